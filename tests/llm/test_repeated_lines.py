import hashlib
import random

from chronicle.llm import repeated_lines
from chronicle.llm.repeated_lines import deduplicated, digest, without_repeated_lines

SCHEMA = "doc_id long, text string, lang string, n_chars long, least string, first int"


def brute(rows, run=3):
    """Rows in the order of keys; later windows of `run` filled lines that came before are deleted."""
    ordered = sorted({(k, t) for k, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = {}, {}
    for key, text in ordered:
        lines = text.split("\n")
        filled = [i for i, line in enumerate(lines) if line.strip(" \t\r")]
        cut = set()
        for a in range(len(filled) - run + 1):
            window = tuple(lines[i].strip(" \t\r") for i in filled[a : a + run])
            if window in seen:
                cut.update(range(filled[a], filled[a + run - 1] + 1))
            seen.setdefault(window, (key, a))
        gone[key, text] = cut
    out = []
    for key, text in rows:
        if text is None:
            out.append((key, 0, 0, 0, None))
            continue
        lines, cut = text.split("\n"), gone[key, text]
        left = "\n".join(line for i, line in enumerate(lines) if i not in cut)
        runs = sum(1 for i in cut if i - 1 not in cut)
        out.append((key, len(lines), len(cut), runs, hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", len(r[1] or ""), "x", 1) for r in rows], SCHEMA)


def test_matches_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, "\n".join(rng.choice(["a", "b", " c ", "", "\t", "d"]) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n\n\n"), (503, "a\n" * 3000), (504, "z\r\ny\r\nx"), (505, "z\ny\nx"), (None, "p\nq\nr"), (506, "p\nq\nr")]
    rows += [(507, "m\nn\no"), (507, "m\nn\no")]
    got = sorted(map(tuple, digest(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_only_selected_positions_and_windows_beyond_matches_are_written(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(repeated_lines, "kept", lambda df, what: written.setdefault(what, (df.persist(), "")))
    rng = random.Random(4)
    own = lambda i, n: [f"line {i} {j} {rng.random()}" for j in range(n)]
    shared = own("s", 30)
    rows = [(i, "\n".join(own(i, 20) + shared + own(i, 20))) for i in range(20)]
    # A common line among different lines; two of its surroundings repeat each other, but not the first position's.
    rows += [(100 + i, "\n".join([*own(i, 4), *(["before", "common", "behind"] if i in (3, 7) else [*own(i, 1), "common", *own(i, 1)]), *own(i, 4)])) for i in range(9)]
    assert sorted(map(tuple, digest(frame(spark, rows)).collect()), key=repr) == brute(rows)
    lines = sum(t.count("\n") + 1 for _, t in rows)
    assert written["positions"][0].count() < 0.65 * lines
    assert written["windows"][0].count() <= 3 * 9 + 4 * 20  # those of the common line, and at the ends of the shared passage


def test_no_python_on_the_main_path(spark):
    plan = deduplicated(frame(spark, [(1, "a\nb\nc")]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "MapIn"))


def test_documents_keep_their_columns(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc\n"), (4, None), (5, ""), (6, "  ")]
    df = frame(spark, rows)
    out = without_repeated_lines(df)
    assert out.columns == df.columns
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert found == {1: ("a\nb\nc\nd", 7), 2: ("x\ny", 3), 4: (None, 0), 5: ("", 0), 6: ("  ", 2)}
    assert without_repeated_lines(df.limit(0)).count() == 0 and digest(df.limit(0)).count() == 0


def test_long_passages_of_one_and_two_lines(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    long, edge, half, other = words("l", 51), words("e", 50), words("h", 30), words("o", 21)
    rows = [
        (1, f"{long}\n{edge}\nshort\n{half}\n\n{other}\nend"),
        (2, f"mine\n {long}\t"),
        (3, f"{edge}\nown\nshort\nalone"),
        (4, f"x\n{half}\n\n{other}\ny"),
        (5, f"{half}\nbetween\n{other}"),
        (6, long),
        (7, f"{long}\n{long}"),
    ]
    out = {r["doc_id"]: r["text"] for r in deduplicated(frame(spark, rows)).collect()}
    assert out == dict(rows) | {2: "mine", 4: "x\ny", 6: "", 7: ""}
    assert {r["doc_id"] for r in without_repeated_lines(frame(spark, rows)).collect()} == {1, 2, 3, 4, 5}


def test_long_passages_match_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(f"p{k}.{i}" for i in range(n)) for k, n in enumerate([1, 1, 2, 20, 26, 30, 50, 51, 60])]
    rows = [(i, "\n".join(rng.choice(pool + [""]) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    seen, want = set(), {}
    for key, text in rows:
        lines = text.split("\n")
        filled, cut = [i for i, line in enumerate(lines) if line], set()
        for a in range(len(filled)):
            for b in range(a, len(filled)):
                run = tuple(lines[i] for i in filled[a : b + 1])
                if len(run) >= 3 or len(" ".join(run).split()) > 50:
                    # A run repeats if all its parts of up to three lines that count do; single windows decide.
                    if len(run) <= 3 and run in seen:
                        cut.update(range(filled[a], filled[b] + 1))
                    seen.add(run)
        want[key] = "\n".join(line for i, line in enumerate(lines) if i not in cut)
    assert {r["doc_id"]: r["text"] for r in deduplicated(frame(spark, rows)).collect()} == want
