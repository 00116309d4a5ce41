import hashlib
import re
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronicle.llm import conversation_repair as repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conversation string, _id int"
TURNS = st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans())


def cheapest(turns):
    """Least (cost, audit) over all edits, by search over how many turns are read and the repaired initials so far."""
    best = None
    limit = 3 * len(turns) + 2
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        heap.sort()
        cost, audit, place, out = heap.pop(0)
        if best is not None and cost > best[0]:
            break
        if place == len(turns) and re.fullmatch("(s?(ua)+)?", out):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if (cost, audit, place, out) in seen or cost > limit:
            continue
        seen.add((cost, audit, place, out))
        steps = [(2, "I", 0, i) for i in "ua"] if len(out) < 2 * len(turns) + 4 else []
        if place < len(turns):
            initial, must_go, truncated = turns[place]
            steps.append((3, "D", 1, ""))
            if not must_go:
                steps += [(0 + truncated, "K", 1, initial)] + [(2 + truncated, "R", 1, i) for i in "ua" if i != initial]
        for more, letter, read, initial in steps:
            if re.fullmatch("s?(ua)*u?", out + initial):
                heap.append((cost + more, audit + letter, place + read, out + initial))
    return best[:2]


@settings(max_examples=60, deadline=None)
@given(st.lists(TURNS, max_size=4))
def test_chart_equals_search_over_all_edits(turns):
    cells = repair.chart(tuple(turns))
    assert min(c for c in (cells[0], cells[3]) if c is not None) == cheapest(turns)


@settings(max_examples=60, deadline=None)
@given(st.lists(TURNS, min_size=2, max_size=12))
def test_every_split_of_a_span_gives_the_same_cells(turns):
    whole = repair.chart(tuple(turns))
    for split in range(1, len(turns)):
        assert repair.combined(repair.chart(tuple(turns[:split])), repair.chart(tuple(turns[split:]))) == whole


@settings(max_examples=80, deadline=None)
@given(st.lists(TURNS, max_size=14), st.integers(1, 4))
def test_chain_of_stretches_equals_one_chart(turns, size):
    whole = repair.chart(tuple(turns))
    cost, audit = min(c for c in (whole[0], whole[3]) if c is not None)
    chain, parts = repair.Chain(), [tuple(turns[i : i + size]) for i in range(0, len(turns), size)]
    for part in parts:
        chain.add(*repair.summary(repair.chart(part)))
    found, states = chain.solved()
    audits = [repair.chart(part)[4 * a + b][1] for part, a, b in zip(parts, states, states[1:])]
    assert found == cost and "".join(audits) == (audit if turns else "")


def brute(rows, legal=("su", "ua", "au")):
    """The contract by hand: rows of one conversation after damage."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, turns, faults = set(), [], []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cells = repair.chart(tuple(turns))
    cost, audit = min(c for c in (cells[0], cells[3]) if c is not None)
    out, i, n = [], 0, 0
    for letter in audit:
        if letter == "K":
            out.append(f"{rows[i][1]}:{rows[i][2]}")
        elif letter in "RI":
            last = out[-1][0] if out else "s"
            out.append(("assistant:" if last == "u" else "user:") + (rows[i][2] if letter == "R" else ""))
        i += letter != "I"
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0] + b[0] not in legal for a, b in zip(turns, turns[1:]))
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit if rows else "", sha)


@pytest.mark.parametrize("stretch", [2, 3, 2048])
def test_edges_and_small_stretches(spark, stretch):
    rows = [(1, t, r, x) for t, r, x in product((0, 1, None), ("user", "assistant", None), ("One.", "Two", None, " "))]
    rows += [(None, t, "user", f"t{t % 3}.") for t in range(40)] + [(2, 5, "", "x."), (2, 9, "system", "y!"), (2, 9, "User", "z?")]
    rows += [(3, 0, "system", "Rule."), (3, 1, "user", "a" * 300_000 + "."), (3, 2, "assistant", "b. \n\t")] + [(4, 1, "user", "Hi.")] * 5
    frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    found = {r[0]: tuple(r)[1:] for r in repair.digest(frame, stretch=stretch).collect()}
    expected = {}
    for key, *rest in rows:
        expected.setdefault(key, []).append(tuple(rest))
    assert found == {k: brute(v) for k, v in expected.items()}


def test_dropped_turns_and_an_empty_table(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 0, "user", "a.", False), (2, 1, "user", "b.", True)], "conv_id bigint, turn bigint, role string, text string, gone boolean")
    found = {r["conv_id"]: r for r in repair.digest(frame, gone="gone").collect()}
    assert tuple(found[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[2]["audit"] == "KI" and found[2]["cost"] == 2
    assert repair.digest(frame.limit(0), gone="gone").count() == 0


def test_damage_follows_the_hash(spark):
    import zlib

    rows = [(k, t, "assistant", "Yes. No!") for k in range(40) for t in range(3)] + [(None, None, None, None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    made = sorted((str(r["conv_id"]), str(r["turn"]), r["role"], r["text"]) for r in repair.damaged(frame).filter("NOT gone").collect())
    expected = []
    for key, turn, role, text in rows:
        damage = zlib.crc32(":".join(" " if x is None else str(x) for x in (key, turn)).encode()) % 20
        role, text = role or " ", text or " "
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        if damage:
            expected += [(str(key), str(turn), "user" if damage == 4 else role, text)] * (1 + (damage == 3))
    assert made == sorted(expected)
