import random

from chronicle.llm.near_copies import without_near_copies
from chronicle.llm.similar import grouped


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, least=0.8):
    """(key, smallest key of the group), and the number of pairs of different sets that are similar."""
    found = [sets(t) for _, t in rows]
    label, close = list(range(len(rows))), []
    by_shingle = {}
    for i, own in enumerate(found):
        for s in own or {None}:
            by_shingle.setdefault(s, []).append(i)
    pairs = {(a, b) for held in by_shingle.values() for n, b in enumerate(held) for a in held[:n]}
    for i, j in pairs:
        a, b = found[i], found[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            close.append((i, j))
    moved = True
    while moved:
        moved = False
        for i, j in close:
            low = min(label[i], label[j])
            moved |= label[i] != label[j]
            label[i] = label[j] = low
    groups = {}
    for i, root in enumerate(label):
        groups.setdefault(root, []).append(rows[i][0])
    lowest = {root: min((k for k in keys if k is not None), default=None) for root, keys in groups.items()}
    return sorted(((k, lowest[label[i]]) for i, (k, _) in enumerate(rows)), key=repr), sum(found[i] != found[j] for i, j in close)


def test_documents_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    want, _ = brute(rows)
    assert sorted(map(tuple, grouped(df).collect()), key=repr) == want


def test_edited_copies_around_the_threshold(spark):
    rng = random.Random(4)
    rows = [(900, None), (901, ""), (902, " \n"), (None, "no name here"), (903, "One  two"), (904, "one two"), (905, "one two three")]
    for i in range(120):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 120, 400]))]
        rows.append((2 * i, " ".join(base)))
        for place in rng.sample(range(len(base)), max(1, len(base) * rng.randint(1, 6) // 200)):
            base[place] = "edited"
        rows.append((2 * i + 1, " ".join(base)))
    crowd = [f"c{i}" for i in range(200)]
    for i in range(60):
        edited = crowd[:]
        edited[rng.randrange(200)] = f"e{i}"
        rows.append((1000 + i, " ".join(edited)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, class string, n int")
    want, close = brute(rows)
    assert close > 60 * 59 // 2 + 40
    assert sorted(map(tuple, grouped(df).collect()), key=repr) == want
    assert sorted(map(tuple, grouped(df, chunk=4).collect()), key=repr) == want
    left = [r["doc_id"] for r in without_near_copies(df).collect()]
    assert sorted(left, key=repr) == sorted([k for k, c in want if k is None or k == c], key=repr)
    assert grouped(df.limit(0)).count() == 0
