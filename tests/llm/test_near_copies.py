import random
import re

import xxhash

from chronicle.llm.near_copies import RADIUS, Tree, fingerprint, grouped, without_near_copies


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= RADIUS and label[j] < label[i]:
                    label[i] = label[j]
                    moved = True
    groups = {}
    for i, root in enumerate(label):
        groups.setdefault(root, []).append(rows[i][0])
    least = {root: min((k for k in keys if k is not None), default=None) for root, keys in groups.items()}
    return sorted(((k, f"{prints[i]:016x}", least[label[i]]) for i, (k, _) in enumerate(rows)), key=repr)


def test_fingerprints():
    for text in (None, "", " \t\n", "One", "a b c", "A b C d E", "x\x0by\x0cz\x1cw é É", "w " * 500):
        assert fingerprint(None if text is None else text.encode()) == plain_print(text)


def test_documents_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    assert sorted(map(tuple, grouped(df).collect()), key=repr) == brute(rows)


def test_odd_rows_and_crowded_shards(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(5, None), (9, ""), (3, " \n"), (None, "alone and unnamed"), (4, "x" * 200_000), (4, "x" * 200_000)]
    for i in range(60):
        edited = base[:]
        edited[rng.randrange(300)] = "edited"
        rows.append((100 + i, " ".join(edited)))
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, print string, node int")
    want = brute(rows)
    assert sorted(map(tuple, grouped(df).collect()), key=repr) == want
    assert sorted(map(tuple, grouped(df, tree=4).collect()), key=repr) == want
    left = without_near_copies(df)
    assert left.columns == df.columns
    keys = [r["doc_id"] for r in left.collect()]
    assert sorted(k for k in keys if k is not None) == sorted([*{c for k, _, c in want if k is not None}, 4])
    assert None in keys and grouped(df.limit(0)).count() == 0


def test_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) & (1 << 64) - 1 for b in base for _ in range(20)]
    tree, seen = Tree(), []
    for value in dict.fromkeys(values):
        assert sorted(tree.within(value, 4)) == sorted(v for v in seen if (v ^ value).bit_count() <= 4)
        tree.insert(value)
        seen.append(value)
