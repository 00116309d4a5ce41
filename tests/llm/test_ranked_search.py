import math
import random
import re
from collections import Counter

import numpy as np

from chronicle.llm import ranked_search

DOCS = "doc_id bigint, text string, item_id int, score string, keys int"
ITEMS = "item_id bigint, text string, doc_id int, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    counted = [(k, Counter(w), len(w)) for k, t in docs if (w := words(t))]
    n, total = len(counted), sum(x for *_, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        rows = []
        for key, count, size in counted:
            m = 75 + 25 * size * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * count[t] // (1000 * count[t] + 12 * m))
                for t in words(text) if count[t]
            )
            if score > 0:
                rows.append((-score, key is None, key or 0, key))
        out += [(item, i, key, -score) for i, (score, _, _, key) in enumerate(sorted(rows, key=lambda r: r[:3])[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, top, **more):
    left = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(k, t, 1, 2) for k, t in items], ITEMS)
    return sorted(map(tuple, ranked_search.search(left, right, top, **more).collect()), key=repr)


def corpus(seed, size):
    rng = random.Random(seed)
    names = ["alpha", "Été", "naïve", "b2", "日本", "the", "of", *(f"w{i}" for i in range(150))]
    weights = [30 / (i + 1) for i in range(len(names))]
    docs = [(i, ", ".join(rng.choices(names, weights, k=rng.choice((1, 5, 40, 200))))) for i in range(size)]
    items = [(i, " ".join(rng.choices(names, k=rng.choice((1, 6, 30, 110))))) for i in range(12)]
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK", 37)
    docs, items = corpus(1, 400)
    docs += [(500 + i, docs[i % 3][1]) for i in range(90)]  # copies: equal scores
    docs += [(900, None), (901, ""), (902, "!!! ..."), (None, docs[1][1]), (1, docs[1][1]), (903, "the " * 60_000), (904, "nothing here")]
    items += [(50, None), (51, "?"), (52, "unheard"), (53, "THE the Alpha ÉTÉ été"), (0, items[0][1]), (None, "alpha of")]
    # The item's rows with equal ids are items of their own.
    assert found(spark, docs, items, 5) == brute(docs, items, 5)
    assert found(spark, docs, items, 3, group=200) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(2, 5)
    assert found(spark, docs, [], 5) == found(spark, [], items, 5) == []


def test_masks_are_finished_early():
    rng = np.random.default_rng(7)
    size, postings = 4000, {}
    for term in range(90):
        places = np.flatnonzero(rng.random(size) < (0.4 if term > 4 else 0.01)).astype(np.int32)
        postings[term] = (places, rng.integers(1, 9, len(places)) * 1000)
    weights = {t: 900 if t < 5 else 30 for t in postings}
    item = ranked_search.Item(list(postings) + [0], weights)
    most = {t: int(x.max()) for t, (_, x) in postings.items()}
    scores = np.zeros(size, np.int64)
    for t, (places, impact) in postings.items():
        scores[places] += weights[t] * (2 if t == 0 else 1) * impact
    order = np.lexsort((np.arange(size), -scores))[:10]
    best, evaluated = item.best(postings, most, size, 10, 1)
    assert best == [(int(scores[i]), int(i)) for i in order]
    assert item.best(postings, most, size, 10, best[-1][0])[0] == best
    few, _ = item.masks({t: postings[t] for t in range(4)}, size)[:2]
    assert set(few[few >= 0].tolist()) and len(set(few[few >= 0].tolist())) < 16


def test_counts_beyond_64_bits():
    lengths = np.array([10**9, 5], np.int64)
    made = ranked_search.impacts(np.array([3, 1], np.int64), lengths, 10**10, 10**12)
    expected = [10**9 * t // (1000 * t + 12 * (75 + 25 * n * 10**10 // 10**12)) for t, n in ((3, 10**9), (1, 5))]
    assert made.tolist() == expected
