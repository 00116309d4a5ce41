import random
from itertools import combinations

import corpus_pipeline
from chronicle.llm.near_copies import RADIUS, fingerprint, united, without_near_copies


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(key, smallest key of the group) of each row, the pairs of texts that only fingerprints link, and those that only sets link."""
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    label, prints, found = list(range(len(texts))), [fingerprint(t.encode()) for t in texts], [sets(t) for t in texts]
    by_print, by_set = [], []
    for a, b in combinations(range(len(texts)), 2):
        near = (prints[a] ^ prints[b]).bit_count() <= RADIUS
        alike = found[a] == found[b] or 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b])
        by_print += [(texts[a], texts[b])] * (near and not alike)
        by_set += [(texts[a], texts[b])] * (alike and not near)
        if (near or alike) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    group = dict(zip(texts, label))
    keys = {}
    for k, t in rows:
        keys.setdefault(group[t or ""], []).append(k)
    least = {g: min((k for k in held if k is not None), default=None) for g, held in keys.items()}
    return [(k, least[group[t or ""]]) for k, t in rows], by_print, by_set


def stays(want):
    later = {k for k, c in want if k is not None and k != c}
    return sorted((k for k, _ in want if k not in later), key=repr)


def refrain(rng, times):
    """A text that says one phrase again and again: its words of the rest weigh little in a fingerprint, and much in a set."""
    phrase = [f"p{rng.randrange(10**6)}" for _ in range(21)]
    return lambda: " ".join(phrase * times + [f"r{rng.randrange(10**6)}" for _ in range(6)])


def test_fingerprints_and_sets_link(spark):
    rng = random.Random(6)
    rows = []
    for i in range(30):
        said = refrain(rng, 60)
        base = [f"w{rng.randrange(4000)}" for _ in range(120)]
        rows += [(10 * i, said()), (10 * i + 1, said()), (10 * i + 2, " ".join(base))]
        base[rng.randrange(120)] = "edited"
        rows.append((10 * i + 3, " ".join(base)))
    rng.shuffle(rows)
    want, by_print, by_set = brute(rows)
    assert len(by_print) > 15 and len(by_set) > 5
    df = spark.createDataFrame([(*r, None, None, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_dedup(spark, df, "")
    assert left.columns == df.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == stays(want)


def test_groups_are_joined_through_links_of_both_kinds(spark):
    rng = random.Random(7)
    said = refrain(rng, 60)
    first, second = said(), said()
    # A text with one word more is the second's copy by its set; the refrain's two texts are copies by their fingerprints.
    third, fourth = second + " more", "all alone here"
    rows = [(9, first), (5, second), (7, third), (8, fourth), (1, "Two words"), (1, first.upper()), (3, "two  words"), (None, third)]
    rows += [(None, "no name"), (20, None), (21, ""), (4, "another text of its own"), (4, "and one more under one key"), (6, "another text of its own")]
    want, by_print, _ = brute(rows)
    assert (first, second) in by_print
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, component string, _digest string, a int")
    assert sorted(map(tuple, united(df).collect()), key=repr) == sorted(want, key=repr)
    left = without_near_copies(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == stays(want)
    assert united(df.limit(0)).count() == 0 and without_near_copies(df.limit(0)).count() == 0
