"""Pairs of alike names against all pairs."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest

from chronicle.operators import similar_names

NAMES = "normal string, tokens array<string>, name_phone string"


def sample(seed, size, words):
    """Names of one frequent word and some rarer ones, with typing errors."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(1, 9))) for _ in range(words)]
    names = set()
    while len(names) < size:
        own = rng.sample(pool, rng.randint(1, rng.choice([2, 2, 5])))
        if rng.random() < 0.6:
            word = own[-1]
            at = rng.randrange(len(word))
            own[-1] = word[:at] + rng.choice(["", "a", "x", word[at] * 2]) + word[at + 1 :]
        if rng.random() < 0.8:
            own.append("popescu")
        rng.shuffle(own)
        names.add(" ".join(filter(None, own)))
    return sorted(names - {""})


def turned(sign):
    lengths, letters = sign.split(":")
    return "-".join(reversed(lengths.split("-"))) + ":" + letters


def brute_force(names, rare):
    near, subset = set(), set()
    for a, b in combinations(names, 2):
        x, y = set(a.split()), set(b.split())
        if x & y & rare and x != y:
            if x < y or y < x:
                subset.add((a, b))
            else:
                left, right = " ".join(sorted(x)), " ".join(sorted(y))
                if max(SequenceMatcher(None, p, q).ratio() for p, q in ((left, right), (right, left))) >= 0.85:
                    near.add((a, b))
    return near, subset


@pytest.mark.parametrize("block", [0, 40, 10**6])
def test_all_alike_names_are_found_once(spark, block):
    names = sample(3, 500, 60)
    counts = {}
    for name in names:
        for token in set(name.split()):
            counts[token] = counts.get(token, 0) + 1
    rare = {token for token in counts if len(token) > 1}
    near, subset = brute_force(names, rare)
    assert len(near) > 100 and len(subset) > 100
    rows = [(n, sorted(set(n.split())), None) for n in names] + [("40 1", ["1", "40"], "401"), ("40", ["40"], "401"), ("40 2", ["2", "40"], "402")]
    counts["40"] = 3
    found = similar_names.candidates(
        spark.createDataFrame(rows, NAMES),
        spark.createDataFrame([(t, counts[t]) for t in sorted(rare | {"40"})], "token string, identities bigint"), block,
    ).collect()
    pairs = [(r["kind"], r["name_a"], r["name_b"]) for r in found]
    assert len(pairs) == len(set(pairs))
    assert {p[1:] for p in pairs if p[0] == "subset"} == subset
    assert near <= {p[1:] for p in pairs if p[0] == "near"}
    assert [p for p in pairs if p[0] == "phone"] == [("phone", "40", "40 1")]
    assert not {p[1:] for p in pairs if p[0] == "near"} & subset


def test_alike_rests_share_a_signature():
    """All lengths, also those for which letters are cut into classes."""
    rng = random.Random(7)
    for _ in range(1500):
        rest = "".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(0, 26)))
        other = list(rest)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(other))
            other[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e"])
        other = "".join(other)
        token = "popescu"[: rng.randint(2, 7)]
        a, b = f"{token} {rest}", f"{token} {other}"
        if SequenceMatcher(None, a, b).ratio() >= 0.85:
            assert set(similar_names.signatures(rest + " ", len(a))) & set(map(turned, similar_names.signatures(other + " ", len(b)))), (a, b)


def test_lists_do_not_grow_with_the_block():
    """A word on five thousand names: what meets under one list, against all pairs of the block."""
    rng = random.Random(11)
    rests = {"".join(rng.choice("aeioubcdfghlmnprstvz") for _ in range(rng.randint(5, 9))) for _ in range(5000)}
    sizes = {}
    for rest in rests:
        for sign in similar_names.signatures(rest + " ", len(rest) + 8):
            sizes[sign] = sizes.get(sign, 0) + 1
    met = sum(n * sizes.get(turned(sign), 0) for sign, n in sizes.items()) / 2
    assert sum(sizes.values()) < 300 * len(rests) and met < len(rests) ** 2 / 2 / 20
