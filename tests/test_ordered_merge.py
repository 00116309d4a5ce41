"""The ordered merge in rounds against the pass over one part, which test_entities compares with all pairs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from chronicle.operators import entities, ordered_merge
from chronicle.operators.merging import merge_component

GROUPS = "identity string, grp string, exact string"
CLAIMS = "identity string, key string, value string"


def part(seed, size):
    """Facts of one part: names in several spellings, phones of two sources, rulings, confirmed merges."""
    rng = random.Random(seed)
    keys = [f"{seed:04}-{i:05}" for i in rng.sample(range(99999), size)]
    facts = []
    for key in keys:
        for source in rng.sample(["w", "s", "m"], rng.choice([1, 1, 2])):
            facts.append(("source", key, source, rng.choice([None, None, f"p{rng.randrange(4)}"])))
        for name in rng.sample(range(4), rng.choice([1, 1, 2])):
            facts.append(("group", key, f"name:{seed}-{name}", rng.choice(["x", "x", "y"])))
        if rng.random() < 0.2:
            facts.append(("group", key, f"phone:{seed}-{rng.randrange(3)}", ""))
    for n in range(rng.randrange(4)):
        for key in rng.sample(keys, min(size, rng.choice([2, 3]))):
            facts.append(("reject", key, f"r{seed}-{n}", rng.choice("ab")))
    for _ in range(rng.randrange(3)):
        facts.append(("merge", *sorted(rng.sample(keys, 2)), None))
    return sorted(set(facts), key=str)


def in_rounds(spark, facts):
    keys = sorted({a for what, a, *_ in facts if what == "source"})
    merges = [(a, b) for what, a, b, _ in facts if what == "merge"]
    nodes = spark.createDataFrame([(k,) for k in keys], "node string")
    start = entities.components(nodes, spark.createDataFrame(merges, "a string, b string"))
    start = start.select(F.col("node").alias("identity"), F.col("component").alias("cluster"))
    groups = spark.createDataFrame([f[1:] for f in facts if f[0] == "group"], GROUPS)
    claims = [(a, f"{what}:{b}", c) for what, a, b, c in facts if what in ("source", "reject") and c]
    merged = ordered_merge.merge_in_rounds(start, groups, spark.createDataFrame(claims, CLAIMS))
    rows = merged.collect()
    assert len(rows) == len(keys)
    return dict(map(tuple, rows))


def test_random_parts_equal_the_ordered_pass(spark):
    parts = [part(seed, size) for seed, size in enumerate([2, 3, 5, 8, 13] * 40 + [24] * 10)]
    expected = {}
    for facts in parts:
        expected.update(merge_component(facts))
    assert in_rounds(spark, [fact for facts in parts for fact in facts]) == expected


def test_a_name_with_many_phones_takes_few_rounds(spark, monkeypatch):
    """A third of the identities have one phone, a third phones of their own, a third none; one name for all."""
    size, rounds = 6000, []
    facts = []
    for i in range(size):
        key = f"i{i * 7919 % size:05}"
        facts.append(("group", key, "name:n", "x" if i % 5 else "y"))
        facts.append(("source", key, "w", [None, "same", f"p{i}"][i % 3]))
    first_pairs = ordered_merge._first_pairs
    monkeypatch.setattr(ordered_merge, "_first_pairs", lambda reach: rounds.append(1) or first_pairs(reach))
    found = in_rounds(spark, facts)
    assert found == merge_component(facts) and len(rounds) <= 6
    assert len(set(found.values())) == size // 3 + 1 or len(set(found.values())) == size // 3


def test_parts_are_merged_alike_in_a_task_and_in_rounds(spark):
    names = defaultdict(set)
    rng = random.Random(5)
    for i in range(40):
        key = f"whatsapp:+40{rng.randrange(30)}" if i % 2 else f"bank:name:{i}"
        names[key].add(rng.choice(["Ana Moon", "Moon Ana", "Ion Owl", "ana  moon", "Owl"]))
    rows = [(k, n, k.split(":")[0], 1, 0) for k, own in sorted(names.items()) for n in sorted(own)]
    identities = spark.createDataFrame(rows, "identity string, name string, source string, n bigint, preferred_n bigint")
    keys = sorted(names)
    decisions = spark.createDataFrame([(keys[0], keys[9], "reject"), (keys[3], keys[13], "merge"), (keys[5], keys[14], "reject")], "a string, b string, decision string")
    one, other = (dict(map(tuple, entities.cluster_identities(identities, decisions, n).collect())) for n in (10**6, 0))
    assert one == other and len(one) == len(keys)
    nothing = identities.limit(0)
    assert entities.cluster_identities(nothing, decisions.limit(0), 0).count() == 0
