"""What the user ruled on who is who: each ruling holds between two sets of identities.

A ruling on two contacts covers every pair of identities across them. It is kept as its members, one row for each: (ruling, side, identity,
decision, decided_at), so its size is the sum of its sides and never their product. Of rulings on one pair the last counts; at the same
moment a rejection does. A ruling of which a later one replaces a part is cut into smaller ones, between the members that the later ones treat
alike; pairs are never written. Everything else asks the two sides: a confirmed merge is two stars, and two clusters are kept apart if one holds an identity of
one side and the other an identity of the opposite side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronicle.functions.hashing import content_hash
from chronicle.session import staged

COLUMNS = ("ruling", "side", "identity", "decision", "decided_at")
A, B = "a", "b"


def rule(left: DataFrame, right: DataFrame, name: tuple[str, str], decision: str, at: Column) -> DataFrame:
    """The rows of one ruling between two frames of identities (column `key`); `name` is what the user named."""
    ruling = content_hash(F.lit("ruling"), *map(F.lit, sorted(name)), F.lit(decision), at)
    sides = [
        keys.select(ruling.alias("ruling"), F.lit(side).alias("side"), F.col("key").alias("identity"), F.lit(decision).alias("decision"), at.alias("decided_at"))
        for side, keys in ((A, left), (B, right))
    ]
    return sides[0].unionByName(sides[1])


def of_pairs(decisions: DataFrame) -> DataFrame:
    """Pairs (a, b, decision[, decided_at]) as rulings of one identity on each side."""
    at = F.col("decided_at") if "decided_at" in decisions.columns else F.lit(None).cast("timestamp")
    rows = decisions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "decision", at.alias("decided_at"))
    rows = rows.withColumn("ruling", content_hash(F.lit("pair"), *map(F.col, ("a", "b", "decision", "decided_at"))))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("identity")) for s in (A, B)]))
    return rows.select("ruling", sides.alias("x"), "decision", "decided_at").select(
        "ruling", "x.side", "x.identity", "decision", "decided_at"
    )


def as_rulings(decisions: DataFrame) -> DataFrame:
    """Rulings, whether given as such or as pairs."""
    return decisions.select(*COLUMNS) if "ruling" in decisions.columns else of_pairs(decisions)


def pairs_of(rulings: DataFrame) -> DataFrame:
    """(a, b, decision, decided_at): every pair of rulings, the last ruling of each."""
    left = rulings.filter(F.col("side") == A).select("ruling", F.col("identity").alias("x"), "decision", "decided_at")
    right = rulings.filter(F.col("side") == B).select("ruling", F.col("identity").alias("y"))
    pairs = left.join(right, "ruling").filter("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "decision", "decided_at")
    last = F.max(F.struct(F.col("decided_at"), F.col("decision"))).alias("last")  # reject sorts after merge
    return pairs.groupBy("a", "b").agg(last).select("a", "b", "last.decision", "last.decided_at")


def _replaced(rulings: DataFrame, members: DataFrame) -> DataFrame:
    """(ruling, later): rulings that share a pair with a later one. Rulings on one pair alone are different pairs here."""
    wide = members.groupBy("ruling").agg(F.count("*").alias("n")).filter("n > 2").select("ruling")
    first = members.join(wide, "ruling").select(F.col("ruling").alias("one"), F.col("side").alias("side_one"), "identity")
    other = members.select(F.col("ruling").alias("two"), F.col("side").alias("side_two"), "identity")
    met = first.join(other, "identity").filter("one <> two")
    met = met.groupBy("one", "two").agg(F.collect_set(F.concat("side_one", "side_two")).alias("sides"))  # four at most
    both = lambda x, y: F.array_contains("sides", x) & F.array_contains("sides", y)
    crossed = met.filter(both("aa", "bb") | both("ab", "ba")).select("one", "two")
    age = rulings.groupBy("ruling").agg(F.max(F.struct(F.col("decided_at"), F.col("decision"), F.col("ruling"))).alias("age"))
    ages = [age.select(F.col("ruling").alias(n), F.col("age").alias(f"age_{n}")) for n in ("one", "two")]
    aged = crossed.join(ages[0], "one").join(ages[1], "two")
    earlier = F.col("age_one") < F.col("age_two")
    return aged.select(
        F.when(earlier, F.col("one")).otherwise(F.col("two")).alias("ruling"),
        F.when(earlier, F.col("two")).otherwise(F.col("one")).alias("later"),
    ).distinct()


def effective(rulings: DataFrame) -> DataFrame:
    """Rulings of which no two share a pair: the last one on each pair counts.

    The members of a side that are on the same sides of the same later rulings have one fate. Of these classes, the pairs that no
    later ruling covers go on as rulings, so what is left of a ruling has the size of its sides times the number of classes.
    """
    rulings = staged(rulings)
    if rulings.isEmpty():
        return rulings
    members = staged(rulings.select("ruling", "side", "identity").distinct())
    # Of rulings on one pair alone the last stays.
    narrow = members.groupBy("ruling").agg(F.count("*").alias("n"), F.min("identity").alias("x"), F.max("identity").alias("y"))
    last = F.max(F.struct(F.col("decided_at"), F.col("decision"), F.col("ruling"))).alias("last")
    facts = rulings.select("ruling", "decision", "decided_at").distinct()
    newest = narrow.filter("n = 2").join(facts, "ruling").groupBy("x", "y").agg(last).select("last.ruling")
    wide = narrow.filter("n > 2").select("ruling")
    stay = newest.unionByName(wide)
    rulings = staged(rulings.join(stay, "ruling", "left_semi").select(*COLUMNS).distinct())
    members = rulings.select("ruling", "side", "identity")
    replaced = staged(_replaced(rulings, members))
    if replaced.isEmpty():
        return rulings
    touched = rulings.join(replaced.select("ruling").distinct(), "ruling", "left_semi")
    on = replaced.join(members.select(F.col("ruling").alias("later"), F.col("side").alias("_on"), "identity"), "later")
    fates = on.groupBy("ruling", "identity").agg(F.sort_array(F.collect_set(F.concat_ws(":", "later", "_on"))).alias("fate"))
    fated = staged(touched.join(fates, ["ruling", "identity"], "left").withColumn("fate", F.coalesce("fate", F.array().cast("array<string>"))))
    classes = [
        fated.filter(F.col("side") == s).select("ruling", F.col("fate").alias(f"fate_{s}")).distinct() for s in (A, B)
    ]
    opposite = F.transform("fate_b", lambda f: F.concat(F.substring_index(f, ":", 1), F.when(f.endswith(":a"), ":b").otherwise(":a")))
    left = classes[0].join(classes[1], "ruling").filter(~F.arrays_overlap("fate_a", opposite))
    named = left.withColumn("_new", content_hash(F.col("ruling"), F.array_join("fate_a", ","), F.array_join("fate_b", ",")))
    parts = [
        fated.filter(F.col("side") == s).join(named.select("ruling", F.col(f"fate_{s}").alias("fate"), "_new"), ["ruling", "fate"])
        for s in (A, B)
    ]
    rest = [p.select(F.col("_new").alias("ruling"), *COLUMNS[1:]) for p in parts]
    alone = rulings.join(replaced.select("ruling").distinct(), "ruling", "left_anti").select(*COLUMNS)
    return staged(reduce(DataFrame.unionByName, [alone, *rest]))


def known(rulings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members that exist, in rulings that have some left on both sides."""
    rows = staged(rulings.join(nodes.select(F.col("node").alias("identity")), "identity", "left_semi"))
    whole = rows.groupBy("ruling").agg((F.min("side") != F.max("side")).alias("whole")).filter("whole")
    return rows.join(whole.select("ruling"), "ruling", "left_semi").select(*COLUMNS)


def merges(rulings: DataFrame) -> DataFrame:
    """(a, b): links that connect whatever the confirmed merges connect, one or two for each member."""
    rows = rulings.filter("decision = 'merge'")
    heads = rows.groupBy("ruling").agg(*[F.min(F.when(F.col("side") == s, F.col("identity"))).alias(f"head_{s}") for s in (A, B)])
    head = F.when(F.col("side") == A, F.col("head_b")).otherwise(F.col("head_a"))
    return rows.join(heads, "ruling").select(head.alias("a"), F.col("identity").alias("b")).filter("a <> b").distinct()


def rejects(rulings: DataFrame) -> DataFrame:
    """(ruling, side, identity) of the rejections."""
    return rulings.filter("decision = 'reject'").select("ruling", "side", "identity").distinct()


def rejected(pairs: DataFrame, refused: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that a rejection covers; only asked pairs are looked up."""
    one = refused.select(F.col("identity").alias("a"), "ruling", F.col("side").alias("_one"))
    two = refused.select(F.col("identity").alias("b"), "ruling", F.col("side").alias("_two"))
    return pairs.select("a", "b").join(one, "a").join(two, ["b", "ruling"]).filter("_one <> _two").select("a", "b").distinct()
