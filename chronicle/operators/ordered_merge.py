"""The ordered merge of large parts, as rounds of joins; `merging.merge_component` states what it computes.

Pairs of a group are tried by (level, a, b): pairs of one spelling or phone before pairs of equal words. A merge is refused where
the clusters hold different values under one key: two phones of a source, or both sides of a rejection. Sets of values only grow,
so a refused pair stays refused. An untried pair that is the first one at both its clusters can therefore be decided at once: what
comes before it touches neither cluster. A round decides all such pairs, and with them all that follow from the same first identity:

1. Each cluster finds its first pair that nothing refuses. In one group that is the pair of its own smallest member and the smallest
   member of any cluster it agrees with. Clusters of a group are therefore listed under the values they hold of those keys that
   another kind of cluster in the group holds too (a kind is a set of keys, and a group has few): the first two of each list will do.
2. A cluster whose first pair starts at its own identity `a` is a hub; clusters whose first pair comes from `a` are its leaves. Leaves
   are decided up to the first cluster that agrees with the hub through `a` but has an earlier pair elsewhere.
3. Among these leaves, the first that holds a key sets its value; a leaf joins unless it or one before it holds another value.
   The rest is looked at again in the next round.

Clusters without a pair are finished and leave the rounds. The first of all open pairs is always decided, so the rounds end; a name or
phone on any number of identities takes a few. They are as many as the longest chain of pairs that wait for each other, which
identities of several names can make long. No task holds a part or a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronicle.session import staged

_PLACE = ["grp", "level", "mine", "other", "vals"]


def merge_in_rounds(start: DataFrame, groups: DataFrame, claims: DataFrame) -> DataFrame:
    """(identity, cluster) from the first clusters (identity, cluster), groups (identity, grp, exact), claims (identity, key, value)."""
    names = staged(_memberships(start, groups))
    claims = staged(claims.join(start.select("identity"), "identity", "left_semi"))
    members, finished = staged(start), []
    while True:
        held = staged(_held(members, claims))
        reach = staged(_reach(names, members, held))
        first = staged(_first_pairs(reach))
        finished.append(members.join(first, "cluster", "left_anti").select("identity", "cluster"))
        if first.isEmpty():
            break
        joined = _accepted(reach, first, held)
        members = staged(
            members.join(first, "cluster", "left_semi").join(joined, "cluster", "left")
            .select("identity", F.coalesce("hub", "cluster").alias("cluster"))
        )
    every = staged(reduce(DataFrame.unionByName, finished))
    smallest = every.groupBy("cluster").agg(F.min("identity").alias("smallest"))
    return every.join(smallest, "cluster").select("identity", F.col("smallest").alias("cluster"))


def _memberships(start: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, level, identity): groups of one spelling or phone at level 0, groups of equal words in several spellings at level 1."""
    own = groups.join(start.select("identity"), "identity", "left_semi")
    spelled = own.select(F.concat_ws("\x1f", "grp", "exact").alias("grp"), F.lit(0).alias("level"), "identity")
    several = own.filter("grp LIKE 'name:%'").groupBy("grp").agg((F.min("exact") != F.max("exact")).alias("several"))
    worded = own.join(several.filter("several"), "grp").select("grp", F.lit(1).alias("level"), "identity").distinct()
    return spelled.unionByName(worded)


def _held(members: DataFrame, claims: DataFrame) -> DataFrame:
    """(cluster, key, value); a cluster that confirmed merges gave several values agrees with nobody who holds the key."""
    found = claims.join(members, "identity").groupBy("cluster", "key").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.concat(F.lit("\x00"), "cluster"))
    return found.select("cluster", "key", value.alias("value"))


def _reach(names: DataFrame, members: DataFrame, held: DataFrame) -> DataFrame:
    """(grp, level, cluster, first, mine, other, vals): each cluster of a group for each kind of cluster in it.

    `first` is its smallest member there, `mine` its keys, `other` the keys of the kind, `vals` what it holds of their common keys.
    """
    signs = held.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("held"))  # sources and rulings of one
    rows = names.join(members, "identity").groupBy("grp", "level", "cluster").agg(F.min("identity").alias("first"))
    mixed = rows.groupBy("grp", "level").agg((F.min("cluster") != F.max("cluster")).alias("mixed")).filter("mixed")
    rows = rows.join(mixed.select("grp", "level"), ["grp", "level"]).join(signs, "cluster", "left")
    rows = staged(
        rows.withColumn("held", F.coalesce("held", F.array().cast("array<struct<key:string,value:string>>")))
        .withColumn("mine", F.transform("held", lambda claim: claim["key"]))
    )
    kinds = rows.select("grp", "level", F.col("mine").alias("other")).distinct()
    common = F.filter("held", lambda claim: F.array_contains("other", claim["key"]))
    return rows.join(kinds, ["grp", "level"]).withColumn("vals", common).select(*_PLACE[:2], "cluster", "first", *_PLACE[2:])


def _seen_from_there(lists: DataFrame) -> DataFrame:
    """Lists by the place of those who look for them."""
    return lists.withColumns({"mine": F.col("other"), "other": F.col("mine")})


def _two(rows: DataFrame) -> DataFrame:
    """The first two rows of each list."""
    place = Window.partitionBy(*_PLACE).orderBy("first")
    return rows.withColumn("_n", F.row_number().over(place)).filter("_n <= 2").drop("_n")


def _first_pairs(reach: DataFrame) -> DataFrame:
    """(cluster, level, a, b, owner): the first pair of each cluster that nothing refuses; `owner` is the cluster of a."""
    lists = _two(reach).groupBy(*_PLACE).agg(
        F.min(F.struct("first", "cluster")).alias("one"), F.max(F.struct("first", "cluster")).alias("two")
    )
    met = reach.join(_seen_from_there(lists), _PLACE)
    to = F.when(F.col("one.cluster") != F.col("cluster"), F.col("one")).when(F.col("two.cluster") != F.col("cluster"), F.col("two"))
    met = met.withColumn("to", to).filter("to IS NOT NULL").select(
        "cluster", "level", F.least("first", "to.first").alias("a"), F.greatest("first", "to.first").alias("b"),
        F.when(F.col("first") < F.col("to.first"), F.col("cluster")).otherwise(F.col("to.cluster")).alias("owner"),
    )
    return met.groupBy("cluster").agg(F.min(F.struct("level", "a", "b", "owner")).alias("e")).select("cluster", "e.*")


def _accepted(reach: DataFrame, first: DataFrame, held: DataFrame) -> DataFrame:
    """(cluster, hub): the leaves that join their hub in this round."""
    hubs = first.filter("owner = cluster").select(F.col("cluster").alias("hub"), "level", "a")
    leaves = first.filter("owner <> cluster").withColumnRenamed("owner", "hub").join(hubs, ["hub", "level", "a"])
    # Of two different tags in a list, one is not the hub's.
    tagged = reach.join(first.select("cluster", F.struct("level", "a").alias("tag")), "cluster")
    others = _two(tagged.groupBy(*_PLACE, "tag").agg(F.min("first").alias("first")))
    others = _seen_from_there(others).withColumnRenamed("first", "late")
    looking = reach.join(hubs.select(F.col("hub").alias("cluster"), "level", F.col("a").alias("first")), ["cluster", "level", "first"])
    waits = (
        looking.join(others, _PLACE).filter((F.col("tag") != F.struct("level", F.col("first").alias("a"))) & (F.col("late") > F.col("first")))
        .groupBy(F.col("cluster").alias("hub")).agg(F.min("late").alias("late"))
    )
    ready = staged(leaves.join(waits, "hub", "left").filter("late IS NULL OR b < late").select("cluster", "hub", "b"))
    claimed = staged(ready.join(held, "cluster"))
    leading = claimed.groupBy("hub", "key").agg(F.min_by("value", "b").alias("set"))
    stops = claimed.join(leading, ["hub", "key"]).filter(F.col("value") != F.col("set")).groupBy("hub", "key").agg(F.min("b").alias("stop"))
    later = claimed.join(stops, ["hub", "key"]).filter(F.col("b") >= F.col("stop")).select("cluster").distinct()
    return ready.join(later, "cluster", "left_anti").select("cluster", "hub")
