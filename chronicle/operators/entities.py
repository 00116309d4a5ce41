"""Who is who: identities from messages and transfers, resolved into contacts.

Identities that share a name form a group. A group is handled as one thing and never as all of its
pairs: equal names merge through the group, and similar names are compared once per pair of
different names, however many identities carry them.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronicle.functions.hashing import content_hash
from chronicle.functions.text import name_tokens, normalise_name, normalise_phone
from chronicle.operators import rulings as R
from chronicle.operators.merging import merge_component
from chronicle.operators.ordered_merge import merge_in_rounds
from chronicle.operators.similar_names import FUZZY, candidates, same_numbers
from chronicle.session import staged

RARE_SHARE = 0.05
AUTO, SUBSET, FUZZY_CAP = 0.95, 0.70, 0.94
PREFERRED_SOURCE = "whatsapp"
PART_FACTS = 50_000


# ---- identities -------------------------------------------------------------------------------


def collect_identities(messages: DataFrame, transactions: DataFrame) -> DataFrame:
    """(identity, name, source, n, preferred_n): who appears under which name, how often."""
    senders = (
        messages.filter(~F.col("is_from_me") & F.col("sender_id").isNotNull())
        .groupBy(F.col("sender_id").alias("identity"), F.col("sender_name").alias("name"), "source")
        .agg(F.count("*").alias("n"))
    )
    parties = transfer_parties(transactions).select(
        "identity", "name", "source", F.lit(1).cast("bigint").alias("n")
    )
    rows = senders.withColumn("name", F.when(F.col("name") != "", F.col("name"))).withColumn(
        "preferred_n", F.when(F.col("source") == PREFERRED_SOURCE, F.col("n")).otherwise(0)
    )
    return rows.unionByName(parties.withColumn("preferred_n", F.lit(0).cast("bigint")))


def transfer_parties(transactions: DataFrame) -> DataFrame:
    """(name, source, identity): counterparties of transfers, keyed by their sorted tokens."""
    names = (
        transactions.filter((F.col("kind") == "transfer") & F.col("counterparty").isNotNull())
        .select(F.col("counterparty").alias("name"), "source")
        .distinct()
        .withColumn("_normal", normalise_name(F.col("name")))
        .filter(F.col("_normal") != "")
    )
    key = F.array_join(F.array_sort(F.split("_normal", " ")), " ")
    return names.select("name", "source", F.concat(F.lit("bank:name:"), key).alias("identity"))


def identity_forms(identities: DataFrame) -> DataFrame:
    """(identity, normal, tokens, name_phone): the different written forms of each identity.

    Distinct names are normalised once, however many identities carry them.
    """
    pairs = identities.filter(F.col("name").isNotNull()).select("identity", "name").distinct()
    names = pairs.select("name").distinct().withColumn("normal", normalise_name(F.col("name")))
    names = names.filter(F.col("normal") != "").withColumns(
        {
            "tokens": name_tokens(F.col("normal")),
            "name_phone": normalise_phone(F.col("name")),
        }
    )
    return pairs.join(names, "name").select("identity", "normal", "tokens", "name_phone").distinct()


def identity_phones(identities: DataFrame) -> DataFrame:
    """(identity, source, phone): phone is NULL for identities that are no phone number."""
    return (
        identities.select("identity", "source")
        .distinct()
        .withColumn("phone", normalise_phone(F.col("identity")))
    )


# ---- similar names ----------------------------------------------------------------------------


def identity_total(identities: DataFrame) -> DataFrame:
    return identities.agg(F.count_distinct("identity").alias("total"))


def rare_tokens(forms: DataFrame, total: DataFrame) -> DataFrame:
    """Tokens of at least two letters that at most 5% of the identities carry."""
    counts = (
        forms.select("identity", F.explode("tokens").alias("token"))
        .filter(F.length("token") >= 2)
        .distinct()
        .groupBy("token")
        .agg(F.count("*").alias("identities"))
    )
    limit = total.select((F.col("total") * RARE_SHARE).alias("limit"))
    return counts.crossJoin(F.broadcast(limit)).filter(F.col("identities") <= F.col("limit")).drop("limit")


def _ratio():
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    return ratio


def name_pairs(forms: DataFrame, rare: DataFrame) -> DataFrame:
    """(name_a, name_b, score, score_ba): different names that share a rare token and are alike.

    The ratio of two names depends on which comes first: `score` is that of name_a before name_b and
    `score_ba` the other. Which counts is decided by the identities that hold the names.

    `similar_names` finds the candidates; the ratio is computed only for those a few edits apart.
    """
    pairs = candidates(forms.select("normal", "tokens", "name_phone").distinct(), rare)

    def scored(first: str, second: str) -> Column:
        ratio = F.when(F.col("kind") == "near", _ratio()(first, second))
        fuzzy = F.when(ratio >= FUZZY, F.least(ratio, F.lit(FUZZY_CAP)))
        return F.when(F.col("kind") == "phone", 1.0).when(F.col("kind") == "subset", SUBSET).otherwise(fuzzy)

    return pairs.select(
        "name_a", "name_b", scored("text_a", "text_b").alias("score"), scored("text_b", "text_a").alias("score_ba")
    ).filter("score IS NOT NULL OR score_ba IS NOT NULL")


# ---- clusters ---------------------------------------------------------------------------------


def equal_groups(forms: DataFrame, phones: DataFrame, rare: DataFrame) -> DataFrame:
    """(identity, grp, exact): groups whose members merge; `exact` tells equal spellings apart.

    Names that are phone numbers are equal when their digits are. Two such names in different
    spellings meet only through a rare token, so each such pair of names is a group of its own.
    """
    name = F.concat(
        F.lit("name:"), F.array_join("tokens", " "), F.lit("\x1f"), F.coalesce("name_phone", F.lit(""))
    )
    spelling = F.when(F.col("name_phone").isNotNull(), "").otherwise(F.col("normal"))
    by_name = forms.select("identity", name.alias("grp"), spelling.alias("exact"))
    numbers = forms.filter("name_phone IS NOT NULL")
    twins = same_numbers(numbers.select("normal", "tokens", "name_phone").distinct(), rare).select(
        F.concat(F.lit("pair:"), "name_a", F.lit("\x1f"), "name_b").alias("grp"),
        F.explode(F.array("name_a", "name_b")).alias("normal"),
    )
    by_twin = numbers.join(twins, "normal").select("identity", "grp", F.lit("").alias("exact"))
    by_phone = phones.filter("phone IS NOT NULL").select(
        "identity", F.concat(F.lit("phone:"), F.col("phone")).alias("grp"), F.lit("").alias("exact")
    )
    return by_name.unionByName(by_twin).unionByName(by_phone).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node is connected to.

    Links of a group are a star around its smallest member. Every round, nodes take the smallest
    label around them and labels are shortcut to their own label, so that long chains close in
    few rounds.
    """
    edges = staged(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = staged(nodes.select("node", F.col("node").alias("component")))
    while True:
        around = (
            edges.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(around, "node", "left").select(
            "node", "component", F.least("component", F.coalesce("near", "component")).alias("low")
        )
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("lowest"))
        after = staged(
            lower.join(jump, "low").select(
                "node", F.col("lowest").alias("component"), (F.col("lowest") != F.col("component")).alias("moved")
            )
        )
        labels = after.select("node", "component")
        if not after.agg(F.max("moved")).first()[0]:
            return labels


def cluster_identities(identities: DataFrame, decisions: DataFrame, part_facts: int = PART_FACTS) -> DataFrame:
    """(identity, cluster): confirmed merges, then equal names and phones, unless refused.

    `decisions` are rulings, or pairs (see `rulings`).

    Connected parts without a refusal are clusters as they are. A part in which something refuses
    (a rejected pair, or two phone numbers of one source) is merged in the order of its pairs. The
    identities that cannot change that order's outcome are settled before: see `_settled`. A part of at
    most `part_facts` names, phones and rulings is merged in one task, a larger one in rounds over all
    tasks, with the same result: see `ordered_merge`.
    """
    forms = staged(identity_forms(identities))
    phones = staged(identity_phones(identities))
    nodes = phones.select(F.col("identity").alias("node")).distinct()
    groups = staged(equal_groups(forms, phones, rare_tokens(forms, identity_total(identities))))
    ruled = staged(R.known(R.effective(R.as_rulings(decisions)), nodes))
    merges, rejects = staged(R.merges(ruled)), R.rejects(ruled)
    heads = groups.groupBy("grp").agg(F.min("identity").alias("head"))
    star = groups.join(heads, "grp").filter("identity <> head").select(
        F.col("head").alias("a"), F.col("identity").alias("b")
    )
    labels = components(nodes, star.unionByName(merges))
    labels = staged(labels.withColumnRenamed("node", "identity"))
    refusing = staged(_refusing(labels, phones, rejects))
    calm = labels.join(refusing.select("component"), "component", "left_anti").select(
        "identity", F.col("component").alias("cluster")
    )
    troubled = labels.join(refusing, "component")
    settled = _settled(troubled.filter("NOT has_rejects"), groups, phones, merges)
    settled = staged(settled)
    rest = troubled.join(settled.select("identity"), "identity", "left_anti")
    merged = _merge_in_order(rest, groups, phones, merges, rejects, part_facts)
    followers = settled.filter("leader <> identity").select("identity", F.col("leader"))
    alone = settled.filter("leader = identity").select("identity", F.col("identity").alias("cluster"))
    merged = staged(merged)
    joined = followers.join(
        merged.select(F.col("identity").alias("leader"), "cluster"), "leader"
    ).select("identity", "cluster")
    return reduce(DataFrame.unionByName, [calm, alone, merged, joined])


def _refusing(labels: DataFrame, phones: DataFrame, rejects: DataFrame) -> DataFrame:
    """(component, has_rejects) of the parts in which some merge is refused."""
    clash = (
        phones.filter("phone IS NOT NULL")
        .join(labels, "identity")
        .groupBy("component", "source")
        .agg((F.min("phone") != F.max("phone")).alias("clash"))
        .filter("clash")
        .select("component", F.lit(False).alias("has_rejects"))
    )
    inside = rejects.join(labels, "identity").groupBy("component", "ruling").agg((F.min("side") != F.max("side")).alias("both"))
    inside = inside.filter("both").select("component", F.lit(True).alias("has_rejects"))
    return clash.unionByName(inside).groupBy("component").agg(F.max("has_rejects").alias("has_rejects"))


def _settled(
    troubled: DataFrame, groups: DataFrame, phones: DataFrame, merges: DataFrame
) -> DataFrame:
    """(identity, leader): identities with one name whose place is known without any ordering.

    Only identities with one spelling, one source and no decision count here. Their pairs all come
    from one group, and identities of the same spelling have the same score with everybody.

    - Without a phone: the pair of the smallest such identity with anybody comes before the pair
      of the others, and they hold nothing that could refuse. They follow the smallest.
    - With a phone nobody else has, where all phones of the part are of one source: whoever meets
      it met the smallest phone of that spelling before, and so holds a phone by then. It stays
      alone.

    Everything is found by grouping, so one name on a third of all identities is no burden.
    """
    decided = merges.select("a").unionByName(merges.select(F.col("b").alias("a"))).distinct()
    shapes = groups.filter("grp NOT LIKE 'phone:%'").groupBy("identity").agg(
        F.count("*").alias("names"), F.min("grp").alias("grp"), F.min("exact").alias("exact")
    )
    sources = phones.groupBy("identity").agg(
        F.count("*").alias("sources"), F.min("source").alias("source"), F.min("phone").alias("phone")
    )
    owners = phones.filter("phone IS NOT NULL").groupBy("phone").agg(
        F.count_distinct("identity").alias("owners")
    )
    simple = (
        troubled.select("identity", "component")
        .join(shapes.filter("names = 1"), "identity")
        .join(sources.filter("sources = 1"), "identity")
        .join(decided.withColumnRenamed("a", "identity"), "identity", "left_anti")
        .join(owners, "phone", "left")
        .filter("phone IS NULL OR owners = 1")
    )
    simple = staged(simple)
    firsts = (
        simple.filter("phone IS NULL").groupBy("grp", "exact").agg(F.min("identity").alias("leader"))
    )
    follow = (
        simple.filter("phone IS NULL")
        .join(firsts, ["grp", "exact"])
        .filter("identity <> leader")
        .select("identity", "leader")
    )
    holders = (
        groups.filter("grp NOT LIKE 'phone:%'")
        .join(phones.filter("phone IS NOT NULL"), "identity")
        .groupBy("grp", "exact", "source")
        .agg(F.min("identity").alias("first"))
    )
    single = (
        phones.filter("phone IS NOT NULL")
        .join(troubled, "identity")
        .groupBy("component")
        .agg((F.min("source") == F.max("source")).alias("one"))
        .filter("one")
    )
    alone = (
        simple.filter("phone IS NOT NULL")
        .join(single, "component", "left_semi")
        .join(holders, ["grp", "exact", "source"])
        .filter("first < identity")
        .select("identity", F.col("identity").alias("leader"))
    )
    return follow.unionByName(alone)


_CLUSTER = "identity string, cluster string"


def _merge_in_order(
    rest: DataFrame, groups: DataFrame, phones: DataFrame, merges: DataFrame, rejects: DataFrame, part_facts: int
) -> DataFrame:
    """The ordered pass over what is left of the parts with refusals: small parts by task, large ones in rounds."""
    part = staged(rest.select("identity", "component"))
    facts = (
        part.join(groups, "identity").select("component", F.lit("group").alias("what"), F.col("identity").alias("a"), F.col("grp").alias("b"), F.col("exact").alias("c"))
    ).unionByName(
        part.join(phones, "identity").select("component", F.lit("source").alias("what"), F.col("identity").alias("a"), F.col("source").alias("b"), F.col("phone").alias("c"))
    )
    confirmed = merges.join(part.withColumnRenamed("identity", "a"), "a")
    facts = facts.unionByName(
        confirmed.select("component", F.lit("merge").alias("what"), "a", "b", F.lit(None).cast("string").alias("c"))
    ).unionByName(
        rejects.join(part, "identity").select("component", F.lit("reject").alias("what"), F.col("identity").alias("a"), F.col("ruling").alias("b"), F.col("side").alias("c"))
    )
    facts = staged(facts)
    large = facts.groupBy("component").count().filter(F.col("count") > part_facts).select("component")
    if large.isEmpty():
        return facts.groupBy("component").applyInPandas(_merge_part, _CLUSTER)
    small = facts.join(large, "component", "left_anti").groupBy("component").applyInPandas(_merge_part, _CLUSTER)
    return small.unionByName(_merge_large(part.join(large, "component", "left_semi"), groups, phones, confirmed, rejects))


def _merge_large(part: DataFrame, groups: DataFrame, phones: DataFrame, confirmed: DataFrame, rejects: DataFrame) -> DataFrame:
    nodes = staged(part.select(F.col("identity").alias("node")))
    links = confirmed.join(nodes.select(F.col("node").alias("a")), "a", "left_semi")
    links = links.join(nodes.select(F.col("node").alias("b")), "b", "left_semi")
    start = components(nodes, links).select(F.col("node").alias("identity"), F.col("component").alias("cluster"))
    numbers = phones.filter("phone IS NOT NULL").select("identity", F.concat(F.lit("source:"), "source").alias("key"), F.col("phone").alias("value"))
    sides = rejects.select("identity", F.concat(F.lit("ruling:"), "ruling").alias("key"), F.col("side").alias("value"))
    return merge_in_rounds(start, groups, numbers.unionByName(sides))


def _merge_part(facts: pd.DataFrame) -> pd.DataFrame:
    merged = merge_component(list(facts[["what", "a", "b", "c"]].itertuples(index=False, name=None)))
    return pd.DataFrame({"identity": list(merged), "cluster": list(merged.values())})


def proposals(identities: DataFrame, clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """(name_a, name_b, score, score_ab, score_ba, pairs, clusters_a, clusters_b): similar names held by different clusters.

    One row stands for the `pairs` of identities under the two names that are in different clusters and
    not rejected; equal names in different clusters (score 1 or .95) are rows too. Where the order of the
    names matters, the score is the best of the orders in which identities hold them. `proposals_for`
    lists the pairs of one identity.
    """
    forms = staged(identity_forms(identities))
    named = staged(forms.select("identity", "normal").distinct().join(clusters, "identity"))
    held = named.groupBy("normal").agg(
        F.count_distinct("cluster").alias("clusters"), F.count("*").alias("n"),
        F.min("identity").alias("first"), F.max("identity").alias("last"),
    )
    by_cluster = named.groupBy("normal", "cluster").agg(F.count("*").alias("n"))
    similar = name_pairs(forms, rare_tokens(forms, identity_total(identities)))
    turned = (
        forms.select("normal", F.array_join("tokens", " ").alias("text"), "name_phone").distinct()
    )
    same = turned.alias("x").join(turned.alias("y"), ["text"]).filter(
        (F.col("x.normal") < F.col("y.normal")) & F.col("x.name_phone").eqNullSafe(F.col("y.name_phone"))
    )
    same = same.select(
        F.col("x.normal").alias("name_a"), F.col("y.normal").alias("name_b"),
        F.lit(AUTO).alias("score"), F.lit(AUTO).alias("score_ba"),
    )
    own = held.filter("clusters > 1").select(
        F.col("normal").alias("name_a"), F.col("normal").alias("name_b"),
        F.lit(1.0).alias("score"), F.lit(1.0).alias("score_ba"),
    )
    pairs = reduce(DataFrame.unionByName, [similar, same, own])
    names = ["name_a", "name_b"]
    pairs = staged(pairs.groupBy(*names).agg(F.max("score").alias("score_ab"), F.max("score_ba").alias("score_ba")))
    sides = [
        held.select(*(F.col(c).alias(c + suffix) for c in held.columns)).withColumnRenamed("normal" + suffix, "name" + suffix)
        for suffix in ("_a", "_b")
    ]
    counts = [
        by_cluster.select(F.col("normal").alias("name" + suffix), "cluster", F.col("n").alias("n" + suffix))
        for suffix in ("_a", "_b")
    ]
    # Pairs inside a cluster are settled; for one name each pair is met from both sides, and each member with itself.
    inside = (
        pairs.select(*names).join(counts[0], "name_a").join(counts[1], ["name_b", "cluster"])
        .groupBy(*names).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("inside"))
    )
    # A rejection's sides are counted by name, and only for the names of a pair.
    refused = R.rejects(R.effective(R.as_rulings(decisions))).join(named, "identity")
    refused = staged(refused.groupBy("ruling", "side", "normal", "cluster").agg(F.count("*").alias("n")))
    ends = [
        refused.select("ruling", *(F.col(c).alias(f"{c}_{end}") for c in ("side", "cluster", "n")), F.col("normal").alias(f"name_{end}"))
        for end in ("a", "b")
    ]
    rejected = (
        pairs.select(*names).join(ends[0], "name_a").join(ends[1], ["name_b", "ruling"])
        .filter("side_a <> side_b AND cluster_a <> cluster_b")
        .groupBy(*names).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("rejected"))
    )
    met = F.col("n_a") * F.col("n_b") - F.coalesce("inside", F.lit(0)) - F.coalesce("rejected", F.lit(0))
    forward = F.when(F.col("first_a") <= F.col("last_b"), F.col("score_ab"))
    backward = F.when(F.col("first_b") <= F.col("last_a"), F.col("score_ba"))
    return (
        pairs.join(sides[0], "name_a").join(sides[1], "name_b")
        .join(inside, names, "left").join(rejected, names, "left")
        .withColumn("pairs", F.when(F.col("name_a") == F.col("name_b"), met / 2).otherwise(met).cast("long"))
        .withColumn("score", F.greatest(forward, backward))
        .filter("pairs > 0 AND score IS NOT NULL")
        .select(*names, "score", "score_ab", "score_ba", "pairs", "clusters_a", "clusters_b")
    )


def proposals_for(
    identity: str, named: DataFrame, identities: DataFrame, clusters: DataFrame, decisions: DataFrame
) -> DataFrame:
    """(a, b, score): the proposals of one identity, from the rows of `proposals`."""
    forms = identity_forms(identities)
    mine = forms.filter(F.col("identity") == identity).select(F.col("normal").alias("mine"))
    both = named.select(
        F.col("name_a").alias("mine"), F.col("name_b").alias("normal"), F.col("score_ab").alias("_first"), F.col("score_ba").alias("_second")
    ).unionByName(
        named.filter("name_a <> name_b").select(
            F.col("name_b").alias("mine"), F.col("name_a").alias("normal"), F.col("score_ba").alias("_first"), F.col("score_ab").alias("_second")
        )
    )
    # The smaller identity's name comes first.
    score = F.when(F.col("identity") > identity, F.col("_first")).otherwise(F.col("_second"))
    others = (
        both.join(mine, "mine").join(forms, "normal").withColumn("score", score).filter("score IS NOT NULL")
        .groupBy("identity").agg(F.max("score").alias("score"))
    )
    own = clusters.filter(F.col("identity") == identity).select(F.col("cluster").alias("own"))
    found = (
        others.filter(F.col("identity") != identity)
        .join(clusters, "identity")
        .crossJoin(F.broadcast(own))
        .filter("cluster <> own")
        .select(
            F.least(F.lit(identity), "identity").alias("a"),
            F.greatest(F.lit(identity), "identity").alias("b"),
            "score",
        )
    )
    found = staged(found)
    return found.join(R.rejected(found, R.rejects(R.effective(R.as_rulings(decisions)))), ["a", "b"], "left_anti")


# ---- contacts ---------------------------------------------------------------------------------


def build_contacts(
    identities: DataFrame, clusters: DataFrame, previous: DataFrame | None, now: Column
) -> DataFrame:
    """One contact per cluster, keeping ids of the previous snapshot, and tombstones."""
    rows = identities.join(clusters, "identity")
    names = rows.filter("name IS NOT NULL").groupBy("cluster", "name").agg(
        F.sum("n").alias("n"), F.sum("preferred_n").alias("preferred_n")
    )
    best = names.groupBy("cluster").agg(
        F.max(F.struct((F.col("preferred_n") > 0).alias("p"), F.when(F.col("preferred_n") > 0, F.col("preferred_n")).otherwise(F.col("n")).alias("n"))).alias("top"),
        F.array_sort(F.collect_set("name")).alias("aliases"),
    )
    display = (
        names.join(best.select("cluster", "top"), "cluster")
        .filter(
            ((F.col("preferred_n") > 0) == F.col("top.p"))
            & (F.when(F.col("top.p"), F.col("preferred_n")).otherwise(F.col("n")) == F.col("top.n"))
        )
        .groupBy("cluster")
        .agg(F.min("name").alias("display_name"))
    )
    members = rows.groupBy("cluster").agg(
        F.array_sort(F.collect_set("identity")).alias("identities"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    built = members.join(best.select("cluster", "aliases"), "cluster", "left").join(display, "cluster", "left")
    built = built.withColumns(
        {
            "first": F.element_at("identities", 1),
            "display_name": F.coalesce("display_name", F.element_at("identities", 1)),
            "aliases": F.coalesce("aliases", F.expr("cast(array() as array<string>)")),
        }
    )
    if previous is None:
        return built.select(
            content_hash(F.lit("contact"), F.col("first")).alias("id"),
            "display_name", "aliases", "identities", "sources",
            F.lit(None).cast("string").alias("merged_into"),
            now.alias("created_at"), now.alias("updated_at"),
        )
    return _carry_over(staged(built), previous, now)


def _claims(built: DataFrame, owners: DataFrame) -> DataFrame:
    """(cluster, id): clusters in the order of their smallest identity take their oldest free id.

    Clusters propose; an id keeps the first cluster that wants it; the others try their next id.
    """
    wishes = staged(
        built.select("cluster", "first", F.explode("identities").alias("identity"))
        .join(owners.select("identity", "id", "created_at"), "identity")
        .select("cluster", "first", "id", "created_at")
        .distinct()
    )
    while True:
        proposed = wishes.groupBy("cluster", "first").agg(
            F.min(F.struct("created_at", "id")).alias("wish")
        )
        kept = staged(
            proposed.groupBy(F.col("wish.id").alias("id")).agg(F.min_by("cluster", "first").alias("cluster"))
        )
        lost = proposed.select("cluster", F.col("wish.id").alias("id")).join(kept, ["cluster", "id"], "left_anti")
        lost = staged(lost)
        if lost.isEmpty():
            return kept.select("cluster", "id")
        wishes = staged(wishes.join(lost, ["cluster", "id"], "left_anti"))


def _carry_over(built: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    living = previous.filter("merged_into IS NULL")
    owners = living.select(F.explode("identities").alias("identity"), "id", "created_at")
    claimed = staged(_claims(built, owners))
    old = previous.select(
        "id", *(F.col(c).alias("_" + c) for c in ("display_name", "aliases", "identities", "sources", "merged_into", "created_at", "updated_at"))
    )
    current = built.join(claimed, "cluster", "left").withColumn(
        "id", F.coalesce("id", content_hash(F.lit("contact"), F.col("first")))
    )
    current = current.join(old, "id", "left")
    same = reduce(
        lambda a, b: a & b,
        (F.col(c).eqNullSafe(F.col("_" + c)) for c in ("display_name", "aliases", "identities", "sources")),
    ) & F.col("_merged_into").isNull() & F.col("_created_at").isNotNull()
    contacts = staged(
        current.select(
            "id", "display_name", "aliases", "identities", "sources",
            F.lit(None).cast("string").alias("merged_into"),
            F.coalesce("_created_at", now).alias("created_at"),
            F.when(same, F.col("_updated_at")).otherwise(now).alias("updated_at"),
        )
    )
    assigned = contacts.select(F.explode("identities").alias("identity"), F.col("id").alias("target"))
    held = previous.select("id", F.explode("identities").alias("identity"))
    spread = held.join(assigned, "identity").groupBy("id").agg(
        F.min("target").alias("target"), F.max("target").alias("other")
    )
    split = spread.filter("target <> other").join(living.select("id"), "id", "left_semi")
    torn = held.join(owners.select("identity", F.col("id").alias("owner")), "identity").join(
        split.select(F.col("id").alias("owner")), "owner", "left_semi"
    )
    gone = previous.join(contacts.select("id"), "id", "left_anti")
    tombs = (
        gone.join(spread, "id", "left")
        .filter("target IS NULL OR target = other")
        .join(torn.select("id").distinct(), "id", "left_anti")
    )
    moved = ~F.col("merged_into").eqNullSafe(F.col("target"))
    tombs = tombs.select(
        "id", "display_name", "aliases", "identities", "sources", F.col("target").alias("merged_into"),
        "created_at", F.when(moved, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return contacts.unionByName(tombs)


def newly_merged(clusters: DataFrame, previous: DataFrame | None, merges: DataFrame) -> DataFrame:
    """One row: how many automatic merges connected what the previous snapshot kept apart."""
    if previous is None:
        owner = clusters.select("identity", F.col("identity").alias("owner"))
    else:
        held = previous.filter("merged_into IS NULL").select(
            F.explode("identities").alias("identity"), F.col("id").alias("owner")
        )
        owner = clusters.join(held, "identity", "left").select(
            "identity", F.coalesce("owner", "identity").alias("owner")
        )
    owner = staged(owner)
    links = owner.filter("owner <> identity").select(F.col("identity").alias("a"), F.concat(F.lit("\x1f"), "owner").alias("b"))
    ends = merges.select("a", "b")
    nodes = clusters.select(F.col("identity").alias("node")).unionByName(links.select(F.col("b").alias("node")).distinct())
    known = clusters.select(F.col("identity"))
    ends = ends.join(known.withColumnRenamed("identity", "a"), "a", "left_semi").join(known.withColumnRenamed("identity", "b"), "b", "left_semi")
    before = components(nodes, links.unionByName(ends)).withColumnRenamed("node", "identity")
    return (
        clusters.join(before, "identity")
        .groupBy("cluster")
        .agg(F.count_distinct("component").alias("parts"))
        .agg(F.coalesce(F.sum(F.col("parts") - 1), F.lit(0)).alias("auto_merged"))
    )


# ---- assignment -------------------------------------------------------------------------------


def contact_map(contacts: DataFrame) -> DataFrame:
    """(identity, contact) of the living contacts."""
    return contacts.filter("merged_into IS NULL").select(
        F.explode("identities").alias("identity"), F.col("id").alias("contact")
    )


def assign_messages(messages: DataFrame, assigned: DataFrame) -> DataFrame:
    """`messages` with a new contact_id and a `changed` flag.

    A direct chat belongs to its only counterpart, for all of its rows; an ambiguous chat to
    nobody. In a group each row belongs to its sender, unless it is mine.
    """
    senders = (
        messages.filter(~F.col("is_from_me") & (F.col("chat_kind") == "direct"))
        .select("source", "chat_id", "sender_id")
        .distinct()
    )
    counterparts = (
        senders.join(assigned.withColumnRenamed("identity", "sender_id"), "sender_id")
        .groupBy("source", "chat_id")
        .agg(F.min("contact").alias("_only"), F.max("contact").alias("_last"))
        .filter("_only = _last")
        .drop("_last")
    )
    # Group rows without a sender, and all direct rows, need no sender lookup: spread their keys.
    spread = F.concat(F.lit("\x1f"), F.pmod(F.xxhash64("id"), F.lit(4096)).cast("string"))
    looked_up = (F.col("chat_kind") != "direct") & ~F.col("is_from_me")
    rows = messages.withColumn("_sender", F.when(looked_up, F.coalesce("sender_id", spread)).otherwise(spread))
    rows = rows.join(counterparts, ["source", "chat_id"], "left").join(
        assigned.select(F.col("identity").alias("_sender"), F.col("contact").alias("_own")), "_sender", "left"
    )
    target = F.when(F.col("chat_kind") == "direct", F.col("_only")).when(~F.col("is_from_me"), F.col("_own"))
    return _reassigned(rows, target, messages.columns)


def assign_transactions(transactions: DataFrame, assigned: DataFrame) -> DataFrame:
    """`transactions` with the contact of transfer counterparties and a `changed` flag."""
    parties = (
        transfer_parties(transactions)
        .select("name", "identity")
        .distinct()
        .join(assigned, "identity")
        .select(F.col("name").alias("_party"), F.col("contact").alias("_own"))
    )
    spread = F.concat(F.lit("\x1f"), F.pmod(F.xxhash64("id"), F.lit(4096)).cast("string"))
    key = F.when(F.col("kind") == "transfer", F.coalesce("counterparty", spread)).otherwise(spread)
    rows = transactions.withColumn("_party", key).join(parties, "_party", "left")
    return _reassigned(rows, F.col("_own"), transactions.columns)


def _reassigned(rows: DataFrame, target: Column, columns: list[str]) -> DataFrame:
    rows = rows.withColumn("_target", target)
    rows = rows.withColumn("changed", ~F.col("contact_id").eqNullSafe(F.col("_target")))
    return rows.withColumn("contact_id", F.col("_target")).select(*columns, "changed")


def decide(contacts: DataFrame, rulings: DataFrame, a: str, b: str, decision: str, at: Column) -> DataFrame:
    """`rulings` with one more, on two contacts or identities; it covers every pair across them."""
    if decision not in ("merge", "reject"):
        raise ValueError("decision must be merge or reject")
    living = contacts.filter("merged_into IS NULL")

    def keys(value: str) -> DataFrame:
        found = living.filter(F.col("id") == value).select(F.explode("identities").alias("key"))
        if not found.isEmpty():
            return found
        known = contacts.filter(F.array_contains("identities", value))
        if known.isEmpty():
            raise ValueError("unknown or superseded contact or identity")
        return known.limit(1).select(F.lit(value).alias("key"))

    left, right = keys(a), keys(b)
    if not left.join(right, "key", "left_semi").isEmpty():
        raise ValueError("choose two different contacts or identities")
    return staged(R.as_rulings(rulings).unionByName(R.rule(left, right, (a, b), decision, at)))


def decide_and_resolve(
    identities: DataFrame, contacts: DataFrame, rulings: DataFrame, a: str, b: str, decision: str, at: Column
) -> tuple[DataFrame, DataFrame]:
    """(rulings, contacts) after a decision: who is who is resolved again, and contacts keep their ids where they can."""
    rulings = decide(contacts, rulings, a, b, decision, at)
    clusters = staged(cluster_identities(identities, rulings))
    return rulings, staged(build_contacts(identities, clusters, contacts, at))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("decision", "decided_at"), "decided_at").alias("latest")
    return decisions.groupBy("a", "b").agg(latest).select("a", "b", "latest.decision", "latest.decided_at")


def contact_activity(contacts: DataFrame, messages: DataFrame, transactions: DataFrame) -> DataFrame:
    """Living contacts with how many messages and transfers they have."""
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.filter("contact_id IS NOT NULL").groupBy(F.col("contact_id").alias("id")).agg(F.count("*").alias(name))

    transfers = transactions
    return (
        contacts.filter("merged_into IS NULL")
        .select("id", "display_name")
        .join(counted(messages, "messages"), "id", "left")
        .join(counted(transfers, "transfers"), "id", "left")
        .fillna(0, ["messages", "transfers"])
        .orderBy("display_name", "id")
    )


def resolve(
    messages: DataFrame,
    transactions: DataFrame,
    decisions: DataFrame,
    previous: DataFrame | None = None,
    now: Column | None = None,
) -> dict[str, DataFrame]:
    """The whole job: clusters, contacts, proposals and both assignments."""
    now = F.current_timestamp() if now is None else now
    identities = staged(collect_identities(messages, transactions))
    clusters = staged(cluster_identities(identities, decisions))
    contacts = staged(build_contacts(identities, clusters, previous, now))
    assigned = contact_map(contacts)
    return {
        "identities": identities,
        "clusters": clusters,
        "contacts": contacts,
        "proposals": proposals(identities, clusters, decisions),
        "messages": assign_messages(messages, assigned),
        "transactions": assign_transactions(transactions, assigned),
    }
