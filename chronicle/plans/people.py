"""Registered queries of identity resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronicle.operators import entities
from chronicle.plans import adapters as A
from chronicle.plans.ingestion import hashed
from chronicle.plans.query import register
from chronicle.session import staged

# Senders are parts under their two-word names; every third is a phone number. Counterparties are
# customers under the same words in reverse order.


def _messages(s, d):
    """One to three messages per part, from two sources."""
    key = F.col("p_partkey")
    sender = F.when(key % 3 == 0, F.concat(F.lit("whatsapp:+1555"), key.cast("string"))).otherwise(
        F.concat(F.lit("part:"), F.lpad(key.cast("string"), 9, "0"))
    )
    rows = A.table(s, d, "part").withColumn("copy", F.explode(F.sequence(F.lit(0), (key % 3).cast("int"))))
    return rows.select(
        F.concat(key.cast("string"), F.lit("-"), F.col("copy").cast("string")).alias("id"),
        F.when(key % 3 == 0, "whatsapp").otherwise("forum").alias("source"),
        F.concat(F.lit("chat-"), F.expr("p_partkey div 2").cast("string")).alias("chat_id"),
        F.when(key % 4 == 0, "group").otherwise("direct").alias("chat_kind"),
        sender.alias("sender_id"), F.col("p_name").alias("sender_name"), (F.col("copy") == 2).alias("is_from_me"),
        F.lit(None).cast("string").alias("contact_id"), F.lit("text").alias("kind"),
    )


def _transactions(s, d):
    """Customers as counterparties: two words in reverse order; a few known by a single word."""
    first = F.element_at(F.split("p_name", " "), 1)
    second = F.element_at(F.split("p_name", " "), 2)
    part = A.table(s, d, "part").select("p_partkey", F.concat(second, F.lit("  "), F.upper(first)).alias("party"), first.alias("one"))
    orders = A.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    party = F.when(F.col("o_custkey") % 7 == 0, F.col("one")).otherwise(F.col("party"))
    return orders.join(part, F.col("o_custkey") == F.col("p_partkey")).select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("bank").alias("source"),
        F.when(F.col("o_orderpriority").startswith("1"), "transfer").otherwise("card").alias("kind"),
        party.alias("counterparty"), F.lit(None).cast("string").alias("contact_id"),
    )


def _identities(s, d):
    return entities.collect_identities(_messages(s, d), _transactions(s, d))


def _nobody(s):
    return s.createDataFrame([], "a string, b string, decision string")


_BASE = """WITH messages AS (SELECT p_partkey || '-' || copy AS id,
        CASE WHEN p_partkey % 3 = 0 THEN 'whatsapp' ELSE 'forum' END AS source, 'chat-' || (p_partkey // 2) AS chat_id,
        CASE WHEN p_partkey % 4 = 0 THEN 'group' ELSE 'direct' END AS chat_kind,
        CASE WHEN p_partkey % 3 = 0 THEN 'whatsapp:+1555' || p_partkey
            ELSE 'part:' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS sender_id,
        p_name AS sender_name, copy = 2 AS is_from_me
        FROM (SELECT *, unnest(range(0, p_partkey % 3 + 1)) AS copy FROM part)),
    transfers AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'bank' AS source, CASE WHEN o_custkey % 7 = 0 THEN split_part(p_name, ' ', 1)
        ELSE split_part(p_name, ' ', 2) || '  ' || upper(split_part(p_name, ' ', 1)) END AS counterparty,
        o_orderpriority LIKE '1%' AS is_transfer FROM orders JOIN part ON o_custkey = p_partkey),
    parties AS (SELECT DISTINCT counterparty AS name, 'bank:name:' || CASE WHEN counterparty LIKE '% %'
        THEN least(lower(split_part(counterparty, '  ', 1)), lower(split_part(counterparty, '  ', 2))) || ' ' ||
        greatest(lower(split_part(counterparty, '  ', 1)), lower(split_part(counterparty, '  ', 2)))
        ELSE lower(counterparty) END AS identity FROM transfers WHERE is_transfer),
    identities AS (SELECT sender_id AS identity, sender_name AS name, source, count(*) AS n,
        CASE WHEN source = 'whatsapp' THEN count(*) ELSE 0 END AS preferred_n
        FROM messages WHERE NOT is_from_me GROUP BY sender_id, sender_name, source
        UNION ALL SELECT identity, name, 'bank', 1, 0 FROM parties),
    words AS (SELECT *, list_sort(list_filter(string_split(lower(name), ' '), lambda w: w <> '')) AS tokens FROM identities),
    phones AS (SELECT identity, tokens, CASE WHEN identity LIKE 'whatsapp:+%' THEN identity END AS phone FROM words),
    firsts AS (SELECT tokens, min(phone) AS first_phone, min(CASE WHEN phone IS NULL THEN identity END) AS head FROM phones GROUP BY tokens),
    clusters AS (SELECT DISTINCT identity, CASE WHEN phone IS NULL OR phone = first_phone THEN coalesce(head, first_phone)
        ELSE identity END AS cluster FROM phones JOIN firsts USING (tokens))"""
register(
    "collect_identities",
    lambda s, d: _identities(s, d),
    _BASE + " SELECT * FROM identities",
)
def _customer_forms(s, d):
    """Names with rare words: a customer's number, segment and nation."""
    key = F.expr("c_custkey div 2").cast("string")
    name = F.concat(F.lit("n"), key, F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), "c_mktsegment")))
    rows = A.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("identity"), name.alias("name"))
    return entities.identity_forms(rows), entities.identity_total(rows)


def _name_pairs(s, d):
    forms, total = _customer_forms(s, d)
    return entities.name_pairs(forms, entities.rare_tokens(forms, total))


def _rare(s, d):
    forms, total = _customer_forms(s, d)
    return entities.rare_tokens(forms, total)


register(
    "rare_tokens",
    _rare,
    """SELECT 'n' || (c_custkey // 2) AS token, count(*) AS identities FROM customer GROUP BY 1
    HAVING count(*) <= 0.05 * (SELECT count(*) FROM customer)""",
)
register(
    "name_pairs",
    lambda s, d: _name_pairs(s, d).drop("score_ba"),
    """SELECT lower(a.n) AS name_a, lower(b.n || ' ' || b.c_mktsegment) AS name_b, 0.7::DOUBLE AS score
    FROM (SELECT *, 'n' || (c_custkey // 2) AS n FROM customer WHERE c_custkey % 2 = 0) a
    JOIN (SELECT *, 'n' || (c_custkey // 2) AS n FROM customer WHERE c_custkey % 2 = 1) b ON a.n = b.n""",
)
def _ruled_customers(s, d):
    """Customers as identities of their own; every third pair of alike names has been rejected."""
    key = F.col("c_custkey")
    name = F.concat(
        F.lit("n"), F.expr("c_custkey div 2").cast("string"),
        F.when(key % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), "c_mktsegment")),
    )
    rows = A.table(s, d, "customer").select(
        F.lpad(key.cast("string"), 9, "0").alias("identity"), name.alias("name"), F.lit("crm").alias("source"),
        F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("preferred_n"), key.alias("key"),
    )
    refused = rows.filter("key % 6 = 0").select(
        F.col("identity").alias("a"), F.lpad((F.col("key") + 1).cast("string"), 9, "0").alias("b"), F.lit("reject").alias("decision")
    )
    return rows.drop("key"), refused


def _proposals(s, d):
    identities, refused = _ruled_customers(s, d)
    clusters = identities.select("identity", F.col("identity").alias("cluster"))
    return entities.proposals(identities, clusters, refused).select("name_a", "name_b", "score", "pairs")


_PROPOSED = """SELECT lower(a.n) AS name_a, lower(b.n || ' ' || b.c_mktsegment) AS name_b, 0.7::DOUBLE AS score, 1 AS pairs
    FROM (SELECT *, 'n' || (c_custkey // 2) AS n FROM customer WHERE c_custkey % 2 = 0) a
    JOIN (SELECT *, 'n' || (c_custkey // 2) AS n FROM customer WHERE c_custkey % 2 = 1) b ON a.n = b.n
    WHERE a.c_custkey % 6 <> 0"""
register("proposals", _proposals, _PROPOSED)


def _clustered_by_rulings(s, d):
    """Customers share one name by tens; rulings reject some pairs and merge some of different names."""
    key = F.col("c_custkey")
    rows = A.table(s, d, "customer").select(
        F.lpad(key.cast("string"), 9, "0").alias("identity"), F.concat(F.lit("person t"), F.expr("c_custkey div 10").cast("string")).alias("name"),
        F.lit("crm").alias("source"), F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("preferred_n"), key.alias("key"),
    )
    this, after = F.col("identity"), F.lpad((F.col("key") + 1).cast("string"), 9, "0")
    rejects = rows.filter("key % 40 = 0").select(this.alias("a"), after.alias("b"), F.lit("reject").alias("decision"))
    # The last of a group of ten is merged with the first of the next.
    last = rows.filter(f"key % 40 = 19").join(rows.select(F.col("identity").alias("b")), F.col("b") == after)
    merges = last.select(this.alias("a"), "b", F.lit("merge").alias("decision"))
    return _smallest(entities.cluster_identities(rows.drop("key"), rejects.unionByName(merges)))


register(
    "cluster_identities_ruled",
    _clustered_by_rulings,
    # A refused pair splits its group: the second of the two is left alone, unless it is the only other member.
    """WITH c AS (SELECT c_custkey AS k, c_custkey // 10 AS grp FROM customer),
    split AS (SELECT k, CASE WHEN k % 40 = 1 AND (k - 1) IN (SELECT k FROM c) THEN -k ELSE
        CASE WHEN grp % 4 = 2 AND (grp * 10 - 1) IN (SELECT k FROM c) AND (grp * 10) IN (SELECT k FROM c) THEN grp - 1 ELSE grp END END AS grp FROM c)
    SELECT lpad(k::VARCHAR, 9, '0') AS identity, lpad(min(k) OVER (PARTITION BY grp)::VARCHAR, 9, '0') AS cluster FROM split""",
)
register(
    "cluster_identities",
    lambda s, d: _smallest(entities.cluster_identities(_identities(s, d), _nobody(s))),
    _BASE + """, named AS (SELECT identity, min(identity) OVER (PARTITION BY cluster) AS cluster FROM clusters)
    SELECT * FROM named""",
)


def _smallest(clusters):
    """Clusters named by their smallest identity."""
    names = clusters.groupBy("cluster").agg(F.min("identity").alias("name"))
    return clusters.join(names, "cluster").select("identity", F.col("name").alias("cluster"))


def _resolved(s, d):
    identities = staged(_identities(s, d))
    clusters = entities.cluster_identities(identities, _nobody(s))
    return entities.build_contacts(identities, clusters, None, F.lit("2024-01-01 00:00:00").cast("timestamp"))


_CONTACTS = _BASE + f""", members AS (SELECT c.identity, min(c.identity) OVER (PARTITION BY c.cluster) AS head FROM clusters c),
    ids AS (SELECT identity, {hashed("'contact'", "head")} AS id FROM members),
    counted AS (SELECT id, name, sum(n) AS n, sum(preferred_n) AS p, array_agg(DISTINCT source) AS sources
        FROM identities JOIN ids USING (identity) GROUP BY id, name),
    contacts AS (SELECT id, arg_min(name, (-(p > 0)::INT, -CASE WHEN p > 0 THEN p ELSE n END, name)) AS display_name,
        count(*) AS names FROM counted GROUP BY id)"""
register(
    "build_contacts",
    lambda s, d: _resolved(s, d).select(
        "id", "display_name", *(F.array_join(c, "|").alias(c) for c in ("aliases", "identities", "sources"))
    ),
    _CONTACTS + """ SELECT id, display_name, aliases, identities, sources FROM contacts
    JOIN (SELECT id, string_agg(identity, '|' ORDER BY identity) AS identities FROM ids GROUP BY id) USING (id)
    JOIN (SELECT id, string_agg(name, '|' ORDER BY name) AS aliases FROM (SELECT DISTINCT id, name FROM counted) GROUP BY id) USING (id)
    JOIN (SELECT id, string_agg(source, '|' ORDER BY source) AS sources FROM (SELECT DISTINCT id, source FROM identities JOIN ids USING (identity)) GROUP BY id) USING (id)""",
)


def _assigned(s, d):
    return entities.contact_map(staged(_resolved(s, d)))


register(
    "assign_messages",
    lambda s, d: entities.assign_messages(_messages(s, d), _assigned(s, d)).select("id", "contact_id", "changed"),
    _CONTACTS + """, counterparts AS (SELECT source, chat_id, min(i.id) AS id FROM messages m JOIN ids i ON m.sender_id = i.identity
        WHERE NOT is_from_me AND chat_kind = 'direct' GROUP BY source, chat_id HAVING count(DISTINCT i.id) = 1),
    desired AS (SELECT m.id, CASE WHEN chat_kind = 'direct' THEN c.id WHEN NOT is_from_me THEN i.id END AS contact_id
        FROM messages m LEFT JOIN counterparts c USING (source, chat_id) LEFT JOIN ids i ON m.sender_id = i.identity)
    SELECT id, contact_id, contact_id IS NOT NULL AS changed FROM desired""",
)
register(
    "assign_transactions",
    lambda s, d: entities.assign_transactions(_transactions(s, d), _assigned(s, d)).select("id", "contact_id", "changed"),
    _CONTACTS + """ SELECT t.id, i.id AS contact_id, i.id IS NOT NULL AS changed FROM transfers t
    LEFT JOIN parties p ON t.is_transfer AND t.counterparty = p.name LEFT JOIN ids i USING (identity)""",
)


def _activity(s, d):
    contacts = staged(_resolved(s, d))
    found = entities.contact_map(contacts)
    return entities.contact_activity(
        contacts, entities.assign_messages(_messages(s, d), found), entities.assign_transactions(_transactions(s, d), found)
    )


register(
    "contact_activity",
    _activity,
    _CONTACTS + """, counterparts AS (SELECT source, chat_id, min(i.id) AS id FROM messages m JOIN ids i ON m.sender_id = i.identity
        WHERE NOT is_from_me AND chat_kind = 'direct' GROUP BY source, chat_id HAVING count(DISTINCT i.id) = 1),
    sent AS (SELECT CASE WHEN chat_kind = 'direct' THEN c.id WHEN NOT is_from_me THEN i.id END AS id, count(*) AS messages
        FROM messages m LEFT JOIN counterparts c USING (source, chat_id) LEFT JOIN ids i ON m.sender_id = i.identity GROUP BY 1),
    paid AS (SELECT i.id, count(*) AS transfers FROM transfers t JOIN parties p ON t.is_transfer AND t.counterparty = p.name
        JOIN ids i USING (identity) GROUP BY i.id)
    SELECT id, display_name, coalesce(messages, 0) AS messages, coalesce(transfers, 0) AS transfers
    FROM contacts LEFT JOIN sent USING (id) LEFT JOIN paid USING (id)""",
)


def _decisions(s, d):
    """A ruling per order on a pair of customers; later rulings replace earlier ones."""
    a, b = F.col("o_custkey").cast("string"), (F.col("o_custkey") % 13).cast("string")
    return A.table(s, d, "orders").filter("o_custkey <> o_custkey % 13").select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b"),
        F.when(F.col("o_orderkey") % 2 == 0, "merge").otherwise("reject").alias("decision"),
        F.timestamp_add("SECOND", F.col("o_orderkey").cast("int"), F.col("o_orderdate")).cast("timestamp").alias("decided_at"),
    )


register(
    "latest_decisions",
    lambda s, d: entities.latest_decisions(_decisions(s, d)).select("a", "b", "decision", F.unix_micros("decided_at").alias("decided_at")),
    """SELECT least(CAST(o_custkey AS VARCHAR), CAST(o_custkey % 13 AS VARCHAR)) AS a,
        greatest(CAST(o_custkey AS VARCHAR), CAST(o_custkey % 13 AS VARCHAR)) AS b,
        CASE WHEN arg_max(o_orderkey, o_orderdate + to_seconds(o_orderkey)) % 2 = 0 THEN 'merge' ELSE 'reject' END AS decision,
        epoch_us(max(o_orderdate + to_seconds(o_orderkey))) AS decided_at
    FROM orders WHERE o_custkey <> o_custkey % 13 GROUP BY 1, 2""",
)


def _decided(s, d):
    """Customers named after their nation; two contacts are merged, then two identities of a third are told apart."""
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    identities = A.table(s, d, "customer").select(
        key.alias("identity"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("name"), F.lit("crm").alias("source"),
        F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("preferred_n"), F.col("c_nationkey").alias("nation"),
    )
    rank = F.row_number().over(Window.partitionBy("nation").orderBy("identity"))
    of: dict[int, list[str]] = {}
    for row in identities.filter("nation < 3").withColumn("rank", rank).filter("rank <= 2").orderBy("nation", "rank").collect():
        of.setdefault(row["nation"], []).append(row["identity"])
    identities = staged(identities.drop("nation"))
    now = [F.lit(f"2024-01-0{i} 00:00:00").cast("timestamp") for i in (1, 2, 3)]
    heads = identities.groupBy("name").agg(F.min("identity").alias("cluster"))
    clusters = identities.join(heads, "name").select("identity", "cluster")
    contacts = staged(entities.build_contacts(identities, clusters, None, now[0]))
    contact = [contacts.filter(F.array_contains("identities", of[n][0])).first()["id"] for n in (0, 1)]
    rulings = entities.decide(contacts, _nobody(s), *contact, "merge", now[1])
    _, contacts = entities.decide_and_resolve(identities, contacts, rulings, *of[2], "reject", now[2])
    return contacts.filter("merged_into IS NULL").select(
        F.element_at("identities", 1).alias("first"), F.size("identities").cast("bigint").alias("identities"),
        (F.col("created_at") == now[0]).alias("kept"),
    )


register(
    "decide",
    _decided,
    """SELECT min(k) AS first, count(*) AS identities, part <> 'apart' AS kept FROM (
        SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS k,
            CASE WHEN c_nationkey = 1 THEN '0'
                 WHEN c_nationkey = 2 AND row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 2 THEN 'apart'
                 ELSE CAST(c_nationkey AS VARCHAR) END AS part
        FROM customer) GROUP BY part""",
)


def _links(s, d):
    """Chains: every order is linked to the one whose key is half of its own, within a customer group."""
    orders = A.table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    node = F.lpad(F.col("k").cast("string"), 12, "0")
    half = F.lpad(F.expr("k div 2").cast("string"), 12, "0")
    nodes = orders.select(node.alias("node"))
    return nodes, orders.filter("k % 5 <> 0").select(half.alias("a"), node.alias("b"))


register(
    "components",
    lambda s, d: entities.components(*_links(s, d)).groupBy("component").agg(F.count("*").alias("nodes")),
    """WITH RECURSIVE up AS (SELECT o_orderkey AS k, o_orderkey AS root FROM orders WHERE o_orderkey % 5 = 0
        UNION ALL SELECT o.o_orderkey, up.root FROM orders o JOIN up ON o.o_orderkey // 2 = up.k WHERE o.o_orderkey % 5 <> 0)
    SELECT lpad(CAST(root AS VARCHAR), 12, '0') AS component, count(*) AS nodes FROM up GROUP BY root""",
)
