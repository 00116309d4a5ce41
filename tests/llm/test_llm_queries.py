import re

import pytest

import corpus_pipeline
from chronicle.llm import decontaminate, packing, repeated_lines
from chronicle.llm.frames import table
from chronicle.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    from check import compare, connect

    for sf_dir in (SMALL, "/root/testdata/sf0.01"):
        assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


def test_all_queries_are_registered():
    import __spark_entry__

    numbers = [int(m[1]) for n in __spark_entry__.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def one_of_each_group(texts):
    """The smallest key of each group that five-word shingle sets with a Jaccard similarity of 0.8 or more connect."""
    sets = []
    for _, text in texts:
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if label[a] != label[b] and (both * 5 >= len(sets[a] | sets[b]) * 4 or sets[a] == sets[b]):
                old, new = sorted((label[a], label[b]))[::-1]
                label = [new if x == old else x for x in label]
    return {texts[i][0] for i in set(label)}


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(9001, None), (9002, "12 ??"), (9003, docs.first()["text"])]
    extra = spark.createDataFrame([(k, t, None, None, 1) for k, t in rows], docs.schema)
    docs = docs.unionByName(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    before, after = seen["language_id"]
    spoken = {r["doc_id"] for r in before.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert {r["doc_id"] for r in after.collect()} == spoken and 9003 in spoken
    before, after = seen["line_dedup"]
    left = {r["doc_id"]: r["text"] for r in repeated_lines.deduplicated(before).collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {k: t for k, t in left.items() if t.strip()}
    before, after = seen["near_dedup"]
    texts = sorted((r["doc_id"], r["text"]) for r in before.collect())
    left = one_of_each_group(texts)
    assert {r["doc_id"] for r in after.collect()} == left and len(texts) > len(left)
    before, after = seen["decontamination"]
    hit = {r["doc_id"] for r in decontaminate.digest(before, table(spark, SMALL, "benchmark")).collect() if r["contaminated"]}
    assert hit and {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - hit
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
    assert packing.pack(before).count() == after.count()


def test_pipeline_runs_whole_and_on_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    for name in ("documents", "benchmark"):
        table(spark, SMALL, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
