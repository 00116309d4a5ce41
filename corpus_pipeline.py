"""The corpus pipeline: documents in, packed sequences out. Each stage works on all that the stage before it kept.

| Stage | Operator | What it does to the documents |
| --- | --- | --- |
| language_id | 1 | drops those in which no language is found (null text, no letter) |
| line_dedup | 9 | deletes later repeated runs of lines; drops documents of which nothing is left |
| near_dedup | 3 | keeps the document with the smallest doc_id of each group of similar texts: op3's links (four of 64 bits) and, as those reach a similarity of some 0.95 only, sets of five words with a Jaccard similarity of 0.8 or more (MinHash buckets and an exact check) |
| decontamination | 4 | drops documents with a passage of a benchmark item |
| packing | 8 | tokenises the rest and packs the pieces into sequences (its rows are pieces) |

Stages take (spark, docs, sf_dir). All but the last return the columns of documents. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronicle.llm import decontaminate, language, near_copies, packing, repeated_lines
from chronicle.llm.frames import kept, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.with_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

# Suffix automata, MinHash and tokenisation have no SQL form; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
