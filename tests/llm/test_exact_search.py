import math
import random

import numpy as np
from pyspark.sql import functions as F

from chronicle.llm import exact_search

SCHEMA = "vec_id bigint, embedding array<double>, query_id int, _vector string"


def brute(rows, top, asked=lambda k: k % 100 == 0):
    good = []
    for key, vector in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            good.append((key, [math.floor(int(1024) * x) if abs(x) < 1e12 else x.as_integer_ratio()[0] * 1024 // x.as_integer_ratio()[1] for x in vector]))
    out = []
    for query, q in {(k, tuple(v)) for k, v in good if k is not None and asked(k)}:
        scored = [(-sum(a * b for a, b in zip(q, v)), k is None, k or 0, k) for k, v in good if k != query]
        for rank, (score, _, _, key) in enumerate(sorted(scored, key=lambda s: s[:3])[:top], 1):
            out.append((query, rank, key, max(-(1 << 63), min((1 << 63) - 1, -score))))
    return sorted(out, key=repr)


def found(spark, rows, top=10, **more):
    frame = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, exact_search.top_k(frame, F.col("_key") % 100 == 0, top, **more).collect()), key=repr)


def test_equals_brute_force_with_ties_and_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(40)]) for i in range(700)]
    rows += [(i, rows[i % 7][1]) for i in range(700, 1300)]  # copies: ties
    rows += [(2001, None), (2100, [1.0, None]), (2200, [float("nan")] * 40), (2300, [float("inf")]), (2400, []), (2500, [0.5] * 60), (None, rows[3][1])]
    rows += [(200, rows[200][1]), (300, [0.1] * 40)]  # a repeated row, a repeated key
    assert found(spark, rows) == brute(rows, 10)
    assert found(spark, rows, 3, group=2) == brute(rows, 3)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e20, 1.0]), (1, [1e15, -1e15]), (2, [-3e20, 2.0]), (3, [0.25, 0.25]), (100, [70000.0, 0.1]), (101, [1e300, 1e300]), (102, [-1e300, 5.0]), (103, [1e-300, 0.3])]
    assert found(spark, rows) == brute(rows, 10)


def test_few_candidates_and_empty_table(spark):
    assert found(spark, [(0, [1.0])]) == [] and found(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 1024 * 2048)]
    assert exact_search.top_k(spark.createDataFrame([], SCHEMA), F.col("_key") % 100 == 0).count() == 0


def test_bounds_prune_whole_blocks():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(exact_search.BLOCK * 4, 64))
    rows = np.floor(1024 * rows / np.linalg.norm(rows, axis=1)[:, None])
    near = np.floor(rows[:40] + rng.normal(size=(40, 64)))
    queries = exact_search.Queries([-1, -2], [near[0], near[1]])
    search = exact_search.Search(queries, 3)
    search.block(np.arange(40), np.zeros(40, bool), [near[0]] * 20 + [near[1]] * 20)
    before = search.compared
    for first in range(0, len(rows), exact_search.BLOCK):
        part = rows[first : first + exact_search.BLOCK]
        search.block(np.arange(first, first + len(part)) + 100, np.zeros(len(part), bool), list(part))
    assert search.compared - before < 0.8 * 2 * rows.size
