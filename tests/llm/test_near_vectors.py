import numpy as np
import pytest

from chronicle.llm.near_vectors import Cells, grouped, spanning, unit


def brute(rows, cosine=0.95):
    good = {
        i: np.array(v, float)
        for i, (_, v) in enumerate(rows)
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    width = max((len(v) for v in good.values()), default=0)
    unit = {i: np.pad(v, (0, width - len(v))) / np.sqrt((v * v).sum()) for i, v in good.items()}
    near = {i: [j for j in unit if j != i and unit[i] @ unit[j] >= cosine] for i in unit}
    label = list(range(len(rows)))
    for _ in rows:
        for i, others in near.items():
            label[i] = min([label[i], *(label[j] for j in others)])
    out = []
    for i, (key, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None), default=None)
        own = key if i not in unit else least
        out.append((key, len(near.get(i, [])), own, own is None or key is None or key == own))
    return sorted(out, key=repr)


def test_table_matches_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], list(r[1])) for r in df.collect()]
    assert sorted(map(tuple, grouped(df).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("cell, chunk", [(4096, 4096), (20, 4096), (20, 5)])
def test_odd_vectors_and_small_cells(spark, cell, chunk):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.12).tolist()) for i in range(150)]
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None]), (204, [float("nan")] * 6), (205, [float("inf")] * 6)]
    rows += [(206, rows[3][1]), (206, rows[3][1]), (None, rows[4][1]), (207, [1e300, 1e300]), (208, [1.0, 1.0, 0.0]), (209, [-0.0, 1e-300])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n_links int, class string")
    got = sorted(map(tuple, grouped(df, cell=cell, chunk=chunk).collect()), key=repr)
    big = [(k, [x / 1e300 for x in v] if k == 207 else [0.0, 1.0] if k == 209 else v) for k, v in rows]  # squares overflow
    want = brute(big)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert grouped(df.limit(0)).count() == 0


def test_spanning():
    pairs = np.array([[4, 5], [3, 4], [0, 1], [5, 6]])
    assert spanning(pairs, 8).tolist() == [0, 0, 2, 3, 3, 3, 3, 7]


def scaled_copies(rng, copies, others, width=64):
    """Multiples of one direction in single precision, and vectors at cosines around 0.95 to it."""
    axis = rng.normal(size=width)
    axis /= np.sqrt(axis @ axis)
    side = rng.normal(size=(others, width))
    side -= np.outer(side @ axis, axis)
    side /= np.sqrt((side * side).sum(axis=1, keepdims=True))
    cosine = rng.uniform(0.94, 1, others)[:, None]
    near = cosine * axis + np.sqrt(1 - cosine**2) * side
    return np.concatenate([np.outer(rng.uniform(0.1, 10, copies), axis), near]).astype(np.float32).astype(float)


def test_linked_vectors_meet_in_a_cell_when_pivots_have_one_direction():
    rng = np.random.default_rng(8)
    rows = unit(scaled_copies(rng, 600, 600))
    pivots = np.concatenate([rows[:13], rows[600:627]])
    home, guest = Cells(pivots, np.sqrt(2 - 2 * 0.95)).homes(rows)
    a, b = np.nonzero(np.triu(rows @ rows.T >= 0.95, 1))
    assert (((home[a] == home[b]) | guest[a, home[b]] | guest[b, home[a]])).all()


def test_scaled_copies_and_small_cells(spark):
    rows = list(enumerate(scaled_copies(np.random.default_rng(9), 130, 260).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, grouped(df, cell=10).collect()), key=repr) == brute(rows)
