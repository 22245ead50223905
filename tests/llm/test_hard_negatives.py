"""Hard negatives against brute force, and the soundness and use of the code's intervals."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pvspark.llm import hard_negatives as mining
from pvspark.llm.common import importable

CLASH = "vec_id long, embedding array<double>, label int, row string, g string, i string, code string, score string, anchor string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    importable(spark)


def brute(rows, every=5):
    use = [(k, i, [math.floor(256 * x) for x in v], lab) for k, (i, v, lab) in enumerate(rows)
           if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, v, lab in use:
        if i % every:
            continue
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=False)))), j, m, other)
                        for m, j, w, other in use if m != k)
        for score, j, _, _ in [s for s in scored if s[3] == lab][:5]:
            fit = [s for s in scored if s[3] != lab and -50 * score <= -100 * s[0] <= -95 * score]
            out += [(i, j, r + 1, s[1], -score, -s[0]) for r, s in enumerate(fit[:3])]
    return sorted(out)


def mined(spark, rows, every=5):
    table = spark.createDataFrame([(*r, *"abcdef") for r in rows], CLASH)
    return sorted(tuple(r) for r in mining.mine_hard_negatives(table, F.col("vec_id") % every == 0).collect())


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, dim)) * 2
    return [(i, [float(x) for x in centres[r.integers(6)] + 0.3 * r.standard_normal(dim)], int(r.integers(4))) for i in range(n)]


@pytest.mark.parametrize("shard,coded", [(1 << 15, 1024), (40, 1024), (1 << 15, 5)])
def test_mining_matches_brute_force(spark, monkeypatch, shard, coded):
    monkeypatch.setattr(mining, "CELL_VECTORS", shard)
    monkeypatch.setattr(mining, "CELL_ANCHORS", max(7, shard // 8))
    monkeypatch.setattr(mining, "CODED", coded)
    monkeypatch.setattr(mining, "BLOCK_ROWS", 64)
    rows = clustered(260, 12, shard + coded)
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (7, rows[7][1], rows[7][2]), (900, [0.0] * 12, 2), (905, [], 2),
             (910, [1.0, 2.0], 3), (911, [1.0] * 20, 3), (None, [1.0] * 12, 1), (920, None, 1), (925, [1.0, None], 1),
             (930, [1.0, float("nan")], 1), (935, [float("inf")], 1), (940, [1.0] * 12, None), (945, [9.0] * 12, 77)]
    rows += [(1000 + i, [0.25] * 12, i % 3) for i in range(40)]  # ties
    assert mined(spark, rows) == brute(rows)


def test_products_beyond_64_bits(spark):
    rows = [(i, [float(10 ** (i % 9 + 1)), -float(3 ** i), 0.5], i % 2) for i in range(24)]
    assert mined(spark, rows) == brute(rows)


def test_mining_of_an_empty_table(spark):
    assert mined(spark, []) == []


def test_one_label_or_no_anchor_gives_nothing(spark):
    rows = clustered(40, 4, 3)
    assert mined(spark, [(i, v, 1) for i, v, _ in rows]) == []
    assert mined(spark, [(5 * i + 1, v, lab) for i, v, lab in rows]) == []


def vectors(m):
    n = len(m)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1)))
    return mining.Vectors(pa.record_batch([pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array([str(i % 2) for i in range(n)]),
                                           lists], names=["row", "vec_id", "label", "v"]), m.shape[1])


@pytest.mark.parametrize("dim", [1, 7, 64, 100])
def test_intervals_hold_every_product(dim):
    r = np.random.default_rng(dim)
    m = np.floor(r.standard_normal((300, dim)) * r.integers(1, 3000, (300, 1))).astype(np.int64)
    m[0] = 0
    v, turn = vectors(m), mining.rotation(dim)
    middle, off = mining.Queries(v, turn).intervals(*mining.codes(v, turn))
    assert (np.abs(m @ m.T - middle) <= off).all()


def test_intervals_leave_out_most_of_what_is_clustered():
    r = np.random.default_rng(1)
    centres = r.standard_normal((20, 32))
    m = np.floor(256 * (centres[r.integers(20, size=2000)] + 0.02 * r.standard_normal((2000, 32)))).astype(np.int64)
    v, turn = vectors(m), mining.rotation(32)
    anchors = v.taken(np.arange(0, 2000, 100))
    top = (anchors.head @ m.T).max(1)
    cell = mining.Cell(anchors, turn, (top * 9 // 10)[:, None], top[:, None], 3, False)
    cell.add(v, *mining.codes(v, turn))
    assert 0 < cell.scored < 0.5 * len(anchors.row) * len(m)


