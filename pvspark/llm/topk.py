"""Exact top-k inner products, norm-sorted with rotated partial sums.

The vectors are rotated by the eigenvectors of their Gram matrix (the right singular vectors of the
vector table), so that a few leading coordinates carry most of every product. Vectors are dealt out in
bands of descending length, queries in shards; a band and a shard make a cell of bounded size. The longest
vectors of all give every query a first k-th best score, and a query goes only to the bands whose greatest
length times its own reaches that score; a band that no query needs is not sent. In a cell vectors
are taken by descending length, a block at a time. Cauchy-Schwarz bounds skip work exactly: a query
leaves the cell when its length times the block's greatest length is below its k-th best score; a vector
is dropped when the leading partial sum plus the product of the residual lengths is. What is left is
scored in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvspark.llm.common import shuffle_partitions, written

CELL_VECTORS = 8192      # vectors in a cell
CELL_QUERIES = 2048      # queries in a cell
SEED_VECTORS = 1024      # longest vectors that give every query its first bound
BANDS = 256              # bands of lengths, at most
BLOCK = 512              # vectors scored together
_LONG = np.iinfo(np.int64)


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, vec_id, v, squares): floor(scale * x) of each usable vector and its squared length; rows are numbered."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    squares = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    return (table.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & usable)
            .select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v"))
            .withColumn("squares", squares))


def _matrix(lists, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers; a product beyond 64 bits takes the nearest long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if bound < 2.0 ** 53:  # every partial sum is a whole number that a double holds
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 2.0 ** 62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


def gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of outer products over all vectors: one partial matrix a task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column("v").to_pylist(), dim).astype(np.float64)
            total += m.T @ m
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total.reshape(-1)[at])], names=["at", "value"])

    out = np.zeros(dim * dim)
    for row in vectors.select("v").mapInArrow(run, "at long, value double").groupBy("at").agg(
            F.sum("value").alias("value")).collect():  # dim * dim entries at most
        out[row["at"]] = row["value"]
    return out.reshape(dim, dim)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~scores))[:k]  # ~ orders downward without overflow


def search_cell(q_ids, q, ids, v, rotation: np.ndarray, lead: int, k: int, floor: np.ndarray):
    """The k best of a cell for each query, never below ``floor``: (query_id, vec_id, score) arrays."""
    qf, vf = q.astype(np.float64), v.astype(np.float64)
    length = np.sqrt((vf * vf).sum(1))
    order = np.lexsort((ids, -length))
    ids, v, vf, length = ids[order], v[order], vf[order], length[order]
    q_length = np.sqrt((qf * qf).sum(1))
    qr, vr = qf @ rotation, vf @ rotation
    q_rest, v_rest = (np.sqrt((m[:, lead:] ** 2).sum(1)) for m in (qr, vr))
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
    bar = floor.astype(np.float64)
    active = np.arange(len(q))
    for s in range(0, len(ids), BLOCK):
        e = min(s + BLOCK, len(ids))
        slack = 1e-9 * q_length[active] * length[s] + 1e-6  # rounding of the bounds
        active = active[q_length[active] * length[s] + slack >= bar[active]]
        if not len(active):
            break
        slack = 1e-9 * q_length[active] * length[s] + 1e-6
        reach = qr[active, :lead] @ vr[s:e, :lead].T + np.outer(q_rest[active], v_rest[s:e]) + slack[:, None]
        hit = reach >= bar[active][:, None]
        rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(rows):
            continue
        exact = inner_products(q[active[rows]], v[s:e][cols])
        for r, scores in zip(rows, exact, strict=True):
            a = active[r]
            keep = hit[r, cols] & (scores >= bar[a]) & (ids[s:e][cols] != q_ids[a])
            if keep.any():
                sc, found = np.r_[best[a][0], scores[keep]], np.r_[best[a][1], ids[s:e][cols][keep]]
                top = _best(sc, found, k)
                best[a] = (sc[top], found[top])
                if len(top) == k:
                    bar[a] = max(bar[a], float(sc[top][-1]) if abs(int(sc[top][-1])) < 2 ** 53 else bar[a])
    n = np.array([len(b[0]) for b in best], dtype=np.int64)
    return (np.repeat(q_ids, n), np.concatenate([b[1] for b in best]), np.concatenate([b[0] for b in best]))


def _length_bands(vectors: DataFrame, asked: DataFrame, n: int, q_shards: int) -> tuple[DataFrame, DataFrame]:
    """Vectors with their shard ``i`` of a band of lengths, and queries with each (i, j) they have to see.

    Bands are cut at quantiles of the squared length, BANDS at most; a band of many vectors has several shards.
    """
    bands = max(1, min(BANDS, -(-n // CELL_VECTORS)))
    cuts = vectors.agg(F.percentile_approx("squares", [b / bands for b in range(1, bands)] or [0.5], 10_000)).first()[0]
    cuts = sorted(set(cuts)) if bands > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("squares"))) if cuts else F.lit(0)
    vectors = vectors.withColumn("band", at)
    sizes = vectors.groupBy("band").agg(F.count("*").alias("n"), F.max("squares").alias("most")).orderBy("band").collect()
    rows, first = [], 0  # a row a band
    for r in sizes:
        shards = -(-r["n"] // CELL_VECTORS)
        rows.append((r["band"], first, shards, math.sqrt(r["most"])))
        first += shards
    table = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(i).cast("long").alias("first"), F.lit(c).cast("long").alias("shards"),
                               F.lit(m).alias("longest")) for b, i, c, m in rows])
    of = F.filter(table, lambda t: t["band"] == F.col("band"))[0]
    banded = vectors.select("vec_id", "v", of.alias("b"), "row").select(
        "vec_id", "v", (F.col("b.first") + F.pmod(F.xxhash64("row"), F.col("b.shards"))).alias("i"))
    reach = F.sqrt("squares")
    needed = F.filter(table, lambda t: reach * t["longest"] * (1 + 1e-9) + 1e-6 >= F.col("bar"))
    every = F.flatten(F.transform(needed, lambda t: F.sequence(t["first"], t["first"] + t["shards"] - 1)))
    return banded, asked.select("vec_id", "v", "bar", F.explode(every).alias("i"),
                                F.pmod(F.xxhash64("row"), F.lit(q_shards)).alias("j"))


def top_k_search(table: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest integer inner products: query_id, rank (from 1), vec_id, score.

    Components are floor(``scale`` * x). Queries are the rows whose id is divisible by ``every``;
    candidates are all rows but those of the query's id; ties go to the smaller vec_id; with fewer
    candidates all are returned. Rows with a null id, a null vector, or null or non-finite
    components take no part. Vectors of unequal length compare as if filled up with zeros; an empty
    vector scores 0. Rows that repeat an id are candidates of their own, and a repeated query's results are
    ranked together. A score beyond 64 bits is the nearest long. An empty table gives an empty result;
    other columns are not read.
    """
    spark = table.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    vectors = written(integer_vectors(table, id_col, vector_col, scale), "vectors")
    is_query = F.col("vec_id") % every == 0
    facts = vectors.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n"),
                        F.count_if(is_query).alias("queries")).first()
    dim, n, queries = facts["dim"] or 0, facts["n"], facts["queries"]
    if not n or not queries:
        return spark.createDataFrame([], out)
    if dim:
        value, axes = np.linalg.eigh(gram(vectors, dim))
        rotation = axes[:, ::-1]
        share = np.cumsum(np.maximum(value[::-1], 0))
        lead = int(np.searchsorted(share, 0.5 * share[-1])) + 1
    else:
        dim, rotation, lead = 1, np.eye(1), 1

    seeds = vectors.orderBy(F.desc("squares"), "vec_id").limit(SEED_VECTORS).collect()
    seed_ids, seed = np.array([r["vec_id"] for r in seeds]), _matrix([r["v"] for r in seeds], dim)

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with ``bar``, their k-th best score among the longest vectors (as a double; -inf without one)."""
        for b in batches:
            ids, q = b.column("vec_id").to_numpy(), _matrix(b.column("v").to_pylist(), dim)
            first = inner_products(q, seed).astype(np.float64)
            first[ids[:, None] == seed_ids[None, :]] = -np.inf
            bar = np.sort(first, axis=1)[:, -k] if len(seed_ids) >= k else np.full(len(q), -np.inf)
            bar = np.where(np.abs(bar) < 2.0 ** 53, bar, -np.inf)
            yield pa.record_batch([*b.columns, pa.array(bar)], names=[*b.schema.names, "bar"])

    asked = written(vectors.where(is_query).mapInArrow(
        first_scores, "row long, vec_id long, v array<long>, squares double, bar double"), "top-k-queries")
    banded, cells_of = _length_bands(vectors, asked, n, -(-queries // CELL_QUERIES))
    p = shuffle_partitions(spark)
    packed = "is_vector boolean, i long, j long, ids binary, data binary, bars binary"

    def pack(is_vector: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = np.stack([b.column("i").to_numpy(), b.column("j").to_numpy()])
                ids, m, bars = b.column("vec_id").to_numpy(), _matrix(b.column("v").to_pylist(), dim), b.column("bar").to_numpy()
                which, of = np.unique(cell, axis=1, return_inverse=True)
                parts = [of.reshape(-1) == w for w in range(which.shape[1])]
                yield pa.record_batch([
                    pa.array([is_vector] * len(parts)), pa.array(which[0]), pa.array(which[1]),
                    *(pa.array([x[part].tobytes() for part in parts], pa.binary()) for x in (ids, m, bars)),
                ], names=["is_vector", "i", "j", "ids", "data", "bars"])
        return run

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {True: ([], [], []), False: ([], [], [])}

        def closed() -> Iterator[pa.RecordBatch]:
            if held[True][0] and held[False][0]:
                (q_ids, q, bar), (ids, v, _) = ((np.concatenate([np.frombuffer(x, "i8") for x in held[side][0]]),
                                                 np.concatenate([np.frombuffer(x, "i8").reshape(-1, dim) for x in held[side][1]]),
                                                 np.concatenate([np.frombuffer(x, "f8") for x in held[side][2]]))
                                                for side in (False, True))
                found = search_cell(q_ids, q, ids, v, rotation, lead, k, bar)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("i", "j", "is_vector", "ids", "data", "bars")]
            for i, j, side, *parts in zip(*cols, strict=True):
                if (i, j) != key:
                    yield from closed()
                    key, held = (i, j), {True: ([], [], []), False: ([], [], [])}
                for of, x in zip(held[side], parts, strict=True):
                    of.append(x)
        yield from closed()

    sent = banded.join(cells_of.select("i", "j").distinct(), "i").withColumn("bar", F.lit(0.0))
    both = (sent.select("i", "j", "vec_id", "v", "bar").mapInArrow(pack(True), packed)
            .unionByName(cells_of.select("i", "j", "vec_id", "v", "bar").mapInArrow(pack(False), packed)))
    found = (both.repartition(p, "i", "j").sortWithinPartitions("i", "j")
             .mapInArrow(cells, "query_id long, vec_id long, score long"))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
