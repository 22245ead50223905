"""Hard negatives by rotated one-bit codes with Cauchy-Schwarz intervals.

A vector x is rotated by a fixed random rotation and coded by the signs of its coordinates; c is the unit
vector of these signs. Stored beside the code are the alignment <x, c> and the length of the rest
x - <x, c>c. For a query q, whose rotated coordinates are cut into planes of bits, popcounts of code and
planes give t, an estimate of <q, c> that is off by at most the length e of what the planes lose. Then
<x, q> lies within <x, c> t, plus or minus |<x, c>| e + |rest| sqrt(|q|^2 - max(0, |t| - e)^2), since the rest
is orthogonal to c. Vectors whose interval reaches no wanted score are out; all others are scored in integers.

Anchors meet all vectors in cells: an anchor shard is held, vectors are streamed past it a batch at a time.
1. In cells of one label each anchor finds its positives, the highest scores of its own label.
2. Positive scores give windows of scores; cells over all labels find the highest negatives of each window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvspark.llm.common import shuffle_partitions, written
from pvspark.llm.topk import inner_products

CELL_VECTORS = 1 << 13   # vectors in a cell, about
CELL_ANCHORS = 2048      # anchors in a cell, about
PLANES = 6               # planes of bits of a query's coordinates
CODED = 1024             # coordinates in the code; those beyond count to the rest
SEED = 20260117
BLOCK_ROWS = 512         # vectors scored together
_NONE, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def rotation(dim: int) -> np.ndarray:
    """The fixed random rotation of ``dim`` coordinates."""
    if not dim:
        return np.zeros((0, 0))
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Vectors:
    """Vectors of a batch: ids, labels, leading coordinates as a matrix, and what long ones have beyond it."""

    def __init__(self, batch: pa.RecordBatch, dim: int):
        self.row, self.id = (batch.column(c).to_numpy() for c in ("row", "vec_id"))
        self.label = np.array(batch.column("label").to_pylist(), dtype=object)
        lists = batch.column("v")
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        size = np.diff(offsets)
        self.tail: dict[int, np.ndarray] = {}
        if len(size) and (size == dim).all():
            self.head = values[offsets[0]:offsets[-1]].reshape(-1, dim)
        else:
            self.head = np.zeros((len(size), dim), np.int64)
            for i, n in enumerate(size):
                v = values[offsets[i]:offsets[i + 1]]
                self.head[i, :min(n, dim)] = v[:dim]
                if n > dim:
                    self.tail[i] = v[dim:]

    def taken(self, at: np.ndarray) -> Vectors:
        out = Vectors.__new__(Vectors)
        out.row, out.id, out.label, out.head = self.row[at], self.id[at], self.label[at], self.head[at]
        where = {int(a): k for k, a in enumerate(at)}
        out.tail = {where[i]: t for i, t in self.tail.items() if i in where}
        return out

    def squares(self) -> np.ndarray:
        out = (self.head.astype(np.float64) ** 2).sum(1)
        for i, t in self.tail.items():
            out[i] += (t.astype(np.float64) ** 2).sum()
        return out


def products(a: Vectors, b: Vectors) -> np.ndarray:
    """Integer inner products; vectors of unequal length compare as if filled up with zeros."""
    out = inner_products(a.head, b.head)
    for i, s in a.tail.items():
        for k, t in b.tail.items():
            n = min(len(s), len(t))
            more = int(out[i, k]) + int(s[:n].astype(object) @ t[:n].astype(object))
            out[i, k] = max(-(1 << 63), min(more, (1 << 63) - 1))
    return out


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def codes(v: Vectors, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of the rotated vectors in words, alignment with the unit vector of the signs, length of the rest."""
    x = v.head @ turn
    align = np.abs(x).sum(1) / np.sqrt(max(1, x.shape[1]))
    return words(x > 0), align, np.sqrt(np.maximum(0, v.squares() - align ** 2))


class Queries:
    """Rotated queries as planes of bits."""

    def __init__(self, v: Vectors, turn: np.ndarray):
        q = v.head @ turn
        self.dim = max(1, q.shape[1])
        self.low = q.min(1) if q.size else np.zeros(len(q))
        self.step = np.maximum((q.max(1) - self.low) / ((1 << PLANES) - 1), 1e-12) if q.size else np.ones(len(q))
        levels = np.rint((q - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = [words((levels >> k & 1).astype(bool)) for k in range(PLANES)]
        kept = self.low[:, None] + self.step[:, None] * levels
        self.sum, self.lost = kept.sum(1), np.sqrt(((q - kept) ** 2).sum(1))
        self.length = np.sqrt(v.squares())

    def intervals(self, code: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimate of each product (query, vector), and how far off it can be."""
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        weighted = np.zeros((len(self.low), len(code)))
        for k, plane in enumerate(self.planes):
            both = np.zeros(weighted.shape, np.int32)
            for w in range(code.shape[1]):
                both += np.bitwise_count(plane[:, w, None] & code[None, :, w])
            weighted += float(1 << k) * both
        inside = self.low[:, None] * ones + self.step[:, None] * weighted  # sum of kept coordinates where the sign is +
        t = (2 * inside - self.sum[:, None]) / np.sqrt(self.dim)
        across = np.sqrt(np.maximum(0, self.length[:, None] ** 2 - np.maximum(0, np.abs(t) - self.lost[:, None]) ** 2))
        reach = np.hypot(align, rest)
        slack = 1e-9 * self.length[:, None] * reach + 1e-6
        return align * t, align * self.lost[:, None] + rest * across + slack


class Best:
    """The k best (score, id, row) of each lane, by descending score, then by id and row."""

    def __init__(self, lanes: int, k: int):
        self.score, self.id, self.row = (np.full((lanes, k), x, np.int64) for x in (_NONE, _MOST, -1))
        self.k = k

    def bar(self) -> np.ndarray:
        """Scores below are of no use to a lane."""
        return self.score[:, -1]

    def add(self, lanes: np.ndarray, score: np.ndarray, use: np.ndarray, v: Vectors) -> None:
        """Offer scores (lane, vector) of the vectors, which are in order of id and row."""
        some = use.any(1)
        lanes, score = lanes[some], np.where(use[some], score[some], _NONE)
        if not len(lanes):
            return
        n = score.shape[1]
        if n > self.k:
            top = int(np.abs(np.where(score == _NONE, 0, score)).max())
            if top < (1 << 60) // n:
                key = np.where(score == _NONE, _NONE, score * n + np.arange(n - 1, -1, -1))
                at = np.argpartition(~key, self.k - 1, axis=1)[:, :self.k]
            else:
                at = np.argsort(~score, axis=1, kind="stable")[:, :self.k]
            score = np.take_along_axis(score, at, 1)
        else:
            at = np.broadcast_to(np.arange(n), score.shape)
        void = score == _NONE
        score = np.concatenate([self.score[lanes], score], 1)
        ids = np.concatenate([self.id[lanes], np.where(void, _MOST, v.id[at])], 1)
        rows = np.concatenate([self.row[lanes], np.where(void, -1, v.row[at])], 1)
        order = np.lexsort((rows, ids, ~score), axis=1)[:, :self.k]
        self.score[lanes], self.id[lanes], self.row[lanes] = (np.take_along_axis(x, order, 1) for x in (score, ids, rows))


class Cell:
    """Anchors with windows of wanted scores, past which vectors are streamed; counts what it scores."""

    def __init__(self, anchors: Vectors, turn: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same_label: bool):
        self.anchors, self.queries, self.same_label = anchors, Queries(anchors, turn), same_label
        self.low, self.high = low, high  # (anchor, window), empty windows have low > high
        self.number = {label: i for i, label in enumerate(dict.fromkeys(anchors.label))}
        self.label = np.array([self.number[x] for x in anchors.label], np.int64)
        self.best = [Best(len(low), k) for _ in range(low.shape[1])]
        self.scored = 0

    def add(self, v: Vectors, code: np.ndarray, align: np.ndarray, rest: np.ndarray) -> None:
        middle, off = self.queries.intervals(code, align, rest)
        most, fewest = np.maximum(middle + off, _NONE), np.minimum(middle - off, _MOST)  # scores end where longs end
        label = np.array([self.number.get(x, -1) for x in v.label], np.int64)
        fits = (self.label[:, None] == label[None, :]) == self.same_label
        fits &= self.anchors.row[:, None] != v.row[None, :]
        wanted = np.zeros(fits.shape, bool)
        for w, best in enumerate(self.best):
            least = np.maximum(self.low[:, w], best.bar()).astype(np.float64)
            open_ = self.low[:, w] <= self.high[:, w]
            slack = 1e-15 * np.abs(least) + 1  # of a long as a double
            wanted |= ((most >= (least - slack)[:, None]) & open_[:, None]
                       & (fewest <= (self.high[:, w].astype(np.float64) + slack)[:, None]))
        wanted &= fits
        lanes, at = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        if not len(lanes):
            return
        at = at[np.lexsort((v.row[at], v.id[at]))]
        some = v.taken(at)
        score = products(self.anchors.taken(lanes), some)
        self.scored += score.size
        use = wanted[np.ix_(lanes, at)]
        for w, best in enumerate(self.best):
            inside = (score >= self.low[lanes, w, None]) & (score <= self.high[lanes, w, None])
            best.add(lanes, score, use & inside, some)

    def found(self) -> Iterator[pa.RecordBatch]:
        for w, best in enumerate(self.best):
            lane, place = np.nonzero(best.row >= 0)
            yield pa.record_batch([pa.array(self.anchors.row[lane]), pa.array(np.full(len(lane), w, np.int32)),
                                   pa.array(best.row[lane, place]), pa.array(best.id[lane, place]),
                                   pa.array(best.score[lane, place])], names=["anchor", "window", "row", "vec_id", "score"])


def _batches_of(batch: pa.RecordBatch, key: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal keys of a batch, none longer than BLOCK_ROWS."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start] or i - start == BLOCK_ROWS:
            yield keys[start], batch.slice(start, i - start)
            start = i


def _searched(vectors: DataFrame, anchors: DataFrame, turn, dim: int, k: int, windows: int, same_label: bool) -> DataFrame:
    """(anchor, window, row, vec_id, score): the k best of each cell. Both sides have a group g and shards i, j."""
    spark = vectors.sparkSession
    anchors = anchors.withColumn("side", F.lit(0))
    both = (vectors.withColumn("side", F.lit(1)).withColumn("low", F.lit(None).cast("array<long>"))
            .withColumn("high", F.lit(None).cast("array<long>")).unionByName(anchors.select(*vectors.columns, "side", "low", "high")))
    key = ["g", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, cell = None, [], None
        for b in batches:
            for (*at, side), part in _batches_of(b, [*key, "side"]):
                if at != current:
                    if cell is not None:
                        yield from cell.found()
                    current, held, cell = at, [], None
                if side == 0:
                    held.append(part)
                    continue
                if cell is None:
                    if not held:
                        continue  # vectors of a cell without anchors
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    bounds = [np.array([(x + [1] * windows)[:windows] for x in rows.column(c).to_pylist()], np.int64)
                              for c in ("low", "high")]
                    n = np.array([len(x) for x in rows.column("low").to_pylist()])
                    bounds[1][np.arange(windows)[None, :] >= n[:, None]] = 0  # windows that an anchor does not have
                    cell, held = Cell(Vectors(rows, dim), turn.value, *bounds, k, same_label), []
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint64).reshape(len(part), -1)
                cell.add(Vectors(part, dim), code, part.column("align").to_numpy(), part.column("rest").to_numpy())
        if cell is not None:
            yield from cell.found()

    found = (both.repartition(shuffle_partitions(spark), *key).sortWithinPartitions(*key, "side")
             .mapInArrow(run, "anchor long, window int, row long, vec_id long, score long"))
    by = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _shards(count: Column, size: int) -> Column:
    return F.ceil(count / size).cast("long")


def _shard_of(n: Column) -> Column:
    return F.pmod(F.xxhash64("row"), n)


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def mine_hard_negatives(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50,
                        high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
                        label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components are floor(``scale`` * x); a score is the integer inner product with the anchor; higher scores
    come first, ties by smaller id. An anchor (``is_anchor``, over the columns of ``table``) has as positives the
    first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels come whose
    score is ``low`` to ``high`` percent of the positive's. A pair without one has no row; nor has a negative
    positive score. Rows with a null id, label or vector, or with null or non-finite components take no part.
    Rows that repeat an id are rows of their own. Vectors of unequal length compare as if filled up with
    zeros; an empty vector scores 0. A score beyond 64 bits is the nearest long. An empty table gives an
    empty result; other columns are not read.
    """
    x = F.col(f"`{vector_col}`").cast("array<double>")
    label = F.col(f"`{label_col}`")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    given = (table.where(F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & x.isNotNull() & usable)
             .select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                     label.cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
                     F.transform(x, lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v")))
    dim = min(CODED, given.agg(F.max(F.size("v"))).first()[0] or 0)
    turn = table.sparkSession.sparkContext.broadcast(rotation(dim))  # CODED x CODED at most

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, align, rest = codes(Vectors(b, dim), turn.value)
            yield pa.record_batch([*b.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(align),
                                   pa.array(rest)], names=[*b.schema.names, "code", "align", "rest"])

    vectors = written(given.mapInArrow(coded, "row long, vec_id long, label string, is_anchor boolean, v array<long>, "
                                              "code binary, align double, rest double"), "coded-vectors")
    keep = ["row", "vec_id", "label", "v", "code", "align", "rest"]

    # 1. positives, in cells of one label
    counts = vectors.groupBy("label").agg(_shards(F.count("*"), CELL_VECTORS).alias("n_i"),
                                          _shards(F.count_if("is_anchor"), CELL_ANCHORS).alias("n_j")).where("n_j > 0")
    sharded = vectors.join(counts, "label").withColumn("g", F.col("label"))
    any_score = F.array(F.lit(_NONE + 1).cast("long")), F.array(F.lit(_MOST).cast("long"))
    found = _searched(sharded.select("g", _shard_of(F.col("n_i")).alias("i"), _every(F.col("n_j")).alias("j"), *keep),
                      sharded.where("is_anchor").select("g", _shard_of(F.col("n_j")).alias("j"), _every(F.col("n_i")).alias("i"),
                                                        *keep, any_score[0].alias("low"), any_score[1].alias("high")),
                      turn, dim, positives, 1, True)
    pairs = written(found.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                                 F.col("score").alias("positive_score")), "positives")

    # 2. negatives, in cells over all labels
    of = F.col("positive_score").cast("decimal(38, 0)")
    bounds = pairs.select("anchor", F.struct("place", F.ceil(of * low / 100).cast("long").alias("low"),
                                             F.floor(of * high / 100).cast("long").alias("high")).alias("w"))
    bounds = bounds.groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("w"))  # ``positives`` entries at most
    asked = vectors.join(bounds.withColumnRenamed("anchor", "row"), "row").select(
        *keep, F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    total = vectors.agg(_shards(F.count("*"), CELL_VECTORS).alias("n_i"),
                        _shards(F.count_if("is_anchor"), CELL_ANCHORS).alias("n_j")).first()
    n_i, n_j, g = F.lit(max(1, total["n_i"])), F.lit(max(1, total["n_j"])), F.lit("").alias("g")
    found = _searched(vectors.select(g, _shard_of(n_i).alias("i"), _every(n_j).alias("j"), *keep),
                      asked.select(g, _shard_of(n_j).alias("j"), _every(n_i).alias("i"), *keep, "low", "high"),
                      turn, dim, negatives, positives, False)
    ids = vectors.where("is_anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (found.withColumn("place", F.col("window") + 1).join(pairs, ["anchor", "place"]).join(ids, "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                    F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
