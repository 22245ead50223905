"""Benchmark decontamination: size-partitioned MinHash containment search.

An item counts as leaked into a document when the document holds ``percent`` or more of the item's
word shingles. An item with m shingles that is contained so far shares at least one of its
m - ceil(t * m) + 1 least shingle hashes (its bottom MinHash sketch) with the document, so the
search misses nothing. Items are partitioned by size (powers of two); each partition has its own
sketch bound, and a document probes only partitions whose least item it is large enough to hold,
and only with its own hashes up to the bound. Candidates are verified by exact shingle containment.

The items are the query set. They go to the tasks in blocks of at most ``BLOCK_TOKENS`` shingles,
so what is broadcast never grows; documents stay where they are and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import id_and_text, written
from pvspark.llm.shingles import shingle_sets

BLOCK_TOKENS = 1_000_000


@dataclass
class Partition:
    """Items of similar size: sketch hashes with the item each belongs to, and the bounds for a probe."""

    smallest: int
    bound: np.uint64
    hashes: np.ndarray
    owners: np.ndarray


@dataclass
class ItemBlock:
    ids: np.ndarray
    sets: list[np.ndarray]
    partitions: list[Partition]


def sketch_length(m: int, percent: int) -> int:
    return m - -(-percent * m // 100) + 1


def item_block(ids, sets: list[np.ndarray], percent: int) -> ItemBlock:
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        by_size.setdefault(len(s).bit_length(), []).append(i)
    partitions = []
    for members in by_size.values():
        sketches = [sets[i][:sketch_length(len(sets[i]), percent)] for i in members]
        hashes, owners = np.concatenate(sketches), np.repeat(members, [len(s) for s in sketches])
        order = np.argsort(hashes, kind="stable")
        partitions.append(Partition(min(-(-percent * len(sets[i]) // 100) for i in members), hashes.max(),
                                    hashes[order], owners[order]))
    return ItemBlock(np.asarray(ids), sets, partitions)


def find_items(sets: list[np.ndarray], block: ItemBlock, percent: int) -> Iterator[tuple[int, int, int]]:
    """(index in ``sets``, item index, shared shingles) of every leaked item."""
    size = np.array([len(s) for s in sets])
    flat, owner = (np.concatenate(sets), np.repeat(np.arange(len(sets)), size)) if size.sum() else (None, None)
    pairs = []
    for part in block.partitions if flat is not None else []:
        probe = (flat <= part.bound) & (size >= part.smallest)[owner]
        tok, doc = flat[probe], owner[probe]
        lo, hi = np.searchsorted(part.hashes, tok, "left"), np.searchsorted(part.hashes, tok, "right")
        hit = np.flatnonzero(hi > lo)
        if len(hit):
            n = hi[hit] - lo[hit]
            at = np.repeat(lo[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            pairs.append(np.stack([np.repeat(doc[hit], n), part.owners[at]], axis=1))
    for d, i in np.unique(np.concatenate(pairs), axis=0) if pairs else []:
        item, doc = block.sets[i], sets[d]
        at = np.minimum(np.searchsorted(doc, item), len(doc) - 1)
        shared = int((doc[at] == item).sum())
        if 100 * shared >= percent * len(item):
            yield int(d), int(i), shared


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, percent: int) -> Iterator[ItemBlock]:
    """The items' shingle sets, read from a written table in blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, sets in shingle_sets(b.column("text"), width):
                yield pa.record_batch([b.column("doc_id").slice(start, len(sets)),
                                       pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array([s.tobytes() for s in sets], pa.binary())],
                                      names=["item_id", "n", "tokens"])

    items = id_and_text(benchmark, item_col, text_col).mapInArrow(run, "item_id long, n long, tokens binary")
    items = written(items.where("n > 0").dropDuplicates(["item_id", "tokens"]), "items")
    total = items.agg(F.sum("n").alias("n")).first()["n"] or 0
    count = -(-total // (BLOCK_TOKENS // 2))  # a block has half of the bound on average
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("tokens", "item_id"), F.lit(count)) == k)
        ids, sets, held = [], [], 0
        for r in part.toLocalIterator():
            ids.append(r["item_id"])
            sets.append(np.frombuffer(r["tokens"], np.uint64))
            held += r["n"]
            if held >= BLOCK_TOKENS:
                yield item_block(ids, sets, percent)
                ids, sets, held = [], [], 0
        if sets:
            yield item_block(ids, sets, percent)


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", width: int = 5,
                 percent: int = 75) -> DataFrame:
    """One row per row of ``documents`` and leaked item: doc_id, item_id, n_item, n_shared, containment.

    n_item counts the item's distinct shingles, n_shared those in the document. An item shorter than
    ``width`` words has its whole sequence as its one shingle, so it is found only in texts of just
    these words. Null, empty or wordless texts hold nothing and leak nothing; null ids are kept;
    repeated documents are reported each, repeated equal items once. Empty tables give an empty
    result; other columns are not read.
    """
    docs = id_and_text(documents, id_col, text_col)
    schema = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    found = None
    for block in _blocks(benchmark, item_col, item_text_col, width, percent):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for b in batches:
                rows = []
                ids = b.column("doc_id")
                for start, sets in shingle_sets(b.column("text"), width):
                    for d, i, shared in find_items(sets, block, percent):
                        n = len(block.sets[i])
                        rows.append((ids[start + d].as_py(), block.ids[i], n, shared, shared / n))
                if rows:
                    cols = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)],
                                          names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

        part = docs.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no item of ``benchmark`` (see ``contaminated``)."""
    out = documents
    for block in _blocks(benchmark, item_col, item_text_col, width, percent):
        sent = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(len(b), bool)
                for start, sets in shingle_sets(b.column(text_col), width):
                    for d, _, _ in find_items(sets, sent.value, percent):
                        keep[start + d] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out
