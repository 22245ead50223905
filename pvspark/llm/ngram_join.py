"""N-gram Jaccard join: rare-first prefix filtering on shingle sets.

1. Texts with equal shingle sets form one class; only classes take part further on.
2. Every (shingle, class) goes once, packed in binary rows, to its shingle's bucket, where the
   exact document frequency is counted. Shingles of a single class go no further: they can link
   nothing. The others return, with their frequency, to the bucket of their class.
3. Each class orders its shingles rare first (frequency, then hash; the single ones lead). With n
   shingles, any partner at the threshold shares one of the first n - ceil(t * n) + 1: the prefix.
   Classes whose prefix holds no shared shingle are done.
4. Prefix shingles connect classes into candidate groups; a group is verified in cells of bounded
   size (a large group in pairs of blocks). In a cell an index over prefix shingles, and length,
   positional and suffix filters, leave few pairs, and each is verified once, at its first common
   prefix shingle. A cell returns link counts and a spanning star for each class it joins, never
   the pairs.
5. The links' connected components give ``component_id``.

Shingles are 64-bit hashes and class ids 64-bit digests of whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import id_and_text, shuffle_partitions, written
from pvspark.llm.graph import connected_components
from pvspark.llm.shingles import shingle_sets

# Tokens packed together before they are dealt out to buckets.
FLUSH_TOKENS = 1 << 20
# A cell holds at most two blocks of about so many classes and shared shingles.
BLOCK_CLASSES = 1024
BLOCK_TOKENS = 400_000


def class_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def required_overlap(total, percent: int):
    """Smallest intersection of sets with ``total`` members together: 100 i >= percent * (total - i)."""
    return -(-percent * total // (100 + percent))


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, class_id) per row; class_id is null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, c = [], []
            for _, sets in shingle_sets(b.column("text"), width):
                n += [len(s) for s in sets]
                c += [class_id(s) if len(s) else None for s in sets]
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(c, pa.int64())],
                                  names=["doc_id", "n_shingles", "class_id"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, class_id long")


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, with the length of the array at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.r_[np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]), len(sorted_values)]


_PACKED = "bucket int, classes binary, sizes binary, counts binary, low binary, high binary"


def _dealt(classes, sizes, sets, buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.array([len(s) for s in sets])
    tok, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
    bucket = ((tok >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    tok, owner, bucket = tok[order], owner[order], bucket[order]
    cut = _runs(bucket)
    cols: list[list] = [[] for _ in range(6)]
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        heads = _runs(owner[s:e])
        own = owner[s:e][heads[:-1]]
        for col, value in zip(cols, (int(bucket[s]), classes[own].tobytes(), sizes[own].tobytes(),
                                     np.diff(heads).astype(np.uint32).tobytes(),
                                     tok[s:e].astype(np.uint32).tobytes(),
                                     (tok[s:e] >> np.uint64(32)).astype(np.uint32).tobytes()), strict=True):
            col.append(value)
    yield pa.record_batch([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                          names=["bucket", "classes", "sizes", "counts", "low", "high"])


def _deal_tokens(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """All (shingle, class) of ``docs``, packed by bucket; a task sends a set once, however often it has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        classes, sets, held = [], [], 0

        def flush():
            c, n = np.array(classes, np.int64), np.array([len(s) for s in sets], np.uint32)
            return _dealt(c, n, sets, buckets)

        for b in batches:
            for _, found in shingle_sets(b.column("text"), width):
                for s in found:
                    if not len(s) or (c := class_id(s)) in seen:
                        continue
                    seen.add(c)
                    classes.append(c)
                    sets.append(s)
                    held += len(s)
                    if held >= FLUSH_TOKENS:
                        yield from flush()
                        classes, sets, held = [], [], 0
        if sets:
            yield from flush()

    return docs.select("text").mapInArrow(run, _PACKED)


def _unpacked(batches: Iterator[pa.RecordBatch], names: list[str], kinds: list[str]) -> dict[int, list[tuple]]:
    """Binary rows of a partition as numpy arrays, by bucket."""
    found: dict[int, list[tuple]] = {}
    for b in batches:
        for i, k in enumerate(b.column("bucket").to_pylist()):
            found.setdefault(k, []).append(tuple(
                np.frombuffer(b.column(n)[i].as_py(), kind) for n, kind in zip(names, kinds, strict=True)))
    return found


def _shared_tokens(packed: DataFrame, buckets: int) -> DataFrame:
    """Shingles held by two classes at least, with their document frequency, packed by their class's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _unpacked(batches, ["classes", "sizes", "counts", "low", "high"], ["i8", "u4", "u4", "u4", "u4"])
        for bucket in list(found):
            rows = found.pop(bucket)
            low = np.concatenate([r[3] for r in rows]).astype(np.uint64)
            low |= np.concatenate([r[4] for r in rows]).astype(np.uint64) << np.uint64(32)
            order = np.argsort(low, kind="stable")
            tok = low[order]
            same = tok[1:] == tok[:-1]
            shared = np.r_[False, same] | np.r_[same, False]
            order, tok = order[shared], tok[shared]
            cls = np.concatenate([np.repeat(r[0], r[2]) for r in rows])[order]
            size = np.concatenate([np.repeat(r[1], r[2]) for r in rows])[order]
            order = np.lexsort((cls, tok))
            tok, cls, size = tok[order], cls[order], size[order]
            if len(tok):  # a class that several tasks sent counts once
                new = np.r_[True, (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])]
                tok, cls, size = tok[new], cls[new], size[new]
            cut = _runs(tok)
            df = np.repeat(np.diff(cut), np.diff(cut))
            keep = df > 1
            tok, cls, size, df = tok[keep], cls[keep], size[keep], df[keep]
            if not len(tok):
                continue
            to = (cls.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.lexsort((cls, to))
            tok, cls, size, df, to = tok[order], cls[order], size[order], df[order], to[order]
            cut = _runs(to)
            cols: list[list] = [[] for _ in range(6)]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                heads = _runs(cls[s:e])
                for col, value in zip(cols, (int(to[s]), cls[s:e][heads[:-1]].tobytes(),
                                             size[s:e][heads[:-1]].tobytes(),
                                             np.diff(heads).astype(np.uint32).tobytes(),
                                             tok[s:e].tobytes(), df[s:e].astype(np.uint32).tobytes()), strict=True):
                    col.append(value)
            yield pa.record_batch([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                  names=["bucket", "classes", "sizes", "counts", "tokens", "dfs"])

    return packed.mapInArrow(run, "bucket int, classes binary, sizes binary, counts binary, tokens binary, dfs binary")


def _rare_first(replies: DataFrame, percent: int) -> DataFrame:
    """Classes with a shared shingle in their prefix: their shared shingles rare first, and the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _unpacked(batches, ["classes", "sizes", "counts", "tokens", "dfs"], ["i8", "u4", "u4", "u8", "u4"])
        for bucket in list(found):
            rows = found.pop(bucket)
            cls = np.concatenate([np.repeat(r[0], r[2]) for r in rows])
            size = np.concatenate([np.repeat(r[1], r[2]) for r in rows]).astype(np.int64)
            tok, df = np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
            order = np.lexsort((tok, df, cls))
            cls, size, tok, df = cls[order], size[order], tok[order], df[order]
            cut = _runs(cls)
            n, shared = size[cut[:-1]], np.diff(cut)
            within = np.minimum(prefix_length(n, percent) - (n - shared), shared)
            keep = np.flatnonzero(within > 0)
            for part in range(0, len(keep), 500):
                at = keep[part:part + 500]
                span = [slice(cut[i], cut[i + 1]) for i in at]
                yield pa.record_batch([
                    pa.array(cls[cut[at]], pa.int64()), pa.array(n[at], pa.int64()),
                    pa.array([tok[cut[i]:cut[i] + w].view(np.int64) for i, w in zip(at, within[at], strict=True)],
                             pa.list_(pa.int64())),
                    pa.array([tok[s].tobytes() for s in span], pa.binary()),
                    pa.array([df[s].tobytes() for s in span], pa.binary()),
                ], names=["class_id", "n", "prefix", "tokens", "dfs"])

    return replies.mapInArrow(run, "class_id long, n long, prefix array<long>, tokens binary, dfs binary")


def link_cell(cls, n, within, tokens, dfs, copies, block, across: bool, percent: int):
    """PPJoin in one cell: (class, smallest class it is joined with, documents it links to) per linked class.

    ``block`` tells the cell's two blocks apart; ``across`` them (either may be empty), only such pairs count.
    """
    order = np.lexsort((cls, n))
    cls, n, within, copies, block = (np.asarray(x)[order] for x in (cls, n, within, copies, block))
    tokens, dfs = [tokens[i] for i in order], [dfs[i] for i in order]
    length = np.array([len(t) for t in tokens])
    flat, df = np.concatenate(tokens), np.concatenate(dfs)
    u, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
    rank_of = np.empty(len(u), np.int64)
    rank_of[np.lexsort((u, df[first]))] = np.arange(len(u))
    at = np.r_[0, np.cumsum(length)]
    ranks = rank_of[inverse.reshape(-1)]
    doc = np.repeat(np.arange(len(cls)), length)
    idx = np.arange(len(ranks)) - at[doc]
    lead = n - length  # single shingles before the shared ones
    in_prefix = idx < within[doc]
    pr, pd, pi = ranks[in_prefix], doc[in_prefix], idx[in_prefix]
    order = np.lexsort((pd, pr))
    pr, pd, pi = pr[order], pd[order], pi[order]
    run_start = np.searchsorted(pr, np.arange(len(u) + 1))
    shortest = -(-percent * n // 100)
    degree, root = np.zeros(len(cls), np.int64), np.arange(len(cls))
    mark = np.zeros(len(u), bool)
    for x in range(1, len(cls)):
        own = ranks[at[x]:at[x + 1]]
        from_ = int(np.searchsorted(n, shortest[x]))  # length filter: classes before are too short
        if from_ >= x:
            continue
        ys, ix, iy = [], [], []
        for k, r in enumerate(own[:within[x]]):
            s, e = run_start[r], run_start[r + 1]
            lo, hi = s + np.searchsorted(pd[s:e], from_), s + np.searchsorted(pd[s:e], x)
            if hi > lo:
                ys.append(pd[lo:hi])
                iy.append(pi[lo:hi])
                ix.append(np.full(hi - lo, k))
        if not ys:
            continue
        y, head = np.unique(np.concatenate(ys), return_index=True)  # the first common prefix shingle
        ix, iy = np.concatenate(ix)[head], np.concatenate(iy)[head]
        if across:
            keep = block[y] != block[x]
            y, ix, iy = y[keep], ix[keep], iy[keep]
        need = required_overlap(n[x] + n[y], percent)
        left_x, left_y = length[x] - ix - 1, length[y] - iy - 1
        keep = 1 + np.minimum(left_x, left_y) >= need  # positional filter
        y, ix, iy, need, left_x, left_y = (v[keep] for v in (y, ix, iy, need, left_x, left_y))
        if not len(y):
            continue
        # Suffix filter: the middle shingle of y's suffix divides both suffixes; the parts' lengths bound the overlap.
        middle = iy + 1 + left_y // 2
        pivot = ranks[np.minimum(at[y] + middle, len(ranks) - 1)]
        split = np.maximum(np.searchsorted(own, pivot), ix + 1)
        low = np.minimum(split - ix - 1, left_y // 2)
        high = np.minimum(length[x] - split, left_y - left_y // 2)
        y, need = y[keep := 1 + low + high >= need], need[keep]
        if not len(y):
            continue
        mark[own] = True
        shared = mark[np.concatenate([ranks[at[k]:at[k + 1]] for k in y])]
        common = np.add.reduceat(shared, np.r_[0, np.cumsum(length[y])[:-1]], dtype=np.int64)
        mark[own] = False
        y = y[common >= need]
        if len(y):
            degree[x] += copies[y].sum()
            degree[y] += copies[x]
            joined = np.unique(root[np.r_[x, y]])
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
    linked = np.flatnonzero(degree)
    least = np.full(len(cls), np.iinfo(np.int64).max)
    np.minimum.at(least, root, cls)
    return cls[linked], least[root[linked]], degree[linked]


def _links(candidates: DataFrame, percent: int) -> DataFrame:
    """(class_id, root, links) of every cell."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                cls, n, within, tokens, dfs, copies, block = zip(*rows, strict=True)
                out = link_cell(cls, n, within, [np.frombuffer(t, "u8") for t in tokens],
                                [np.frombuffer(d, "u4") for d in dfs], copies, block, key[1] != key[2], percent)
                if len(out[0]):
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["class_id", "root", "links"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("comp", "i", "j", "class_id", "n", "within", "tokens", "dfs",
                                                      "copies", "block")]
            for comp, i, j, *row in zip(*cols, strict=True):
                if (comp, i, j) != key:
                    yield from closed()
                    key, rows = (comp, i, j), []
                rows.append(row)
        yield from closed()

    size = candidates.groupBy("comp").agg(F.count("*").alias("members"),
                                          F.sum(F.octet_length("tokens") / 8).alias("held"))
    blocks = size.select("comp", F.greatest(F.ceil(F.col("members") / BLOCK_CLASSES),
                                            F.ceil(F.col("held") / BLOCK_TOKENS)).cast("long").alias("k"))
    blocked = candidates.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("class_id"), "k"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    p = shuffle_partitions(candidates.sparkSession)
    return (blocked.select("*", other.alias("o"))
            .select("comp", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "class_id", "n",
                    F.size("prefix").cast("long").alias("within"), "tokens", "dfs", "copies", "block")
            .repartition(p, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
            .mapInArrow(cells, "class_id long, root long, links long"))


def ngram_jaccard_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                       percent: int = 75) -> DataFrame:
    """Components of documents whose word-shingle sets have a Jaccard similarity of ``percent`` or more.

    One row per row of ``documents``: doc_id, n_shingles (size of its set), component_id (smallest
    doc_id reachable by links, itself included), n_links (documents it links to directly, copies
    included). A null or empty text, or one without words, links with nothing. Equal sets always
    link, whatever their ids; a repeated doc_id is one more document with that id. A row with a null
    id keeps it and takes the smallest id of its component, null if there is none. An empty table
    gives an empty result; other columns are not read.
    """
    spark = documents.sparkSession
    docs = id_and_text(documents, id_col, text_col)
    p = shuffle_partitions(spark)
    buckets = min(2 * p, 1 << 16)

    sig = written(signatures(docs, width), "signatures")
    classes = written(sig.where(F.col("class_id").isNotNull()).groupBy("class_id")
                      .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    packed = _deal_tokens(docs, width, buckets).repartition(p, "bucket")
    replies = _shared_tokens(packed, buckets).repartition(p, "bucket")
    candidates = written(_rare_first(replies, percent), "candidates")

    postings = candidates.select("class_id", F.explode("prefix").alias("token"))
    hubs = postings.groupBy("token").agg(F.min("class_id").alias("hub"), F.count("*").alias("held")).where("held > 1")
    groups = connected_components(postings.join(hubs, "token").select("class_id", "hub").where("class_id != hub"))
    known = groups.select(F.col("node").alias("class_id"), F.col("root").alias("comp")).join(
        classes.select("class_id", "copies"), "class_id")
    links = written(_links(candidates.join(known, "class_id"), percent), "links")

    roots = connected_components(links.select("class_id", "root"))
    degree = links.groupBy("class_id").agg(F.sum("links").alias("links"))
    labelled = (classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
                .withColumn("root", F.coalesce("root", "class_id")).join(degree, "class_id", "left"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    labelled = labelled.join(least, "root").select(
        "class_id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sig.join(labelled, "class_id", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
