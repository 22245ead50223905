"""Byte-level BPE encoding and decoding by merge ranks, with a segment tree over byte positions.

A leaf holds the rank of merging the token that starts at its byte with the next one, and an inner node
the leftmost minimum of its children, 32 of them, over which Python's own ``min`` runs. A merge takes the
root's pair, joins the two tokens in the list of live tokens and updates three leaves: the merged token's,
its left neighbour's, and the swallowed one's; their paths to the root are climbed together. A text of n
bytes takes O(n log n) steps, also as one single pre-token.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pvspark.llm.common import id_and_text
from pvspark.llm.pretoken import pre_tokens

# Encoded pre-tokens that a worker keeps.
CACHE = 1 << 19
CACHE_CHARS = 64

# Children of an inner node of the tree, and the value of a leaf whose pair does not merge.
FANOUT = 32
_NEVER = 1 << 62

_loaded: dict[str, Ranks] = {}


class Ranks(dict):
    """A rank file: encoder of pre-tokens and decoder of ids. It maps pre-tokens to their packed ids, as a bounded cache."""

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__()
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.token = {rank: token for token, rank in self.rank.items()}
        self._general = regex.compile(pattern).findall
        self._byte = [self.rank[bytes([c])] for c in range(256)]
        self._pair = [self.rank.get(bytes([c, d]), _NEVER) for c in range(256) for d in range(256)]

    def encode_bytes(self, b: bytes) -> list[int]:
        get, n = self.rank.get, len(b)
        whole = get(b)
        if whole is not None:
            return [whole]
        pair = self._pair
        ids = [self._byte[c] for c in b]  # of the token that starts at each byte: a merge's rank is its token's id
        leaves = [pair[c << 8 | d] for c, d in zip(b, b[1:])]
        leaves.append(_NEVER)
        levels = [leaves]  # from the leaves up to the children of the root
        while len(levels[-1]) > FANOUT:
            below = levels[-1]
            levels.append([min(below[k:k + FANOUT]) for k in range(0, len(below), FANOUT)])
        top, flat = levels[-1], len(levels) == 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := min(top)) < _NEVER:
            i = top.index(least)
            if not flat:
                for level in levels[-2::-1]:
                    i = level.index(least, i * FANOUT)
            j = after[i]
            k = after[j]
            after[i] = k
            ids[i] = least
            leaves[j] = _NEVER
            if k < n:
                before[k] = i
                leaves[i] = get(b[i:after[k]], _NEVER)
            else:
                leaves[i] = _NEVER
            p = before[i]
            if p >= 0:
                leaves[p] = get(b[p:k], _NEVER)
            if not flat:
                changed = {i // FANOUT, j // FANOUT, max(p, 0) // FANOUT}
                for below, level in zip(levels, levels[1:]):
                    for at in changed:
                        level[at] = min(below[at * FANOUT:at * FANOUT + FANOUT])
                    changed = {at // FANOUT for at in changed}
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def __missing__(self, piece: str) -> bytes:
        packed = array("i", self.encode_bytes(piece.encode())).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed as 32-bit integers."""
        return b"".join(map(self.__getitem__, pre_tokens(text, self._general)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def ranks(path: str, pattern: str) -> Ranks:
    """The file's ranks, loaded once a worker."""
    key = f"{path}\0{pattern}"
    if key not in _loaded:
        _loaded[key] = Ranks(path, pattern)
    return _loaded[key]


# Ids in a batch that goes back to Spark.
BATCH_IDS = 1 << 20


def encode_documents(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each row's whole text, without special tokens.

    A null or empty text has no ids. Null and repeated ids are kept, row by row; an empty table
    gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path, pattern)
        for b in batches:
            start, held, size = 0, [], 0
            for i, text in enumerate(b.column("text")):
                held.append(r.encode(text.as_py()))
                size += len(held[-1])
                if size >= 4 * BATCH_IDS or i == len(b) - 1:
                    offsets = np.cumsum([0, *(len(x) // 4 for x in held)], dtype=np.int32)
                    flat = np.frombuffer(b"".join(held), np.int32)
                    yield pa.record_batch([b.column("doc_id").slice(start, len(held)),
                                           pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])
                    start, held, size = i + 1, [], 0

    return id_and_text(documents, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column of the bytes that its ids stand for; null ids give null.

    Bytes need not be valid UTF-8: a list of ids may end inside a character. An id outside the
    vocabulary raises KeyError.
    """
    keep = [f"`{c}`" for c in encoded.columns if c != out_col]
    rows = encoded.select(*keep)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path, pattern)
        for b in batches:
            lists = b.column(at)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            out = [r.decode(flat[offsets[i]:offsets[i + 1]].tolist()) if lists[i].is_valid else None
                   for i in range(len(lists))]
            yield pa.record_batch([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, out_col])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField(out_col, BinaryType())]))


def ids_digest(ids: str = "ids"):
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
