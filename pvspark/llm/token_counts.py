"""Token counts of a tokenizers file without materialising ids.

Tokens of a byte-level BPE never cross a pre-token, so a text's count is the sum over its pre-tokens.
1. All texts are split; the distinct pre-tokens of the corpus, with their frequencies, are a grouped
   table (each task sends a pre-token once for many occurrences).
2. The tokenizer counts the pieces of each distinct pre-token once.
3. Texts are split again and joined to the counts: the most frequent pre-tokens, of bounded number and
   length, are broadcast; the rest are joined by a shuffle, one row for each text and pre-token.
4. The products of frequency and pieces are summed by row of the input.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import id_and_text, written
from pvspark.llm.pretoken import pre_tokens

# Bound of the broadcast: so many pre-tokens of so many characters at most.
FREQUENT = 1 << 18
FREQUENT_CHARS = 48
# Distinct pre-tokens (and their characters) that a task holds before it sends them.
HELD = 300_000
HELD_CHARS = 1 << 25

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The file's tokenizer, loaded once a worker; Spark gives the parallelism."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


class Splitter:
    """Pre-tokens of a text, and the number of added tokens that stand between them."""

    def __init__(self, path: str):
        import re

        t = tokenizer(path)
        if type(t.model).__name__ != "BPE" or type(t.pre_tokenizer).__name__ != "ByteLevel" or t.normalizer is not None:
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        self._general = lambda s: [s[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(s)]
        added = sorted((a.content for a in t.get_added_tokens_decoder().values()), key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, added))) if added else None

    def __call__(self, text: str) -> tuple[list[str], int]:
        if self._added is None or not self._added.search(text):
            return pre_tokens(text, self._general), 0
        parts = self._added.split(text)
        return [p for part in parts if part for p in pre_tokens(part, self._general)], len(parts) - 1


def _pre_token_table(docs: DataFrame, path: str) -> DataFrame:
    """(piece, freq) over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, chars = Splitter(path), Counter(), 0

        def sent() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held)), pa.array(list(held.values()), pa.int64())],
                                   names=["piece", "freq"])

        for b in batches:
            for text in b.column("text"):
                text = text.as_py()
                held.update(split(text)[0])
                chars += len(text)
                if len(held) > HELD or chars > HELD_CHARS:
                    yield sent()
                    held, chars = Counter(), 0
        if held:
            yield sent()

    return docs.select("text").mapInArrow(run, "piece string, freq long").groupBy("piece").agg(
        F.sum("freq").alias("freq"))


def _pieces(table: DataFrame, path: str) -> DataFrame:
    """The table with n_pieces: the tokens of each distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for s in range(0, len(b), 2000):
                part = b.slice(s, 2000)
                n = [len(e.ids) for e in t.encode_batch_fast(part.column("piece").to_pylist(), add_special_tokens=False)]
                yield pa.record_batch([*part.columns, pa.array(n, pa.int64())], names=["piece", "freq", "n_pieces"])

    return table.mapInArrow(run, "piece string, freq long, n_pieces long")


def token_counts(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) for each row of ``documents``.

    ``path`` is a tokenizers file of a byte-level BPE. Added tokens inside a text count one each, as
    the library has it; none are added. A null text counts as empty: 0 and 0. Null and repeated ids
    are kept, row by row. An empty table gives an empty result; other columns are not read.
    """
    docs = id_and_text(documents, id_col, text_col)
    table = written(_pieces(_pre_token_table(docs, path), path), "pre-tokens")
    top = (table.where(F.char_length("piece") <= FREQUENT_CHARS).orderBy(F.col("freq").desc(), "piece")
           .limit(FREQUENT).select("piece", "n_pieces").toArrow())
    known = docs.sparkSession.sparkContext.broadcast(
        dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces_of = Splitter(path), known.value.get
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[list] = [[] for _ in range(6)]

            def put(*values, out=out):
                for col, v in zip(out, values, strict=True):
                    col.append(v)

            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                text = text.as_py()
                pieces, n = split(text)
                counts = list(map(pieces_of, pieces))
                if None in counts:
                    for piece, freq in Counter(p for p, c in zip(pieces, counts, strict=True) if c is None).items():
                        put(row, None, None, None, piece, freq)
                    n += sum(c for c in counts if c is not None)
                else:
                    n += sum(counts)
                put(row, doc_id.as_py(), len(text.encode()), n, None, None)
                row += 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 4, pa.string(), pa.int64()),
                                                                   strict=True)],
                                  names=["row", "doc_id", "n_bytes", "known", "piece", "n"])

    rows = docs.mapInArrow(run, "row long, doc_id long, n_bytes long, known long, piece string, n long")
    # rows without a piece carry the document; a key of their own keeps them apart in the join
    rows = rows.withColumn("key", F.coalesce("piece", F.col("row").cast("string")))
    rest = table.select(F.col("piece").alias("key"), "n_pieces")
    joined = rows.join(rest, "key", "left")
    tokens = F.when(F.col("piece").isNull(), F.col("known")).otherwise(F.col("n") * F.col("n_pieces"))
    return (joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                      F.sum(tokens).alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
