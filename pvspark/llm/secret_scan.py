"""Secret scans: fixed patterns, and strings that stay incompressible next to what surrounds them.

Beside the patterns, a candidate is any token of ten characters or more with a letter in it and a sensitive
word in its surroundings, on either side and over line breaks, or the body of a PEM private key. Its
novelty is the number of bytes that it adds to the zstandard frame of its surroundings, with a compressor
primed by a dictionary: words that recur in the texts of the corpus, and words of code. Names, paths and
words of the corpus add a few bytes a word; random keys add nearly a byte a character, since a frame this
short gives their characters no short codes.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import id_and_text

KINDS = ("assign", "access", "hex", "novel")

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20

_CONTEXT = re.compile(
    r"(?:passw(?:or)?d|passphrase|secret|token|api[\s_-]?key|access[\s_-]?key|private[\s_-]?key|credential|authorization"
    r"|bearer|signature|client[\s_-]?id|webhook|connection[\s_-]?string)", re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{10,}")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----\s*(?P<body>(?:[^-]|-(?!----))+?)\s*-----END ", re.ASCII)
AROUND = 400        # characters of surroundings that hold the sensitive word and prime the measure
NOVEL_BYTES = 12    # marginal bytes from which a candidate is reported,
NOVEL_SHARE = 0.88  # also as a share of its characters;
LONG, LONG_SHARE = 64, 0.68  # longer candidates have characters enough to get codes of six bits
SHARED_WORDS = 4000  # most frequent words that prime the compressor: each in
SHARED_TEXTS = 3     # so many different texts at least,
SHARED_SHARE = 3 / 512  # and in this share of all

# Words of code that prime the compressor, beside those of the corpus.
_IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key public_key credential username "
    "authorization bearer signature client_id client_secret webhook connection_string session_id user_id request "
    "response configuration environment variable default example placeholder changeme your_secret_here undefined "
    "function return import export class public private static const string integer boolean null true false none "
    "self this value name path file index count length size type error exception message callback handler service "
    "controller repository manager factory builder provider context application database transaction module version "
    "server node project build release deploy pipeline package component interface model view schema query filter "
    "sort group limit offset cursor record entry item list map set queue stack cache buffer stream reader writer parser "
    "format encode decode encrypt decrypt hash digest certificate license checksum timestamp address account customer "
    "order payment product price report task worker thread process event channel client cluster instance resource "
    "storage bucket object folder document page template layout widget button window color image level state status "
    "mode option parameter setting property attribute element tree graph edge matrix vector number double float long "
    "short byte enabled disabled required optional internal external primary secondary global local temp final "
    "abstract base common util helper wrapper adapter proxy listener observer iterator generator validator converter "
    "serializer scheduler executor monitor logger metric alert test main source target field column table row key "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 http https www com org net localhost xxxxxxxx")
_WORD = re.compile(r"[^\W\d_]{4,}")
_SPARK_WORD = r"[\p{L}\p{Nl}\p{No}]{4,}"  # the same in Spark's expressions


def _primer(shared: list[str]) -> bytes:
    """The compressor's dictionary: the shared words, most frequent first, turned round, and words of code: the most
    frequent ones and those of code are last, where they are nearest."""
    return " ".join([*reversed(shared), _IDENTIFIERS]).encode()


def dictionary(texts: list[str]) -> bytes:
    """The dictionary of a few texts at hand, each of them taken as different from the others."""
    seen = Counter(w for t in texts for w in set(_WORD.findall(t)))
    least = max(SHARED_TEXTS, SHARED_SHARE * len(texts))
    return _primer(sorted((w for w, n in seen.items() if n >= least), key=lambda w: (-seen[w], w))[:SHARED_WORDS])


def shared_words(rows: DataFrame) -> list[str]:
    """The words that the different texts of ``rows`` share, most frequent first, counted over every whole text.

    Copies count once: what is shuffled by text is its hash and its distinct words, joined in one string, since an
    array of them takes more than twice the disk. At most SHARED_WORDS words reach the driver."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(_SPARK_WORD), 0))
    words = rows.select(F.xxhash64("text").alias("hash"), F.array_join(found, " ").alias("words"))
    least = max(SHARED_TEXTS, SHARED_SHARE * words.select("hash").distinct().count())
    return [r["word"] for r in words.dropDuplicates(["hash"]).select(F.explode(F.split("words", " ")).alias("word"))
            .where("word <> ''").groupBy("word").count().where(F.col("count") >= least)
            .orderBy(F.desc("count"), "word").limit(SHARED_WORDS).collect()]


@functools.lru_cache(maxsize=4)
def _compressor(primer: bytes):
    import zstandard

    held = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=held, write_content_size=False, write_checksum=False)


def marginal_bytes(before: str, candidate: str, after: str, primer: bytes = _IDENTIFIERS.encode()) -> int:
    """Bytes by which the candidate lengthens the compressed surroundings."""
    c = _compressor(primer)
    return len(c.compress((before + candidate + after).encode())) - len(c.compress((before + after).encode()))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns' matches, in code points, by start, then kind."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _is_novel(text: str, start: int, end: int, primer: bytes) -> bool:
    s = text[start:end]
    if not any(c.isalpha() for c in s):
        return False  # a number
    added = marginal_bytes(text[max(0, start - AROUND):start], s, text[end:end + AROUND], primer)
    return added >= max(NOVEL_BYTES, (LONG_SHARE if len(s) > LONG else NOVEL_SHARE) * len(s))


def novel_spans(text: str, known: list[tuple[str, int, int]],
                primer: bytes = _IDENTIFIERS.encode()) -> list[tuple[str, int, int]]:
    """Incompressible strings in a sensitive context that no known span touches, and bodies of private keys."""
    words = [m.span() for m in _CONTEXT.finditer(text)]
    if not words:
        return []
    out = [("novel", *m.span("body")) for m in _PEM.finditer(text) if _is_novel(text, *m.span("body"), primer)]
    taken = sorted((a, b) for _, a, b in known + out)
    k = reach = 0  # taken spans before k start before the candidate's end; reach is the last of their ends
    last = -AROUND - 1
    for start, after in zip([0, *(b for _, b in words)], [*words, (len(text) + AROUND + 1, 0)], strict=True):
        for m in _CANDIDATE.finditer(text, start, min(after[0], len(text))):
            if m.start() - last > AROUND and after[0] - m.end() > AROUND:
                continue
            while k < len(taken) and taken[k][0] < m.end():
                reach = max(reach, taken[k][1])
                k += 1
            if reach <= m.start() and _is_novel(text, *m.span(), primer):
                out.append(("novel", *m.span()))
        last = after[1]
    return sorted(out, key=lambda s: s[1])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base_spans and spans (kind:start:end joined by commas), n_assign, n_access, n_hex, n_novel.

    Spans are code points with an exclusive end, ordered by start, then kind; ``spans`` holds the base
    ones and the novel ones. A null or empty text has none. Null and repeated ids are kept, row by
    row; an empty table gives an empty result; other columns are not read. The dictionary's words are
    counted over all whole texts, and every text is scanned whole.
    """
    rows = id_and_text(documents, id_col, text_col)
    primer = rows.sparkSession.sparkContext.broadcast(_primer(shared_words(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every, counts = [], [], []
            for t in b.column("text"):
                t = t.as_py()
                known = base_spans(t)
                novel = novel_spans(t, known, primer.value)
                both = sorted(known + novel, key=lambda s: (s[1], KINDS.index(s[0])))
                base.append(_joined(known))
                every.append(_joined(both))
                counts.append([sum(s[0] == k for s in both) for k in KINDS])
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.record_batch([b.column("doc_id"), pa.array(base, pa.string()), pa.array(every, pa.string()), *cols],
                                  names=["doc_id", "base_spans", "spans", *(f"n_{k}" for k in KINDS)])

    return rows.mapInArrow(
        run, "doc_id long, base_spans string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS))
