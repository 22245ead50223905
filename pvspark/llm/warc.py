"""WARC archives in zstandard: a dictionary in front, a frame a record.

An archive starts with a skippable frame that holds the zstandard dictionary; each record behind it is a
frame of its own. The reader walks the frames by their headers, loads the dictionary, decodes a frame at
a time and validates each record: version, header lines, mandatory fields, length of the block, its end,
and the digests that the record names. What is wrong with a record is told in its ``error``.

Records of equal payloads are written once as response, that of the smallest page_id, and else as revisit.
Equal payloads meet in one task by their digest; digests of so many rows that they would fill a task are few,
and their revisits, which need no payload, are dealt out apart from it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.llm.common import shuffle_partitions, written
from pvspark.session import checkpoint_dir

ARCHIVE_BYTES = 16 << 20     # an archive is closed beyond so many compressed bytes
SAMPLE_PAGES = 512           # the dictionary is trained on so many pages at most,
SAMPLE_CHARS = 1 << 14       # on so many characters of each
DICTIONARY_BYTES = 1 << 16
HOT_ROWS = 1000              # digests of fewer rows never count as hot
DATE = "2000-01-01T00:00:00Z"  # the tables have no time of capture

# The formats' numbers and names.
_DICTIONARY_FRAME = 0x184D2A5D
_SKIPPABLE = range(0x184D2A50, 0x184D2A60)
_FRAME = 0xFD2FB528
_VERSIONS = (b"WARC/1.0", b"WARC/1.1")
_MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
_TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*?)[ \t]*", re.DOTALL)
_PAGE, _REFERS_TO_PAGE = "X-Page-Id", "X-Refers-To-Page-Id"
_RECORDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-records")


def digest_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing ---------------------------------------------------------------------------------------------------

def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Block-Digest", digest_of(block)), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers + lines)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _page_record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, is_response: bool, place: str) -> bytes:
    """The record of a page; a response's id follows from its payload, a revisit's from its place."""
    first = f"<urn:uuid:{uuid.uuid5(_RECORDS, 'response ' + digest)}>"
    own = first if is_response else f"<urn:uuid:{uuid.uuid5(_RECORDS, 'revisit ' + place)}>"
    headers = [("WARC-Type", "response" if is_response else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if page_id is not None:
        headers.append((_PAGE, str(page_id)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if not is_response:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", first)]
        headers += [(_REFERS_TO_PAGE, str(refers_to))] if refers_to is not None else []
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record_bytes(headers, http + (payload if is_response else b""))


def trained_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples, or none where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """An archive in memory: the dictionary's frame, then a frame for each record."""

    def __init__(self, dictionary: bytes):
        import zstandard

        kind = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._compressor = zstandard.ZstdCompressor(level=3, dict_data=kind, write_checksum=True, write_content_size=True)
        self._out, self.records = io.BytesIO(), 0
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self._out.write(struct.pack("<II", _DICTIONARY_FRAME, len(packed)) + packed)

    def add(self, record: bytes) -> int:
        """Bytes of the archive behind the record."""
        self._out.write(self._compressor.compress(record))
        self.records += 1
        return self._out.tell()

    def bytes(self) -> bytes:
        return self._out.getvalue()


def _store(folder: str):
    """File system and path of a folder that all tasks reach."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    scheme, _, rest = folder.partition(":")
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{'//' + rest.lstrip('/') if scheme != 'file' else '///' + rest.lstrip('/')}")


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a whole file under its name at once, so that a repeated task leaves one file."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` into archives below ``folder``; (name, records, bytes) of each archive.

    The payload is the page in UTF-8; null counts as empty, and empty payloads are equal ones. Of equal
    payloads the row with the smallest page_id is the response (null ids last, then by url); others are
    revisits of it. A null url has no target URI; characters that a URI can't hold are percent-encoded. A row's
    whole payload is in memory, and an archive of ``archive_bytes`` and one record at most. ``folder`` must be
    shared by driver and executors. Archives have fixed names and appear whole, so a repeated task leaves
    the same files. Rows that repeat both page_id and payload stay together in one task. An empty table
    gives no archive; other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    sample = rows.select(F.substring("payload", 1, SAMPLE_CHARS).alias("x")).limit(SAMPLE_PAGES).collect()
    dictionary = spark.sparkContext.broadcast(trained_dictionary([bytes(r["x"]) for r in sample if r["x"]]))

    p = shuffle_partitions(spark)
    rows = rows.select("page_id", "url", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("size"),
                       "payload")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("least"))
    groups = written(groups.where("n > 1"), "equal-payloads")
    # Digests of more than a share of the rows: four a partition at most, so few enough to send to every task.
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") > F.lit(max(HOT_ROWS, total // (4 * p)))).withColumn("hot", F.lit(True))
    spread = (rows.join(F.broadcast(hot.select("digest", "least", "hot")), "digest", "left")
              .withColumn("apart", F.coalesce(F.col("hot") & ~F.col("least").eqNullSafe(F.col("page_id")), F.lit(False)))
              .withColumn("payload", F.when(~F.col("apart"), F.col("payload")))
              .withColumn("lane", F.when(F.col("apart"), F.xxhash64("page_id", "url")).otherwise(0)))
    dealt = (spread.repartition(p, "digest", "lane")
             .sortWithinPartitions("digest", "lane", F.asc_nulls_last("page_id"), "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, archive, at = TaskContext.get().partitionId(), 0, None, 0
        digest = least = None

        def closed() -> pa.RecordBatch:
            name, data = f"pages-{part:05d}-{made:05d}.warc.zst", archive.bytes()
            _put(folder, name, data)
            return pa.record_batch([pa.array([name]), pa.array([archive.records], pa.int64()),
                                    pa.array([len(data)], pa.int64())], names=["name", "records", "bytes"])

        for b in batches:
            for page_id, url, of, size, payload, apart, known in zip(
                    *(b.column(c) for c in ("page_id", "url", "digest", "size", "payload", "apart", "least")), strict=True):
                page_id, of = page_id.as_py(), of.as_py()
                is_response = not apart.as_py() and of != digest
                if is_response:
                    digest, least = of, page_id
                archive = archive or ArchiveWriter(dictionary.value)
                record = _page_record(page_id, url.as_py(), payload.as_py(), size.as_py(), base64.b32encode(of).decode(),
                                      known.as_py() if apart.as_py() else least, is_response, f"{part} {at}")
                at += 1
                if archive.add(record) >= archive_bytes:
                    yield closed()
                    made, archive = made + 1, None
        if archive:
            yield closed()

    return written(dealt.select("page_id", "url", "digest", "size", "payload", "apart", "least")
                   .mapInArrow(run, "name string, records long, bytes long"), "archives")


# --- reading ---------------------------------------------------------------------------------------------------

def frames(data) -> Iterator[tuple[int, int, int]]:
    """(magic number, start, end) of each frame of an archive; ValueError where one is damaged."""
    at, size = 0, len(data)

    def need(n: int) -> None:
        if at + n > size:
            raise ValueError("the archive ends inside a frame")

    while at < size:
        start = at
        need(5)
        magic = int.from_bytes(data[at:at + 4], "little")
        if magic in _SKIPPABLE:
            need(8)
            at += 8 + int.from_bytes(data[at + 4:at + 8], "little")
            need(0)
        elif magic == _FRAME:
            flags = data[at + 4]
            single = flags >> 5 & 1
            at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
            last = False
            while not last:
                need(3)
                block = int.from_bytes(data[at:at + 3], "little")
                last, kind = bool(block & 1), block >> 1 & 3
                if kind == 3:
                    raise ValueError("reserved block type")
                at += 3 + (1 if kind == 1 else block >> 3)
            at += 4 * (flags >> 2 & 1)
            need(0)
        else:
            raise ValueError("not a zstandard frame")
        yield magic, start, at


def load_dictionary(content: bytes) -> bytes:
    """The dictionary of a skippable frame, which may be a zstandard frame itself."""
    import zstandard

    if content[:4] == struct.pack("<I", _FRAME):
        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return content


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block, of a whole record; ValueError where it is malformed."""
    head, found, rest = record.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("the headers have no end")
    version, *lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if version not in _VERSIONS:
        raise ValueError("unknown version")
    fields: dict[str, str] = {}
    for line in lines:
        m = _FIELD.fullmatch(line)
        if m is None:
            raise ValueError("malformed header line")
        name = m[1].decode().lower()
        if name in fields and name != "warc-concurrent-to":
            raise ValueError(f"repeated field {name}")
        fields[name] = m[2].decode("utf-8", "replace")
    for name in _MANDATORY:
        if not fields.get(name):
            raise ValueError(f"missing field {name}")
    if not re.fullmatch("[0-9]+", fields["content-length"]):
        raise ValueError("malformed length")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the block has another length than its header says")
    if fields["warc-type"] not in _TYPES:
        raise ValueError("unknown record type")
    block = rest[:n]
    claimed = fields.get("warc-block-digest")
    if claimed is not None and claimed.startswith("sha1:") and claimed.upper() != digest_of(block).upper():
        raise ValueError("the block has another digest than its header says")
    return fields, block


def http_payload(fields: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """Payload of a record, and the length that its HTTP headers tell (its own where they tell none)."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("the HTTP headers have no end")
    told = re.search(rb"(?mi)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", head)
    return payload, int(told[1]) if told else len(payload)


@functools.cache
def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


_RECORD = pa.schema([("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                     ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
                     ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("error", pa.string())])


def _long(text: str | None) -> int | None:
    return int(text) if text is not None else None


def archive_records(data) -> Iterator[dict]:
    """The records of an archive in order; the one at which it can't be read further has an error and is the last."""
    import zstandard

    dictionary = b""
    at = 0
    try:
        for magic, start, end in frames(data):
            at = end
            if magic != _FRAME:
                if magic == _DICTIONARY_FRAME and start == 0:
                    dictionary = load_dictionary(bytes(data[start + 8:end]))
                continue
            out = dict.fromkeys(_RECORD.names) | {"offset": start}
            try:
                fields, block = parse_record(_decompressor(dictionary).decompressobj().decompress(data[start:end]))
                payload, told = http_payload(fields, block)
                digest = fields.get("warc-payload-digest") or digest_of(payload)
                whole = fields["warc-type"] == "response"
                out |= {"record_type": fields["warc-type"], "record_id": fields["warc-record-id"],
                        "target_uri": fields.get("warc-target-uri"), "page_id": _long(fields.get(_PAGE.lower())),
                        "refers_to": _long(fields.get(_REFERS_TO_PAGE.lower())), "payload": payload if whole else None,
                        "payload_bytes": told, "payload_digest": digest.removeprefix("sha1:")}
                if whole and told != len(payload):
                    raise ValueError("the payload has another length than its header says")
                if whole and digest.startswith("sha1:") and digest.upper() != digest_of(payload).upper():
                    raise ValueError("the payload has another digest than its header says")
            except (ValueError, zstandard.ZstdError) as problem:
                out["error"] = str(problem)
            yield out
    except (ValueError, zstandard.ZstdError) as problem:
        yield dict.fromkeys(_RECORD.names) | {"offset": at, "error": str(problem)}


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives ``*.warc.zst`` below ``folder``: archive, offset, record_type, record_id, target_uri,
    page_id, refers_to, payload (of responses), payload_bytes and payload_digest (also of revisits), error.

    Null ``error`` means that the record passed. A damaged record keeps its row; behind a damaged frame
    nothing of that archive can be read, and its last row says so. An archive is in memory as a whole, its
    records one by one. A folder without archives gives an empty result.
    """
    names = [n for n in _RECORD.names if with_payload or n != "payload"]
    schema = pa.schema([("archive", pa.string()), *(_RECORD.field(n) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                held, size = [], 0
                for r in archive_records(memoryview(content.as_buffer())):
                    size += len(r["payload"] or b"") if with_payload else 0
                    held.append({n: r[n] for n in names} | {"archive": path.as_py()})
                    if size >= 1 << 23 or len(held) >= 1000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true")
            .load(folder).select("path", "content")
            .mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
