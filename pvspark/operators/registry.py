"""Champion / challenger registry state (W15) and checksums of files and models.

The registry is an append-only event table ``(model_version, objective, action, seq, artifact_verified,
selection_based_on_validation)`` whose ``seq`` tells all events apart.  Whether an event is accepted depends on
the state that the accepted events before it have led to:

- a version is registered once, with a verified artifact, under the objective named there;
- a promotion needs a validation-based selection, a known version that is candidate or champion, and a
  verified artifact; it archives the champion of the version's objective;
- an archived version stays archived.

An archived version never returns, so the fold over the events has a closed form without one: the first
promotion of a version that meets the rules always stands, and begins its reign; the reign ends with the
next one of its objective or with the version's own archiving, and a later promotion stands within the
reign only.  Windows run over registrations and reigns, two rows a version, not over events.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("register", "promote", "archive")
# Messages of refused events.
REGISTERED = "model version already registered"
UNVERIFIED = "model artifact verification failed"
NOT_VALIDATION = "promotion must be based on validation selection"
UNKNOWN = "unknown model version"
NOT_CANDIDATE = "only a complete candidate can be promoted"
UNKNOWN_ACTION = "unknown action"


def _versions(events: DataFrame) -> DataFrame:
    """One row a registered version: objective, ``since``, ``up`` (its reign's begin), ``down`` (its end), ``gone``
    (its own archiving), as sequence numbers."""
    verified = F.coalesce("artifact_verified", F.lit(False))
    first = events.where((F.col("action") == "register") & verified).groupBy("model_version").agg(
        F.min("seq").alias("since"), F.min_by("objective", "seq").alias("objective"))
    later = events.drop("objective").join(first, "model_version").where(F.col("seq") > F.col("since"))
    chosen = (F.col("action") == "promote") & verified & F.coalesce("selection_based_on_validation", F.lit(False))
    moves = later.groupBy("model_version").agg(F.min(F.when(F.col("action") == "archive", F.col("seq"))).alias("gone"),
                                               F.min(F.when(chosen, F.col("seq"))).alias("up"))
    known = first.join(moves, "model_version", "left").withColumn(
        "up", F.when(F.col("gone").isNull() | (F.col("up") < F.col("gone")), F.col("up")))
    reigns = known.where(F.col("up").isNotNull()).select(
        "model_version", F.lead("up").over(Window.partitionBy("objective").orderBy("up")).alias("next"))
    return known.join(reigns, "model_version", "left").withColumn("down", F.least("next", "gone")).drop("next")


def registry_decisions(events: DataFrame) -> DataFrame:
    """Every event with ``problem``, why it was refused; null where it was accepted."""
    verified, selected = (F.coalesce(c, F.lit(False)) for c in ("artifact_verified", "selection_based_on_validation"))
    versions = _versions(events).select("model_version", "since", "gone", "down")
    known = F.col("since").isNotNull() & (F.col("since") < F.col("seq"))
    ended = F.coalesce(F.least("gone", "down") < F.col("seq"), F.lit(False))
    problem = (F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), UNKNOWN_ACTION)
               .when((F.col("action") == "register") & known, REGISTERED)
               .when((F.col("action") == "register") & ~verified, UNVERIFIED)
               .when((F.col("action") == "promote") & ~selected, NOT_VALIDATION)
               .when((F.col("action") != "register") & ~known, UNKNOWN)
               .when((F.col("action") == "promote") & ended, NOT_CANDIDATE)
               .when((F.col("action") == "promote") & ~verified, UNVERIFIED))
    return events.join(versions, "model_version", "left").select(*events.columns, problem.alias("problem"))


def registry_issues(events: DataFrame) -> DataFrame:
    """The refused events: seq, model_version, action, problem."""
    return registry_decisions(events).where(F.col("problem").isNotNull()).select("seq", "model_version", "action", "problem")


def registry_state(events: DataFrame) -> DataFrame:
    """Current status of each registered version; refused events change nothing.

    ``previous_champion_version`` is the champion of the objective when the version was registered.
    """
    versions = _versions(events)
    crowned = versions.where(F.col("up").isNotNull()).select(
        "objective", F.col("up").alias("at"), F.struct("model_version", "down").alias("reign"), F.lit(None).alias("registered"))
    entered = versions.select("objective", F.col("since").alias("at"), F.lit(None).alias("reign"),
                              F.col("model_version").alias("registered"))
    last = F.last("reign", ignorenulls=True).over(
        Window.partitionBy("objective").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    held = F.col("reign")["down"].isNull() | (F.col("reign")["down"] > F.col("at"))
    previous = (crowned.unionByName(entered).withColumn("reign", last).where(F.col("registered").isNotNull())
                .select(F.col("registered").alias("model_version"),
                        F.when(held, F.col("reign")["model_version"]).alias("previous_champion_version")))
    status = (F.when(F.col("gone").isNotNull() | F.col("down").isNotNull(), "archived")
              .when(F.col("up").isNotNull(), "champion").otherwise("candidate"))
    return versions.join(previous, "model_version").select("model_version", "objective", status.alias("status"),
                                                           "previous_champion_version")


# Files up to this size are hashed as one ``binaryFile`` row, larger ones split by split.
WHOLE_FILE_BYTES = 256 << 20
# Suffixes whose files Spark's text reader would unpack, so that they can only be read whole.
UNPACKED = (".bz2", ".deflate", ".gz", ".lz4", ".snappy", ".zst")
_BOM = b"\xef\xbb\xbf"


def file_checksums(spark, path_glob: str) -> DataFrame:
    """SHA-256 and size of every file matching ``path_glob`` (one row per
    file; contents are hashed inside the tasks that read them).

    SHA-256 is a chain through a file's bytes, but its state is small: a file above ``WHOLE_FILE_BYTES`` is
    hashed split by split, each by a task that takes up the state the one before it left."""
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name")

    def whole(files: DataFrame) -> DataFrame:
        return files.select(name, F.col("length").alias("bytes"), F.sha2(F.col("content"), 256).alias("sha256"))

    sha256 = _resumable_sha256()
    files = spark.read.format("binaryFile").load(path_glob)
    large = files.where(F.col("length") > WHOLE_FILE_BYTES).select("path", "length").collect() if sha256 else []
    if not large:
        return whole(files)
    out = whole(files.where(F.col("length") <= WHOLE_FILE_BYTES))  # by the listing: the others are not read
    packed = [_escaped(r["path"]) for r in large if r["path"].endswith(UNPACKED)]
    if packed:
        out = out.unionByName(whole(spark.read.format("binaryFile").load(packed)))
    chained = [(r["path"], r["length"]) for r in large if not r["path"].endswith(UNPACKED)]
    if not chained:
        return out
    with ThreadPoolExecutor(max_workers=min(len(chained), spark.sparkContext.defaultParallelism)) as pool:
        digests = list(pool.map(lambda f: _chained_sha256(spark, *f, *sha256), chained))
    rows = [(*f, digest) for f, digest in zip(chained, digests, strict=True)]
    return out.unionByName(spark.createDataFrame(rows, "path string, bytes long, sha256 string").select(name, "bytes", "sha256"))


def _escaped(path: str) -> str:
    """The path as a pattern that matches it alone."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _chained_sha256(spark, path: str, size: int, update, final) -> str:
    """SHA-256 of one file, its splits read in their order by one task each.

    Spark's text reader deals a file out by byte ranges; its lines, joined by the separator again, are the file's
    bytes but for a separator at the end and a byte order mark at the start, which the file's size tells."""
    lines = spark.read.option("lineSep", "\n").text(_escaped(path)).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("start"))
    for head in (b"", _BOM):
        state, seen, at = update(None, head), None, -1
        for k in range(lines.rdd.getNumPartitions()):
            step = lines.mapInArrow(_sha256_of_lines(update, state, seen is not None), "state binary, seen long, first long, last long")
            for r in spark.sparkContext.runJob(step.rdd, list, [k]):  # no row where the split lies within one line
                if not at < r["first"] <= r["last"]:
                    raise RuntimeError(f"the splits of {path} are not read in their order")
                state, seen, at = bytes(r["state"]), (seen or 0) + r["seen"], r["last"]
        left = size - len(head) - (seen or 0)
        if left in (0, 1):
            return final(update(state, b"\n" * left))
    raise RuntimeError(f"{path} has {size} bytes, {seen} were read")


def _sha256_of_lines(update, state: bytes, begun: bool):
    """For ``mapInArrow``: the state after the lines of a split, how many bytes they are, and where they lie."""
    def run(batches):
        after, seen, starts, joint = state, 0, [], begun
        for batch in batches:
            if batch.num_rows:
                text = (b"\n" if joint else b"") + b"\n".join(batch.column(0).to_pylist())
                after, seen, joint = update(after, text), seen + len(text), True
                starts += [pc.min(batch.column(1)).as_py(), pc.max(batch.column(1)).as_py()]
        if starts:
            yield pa.RecordBatch.from_pydict({"state": [after], "seen": [seen], "first": [min(starts)], "last": [max(starts)]})
    return run


def _resumable_sha256():
    """``update`` and ``final`` of OpenSSL's SHA-256, the one behind ``hashlib``, with a state that can be passed on:
    its SHA256_CTX, 112 bytes of plain memory (None begins).  None where the library is not at hand.

    Both are local functions, so that Python workers get them whole and need not import this package."""
    def library():
        import _hashlib
        return ctypes.CDLL(_hashlib.__file__)

    def update(state: bytes | None, data: bytes) -> bytes:
        openssl, context = library(), ctypes.create_string_buffer(state or b"", 112)
        if state is None:
            openssl.SHA256_Init(context)
        openssl.SHA256_Update(context, data, ctypes.c_size_t(len(data)))
        return context.raw

    def final(state: bytes) -> str:
        digest = ctypes.create_string_buffer(32)
        library().SHA256_Final(digest, ctypes.create_string_buffer(state, 112))
        return digest.raw.hex()

    try:
        works = final(update(update(None, b"a"), b"bc")) == hashlib.sha256(b"abc").hexdigest()
    except (ImportError, AttributeError, OSError):
        works = False
    return (update, final) if works else None


def artifact_checksum(spark, path: str) -> DataFrame:
    """One row for a saved model: ``files``, ``bytes`` and the SHA-256 over its files' names and digests in
    the order of their names (a model's size, not the data's)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.regexp_replace("path", r"^.*?/(metadata|stages)/", "$1/").alias("name"), F.col("length").alias("bytes"),
        F.sha2(F.col("content"), 256).alias("sha256"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda f: F.concat_ws(":", f["name"], f["sha256"]))
    return files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"),
                     F.sha2(F.array_join(listed, "\n"), 256).alias("sha256"))


def verify_artifact(spark, path: str, sha256: str) -> None:
    """Raise unless the saved model at ``path`` still has the digest that was recorded for it."""
    if artifact_checksum(spark, path).first()["sha256"] != sha256:
        raise ValueError(f"{UNVERIFIED}: {path}")
