"""Corpus pipeline: five operators, each on all that the one before has kept.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> PII pseudonyms -> byte-level BPE.
All stages but the last return the columns of ``documents``; the last returns a document's ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.llm import bpe, decontam, ngram_join, pii, quality
from pvspark.llm.common import importable, read_table, written
from pvspark.llm.queries import DEMO_KEY, split_pattern, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones.

    Every row is scored by its whole text, a null text as the empty one; repeated rows and null ids are kept or go
    like any other. Further columns are carried along. An empty table stays empty.
    """
    importable(spark)
    return quality.keep_quality(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: its first row in the table's order.

    Rows are told apart by their place in the table, not by doc_id, which may be null or repeated.
    Places are written once: another scan may cut the files otherwise and number its rows anew. Texts
    are only streamed past the hashed places to keep. Of repeated rows one stays; null, empty and blank texts are
    linked with nothing and all stay. Further columns are carried along, whatever their names. An empty table
    stays empty.
    """
    importable(spark)
    place = "_place"
    while place in {c.lower() for c in docs.columns}:
        place += "_"
    placed = written(docs.withColumn(place, F.monotonically_increasing_id()), "placed")
    groups = ngram_join.ngram_jaccard_join(placed, id_col=place)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(place))
    return placed.join(kept.hint("shuffle_hash"), place, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none; repeated rows and null ids are kept or go like any other, and an empty
    benchmark keeps all. Further columns are carried along. An empty table stays empty.
    """
    importable(spark)
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms; n_chars follows the new text.

    Every row stays; a null text stays null, and an empty one empty. Further columns are carried along. An
    empty table stays empty.
    """
    importable(spark)
    out = pii.pseudonymize_documents(docs, DEMO_KEY, count=False)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (array of int), n_tokens, and the digests of the ids and of their decoded bytes.

    Every row stays, also null and repeated ids; a null or empty text has no ids. Other columns end here. An empty
    table gives an empty result.
    """
    importable(spark)
    path, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), split_pattern()
    decoded = bpe.decode_ids(bpe.encode_documents(docs, path, pattern), path, pattern)
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                          bpe.ids_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("byte-level BPE", token_stage),
]

# A fitted classifier, keyed permutations and BPE merges are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
