import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pvspark.operators import features as FE
from pvspark.operators import profile as P
from pvspark.operators import registry as REG
from pvspark.sources import sites as SI

SITE = ("site-a", 10.0, 20.0, "Africa/Dar_es_Salaam", 5.0, 15.0, 180.0)


def _sites(spark, rows):
    return spark.createDataFrame(rows, SI.SITE_SCHEMA)


def test_site_rules(spark):
    bad = [SITE, (" ", 95.0, 20.0, "Mars/Olympus", 0.0, 91.0, 180.0)]
    got = {(r["field"], r["problem"]) for r in SI.site_issues(_sites(spark, bad)).collect()}
    assert got == {("site_id", "must be a non-empty string"), ("latitude", "must be between -90 and 90"),
                   ("timezone", "must be a valid IANA timezone"), ("installed_capacity_kwp", "must be greater than 0"),
                   ("panel_tilt_degrees", "must be between 0 and 90")}


def test_unknown_key_rejected(spark):
    df = _sites(spark, [SITE]).withColumn("colour", F.lit("blue"))
    assert [r["field"] for r in SI.site_issues(df).collect()] == ["colour"]


def test_registry_duplicates_and_dataset_match(spark):
    s = _sites(spark, [SITE, SITE, ("site-b",) + SITE[1:]])
    assert [r["site_id"] for r in SI.registry_issues(s).collect()] == ["site-a"]
    ds = spark.createDataFrame([("site-a",), ("site-c",)], "site_id string")
    got = {(r["site_id"], r["problem"]) for r in SI.dataset_site_match(ds, s).collect()}
    assert got == {("site-c", "missing_site_configuration"), ("site-b", "unused_site_configuration")}
    assert {r["site_id"] for r in SI.dataset_site_match(ds, s, allow_unused=True).collect()} == {"site-c"}


def test_file_checksums(spark, tmp_path):
    p = tmp_path / "a.bin"
    p.write_bytes(b"hello world")
    r = REG.file_checksums(spark, str(tmp_path / "*.bin")).first()
    assert r["sha256"] == hashlib.sha256(b"hello world").hexdigest() and r["bytes"] == 11


def _noise(n):
    return random.Random(n).randbytes(n)


@pytest.mark.parametrize("content", [
    _noise(50_000), _noise(50_000) + b"\n", b"\n" + _noise(40_000) + b"\n\n", b"\xef\xbb\xbf" + _noise(30_000),
    b"\xef\xbb\xbf" + _noise(30_000) + b"\n", b"a\r\nb\r" * 5_000, b"\0" * 30_000, b"\n" * 30_000,
    b"\0" * 9_000 + _noise(9_000) + b"\xff" * 9_000], ids=range(9))
def test_checksum_of_a_large_file_is_handed_from_task_to_task(spark, tmp_path, monkeypatch, content):
    read = []
    monkeypatch.setattr(REG, "WHOLE_FILE_BYTES", 1000)
    monkeypatch.setattr(REG, "_sha256_of_lines", lambda *a, f=REG._sha256_of_lines: read.append(a) or f(*a))
    (tmp_path / "large [1].bin").write_bytes(content)
    (tmp_path / "small.bin").write_bytes(b"x")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["file_name"]: (r["bytes"], r["sha256"]) for r in REG.file_checksums(spark, str(tmp_path / "*.bin")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in (("large [1].bin", content), ("small.bin", b"x"))}
    assert len(read) >= len(content) // 4096  # a task a split


def test_checksum_of_a_large_file_that_text_readers_unpack(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(REG, "WHOLE_FILE_BYTES", 10)
    (tmp_path / "a.gz").write_bytes(b"no gzip, but longer")
    r = REG.file_checksums(spark, str(tmp_path / "*")).first()
    assert r["sha256"] == hashlib.sha256(b"no gzip, but longer").hexdigest()


def test_weather_summary_all_null_column(spark):
    df = spark.createDataFrame([("a", datetime(2025, 1, 1), 1.0, 5.0, None)],
                               "site_id string, timestamp timestamp, ac_energy_kwh double, ghi_w_m2 double, dni_w_m2 double")
    s = {r["column"]: r for r in P.weather_summary(df).collect()}
    assert s["dni_w_m2"]["count"] is None and s["dni_w_m2"]["mean"] is None
    assert s["ghi_w_m2"]["count"] == 1 and s["ghi_w_m2"]["standard_deviation"] == 0.0


def test_feature_quality_and_manifest(spark):
    df = spark.createDataFrame([("a", datetime(2025, 1, 1, h), float(h), 5.0 if h else None, "train" if h < 3 else "test",
                                 h > 0) for h in range(5)],
                               "site_id string, timestamp timestamp, ac_energy_kwh double, ghi_w_m2 double, split string, "
                               "feature_eligible boolean")
    c = FE.FeatureContract(("timestamp", "site_id"), "ac_energy_kwh", ("ghi_w_m2",), (), (), ("ghi_w_m2",))
    q = FE.feature_quality(df, c).first()
    assert (q["feature"], q["missing_count"], q["is_constant"], q["feature_group"]) == ("ghi_w_m2", 1, True, "raw")
    m = FE.feature_manifest(df, c, only_eligible=True).first()
    assert (m["source_row_count"], m["output_row_count"], m["excluded_row_count"], m["train_rows"]) == (5, 4, 1, 3)
