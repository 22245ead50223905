"""WARC archives: round trips through written files, and what a reader says of damaged ones."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard

from pvspark.llm import warc
from pvspark.llm.common import importable

CLASH = "page_id long, url string, html string, digest string, least string, n string, lane string, hot string, size string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    importable(spark)


def written_and_read(spark, folder, rows):
    table = spark.createDataFrame([(*r, *"abcdef") for r in rows], CLASH)
    made = warc.write_archives(table, folder).collect()
    return made, warc.read_archives(spark, folder).collect()


def expected(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for payload in {d for _, d in data}:
        ids = sorted((p for p, d in data if d == payload), key=lambda p: (p is None, p or 0))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(p, len(payload), digest, "revisit" if k else "response", ids[0] if k else None) for k, p in enumerate(ids)]
    return sorted(out, key=str)


PAGES = ([(i, f"http://x.org/{i}", f"<p>page {i} {'word ' * (i % 40)}</p>") for i in range(300)]
         + [(1000 + i, f"http://x.org/copy/{i}", "<p>copied</p>") for i in range(200)]
         + [(5, "http://x.org/5", "<p>copied</p>"), (1003, "http://x.org/copy/3", "<p>copied</p>"), (None, None, "<p>copied</p>"),
            (None, "u\r\nWARC-Type: x", "<p>only null</p>"), (None, None, "<p>only null</p>"), (2000, "é b", None),
            (2001, "", ""), (2002, None, "日本\r\n\r\nWARC/1.1\r\n" * 3), (2003, "http://x.org/long", "long " * 600_000)])


@pytest.mark.parametrize("hot,size", [(1000, 16 << 20), (20, 4000)])
def test_pages_come_back_as_responses_and_revisits(spark, monkeypatch, tmp_path, hot, size):
    monkeypatch.setattr(warc, "HOT_ROWS", hot)
    monkeypatch.setattr(warc.write_archives, "__defaults__", (*warc.write_archives.__defaults__[:-1], size))
    made, got = written_and_read(spark, f"file://{tmp_path}/a", PAGES)
    assert [r["error"] for r in got if r["error"]] == []
    assert sum(m["records"] for m in made) == len(PAGES) and len(made) == len(list((tmp_path / "a").iterdir()))
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=str) == expected(PAGES)
    texts = {(p, (h or "").encode()) for p, _, h in PAGES}
    assert all((r["page_id"], bytes(r["payload"])) in texts for r in got if r["record_type"] == "response")
    ids = [r["record_id"] for r in got]
    assert len(set(ids)) == len(ids)
    for f in (tmp_path / "a").iterdir():
        kinds = [magic for magic, _, _ in warc.frames(f.read_bytes())]
        assert kinds[0] == 0x184D2A5D and set(kinds[1:]) == {0xFD2FB528}


def test_pages_too_few_for_a_dictionary(spark, tmp_path):
    made, got = written_and_read(spark, str(tmp_path / "b"), [(1, "u", "one"), (2, "u", "one")])
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["error"]) for r in got) == [
        (1, "response", None, None), (2, "revisit", 1, None)]


def test_an_empty_table_has_no_records(spark, tmp_path):
    (tmp_path / "c").mkdir()
    made, got = written_and_read(spark, str(tmp_path / "c"), [])
    assert made == [] and got == []


def record(block=b"x", **changed):
    headers = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:1>", "WARC-Date": warc.DATE} | changed
    return warc.record_bytes([(k.replace("_", "-"), v) for k, v in headers.items() if v is not None], block)


def test_records_are_validated():
    fields, block = warc.parse_record(record(b"a\r\n\r\nb"))
    assert block == b"a\r\n\r\nb" and fields["warc-type"] == "resource"
    folded = record().replace(b"<urn:1>", b"<urn:1>\r\n  more")
    assert warc.parse_record(folded)[0]["warc-record-id"] == "<urn:1> more"
    good = record(b"body")
    for bad in (good[:-1], good + b"x", good.replace(b"Length: 4", b"Length: 5"), good.replace(b"Length: 4", b"Length: -4"),
                good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date:", b"WARC Date:"), good.replace(b"body", b"bady"),
                record(**{"WARC-Date": None}), record(**{"WARC-Type": "poem"}), b"", b"WARC/1.1\r\n",
                good.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


@pytest.mark.parametrize("packed", [True, False])
def test_dictionary_of_the_leading_frame(packed):
    words = [f"<p>{i} some words that pages share {i * 7}</p>".encode() for i in range(2000)]
    trained = zstandard.train_dictionary(2000, words)
    raw = trained.as_bytes()
    held = zstandard.ZstdCompressor().compress(raw) if packed else raw
    compress = zstandard.ZstdCompressor(dict_data=trained, write_content_size=False).compress
    data = struct.pack("<II", 0x184D2A5D, len(held)) + held + compress(record(b"one")) + compress(record(b"two" * 100_000))
    got = list(warc.archive_records(data))
    assert [r["error"] for r in got] == [None, None] and [r["payload_bytes"] for r in got] == [3, 300_000]


def test_damaged_archives_keep_what_can_be_read():
    compress = zstandard.ZstdCompressor(write_checksum=True).compress
    first, second, third = compress(record(b"one")), compress(record(b"two")[:-2]), compress(record(b"three"))
    got = list(warc.archive_records(first + second + third))
    assert [bool(r["error"]) for r in got] == [False, True, False] and got[2]["offset"] == len(first + second)
    for rest in (b"nonsense", third[:-3], struct.pack("<II", 0x184D2A50, 99)):
        got = list(warc.archive_records(first + rest))
        assert len(got) == 2 and got[0]["error"] is None and got[1]["error"]
    broken = bytearray(third)
    broken[len(broken) // 2] ^= 0xFF
    got = list(warc.archive_records(bytes(broken) + first))
    assert got[0]["error"]
    assert list(warc.archive_records(b"")) == []


def test_frames_agree_with_the_library():
    out = io.BytesIO()
    sizes = []
    for i, n in enumerate((0, 1, 200, 70_000, 900_000)):
        c = zstandard.ZstdCompressor(level=1 + i, write_checksum=bool(i % 2), write_content_size=bool(i % 3))
        sizes.append(out.write(c.compress(bytes(range(256)) * (n // 256) + b"z" * (n % 256))))
    ends = [e for _, _, e in warc.frames(out.getvalue())]
    assert ends == [sum(sizes[:k + 1]) for k in range(len(sizes))]
