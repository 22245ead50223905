"""Secrets: base spans against a scan by hand, and what the byte measure finds among planted strings and identifiers."""

import random
import string
import time

import duckdb
import pytest

from pvspark.llm import secret_scan

TEXTS = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) > 900 "
                                  "ORDER BY doc_id").fetchall()]
PRIMER = secret_scan.dictionary(TEXTS[:200])


def slow_base(text):
    """Base spans found character by character."""
    out, low = [], text.lower() if text.isascii() else "".join(c.lower() if c < "\x80" else c for c in text)
    words = ["password", "passwd", "secret", "token", "apikey", "api_key"]

    def run(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    at = 0
    while at < len(text):
        step = None
        for word in words:
            if not low.startswith(word, at):
                continue
            k = at + len(word)
            k += text[k:k + 1] in ("'", '"') and bool(text[k:k + 1])
            k = run(k, " ")
            if text[k:k + 1] not in (":", "=") or not text[k:k + 1]:
                continue
            k = run(k + 1, " ")
            k += text[k:k + 1] in ("'", '"') and bool(text[k:k + 1])
            end = run(k, string.ascii_letters + string.digits + "+/_.=-")
            if end > k:
                step = end
                if end - k >= 6:
                    out.append(("assign", at, end))
                break
        at = step or at + 1
    for kind, lead, allowed, least in (("access", "AKIA", string.ascii_uppercase + string.digits, 20),
                                       ("hex", "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            if text.startswith(lead, at) and (end := run(at + len(lead), allowed)) > at + len(lead):
                if end - at >= least:
                    out.append((kind, at, end))
                at = end
            else:
                at += 1
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_equal_a_scan_by_hand(seed):
    r = random.Random(seed)
    parts = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "'", '"', " ", "  ", ":", "=", "AKIA", "\n", "é",
             "abc123", "x.y/z", "0123456789abcdef" * 2, "AKIA" + "A1" * 9, "deadbeef", "\t"]
    for _ in range(400):
        text = "".join(r.choices(parts, k=r.randrange(1, 14)))
        assert secret_scan.base_spans(text) == slow_base(text), text
    for text in TEXTS[seed::40]:
        assert secret_scan.base_spans(text) == slow_base(text)


def share_found(make, n=200, seed=1):
    """Share of made strings that are reported beside a sensitive word in texts of the corpus."""
    r, hits = random.Random(seed), 0
    for _ in range(n):
        text = r.choice(TEXTS[200:])
        at, value = r.randrange(300, len(text) - 300), make(r)
        whole = f"{text[:at]} my token is {value} {text[at:]}"
        start = at + len(" my token is ")
        hits += ("novel", start, start + len(value)) in secret_scan.novel_spans(whole, [], PRIMER)
    return hits / n


ALNUM = string.ascii_letters + string.digits
WORDS = [w for w in secret_scan._IDENTIFIERS.split() if len(w) < 20]


@pytest.mark.parametrize("alphabet,length,least", [
    (ALNUM, 12, 0.9), (ALNUM, 15, 0.95), (ALNUM, 20, 0.95), (ALNUM, 40, 0.95), (ALNUM, 64, 0.95), (ALNUM, 100, 0.95),
    (ALNUM + "+/", 300, 0.95), (string.ascii_letters, 40, 0.95), (string.ascii_letters, 20, 0.95)])
def test_random_strings_are_found(alphabet, length, least):
    assert share_found(lambda r: "".join(r.choices(alphabet, k=length))) >= least


@pytest.mark.parametrize("make", [
    lambda r: "_".join(r.choices(WORDS, k=r.randint(2, 6))) + r.choice(["", "_v3", "2", "_2024"]),
    lambda r: "-".join(r.choices(WORDS, k=r.randint(3, 6))) + "-2024",
    lambda r: r.choice(["my_module_path_version_2_handler_v3", "https_server_configuration_node12", "com-example-project-build-2024-release"]),
    lambda r: "/".join(r.choices(WORDS, k=4)) + "/",
    lambda r: r.choice(r.choice(TEXTS[200:]).split())])
def test_identifiers_and_words_are_not(make):
    assert share_found(make) <= 0.05


def test_numbers_are_no_secrets():
    assert share_found(lambda r: "".join(r.choices(string.digits, k=16))) == 0


def test_a_text_of_megabytes_with_many_candidates():
    r = random.Random(3)
    text = " ".join(f"token {''.join(r.choices(ALNUM, k=24))} {r.choice(TEXTS)[:300]}" for _ in range(6000))
    began = time.process_time()
    found = secret_scan.novel_spans(text, secret_scan.base_spans(text), PRIMER)
    assert len(text) > 1_800_000 and len(found) > 4800 and time.process_time() - began < 60


def test_dictionary_keeps_what_texts_share():
    words = secret_scan.dictionary(["alpha beta zulu1", "alpha beta", "alpha gamma", "beta alpha Xk9dL2pQ"]).decode().split()
    assert words[:2] == ["beta", "alpha"] and "gamma" not in words and secret_scan.dictionary([]).decode().startswith("password")


def test_words_are_counted_over_all_whole_texts(spark):
    # 2000 different texts, more than any sample: "zuletzt" stands in 1 of 100 of them, behind 5000 characters.
    texts = ["".join(chr(97 + (i // 26 ** k) % 26) for k in range(5)) + " gemeinsam " + "ab " * 1700
             + ("zuletzt" if i % 100 == 0 else "") for i in range(2000)]
    copies = ["einmaliges geheim"] * 500 + [None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + copies)], "doc_id long, text string")
    found = secret_scan.shared_words(secret_scan.id_and_text(rows, "doc_id", "text"))
    assert found == ["gemeinsam", "zuletzt"]  # copies count once
    assert secret_scan.shared_words(secret_scan.id_and_text(rows.limit(0), "doc_id", "text")) == []
