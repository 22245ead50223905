"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.llm import (bpe, chat, conversation_repair, decontam, hard_negatives, html_text, ngram_join, pii, quality,
                         secret_scan, token_counts, topk, warc)
from pvspark.llm.common import importable, read_table

# The key of the registered queries' pseudonyms; a production run passes its own secret.
DEMO_KEY = b"registered-query-key"


def tokenizer_path(name: str) -> str:
    """Where the machine's public tokenizer files are; another place can be passed to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return ngram_join.ngram_jaccard_join(read_table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return topk.top_k_search(read_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(chat.conversation_events(rows))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                       chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
                    F.char_length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize_documents(docs, DEMO_KEY)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    path, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), split_pattern()
    encoded = bpe.encode_documents(read_table(spark, sf_dir, "documents"), path, pattern)
    return bpe.decode_ids(encoded, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return secret_scan.find_secrets(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
        "spans")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return html_text.extract_main_text(read_table(spark, sf_dir, "pages"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of conv_id and turn; a dropped row stays to announce its conversation."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fate = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fate != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1))).alias("copy"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    rows = damaged(read_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_report(conversation_repair.repair_conversations(rows, present="present"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    folder = warc.archive_folder(spark)
    warc.write_archives(read_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine_hard_negatives(rows, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_ngram_join, op2_top_k, op3_decontamination, op4_chat_format, op5_pii, op6_token_counts,
                            op7_bpe, op8_quality, op9_secrets, op10_html_text, op11_conversation_repair,
                            op12_warc, op13_hard_negatives)}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x20\x09-\x0D]+')"""


def _shingles(table: str, key: str) -> str:
    """SQL of (key, g): the distinct five-word shingles of each row's text."""
    return f"""
      SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
      FROM (SELECT {key}, {_WORDS} AS w FROM {table})"""


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": f"""
    WITH RECURSIVE s AS ({_shingles('documents', 'doc_id')}),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g)
               WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
             WHERE 100 * c >= 75 * (p.n + q.n - c)),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
    SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.y)::BIGINT AS component_id,
           (SELECT count(*) FROM link l WHERE l.x = d.doc_id)::BIGINT AS n_links
    FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op2_top_k": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_decontamination": f"""
    WITH d AS ({_shingles('documents', 'doc_id')}), i AS ({_shingles('benchmark', 'item_id')}),
    n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
    c AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN i USING (g) GROUP BY ALL)
    SELECT doc_id, item_id, n AS n_item, c AS n_shared, c::DOUBLE / n AS containment FROM c JOIN n USING (item_id)
    WHERE 100 * c >= 75 * n""",
    "op4_chat_format": r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
               UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (SELECT *, replace(replace(replace(replace(role, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'),
                            '</s>', '<\/s>') AS r,
                 replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'),
                            '</s>', '<\/s>') AS t FROM c),
    g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                 sum(6 + length(r) + 7 + length(t) + 4) AS chars FROM e GROUP BY conv_id)
    SELECT conv_id, n::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
           sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g""",
    "op11_conversation_repair": r"""
    WITH RECURSIVE crc_table AS (
      SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
               CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    fated AS (SELECT conv_id, turn, role, text,
                xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1)))),
                    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS fate FROM keyed, crc_table),
    hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
               CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fated),
    placed AS (SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS r0,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
                 rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
               FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
    r AS (SELECT *, trimmed = '' AS is_blank, trimmed <> '' AND seen AS is_duplicate,
            trimmed <> '' AND NOT seen AND right(trimmed, 1) NOT IN ('.', '!', '?') AS is_cut,
            lag(r0) OVER (PARTITION BY conv_id ORDER BY i) AS r1 FROM placed),
    inserts(q, k, s, letters, added) AS (VALUES
      (0, 0, 0, '', []::VARCHAR[]), (0, 1, 2, 'I', ['user:']), (0, 2, 3, 'II', ['user:', 'assistant:']),
      (1, 0, 1, '', []::VARCHAR[]), (1, 1, 2, 'I', ['user:']), (1, 2, 3, 'II', ['user:', 'assistant:']),
      (2, 0, 2, '', []::VARCHAR[]), (2, 1, 3, 'I', ['assistant:']), (2, 2, 2, 'II', ['assistant:', 'user:']),
      (3, 0, 3, '', []::VARCHAR[]), (3, 1, 2, 'I', ['user:']), (3, 2, 3, 'II', ['user:', 'assistant:'])),
    edits(edit, s, needs, q2, becomes, price) AS (VALUES
      ('D', 0, NULL, 0, NULL, 2), ('D', 1, NULL, 1, NULL, 2), ('D', 2, NULL, 2, NULL, 2), ('D', 3, NULL, 3, NULL, 2),
      ('K', 0, 's', 1, NULL, 0), ('K', 0, 'u', 2, NULL, 0), ('K', 1, 'u', 2, NULL, 0), ('K', 3, 'u', 2, NULL, 0),
      ('K', 2, 'a', 3, NULL, 0), ('R', 0, NULL, 2, 'user', 1), ('R', 1, NULL, 2, 'user', 1), ('R', 3, NULL, 2, 'user', 1),
      ('R', 2, NULL, 3, 'assistant', 1)),
    best AS (
      SELECT c.conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'rows': []::VARCHAR[]} AS path
      FROM (SELECT DISTINCT conv_id FROM conversations) c
      UNION ALL
      SELECT b.conv_id, r.i, e.q2, min({'cost': path.cost + 5 * n.k + e.price + CASE WHEN r.is_cut AND e.edit <> 'D' THEN 5 ELSE 0 END,
               'audit': path.audit || n.letters || e.edit,
               'rows': list_concat(path.rows, list_concat(n.added, CASE WHEN e.edit = 'D' THEN []::VARCHAR[]
                       ELSE [coalesce(e.becomes, r.role) || ':' || r.text] END))})
      FROM best b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1 JOIN inserts n ON n.q = b.q
      JOIN edits e ON e.s = n.s AND (e.edit = 'D' OR NOT (r.is_blank OR r.is_duplicate)) AND (e.needs IS NULL OR e.needs = r.r0)
      GROUP BY b.conv_id, r.i, e.q2),
    facts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_duplicate) AS duplicate,
                count(*) FILTER (is_cut) AS truncated,
                count(*) FILTER (i > 1 AND r1 || r0 NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
    ended AS (SELECT b.conv_id, min({'cost': path.cost + 5 * x.k, 'audit': path.audit || x.letters,
                                    'rows': list_concat(path.rows, x.added)}) AS path
              FROM best b LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id
              JOIN inserts x ON x.q = b.q AND x.k = CASE b.q WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END
              WHERE b.i = coalesce(f.n, 0) GROUP BY b.conv_id)
    SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, path.cost::BIGINT AS cost, path.audit AS audit,
           sha256(array_to_string(path.rows, chr(10))) AS repaired_sha256
    FROM ended e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op12_warc": """
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, html,
            row_number() OVER w AS place, first(page_id) OVER w AS least
          FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS FIRST)),
    bits AS (SELECT *, list_transform(range(0, 40), lambda i: ('0x' || substr(sha1(html), i + 1, 1))::INTEGER) AS nibble FROM d)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(
             list_transform(range(5 * k, 5 * k + 5), lambda b: (nibble[b // 4 + 1] // (2 ** (3 - b % 4))::INTEGER) % 2),
             lambda a, b: 2 * a + b), 1)), '') AS payload_digest,
           CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN place > 1 THEN least END AS refers_to, NULL::VARCHAR AS error FROM bits""",
    "op13_hard_negatives": """
    WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
    s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same,
                 list_inner_product(a.v, c.v)::BIGINT AS score
          FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.row <> c.row),
    p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) AS place FROM s WHERE same),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id, s.row) AS rank
          FROM p JOIN s ON p.place <= 5 AND s.anchor = p.anchor AND NOT s.same
                       AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
