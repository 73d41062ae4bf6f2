"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, langid, lexical, licenses, packing, quality, simhash, suffix_dedup, topk, warc, wrappers
from ..session import materialise, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    forest = quality.train_quality(documents, _table(spark, sf_dir, "labels"))
    return quality.score_documents(documents, forest)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.canonical_turns(_table(spark, sf_dir, "conversations"), "conv_id")
    odd = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.array(*[F.struct(F.lit(r).alias("role"), F.lit(odd).alias("content")) for r in ("user", "assistant")]).alias("messages")
    )
    done = chat.format_chats(rows).unionByName(chat.format_chats(chat.canonical_turns(own, "conv_id")))  # a table's own -7 stays apart
    read = done.select("conv_id", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return langid.identify_documents(documents, langid.fit_language_model(documents))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=10)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = warc.plan_records(_table(spark, sf_dir, "pages"))
    archives = materialise(warc.write_archives(planned, shared_folder(spark, "archives")), "archive-paths")
    whole = F.when(F.col("error").isNull(), F.col("page_id")).otherwise(F.raise_error(F.col("error")).cast("bigint"))  # own archives: all or nothing
    return warc.read_archive_files(archives).select(whole.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_main_text(_table(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"), min_documents=3, k=200)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_language_id": op3_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_exact_topk": op6_exact_topk,
    "op7_simhash": op7_simhash,
    "op8_warc_archives": op8_warc_archives,
    "op9_packing": op9_packing,
    "op10_license_scan": op10_license_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_main_text": op12_main_text,
    "op13_source_divergence": op13_source_divergence,
}

ESCAPED = "replace({0}, chr(92), chr(92) || chr(92))"
for _control in chat.CONTROL:
    ESCAPED = f"replace({ESCAPED}, '{_control}', '{_control[0]}' || chr(92) || '{_control[1:]}')"
_MARKS = len(chat.START) + len(chat.SEP) + len(chat.END)

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": f"""
WITH turns AS (
  SELECT 0 AS origin, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT 1, -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT 1, -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
said AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length({ESCAPED.format("role")}) + length({ESCAPED.format("text")}) + {_MARKS}) AS formatted_chars
  FROM turns GROUP BY origin, conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM said
""",
    "op4_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d WHERE doc_id IS NOT NULL AND len(x) >= 100)),
lowest AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hits AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM w JOIN lowest USING (s) WHERE doc_id > m),
spans AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM hits) GROUP BY r, g),
ends AS (SELECT r, a, b FROM spans UNION ALL SELECT r, len(x) // 2, len(x) // 2 FROM d),
pieces AS (SELECT r, coalesce(max(b) OVER (PARTITION BY r ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, a AS t FROM ends),
kept AS (SELECT r, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY f, t) AS k FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, ((len(x) - len(k)) // 2)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM spans GROUP BY r) USING (r)
""",
    "op6_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op8_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN f USING (html)
""",
    "op10_license_scan": licenses.oracle_sql(),
    "op11_lexical_search": r"""
WITH words AS (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE doc_id IS NOT NULL)
),
counted AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY row, term),
lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM counted GROUP BY row),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM counted GROUP BY term), whole),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
scored AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (row), whole GROUP BY item_id, row
),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::BIGINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, count(*)::BIGINT AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS n FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source),
shares AS (
  SELECT k.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (t.n + l.v) AS p, 1 + (1000000000 * (k.n + 1)) // (l.n + l.v) AS q
  FROM kept k JOIN totals t USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = k.lang AND c.source = t.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM terms
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
