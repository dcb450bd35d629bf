"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, lm_scoring, ngram_jaccard, packing, pii, quality, runtime, secrets, spelling, token_counts, url_filters, warc, word_runs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = runtime.stage_dir(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), folder).agg(F.sum("records")).collect()
    return warc.read_warc(spark, folder).drop("url")


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    return lm_scoring.lm_scores(docs.select("doc_id", "text", place.alias("place")), place=F.col("place"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ratio = quality.fit_log_ratio(docs, _table(spark, sf_dir, "labels"))
    return quality.quality_rules(docs, ratio)


def url_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a capture at a time that its id gives."""
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(page_id * 7919 % 365), int(page_id % 24))").alias("fetch_time"))


def url_list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list entry that each page gives: its host, the host's parent domain, or host and first segment."""
    pages = _table(spark, sf_dir, "pages")
    host, segment = url_filters.url_host(F.col("url")), url_filters.url_segment(F.col("url"))
    kind = F.expr("page_id % 3")
    key = F.when(kind == 0, host).when(kind == 1, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(F.concat(host, F.lit("/"), segment))
    action = F.element_at(F.array(*(F.lit(a) for a in url_filters.ACTIONS)), F.expr("int(page_id % 7 % 3) + 1"))
    return pages.select(key.alias("key"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(page_id * 104729 % 365), 0)").alias("listed_at"), action.alias("action"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.temporal_url_filter(url_captures(spark, sf_dir), url_list_entries(spark, sf_dir))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents")).drop("row_key")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    ranks = bpe.load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), ranks, tokenizers.PATTERN)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def looped_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where a tenth of the documents, by the crc32 of the id, repeat some of their words up to the end."""

    def looped(i: int | None, text: str) -> str:
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        words = text.encode().split() if h % 10 == 0 else []
        if not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [looped(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    runtime.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, text string")


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.word_runs(looped_texts(_table(spark, sf_dir, "documents")))
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda b, r: F.when(b.isNull() | (r["length"] > b["length"]), r).otherwise(b))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted_typos(i: int | None, words: list[str]) -> list[str]:
    """Of a document's words, about one in 31 without one of its letters, by the crc32 of id and word."""
    first, out = zlib.crc32(f"{i}:".encode()), []
    for word in words:
        h = zlib.crc32(word.encode(), first)
        k = h % len(word)
        out.append(word if h % 31 else word[:k] + word[k + 1 :])
    return out


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(_table(spark, sf_dir, "documents"), change=planted_typos)
    return spelling.spelling_variants(words.filter(F.col("n") >= spelling.LEAST_COUNT))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT page_id, octet_length(encode(p.html)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 1 + 5 * CAST(j // 4 AS INT), 5) AS INT) >> CAST(15 - 5 * (j % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN r ON p.html = r.html
"""

OP4_SQL = r"""
WITH u AS (
  SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '\.$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS segment,
    TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 7919 % 365 AS INT)) + to_hours(CAST(page_id % 24 AS INT)) AS fetch_time
  FROM pages),
e AS (
  SELECT CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host || '/' || segment END AS key,
    TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 104729 % 365 AS INT)) AS listed_at, page_id % 7 % 3 AS a
  FROM u),
one AS (SELECT key, listed_at, min(a) AS a FROM e GROUP BY key, listed_at),
spans AS (
  SELECT key, CASE a WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'remove' END AS action, listed_at AS valid_from,
    lead(listed_at) OVER (PARTITION BY key ORDER BY listed_at) AS valid_to
  FROM one),
k AS (
  SELECT page_id, host, fetch_time, unnest(list_distinct(list_concat(
      list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
      CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END))) AS key
  FROM u),
m AS (
  SELECT k.page_id, spans.*, row_number() OVER (PARTITION BY k.page_id ORDER BY length(spans.key) DESC, spans.key DESC) AS n
  FROM k JOIN spans ON k.key = spans.key AND k.fetch_time >= valid_from AND (valid_to IS NULL OR k.fetch_time < valid_to)
  WHERE action <> 'remove')
SELECT u.page_id, u.host, u.fetch_time, m.key AS matched_key, m.action, m.valid_from, m.valid_to, coalesce(m.action = 'block', false) AS blocked
FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.n = 1
"""

OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_deleted_interpolation, op3_quality_rules, op4_url_filter, op5_ngram_jaccard, op6_exact_dedup, op7_best_fit_packing, op8_byte_bpe, op9_pii, op10_secrets, op11_word_runs, op12_spelling_variants, op13_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_url_filter": OP4_SQL, "op6_exact_dedup": OP6_SQL}
