"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Runs of four bytes are hashed into a fixed number of buckets (runs inside words and over
their edges, so rare words of a clean text look like others of its language). Two multinomials over the
buckets are counted: one over every document (raw), one over trusted documents (target: a
bounded set of labelled ids). A document's score is the mean over its n-grams of
``log p_target - log p_raw``; it is kept if it passes the base rules and the score is not
below a fixed threshold. The model is ``buckets`` numbers whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .runtime import small_batches

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

BUCKETS = 1 << 16
#: Most labelled ids that the target model is fitted on.
TARGET_IDS = 100_000
GRAM_BYTES = 4
#: Pseudo-count of each bucket in the raw multinomial; the target's is in proportion to its size, so unseen n-grams pull to 0.
SMOOTHING = 1.0
#: A document below this mean log ratio (in nats per n-gram) is rejected.
THRESHOLD = -0.45

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _grams(words: K.Words, buckets: int, n: int = GRAM_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every run of n bytes inside one document."""
    data, size = words.data, words.data.size - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        value = (value << np.uint64(8)) | data[j : size + j]
    doc = np.repeat(np.arange(words.offsets.size - 1), np.diff(words.offsets))
    inside = np.flatnonzero(doc[:size] == doc[n - 1 :])
    return doc[inside], (K.mix(value[inside]) % np.uint64(buckets)).astype(np.int64)


def base_features(words: K.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    data, offsets, rows = words.data, words.offsets, words.offsets.size - 1
    letters = ~K.SPACE[data] & ((data & 0xC0) != 0x80)
    first, value = K.windows(words, REPEAT_WINDOW)
    again, _ = K.repeated(words.doc[first], value)
    covered = np.zeros(words.hashes.size + 1, dtype=np.int64)
    np.add.at(covered, first[again], 1)
    np.add.at(covered, first[again] + REPEAT_WINDOW, -1)

    breaks = np.flatnonzero(data == 0x0A)
    lines = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    doc = np.searchsorted(offsets, lines, side="right") - 1
    inside = lines < offsets[-1]
    lines, doc = lines[inside], doc[inside]
    ends = np.minimum(np.append(breaks, data.size)[np.searchsorted(breaks, lines)], offsets[doc + 1])
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, lines)
    lines, ends, doc = lines[has_word], ends[has_word], doc[has_word]
    _, later = K.repeated(doc, K.hash_bytes((words.raw[s:e] for s, e in zip(lines.tolist(), ends.tolist(), strict=True)), lines.size))
    return {
        "n_words": words.counts,
        "word_chars": K.sum_by(offsets, letters),
        "n_symbols": K.sum_by(offsets, _SYMBOL[data]),
        "n_dup_lines": np.bincount(doc[later], minlength=rows),
        "n_repeat_words": K.sum_by(words.bounds, np.cumsum(covered[:-1]) > 0),
    }


def _count_buckets(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, end, words in K.batch_words(batch.column(0)):
                doc, bucket = _grams(words, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[trusted[first:end][doc]], minlength=buckets)
        K.release_memory()
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    return count


def fit_log_ratio(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1", buckets: int = BUCKETS, target_ids: int = TARGET_IDS, smoothing: float = SMOOTHING
) -> np.ndarray:
    """log p_target - log p_raw of each bucket, counted over every document of ``df``.

    The target's ids are the ``target_ids`` labelled good ids of smallest hash, so the set
    has a fixed bound and does not depend on row order. Without any target text all ratios
    are 0.
    """
    spark = df.sparkSession
    small_batches(spark)
    ids = [r[0] for r in labels.filter(good).filter(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(target_ids).collect()]
    key = df.schema[id_col].dataType
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("_target_id", key)])))
    flagged = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(chosen, F.col("_id") == F.col("_target_id"), "left")
    counts = (
        flagged.select("text", F.col("_target_id").isNotNull().alias("trusted"))
        .mapInArrow(_count_buckets(buckets), "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()  # at most ``buckets`` rows
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.sum():
        return np.zeros(buckets)
    share = target.sum() / raw.sum()
    return np.log((target + smoothing * share) / share) - np.log(raw + smoothing)


def _base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def _verdicts(words: K.Words, ratio: np.ndarray, threshold: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(base features, mean log ratio, kept) of each document."""
    f, rows = base_features(words), words.counts.size
    doc, bucket = _grams(words, ratio.size)
    mean = np.round(np.bincount(doc, weights=ratio[bucket], minlength=rows) / np.maximum(np.bincount(doc, minlength=rows), 1), 9)
    return f, mean, ~_base_failed(f) & (mean >= threshold)


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def quality_rules(df: DataFrame, log_ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, base counts, ``base_failed``, ``score`` and ``kept``.

    A null or empty text has no words, fails the base rules and scores 0. Scores depend on a
    row's text only, so ties and repeated rows get equal verdicts. Other columns of ``df``
    are not read. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(log_ratio)  # fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for batch in batches:
            for first, end, words in K.batch_words(batch.column(1)):
                f, mean, kept = _verdicts(words, ratio, threshold)
                values = [*f.values(), _base_failed(f), mean, kept]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *(pa.array(v if v.dtype != np.int64 else v.astype(np.int64)) for v in values)], ["id", *(x.split()[0] for x in OUT.split(", "))])
        K.release_memory()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(score, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, log_ratio: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that ``quality_rules`` keeps, with all their columns, in one pass without a join.

    Rows of null or empty text go (they have fewer words than the base rules ask for).
    """
    small_batches(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(log_ratio)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for first, end, words in K.batch_words(column):
                _, _, kept = _verdicts(words, model.value, threshold)
                yield batch.slice(first, end - first).filter(pa.array(kept))
        K.release_memory()

    return df.mapInArrow(run, df.schema)
