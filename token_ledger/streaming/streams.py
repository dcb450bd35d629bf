"""Streaming forms: continuous ingest, hourly roll-up, and counter deltas that outlive a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.counters import COUNTER_FIELDS, FALLBACK_MODEL, REVIEW_MODEL, REVIEW_SINCE, REVIEW_TARGET
from ..schema import TOKENS
from ..session import staged


def stream_ingest(spark: SparkSession, path: str, scan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str, interval: str = "10 seconds", available_now: bool = False) -> StreamingQuery:
    """Follows a folder of rolled (immutable) log files; each batch of lines goes through ``scan`` to ``sink``.

    ``scan`` takes ``file_path, line, value, modified_at``. A rolled file arrives whole and is
    taken once. Files are planned by the ``rolled`` source and read where their rows are, without
    a shuffle. Spark's own stream of files is used where pyarrow doesn't know the file system,
    and where a checkpoint goes on that began with it. The sink upserts, so a batch that runs
    again changes nothing.
    """
    from ..plans.storage import names
    from ..sources.lines import lines_of
    from ..sources.listing import known_place
    from ..sources.tail import RolledSource

    root, log = known_place(spark, path), f"{checkpoint.rstrip('/')}-plans"
    if root is None or (names(spark, f"{checkpoint}/sources/0") and not names(spark, log)):
        rows, lines = _text_stream(spark, path), _number_batch
    else:
        spark.dataSource.register(RolledSource)
        rows, lines = spark.readStream.format("rolled").options(path=root, log=log).load(), lambda batch: lines_of(staged(batch, "rolled-files"), root)
    writer = rows.writeStream.foreachBatch(lambda batch, _: sink(scan(lines(batch)))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def _text_stream(spark: SparkSession, path: str) -> DataFrame:
    from ..sources.lines import plain_path

    raw = spark.readStream.option("recursiveFileLookup", True).text(path)
    return raw.select("value", plain_path(F.col("_metadata.file_path")).alias("file_path"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_modification_time").alias("modified_at"))


def _number_batch(batch: DataFrame) -> DataFrame:
    numbered = batch.withColumn("_id", F.monotonically_increasing_id())
    line = F.row_number().over(Window.partitionBy("file_path").orderBy("_block", "_id")).cast("bigint") - 1
    return numbered.withColumn("line", line).select("file_path", "line", "value", "modified_at")


def number_lines(rows: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, state, reset files) of a batch of the ``tail`` source.

    ``known`` (``file_path, byte_offset, line_index``) is the state after the batches before. A
    chunk's lines are numbered where they are read; what comes before a chunk is a running sum
    of counts, one row for each chunk, so a huge file is never sorted in one place. Chunks that
    the state is beyond have been taken in already and are left out. Blank lines count, and go.
    """
    chunks = rows.groupBy("file_path", "chunk", "reset").agg(F.count("row").alias("n"), F.max("end").alias("end"), F.max("modified_at").alias("modified_at"))
    if known is None:
        known = rows.sparkSession.createDataFrame([], "file_path string, byte_offset bigint, line_index bigint")
    chunks = chunks.join(known.select("file_path", "byte_offset", "line_index"), "file_path", "left")
    chunks = chunks.filter("n > 0 OR reset")  # a part of a line changes nothing yet
    fresh = F.col("reset") | F.col("byte_offset").isNull() | (F.col("chunk") >= F.col("byte_offset"))
    order = Window.partitionBy("file_path").orderBy("chunk")
    started = F.when(F.col("reset"), 0).otherwise(F.coalesce("line_index", F.lit(0)))
    # Lines, state and resets each need the chunks, which are few against the lines.
    chunks = staged(chunks.filter(fresh).withColumn("before", started + F.sum("n").over(order) - F.col("n")), "tail-chunks")
    lines = rows.select("file_path", "chunk", "row", "value").join(chunks.select("file_path", "chunk", "before", "modified_at"), ["file_path", "chunk"])
    lines = lines.select("file_path", (F.col("before") + F.col("row")).alias("line"), "value", "modified_at").filter(F.trim("value") != "")
    state = chunks.groupBy("file_path").agg(F.max("end").alias("byte_offset"), F.max(F.col("before") + F.col("n")).alias("line_index"), F.max("end").alias("file_size"), F.max("modified_at").alias("file_mtime"))
    return lines, state, chunks.filter("reset").select("file_path").distinct()


def void_files(rows: DataFrame, known: DataFrame | None) -> DataFrame | None:
    """``file_path, last, modified_at`` of files that were continued but don't go on where the state says: others by the same name.

    A file's first new lines begin behind its last line end before; chunks that the state is beyond have been taken in.
    """
    if known is None:
        return None
    firsts = rows.filter("begin IS NOT NULL AND NOT reset").join(known.select("file_path", "byte_offset"), "file_path").filter("chunk >= byte_offset")
    each = firsts.groupBy("file_path").agg(F.min_by("begin", "chunk").alias("begin"), F.max("byte_offset").alias("byte_offset"), F.max("last").alias("last"), F.max("modified_at").alias("modified_at"))
    return each.filter("begin != byte_offset").select("file_path", "last", "modified_at")


def stream_tail(spark: SparkSession, path: str, sink: Callable[[DataFrame, DataFrame, DataFrame], None], checkpoint: str, known: Callable[[], DataFrame | None], glob: str = "*.jsonl", interval: str = "10 seconds", available_now: bool = False, chunk_bytes: int | None = None) -> StreamingQuery:
    """Follows a folder of growing files; each batch's new lines go to ``sink(lines, state, reset)``.

    ``lines`` are ``file_path, line, value, modified_at``; ``state`` is that of files with new
    lines; ``reset`` are files that have shrunk, whose earlier lines are void. ``known`` gives
    the state that the sink has kept. A sink that commits lines, state and resets together
    (``plans.store.write_events``) takes every line once, whatever batch runs again.
    """
    from ..sources.tail import CHUNK_BYTES, SCHEMA, TailSource, read_again

    spark.dataSource.register(TailSource)
    chunk = chunk_bytes or CHUNK_BYTES
    rows = spark.readStream.format("tail").options(path=path, glob=glob, log=f"{checkpoint.rstrip('/')}-plans", chunkBytes=chunk).load()

    def handle(batch: DataFrame, _: int) -> None:
        new, was = staged(batch, "tail-lines"), known()
        void = void_files(new, was)
        if void is not None and not (void := staged(void, "tail-void")).isEmpty():
            start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last") - 1, F.lit(chunk).cast("bigint"))).alias("start")
            chunks = void.select("file_path", start, "last", F.col("modified_at").cast("double").alias("modified")).withColumn("stop", F.least(F.col("start") + chunk, "last"))
            new = new.join(void, "file_path", "left_anti").unionByName(staged(chunks.repartition("file_path", "start").mapInArrow(partial(read_again, path), SCHEMA), "tail-again"))
        sink(*number_lines(new, was))

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def stream_to_store(events: DataFrame, root: str, checkpoint: str, scan: Callable[[DataFrame], DataFrame] | None = None, interval: str = "10 seconds", available_now: bool = False) -> StreamingQuery:
    """Merges a stream of events into a store, whose hours and day revisions follow every batch.

    No row is too late: an event of any day changes that day's hours and raises its revision,
    so the day is published again. A batch that runs again changes nothing. ``scan`` turns a
    batch into events, if the stream holds something else.
    """
    from ..plans.store import write_events

    def handle(batch: DataFrame, _: int) -> None:
        write_events(scan(batch) if scan else batch, root)

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def stream_hourly(events: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """The hourly roll-up on a stream of events; hours close once the watermark has passed them (append) or change (update).

    Rows behind the watermark are lost here; ``stream_to_store`` keeps hours that take them in.
    """
    hours = events.withWatermark("timestamp_utc", watermark).groupBy(F.window("timestamp_utc", "1 hour"), "source_id", "model_family")
    sums = hours.agg(*(F.sum(c).alias(c) for c in (*TOKENS, "cost_usd")), F.count(F.lit(1)).alias("event_count"), F.count_if("cost_is_estimated").alias("estimated_event_count"))
    return sums.select(F.col("window.start").alias("hour_utc"), *(c for c in sums.columns if c != "window"))


_STATE = "file_path array<string>, " + ", ".join(f"{f} array<bigint>" for f in COUNTER_FIELDS) + ", model array<string>, is_fallback array<boolean>"
STREAM_DELTA = "file_path string, line bigint, " + ", ".join(f"{f} bigint" for f in COUNTER_FIELDS) + ", resolved_model string, is_fallback boolean"
#: Groups of files that keep their state together.
GROUPS = 512


def _usage(rows: pd.DataFrame, file: np.ndarray, before: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, pd.DataFrame]:
    """(usage of each row, which rows have any, the last total of each file), given the last totals before them."""
    fields = list(COUNTER_FIELDS)
    total = rows[[f"total_{f}" for f in fields]].astype("float64").set_axis(fields, axis=1)
    last = rows[[f"last_{f}" for f in fields]].astype("float64").set_axis(fields, axis=1)
    start = before[fields].astype("float64").reset_index(drop=True)
    known = total.groupby(file).ffill()
    previous = known.groupby(file).shift(1).fillna(start.iloc[file].reset_index(drop=True))
    has_total, has_last = total["total"].notna(), last["total"].notna()
    repeat = has_total & (total == previous).all(axis=1)
    usage = last.where(has_last, (total - previous.fillna(0)).clip(lower=0))
    end = known.groupby(file).last().fillna(start)
    return usage, (rows["is_usage"] & ~repeat & (has_last | has_total)).to_numpy(dtype=bool), end


def _models(rows: pd.DataFrame, file: np.ndarray, before: pd.DataFrame) -> tuple[pd.Series, pd.Series, pd.DataFrame]:
    """(resolved model, fallback flag) of each row and the ``model, is_fallback`` that each of their files goes on with, given those before."""
    stated = rows["model"].astype("string").replace("", pd.NA)
    segment = stated.notna().groupby(file).cumsum()
    model, flag = before["model"].astype("string"), before["is_fallback"].eq(True)
    told = stated.groupby(file).ffill().fillna(model.iloc[file].reset_index(drop=True))
    none, carried = told.isna(), (segment == 0) & flag.to_numpy()[file]
    used = rows["is_usage"].astype("int64").groupby([file, segment]).cumsum()
    first = rows["event_date"].astype("string").where(rows["is_usage"]).groupby([file, segment]).transform("first").str.slice(0, 10)
    review = (told == REVIEW_MODEL).fillna(False).astype(bool)
    target = pd.Series(np.where((first.fillna("") >= REVIEW_SINCE).to_numpy(dtype=bool), REVIEW_TARGET, FALLBACK_MODEL), index=rows.index, dtype="string")
    resolved = told.mask(review, target).fillna(FALLBACK_MODEL)
    flags = none | carried | (review & rows["is_usage"] & (used == 1))
    # Where nothing has used the last stated model yet, it goes on as stated.
    on = pd.DataFrame({"model": resolved.where(used > 0, told), "is_fallback": carried | (none & (used > 0))})
    return resolved, flags, on[np.append(file[1:] != file[:-1], True)].set_axis(file[np.append(file[1:] != file[:-1], True)])


def _delta(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Deltas and models of the new lines of a group's files; the state is the last total, model and fallback flag of each."""
    names = ["file_path", *COUNTER_FIELDS, "model", "is_fallback"]
    held = pd.DataFrame({n: pd.Series(list(v), dtype=object) for n, v in zip(names, state.get, strict=True)} if state.exists else {n: pd.Series(dtype=object) for n in names}).set_index("file_path")
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["file_path", "line"], ignore_index=True)
    rows["is_usage"] = rows["is_usage"].astype(bool)
    file, files = pd.factorize(rows["file_path"])
    before = held.reindex(files)
    usage, kept, totals = _usage(rows, file, before)
    stands = kept | (~rows["is_usage"] & (rows["model"].fillna("") != "")).to_numpy()
    out = usage[kept].astype("int64")
    out.insert(0, "line", rows["line"].to_numpy()[kept])
    out.insert(0, "file_path", rows["file_path"].to_numpy()[kept])
    after = before.copy()
    for f in COUNTER_FIELDS:
        after[f] = totals[f].to_numpy()
    resolved, flags = pd.Series(dtype=object), pd.Series(dtype=bool)
    if stands.any():
        resolved, flags, on = _models(rows[stands].reset_index(drop=True), file[stands], before)
        for n in ("model", "is_fallback"):
            values = after[n].to_numpy(dtype=object, copy=True)
            values[on.index] = on[n].to_numpy(dtype=object)
            after[n] = values
    others = held.drop(index=files, errors="ignore")
    held = (pd.concat([others, after]) if len(others) else after).rename_axis("file_path").reset_index()
    plain = lambda n: [None if pd.isna(x) else (str(x) if n in ("file_path", "model") else bool(x) if n == "is_fallback" else int(x)) for x in held[n]]
    state.update(tuple(plain(n) for n in names))
    yield out.assign(resolved_model=resolved.to_numpy()[kept[stands]], is_fallback=flags.to_numpy(dtype=bool)[kept[stands]])


def stream_counter_delta(snapshots: DataFrame, groups: int = GROUPS) -> DataFrame:
    """``drop_repeated_snapshot``, ``counter_delta`` and ``resolve_fallback_model`` over micro-batches.

    Takes ``file_path, line, total, last`` (structs of the counter fields) and, if there are
    such columns, ``model``, ``is_usage`` (false for lines that only state a model) and
    ``event_date`` (text). Gives the usage rows: ``file_path, line``, the counter fields,
    ``resolved_model, is_fallback``. A file's last total, model and fallback flag are kept as
    state, so a batch may end anywhere in a file; later batches hold later lines. Repeats and
    rows without usage state no model. Files are dealt by a hash to ``groups`` that are worked
    on one at a time, all files of one together, as a call for each of very many small files
    costs more than its rows. A group's lines of one batch meet in one worker, as numbers and
    names of models only; bound them by more groups (for a new checkpoint) or by
    ``maxBytesPerTrigger`` at the source.
    """
    have = lambda c, otherwise: F.col(c) if c in snapshots.columns else otherwise.alias(c)
    text = F.lit(None).cast("string")
    counters = (F.col(f"{s}.{f}").alias(f"{s}_{f}") for f in COUNTER_FIELDS for s in ("total", "last"))
    flat = snapshots.select("file_path", "line", *counters, have("model", text), have("is_usage", F.lit(True)), have("event_date", text))
    return flat.withColumn("_group", F.pmod(F.xxhash64("file_path"), F.lit(groups))).groupBy("_group").applyInPandasWithState(_delta, STREAM_DELTA, _STATE, "append", GroupStateTimeout.NoTimeout)


def republish_days(batch: DataFrame, revisions: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """Sink for late data: every day that a batch touches goes to ``write`` as ``day_utc, revision``; no late row is dropped.

    ``revisions`` has the ``day_utc, revision`` of days so far; a touched day gets the next
    one. Returns all days with their revisions, for ``mark_published``.
    """
    touched = batch.select(F.to_date("timestamp_utc").alias("day_utc")).distinct().withColumn("_touched", F.lit(1))
    joined = revisions.join(touched, "day_utc", "full").withColumn("revision", F.coalesce("revision", F.lit(0)) + F.coalesce("_touched", F.lit(0)))
    write(joined.filter("_touched = 1").select("day_utc", "revision"))
    return joined.select("day_utc", "revision")


def mark_published(revisions: DataFrame, published: DataFrame) -> DataFrame:
    """``day_utc, revision, dirty``: a day is clean only if what was published is of its revision of now."""
    done = published.groupBy("day_utc").agg(F.max("revision").alias("_done"))
    return revisions.join(done, "day_utc", "left").select("day_utc", "revision", (~F.coalesce(F.col("_done") == F.col("revision"), F.lit(False))).alias("dirty"))
