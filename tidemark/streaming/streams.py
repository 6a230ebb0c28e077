"""Structured Streaming forms of the ingest, roll-up and bookkeeping steps.

Transformations take and return streaming frames.  Sinks that update by key append each micro-batch to
its own folder (rewriting that folder on replay, so a repeated batch changes nothing) and resolve the
key at read time; nothing else is overwritten, so a lost executor or a restart is harmless.  The folder
names the run as well: a query whose checkpoint was lost counts its batches from 0 again, in a run of
its own.  ``compact`` folds the stored batches of a table into one.
"""

from __future__ import annotations

import time as clock
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators import bars as B
from tidemark.operators.relations import not_yet
from tidemark.sources.payloads import content_hash, parse_stream_bars, strip_space
from tidemark.sources.sinks import observed
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming.state import rocksdb

# --- transformations -----------------------------------------------------------------------------


def zoned(df: DataFrame, name: str) -> DataFrame:
    """Watermarks need a zoned timestamp; all times are UTC."""
    return df.withColumn(name, F.col(name).cast("timestamp"))


def _rank(order: Sequence[str]) -> Column:
    """One column keeps first and last in hash aggregation; several need a struct and a sort."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def final_bars(messages: DataFrame, column: str = "value", now: Column | None = None) -> DataFrame:
    return parse_stream_bars(messages, column, now)


def dedupe(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    return zoned(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling_ohlc(ticks: DataFrame, width: str, delay: str, price: str = "value", time: str = "ts",
                  order: Sequence[str] = ("event_id",), key: str = "asset_id") -> DataFrame:
    """Bars per window, emitted once when the watermark passes the window end."""
    rank, p = _rank(order), F.col(price)
    return (zoned(ticks, time).withWatermark(time, delay).groupBy(key, F.window(time, width).alias("w")).agg(
        F.min_by(p, rank).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, rank).alias("close"), F.count(F.lit(1)).alias("trades"))
        .select(key, F.col("w.start").alias("open_time"), F.col("w.end").alias("known_at"), "open", "high", "low", "close", "trades"))


def sliding_change(bars: DataFrame, delay: str, width: str = "24 hours", slide: str = "1 hour", need: int = 24,
                   time: str = "ts", price: str = "value", order: Sequence[str] = ("event_id",), key: str = "asset_id") -> DataFrame:
    """Percent change between the first and the last value of every sliding window that holds enough rows."""
    rank, p = _rank(order), F.col(price)
    out = zoned(bars, time).withWatermark(time, delay).groupBy(key, F.window(time, width, slide).alias("w")).agg(
        F.min_by(p, rank).alias("_first"), F.max_by(p, rank).alias("latest"), F.count(F.lit(1)).alias("n"))
    change = F.when((F.col("n") >= need) & (F.col("_first") != 0), (F.col("latest") / F.col("_first") - 1) * 100)
    return out.select(key, F.col("w.end").alias("window_end"), "n", "latest", change.alias("change"))


def complete_grids(stream: DataFrame, n: int, delay: str, time: str = "time", bucket: str = "1 hour", key: str = "asset_id") -> DataFrame:
    """Days whose every grid bucket arrived; repeated deliveries of a bucket count once."""
    slot = zoned(stream, time).withColumn("_slot", F.window(time, bucket)["start"]).withWatermark("_slot", delay)
    once = slot.dropDuplicatesWithinWatermark([key, "_slot"])
    days = once.groupBy(key, F.window("_slot", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("points"))
    return days.where(F.col("points") == n).select(key, F.col("w.start").alias("day"), "points")


def latest_price(stream: DataFrame, time: str = "ts", price: str = "value", order: Sequence[str] = ("event_id",), key: str = "asset_id") -> DataFrame:
    """Running newest price per asset (update mode; one state row per asset)."""
    return stream.groupBy(key).agg(F.max_by(price, _rank(order)).alias("price"), F.max(time).alias("price_time"))


def asof_guard(stream: DataFrame, now: Column, cutoff: str = "snapshot_time") -> DataFrame:
    """Only rows known by now whose sources ended before the cutoff."""
    return stream.where((F.col("available_at") <= now) & (F.col("source_max_event_time") < F.col(cutoff)))


def news_dedupe(stream: DataFrame, delay: str, key: str = "symbol", time: str = "published_at") -> DataFrame:
    hashed = stream.where(strip_space(F.col("title")) != "").withColumn("content_hash", content_hash(F.col("title"), F.col("url")))
    return dedupe(hashed, [key, "content_hash"], time, delay)


# --- sinks ---------------------------------------------------------------------------------------


def start(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append",
          every: str | None = None, timed: bool = False) -> StreamingQuery:
    """Start a query with its own checkpoint: all available data once, or every ``every``.

    ``timed`` is for the operators of ``state``, whose state needs RocksDB.
    """
    if timed:
        with rocksdb(stream.sparkSession):
            return start(stream, path, each, mode, every)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if each is not None:
        return writer.foreachBatch(each).start()
    return writer.format("parquet").option("path", f"{path}/data").start()


def _folder(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def run_name(spark: SparkSession, path: str) -> str:
    """Name of the run that the checkpoint below ``path`` belongs to; it is kept with the checkpoint.

    Names sort by the time the run began.
    """
    folder, fs = _folder(spark, f"{path}/_checkpoint/_run")
    if fs.exists(folder):
        return fs.listStatus(folder)[0].getPath().getName()
    name = f"{int(clock.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder, name))
    return name


def put_batch(batch: DataFrame, path: str, table: str, batch_id: int, run: str = "0") -> None:
    batch.write.mode("overwrite").parquet(f"{path}/{table}/run={run}/batch={batch_id}")


def keyed(path: str, each: Callable[[DataFrame, int, str], None], hold: bool = True) -> Callable[[DataFrame, int], None]:
    """A batch function that knows its run; with ``hold`` its batch is computed once, however often it is used."""
    names: list[str] = []

    def run(batch: DataFrame, batch_id: int) -> None:
        if not names:
            names.append(run_name(batch.sparkSession, path))
        if not hold:
            return each(batch, batch_id, names[0])
        batch = batch.persist()
        try:
            each(batch, batch_id, names[0])
        finally:
            batch.unpersist()

    return run


PLACE = ("run", "batch")


def get_table(spark: SparkSession, path: str, table: str, schema) -> DataFrame:
    """All stored batches of a table, empty before the first one; ``run`` and ``batch`` are partition columns."""
    folder, fs = _folder(spark, f"{path}/{table}")
    if not fs.exists(folder):
        return spark.createDataFrame([], schema).withColumns({"run": F.lit("0"), "batch": F.lit(0)})
    return stored(spark, path, table)


def stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")
    return rows.withColumn("run", F.col("run").cast("string"))


def compact(spark: SparkSession, path: str, table: str, keys: Sequence[str], order: Sequence[Column] = ()) -> None:
    """Fold the batches of a table into one: the winning row of each key, under ``order`` and then the
    newest batch.  Rows move to a new folder before the old ones go, so an interruption leaves repeats, never gaps.

    Run it between the runs of the table's queries; keys resolve to the same rows before and after.
    """
    _, fs = _folder(spark, path)
    old = [s.getPath() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}/run=*/batch=*"))]
    if len(old) < 2:
        return
    kept = B.latest_wins(stored(spark, path, table), keys, [*order, F.desc("run"), F.desc("batch")])
    # In the newest run, before its batches: whatever that run or a later one adds still wins.
    run = max(f.getParent().getName() for f in old).removeprefix("run=")
    kept.drop(*PLACE).write.parquet(f"{path}/{table}/run={run}/batch=-{int(clock.time() * 1000)}")
    def age(folder) -> tuple[str, int]:
        return folder.getParent().getName(), int(folder.getName().removeprefix("batch="))
    for folder in sorted(old, key=age):  # oldest first, so that what is left wins at any time
        fs.delete(folder, True)


def upsert_sink(stream: DataFrame, path: str, **kw) -> StreamingQuery:
    """Idempotent keyed upsert of bars: deliveries are stored, ``upserted`` resolves them."""
    return start(stream, path, keyed(path, lambda df, i, run: put_batch(df, path, "bars", i, run)), **kw)


def upserted(spark: SparkSession, path: str, keys: Sequence[str] = B.BAR_KEY, seq: str = "ingest_seq") -> DataFrame:
    """Current bars: a final bar wins over a non-final one, then the later batch, then the later arrival."""
    return B.latest_wins(stored(spark, path, "bars"), keys, [F.desc("is_final"), F.desc("run"), F.desc("batch"), F.desc(seq)]).drop(*PLACE)


def snapshot_sink(stream: DataFrame, path: str, table: SnapshotTable, seq: str | None = "ingest_seq", prefer: Sequence[str] = ("is_final",), **kw) -> StreamingQuery:
    """Keyed upsert that rewrites the touched buckets of ``table``; its readers see whole batches only."""
    def each(batch: DataFrame, batch_id: int, run: str) -> None:
        table.upsert(batch, seq, prefer, (run, batch_id))

    return start(stream, path, keyed(path, each, hold=False), **kw)


def latest_sink(stream: DataFrame, path: str, **kw) -> StreamingQuery:
    """Changed keys of an update-mode aggregate per micro-batch."""
    return start(stream, path, keyed(path, lambda df, i, run: put_batch(df, path, "latest", i, run)), mode="update", **kw)


def latest_of(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return B.latest_wins(stored(spark, path, "latest"), keys, [F.desc("run"), F.desc("batch")]).drop(*PLACE)


def cutoff_collect(stream: DataFrame, path: str, time: str = "ts", arrived: str = "arrived_at", close_minutes: int = 45, **kw) -> StreamingQuery:
    """Rows that arrive by 45 minutes after their day's cutoff are kept; later ones become issues.

    Stateful operators drop late rows silently, so lateness is decided here, before any aggregation.
    """
    limit = F.date_trunc("day", F.col(time).cast("timestamp")) + F.expr(f"INTERVAL '1 00:{close_minutes}:00' DAY TO SECOND")
    late = F.col(arrived).cast("timestamp") > limit

    def each(batch: DataFrame, batch_id: int, run: str) -> None:
        put_batch(batch.where(~late), path, "kept", batch_id, run)
        put_batch(batch.where(late).withColumn("code", F.lit("DERIVATIVE_CUTOFF_INCOMPLETE")), path, "issues", batch_id, run)

    return start(stream, path, keyed(path, each), **kw)


def append_once(stream: DataFrame, path: str, keys: Sequence[str], day: str | None = None, **kw) -> StreamingQuery:
    """Append rows whose key is not stored yet, by any run; a key repeated inside a batch counts once.

    A batch that is replayed compares itself with every stored folder but its own.  ``day`` names a date or time
    among the keys: stored rows outside the batch's range of it cannot match and are skipped by file statistics.
    """
    def each(batch: DataFrame, batch_id: int, run: str) -> None:
        old = get_table(batch.sparkSession, path, "rows", batch.schema).where(~((F.col("run") == run) & (F.col("batch") == batch_id)))
        if day is not None:
            low, high = batch.agg(F.min(day), F.max(day)).first()
            if low is not None:
                old = old.where(F.col(day).between(F.lit(low), F.lit(high)) | F.col(day).isNull())
        put_batch(not_yet(batch.dropDuplicates(list(keys)), old, keys), path, "rows", batch_id, run)

    return start(stream, path, keyed(path, each), **kw)


def audited(stream: DataFrame, path: str, source: str, dataset: str, valid: Column, **kw) -> StreamingQuery:
    """Store valid rows and one run row per micro-batch: read, written, succeeded, deferred or failed.

    The counts are observed by the job that writes the rows, so a batch is read once and held nowhere.

    A failed batch leaves its row and stops the query; when it is repeated with success, the row is replaced.
    """
    def row(spark: SparkSession, batch_id: int, status: str, read: int, written: int) -> DataFrame:
        return spark.createDataFrame([(str(batch_id), source, dataset, status, read, written)],
                                     "run_id string, source string, dataset string, status string, records_read long, records_written long")

    def each(batch: DataFrame, batch_id: int, run: str) -> None:
        spark = batch.sparkSession
        try:
            read, written = observed(batch, valid, lambda rows: put_batch(rows, path, "rows", batch_id, run))
        except Exception:
            put_batch(row(spark, batch_id, "failed", 0, 0), path, "runs", batch_id, run)
            raise
        put_batch(row(spark, batch_id, "succeeded" if read else "deferred", read, written), path, "runs", batch_id, run)

    return start(stream, path, keyed(path, each, hold=False), **kw)
