"""Writers: versioned datasets, JSON reports, audited writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def stamp_version(df: DataFrame, version: str) -> DataFrame:
    return df.withColumn("dataset_version", F.lit(version))


def write_dataset(df: DataFrame, path: str, version: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """One zstd parquet dataset stamped with its version.

    Rows are clustered by the partition columns first, so each partition gets few files instead of one
    per task; AQE splits a skewed partition value over several writers.
    """
    out = stamp_version(df, version)
    if partition_by:
        out = out.hint("rebalance", *partition_by)
    out.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def report_json(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One JSON document per row of a (small, already aggregated) report."""
    return df.select(*by, F.to_json(F.struct(*[c for c in df.columns if c not in by])).alias("document"))


def write_report(df: DataFrame, path: str) -> None:
    report_json(df).select(F.col("document").alias("value")).write.text(path)


def audit_row(run_id: str, source: str, dataset: str, started: Column, completed: Column, counts: DataFrame,
              status: str = "succeeded", error: str | None = None) -> DataFrame:
    """Ingestion-run row from a one-row frame with records_read and records_written."""
    return counts.select(
        F.lit(run_id).alias("run_id"), F.lit(source).alias("source"), F.lit(dataset).alias("dataset"), started.alias("started_at"),
        completed.alias("completed_at"), F.lit(status).alias("status"), F.col("records_read").cast("long").alias("records_read"),
        F.col("records_written").cast("long").alias("records_written"), F.lit(error).cast("string").alias("error"))


def observed(df: DataFrame, valid: Column, write: Callable[[DataFrame], None]) -> tuple[int, int]:
    """Write the valid rows; how many rows were read and written is counted by that same job."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(valid).alias("written")).where(valid))
    counts = seen.get
    return counts.get("read") or 0, counts.get("written") or 0


def audited_write(df: DataFrame, path: str, valid: Column, run_id: str, source: str, dataset: str, started: Column) -> DataFrame:
    """Write the valid rows below ``path`` and give the run's row; a failed write leaves its row in ``path`` and is raised."""
    spark = df.sparkSession

    def row(status: str, read: int, written: int, error: str | None = None) -> DataFrame:
        counts = spark.createDataFrame([(read, written)], "records_read long, records_written long")
        out = audit_row(run_id, source, dataset, started, F.current_timestamp(), counts, status, error)
        out.write.mode("overwrite").parquet(f"{path}/runs/run_id={run_id}")
        return spark.read.schema(out.schema).option("basePath", f"{path}/runs").parquet(f"{path}/runs/run_id={run_id}")
    try:
        read, written = observed(df, valid, lambda rows: rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows/run_id={run_id}"))
    except Exception as failure:
        row("failed", 0, 0, str(failure)[:1000])
        raise
    return row("succeeded" if read else "deferred", read, written)
