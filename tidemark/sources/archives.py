"""Vendor archives: zipped CSV members decoded next to the data, everything after that is columns."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import norm_epoch
from tidemark.schemas import FUNDING_REQUIRED, KLINE_COLUMNS, METRICS_REQUIRED

CHUNK = 20_000
LINES = "path string, digest string, line_no long, header string, line string"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of the single CSV member of each archive with the archive's digest, streamed in chunks."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            digest = hashlib.sha256(content).hexdigest()
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = [n for n in archive.namelist() if n.endswith(".csv")]
                if len(names) != 1:
                    raise ValueError(f"{path}: an archive must contain exactly one CSV file")
                with archive.open(names[0]) as member:
                    header, lines, start = None, [], 0
                    for number, raw in enumerate(io.TextIOWrapper(member, "utf-8")):
                        line = raw.rstrip("\r\n")
                        header = line if header is None else header
                        lines.append(line)
                        if len(lines) == CHUNK:
                            yield pd.DataFrame({"path": path, "digest": digest, "line_no": range(start, number + 1), "header": header, "line": lines})
                            lines, start = [], number + 1
                    if lines:
                        yield pd.DataFrame({"path": path, "digest": digest, "line_no": range(start, start + len(lines)), "header": header, "line": lines})


def zip_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every archive under the path; listing is distributed, one file is one row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")


ARCHIVE = r"^([A-Za-z0-9_]+)-([0-9a-zA-Z]+)-(\d{4}-\d{2})[^/]*\.zip$"
FILES = "path string, modificationTime timestamp, length long, content binary"


def named_archives(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(path, asset_id, interval, month, content) of the archives below a path, what they are about read off their names.

    The three columns come from file metadata alone: a filter on them is applied when files are listed, so archives of
    other assets, intervals or months are not opened.  Names of another form have empty columns.  As a ``stream`` each
    archive is delivered once, the files seen being the offset.
    """
    reader = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1000) if stream else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    about = {c: F.regexp_extract("_metadata.file_name", ARCHIVE, k + 1) for k, c in enumerate(("asset_id", "interval", "month"))}
    return files.select("path", *[e.alias(c) for c, e in about.items()], "content")


def zip_lines(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_decode, LINES)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Unzipped CSV as splittable text; the header of each file is recognised by content."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def _file_part(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract("path", pattern, group)


def _typed_klines(lines: DataFrame, *also: str) -> DataFrame:
    """Positional columns of data lines; a header line has no digits in front and is dropped."""
    cells = F.split("line", ",")
    df = lines.where(F.col("line").rlike("^[0-9]+,")).select("path", *also, *[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(KLINE_COLUMNS)])
    doubles = [c for c in KLINE_COLUMNS if c not in ("open_time", "close_time", "trade_count", "ignore")]
    return df.select("path", *also, norm_epoch(F.col("open_time")).alias("open_time"), norm_epoch(F.col("close_time")).alias("close_time"),
                     *[F.col(c).cast("double").alias(c) for c in doubles], F.col("trade_count").cast("long").alias("trade_count"))


NAME = r"([A-Za-z0-9_]+)-([0-9a-zA-Z]+)-\d{4}-\d{2}[^/]*$"


def read_kline_archives(files: DataFrame, source: str = "spot_archive") -> DataFrame:
    """Spot klines: bars with asset and interval from the file name and the archive's checksum as lineage."""
    bars = _typed_klines(zip_lines(files), "digest").withColumnRenamed("digest", "source_checksum")
    return bars.select(_file_part(NAME, 1).alias("asset_id"), _file_part(NAME, 2).alias("interval"), *[c for c in bars.columns if c != "path"],
                       F.lit(source).alias("source"), F.col("close_time").alias("available_at"), F.lit(True).alias("is_final"))


def read_futures_klines(lines: DataFrame, data_type: str, asset: str = r"([A-Za-z0-9_]+)-[0-9a-zA-Z]+-[^/]*$") -> DataFrame:
    """Futures or premium-index klines, header optional."""
    bars = _typed_klines(lines)
    return bars.select(_file_part(asset).alias("asset_id"), F.lit(data_type).alias("data_type"), *[c for c in bars.columns if c != "path"],
                       F.col("close_time").alias("available_at"))


def _by_header(lines: DataFrame, required: Sequence[str], kind: str) -> DataFrame:
    """Named columns of files whose first line is a header; a missing required column fails the job."""
    names, cells = F.split("header", ","), F.split("line", ",")
    missing = F.array_except(F.array(*[F.lit(c) for c in required]), names)
    check = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit(f"{kind} archive is missing columns: "), F.array_join(missing, ", "))).cast("boolean"))
    data = lines.withColumn("_ok", F.coalesce(check, F.lit(True))).where(F.col("_ok") & (F.col("line") != F.col("header")))
    return data.select("path", *[F.try_element_at(cells, F.array_position(names, c).cast("int")).alias(c) for c in required])


def read_funding(lines: DataFrame, asset: str = r"([A-Za-z0-9_]+)-fundingRate-[^/]*$") -> DataFrame:
    df = _by_header(lines, FUNDING_REQUIRED, "funding")
    return df.select(_file_part(asset).alias("asset_id"), norm_epoch(F.col("calc_time")).alias("calc_time"),
                     F.col("last_funding_rate").cast("double").alias("last_funding_rate"), norm_epoch(F.col("calc_time")).alias("available_at"))


def read_metrics(lines: DataFrame, asset: str = r"([A-Za-z0-9_]+)-metrics-[^/]*$") -> DataFrame:
    df = _by_header(lines, METRICS_REQUIRED, "metrics")
    return df.select(_file_part(asset).alias("asset_id"), F.to_timestamp("create_time").alias("create_time"),
                     *[F.col(c).cast("double").alias(c) for c in METRICS_REQUIRED[1:]], F.to_timestamp("create_time").alias("available_at"))


def with_header(lines: DataFrame, header: str) -> DataFrame:
    """Text lines read by Spark with the agreed header of their files."""
    return lines.withColumn("header", F.lit(header))


def read_macro(lines: DataFrame, series: str) -> DataFrame:
    """Two-column macro CSV; the header must be exactly (observation_date, series), text values become NULL."""
    want = f"observation_date,{series}"
    head = F.col("line").startswith("observation_date")
    check = F.when(head & (F.col("line") != want), F.raise_error(F.lit(f"unexpected columns for {series}")).cast("boolean"))
    data = lines.withColumn("_ok", F.coalesce(check, F.lit(True))).where(F.col("_ok") & ~head)
    cells = F.split("line", ",")
    return data.select(F.lit(series).alias("series"), F.to_timestamp(F.get(cells, F.lit(0))).alias("observation_date"),
                       F.expr("try_cast(get(split(line, ','), 1) as double)").alias("value"))


# --- integrity -----------------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def checksum_faults(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, expected, actual) of manifest entries whose file is missing or differs; empty when all is well."""
    actual = files.select(file_name(F.col("path")).alias("file"), F.sha2("content", 256).alias("actual"))
    both = manifest.select("file", F.lower(F.split(F.trim("sha256"), r"\s+")[0]).alias("expected")).join(actual, "file", "left")
    return both.where(F.col("actual").isNull() | (F.col("actual") != F.col("expected")))


def verify_checksums(files: DataFrame, manifest: DataFrame) -> None:
    """Abort when any file deviates from the manifest (the faults are looked at one row at a time)."""
    bad = checksum_faults(files, manifest).limit(1).collect()
    if bad:
        raise ValueError(f"checksum mismatch for {bad[0]['file']}: expected {bad[0]['expected']}, received {bad[0]['actual']}")


def lineage_faults(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose processed rows do not carry exactly the raw file's checksum.

    ``raw`` is (file, sha256), ``processed`` any table with (file, source_checksum).
    """
    stored = processed.groupBy("file").agg(F.count_distinct("source_checksum").alias("checksums"), F.min("source_checksum").alias("stored"),
                                           F.count(F.lit(1)).alias("rows"))
    both = raw.join(stored, "file")
    return both.where((F.col("checksums") != 1) | (F.col("stored") != F.col("sha256")))
