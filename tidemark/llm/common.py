"""Shared small pieces of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """A batch in parts of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` of text; a longer text is a part of its own.

    Spark bounds what arrives by bytes; this bounds what a worker makes of it at once.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and (k - start >= BATCH_ROWS or held + size > BATCH_BYTES):
            yield batch.slice(start, k - start), texts.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start), texts.slice(start)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows kept out of learning; a missing id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable], whole: bool = False) -> DataFrame:
    """One Arrow pass over the texts: ``make()`` runs once per task and returns texts -> iterable of value tuples.

    The result holds ``doc_id``, or with ``whole`` the entire row as the struct ``row``, and the values; only what it
    holds is read.  Repeated rows stay repeated.
    """
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    carried = df.select(F.struct("*").alias("row")) if whole else df.select("doc_id", "text")
    first, place = carried.schema.fields[0], df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = make()
        for arrived in batches:
            for batch, texts in slices(arrived, arrived.column(0).field(place) if whole else arrived.column(1)):
                values = list(many(texts.to_pylist()))
                arrays = [pa.array(c, type=ARROW[kind]) for c, (_, kind) in zip(zip(*values), fields)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [first.name, *(n for n, _ in fields)])

    return carried.mapInArrow(run, f"{first.name} {first.dataType.simpleString()}, {schema}")


def rows_where(mapped: DataFrame, keep: Column, columns: list[str]) -> DataFrame:
    """The original rows of a ``whole`` pass for which the verdict holds."""
    return mapped.where(keep).select(*[F.col("row").getField(c).alias(c) for c in columns])


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()),
}
