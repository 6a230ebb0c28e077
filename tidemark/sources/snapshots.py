"""Keyed tables that are updated by rewriting only the buckets an upsert touches.

Rows lie in buckets by a hash of some expressions of their keys.  An upsert reads the buckets its rows fall into, merges
and writes them to a new folder, and then puts a new manifest beside the old ones; a manifest names the folder of every
bucket.  Readers take the newest manifest, so they see the state before or after an upsert and never a part of it, and a
frame that was read keeps its files until they are vacuumed.  Two writers that start from one manifest cannot both
commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import bars as B
from tidemark.session import stage


class Conflict(RuntimeError):
    """Another writer has committed since this upsert read the table."""


@dataclass(frozen=True)
class Manifest:
    """``folders`` by bucket, and the last batch that each run of a stream has put in."""

    version: int = 0
    schema: dict | None = None
    folders: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


@dataclass
class SnapshotTable:
    """``by`` are expressions of the keys; add one of the time to ``keys``' asset so that a hot asset fills many buckets."""

    spark: SparkSession
    path: str
    keys: Sequence[str]
    by: Sequence[str]
    buckets: int = 64

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest or that of a version; an empty one before the first upsert."""
        known = self._versions()
        if version is None and not known:
            return Manifest()
        file, fs = self._fs(f"{self.path}/manifests/{version if version is not None else known[-1]:012d}.json")
        stream = fs.open(file)
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, manifest: Manifest) -> None:
        """Write beside, then rename to a name that must not exist yet."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        draft, fs = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(vars(manifest)).encode()))
        out.close()
        final, _ = self._fs(f"{self.path}/manifests/{manifest.version:012d}.json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(draft, final, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as failure:
            fs.delete(draft, False)
            if not fs.exists(final):
                raise
            raise Conflict(f"version {manifest.version} is already committed") from failure

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*[F.expr(e) for e in self.by]), F.lit(self.buckets)).cast("int"))

    def _rows(self, manifest: Manifest, buckets: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(manifest.schema)
        folders = [f"{self.path}/{manifest.folders[b]}" for b in buckets if b in manifest.folders]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; an error before the first upsert."""
        manifest = self.manifest(version)
        if manifest.schema is None:
            raise ValueError(f"{self.path} holds no rows yet")
        return self._rows(manifest, sorted(manifest.folders))

    def upsert(self, incoming: DataFrame, seq: str | None = None, prefer: Sequence[str] = (), batch: tuple[str, int] | None = None) -> Manifest:
        """Merge rows by key: the greatest of ``prefer`` wins, then an incoming row over a stored one, the last by ``seq``.

        ``batch`` (run, number) makes a repeated delivery change nothing.  Incoming rows must have the stored columns.
        Null keys are equal to each other; no rows leave the table as it is.
        """
        old = self.manifest()
        if batch is not None and old.applied.get(batch[0], -1) >= batch[1]:
            return old
        schema = T.StructType.fromJson(old.schema) if old.schema else incoming.schema
        fresh = stage(self.bucketed(incoming.select(*schema.names)))
        touched = [str(r["bucket"]) for r in fresh.select("bucket").distinct().collect()]  # at most the number of buckets
        applied = old.applied | ({batch[0]: batch[1]} if batch is not None else {})
        folders = dict(old.folders)
        if touched:
            arrival = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
            both = fresh.withColumn("_seq", F.coalesce(arrival, F.lit(0).cast("long")))
            if old.schema:
                both = both.unionByName(self.bucketed(self._rows(old, touched)).withColumn("_seq", F.lit(-(1 << 62)).cast("long")))
            kept = B.latest_wins(both, self.keys, [*[F.desc(c) for c in prefer], F.desc("_seq")]).drop("_seq")
            folder = f"data/{uuid.uuid4().hex}"
            kept.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
            folders |= {b: f"{folder}/bucket={b}" for b in touched}
        new = Manifest(old.version + 1, json.loads(schema.json()), folders, applied)
        try:
            self._commit(new)
        except Conflict:
            if touched:
                self._delete(folder)
            raise
        return new

    def _delete(self, name: str) -> None:
        folder, fs = self._fs(f"{self.path}/{name}")
        fs.delete(folder, True)

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the newest ``keep`` versions and the folders that only they name."""
        if keep < 1:
            raise ValueError("keep must be at least 1")
        known = self._versions()
        gone, left = known[:-keep], [self.manifest(v) for v in known[-keep:]]
        used = {f for m in left for f in m.folders.values()}
        stale = {f for v in gone for f in self.manifest(v).folders.values()} - used
        for v in gone:
            self._delete(f"manifests/{v:012d}.json")
        whole = {f.rsplit("/", 1)[0] for f in stale} - {f.rsplit("/", 1)[0] for f in used}
        for f in sorted(whole | {f for f in stale if f.rsplit("/", 1)[0] not in whole}):
            self._delete(f)
