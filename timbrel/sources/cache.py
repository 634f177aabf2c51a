"""A versioned cache of feature vectors, bucketed by key.

The cache is one Parquet table, partitioned by speaker, encoder and version and bucketed by a file's key
(name, length, time), at a path that machines share.  A writer fills a version of its own, in a folder of
its own, so writers do not collide and one that is run again does no harm; then a manifest names the
version, and only versions that have one are read.  Keys lie in their buckets already,
so neither looking for misses nor taking one row of each key shuffles the cache.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("filename", "length", "modified")
BUCKETS = 32


def _part(value: str) -> str:
    """A partition's name: never empty, never a number, of letters and digits alone."""
    return "x" + value.encode().hex()


class FeatureCache:
    """Vectors ``v`` by key, speaker and encoder, at ``path``; all sessions of one path take one number of ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self._added: set[tuple[str, str, str]] = set()  # partitions that the session's table knows
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._store = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = self._store.makeQualified(self._path(path)).toString().rstrip("/")
        noted = self._noted("_layout.json")
        self.buckets = noted["buckets"] if noted else buckets
        if not noted:
            self._note("_layout.json", {"buckets": buckets})
        self.table = "timbrel_cache_" + hashlib.md5(f"{self.path} {self.buckets}".encode()).hexdigest()
        where = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (filename STRING, length BIGINT, modified TIMESTAMP, v ARRAY<DOUBLE>, speaker STRING, encoder STRING, version STRING) USING parquet PARTITIONED BY (speaker, encoder, version) CLUSTERED BY ({', '.join(KEYS)}) SORTED BY ({', '.join(KEYS)}) INTO {self.buckets} BUCKETS LOCATION '{where}'")

    def _noted(self, name: str) -> dict | None:
        at = self._path(f"{self.path}/{name}")
        if not self._store.exists(at):
            return None
        stream = self._store.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _note(self, name: str, value: dict) -> None:
        """Written beside its place and renamed, so a reader sees all of it or nothing."""
        aside, at = self._path(f"{self.path}/_{uuid.uuid4().hex}.part"), self._path(f"{self.path}/{name}")
        stream = self._store.create(aside, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        self._store.mkdirs(at.getParent())
        if not self._store.rename(aside, at):
            self._store.delete(aside, False)
            if not self._store.exists(at):
                raise OSError(f"cannot write {at}")

    def versions(self, speaker: str, encoder: str) -> list[str]:
        """Versions with a manifest, in order of name."""
        at = self._path(f"{self.path}/_manifest/{_part(speaker)}/{_part(encoder)}")
        return sorted(s.getPath().getName().removesuffix(".json") for s in self._store.listStatus(at)) if self._store.exists(at) else []

    def _rows(self, speaker: str, encoder: str) -> DataFrame:
        known, s, e = self.versions(speaker, encoder), _part(speaker), _part(encoder)
        fresh = [v for v in known if (s, e, v) not in self._added]
        if fresh:
            self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS " + " ".join(f"PARTITION (speaker = '{s}', encoder = '{e}', version = '{v}')" for v in fresh))
            self._added |= {(s, e, v) for v in fresh}
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table).where((F.col("speaker") == s) & (F.col("encoder") == e) & F.col("version").isin(known))

    def read(self, speaker: str, encoder: str) -> DataFrame:
        """(filename, length, modified, v): one row a key, of the last version by name that has it."""
        rows = self._rows(speaker, encoder)
        return rows.groupBy(*KEYS).agg(F.max_by("v", "version").alias("v"))

    def misses(self, files: DataFrame, speaker: str, encoder: str) -> DataFrame:
        """The rows of ``files`` (with the key's columns) that the cache does not have; only they are dealt out, to the cache's buckets.  A file with a null in its key always is a miss."""
        known = self._rows(speaker, encoder).select(*[F.col(k).alias(f"known_{k}") for k in KEYS])
        same = [files[k] == known[f"known_{k}"] for k in KEYS]
        return files.join(known.hint("shuffle_hash"), same, "left_anti")

    def write(self, rows: DataFrame, speaker: str, encoder: str, version: str | None = None) -> str:
        """Keep (filename, length, modified, v) as one version, visible at once when all of it is there."""
        version = version or uuid.uuid4().hex
        # a table of its own at the version's place: writers of one cache share no folder
        own = f"{self.table}_{uuid.uuid4().hex}"
        named = rows.select(*KEYS, F.col("v").cast("array<double>").alias("v")).repartition(self.buckets, *KEYS)
        place = f"{self.path}/speaker={_part(speaker)}/encoder={_part(encoder)}/version={_part(version)}"
        named.write.mode("overwrite").format("parquet").bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", place).saveAsTable(own)
        self.spark.sql(f"DROP TABLE {own}")  # its files stay
        self._note(f"_manifest/{_part(speaker)}/{_part(encoder)}/{_part(version)}.json", {"version": version})
        return version
