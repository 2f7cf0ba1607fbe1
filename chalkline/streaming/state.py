"""Keyed state of a stream, kept in bucketed parquet folders under one root.

A micro-batch reads the newest value of its own keys only, and writes the
values it changes:

* ``deltas/version=<batch>/bucket=<b>/``: what a batch wrote. Keys are dealt
  over buckets by their hash;
* ``snapshots/upto=<batch>/bucket=<b>/``: the newest value of every key of a
  bucket, written every ``every`` batches, for the buckets that changed since;
* ``manifests/upto=<batch>/``: which snapshot each bucket has, how many rows,
  and how many buckets there are. It makes a compaction valid.

A batch reads the newest manifest older than itself, the snapshots of its keys'
buckets, and these buckets' part of the deltas since, all by name; a missing
delta is an error. Buckets double once they hold ``bucket_rows`` rows on
average, so what one key costs does not grow with the state.

All writes are named by the batch id and overwrite, so a retried batch rewrites
the same folders with the same result. A compaction deletes what neither its
own manifest nor the one before needs (a retry of its batch reads the latter).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.sources.store import Store

COMPACT_EVERY = 20
BUCKETS, BUCKET_ROWS = 64, 100_000
_MANIFEST = "bucket int, upto long, rows long, buckets int"


class MissingDelta(RuntimeError):
    """A batch's values are not where the state says they are."""


class KeyedState:
    """The newest row of every key, as of the end of each batch."""

    def __init__(self, root: str, key: str, values: str, every: int = COMPACT_EVERY, buckets: int = BUCKETS,
                 bucket_rows: int = BUCKET_ROWS):
        """key, values: column definitions, as ``key string`` and ``text string, n long``."""
        self.root, self.every, self.buckets, self.bucket_rows = root, every, buckets, bucket_rows
        self.schema, self.key = f"{key}, {values}, version long", key.split()[0]

    def _manifest(self, spark: SparkSession, store: Store, batch_id: int) -> tuple[int, int, dict[int, tuple[int, int]]]:
        """(batch, number of buckets, {bucket: (snapshot, rows)}) of the newest complete manifest before ``batch_id``."""
        for upto in reversed([i for i in store.ids("manifests", "upto=") if i < batch_id]):
            if store.complete("manifests", f"upto={upto}"):
                rows = spark.read.schema(_MANIFEST).parquet(store.at("manifests", f"upto={upto}")).collect()  # a row per bucket
                return upto, rows[0]["buckets"], {r["bucket"]: (r["upto"], r["rows"]) for r in rows if r["upto"] is not None}
        return -1, self.buckets, {}

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _deltas(self, spark: SparkSession, store: Store, versions: range) -> DataFrame | None:
        names = [("deltas", f"version={v}") for v in versions]
        if missing := [n for n in names if not store.complete(*n)]:
            raise MissingDelta(f"no complete delta at {store.at(*missing[0])}")
        if not names:
            return None
        return spark.read.schema(f"{self.schema}, bucket int").option("basePath", store.at("deltas")).parquet(*[store.at(*n) for n in names])

    def _snapshots(self, spark: SparkSession, store: Store, placed: dict[int, tuple[int, int]], buckets: list[int]) -> DataFrame | None:
        folders = [store.at("snapshots", f"upto={placed[b][0]}", f"bucket={b}") for b in buckets if b in placed]
        return spark.read.schema(self.schema).parquet(*folders) if folders else None

    def _newest(self, parts: list[DataFrame]) -> DataFrame:
        columns = [c for c in parts[0].columns if c not in (self.key, "bucket")]
        rows = reduce(DataFrame.unionByName, [p.select(self.key, *columns) for p in parts])
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "version").alias("_row"))
        return best.select(self.key, *[F.col(f"_row.{c}").alias(c) for c in columns])

    def before(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """The newest row (with ``version``, the batch that wrote it) of those ``keys`` that have one before ``batch_id``."""
        spark = keys.sparkSession
        store = Store(spark, self.root)
        upto, n, placed = self._manifest(spark, store, batch_id)
        own = keys.select(self.key).distinct()
        touched = [r["bucket"] for r in own.select(self._bucket(n).alias("bucket")).distinct().collect()]     # at most n numbers
        parts = [p for p in (self._snapshots(spark, store, placed, touched), self._deltas(spark, store, range(upto + 1, batch_id))) if p is not None]
        parts = [p.filter(F.col("bucket").isin(touched)) if "bucket" in p.columns else p for p in parts]
        if not parts or not touched:
            return spark.createDataFrame([], self.schema)
        found = [p.join(own, self.key, "left_semi") for p in parts]
        return self._newest(found)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Rows (one per key, without version) that ``batch_id`` sets."""
        spark = rows.sparkSession
        store = Store(spark, self.root)
        upto, n, placed = self._manifest(spark, store, batch_id)
        out = rows.withColumns({"version": F.lit(batch_id).cast("long"), "bucket": self._bucket(n)})
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(store.at("deltas", f"version={batch_id}"))
        if (batch_id + 1) % self.every == 0:
            self._compact(spark, store, batch_id, upto, n, placed)

    def _compact(self, spark: SparkSession, store: Store, batch_id: int, upto: int, n: int, placed: dict[int, tuple[int, int]]) -> None:
        deltas = self._deltas(spark, store, range(upto + 1, batch_id + 1))
        changed = [r["bucket"] for r in deltas.select("bucket").distinct().collect()]                         # at most n numbers
        if sum(rows for _, rows in placed.values()) > n * self.bucket_rows:
            changed, n = sorted({*changed, *placed}), 2 * n
            kept = {}
        else:
            kept = {b: x for b, x in placed.items() if b not in changed}
        old = self._snapshots(spark, store, placed, changed)
        folder = store.at("snapshots", f"upto={batch_id}")
        merged = self._newest([deltas] if old is None else [old, deltas])
        merged.withColumn("bucket", self._bucket(n)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = spark.read.schema(f"{self.schema}, bucket int").option("basePath", folder).parquet(folder)
        sizes = {r["bucket"]: r["count"] for r in written.groupBy("bucket").count().collect()}                # a row per bucket
        entries = [(b, u, rows, n) for b, (u, rows) in {**kept, **{b: (batch_id, rows) for b, rows in sizes.items()}}.items()]
        manifest = spark.createDataFrame(entries or [(0, None, 0, n)], _MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(store.at("manifests", f"upto={batch_id}"))
        named = {u for _, u, _, _ in entries} | {u for u, _ in placed.values()}
        for i in store.ids("snapshots", "upto="):
            if i not in named and i < batch_id:
                store.delete("snapshots", f"upto={i}")
        for folder, prefix, last in (("deltas", "version=", upto), ("manifests", "upto=", upto - 1)):
            for i in store.ids(folder, prefix):
                if i <= last:
                    store.delete(folder, f"{prefix}{i}")
