"""Response index import and persistence."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chalkline.functions.keys import meta_key
from chalkline.sources.store import Store

META = ("struct<chapter_number:int,content_source:string,document_hash:string,intent:string,"
        "student_query:string,subject:string>")
ENTRY = f"struct<text:string,audio_path:string,meta:{META}>"
#: Buckets of a written index: about one for each 100 MB.
BUCKETS = 16
INDEX_SCHEMA = f"key string, text string, audio_path string, meta {META}, version long"


def load_response_index(spark: SparkSession, path: str, version: int = 0) -> DataFrame:
    """S3: import a JSON index file (one object: key -> entry).

    A missing or malformed file gives an empty index. ``key_matches`` tells
    whether the stored key equals the key recomputed from ``meta``. A JSON
    object cannot be split, so each file is one task; imported indexes are
    kept as parquet (S4) from then on."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], INDEX_SCHEMA + ", key_matches boolean")
    parsed = raw.select(F.explode(F.from_json("value", f"map<string,{ENTRY}>")).alias("key", "e"))
    return parsed.select("key", "e.text", "e.audio_path", "e.meta", F.lit(version).cast("long").alias("version"),
                         (F.col("key") == meta_key(F.col("e.meta"))).alias("key_matches"))


def _table(path: str) -> str:
    return "chalkline_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]


def write_response_index(df: DataFrame, base: str, version: int, buckets: int = BUCKETS) -> str:
    """Write the whole index (U1's merge) as one version, bucketed and sorted by key.

    A version has a folder of its own, never one that readers use, and can be
    read once its job committed; a retry of the same version rewrites the same
    folder. Rows of a key lie in the bucket that a join on key looks for them."""
    spark = df.sparkSession
    out = f"{base.rstrip('/')}/version={int(version)}/buckets={int(buckets)}"
    rows = df.select("key", "text", "audio_path", "meta", F.lit(int(version)).cast("long").alias("version"))
    spark.sql(f"DROP TABLE IF EXISTS {_table(out)}")
    # one writer per bucket, so a bucket is one sorted file
    (rows.repartition(int(buckets), "key").write.mode("overwrite").bucketBy(int(buckets), "key").sortBy("key").format("parquet")
     .option("path", out).saveAsTable(_table(out)))
    return out


def newest_version(spark: SparkSession, base: str) -> tuple[int, int] | None:
    """(version, buckets) of the newest committed version."""
    store = Store(spark, base)
    for version in reversed(store.ids("", "version=")):
        for buckets in store.ids(f"version={version}", "buckets="):
            if store.complete(f"version={version}", f"buckets={buckets}"):
                return version, buckets
    return None


def read_index(spark: SparkSession, base: str) -> DataFrame:
    """The newest committed version, as a table that knows its buckets: a lookup by key (J2) does not shuffle it."""
    found = newest_version(spark, base)
    if found is None:
        return spark.createDataFrame([], INDEX_SCHEMA)
    out = f"{base.rstrip('/')}/version={found[0]}/buckets={found[1]}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_table(out)} (key STRING, text STRING, audio_path STRING, meta {META}, version BIGINT) "
              f"USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {found[1]} BUCKETS LOCATION '{out}'")
    return spark.read.table(_table(out))
