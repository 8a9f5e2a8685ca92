"""Scans and sinks: Parquet, JSON lines, CSV, pinned snapshots, articles; artefacts are never overwritten."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks_for(df: DataFrame, rows: int) -> int:
    """At least as many tasks as there are cores, and one for each so many rows."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / rows))


def spread(df: DataFrame, *by: str, rows: int = 20_000) -> DataFrame:
    """Rows dealt by key over ``tasks_for``: for texts that cost more than their bytes tell, by which Spark sizes its tasks."""
    return df.repartition(tasks_for(df, rows), *by)


def json_lines(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """Blank lines are skipped. A malformed line fails the scan, or, if ``tolerant``, lands in ``_corrupt_record``."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    columns = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{columns}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def csv_corpus(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV corpus with a header and quoted multi-line texts; the article id must be a column."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles with an ``error`` each: a field missing, an id used twice, or a date that is not ISO; null if sound."""
    rows = spark.read.schema("article_idx string, title string, article_text string, date string, source_url string").json(path)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    twice = rows.groupBy(F.col("article_idx").alias("_id")).agg((F.count("*") > 1).alias("twice"))
    missing = blank("article_idx") | blank("title") | blank("article_text") | blank("date")
    iso = F.to_date(F.try_to_timestamp(F.col("date")))
    marked = rows.join(twice, F.col("article_idx").eqNullSafe(F.col("_id")))
    error = F.when(missing, "FIELD_MISSING").when(F.col("twice"), "DUPLICATE_ID").when(iso.isNull(), "DATE_INVALID")
    return marked.select("article_idx", "title", "article_text", iso.alias("date"), "source_url", error.alias("error"))


def snapshot(df: DataFrame, snapshot_id: str) -> DataFrame:
    """Rows of one release; with the table partitioned by it, other releases are not read."""
    return df.where(F.col("snapshot_id") == snapshot_id)


def rows_for_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``keys``: a semi-join, so keys may repeat and be many."""
    return df.join(keys.select(key), key, "left_semi")


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write an artefact as Parquet; an existing one is an error, never replaced."""
    df.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(path)


def publish_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``; on one machine without it, a temporary one), removed when the driver exits."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veristrata-files-")
    path = f"{base}/veristrata-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        return
