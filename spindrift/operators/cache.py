"""Cached file summaries, keyed by path, time of change and the settings they were made with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def settings_key(*settings: str) -> Column:
    return F.sha2(F.concat_ws("\0", *[F.lit(s) for s in settings]), 256)


def looked_up(files: DataFrame, cache: DataFrame | None, settings: Column) -> DataFrame:
    """files (rel_path, mtime, ...) with cached_content, null where the cache has nothing current."""
    files = files.withColumn("settings", settings)
    if cache is None:
        return files.withColumn("cached_content", F.lit(None).cast("string"))
    return files.join(cache.select("rel_path", "mtime", "settings", "cached_content"), ["rel_path", "mtime", "settings"], "left")


def merged(cache: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The cache with fresh rows (rel_path, mtime, settings, cached_content) over older ones of their path and settings."""
    rows = fresh.withColumn("_new", F.lit(1))
    if cache is not None:
        rows = rows.unionByName(cache.withColumn("_new", F.lit(0)))
    first = F.row_number().over(Window.partitionBy("rel_path", "settings").orderBy(F.col("_new").desc(), F.col("mtime").desc()))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n", "_new")


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache at a path, or None where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def save(cache: DataFrame, path: str) -> None:
    """Write a version beside the last one; nothing is written for an empty cache."""
    if not cache.isEmpty():
        cache.write.mode("overwrite").parquet(path)
