"""The table of detections, kept between runs: one result, of one or more rows, for each cache key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.session import written

#: Hexadecimal digits of a key that name its partition.
DIGITS = 2
PREFIX, VERSION = "key_prefix", "saved_version"


def _prefix() -> F.Column:
    return F.substring("cache_key", 1, DIGITS)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """None where nothing was saved yet."""
    try:
        return spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def save(rows: DataFrame, path: str, version: int | None = None) -> None:
    """Replaces the results of the rows' cache keys: all rows that a key had go, those given come. Other keys stay.

    Saves of one version may be made again and change nothing; a save of a lower version than a key's result has leaves that as it is, so
    the last version wins in whatever order saves are made. Without a version a save wins over all before it. Only partitions of the keys
    given are read and written anew, each replaced when all of it is there. Rows without a cache key are left out. A result without
    rows can't be told from none: save it as one row of nulls. One save at a time writes to a table.
    """
    spark = rows.sparkSession
    new = written(rows.filter("cache_key is not null").withColumn(PREFIX, _prefix()), "saved")
    touched = [r[0] for r in new.select(PREFIX).distinct().collect()]  # 256 at most
    if not touched:
        return
    old = _table(spark, path)
    if old is not None:
        old = old.withColumn(PREFIX, F.lpad(F.col(PREFIX).cast("string"), DIGITS, "0")).filter(F.col(PREFIX).isin(touched))
        if version is None:
            version = (old.agg(F.max(VERSION)).first()[0] or 0) + 1
        newer = old.filter(F.col(VERSION) > version).select("cache_key").distinct()
        keys = new.select("cache_key").distinct().join(newer, "cache_key", "left_anti")
        put = new.join(newer, "cache_key", "left_anti").withColumn(VERSION, F.lit(version).cast("long"))
        new = written(old.join(keys, "cache_key", "left_anti").unionByName(put, allowMissingColumns=True), "merged")
    else:
        new = new.withColumn(VERSION, F.lit(version or 0).cast("long"))
    writer = new.hint("rebalance", PREFIX).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(PREFIX).parquet(path)


def load(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Saved rows of the keys; the prefix joins too, so partitions are pruned at run time."""
    table = _table(spark, path)
    if table is None:
        raise FileNotFoundError(path)
    wanted = keys.select("cache_key", _prefix().alias(PREFIX)).distinct()
    table = table.withColumn(PREFIX, F.lpad(F.col(PREFIX).cast("string"), DIGITS, "0"))
    return table.join(wanted, [PREFIX, "cache_key"], "left_semi").drop(PREFIX, VERSION)


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: each batch is a save with its number as version, so one that runs again, as after a restart, changes
    nothing, and of a key that comes in several batches the last one's result stays."""
    return lambda batch, batch_id: save(batch, path, batch_id)
