"""The engine's tables, derived from the tables at hand, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.operators import ordered, signal
from ostinato.params import Detection

#: 2024-01-01 in microseconds.
EPOCH_US = 1_704_067_200_000_000
DETECT = Detection(precision=2, block_size=100, threshold=0.15, focus_idx=58, classes=64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as score frames: 100 to a block, two blocks to a source."""
    v = F.col("vec_id")
    source = F.concat(F.lit("rec"), F.floor(v / 200).cast("string"))
    return table(spark, sf_dir, "embeddings").select(
        source.alias("source_key"), F.floor(v / 100).cast("long").alias("block_no"), (v % 100).cast("int").alias("frame_no"), F.col("embedding").alias("scores")
    )


FRAMES = """frames AS (SELECT 'rec' || (vec_id // 200) AS source_key, vec_id // 100 AS block_no, (vec_id % 100)::INT AS frame_no, embedding AS scores,
  embedding[59]::DOUBLE AS score FROM embeddings)"""
BUCKETS = FRAMES + """, buckets AS (SELECT source_key, block_no, (frame_no // 2)::BIGINT AS bucket, max(score) AS score FROM frames GROUP BY ALL)"""
ISLANDS = BUCKETS + """, hits AS (SELECT * FROM buckets WHERE score > 0.15),
isl AS (SELECT *, bucket - row_number() OVER (PARTITION BY source_key, block_no ORDER BY bucket) AS island FROM hits),
agg AS (SELECT source_key, block_no, island, min(bucket) AS first_bucket, max(bucket) AS last_bucket, round(max(score), 6) AS pred FROM isl GROUP BY ALL)"""


def intervals(spark: SparkSession, sf_dir: str, scale: float = 20.0) -> DataFrame:
    """Events as segments of one source for each event type."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_key"), F.col("event_id").alias("ordinal"), at.alias("start_s"), (at + F.col("value") * scale).alias("end_s"),
        ((F.col("event_id") % 100) / F.lit(100.0)).alias("pred"), F.when(F.col("event_id") % 3 == 0, "new").otherwise("original").alias("kind"),
        (F.col("event_id") % 7 == 0).alias("suspect"), "user_id",
    )


def segments_sql(scale: str = "20") -> str:
    return f"""seg AS (SELECT event_type AS source_key, event_id AS ordinal, (epoch_us(ts) - {EPOCH_US}) / 1e6 AS start_s,
  (epoch_us(ts) - {EPOCH_US}) / 1e6 + value * {scale} AS end_s, (event_id % 100) / 1e2 AS pred,
  CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'original' END AS kind, event_id % 7 = 0 AS suspect, user_id FROM events)"""


SEG = segments_sql()


def durations(segments: DataFrame, less: float = 3600.0) -> DataFrame:
    return segments.groupBy("source_key").agg((F.max("end_s") - less).alias("duration"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as samples: quantity x 100, numbered in each return flag by a unique order."""
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source_key"), *order, (F.col("l_quantity") * 100).cast("int").alias("sample"))
    return ordered.numbered(rows, order, "sample_no", ["source_key"]).select("source_key", (F.col("sample_no") - 1).alias("sample_no"), "sample")


def chunks(spark: SparkSession, sf_dir: str, size: int = 1500) -> DataFrame:
    """The same as chunks of PCM, which end at other places than blocks do."""
    return signal.packed(samples(spark, sf_dir), size)


SAMPLES = """samples AS (SELECT l_returnflag AS source_key, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS sample_no,
  (l_quantity * 100)::INT AS sample FROM lineitem)"""
