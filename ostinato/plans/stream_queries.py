"""Streaming queries, run with availableNow over the tables' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.operators import detect, signal
from ostinato.params import Detection
from ostinato.plans import fixtures as x
from ostinato.plans.detect_queries import DETECTED, POWER
from ostinato.plans.interval_queries import merged_sql
from ostinato.plans.registry import query
from ostinato.plans.reuse_queries import STREAK
from ostinato.session import new_folder
from ostinato.streaming import streams


def _events(spark, sf):
    return streams.stream_of(spark, sf, x.table(spark, sf, "events").schema, "events.parquet")


def _closing(spark, sf):
    """One event long after all others, as a stream."""
    last, schema = new_folder(spark, "closing"), x.table(spark, sf, "events").schema
    streams.closing(schema, event_id=0, user_id=-1, event_type="", ts="2100-01-01 00:00:00", value=0.0)(spark).write.parquet(last)
    return streams.stream_of(spark, last, schema)


@query(f"WITH RECURSIVE {STREAK} SELECT key, seq FROM f WHERE alarm")
def stream_slow_streak(spark, sf):
    s = _events(spark, sf).union(_closing(spark, sf)).filter("user_id is not null")
    s = s.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), F.col("value").alias("speed"))
    return streams.finished(streams.slow_streak(s, 35.0), new_folder(spark, "alarms"), new_folder(spark, "state"))


US = f"""seg AS (SELECT event_type AS source_key, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'original' END AS kind, event_id AS ordinal, epoch_us(ts) AS start_s, epoch_us(ts) + round(value * 2e7)::BIGINT AS end_s FROM events),
{merged_sql('seg', 'source_key, kind', 'start_s > m + 2000000')}"""


@query(f"WITH {US} SELECT source_key, kind, start_s AS start_us, end_s AS end_us, n_merged FROM merged")
def stream_merge(spark, sf):
    ts = F.col("ts").cast("timestamp")
    s = _events(spark, sf).union(_closing(spark, sf)).select(
        F.col("event_type").alias("source_key"), F.when(F.col("event_id") % 3 == 0, "new").otherwise("original").alias("kind"), ts.alias("start_ts"),
        F.unix_micros(ts).alias("start_us"), (F.unix_micros(ts) + F.round(F.col("value") * 2e7).cast("long")).alias("end_us"),
    )
    return streams.finished(streams.merged_sessions(s, 2_000_000, ["source_key", "kind"]), new_folder(spark, "sessions"), new_folder(spark, "state"))


@query(f"WITH {DETECTED} SELECT source_key, block_no, start_s, end_s, pred, suspect, top1_idx FROM detected")
def stream_frame_segments(spark, sf):
    f = x.frames(spark, sf)
    rows = f.groupBy("source_key", "block_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_no", "scores"))), lambda v: v["scores"]).alias("scores"))
    path = new_folder(spark, "blocks")
    rows.write.parquet(path)
    d = x.DETECT
    found = streams.block_segments(streams.stream_of(spark, path, rows.schema), d.precision, d.threshold, d.focus_idx, d.block_size)
    return streams.finished(found, new_folder(spark, "segments"), new_folder(spark, "state"))


PCM = Detection(precision=2, block_size=10, threshold=0.0072, focus_idx=0, classes=2)
#: Segments of scored blocks: buckets of two frames, runs, and the first frame of the highest score.
SEGMENTS = """fr AS (SELECT source_key, block_no, frame_no, frame_no // 2 AS bucket, p::FLOAT::DOUBLE AS p, (1 - p)::FLOAT::DOUBLE AS q FROM framed),
bu AS (SELECT source_key, block_no, bucket, max(p) AS p FROM fr GROUP BY ALL HAVING max(p) > 0.0072),
bi AS (SELECT *, bucket - row_number() OVER (PARTITION BY source_key, block_no ORDER BY bucket) AS isl FROM bu),
sg AS (SELECT source_key, block_no, isl, min(bucket) AS b0, max(bucket) AS b1, round(max(p), 6) AS pred FROM bi GROUP BY ALL),
pk AS (SELECT sg.*, fr.p, fr.q, row_number() OVER (PARTITION BY sg.source_key, sg.block_no, isl ORDER BY fr.p DESC, frame_no) AS o FROM sg JOIN fr ON fr.source_key = sg.source_key AND fr.block_no = sg.block_no AND fr.bucket BETWEEN b0 AND b1)"""
#: The block that is lost on its way.
LOST = 3


def _sent(spark, sf, *columns):
    """(all blocks, those that arrive as a stream): padded blocks, each a second after the one before, written once; on its way one of
    each source is lost. columns: of source_key, block_no, ts and payload."""
    path, at = new_folder(spark, "blocks"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("block_no"))
    blocks = signal.block_pad(x.chunks(spark, sf), 1000).withColumn("ts", at).select(*columns)
    blocks.write.parquet(path)
    return spark.read.schema(blocks.schema).parquet(path), streams.stream_of(spark, path, blocks.schema).filter(F.col("block_no") != LOST)


@query(f"""WITH {x.SAMPLES}, {POWER}, {SEGMENTS} SELECT source_key, block_no, b0 * 2 / 100 + block_no * 10 AS start_s, b1 * 2 / 100 + block_no * 10 + 1 AS end_s, pred, q > p AS suspect, (q > p)::INT AS top1_idx, round(greatest(p, q), 6) AS top1_score
FROM pk WHERE o = 1 AND block_no <> {LOST}""")
def stream_block_detect(spark, sf):
    """PCM blocks that arrive are scored and segmented inside the stream."""
    _, arriving = _sent(spark, sf, "source_key", "block_no", "payload", "ts")
    found = detect.detect_blocks(arriving, detect.power_scorer(frame=100), PCM)
    return streams.finished(found, new_folder(spark, "segments"), new_folder(spark, "state"))


@query(f"""WITH {x.SAMPLES} SELECT DISTINCT source_key, {LOST}::BIGINT AS block_no FROM samples WHERE sample_no // 1000 = {LOST}""")
def stream_missing_blocks(spark, sf):
    """Sources announce how many blocks they have; those that never came are reported."""
    made, blocks = _sent(spark, sf, "source_key", "block_no", "ts")
    n = made.groupBy("source_key").agg((F.max("block_no") + 1).alias("n_expected"))
    path, start = new_folder(spark, "sources"), F.timestamp_seconds(F.lit(1_704_067_200))
    n.select("source_key", start.alias("ts"), "n_expected").write.parquet(path)
    sources = streams.stream_of(spark, path, "source_key string, ts timestamp, n_expected long")
    for folder, row in ((new_folder(spark, "closing"), "'' AS source_key, timestamp_seconds(9e9) AS ts, 1L AS n_expected"), (new_folder(spark, "closing"), "'' AS source_key, 0L AS block_no, timestamp_seconds(9e9) AS ts")):
        spark.sql(f"SELECT {row}").write.parquet(folder)
        if "n_expected" in row:
            sources = sources.union(streams.stream_of(spark, folder, sources.schema))
        else:
            blocks = blocks.union(streams.stream_of(spark, folder, blocks.schema))
    found = streams.missing_blocks(sources, blocks, "30 days")
    return streams.finished(found, new_folder(spark, "missing"), new_folder(spark, "state")).select("source_key", "block_no")
