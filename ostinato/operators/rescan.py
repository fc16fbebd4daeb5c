"""Second look around each hit: windows, gain, scoring of whole short blocks, and the verdict on what is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.operators import detect, intervals, signal
from ostinato.params import SCALE_RESCAN, Detection, Rescan


def whole_blocks(windows: DataFrame, block: int, least: float = 1.0) -> DataFrame:
    """Windows of a second and a block at least, cut to whole blocks; n_blocks tells how many."""
    length = F.col("end_s") - F.col("start_s")
    w = windows.filter((length >= least) & (length >= block)).withColumn("n_blocks", F.floor(length / block).cast("long"))
    return w.withColumn("end_s", F.col("start_s") + F.col("n_blocks") * block)


def of_complete(windows: DataFrame, done: DataFrame) -> DataFrame:
    """Windows of sources all whose blocks were processed; done: source_key, complete. Others are not looked at again."""
    return windows.join(done.filter("complete").select("source_key").distinct(), "source_key", "left_semi")


def outcome(pred: Column, suspect: Column, direct: float = 0.75) -> Column:
    """Sure enough by score: direct; else confirmed unless another class is higher there."""
    return F.when(pred > direct, "direct").when(~F.coalesce(suspect, F.lit(False)), "confirmed").otherwise("rejected")


def verified(found: DataFrame, p: Rescan = Rescan()) -> DataFrame:
    return found.withColumn("outcome", outcome(F.col("pred"), F.col("suspect"), p.direct_accept))


def verify_summary(rows: DataFrame) -> DataFrame:
    n = lambda x: F.count_if(F.col("outcome") == x)
    return rows.groupBy("source_key").agg(
        F.count(F.lit(1)).alias("n_windows"), n("confirmed").alias("n_confirmed"), n("direct").alias("n_direct"), n("rejected").alias("n_rejected")
    )


def rescan(windows: DataFrame, chunks: DataFrame, rate: int, scorer, p: Detection, r: Rescan = Rescan()) -> DataFrame:
    """windows (source_key, start_s, end_s) x chunks of PCM -> segments with an outcome, kind 'new'.

    Blocks are whole; what is left of a window behind its last one is not read. A block's PCM is one value from the chunks on.
    """
    w = whole_blocks(windows, r.block)
    w = w.withColumn("_first", F.round(F.col("start_s") * rate).cast("long"))
    blocks = w.select("source_key", "start_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"), "_first")
    n = r.block * rate
    blocks = blocks.withColumn("from", F.col("_first") + F.col("block") * n).withColumn("to", F.col("from") + n)
    whole = signal.cut(blocks, chunks, ["start_s", "block"]).filter(F.octet_length("payload") == 2 * n)
    loud = signal.square_sums(whole, ["source_key", "start_s", "block"], "payload").withColumn("gain", signal.gain(F.sqrt(F.col("squares") / n), r))
    # source and window are one key of blocks, written so that any text and any double can be told apart and read back
    name = F.to_json(F.struct("source_key", F.col("start_s").alias("at")))
    ready = loud.select(name.alias("source_key"), F.col("block").alias("block_no"), "payload", "gain")
    found = detect.detect_segments(detect.score_blocks(ready, scorer, detect.FRAME_SCHEMA, SCALE_RESCAN), p)
    read = F.from_json("source_key", "source_key string, at double")
    found = found.withColumn("_k", read).withColumn("_w", F.col("_k.at")).withColumn("source_key", F.col("_k.source_key")).drop("_k")
    found = found.withColumn("start_s", F.col("start_s") + F.col("_w")).withColumn("end_s", F.col("end_s") + F.col("_w"))
    return verified(found, r).withColumn("kind", F.lit("new")).drop("_w")


def demo(samples: DataFrame, rate: int = 100) -> DataFrame:
    """Every run of hits looked at again, on samples taken as `rate` a second. Runs are cut at minutes; close windows merge."""
    r, p = Rescan(window=10.0, block=10), Detection(precision=10, block_size=10, threshold=0.01, focus_idx=0, classes=2)
    minute = F.floor(F.col("sample_no") / (60 * rate)).alias("block_no")
    over = samples.filter("sample > 4000").select("source_key", minute, F.col("sample_no").alias("bucket"))
    runs = detect.islands(over).groupBy("source_key", "block_no", "island").agg(F.min("bucket").alias("at"), F.max("bucket").alias("to"))
    hits = runs.select("source_key", F.col("at").alias("ordinal"), (F.col("at") / rate).alias("start_s"), (F.col("to") / rate + 1).alias("end_s"))
    windows = intervals.scan_windows(hits, r.window, gap=r.coalesce_gap).select("source_key", "start_s", "end_s")
    return rescan(windows, signal.packed(samples, 60 * rate), rate, detect.power_scorer(frame=rate // 100 or 1), p, r)
