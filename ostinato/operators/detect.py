"""From score frames to event segments.

frames: source_key, block_no, frame_no, scores (array<float>, one score for each class), FRAMES_PER_SECOND of them a second.
Runs never join over a block's end, so everything here is grouped by (source_key, block_no): a long source is as many
groups as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.params import FRAMES_PER_SECOND, SCALE_DETECT, Detection

BLOCK = ["source_key", "block_no"]


def focus_scores(frames: DataFrame, p: Detection) -> DataFrame:
    """The focus class's score alone, so that no array is shuffled."""
    return frames.select(*BLOCK, "frame_no", F.get("scores", F.lit(p.focus_idx)).cast("double").alias("score"))


def subsample_max(scores: DataFrame, p: Detection) -> DataFrame:
    """Highest score of each bucket of `precision` frames; what is left at the end is a bucket too."""
    bucket = F.floor(F.col("frame_no") / p.precision).cast("long")
    return scores.groupBy(*BLOCK, bucket.alias("bucket")).agg(F.max("score").alias("score"))


def threshold_filter(buckets: DataFrame, p: Detection) -> DataFrame:
    return buckets.filter(F.col("score") > F.lit(p.threshold))


def islands(hits: DataFrame) -> DataFrame:
    """hits with `island`, equal for consecutive buckets of a block."""
    by = W.partitionBy(*BLOCK).orderBy("bucket")
    return hits.withColumn("island", F.col("bucket") - F.row_number().over(by))


def segment_aggregate(marked: DataFrame) -> DataFrame:
    return marked.groupBy(*BLOCK, "island").agg(
        F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.round(F.max("score"), 6).alias("pred")
    )


def segment_bounds(segments: DataFrame, p: Detection) -> DataFrame:
    """Seconds from the source's start. The end is always one second past the last bucket's start."""
    offset = F.col("block_no") * F.lit(p.block_size)
    at = lambda c: F.col(c) * F.lit(p.precision) / F.lit(FRAMES_PER_SECOND) + offset
    return segments.withColumn("start_s", at("first_bucket").cast("double")).withColumn("end_s", (at("last_bucket") + 1).cast("double"))


def frame_peaks(frames: DataFrame, p: Detection) -> DataFrame:
    """A frame as numbers: frame_no, the focus class's score, the highest class (the first of equals) and its score."""
    top = F.array_max("scores")
    return frames.select(
        *BLOCK, "frame_no", F.get("scores", F.lit(p.focus_idx)).cast("double").alias("score"), (F.array_position("scores", top) - 1).cast("int").alias("top1_idx"),
        F.round(top.cast("double"), 6).alias("top1_score"),
    )


def bucket_peaks(peaks: DataFrame, p: Detection) -> DataFrame:
    """Highest score of each bucket, as subsample_max, with `_peak`, its first frame with that score: one shuffle of numbers."""
    bucket = F.floor(F.col("frame_no") / p.precision).cast("long")
    frame = F.struct("score", (-F.col("frame_no")).alias("before"), "top1_idx", "top1_score")
    return peaks.groupBy(*BLOCK, bucket.alias("bucket")).agg(F.max("score").alias("score"), F.max(frame).alias("_peak"))


def segment_peaks(marked: DataFrame, p: Detection) -> DataFrame:
    """segment_aggregate over buckets with `_peak`, with the segment's peak: the frame with its highest focus score, the first of
    equals, and the class that is highest there."""
    found = marked.groupBy(*BLOCK, "island").agg(
        F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.round(F.max("score"), 6).alias("pred"), F.max("_peak").alias("_peak")
    )
    return found.select(
        *BLOCK, "island", "first_bucket", "last_bucket", "pred", (-F.col("_peak.before")).cast("long").alias("peak_frame"), F.col("_peak.top1_idx").alias("top1_idx"), F.col("_peak.top1_score").alias("top1_score"),
        (F.col("_peak.top1_idx") != p.focus_idx).alias("suspect"),
    )


def detect_segments(frames: DataFrame, p: Detection) -> DataFrame:
    """The whole way in one scan: source_key, block_no, start_s, end_s, pred, suspect, top1_idx, top1_score."""
    marked = islands(threshold_filter(bucket_peaks(frame_peaks(frames, p), p), p))
    return segment_bounds(segment_peaks(marked, p), p).select(*BLOCK, "start_s", "end_s", "pred", "suspect", "top1_idx", "top1_score")


def block_count(duration: Column, block_size: int, local: bool = False) -> Column:
    """Blocks that a source of so many seconds has; 1 if that is unknown. Local files count one more for the rest."""
    n = F.floor(duration / block_size) + 1 if local else F.ceil(duration / block_size)
    return F.when(duration.isNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), n)).cast("long")


def block_ranges(sources: DataFrame, block_size: int) -> DataFrame:
    """sources (source_key, duration) -> source_key, block_no, start_s, length_s."""
    n = block_count(F.col("duration"), block_size)
    rows = sources.filter("duration > 0").select("source_key", "duration", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block_no"))
    start = (F.col("block_no") * block_size).cast("double")
    return rows.select("source_key", "block_no", start.alias("start_s"), F.least(F.lit(float(block_size)), F.col("duration") - start).alias("length_s"))


def completeness(expected: DataFrame, processed: DataFrame) -> DataFrame:
    """expected (source_key, n_expected), processed (source_key, block_no) -> n_processed, complete; for sources with no block too."""
    done = processed.groupBy("source_key").agg(F.count_distinct("block_no").alias("n_processed"))
    n = F.coalesce("n_processed", F.lit(0)).cast("long")
    return expected.join(done, "source_key", "left").select("source_key", "n_expected", n.alias("n_processed"), (n >= F.col("n_expected")).alias("complete"))


def detection_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("source_key").agg(F.count(F.lit(1)).alias("n_clips"))


def score_blocks(blocks: DataFrame, scorer, columns: str, scale: float = SCALE_DETECT) -> DataFrame:
    """blocks (source_key, block_no, payload: 16-bit samples, all of one length, and perhaps gain) -> frames.

    scorer is a callable without arguments, called once in each Python worker; what it returns maps float32 [n, samples] to
    float32 [n, frames, classes]. Arrow batches go in, so memory is bounded by the batch size of the session.
    """
    import numpy as np
    import pandas as pd

    def run(batches):
        model = scorer()
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.frombuffer(bytes(v), "<i2") for v in pdf["payload"]]).astype(np.float64) / scale
                got = model((x * pdf["gain"].to_numpy()[:, None]).astype(np.float32))
                for key, block, scores in zip(pdf["source_key"], pdf["block_no"], got):
                    yield pd.DataFrame({"source_key": key, "block_no": block, "frame_no": np.arange(len(scores), dtype=np.int32), "scores": list(scores)})

    gain = F.col("gain") if "gain" in blocks.columns else F.lit(1.0)
    return blocks.select("source_key", "block_no", "payload", gain.alias("gain")).mapInPandas(run, columns)


SEGMENT_SCHEMA = "source_key string, block_no long, start_s double, end_s double, pred double, suspect boolean, top1_idx int, top1_score double"


def block_segments(scores, p: Detection):
    """scores: an array [blocks, frames, classes] -> arrays (block, first bucket, last bucket, peak frame, pred, top1 class, its score), one
    value for each segment, as detect_segments finds them; all blocks at once."""
    import numpy as np

    n, frames, _ = scores.shape
    focus = scores[:, :, p.focus_idx].astype(np.float64)
    n_buckets = -(-frames // p.precision)
    full = np.full((n, n_buckets * p.precision), -np.inf)
    full[:, :frames] = focus
    full = full.reshape(n, n_buckets, p.precision)
    top, at = full.max(axis=2), full.argmax(axis=2) + np.arange(n_buckets) * p.precision
    edges = np.diff((top > p.threshold).astype(np.int8), axis=1, prepend=0, append=0)
    block, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    size = last - first + 1
    begin = np.cumsum(size) - size
    place = np.repeat(block * n_buckets + first - begin, size) + np.arange(size.sum())  # the buckets of all segments, flat
    of = np.repeat(np.arange(len(size)), size)
    pred = np.maximum.reduceat(top.ravel()[place], begin) if len(size) else np.zeros(0)
    hit = np.flatnonzero(top.ravel()[place] == pred[of])
    peak = at.ravel()[place[hit[np.unique(of[hit], return_index=True)[1]]]]
    there = scores[block, peak]
    best = there.argmax(axis=1) if len(there) else np.zeros(0, np.int64)
    return block, first, last, peak, pred, best, there[np.arange(len(there)), best].astype(np.float64)


def segments_frame(keys, blocks, scores, p: Detection):
    """SEGMENT_SCHEMA rows of blocks with their scores, as a pandas frame."""
    import numpy as np
    import pandas as pd

    i, first, last, _, pred, best, score = block_segments(scores, p)
    keys, blocks = np.asarray(keys, object)[i], np.asarray(blocks, np.int64)[i]
    second = lambda b: b * p.precision / FRAMES_PER_SECOND + blocks * p.block_size
    return pd.DataFrame(
        {"source_key": keys, "block_no": blocks, "start_s": second(first), "end_s": second(last) + 1.0, "pred": np.round(pred, 6), "suspect": best != p.focus_idx, "top1_idx": best.astype(np.int32), "top1_score": np.round(score, 6)}
    )


def detect_blocks(blocks: DataFrame, scorer, p: Detection, scale: float = SCALE_DETECT) -> DataFrame:
    """blocks (source_key, block_no, payload: PCM, all of one length) -> SEGMENT_SCHEMA, scored and segmented in one pass. Segments end with
    their block, so there is no state and no shuffle: blocks may be a stream."""
    import numpy as np

    def run(batches):
        model = scorer()
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.frombuffer(bytes(v), "<i2") for v in pdf["payload"]]).astype(np.float64) / scale
                yield segments_frame(pdf["source_key"], pdf["block_no"], model(x.astype(np.float32)), p)

    return blocks.select("source_key", "block_no", "payload").mapInPandas(run, SEGMENT_SCHEMA)


FRAME_SCHEMA = "source_key string, block_no long, frame_no int, scores array<float>"


def power_scorer(frame: int = 100, classes: int = 2):
    """A scorer without a model: the mean square of each frame's samples, and one less that. For tests and dry runs."""

    def load():
        import numpy as np

        def score(x):
            n = x.shape[1] // frame
            power = np.clip((x[:, : n * frame].reshape(len(x), n, frame).astype(np.float64) ** 2).mean(axis=2), 0, 1)
            return np.stack([power, 1 - power] + [np.zeros_like(power)] * (classes - 2), axis=2).astype(np.float32)

        return score

    return load


def onnx_scorer(path: str):
    """A scorer that runs an ONNX model; onnxruntime is only needed here."""

    def load():
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x})[0]

    return load
