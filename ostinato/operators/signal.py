"""Samples: chunks of PCM, blocks, padding, down-mix, loudness and gain.

chunks: source_key, first_sample, payload (16-bit little-endian mono samples, in one piece). A chunk is one row whatever its length;
samples are never rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.params import SCALE_RESCAN, Rescan

#: Samples of a cell in which chunks and the stretches that are cut from them meet.
CELL = 1 << 20


def packed(samples: DataFrame, size: int) -> DataFrame:
    """samples (source_key, sample_no, sample), numbered without holes -> chunks of `size`."""
    item = F.struct("sample_no", "sample")
    rows = samples.groupBy("source_key", F.floor(F.col("sample_no") / size).alias("_no")).agg(F.sort_array(F.collect_list(item)).alias("_x"))
    rows = rows.select("source_key", F.get("_x", F.lit(0))["sample_no"].alias("first_sample"), F.transform("_x", lambda v: v["sample"]).alias("_x"))

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"source_key": pdf["source_key"], "first_sample": pdf["first_sample"], "payload": [np.asarray(v, "<i2").tobytes() for v in pdf["_x"]]})

    return rows.mapInPandas(run, "source_key string, first_sample long, payload binary")


#: Aggregate: a group's binary pieces one behind another, each copied once.
JOINED = "listagg(piece, X'') WITHIN GROUP (ORDER BY first_sample)"


def _piece(start: Column, end: Column) -> Column:
    """The part of a chunk that lies between two sample numbers."""
    at = F.greatest(start, F.col("first_sample"))
    return F.substr("payload", (2 * (at - F.col("first_sample")) + 1).cast("int"), F.greatest(F.lit(0), 2 * (F.least(end, F.col("_end")) - at)).cast("int"))


def _ended(chunks: DataFrame) -> DataFrame:
    return chunks.select("source_key", "first_sample", "payload", (F.col("first_sample") + F.floor(F.octet_length("payload") / 2)).alias("_end"))


def cut(stretches: DataFrame, chunks: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """stretches (source_key, keys..., from, to: sample numbers, the second not included) -> (source_key, keys..., payload): the samples
    that there are. Both sides are listed in each cell that they touch, and meet in the first that they share."""
    cells = lambda a, b: F.sequence(F.floor(a / cell), F.floor((b - 1) / cell))
    c = _ended(chunks).filter("_end > first_sample")
    c = c.withColumn("_cells", cells(F.col("first_sample"), F.col("_end"))).withColumn("_cell", F.explode("_cells"))
    s = stretches.filter("to > from").select("source_key", *keys, "from", "to", cells(F.col("from"), F.col("to")).alias("_own")).withColumn("_cell", F.explode("_own"))
    both = s.join(c, ["source_key", "_cell"]).filter(F.col("_cell") == F.greatest(F.get("_cells", F.lit(0)), F.get("_own", F.lit(0))))
    both = both.filter((F.col("from") < F.col("_end")) & (F.col("to") > F.col("first_sample")))
    pieces = both.select("source_key", *keys, "first_sample", _piece(F.col("from"), F.col("to")).alias("piece"))
    return pieces.groupBy("source_key", *keys).agg(F.expr(JOINED).alias("payload"))


def _blocks(chunks: DataFrame, frame_count: int) -> DataFrame:
    """(source_key, block_no, first_sample, piece): chunks cut where blocks of frame_count samples end."""
    c = _ended(chunks).filter("_end > first_sample")
    c = c.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("first_sample") / frame_count), F.floor((F.col("_end") - 1) / frame_count))))
    start = F.col("block_no") * frame_count
    return c.select("source_key", F.col("block_no").cast("long").alias("block_no"), "first_sample", _piece(start, start + frame_count).alias("piece"))


def padded(blocks: DataFrame, frame_count: int) -> DataFrame:
    """Blocks (source_key, block_no, payload) that are whole already, as a reader gives them -> with n_samples, and the payload padded by
    zeros to frame_count samples. Nothing is shuffled."""
    n = F.floor(F.octet_length("payload") / 2).cast("long")
    return blocks.select("source_key", "block_no", n.alias("n_samples"), F.rpad("payload", F.lit(2 * frame_count), F.lit(b"\0")).alias("payload"))


def block_pad(chunks: DataFrame, frame_count: int) -> DataFrame:
    """chunks of any lengths -> source_key, block_no, n_samples, payload: all blocks of frame_count samples, the last padded by zeros."""
    return padded(_blocks(chunks, frame_count).groupBy("source_key", "block_no").agg(F.expr(JOINED).alias("payload")), frame_count)


def downmix(left: Column, right: Column) -> Column:
    return left * 0.5 + right * 0.5


def mono(left: Column, right: Column) -> Column:
    """Two arrays of samples, mixed place by place."""
    return F.zip_with(left, right, lambda a, b: downmix(a, b))


def gain(rms: Column, p: Rescan = Rescan()) -> Column:
    """Factor that brings a block to the target loudness, at most max_gain; 1 where it is nearly silent."""
    return F.when(rms > p.quiet_rms, F.least(F.lit(p.max_gain), F.lit(p.target_rms) / rms)).otherwise(F.lit(1.0))


def square_sums(pieces: DataFrame, keys: list[str], column: str, scale: float = SCALE_RESCAN) -> DataFrame:
    """pieces (keys..., a column of PCM) with n, the number of samples, and squares, the sum of their squares at that scale."""

    def run(batches):
        import numpy as np

        for pdf in batches:
            x = [np.frombuffer(bytes(v), "<i2").astype(np.float64) / scale for v in pdf[column]]
            yield pdf.assign(n=np.array([len(v) for v in x], "int64"), squares=np.array([float(v @ v) for v in x], "float64"))

    schema = pieces.select(*keys, column).schema.add("n", "long").add("squares", "double")
    return pieces.select(*keys, column).mapInPandas(run, schema)


def block_rms_gain(chunks: DataFrame, frame_count: int, p: Rescan = Rescan()) -> DataFrame:
    """rms and gain of each block; only sums are shuffled."""
    sums = square_sums(_blocks(chunks, frame_count), ["source_key", "block_no"], "piece").groupBy("source_key", "block_no").agg(F.sqrt(F.sum("squares") / F.sum("n")).alias("rms"))
    return sums.withColumn("gain", gain(F.col("rms"), p))
