"""Text sources and sinks: address lists and timestamp files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions import timefmt

#: A segment's line begins so; all else names a source, such as a line without a confidence.
SEGMENT = r"^(\d+:\d{2}:\d{2})\s*-\s*(\d+:\d{2}:\d{2}),\s*confidence:\s*([\d.]+)"


def url_list(lines: DataFrame) -> DataFrame:
    """lines (ordinal, value) -> (ordinal, url): stripped, without blanks and # lines, the first of equal ones."""
    v = F.trim("value")
    return lines.select("ordinal", v.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#")).groupBy("url").agg(F.min("ordinal").alias("ordinal"))


def url_entries(urls: DataFrame, cap: int = 1000) -> DataFrame:
    """An address list as playlist entries: at most `cap`, the first ones; id and title are the address."""
    first = urls.orderBy("ordinal").limit(cap)
    return first.select("ordinal", F.col("url").alias("entry_id"), F.col("url").alias("title"), F.col("url").alias("webpage_url"))


def parse_timestamps(files: DataFrame) -> DataFrame:
    """files (path, value: whole text) -> (path, block_no, source_name, seg_no, start_s, end_s, pred, is_segment).

    Blocks are parted by blank lines. The last line that is no segment names the block's source; a block without one is left
    out, a block with a name and no segment gives one row with is_segment false. A bad number gives a null.
    """
    blocks = files.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"(?U)\n\s*\n")).alias("block_no", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    b = blocks.select("path", "block_no", lines.alias("lines"))
    names = F.filter("lines", lambda x: ~x.rlike(SEGMENT))
    b = b.withColumn("names", names).filter(F.size("names") > 0).withColumn("source_name", F.element_at("names", -1))
    segs = F.filter("lines", lambda x: x.rlike(SEGMENT))
    rows = b.select("path", "block_no", "source_name", F.posexplode_outer(segs).alias("seg_no", "line"))
    g = lambda i: F.regexp_extract("line", SEGMENT, i)
    return rows.select(
        "path", "block_no", "source_name", "seg_no", timefmt.parse_hms(g(1)).alias("start_s"), timefmt.parse_hms(g(2)).alias("end_s"),
        g(3).try_cast("double").alias("pred"), F.col("line").isNotNull().alias("is_segment"),
    )


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_timestamps(files)


def timestamps_text(segments: DataFrame, review: bool = False) -> DataFrame:
    """(source_key, value): a source's block: its name, a line for each segment in order, a blank line.

    review: seconds cut off and confidences at two decimals, instead of rounded ones and full confidences.
    """
    clock = timefmt.hms_floor if review else timefmt.hms_round
    pred: Column = F.format_string("%.2f", F.col("pred")) if review else F.col("pred").cast("string")
    line = F.concat(clock(F.col("start_s")), F.lit(" - "), clock(F.col("end_s")), F.lit(", confidence: "), pred)
    rows = segments.select("source_key", F.struct("start_s", "ordinal", line.alias("line")).alias("_l"))
    block = rows.groupBy("source_key").agg(F.sort_array(F.collect_list("_l")).alias("_l"))
    return block.select("source_key", F.concat_ws("\n", "source_key", F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("")).alias("value"))


def write_timestamps(segments: DataFrame, path: str, review: bool = False) -> None:
    """Text files of blocks; nothing is written for sources without a segment."""
    timestamps_text(segments, review).select("value").write.text(path)
