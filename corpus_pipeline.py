"""A training corpus from raw documents: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import linededup, mixing, near, packing, quality
from ostinato.llm.shared import checked, words, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those of null, empty or blank text among them. Each row is judged by its own text, so
    null and repeated doc_ids and equal rows change nothing; rows that stay do so unchanged."""
    return quality.passing(docs.select(*COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go from all; n_chars follows the text. Every row stays, null text as an empty one. Rows of equal
    doc_id (null ones too) and text count as one document."""
    done = linededup.line_dedup(docs.select(*COLUMNS))
    return done.select("doc_id", F.col("_kept").alias("text"), "lang", "source", F.length("_kept").cast("long").alias("n_chars"))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """COLUMNS and a number of each row's own, `_row`. It is written, so that every reading sees the same numbers."""
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), name)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (SimHash and MinHash find candidates, five-word shingles, a similarity of 0.8 or more) stays: the one with the least
    doc_id, with a null one only where there is no other; of equal doc_ids the one with the least hash of its columns."""
    docs = numbered(docs, "near_rows").withColumn("_hash", F.xxhash64(*COLUMNS))
    groups = near.similar_groups(docs, "_row", "text", ["doc_id", "_hash"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "row"))
    stay = groups.groupBy("component").agg(first.alias("_first")).select(F.col("_first.row").alias("_row"))
    return docs.join(checked(stay), "_row", "left_semi").select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; one that is taken in part has its words joined by single spaces. Rows are told apart by
    a number of their own, so null and repeated doc_ids neither lose nor multiply any; texts without a word are taken 0 times."""
    docs = numbered(docs, "mix_rows")
    m = mixing.mixed(docs, row="_row").filter("taken > 0").select(F.col("row").alias("_row"), "size", "rounds", "part_from", "part_len")
    whole = F.col("rounds") + F.when(F.col("part_len") == F.col("size"), 1).otherwise(0)
    some = (F.col("part_len") > 0) & (F.col("part_len") < F.col("size"))
    d = docs.join(m, "_row")
    cut = F.array_join(F.slice(words(F.col("text")), F.col("part_from") + 1, F.col("part_len")), " ")
    d = d.withColumn("_copies", F.concat(F.array_repeat(F.lit(False), whole), F.when(some, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))))
    d = d.withColumn("_part", F.explode("_copies")).withColumn("text", F.when(F.col("_part"), cut).otherwise(F.col("text")))
    return d.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids. Each row is a document of its own, whatever its doc_id; null text has the end id alone."""
    return packing.pack_documents(docs, packing.vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_stage),
    ("mixing to target weights", mix_stage),
    ("best-fit packing", pack_stage),
]

#: Neither shingle similarity, the seeded choice of blocks nor tokens can be had in SQL. tests/llm compares each stage with a
#: brute-force version of it, on rows with null and repeated doc_ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
