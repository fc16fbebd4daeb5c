"""What the operators of this folder share: words, the shared folder, written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.session import new_folder as new_path
from ostinato.session import shared_folder as shared_dir

#: The six ASCII white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder. Cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one long that are broadcast at most.
FEW = 1 << 20


def checked(ids: DataFrame) -> DataFrame:
    """ids (one long), written once; to be broadcast in a join if they are counted to be few, so that what they meet isn't shuffled."""
    ids = ids.checkpoint()
    return F.broadcast(ids) if ids.count() <= FEW else ids


def words(text: Column) -> Column:
    """The maximal runs of other characters than SPACE; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
