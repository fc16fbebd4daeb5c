"""Token ids in Parquet files: list columns with dictionary or delta encoding, sized row groups and page indexes.

Documents are range-sorted by id before they are encoded, so a file, a row group and a page each hold a narrow range of
ids, and their statistics let a reader skip the rest.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .shared import new_path

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000


def _ranged(df: DataFrame) -> DataFrame:
    """Rows in partitions by ranges of doc_id, null first. The bounds are quantiles of the ids alone, so that the texts are
    read once and not twice, as a range partitioning's own sample would. An id that is several quantiles has as many partitions, and
    null ids have their share: their rows are dealt by their texts. A few numbers for each partition come to the driver."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts, nulls, rows = df.select("doc_id").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n), F.count_if(F.col("doc_id").isNull()), F.count(F.lit(1))).first()
    first = -(-n * nulls // max(1, rows))  # partitions of null ids
    bounds = F.array(*[F.struct(F.lit(x).cast("long").alias("id"), F.lit(m).alias("m")) for x, m in sorted(Counter(cuts or []).items())])
    dealt = lambda m: F.pmod(F.xxhash64("text"), m).cast("int")
    step = lambda k, x: k + F.when(F.col("doc_id") > x["id"], x["m"]).when(F.col("doc_id") == x["id"], 1 + dealt(x["m"])).otherwise(0)
    own = F.aggregate(bounds, F.lit(first), step) if cuts else F.lit(first)
    return df.repartitionById(n + first, F.when(F.col("doc_id").isNull(), dealt(F.lit(max(1, first)))).otherwise(own))


def encoded(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids), range-sorted by doc_id, null ids first; null text is empty and has only the end id.

    Rows of equal doc_id follow one another, each with its own ids. A very long text is one list in one row; it takes a row group of
    its own if it is longer than one.
    """

    def run(batches):
        enc = tokens.encoder(tokenizer)
        for b in batches:
            for at, raw in tokens.encoded(enc, b.column(1), end_id):
                ends = np.cumsum([0] + [len(x) // 4 for x in raw]).astype("<i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                n = pa.array(np.diff(ends).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(raw)), n, ids], ["doc_id", "n_tokens", "ids"])

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    dealt = _ranged(own).sortWithinPartitions("doc_id")
    return dealt.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def write_tokens(tokens_df: DataFrame, path: str, delta: bool = False) -> None:
    """One file for each partition. Ids are dictionary-encoded, or delta-packed with `delta` (ids without repetition); doc_id and
    n_tokens, which ascend or are small, are delta-packed. Every page has its least and greatest doc_id in the file's index."""
    dictionary = {"ids.list.element": not delta, "doc_id": False, "n_tokens": False}
    writer = tokens_df.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    for column, on in dictionary.items():
        writer = writer.option(f"parquet.enable.dictionary#{column}", str(on).lower())
    (
        writer.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, columns=("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Rows with first <= doc_id <= last. The range reaches the row groups and pages, and only `columns` are read."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    if last is not None:
        df = df.filter(F.col("doc_id") <= last)
    return df.select(*columns)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of files written by write_tokens, from the ids in them.

    start counts the ids of all rows before, by doc_id, null first; rows that share a doc_id follow in any order.
    """

    def run(batches):
        for b in batches:
            ids = b.column(2)
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [tokens.crc32(flat[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "n_tokens", "ids_crc32"])

    read = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), "doc_id", "ids")
    rows = read.mapInArrow(run, "file string, doc_id long, n_tokens long, ids_crc32 long")
    # files follow one another by doc_id, so a file's start is the sum of those before it: one row for each file
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), "doc_id", "n_tokens")
    files = files.groupBy("file").agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("n"), F.max(F.col("doc_id").isNull()).alias("nulls"))
    before = F.sum("n").over(W.orderBy(F.col("nulls").desc(), F.col("least").asc_nulls_first(), "file")) - F.col("n")
    files = files.select("file", before.alias("before"))
    inner = F.sum("n_tokens").over(W.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("inner", inner - F.col("n_tokens")).join(files, "file")
    return rows.select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = new_path(spark, "tokens")
    write_tokens(encoded(docs, vocabulary()), path)
    return digests(spark, path)
