"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

Lengths are taken by halves: pieces of more than size/2 ids first, then those of more than size/4 ... A round range-sorts the
pieces that are left of a half, together with the gaps of the sequences, longest first. A successor sweep down that order
gives each piece the smallest gap that it fits and no piece before it took; a gap that is several times as wide as the
half's longest piece stands there as often. Each partition sweeps its own rows; what it leaves, pieces without a gap first
and open gaps behind them, meets across partitions by rank. Gaps shrink by what they got, and the next round begins. Where
the gaps can't hold what is left, new sequences open: at first by the volume, then one for each place that is missing.

The driver sees a count for each length and gap (at most `size`) and two for each partition; rows stay distributed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .shared import written

SIZE = 4096
END_ID = 1


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and `end_id`, cut every `size` ids.

    Null text counts as empty: one piece that holds `end_id`. Rows with equal ids stay apart. Extra columns aren't read.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches):
        enc = tokens.encoder(tokenizer)
        for b in batches:
            names = b.column(0).to_pylist()
            for at, found in tokens.encoded(enc, b.column(1), end_id):
                out = [[], [], [], [], [], []]
                for i, raw in enumerate(found, at):
                    for piece, x in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[x : x + 4 * size]
                        row = (names[i], piece, x // 4, len(part) // 4, tokens.crc32(part))
                        for column, value in zip(out, row):
                            column.append(value)
                        if ids:
                            out[5].append(np.frombuffer(part, "<i4"))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [f.split()[0] for f in schema.split(", ")])

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, schema)


SWEPT = "part int, kind int, rank long, item long, bin long, length int"
SLOT, PIECE, MATCH = 0, 1, 2


def _sweep(batches):
    """Rows (length, kind, item, bin), longest first, gaps before pieces that fill them: matches, pieces without a gap by rank, and
    open gaps by rank, the smallest first."""
    from pyspark import TaskContext

    part, open_, alone = TaskContext.get().partitionId(), [], 0
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("rank", pa.int64()), ("item", pa.int64()), ("bin", pa.int64()), ("length", pa.int32())])

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(schema)], schema=schema)

    for b in batches:
        found = []
        for length, kind, item, to in zip(*[c.to_numpy(zero_copy_only=False).tolist() for c in b.columns]):
            if kind == SLOT:
                open_.append((to, length))
            elif open_:
                found.append((part, MATCH, 0, item, open_.pop()[0], length))
            else:
                found.append((part, PIECE, alone, item, -1, length))
                alone += 1
        yield rows(found)
    open_.reverse()
    for i in range(0, len(open_), 10_000):
        yield rows([(part, SLOT, r, -1, to, length) for r, (to, length) in enumerate(open_[i : i + 10_000], i)])


def _across(ends: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """ends: (part, kind) -> rows left. Stretches (part and first rank of open gaps, part and first rank of pieces, how many) that meet:
    a partition's pieces take the nearest open gaps before it. At most two for each partition."""
    out, open_ = [], []
    for part in sorted({p for p, _ in ends}):
        left, rank = ends.get((part, PIECE), 0), 0
        while left and open_:
            where, first, n = open_.pop()
            take = min(left, n)
            out.append((where, first, part, rank, take))
            left, rank = left - take, rank + take
            if take < n:
                open_.append((where, first + take, n - take))
        if ends.get((part, SLOT), 0):
            open_.append((part, 0, ends[part, SLOT]))
    return out


def _matched(left: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """left (item, length) and slots (bin, length) -> (item, bin, length) of those that meet, the items that are left, how many are."""
    spark, none = left.sparkSession, F.lit(-1).cast("long")
    rows = left.select("length", F.lit(PIECE).alias("kind"), "item", none.alias("bin")).union(slots.select("length", F.lit(SLOT), none, "bin"))
    order = [F.col("length").desc(), F.col("kind"), F.col("item"), F.col("bin")]
    swept = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sweep, SWEPT), "swept")
    ends = {(r["part"], r["kind"]): r["n"] for r in swept.filter(F.col("kind") < MATCH).groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    met, alone = swept.filter(F.col("kind") == MATCH).select("item", "bin", "length"), swept.filter(F.col("kind") == PIECE)
    n, stretches = sum(v for (_, kind), v in ends.items() if kind == PIECE), _across(ends)
    if not stretches:
        return met, alone.select("item", "length"), n
    schema = "no int, slots int, slot_rank long, pieces int, piece_rank long, many long"
    of = F.broadcast(spark.createDataFrame([(i, *x) for i, x in enumerate(stretches)], schema))  # bounded: two rows a partition
    inside = lambda rank: (F.col("rank") >= F.col(rank)) & (F.col("rank") < F.col(rank) + F.col("many"))
    piece = alone.join(of, (F.col("part") == F.col("pieces")) & inside("piece_rank")).select("no", (F.col("rank") - F.col("piece_rank")).alias("at"), "item", "length")
    slot = swept.filter(F.col("kind") == SLOT).join(of, (F.col("part") == F.col("slots")) & inside("slot_rank")).select("no", (F.col("rank") - F.col("slot_rank")).alias("at"), "bin")
    met = written(met.union(piece.join(slot, ["no", "at"]).select("item", "bin", "length")), "met")
    still = alone.join(of, (F.col("part") == F.col("pieces")) & inside("piece_rank"), "left_anti")
    return met, still.select("item", "length"), n - sum(x[4] for x in stretches)


def _offered(gaps: dict[int, int], top: int, least: int, n: int) -> dict[int, int]:
    """gaps: gap -> sequences. How often a gap stands in the order, the smallest gaps first, until n pieces of at most `top` surely fit."""
    out: dict[int, int] = {}
    for gap in sorted(g for g in gaps if g >= least):
        out[gap] = max(1, min(gap // top, -(-n // gaps[gap])))
        n -= out[gap] * gaps[gap] if gap >= top else 0
        if n <= 0:
            break
    return out


def packed(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """parts (with a `length` within 1..size) -> with sequence_id and offset.

    Sequences hold at most `size` ids and are filled without gaps from 0. Empty input gives no rows. Equal rows each have a place.
    """
    spark = parts.sparkSession
    items = written(parts.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    tally = lambda df, c: {r[c]: r["n"] for r in df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).collect()}  # noqa: E731  at most `size` rows
    counts, gaps = tally(items, "length"), {}
    bins, n_bins = spark.createDataFrame([], "bin long, gap int"), 0
    placed: list[DataFrame] = []
    top = size
    while top:
        own = {k: v for k, v in counts.items() if top // 2 < k <= top}
        n, volume, least, opened = sum(own.values()), sum(k * v for k, v in own.items()), min(own, default=0), 0
        left = items.filter(F.col("length").between(top // 2 + 1, top)).select(F.col("_item").alias("item"), F.col("length").cast("int").alias("length"))
        while n:
            wide = {g: k for g, k in gaps.items() if g >= least}
            room, new = sum(max(1, g // top) * k for g, k in wide.items()), 0
            if room < n:
                new = -(-(n - room) // (size // top)) if opened or top == size else max(0, -(-(volume - sum(g * k for g, k in wide.items())) // size))
                if new:
                    bins = bins.union(spark.range(n_bins, n_bins + new).select(F.col("id").alias("bin"), F.lit(size).alias("gap")))
                    opened, n_bins, gaps[size] = opened + new, n_bins + new, gaps.get(size, 0) + new
            offer = spark.createDataFrame(list(_offered(gaps, top, least, n).items()), "gap int, times int")
            slots = bins.join(F.broadcast(offer), "gap").select("bin", F.least("gap", F.lit(top)).alias("length"), F.explode(F.sequence(F.lit(1), "times")).alias("_time"))  # bounded: `size` rows
            met, left, n = _matched(left, slots)
            placed.append(met.select("item", "bin", "length", F.lit(len(placed)).alias("round")))
            used = met.groupBy("bin").agg(F.sum("length").cast("int").alias("_used"))
            bins = written(bins.join(used, "bin", "left").select("bin", (F.col("gap") - F.coalesce("_used", F.lit(0))).alias("gap")).filter("gap > 0"), "gaps")
            gaps = tally(bins, "gap")
            if n:
                volume, least = left.agg(F.sum("length"), F.min("length")).first()
        top //= 2
    if not placed:
        return items.select(*[F.col(f"`{c}`") for c in parts.columns], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    of = reduce(DataFrame.union, placed)
    before = F.sum("length").over(W.partitionBy("bin").orderBy("round", "item")) - F.col("length")  # at most `size` rows each
    of = of.select(F.col("item").alias("_item"), F.col("bin").alias("sequence_id"), before.cast("long").alias("offset"))
    return items.join(of, "_item").select(*[F.col(f"`{c}`") for c in parts.columns], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    return packed(pieces(docs, tokenizer, size=size), size)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary())
