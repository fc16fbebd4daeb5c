"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

1. Targets: every source's share of the mix by its weight, filled up to a cap (water filling).
2. Each source is dealt into shards by hash; a shard orders its documents by seed, end to end, and is cut into
   blocks of `block` tokens.
3. Sainte-Lague quotients give each source its blocks, then each wing (a group of shards) of a source its own, then each shard.
4. A shard takes whole rounds of all its blocks, and the rest as one run of neighbouring blocks from a seeded place
   (around the end), so only the documents at the ends of the run are taken in part.

The largest things that any task sorts at once are one shard, WING shards of a source, or its wings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import n_words, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCK = 16
SHARD_TOKENS = 1 << 16
WING = 4096
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, size) of documents -> (source, source_size, weight, target). Sources by code point, null last, take the
    weights in turn; what a source would have above cap x its size is dealt again by weight until none is above."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))).checkpoint()
    free = F.lit(True)
    rate, capped = 0.0, -1
    while True:
        x = by.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(free, F.lit(0)).otherwise(F.col("source_size"))).alias("full"),
            F.sum(F.when(free, F.col("weight"))).alias("weight"),
            F.sum(F.when(free, F.lit(0)).otherwise(F.lit(1))).alias("capped"),
        ).first()
        if not x["all"] or x["weight"] is None or x["capped"] == capped:
            break
        capped, rate = x["capped"], (share * x["all"] - cap * x["full"]) / x["weight"]
        free = F.col("weight") * F.lit(rate) <= cap * F.col("source_size")
    return by.withColumn("target", F.least(F.col("weight") * F.lit(rate), cap * F.col("source_size")).cast("double"))


def _seats(parties: DataFrame, group: list[str], votes: str, house: str, order: str) -> DataFrame:
    """Sainte-Lague: `house` seats of each group go one by one to the highest votes / (2 k + 1). Adds `seats`.

    A party's seats differ from its rounded share by at most about half the number of parties times that share, so only
    quotients around it compete; all below are certain.
    """
    by = W.partitionBy(*group)
    ideal = F.col(votes) / F.sum(votes).over(by) * F.col(house)
    slack = F.ceil(F.count(F.lit(1)).over(by) * F.col(votes) / F.sum(votes).over(by) / 2 + 2)
    p = parties.filter(F.col(votes) > 0).withColumns({"_ideal": ideal, "_slack": slack})
    p = p.withColumn("_sure", F.greatest(F.lit(0), F.floor("_ideal") - F.col("_slack")).cast("long"))
    left = (F.col(house) - F.sum("_sure").over(by)).alias("_left")
    p = p.select("*", left)
    q = p.select("*", F.explode(F.sequence(F.col("_sure"), (F.ceil("_ideal") + F.col("_slack")).cast("long"))).alias("_k"))
    place = F.row_number().over(W.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col(order), F.col("_k")))
    won = q.withColumn("_place", place).filter(F.col("_place") <= F.col("_left"))
    keys = [*dict.fromkeys([*group, order])]
    more = won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    own = [F.col(f"a.{c}") for c in parties.columns]
    return p.alias("a").join(more.alias("b"), cond, "left").select(*own, (F.col("a._sure") + F.coalesce(F.col("b._won"), F.lit(0))).alias("seats"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: str = SEED, row: str | None = None) -> DataFrame:
    """A row for each document: doc_id, source, size (words), source_size, target, taken (words that the mix takes), and
    `rounds` whole copies plus `part_from`, `part_len`: further words, from the first of these (0-based).

    Null text has size 0 and is taken 0 times; null source is a source of its own. Ties in the seeded order fall to doc_id
    and size, so rows that are equal in both may trade places, which changes no count. Extra columns are not read.

    row: a column that tells all rows apart, where doc_id may be null or repeated. It breaks the last ties and comes back as
    `row`, so that results can be joined to their rows.
    """
    rows = [] if row is None else ["row"]
    sizes = written(
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"), *[F.col(f"`{row}`").alias("row") for _ in rows]), "sizes"
    )
    targets = source_targets(sizes).withColumn("shards", F.ceil(F.col("source_size") / SHARD_TOKENS).cast("long"))
    targets = targets.withColumn("house", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long")).withColumn("_all", F.lit(0))
    targets = _seats(targets.withColumn("_order", F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))), ["_all"], "target", "house", "_order")
    zero = source_targets_zero(targets, sizes)
    t = zero.select("source", "source_size", "target", "shards", "seats").checkpoint()
    mix = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    d = sizes.join(F.broadcast(t) if t.count() <= 10_000 else t, sizes["source"].eqNullSafe(t["source"]), "left").select(
        "doc_id", sizes["source"].alias("source"), "size", "source_size", "target", "shards", "seats", mix.alias("_mix"),
        F.coalesce(F.concat(F.lit("0"), sizes["source"]), F.lit("1")).alias("_s"), *rows,
    )
    d = d.withColumn("shard", F.pmod(F.conv(F.substring("_mix", 1, 12), 16, 10).cast("long"), F.greatest(F.lit(1), F.coalesce("shards", F.lit(1)))))
    spread = d.groupBy("_s", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("house"))
    spread = spread.withColumn("wing", F.floor(F.col("shard") / WING))
    wings = spread.groupBy("_s", "wing").agg(F.sum("shard_size").alias("wing_size"), F.first("house").alias("house"))
    wings = _seats(wings, ["_s"], "wing_size", "house", "wing").select("_s", "wing", F.col("seats").alias("house"))
    spread = _seats(spread.drop("house").join(wings, ["_s", "wing"]), ["_s", "wing"], "shard_size", "house", "shard")
    blocks = F.ceil(F.col("shard_size") / block)
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "_s", "shard")), 1, 12), 16, 10).cast("long")
    spread = spread.withColumn("blocks", blocks).withColumn("seats", F.least("seats", 2 * F.col("blocks")))
    spread = spread.select(
        "_s", "shard", "shard_size",
        F.floor(F.col("seats") / F.col("blocks")).alias("rounds"), (F.col("seats") % F.col("blocks")).alias("_run"), (start % F.col("blocks")).alias("_from"),
    )
    end = F.sum("size").over(W.partitionBy("_s", "shard").orderBy("_mix", "doc_id", "size", *rows).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("_e", end).withColumn("_b", F.col("_e") - F.col("size"))
    d = d.join(spread, ["_s", "shard"], "left")
    lo, hi = F.col("_from") * block, (F.col("_from") + F.col("_run")) * block
    n = F.ceil(F.col("shard_size") / block) * block  # the run goes on at the shard's start behind this
    within = lambda x, y: F.greatest(F.lit(0), F.least(F.col("_e"), y) - F.greatest(F.col("_b"), x))
    first, second = within(lo, F.least(hi, n)), within(F.lit(0), F.greatest(F.lit(0), hi - n))
    rounds, some = F.coalesce("rounds", F.lit(0)), F.coalesce(first + second, F.lit(0))
    # a document that the run both ends and starts in counts from its start
    from_ = F.when(F.coalesce(second, F.lit(0)) > 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.coalesce(lo - F.col("_b"), F.lit(0))))
    return d.select(
        "doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        (rounds * F.col("size") + some).cast("long").alias("taken"), rounds.cast("int").alias("rounds"),
        F.when(some > 0, from_).otherwise(F.lit(0)).cast("int").alias("part_from"), some.cast("int").alias("part_len"), *rows,
    )


def source_targets_zero(seated: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sources without a word get no seats but stay."""
    empty = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).filter(F.col("source_size") == 0)
    cols = ["source", "source_size", "target", "shards", "seats"]
    return seated.select(*cols).union(empty.select("source", "source_size", F.lit(0.0), F.lit(1), F.lit(0).cast("long")))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
