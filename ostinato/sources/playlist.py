"""Playlist JSON as entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.functions import media, urls
from ostinato.operators import catalog, ordered
from ostinato.session import written

INFO = "struct<title:string,extractor_key:string,extractor:string,entries:array<string>>"


def playlist_entries(infos: DataFrame, cap: int = 1000) -> DataFrame:
    """infos (list_id, url, value: JSON) -> (list_id, platform, index, entry_id, title, webpage_url, duration, upload_date, metadata,
    part_number, part_count).

    Entries that are no object or have no address are left out, `index` counts them all from 0; at most `cap` stay, in order. Part
    numbers are given where the platform's name begins with bilibili and there is more than one entry. metadata: an entry's fields but
    for addresses of media, as text. Unreadable JSON gives nothing.
    """
    rows = infos.select("list_id", "url", F.from_json("value", INFO).alias("i"))
    name = F.coalesce(F.nullif(F.col("i.extractor_key"), F.lit("")), F.col("i.extractor"))
    rows = rows.select("list_id", urls.classify_platform(F.col("url"), name).alias("platform"), F.posexplode("i.entries").alias("pos", "_e"))
    rows = rows.withColumn("e", F.from_json("_e", "map<string,string>"))
    full = lambda c: F.nullif(F.element_at("e", c), F.lit(""))
    rows = rows.withColumn("webpage_url", F.coalesce(full("webpage_url"), full("original_url"), full("url"))).filter("webpage_url is not null")
    from pyspark.sql import Window as W

    by = W.partitionBy("list_id")
    rows = rows.withColumn("no", F.row_number().over(by.orderBy("pos"))).filter(F.col("no") <= cap).withColumn("n", F.count(F.lit(1)).over(by))
    parts = F.col("platform").startswith("bilibili") & (F.col("n") > 1)
    return rows.select(
        "list_id", "platform", F.col("pos").alias("index"), F.coalesce(full("id"), "webpage_url").alias("entry_id"), F.coalesce(full("title"), F.lit("Unknown")).alias("title"), "webpage_url",
        media.normalize_duration(F.element_at("e", "duration"), F.element_at("e", "duration_ms")).alias("duration"), media.entry_date(lambda k: F.element_at("e", k)).alias("upload_date"),
        catalog.entry_metadata(F.col("e")).alias("metadata"), F.when(parts, F.col("no")).alias("part_number"), F.when(parts, F.col("n")).alias("part_count"),
    )


#: Positions of a list's entries that are ordered together.
TOGETHER = 1 << 16


def flatten_nested(nodes: DataFrame) -> DataFrame:
    """nodes (list_id, node_id, parent_id or null, pos, url or null for a list) -> (list_id, place, url) depth first; entries of one position
    by node_id. Entries below what isn't a list, or isn't there, are left out; ValueError where lists hold one another in a circle.

    Only lists take part in rounds, whose number is that of the binary digits of the deepest list's depth: lists know their ancestor
    1, 2, 4 ... levels above, and of a list only those that have one go on. On the way up each adds the addresses below it to that ancestor's;
    on the way down it adds what comes before that ancestor. Among neighbours, what comes before is a running sum.
    """
    n = written(nodes.select("list_id", "node_id", "parent_id", "pos", "url"), "nodes")
    is_list = F.col("url").isNull()
    lists = written(_sized(n.filter(is_list), n.filter(~is_list)), "lists")
    rows = n.filter(~is_list).withColumn("n", F.lit(1).cast("long")).unionByName(lists)
    rows = rows.withColumns({"_root": F.col("parent_id").isNull(), "_up": F.coalesce("parent_id", F.lit(0))})
    rows = ordered.running(rows, ["list_id", "_root", "_up"], F.floor(F.col("pos") / TOGETHER), [F.col("pos"), F.col("node_id")], {"_before": (F.col("n"), "sum", False)})
    rows = written(rows.select("list_id", "node_id", "parent_id", "url", F.coalesce("_before", F.lit(0)).alias("before")), "neighbours")
    bases = _bases(rows.filter(is_list).select("list_id", "node_id", F.col("parent_id").alias("up"), F.col("before").alias("base")))
    leaves = rows.filter(~is_list)
    inside = leaves.join(bases.withColumnRenamed("node_id", "parent_id"), ["list_id", "parent_id"]).select("list_id", (F.col("base") + F.col("before") + 1).alias("place"), "url")
    return inside.union(leaves.filter("parent_id is null and list_id is not null").select("list_id", (F.col("before") + 1).alias("place"), "url"))


def _sized(lists: DataFrame, leaves: DataFrame) -> DataFrame:
    """lists with n, the number of leaves below each, at any depth."""
    own = leaves.filter("parent_id is not null").groupBy("list_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    inner = lists.filter("parent_id is not null").select("list_id", "node_id", F.col("parent_id").alias("up"))
    parts, rounds, most = own, 0, None
    live = inner if inner.isEmpty() else written(inner.join(own, ["list_id", "node_id"], "left").na.fill(0, ["n"]), "lists")
    while not live.isEmpty():
        if most is None:
            most = lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0].bit_length() + 1
        rounds += 1
        if rounds > most:
            raise ValueError("lists hold one another in a circle")
        sent = live.groupBy("list_id", F.col("up").alias("node_id")).agg(F.sum("n").alias("n"))
        parts = parts.unionByName(sent)
        above = live.select("list_id", F.col("node_id").alias("up"), F.col("up").alias("_up"))
        on = live.join(above, ["list_id", "up"]).join(sent.withColumnRenamed("n", "_n"), ["list_id", "node_id"], "left")
        live = written(on.select("list_id", "node_id", F.col("_up").alias("up"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")), "lists")
    sizes = parts.groupBy("list_id", "node_id").agg(F.sum("n").alias("n"))
    return lists.join(sizes, ["list_id", "node_id"], "left").na.fill(0, ["n"]).select(*lists.columns, "n")


def _bases(lists: DataFrame) -> DataFrame:
    """lists (list_id, node_id, up, base: what comes before it below the same one) -> (list_id, node_id, base: what comes before it in
    all), of those below a root."""
    known, live = lists.filter("up is null"), lists.filter("up is not null")
    while not live.isEmpty():
        on = known.unionByName(live).select("list_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("base").alias("_base"))
        now = written(live.join(on, ["list_id", "up"]).select("list_id", "node_id", F.col("_up").alias("up"), (F.col("base") + F.col("_base")).alias("base")), "bases")
        known, live = known.unionByName(now.filter("up is null")), now.filter("up is not null")
    return known.select("list_id", "node_id", "base")
