"""Candidates and nested lists against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from ostinato.operators import catalog
from ostinato.sources import playlist


def test_candidates_by_rounds(spark):
    rng = random.Random(53)
    rows = [(f"s{k}", i, rng.choice(["", None, *(f"f{j}" for j in range(12))]), rng.choice(["", None, *(f"u{j}" for j in range(14))])) for k in range(30) for i in range(rng.randrange(1, 40))]
    rows += [("chain", i, f"f{(i + 1) // 2}", f"u{i // 2}") for i in range(9)]
    want = []
    for key in {r[0] for r in rows}:
        formats, urls = set(), set()
        for k, i, f, u in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if u and not (u in urls or f and f in formats):
                want.append((k, i))
                urls.add(u)
                formats |= {f} - {"", None}
    df = spark.createDataFrame([(*r, "none", "v") for r in rows], "source_key string, ordinal long, format_id string, url string, acodec string, vcodec string").repartition(4)
    assert sorted((r["source_key"], r["ordinal"]) for r in catalog.distinct_candidates(df, "video").collect()) == sorted(want)
    assert catalog.distinct_candidates(df.limit(0), "video").collect() == []


def test_many_candidates_of_one_source(spark):
    h = F.xxhash64("id")
    many = spark.range(100_000).select(F.lit("s").alias("source_key"), F.col("id").alias("ordinal"), F.concat(F.lit("f"), F.pmod(h, 30_000)).alias("format_id"), F.concat(F.lit("u"), F.pmod(F.shiftright(h, 20), 40_000)).alias("url"), F.lit("none").alias("acodec"), F.lit("v").alias("vcodec"))
    formats, urls, want = set(), set(), []
    for r in many.orderBy("ordinal").collect():
        if r["format_id"] not in formats and r["url"] not in urls:
            formats.add(r["format_id"])
            urls.add(r["url"])
            want.append(r["ordinal"])
    assert sorted(r["ordinal"] for r in catalog.distinct_candidates(many, "video").collect()) == want


NODES = "list_id string, node_id long, parent_id long, pos long, url string"


def flat(nodes):
    """{list: [url]} depth first"""
    out = {}

    def visit(key, parent):
        for _, i, _, _, url in sorted((n for n in nodes if n[0] == key and n[2] == parent), key=lambda n: (n[3], n[1])):
            if url is None:
                visit(key, i)
            else:
                out.setdefault(key, []).append(url)

    for key in {n[0] for n in nodes}:
        visit(key, None)
    return out


def places(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: r["place"]):
        got.setdefault(r["list_id"], []).append((r["place"], r["url"]))
    assert all([p for p, _ in v] == list(range(1, len(v) + 1)) for v in got.values())
    return {k: [u for _, u in v] for k, v in got.items()}


def test_nested_lists(spark, monkeypatch):
    monkeypatch.setattr(playlist, "TOGETHER", 3)
    rng = random.Random(7)
    nodes = [(k, i, rng.choice([None, *range(max(0, i - 6), i)]) if i else None, rng.randrange(9), rng.choice([None, None, f"{k}{i}"])) for k in "abc" for i in range(60)]
    nodes += [("a", 900, 800, 0, "orphan"), ("d", 1, None, 0, None), ("e", 5, None, 2, "e5"), ("e", 4, None, 2, "e4")]
    assert places(playlist.flatten_nested(spark.createDataFrame(nodes, NODES).repartition(3))) == flat(nodes)
    assert playlist.flatten_nested(spark.createDataFrame([], NODES)).collect() == []


def test_a_deep_chain_takes_few_rounds_and_circles_raise(spark):
    rounds = []
    held = type(spark.range(1)).checkpoint
    deep = spark.range(4096).select(F.lit("a").alias("list_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("url"))
    leaves = spark.range(4096).select(F.lit("a"), F.col("id") + 10_000, F.col("id"), F.lit(1).cast("long"), F.concat(F.lit("u"), F.col("id").cast("string")))
    kind = type(spark.range(1))
    try:
        kind.checkpoint = lambda self, *a, **b: rounds.append(1) or held(self, *a, **b)
        got = places(playlist.flatten_nested(deep.union(leaves)))
    finally:
        kind.checkpoint = held
    assert got == {"a": [f"u{i}" for i in reversed(range(4096))]} and len(rounds) <= 16
    with pytest.raises(ValueError):
        playlist.flatten_nested(spark.createDataFrame([("a", 1, None, 0, "x"), ("a", 2, 3, 0, None), ("a", 3, 2, 0, None)], NODES))


def test_flat_lists_take_no_rounds(spark):
    """Bytes that stay in the shared folder: a few for each node, not a copy of all nodes for each round."""
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())
    i = F.col("id")
    lists = spark.range(20_000).select((i % 2000).alias("list_id"), i.alias("node_id"), F.lit(None).cast("long").alias("parent_id"), i.alias("pos"), F.lit(None).cast("string").alias("url"))
    leaves = spark.range(80_000).select((i % 2000).alias("list_id"), i + 1_000_000, i % 20_000, i, F.concat(F.lit("u"), i.cast("string")))
    before = size()
    got = places(playlist.flatten_nested(lists.union(leaves)))
    assert (size() - before) / 100_000 < 100
    assert got[7] == [f"u{p + 20_000 * j}" for p in range(7, 20_000, 2000) for j in range(4)]


def test_times_of_eight_digits(spark):
    """10022400 is second 10,022,400 where a field holds times; as a day it would be in a month 24."""
    value = '{"entries": [%s]}' % ", ".join('{"url": "u%d", "%s": %s}' % (i, k, v) for i, (k, v) in enumerate([("release_timestamp", 10022400), ("timestamp", 99964800), ("timestamp", '"20240102"'), ("upload_date", '"20240230"'), ("release_timestamp", 1704153600)]))
    got = playlist.playlist_entries(spark.createDataFrame([("a", "https://x.example/", value)], "list_id string, url string, value string"))
    assert [r["upload_date"] for r in got.orderBy("index").collect()] == ["1970-04-27", "1973-03-03", "2024-01-02", "2024-02-30", "2024-01-02"]


def test_rounds_of_candidates_write_little(spark):
    """Bytes that stay in the shared folder for each candidate; equal ordinals go on by their texts."""
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())
    i = F.col("id")
    of = lambda lead, n: F.concat(F.lit(lead), F.pmod(F.xxhash64("id", F.lit(lead)), F.lit(n)).cast("string"))
    many = spark.range(60_000).select(F.floor(i / 4).alias("source_key"), (i % 4).alias("ordinal"), of("f", 5).alias("format_id"), of("u", 6).alias("url"), F.lit("none").alias("acodec"), F.lit("v").alias("vcodec"))
    before = size()
    assert catalog.distinct_candidates(many, "video").count() > 30_000
    assert (size() - before) / 60_000 < 30
    ties = [("s", None, "b", "u1"), ("s", None, "a", "u1"), ("s", 1, "c", "u3"), ("s", 1, None, "u3"), ("s", 2, "c", "u4"), ("s", 2, "c", "u4")]
    df = spark.createDataFrame([(*r, None, "v") for r in ties], "source_key string, ordinal long, format_id string, url string, acodec string, vcodec string").repartition(3)
    assert sorted(tuple(r)[2:4] for r in catalog.distinct_candidates(df, "video").collect() if r["format_id"]) == [("a", "u1"), ("c", "u4")]
    assert catalog.distinct_candidates(df, "video").filter("format_id is null and url = 'u3'").count() == 1
