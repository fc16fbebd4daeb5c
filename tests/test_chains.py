"""Chains of survivors against the sequential fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import chains, intervals


def fold(rows):
    """rows (start, ordinal, end), sorted -> kept"""
    out = []
    for s, o, e in rows:
        if out and out[-1][2] > s:
            if e - s > out[-1][2] - out[-1][0]:
                out[-1] = (s, o, e)
        else:
            out.append((s, o, e))
    return out


def by_source(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["source_key"], []).append((r["start_s"], r["ordinal"], r["end_s"]))
    return {k: sorted(v) for k, v in got.items()}


def frame(spark, data):
    rows = [(k, o, s, e) for k, v in data.items() for s, o, e in v]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "source_key string, ordinal long, start_s double, end_s double").repartition(5)


def case(kind, seed, n):
    rng = random.Random(seed)
    if kind == "short":
        v = [((s := rng.randint(0, 3 * n)) * 1.0, s + rng.randint(0, 8) * 1.0) for _ in range(n)]
    elif kind == "mixed":
        v = [((s := rng.randint(0, n)) * 1.0, s + rng.choice([1, 2, 5, 40, n]) * 1.0) for _ in range(n)]
    elif kind == "one":  # a cluster of all rows
        v = [(i * 1.0, i + n * rng.uniform(1, 2)) for i in range(n)]
    elif kind == "falling":  # each shorter than the one before, and all overlap
        v = [(i * 1.0, 2.0 * n - i / 2) for i in range(n)]
    elif kind == "rising":
        v = [(i * 1.0, 3.0 * i + 2) for i in range(n)]
    else:  # a long one over many
        v = [(0.0, n * 2.0), *[((s := rng.randint(0, 3 * n)) * 1.0, s + rng.randint(1, 4) * 1.0) for _ in range(n)]]
    return [(s, i, e) for i, (s, e) in enumerate(sorted(v))]


KINDS = ["short", "mixed", "one", "falling", "rising", "long"]


def test_successors():
    for kind in KINDS:
        v = case(kind, 1, 200)
        start, end = (np.array([r[k] for r in v]) for k in (0, 2))
        for cuts in ([0, 200], [0, 1, 2, 50, 199, 200]):
            n = len(v)
            stop = np.repeat([*cuts[1:-1], n], np.diff([*cuts[:-1], n]))
            want = [next((j for j in range(i + 1, stop[i]) if start[j] >= end[i] or end[j] - start[j] > end[i] - start[i]), stop[i]) for i in range(n)]
            assert chains.successors(start, end, stop).tolist() == want


@pytest.mark.parametrize(("size", "fan", "bucket"), [(chains.PART, 16, 1e9), (7, 2, 50.0), (3, 4, 1e9), (1, 3, 20.0)])
def test_parts(spark, size, fan, bucket):
    data = {f"{kind}{n}": case(kind, n, n) for kind in KINDS for n in (1, 2, 60)}
    assert by_source(chains.longest_kept(frame(spark, data), bucket, size, fan)) == {k: fold(v) for k, v in data.items()}


def test_one_cluster_of_all_rows_is_spread(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit("a").alias("source_key"), F.col("id").alias("ordinal"), (F.col("id") * 1.0).alias("start_s"), (F.col("id") + 100_000.0 + F.pmod(F.xxhash64("id"), 1_000_000)).alias("end_s"))
    v = [(r["start_s"], r["ordinal"], r["end_s"]) for r in rows.orderBy("start_s", "ordinal").collect()]
    out = chains.longest_kept(rows, 1e9, 4096)
    assert by_source(out) == {"a": fold(v)}
    parts = chains._parts(rows, 1e6, 4096)
    assert parts.count() == -(-n // 4096)


def test_edges(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 5.0), ("a", 2, None, 9.0), ("a", 3, 1.0, None), ("b", 4, 2.0, 2.0), ("b", 5, 2.0, 2.0), ("b", 6, 1.0, 3.0)], "source_key string, ordinal long, start_s double, end_s double")
    assert by_source(intervals.keep_longer(df)) == {"a": [(0.0, 1, 5.0)], "b": [(1.0, 6, 3.0)]}
    assert intervals.keep_longer(df.limit(0)).collect() == []
