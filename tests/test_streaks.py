"""Streaks as composed maps against the fold."""

import random

import pytest
from pyspark.sql import functions as F

from ostinato.operators import transfer


def fold(speeds, threshold, warm_up, slow):
    """[(seq, speed)] in order -> seqs of alarms"""
    out, seen, run = [], 0, 0
    for seq, v in speeds:
        run = run + 1 if seen >= warm_up and v is not None and v < threshold else 0
        seen += 1
        if run >= slow:
            out.append(seq)
            seen = run = 0
    return out


@pytest.mark.parametrize(("warm_up", "slow"), [(2, 2), (0, 1), (3, 1), (0, 3), (1, 4)])
@pytest.mark.parametrize("bucket", [1, 5, 1024])
def test_streaks(spark, warm_up, slow, bucket, monkeypatch):
    monkeypatch.setattr(transfer, "GROUP", 3)
    rng = random.Random(warm_up * 10 + slow)
    data = {k: [(i * rng.choice([1, 1, 7]) + 100 * i * (k % 2) - 50, rng.choice([0.1, 0.1, 0.1, 0.9, None])) for i in range(rng.randrange(120))] for k in range(12)}
    data = {k: sorted(dict(v).items()) for k, v in data.items()}
    rows = [(k, s, v) for k, x in data.items() for s, v in x]
    rng.shuffle(rows)
    got = {}
    for r in transfer.slow_streak(spark.createDataFrame(rows, "key long, seq long, speed double"), 0.5, warm_up, slow, bucket).collect():
        got.setdefault(r["key"], []).append(r["seq"])
    want = {k: fold(v, 0.5, warm_up, slow) for k, v in data.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_one_key_is_spread_and_native(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), 100) / 100.0).alias("speed"))
    out = transfer.slow_streak(rows, 0.7)
    assert sorted(r["seq"] for r in out.collect()) == fold([(r["seq"], r["speed"]) for r in rows.orderBy("seq").collect()], 0.7, 2, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
    assert transfer.slow_streak(rows.limit(0), 0.7).collect() == []
