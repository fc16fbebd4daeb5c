"""Streams with rows out of order, restarts and idle keys."""

import random

from pyspark.sql import functions as F

from ostinato.streaming import streams

SCHEMA = "key long, ts timestamp, tie long, speed double"


def fold(speeds, threshold=0.5, warm_up=2, slow=2):
    out, seen, run = [], 0, 0
    for place, v in enumerate(speeds, 1):
        run = run + 1 if seen >= warm_up and v is not None and v < threshold else 0
        seen += 1
        if run >= slow:
            out.append(place)
            seen = run = 0
    return out


def put(spark, folder, rows, no):
    df = spark.createDataFrame([(k, at, i, v) for k, at, i, v in rows], "key long, at long, tie long, speed double")
    df.select("key", F.timestamp_seconds("at").alias("ts"), "tie", "speed").coalesce(1).write.mode("append").parquet(f"{folder}/in/{no:03d}")


def run(spark, folder, **how):
    s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = streams.finished(streams.slow_streak(s, 0.5, **how), f"{folder}/out", f"{folder}/state")
    got = {}
    for r in out.filter("key >= 0").collect():
        got.setdefault(r["key"], []).append(r["seq"])
    return {k: sorted(v) for k, v in got.items()}


def test_rows_of_later_batches_are_put_in_order_and_a_restart_goes_on(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, 10_000 + 60 * i + k, i, rng.choice([0.1, 0.1, 0.9, None])) for k in range(4) for i in range(40)]
    want = {k: fold([r[3] for r in rows if r[0] == k]) for k in range(4)}
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 1500))  # up to 25 minutes behind
    cuts = [late[i : i + 32] for i in range(0, len(late), 32)]
    assert any(a[1] > b[1] for x, y in zip(cuts, cuts[1:]) for a in x for b in y)
    for i, c in enumerate(cuts[:3]):
        put(spark, tmp_path, c, i)
    first = run(spark, tmp_path)
    assert sum(map(len, first.values())) < sum(map(len, want.values()))
    for i, c in enumerate([*cuts[3:], [(-1, 10_000_000, 0, 0.0)]], 3):
        put(spark, tmp_path, c, i)
    assert run(spark, tmp_path) == want


def test_rows_that_arrive_together_take_few_calls_to_the_store():
    """A processor with a store of its own that counts: as many calls for a thousand rows of many keys as for one."""
    import pandas as pd

    calls = []

    class Store:
        value = None
        get = lambda self: calls.append("get") or self.value
        exists = lambda self: calls.append("exists") or self.value is not None
        update = put = lambda self, v: calls.append("put") or setattr(self, "value", v)
        clear = lambda self: calls.append("clear") or setattr(self, "value", None)

    class Items(Store):
        get = lambda self: iter(calls.append("get") or list(map(tuple, self.value or [])))
        appendList = lambda self, v: calls.append("append") or setattr(self, "value", [*(self.value or []), *v])

    class Handle:
        getValueState, getListState = staticmethod(lambda *a: Store()), staticmethod(lambda *a: Items())
        registerTimer = deleteTimer = staticmethod(lambda ms: calls.append("timer"))

    class Watermark:
        getCurrentWatermarkInMs = staticmethod(lambda: 1_000_000)

    found, taken = [], []
    for n in (1, 1000):
        calls.clear()
        p = streams.Streaks(0.5, 2, 2, None)
        p.init(Handle())
        speeds = [(None, 0.1, 0.1, 0.1, 0.9, float("nan"))[i * i // 5 % 6] for i in range(n)]
        keys = [i * i // 7 % 5 for i in range(n)]
        assert list(p.handleInputRows((3,), iter([pd.DataFrame({"key": keys, "at": range(n), "tie": range(n), "speed": pd.Series(speeds, dtype="float64")})]), None)) == []
        assert p.waiting.value is not None and len(p.waiting.value) == 1
        found = [tuple(r) for pdf in p.handleExpiredTimer((3,), Watermark, None) for r in pdf.itertuples(index=False)]
        taken.append(len(calls))
    known = [None if v is None or v != v else v for v in speeds]
    assert found == [(k, i) for k in range(5) for i in fold([v for own, v in zip(keys, known) if own == k])] and found
    assert taken[0] == taken[1] <= 8


def test_state_of_idle_keys_goes(spark, tmp_path):
    quick = lambda at, n: [(7, at + i, i, 0.1) for i in range(n)]
    put(spark, tmp_path, quick(1000, 3), 0)  # one more would be an alarm
    put(spark, tmp_path, [(-1, 100_000, 0, 0.0)], 1)
    put(spark, tmp_path, [(-1, 110_000, 0, 0.0)], 2)
    put(spark, tmp_path, quick(120_000, 3), 3)
    put(spark, tmp_path, [(-1, 10_000_000, 0, 0.0)], 4)
    assert run(spark, tmp_path, late="10 seconds", idle_s=3600.0) == {}
    put(spark, tmp_path / "b", quick(1000, 3), 0)
    put(spark, tmp_path / "b", quick(120_000, 3), 1)
    put(spark, tmp_path / "b", [(-1, 10_000_000, 0, 0.0)], 2)
    assert run(spark, tmp_path / "b", late="10 seconds") == {7: [4]}


def test_segments_of_many_blocks_at_once(spark):
    """The array form against the batch operators on the same scores, ties and rests of buckets among them."""
    import numpy as np

    from ostinato.operators import detect
    from ostinato.params import Detection

    rng = np.random.default_rng(6)
    for frames, precision in ((10, 2), (11, 3), (5, 7), (12, 1)):
        p = Detection(precision=precision, block_size=1, threshold=0.5, focus_idx=1, classes=3)
        scores = rng.choice([0.25, 0.5, 0.625, 0.75], (20, frames, 3)).astype(np.float32)
        rows = [("a", i, j, [float(v) for v in scores[i, j]]) for i in range(20) for j in range(frames)]
        want = sorted(tuple(r) for r in detect.detect_segments(spark.createDataFrame(rows, detect.FRAME_SCHEMA), p).collect())
        got = detect.segments_frame(["a"] * 20, range(20), scores, p)
        assert sorted(got.itertuples(index=False, name=None)) == want and want
    assert len(detect.segments_frame(["a"], [0], np.zeros((1, 4, 3), np.float32), p)) == 0


def test_missing_blocks_in_later_batches(spark, tmp_path):
    hour = 3600
    given = {"a": 3, "b": 2}
    spark.createDataFrame([(k, 1_000_000, n) for k, n in given.items()], "source_key string, at long, n_expected long").select("source_key", F.timestamp_seconds("at").alias("ts"), "n_expected").coalesce(1).write.parquet(f"{tmp_path}/s/0")
    came = [("a", 0, 5), ("a", 2, 10 * hour), ("b", 0, 7), ("b", 1, 1 * hour)]  # one never comes, one too late
    for i, c in enumerate(came):
        spark.createDataFrame([c], "source_key string, block_no long, at long").select("source_key", "block_no", F.timestamp_seconds(F.col("at") + 1_000_000).alias("ts")).write.parquet(f"{tmp_path}/b/{i}")
    end = lambda name, sql: spark.sql(sql).write.parquet(f"{tmp_path}/{name}/9")
    end("s", "SELECT 'z' AS source_key, timestamp_seconds(1e9) AS ts, 1L AS n_expected")
    end("b", "SELECT 'z' AS source_key, 0L AS block_no, timestamp_seconds(1e9) AS ts")
    stream = lambda name, schema: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    found = streams.missing_blocks(stream("s", "source_key string, ts timestamp, n_expected long"), stream("b", "source_key string, block_no long, ts timestamp"), "6 hours", "12 hours")
    out = streams.finished(found, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r["source_key"], r["block_no"]) for r in out.collect()) == [("a", 1), ("a", 2)]


def test_samples_are_made_once(spark, monkeypatch):
    """The query's sources and blocks come from one pass over the samples, and payloads aren't written where they aren't read."""
    from ostinato.operators import ordered
    from ostinato.plans import stream_queries

    passes, numbered, written = [], ordered.numbered, []
    monkeypatch.setattr(ordered, "numbered", lambda *a, **b: passes.append(1) or numbered(*a, **b))
    folder = stream_queries.new_folder
    monkeypatch.setattr(stream_queries, "new_folder", lambda spark, name: written.append((name, folder(spark, name))) or written[-1][1])
    got = stream_queries.stream_missing_blocks(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet(dict(written)["blocks"]).filter(f"block_no = {stream_queries.LOST}").count()
    assert len(passes) == 1 and spark.read.parquet(dict(written)["blocks"]).columns == ["source_key", "block_no", "ts"]
