"""Edits one after another, and results that are saved again."""

import random

import pytest
from pyspark.sql import functions as F

from ostinato.operators import rescan, review
from ostinato.params import Detection
from ostinato.sources import detections


def replay(segments, edits):
    """segments (source, ordinal, start, end), edits (source, no, old, old, new, new) by plain loops."""
    now = {(k, o): [s, e, False] for k, o, s, e in segments}
    order = sorted(now, key=lambda x: (x[0], x[1]))
    for k, _, s, e, ns, ne in sorted(edits, key=lambda x: x[1]):
        if ns >= ne:
            continue
        for x in order:
            if x[0] == k and abs(now[x][0] - s) < 0.01 and abs(now[x][1] - e) < 0.01:
                now[x] = [ns, ne, True]
                break
    return {x: tuple(v) for x, v in now.items()}


def done(spark, segments, edits):
    s = spark.createDataFrame(segments, "source_key string, ordinal long, start_s double, end_s double")
    e = spark.createDataFrame(edits, "source_key string, edit_no long, old_start double, old_end double, new_start double, new_end double")
    return {(r["source_key"], r["ordinal"]): (r["start_s"], r["end_s"], r["edited"]) for r in review.apply_edits(s.repartition(3), e.repartition(3)).collect()}


def test_edits_follow_one_another(spark):
    segments = [("a", 0, 1.0, 2.0), ("a", 1, 1.0, 2.0), ("b", 0, 1.0, 2.0)]
    edits = [("a", 1, 1.0, 2.0, 3.0, 4.0), ("a", 2, 3.0, 4.0, 5.0, 6.0), ("a", 3, 1.0, 2.0, 9.0, 9.0), ("a", 4, 5.0, 6.0, 1.0, 2.0), ("a", 5, 1.0, 2.0, 7.0, 8.0)]
    assert done(spark, segments, edits[:2]) == {("a", 0): (5.0, 6.0, True), ("a", 1): (1.0, 2.0, False), ("b", 0): (1.0, 2.0, False)}
    assert done(spark, segments, edits) == {("a", 0): (7.0, 8.0, True), ("a", 1): (1.0, 2.0, False), ("b", 0): (1.0, 2.0, False)}
    assert done(spark, segments, [("a", 1, 50.0, 60.0, 70.0, 80.0)]) == replay(segments, [])


def test_random_edits(spark):
    rng = random.Random(33)
    bound = lambda: (float(s := rng.randint(0, 12)), s + float(rng.randint(1, 3)))
    segments = [(k, o, *bound()) for k in "abc" for o in range(25)]
    off = lambda: rng.choice([0, 0, 0.004, -0.006, 0.0099, 0.011])
    edits = [(rng.choice("abc"), i, (b := bound())[0] + off(), b[1] + off(), *((n := bound())[0] + off(), n[1])) for i in range(150)]
    assert done(spark, segments, edits) == replay(segments, edits)
    assert sum(v[2] for v in replay(segments, edits).values()) > 30


def test_a_long_chain_of_edits(spark):
    edits = [("a", i, float(i), i + 1.5, i + 1.0, i + 2.5) for i in range(300)]
    assert done(spark, [("a", 0, 0.0, 1.5)], edits) == {("a", 0): (300.0, 301.5, True)}


def results(spark, path, *keys):
    k = spark.createDataFrame([(x,) for x in keys], "cache_key string")
    return sorted(tuple(r) for r in detections.load(spark, path, k).select("cache_key", "n").collect())


def test_saving_again_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "cache_key string, n int")
    with pytest.raises(FileNotFoundError):
        detections.load(spark, path, rows(("aa", 1)))
    detections.save(rows(("aa1", 1), ("aa1", 2), ("aa2", 3), ("01b", 4), (None, 9)), path)
    assert results(spark, path, "aa1", "01b", "zz") == [("01b", 4), ("aa1", 1), ("aa1", 2)]
    detections.save(rows(("aa1", 5)), path)
    detections.save(rows(("aa1", 5)), path)
    assert results(spark, path, "aa1", "aa2", "01b") == [("01b", 4), ("aa1", 5), ("aa2", 3)]
    detections.save(rows(), path)
    assert results(spark, path, "aa1") == [("aa1", 5)]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path, batch = str(tmp_path / "t"), detections.sink(str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(r, "cache_key string, n int")
    batch(rows(("aa1", 1), ("aa2", 1)), 0)
    batch(rows(("aa1", 2)), 1)
    batch(rows(("aa1", 2)), 1)
    batch(rows(("aa1", 1), ("aa2", 1)), 0)
    assert results(spark, path, "aa1", "aa2") == [("aa1", 2), ("aa2", 1)]
    source, schema = str(tmp_path / "in"), "cache_key string, n int"
    for i in range(3):
        rows(("bb1", i), (f"bb{i}x", i)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(detections.sink(path + "2")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = results(spark, path + "2", "bb1", "bb0x", "bb1x", "bb2x")
    assert [k for k, _ in got] == ["bb0x", "bb1", "bb1x", "bb2x"]


def test_keys_of_any_text_are_scanned_again(spark):
    import struct

    key, rate = 'a\n"b\\\n', 10
    raw = b"".join(struct.pack("<h", 20000 if 100 <= i < 140 else 0) for i in range(600))
    chunks = spark.createDataFrame([(key, 0, bytearray(raw))], "source_key string, first_sample long, payload binary")
    windows = spark.createDataFrame([(key, 5.1, 35.1)], "source_key string, start_s double, end_s double")
    from ostinato.operators import detect

    got = rescan.rescan(windows, chunks, rate, detect.power_scorer(frame=1), Detection(precision=10, block_size=10, threshold=0.01, focus_idx=0, classes=2)).collect()
    assert got and {r["source_key"] for r in got} == {key} and min(r["start_s"] for r in got) >= 5.1
