"""The narrowest covering segment against all pairs."""

import random

from pyspark.sql import functions as F

from ostinato.operators import reuse

CACHED, ASKED = "cached_id long, source_key string, start_s double, end_s double, media_type string", "request_id long, source_key string, start_s double, end_s double, padding double, media_type string"


def test_narrowest_cover(spark):
    rng = random.Random(31)
    span = lambda n: (float(s := rng.randint(-20, 60)), s + float(rng.randint(0, n)))
    cached = [(i, rng.choice("ab"), *span(25), rng.choice([None, "video", "AUDIO"])) for i in range(200)] + [(900, "a", 5.0, 1.0, None), (901, "c", 0.0, 9.0, None)]
    asked = [(i, rng.choice("abcd"), *span(8), rng.choice([None, 0.0, 1.5]), rng.choice([None, "Video", "audio"])) for i in range(300)]
    want = {}
    for i, k, s, e, pad, m in asked:
        s, e, m = s - (pad or 0), e + (pad or 0), (m or "video").lower()
        hits = [(ce - cs, cs, c) for c, ck, cs, ce, cm in cached if ck == k and (cm or "video").lower() == m and cs <= s and ce >= e and ce >= cs]
        if hits:
            want[i] = min(hits)[2]
    for bucket in (7.0, reuse.BUCKET_S):
        got = reuse.covering_segment(spark.createDataFrame(asked, ASKED), spark.createDataFrame(cached, CACHED), bucket)
        assert {r["request_id"]: r["cached_id"] for r in got.collect()} == want
    assert reuse.covering_segment(spark.createDataFrame(asked, ASKED), spark.createDataFrame([], CACHED)).collect() == []


def test_many_segments_of_like_length_make_no_pairs(spark):
    """All segments cover all requests: pairs would be 10 thousand million."""
    n = 100_000
    cached = spark.range(n).select(F.col("id").alias("cached_id"), F.lit("a").alias("source_key"), (F.col("id") / n).alias("start_s"), (F.col("id") / n + 1000).alias("end_s"), F.lit(None).cast("string").alias("media_type"))
    asked = spark.range(n).select(F.col("id").alias("request_id"), F.lit("a").alias("source_key"), (F.col("id") / n + 1).alias("start_s"), (F.col("id") / n + 2).alias("end_s"), F.lit(0.0).alias("padding"), F.lit(None).cast("string").alias("media_type"))
    out = reuse.covering_segment(asked, cached)
    widths = {r["cached_id"]: r["w"] for r in cached.select("cached_id", (F.col("end_s") - F.col("start_s")).alias("w")).collect()}
    least = min((w, i / n, i) for i, w in widths.items())[2]
    assert out.count() == n and {r["cached_id"] for r in out.select("cached_id").distinct().collect()} == {least}
