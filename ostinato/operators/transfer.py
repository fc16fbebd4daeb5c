"""Transfer telemetry: figures of a sample, and alarms of slow streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WARM_UP, SLOW = 2, 2
#: Samples of a bucket and buckets of a group, if seq counts on by one.
BUCKET, GROUP = 1 << 10, 1 << 10


MIB = 1024 * 1024


def _least(c: str) -> Column:
    return F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)).cast("double")


def _figures(samples: DataFrame, total: Column, realtime: Column, speed: Column | None, busy: str) -> DataFrame:
    """Figures that all kinds share; eta_seconds where something moves towards a known end."""
    cur, t, rate = _least("current"), _least("elapsed"), F.when(_least("elapsed") > 0, _least("current") / _least("elapsed")).otherwise(0.0)
    percent = F.when(total > 0, F.least(F.lit(100.0), cur / total * 100))
    return samples.withColumns({
        "percent": percent, "speed_mb_s": speed if speed is not None else F.lit(None).cast("double"), "realtime": realtime,
        "eta_seconds": F.when((total > 0) & (rate > 0), F.greatest(F.lit(0.0), (total - cur) / rate)), "stage": F.when(percent == 100, "completed").otherwise(busy),
    })


def metrics(samples: DataFrame) -> DataFrame:
    """A transfer. samples (current, total, elapsed, source_duration) with percent, speed_mb_s, eta_seconds, realtime and stage.

    Bytes and seconds; negative and null ones count as 0, a total of null or 0 is unknown. realtime: seconds of the source a second, by
    the share that has come or, without a total, by all of it.
    """
    cur, t = _least("current"), _least("elapsed")
    total, length = F.when(F.col("total") != 0, _least("total")), F.col("source_duration").try_cast("double")
    done = F.when(total > 0, cur / total * length).otherwise(length)
    return _figures(samples, total, F.when((length > 0) & (t > 0), done / t), F.when(t > 0, cur / t).otherwise(0.0) / MIB, "transferring")


def block_metrics(samples: DataFrame) -> DataFrame:
    """Blocks of a detection done of all, at least one; nothing tells when it ends."""
    cur, t, total = F.floor(_least("current")), _least("elapsed"), F.greatest(F.floor(F.coalesce("total", F.lit(1.0))), F.lit(1)).cast("double")
    length = F.col("source_duration").try_cast("double")
    out = _figures(samples.withColumn("current", cur.cast("double")), total, F.when((length > 0) & (t > 0), F.col("current") / total * length / t), None, "transferring")
    return out.withColumn("eta_seconds", F.lit(None).cast("double"))


def compile_metrics(samples: DataFrame) -> DataFrame:
    """Seconds that are encoded of all; realtime is null where nothing has moved."""
    rate = F.when(_least("elapsed") > 0, _least("current") / _least("elapsed"))
    total = _least("total")
    out = _figures(samples, total, F.nullif(rate, F.lit(0.0)), None, "compiling")
    moved = F.when((total > 0) & (rate > 0), (total - _least("current")) / rate)  # below 0 past the end
    return out.withColumn("eta_seconds", moved)


def fetch_metrics(samples: DataFrame) -> DataFrame:
    """Seconds of a remote source that are fetched of all; realtime only where the total is known."""
    total, t = F.when(F.col("total") != 0, _least("total")), _least("elapsed")
    return _figures(samples, total, F.when((total > 0) & (t > 0), _least("current") / t), None, "transferring")


def slow_streak(samples: DataFrame, threshold: float, warm_up: int = WARM_UP, slow: int = SLOW, bucket: int = BUCKET) -> DataFrame:
    """samples (key, seq: whole numbers, speed) -> alarms (key, seq). The first `warm_up` samples don't count; `slow` in a row under the
    threshold raise an alarm, after which all begins anew. A null speed ends a streak; rows of equal seq follow by speed.

    What a sample does depends on one of warm_up + slow states alone: samples seen, or from then on the streak. So a bucket of samples
    is a map from the state before it to the state behind it; maps of buckets, and of runs of GROUP buckets, are composed to find the
    state that each bucket begins in, and then each bucket finds its own alarms. No task holds more than a bucket, or the maps of a
    group, or a key's groups.
    """
    states = warm_up + slow
    by = samples.select("key", F.floor(F.col("seq") / bucket).cast("long").alias("bucket"), "seq", F.coalesce(F.col("speed") < threshold, F.lit(False)).alias("low"), "speed")
    cut = by.groupBy("key", "bucket").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("speed").alias("v"), "low"))).alias("x"))
    wrap = lambda c: F.when(c == states, 0).otherwise(c)
    after = lambda state, low: F.when(state < warm_up, state + 1).when(low, wrap(state + 1)).otherwise(warm_up)
    same = F.array(*[F.lit(i) for i in range(states)])
    through = F.aggregate("x", same, lambda m, x: F.transform(m, lambda s: after(s, x["low"])))
    joined = lambda maps, start: F.aggregate(maps, start, lambda m, x: F.transform(m, lambda s: F.get(x["m"], s)))
    listed = lambda name: F.sort_array(F.collect_list(F.struct(name, "m"))).alias("maps")

    def begun(lists: DataFrame, keys: list[str], first: Column, name: str) -> DataFrame:
        """lists (keys, maps in order of `name`) -> (keys, name, state): the state before each, from `first` before all."""
        step = lambda a, x: F.struct(F.get(x["m"], a["s"]).alias("s"), F.concat(a["all"], F.array(F.struct(x[name].alias(name), a["s"].alias("state")))).alias("all"))
        none = F.slice(F.transform("maps", lambda x: F.struct(x[name].alias(name), F.lit(0).alias("state"))), 1, 0)
        runs = F.aggregate("maps", F.struct(first.alias("s"), none.alias("all")), step, lambda a: a["all"])
        return lists.select(*keys, F.inline(runs))

    maps = cut.select("key", "bucket", through.alias("m"))
    groups = maps.groupBy("key", F.floor(F.col("bucket") / GROUP).cast("long").alias("group")).agg(listed("bucket"))
    whole = groups.select("key", "group", joined(F.col("maps"), same).alias("m")).groupBy("key").agg(listed("group"))
    entered = begun(whole, ["key"], F.lit(0), "group").withColumnRenamed("state", "first")
    entered = begun(groups.join(entered, ["key", "group"]), ["key"], F.col("first"), "bucket")
    step = lambda a, x: F.struct(after(a["s"], x["low"]).alias("s"), F.when((a["s"] == states - 1) & x["low"], F.concat(a["at"], F.array(x["seq"]))).otherwise(a["at"]).alias("at"))
    empty = F.slice(F.transform("x", lambda x: x["seq"]), 1, 0)
    alarms = F.aggregate("x", F.struct(F.col("state").alias("s"), empty.alias("at")), step, lambda a: a["at"])
    return cut.join(entered, ["key", "bucket"]).select("key", F.explode(alarms).alias("seq"))
