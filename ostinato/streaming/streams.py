"""Structured Streaming forms of the stateful operators. With availableNow they give what their batch forms give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ostinato.operators import detect
from ostinato.operators.transfer import SLOW, WARM_UP
from ostinato.params import Detection


def finished(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs over what is there now and gives the rows written, each once."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode("append").format("parquet").option("path", out).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def keeps_state(spark: SparkSession) -> None:
    """Processors with timers and lists of state need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Groups of keys that share their calls to the store of states: a call costs as much as thousands of rows.
GROUPS = 1024
#: A row that waits (microseconds, tie, speed: no number if unknown), and where a key's automaton is.
WAITS = [("key", "<i8"), ("at", "<i8"), ("tie", "<i8"), ("speed", "<f8")]
PLACES = [("key", "<i8"), ("seen", "<i8"), ("run", "<i8"), ("place", "<i8"), ("last", "<i8")]


class Streaks(StatefulProcessor):
    """Of a group of keys: rows wait in a list until the watermark has passed them, and then go through their key's automaton of slow
    streaks in order.

    The list has one value for all rows that arrive together, the automata of all keys are one value. One timer a group: at the first
    row that waits or, if earlier, `idle_ms` after the last one of a key without any, when the key's state goes.
    """

    def __init__(self, threshold: float, warm_up: int, slow: int, idle_ms: int | None):
        self.threshold, self.warm_up, self.slow, self.idle_ms = threshold, warm_up, slow, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machines = handle.getValueState("machines", "places binary, timer long")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np

        new, first = [], None
        for pdf in rows:
            if len(pdf):
                x = np.empty(len(pdf), WAITS)
                for name, _ in WAITS:
                    x[name] = pdf[name].to_numpy(x[name].dtype)
                new.append((x.tobytes(),))
                least = int(x["at"].min())
                first = least if first is None else min(first, least)
        if new:
            self.waiting.appendList(new)
            self._wake(first, *(self.machines.get() or (b"", -1)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import numpy as np
        import pandas as pd

        done = timerValues.getCurrentWatermarkInMs() * 1000
        machines = {k: v for k, *v in np.frombuffer(self.machines.get()[0], PLACES).tolist()}
        held = [np.frombuffer(v, WAITS) for (v,) in self.waiting.get()]
        rows = np.concatenate(held) if held else np.empty(0, WAITS)
        rows = rows[np.lexsort((rows["tie"], rows["at"], rows["key"]))]
        ready, rest, out = rows[rows["at"] <= done], rows[rows["at"] > done], []
        keys, starts = np.unique(ready["key"], return_index=True)
        for k, some in zip(keys.tolist(), np.split(ready, starts[1:])):
            seen, run, place, _ = machines.get(k, (0, 0, 0, 0))
            for below in (some["speed"] < self.threshold).tolist():
                place += 1
                run = run + 1 if seen >= self.warm_up and below else 0
                seen += 1
                if run >= self.slow:
                    out.append((k, place))
                    seen = run = 0
            machines[k] = (seen, run, place, int(some["at"][-1]))
        wake = [int(rest["at"].min())] if len(rest) else []
        if self.idle_ms is not None:
            busy, gone = set(rest["key"].tolist()), lambda v: v[-1] + 1000 * self.idle_ms
            machines = {k: v for k, v in machines.items() if k in busy or gone(v) > done}
            wake += [gone(v) for k, v in machines.items() if k not in busy]
        self.waiting.put([(rest.tobytes(),)]) if len(rest) else self.waiting.clear()
        places = np.array([(k, *v) for k, v in machines.items()], PLACES).tobytes()
        if wake:
            self._wake(min(wake), places, -1)
        elif machines:
            self.machines.update((places, -1))
        else:
            self.machines.clear()
        if out:
            yield pd.DataFrame(np.array(out, "int64"), columns=["key", "seq"])

    def _wake(self, at: int, places: bytes, timer: int) -> None:
        """Keeps the automata, with a timer when the watermark has passed `at`, in place of a later one."""
        ms = -(-at // 1000)
        if timer < 0 or ms < timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ms)
            self.machines.update((places, ms))

    def close(self) -> None:
        pass


def slow_streak(samples: DataFrame, threshold: float, warm_up: int = WARM_UP, slow: int = SLOW, late: str = "1 hour", idle_s: float | None = None) -> DataFrame:
    """Stream (key, ts, tie, speed) -> alarms (key, seq: the place among the key's samples), as the batch form gives them.

    Samples count in the order of (ts, tie) whatever batch they come in, as long as they come no more than `late` behind the latest ts;
    later ones are left out. An alarm comes out once the watermark has passed its sample, so the last ones do after a row that starts
    later, of whatever key (`closing`). With idle_s a key's state goes so long after its last sample; if it comes back it begins anew. Samples without a key are left out.
    """
    keeps_state(samples.sparkSession)
    group = F.pmod(F.xxhash64("key"), F.lit(GROUPS)).alias("group")
    s = samples.withWatermark("ts", late).filter("key is not null").select(group, "key", "ts", F.unix_micros("ts").alias("at"), "tie", "speed")
    processor = Streaks(threshold, warm_up, slow, None if idle_s is None else round(1000 * idle_s))
    return s.groupBy("group").transformWithStateInPandas(processor, "key long, seq long", "append", "eventTime")


def merged_sessions(segments: DataFrame, gap_us: int, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Stream (keys, start_ts, start_us, end_us) -> merged intervals: session windows that last to a segment's end and gap_us on.

    A segment that starts when the window ends still joins it, so gap_us microseconds are within, one more is not. A merged interval
    comes out once, when the watermark (`late` behind the latest start) has passed its end, and its state goes then; those that are
    still open when a stream ends come out after a row that starts later, of whatever key (`closing`).
    """
    gap = F.concat((F.col("end_us") - F.col("start_us") + gap_us).cast("string"), F.lit(" microseconds"))
    s = segments.withWatermark("start_ts", late)
    g = s.groupBy(*keys, F.session_window("start_ts", gap))
    return g.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("n_merged")).drop("session_window")


def closing(schema, **values) -> Callable[[SparkSession], DataFrame]:
    """One row of a stream's schema, which moves the watermark on; its own session stays open."""
    return lambda spark: spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def block_segments(blocks: DataFrame, precision: int, threshold: float, focus: int, block_size: int) -> DataFrame:
    """Stream of whole blocks (source_key, block_no, scores array<array<float>>) -> segments. No state: runs end with the block."""
    p = Detection(precision=precision, threshold=threshold, focus_idx=focus, block_size=block_size)

    def run(batches):
        import numpy as np

        for pdf in batches:
            frames = pdf["scores"].map(len)
            for _, some in pdf.groupby(frames):  # blocks of one length together
                yield detect.segments_frame(some["source_key"], some["block_no"], np.stack([np.stack(v) for v in some["scores"]]), p).drop(columns="top1_score")

    return blocks.mapInPandas(run, "source_key string, block_no long, start_s double, end_s double, pred double, suspect boolean, top1_idx int")


def missing_blocks(sources: DataFrame, blocks: DataFrame, wait: str, late: str = "1 hour") -> DataFrame:
    """Streams of sources (source_key, ts, n_expected) and of blocks (source_key, block_no, ts) -> (source_key, block_no, ts) of the blocks
    that didn't come within `wait` of their source.

    An outer join of two streams: a block that is expected is held until it comes, or until the watermark (`late` behind the latest ts of
    the slower stream) has passed its time; then it is missing, its state goes, and its source is incomplete.
    """
    s = sources.withWatermark("ts", late).select("source_key", "ts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_expected") - 1)).alias("block_no"))
    b = blocks.withWatermark("ts", late).select(F.col("source_key").alias("_key"), F.col("block_no").alias("_no"), F.col("ts").alias("_came"))
    in_time = (F.col("_came") >= F.col("ts")) & (F.col("_came") <= F.col("ts") + F.expr(f"INTERVAL {wait}"))
    both = s.join(b, (F.col("source_key") == F.col("_key")) & (F.col("block_no") == F.col("_no")) & in_time, "leftOuter")
    return both.filter("_key is null").select("source_key", "block_no", "ts")


def stream_of(spark: SparkSession, folder: str, schema, name: str | None = None) -> DataFrame:
    """A folder's Parquet files as a stream; name: only files of that name."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", name) if name else reader).parquet(folder)
