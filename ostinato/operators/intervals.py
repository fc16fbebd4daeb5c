"""Interval algebra on (source_key, ordinal, start_s, end_s, ...).

Merges look at the running maximum of the ends before a row, which `ordered.running` finds without putting a whole source into one task. Order within a source is (start_s, ordinal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.operators.chains import longest_kept
from ostinato.operators.ordered import beside, running
from ostinato.session import written

#: Seconds of a source that are ordered together.
BUCKET_S = 6 * 3600.0


def _order() -> list[Column]:
    return [F.col("start_s"), F.col("ordinal")]


def _bucket(at: str, bucket_s: float = BUCKET_S) -> Column:
    return F.floor(F.col(at) / bucket_s)


def _before(rows: DataFrame, keys, bucket_s: float = BUCKET_S) -> DataFrame:
    """rows with `_max_end`, the highest end before a row."""
    return running(rows, list(keys), _bucket("start_s", bucket_s), _order(), {"_max_end": (F.col("end_s"), "max", False)})


def _groups(rows: DataFrame, new: Column, keys, bucket_s: float = BUCKET_S) -> DataFrame:
    """rows with `_max_end` -> with `grp` instead: raised by one where nothing is before a row or `new` holds."""
    first = F.when(F.col("_max_end").isNull() | new, 1).otherwise(0).cast("long")
    return running(rows, list(keys), _bucket("start_s", bucket_s), _order(), {"grp": (first, "sum", True)}).drop("_max_end")


def grouped(rows: DataFrame, starts_new, keys=("source_key",), bucket_s: float = BUCKET_S) -> DataFrame:
    """rows with `grp`: raised by one wherever starts_new(row's start, highest end before) holds, or nothing is before."""
    return _groups(_before(rows, keys, bucket_s), starts_new(F.col("start_s"), F.col("_max_end")), keys, bucket_s)


def _united(groups: DataFrame, keys, more=()) -> DataFrame:
    return groups.groupBy(*keys, "grp").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("n_merged"), *more).drop("grp")


def merged(rows: DataFrame, starts_new, keys=("source_key",), more=()) -> DataFrame:
    """One row for each group: first start, last end, number, and `more` aggregates."""
    return _united(grouped(rows, starts_new, keys), keys, more)


#: Columns that a merge makes itself; all others are the first row's.
_MADE = ("source_key", "kind", "start_s", "end_s", "pred", "grp")


def merge_reverify(rows: DataFrame, gap: float = 2.0) -> DataFrame:
    """Within (source, kind): merge while start <= end + gap. pred is the highest; all other columns (ordinal, suspect, top1_idx ...) are
    those of the first row by (start, ordinal), as it is that row which grows."""
    others = [c for c in rows.columns if c not in _MADE]
    first = F.min_by(F.struct(*others), F.struct("start_s", "ordinal")).alias("_first")
    out = merged(rows, lambda s, e: s > e + gap, ("source_key", "kind"), [F.max("pred").alias("pred"), first])
    return out.select(*[c for c in out.columns if c != "_first"], *[F.col(f"_first.{c}").alias(c) for c in others])


def union_original_new(original: DataFrame, new: DataFrame) -> DataFrame:
    """Both as one, tagged by `kind`; `place` counts each source's rows from 1 in their order: by start, of equal ones the original first,
    then by ordinal. Columns that only one side has are null on the other."""
    both = original.withColumn("kind", F.lit("original")).unionByName(new.withColumn("kind", F.lit("new")), allowMissingColumns=True)
    order = [F.col("start_s"), F.col("kind").desc(), F.col("ordinal")]
    return running(both, ["source_key"], _bucket("start_s"), order, {"place": (F.lit(1).cast("long"), "sum", True)})


def scan_windows(rows: DataFrame, window: float, cap: Column | None = None, gap: float = 1.0) -> DataFrame:
    """Windows around hits, cut at 0 and `cap`, empty ones dropped, joined while start <= end + gap."""
    end = F.col("end_s") + window
    w = rows.withColumn("start_s", F.greatest(F.lit(0.0), F.col("start_s") - window)).withColumn("end_s", end if cap is None else F.least(end, cap))
    return merged(w.filter("end_s > start_s"), lambda s, e: s > e + gap)


def keep_longer(rows: DataFrame, min_length: float | None = None, strict: bool = False) -> DataFrame:
    """Of two that overlap the longer stays, of equal ones the earlier: the chain of survivors from each source's first row (chains)."""
    out = longest_kept(rows, BUCKET_S)
    if min_length is None:
        return out
    length = F.col("end_s") - F.col("start_s")
    return out.filter(length > min_length if strict else length >= min_length)


def covered_original_anti(rows: DataFrame) -> DataFrame:
    """All but the 'original' rows that lie fully within a 'new' row of the same source."""
    new = rows.filter("kind = 'new'").select(F.col("source_key").alias("_k"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    inside = covering(rows.filter("kind = 'original'"), new)
    return rows.filter("kind <> 'original'").unionByName(inside.filter(~F.col("_covered")).drop("_covered"))


def covering(rows: DataFrame, others: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """rows with `_covered`: whether one of others (_k, _s, _e) holds it whole.

    Among the others that begin at or before a row, the highest end decides: no pairs are made. Both sides are swept in one order.
    """
    own = rows.select(*rows.columns, F.lit(None).cast("double").alias("_reach"), F.lit(1).alias("_row"), F.col("start_s").alias("_at"))
    cols = [F.col("_k").alias(c) if c == "source_key" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    ext = others.select(*cols, F.col("_e").alias("_reach"), F.lit(0).alias("_row"), F.col("_s").alias("_at"))
    both = running(own.unionByName(ext), ["source_key"], _bucket("_at", bucket_s), [F.col("_at"), F.col("_row")], {"_most": (F.col("_reach"), "max", True)})
    return both.filter("_row = 1").withColumn("_covered", F.coalesce(F.col("_most") >= F.col("end_s"), F.lit(False))).select(*rows.columns, "_covered")


def overlapping(rows: DataFrame, others: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """rows with `_overlaps`: whether one of others (_k, _s, _e) has _s < end and _e > start.

    Of the others that begin before a row's end, some end after its start iff the highest of their ends does.
    """
    own = rows.select(*rows.columns, F.lit(None).cast("double").alias("_reach"), F.lit(0).alias("_row"), F.col("end_s").alias("_at"))
    cols = [F.col("_k").alias(c) if c == "source_key" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    ext = others.select(*cols, F.col("_e").alias("_reach"), F.lit(1).alias("_row"), F.col("_s").alias("_at"))
    # a row's end comes before an equal start
    both = running(own.unionByName(ext), ["source_key"], _bucket("_at", bucket_s), [F.col("_at"), F.col("_row")], {"_most": (F.col("_reach"), "max", True)})
    return both.filter("_row = 0").withColumn("_overlaps", F.coalesce(F.col("_most") > F.col("start_s"), F.lit(False))).select(*rows.columns, "_overlaps")


def blocked_intervals(excluded: DataFrame, kept: DataFrame) -> DataFrame:
    """Excluded intervals of positive length that overlap no kept interval."""
    k = kept.select(F.col("source_key").alias("_k"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    return overlapping(excluded.filter("end_s > start_s"), k).filter(~F.col("_overlaps")).drop("_overlaps")


def _gaps(before: DataFrame) -> DataFrame:
    rows = before.filter(F.col("start_s") > F.col("_max_end"))
    return rows.select("source_key", "ordinal", F.col("_max_end").alias("start_s"), F.col("start_s").alias("end_s"))


def gaps(clips: DataFrame) -> DataFrame:
    """Rows (source_key, ordinal, start_s, end_s): the positive gap between the clips before a clip and itself."""
    return _gaps(_before(clips, ["source_key"]))


def _within(spans: DataFrame, blocked: DataFrame) -> DataFrame:
    b = blocked.select(F.col("source_key").alias("_k"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    return overlapping(spans, b).filter("_overlaps").select("source_key", "ordinal")


def gap_blocked(clips: DataFrame, blocked: DataFrame) -> DataFrame:
    """(source_key, ordinal) of clips with a blocked interval in the gap before them."""
    return _within(gaps(clips), blocked)


def _swept(clips: DataFrame, blocked: DataFrame | None, gap: float) -> DataFrame:
    """clips (source_key, ordinal, start_s, end_s) with `_max_end` and `_new`: whether a clip begins `gap` or more after the clips before it
    end, or something blocked lies between. Blocked intervals are swept along in the same order: one of them reaches into the gap before
    a clip iff, of those that begin before the clip, the highest end lies in or behind the gap."""
    own = clips.select("source_key", "ordinal", "start_s", "end_s", F.lit(0).alias("_blocks"))
    far = F.col("start_s") - F.col("_max_end") >= gap
    if blocked is None:
        return _before(own, ["source_key"]).withColumn("_new", far)
    other = blocked.select("source_key", F.lit(None).cast("long").alias("ordinal"), "start_s", "end_s", F.lit(1).alias("_blocks"))
    end = lambda k: (F.when(F.col("_blocks") == k, F.col("end_s")), "max", False)
    order = [F.col("start_s"), F.col("_blocks"), F.col("ordinal")]  # what begins with a clip isn't before it
    both = running(own.union(other), ["source_key"], _bucket("start_s"), order, {"_max_end": end(0), "_block_end": end(1)}).filter("_blocks = 0")
    stop = (F.col("start_s") > F.col("_max_end")) & F.coalesce(F.col("_block_end") > F.col("_max_end"), F.lit(False))
    return both.withColumn("_new", far | stop).drop("_block_end")


def merge_clips(clips: DataFrame, blocked: DataFrame | None = None, gap: float = 2.0, hold: bool = False) -> DataFrame:
    """Merge a clip into the one before when it begins less than `gap` after that ends, unless something blocked lies between. With hold
    the clips are written once, with what the sweep found, for plans that go on from here in several steps."""
    rows = _swept(clips, blocked, gap).drop("_blocks")
    rows = written(rows, "swept") if hold else rows
    return _united(_groups(rows, F.col("_new"), ["source_key"]), ["source_key"])


def pad_plain(rows: DataFrame, before: float, after: float) -> DataFrame:
    return rows.withColumn("start_s", F.col("start_s") - before).withColumn("end_s", F.col("end_s") + after)


def pad_clamped(rows: DataFrame, before: float, after: float) -> DataFrame:
    """Padding that never crosses a neighbour: the end stops at the next start, the start at the end before it, as padded.

    duration is that of the padded clip; fetch_start is cut at 0.
    """
    x = beside(rows, ["source_key"], _bucket("start_s"), _order(), {"_next": (F.col("start_s"), True), "_last": (F.col("end_s"), False)})
    x = x.withColumn("_end", F.least(F.col("end_s") + after, F.col("_next")))
    x = x.withColumn("_start", F.greatest(F.col("start_s") - before, F.least(F.col("_last") + after, F.when(F.col("_last").isNotNull(), F.col("start_s")))))
    return x.select(
        *[c for c in rows.columns if c not in ("start_s", "end_s")], F.col("_start").alias("start_s"), F.col("_end").alias("end_s"),
        (F.col("_end") - F.col("_start")).alias("duration"), F.greatest(F.lit(0.0), F.col("_start")).alias("fetch_start"),
    )


def safe_clip(rows: DataFrame, duration: Column, guard: Column, min_length: float = 1.0) -> DataFrame:
    """With a duration: drop what starts at or past the safe end (duration - guard), cut to [0, safe end], keep what is still
    long enough. Without: keep what is long enough as it is, and cut the start at 0."""
    end = F.greatest(F.lit(0.0), duration - guard)
    known = duration.isNotNull()
    x = rows.withColumns({"_s": F.greatest(F.lit(0.0), F.col("start_s")), "_e": F.when(known, F.least(F.col("end_s"), end)).otherwise(F.col("end_s"))})
    fits = F.when(known, (F.col("start_s") < end) & (F.col("_e") - F.col("_s") >= min_length)).otherwise(F.col("end_s") - F.col("start_s") >= min_length)
    return x.filter(fits).withColumns({"start_s": F.col("_s"), "end_s": F.col("_e")}).drop("_s", "_e")


def clips_dropped(rows: DataFrame, duration: Column, guard: Column, min_length: float = 1.0) -> DataFrame:
    """(source_key, n_dropped): how many of a source's clips safe_clip leaves out."""
    kept = safe_clip(rows, duration, guard, min_length).groupBy("source_key").agg(F.count(F.lit(1)).alias("_kept"))
    n = rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("_n"))
    return n.join(kept, "source_key", "left").select("source_key", (F.col("_n") - F.coalesce("_kept", F.lit(0))).alias("n_dropped"))


def clip_plan(segments: DataFrame, excluded: DataFrame, duration: DataFrame, merge_gap: float | None = 2.0, guard: float = 0.5, min_length: float = 1.0) -> DataFrame:
    """Segments -> (source_key, clip_no, start_s, end_s): merge, cut to the source, number. Merged clips don't overlap: each begins behind all
    ends before it. With merge_gap None nothing is merged, and of clips that overlap the shorter goes. The segments are written once."""
    if merge_gap is None:
        clips = segments.select("source_key", "ordinal", "start_s", "end_s")
    else:
        if merge_gap < 0:
            raise ValueError("merge_gap must be at least 0")
        clips = merge_clips(segments, blocked_intervals(excluded, segments), merge_gap, hold=True)
    clips = safe_clip(clips.join(duration, "source_key", "left"), F.col("duration"), F.lit(guard), min_length)
    if merge_gap is None:
        clips = keep_longer(clips.select("source_key", "ordinal", "start_s", "end_s"), min_length)
    order = [F.col("start_s"), F.col("end_s")]
    no = running(clips.select("source_key", "start_s", "end_s"), ["source_key"], _bucket("start_s"), order, {"clip_no": (F.lit(1).cast("long"), "sum", True)})
    return no.select("source_key", "clip_no", "start_s", "end_s")
