"""Review of segments: labels, selections by tolerance, edits, exclusions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.session import written

#: Seconds within which two bounds are the same.
TOLERANCE = 0.01


def strict_filter(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): suspect segments go to the excluded ones; an unknown flag is not suspect."""
    bad = F.coalesce(F.col("suspect"), F.lit(False))
    return segments.filter(~bad), segments.filter(bad)


def flatten(entries: DataFrame) -> DataFrame:
    """Entries with an array `timestamps` of structs -> rows, with what is missing filled: pred 0, kind original, not suspect."""
    rows = entries.select("source_key", F.posexplode("timestamps").alias("ordinal", "t"))
    return rows.select(
        "source_key", F.col("ordinal").cast("long").alias("ordinal"), "t.start_s", "t.end_s", F.coalesce("t.pred", F.lit(0.0)).alias("pred"),
        F.coalesce("t.kind", F.lit("original")).alias("kind"), F.coalesce("t.suspect", F.lit(False)).alias("suspect"),
    )


def nested(segments: DataFrame) -> DataFrame:
    """The other way: one row for each source, its segments in order."""
    item = F.struct("start_s", "ordinal", "end_s", "pred", "kind", "suspect")
    return segments.groupBy("source_key").agg(F.sort_array(F.collect_list(item)).alias("timestamps"))


def status(suspect: Column, kind: Column) -> Column:
    return F.when(F.coalesce(suspect, F.lit(False)), "Suspect").when(kind == "new", "New").otherwise("Original")


def summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("source_key").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("kind") == "new").alias("n_new"), F.count_if(F.coalesce("suspect", F.lit(False))).alias("n_suspect")
    )


def _cells(c: Column) -> Column:
    """The tolerance-wide cells in which a bound's equals may lie: an equi-key in place of a range condition."""
    k = F.floor(c / TOLERANCE)
    return F.explode(F.array(k - 1, k, k + 1))


def selected_semi(segments: DataFrame, picks: DataFrame) -> DataFrame:
    """Segments that a pick (source_key, start_s, end_s) matches within the tolerance at both ends."""
    p = picks.select(F.col("source_key").alias("_k"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e")).withColumn("_cell", _cells(F.col("_s")))
    s = segments.withColumn("_own", F.floor(F.col("start_s") / TOLERANCE))
    near = (F.abs(F.col("start_s") - F.col("_s")) < TOLERANCE) & (F.abs(F.col("end_s") - F.col("_e")) < TOLERANCE)
    return s.join(p, (F.col("source_key") == F.col("_k")) & (F.col("_own") == F.col("_cell")) & near, "left_semi").drop("_own")


def _linked(links: DataFrame) -> DataFrame:
    """links (a, b): pairs of numbers, each number in one at least -> (node, group), the least number that a node is linked with. Large
    and small stars by turns: every node hangs its larger neighbours, then its smaller ones, on the least of them, in some rounds a
    logarithm of a chain's length."""
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    at, was = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct().checkpoint(), None
    while (now := tuple(at.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())) != was:
        was = now
        both = at.union(at.select("lo", "hi"))
        large = both.join(both.groupBy("hi").agg(F.least("hi", F.min("lo")).alias("m")), "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct().checkpoint()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        at = moved.union(least.select("hi", F.col("m").alias("lo"))).distinct().checkpoint()
    group = at.select(F.col("hi").alias("node"), F.col("lo").alias("group"))
    return nodes.join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))


def _replayed(rows):
    """Rows (row or None for an edit, start, end, new start, new end) of one group, its segments in order and then its edits in order ->
    (row, start, end) of the segments that were edited, with the bounds that the last edit left."""
    import math

    cell = lambda x: math.floor(x / TOLERANCE)
    names, now, cells, edited = [], [], {}, set()
    for row, s, e, ns, ne in rows:
        if row is not None:
            cells.setdefault(cell(s), set()).add(len(now))
            names.append(row)
            now.append((s, e))
            continue
        k = cell(s)
        near = (i for c in (k - 1, k, k + 1) for i in cells.get(c, ()))
        i = min((i for i in near if abs(now[i][0] - s) < TOLERANCE and abs(now[i][1] - e) < TOLERANCE), default=None)
        if i is not None:
            cells[cell(now[i][0])].discard(i)
            now[i] = (ns, ne)
            cells.setdefault(cell(ns), set()).add(i)
            edited.add(i)
    return [(names[i], *now[i]) for i in sorted(edited)]


def _replays(batches):
    """Of rows in order of their group; a group may go over several batches."""
    from itertools import groupby

    import pyarrow as pa

    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    held: list = []
    out = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))], ["_row", "_start", "_end"])
    for _, group in groupby(rows, key=lambda r: r[0]):
        held += _replayed(r[1:] for r in group)
        if len(held) >= 10_000:
            yield out()
            held.clear()
    yield out()


def apply_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (source_key, edit_no, old_start, old_end, new_start, new_end), made one after another by edit_no: each moves the first segment of
    its source, in the order of ordinal, whose bounds are within the tolerance of the old ones at that time, as earlier edits left them.
    One with new_start >= new_end is refused, one that meets nothing does nothing. Segments keep their order. -> segments with `edited`.

    Edits that may meet one segment are one group: they look for bounds near each other's, or for bounds that another one leaves. Groups
    are found by linking edits in tolerance-wide cells and replayed apart, with the segments near them; others aren't touched.
    """
    e = edits.filter("new_start < new_end").withColumn("_id", F.monotonically_increasing_id())
    e = written(e.select("_id", "source_key", "edit_no", "old_start", "old_end", "new_start", "new_end"), "edits")
    at = lambda s: F.floor(F.col(s) / TOLERANCE).cast("long")
    # an edit touches the cells around its old start and the cell of its new one; the least edit of each cell stands for the cell
    around = e.select("_id", "source_key", F.explode(F.array(at("old_start") - 1, at("old_start"), at("old_start") + 1, at("new_start"))).alias("_cell"))
    first = around.groupBy("source_key", "_cell").agg(F.min("_id").alias("_first"))
    links = around.join(first, ["source_key", "_cell"]).select(F.col("_id").alias("a"), F.col("_first").alias("b"))
    group = _linked(links).withColumnsRenamed({"node": "_id", "group": "_group"})
    grouped = written(e.join(group, "_id"), "edit_groups")
    cells = around.join(group, "_id").select("source_key", "_cell", "_group").distinct()
    # the place of a segment: its ordinal, of equal ones by bounds
    own = written(segments.withColumn("_row", F.monotonically_increasing_id()), "reviewed")
    near = own.withColumn("_cell", at("start_s")).join(cells, ["source_key", "_cell"])
    none = F.lit(None).cast("double")
    both = near.select("_group", "_row", "start_s", "end_s", none.alias("new_start"), none.alias("new_end"), F.lit(0).alias("_kind"), F.col("ordinal").alias("_no")).union(
        grouped.select("_group", F.lit(None).cast("long"), "old_start", "old_end", "new_start", "new_end", F.lit(1), "edit_no")
    )
    both = both.repartition("_group").sortWithinPartitions("_group", "_kind", "_no", "start_s", "end_s", "_row")
    moved = both.select("_group", "_row", "start_s", "end_s", "new_start", "new_end").mapInArrow(_replays, "_row long, _start double, _end double")
    done = own.join(moved, "_row", "left")
    rest = [c for c in segments.columns if c not in ("start_s", "end_s")]
    return done.select(*rest, F.coalesce("_start", "start_s").alias("start_s"), F.coalesce("_end", "end_s").alias("end_s"), F.col("_start").isNotNull().alias("edited"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"_rs": F.round("start_s", 3), "_re": F.round("end_s", 3)})


def requested_semi(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """Segments whose bounds, at three decimals, are requested."""
    r = _rounded(requests).select("source_key", "_rs", "_re")
    return _rounded(segments).join(r, ["source_key", "_rs", "_re"], "left_semi").drop("_rs", "_re")


def excluded_by_review(before: DataFrame, selected: DataFrame) -> DataFrame:
    """What a review took out: (source_key, start_s, end_s) before it and not after, of sources that still have something."""
    s = _rounded(selected)
    left = before.join(selected.select("source_key").distinct(), "source_key", "left_semi")
    return _rounded(left).join(s, ["source_key", "_rs", "_re"], "left_anti").select("source_key", "start_s", "end_s")


def excluded_union(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("source_key", "start_s", "end_s")
    for p in parts[1:]:
        out = out.union(p.select("source_key", "start_s", "end_s"))
    return out
