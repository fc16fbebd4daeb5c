"""Keep-longer as a chain of successors, on any number of tasks.

Of intervals in order of their start, the one that stands (the survivor so far) gives way to the first later one that starts at or
after its end, which leaves it behind as kept, or that is longer, which drops it. So each row has one successor, whatever happened before
it, and the rows that ever stand are the chain from a source's first row.

A source is cut into parts of at most PART rows. Inside a part successors come from binary searches and chains from pointer doubling,
on whole arrays. Between parts only terminals count: rows whose successor lies in a later part. They are few (none of the rows behind
them in the part is longer); the part that each goes on in is found by descent of a tree of (last start, greatest length), the terminals
on the chain by doubling over terminals. In the end each part knows where the chain enters it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.session import written

#: Rows of a part, parts below a node of the tree, parts whose terminals are looked up together.
PART, FAN, TOGETHER = 1 << 16, 16, 64
#: Rows of two numbers that are broadcast at most.
FEW = 1 << 20


def successors(start: np.ndarray, end: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each row the first one behind it that starts at or after its end or is longer; stop, where its source or part ends, if none."""
    n, i, length = len(start), np.arange(len(start)), end - start
    bits = int((stop - i).max(initial=0)).bit_length()
    low, high = i + 1, stop.copy()
    for _ in range(bits):
        middle = (low + high) >> 1
        left = low < high
        found = left & (start[np.minimum(middle, n - 1)] >= end)
        high = np.where(found, middle, high)
        low = np.where(left & ~found, middle + 1, low)
    tops = [length]  # the greatest length from a row on, of 1, 2, 4 ... rows
    while len(tops) <= bits and (w := 1 << len(tops) - 1) < n:
        wider = tops[-1].copy()
        wider[:-w] = np.maximum(tops[-1][:-w], tops[-1][w:])
        tops.append(wider)
    at = i + 1
    for k in reversed(range(len(tops))):
        over = (at + (1 << k) <= n) & (tops[k][np.minimum(at, n - 1)] <= length)
        at = np.where(over, at + (1 << k), at)
    return np.minimum(np.minimum(low, at), stop)


def _hops(following: np.ndarray, stop: np.ndarray):
    """1, 2, 4 ... steps along the chains; a chain's last row stays where it is."""
    i = np.arange(len(following))
    hop = np.where(following < stop, following, i)
    for _ in range(int((stop - i).max(initial=0)).bit_length()):
        yield hop
        hop = hop[hop]


def last_of_chains(following: np.ndarray, stop: np.ndarray) -> np.ndarray:
    last = np.arange(len(following))
    for hop in _hops(following, stop):
        last = hop[last]
    return last


def on_chains(following: np.ndarray, stop: np.ndarray, entries: np.ndarray) -> np.ndarray:
    on = np.zeros(len(following), bool)
    on[entries] = True
    for hop in _hops(following, stop):
        on[hop[np.flatnonzero(on)]] = True
    return on


def _runs(batch: pa.RecordBatch):
    """(first row, last row, start, end, ordinal, where each row's part begins and stops) of runs of parts of about PART rows in all."""
    x = batch.column(batch.schema.get_field_index("x"))
    offsets = x.offsets.to_numpy().astype(np.int64)
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, "right")) - 1)
        rows = x.values.slice(offsets[at], offsets[to] - offsets[at])
        start, ordinal, end = (rows.field(i) for i in range(3))
        own = offsets[at : to + 1] - offsets[at]
        sizes = np.diff(own)
        yield at, to, start.to_numpy(), end.to_numpy(), ordinal, np.repeat(own[:-1], sizes), np.repeat(own[1:], sizes)
        at = to


def _parts(rows: DataFrame, bucket_s: float, size: int) -> DataFrame:
    """(source_key, part, chunk, x): a source's rows in order. A part is so many neighbouring buckets of time as begin within `size` rows; one
    that has more, as a single bucket may, is cut into chunks."""
    cut = rows.dropna(subset=["start_s", "end_s"]).select("source_key", "ordinal", "start_s", "end_s", F.floor(F.col("start_s") / bucket_s).cast("long").alias("bucket"))
    counts = cut.groupBy("source_key", "bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("source_key").orderBy("bucket")) - F.col("_n")
    cut = cut.join(counts.select("source_key", "bucket", F.floor(before / size).cast("long").alias("part")), ["source_key", "bucket"])
    no = F.row_number().over(W.partitionBy("source_key", "part").orderBy("start_s", "ordinal"))
    cut = cut.withColumn("chunk", F.floor((no - 1) / size).cast("long"))
    return cut.groupBy("source_key", "part", "chunk").agg(F.sort_array(F.collect_list(F.struct("start_s", "ordinal", "end_s"))).alias("x"))


def _ends(parts: DataFrame) -> DataFrame:
    """(source_key, no, last_start, longest, head, terminals): head is the last row of the chain from the part's first row; terminals
    (pos, end, length) are the rows without a successor in the part."""

    def run(batches):
        for b in batches:
            out = []
            for at, _, start, end, _, first, stop in _runs(b):
                following = successors(start, end, stop)
                last = last_of_chains(following, stop)
                for i, (p, q) in enumerate(sorted(set(zip(first.tolist(), stop.tolist())))):
                    own = p + np.flatnonzero(following[p:q] == q)
                    t = [{"pos": int(k - p), "end": float(end[k]), "length": float(end[k] - start[k])} for k in own]
                    out.append((b.column("source_key")[at + i].as_py(), b.column("no")[at + i].as_py(), float(start[q - 1]), float((end - start)[p:q].max()), int(last[p] - p), t))
            kind = pa.list_(pa.struct([("pos", pa.int64()), ("end", pa.float64()), ("length", pa.float64())]))
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), kind]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["source_key", "no", "last_start", "longest", "head", "terminals"])

    return parts.select("source_key", "no", "x").mapInArrow(run, "source_key string, no long, last_start double, longest double, head long, terminals array<struct<pos:bigint,end:double,length:double>>")


def first_after(asked: DataFrame, nodes: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """asked (source_key, no, end, length, ...) -> with `target`, the first part of the source after `no` whose last_start reaches the end
    or whose longest is longer; without those that have none. nodes: source_key, no, last_start, longest; numbers are at most `most`.

    Up the tree the siblings behind a part are looked at, level by level; then down to the first child that fits.
    """
    levels = [nodes.select("source_key", F.lit(0).alias("level"), F.col("no").alias("node"), "last_start", "longest")]
    while most >= fan ** len(levels):
        up = levels[-1].groupBy("source_key", F.floor(F.col("node") / fan).cast("long").alias("node")).agg(F.max("last_start").alias("last_start"), F.max("longest").alias("longest"))
        levels.append(up.select("source_key", F.lit(len(levels)).alias("level"), "node", "last_start", "longest"))
    tree = levels[0]
    for level in levels[1:]:
        tree = tree.union(level)
    tree = tree.checkpoint()
    keep, fits = asked.columns, (F.col("last_start") >= F.col("end")) | (F.col("longest") > F.col("length"))

    def first_fit(candidates: DataFrame) -> DataFrame:
        found = candidates.withColumn("_at", F.explode("_at")).select(*keep, "_at.level", "_at.node").join(tree, ["source_key", "level", "node"]).filter(fits)
        return found.groupBy(*keep).agg(F.min(F.struct("level", "node")).alias("_f"))

    own = lambda k: F.floor(F.col("no") / fan**k).cast("long")
    behind = lambda k: F.when(own(k) % fan < fan - 1, F.sequence(own(k) + 1, own(k) - own(k) % fan + fan - 1)).otherwise(F.array().cast("array<bigint>"))
    named = lambda nodes, k: F.transform(nodes, lambda x: F.struct(F.lit(k).alias("level"), x.alias("node")))
    found = first_fit(asked.withColumn("_at", F.concat(*[named(behind(k), k) for k in range(len(levels))])))
    for k in reversed(range(1, len(levels))):
        high, node = F.col("_f.level") == k, F.col("_f.node")
        down = F.when(high, named(F.sequence(node * fan, node * fan + fan - 1), k - 1)).otherwise(F.array(F.col("_f")))
        found = first_fit(found.withColumn("_at", down).drop("_f"))
    return found.select(*keep, F.col("_f.node").alias("target")).checkpoint()


def _entered(parts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (source_key, no, pos, end, length, target) -> (source_key, no, pos, target, entry, to, clear): the successor's place in the
    target, the last row of the chain from there, and whether the successor leaves the terminal kept."""
    item = F.struct("no", "pos", "end", "length")
    lists = asked.groupBy("source_key", F.col("target").alias("no"), F.floor(F.col("no") / TOGETHER).alias("_some")).agg(F.collect_list(item).alias("asked")).drop("_some")

    def run(batches):
        for b in batches:
            of = lambda rows, k: rows.field(k).to_numpy()
            for at, to, start, end, _, first, stop in _runs(b):
                last = last_of_chains(successors(start, end, stop), stop)
                bounds = np.concatenate([np.unique(first), [len(start)]]) if len(start) else [0]
                for i in range(to - at):
                    p, q = bounds[i], bounds[i + 1]
                    rows = b.column("asked")[at + i].values
                    e = of(rows, "end")
                    longest = np.maximum.accumulate(end[p:q] - start[p:q])
                    entry = np.minimum(np.searchsorted(start[p:q], e), np.searchsorted(longest, of(rows, "length"), "right"))
                    key, no = b.column("source_key")[at + i].as_py(), b.column("no")[at + i].as_py()
                    n = len(entry)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * n, pa.string()), rows.field("no"), rows.field("pos"), pa.array([no] * n, pa.int64()), pa.array(entry.astype(np.int64)), pa.array((last[p + entry] - p).astype(np.int64)), pa.array(start[p + entry] >= e)],
                        ["source_key", "no", "pos", "target", "entry", "to", "clear"],
                    )

    both = parts.select("source_key", "no", "x").join(lists, ["source_key", "no"])
    return both.mapInArrow(run, "source_key string, no long, pos long, target long, entry long, to long, clear boolean")


def _reached(ends: DataFrame, edges: DataFrame, most_parts: int) -> DataFrame:
    """edges of the terminals that lie on their source's chain, by doubling from the first part's."""
    on = ends.groupBy("source_key").agg(F.min_by(F.struct("no", F.col("head").alias("pos")), "no").alias("_r")).select("source_key", "_r.no", "_r.pos")
    hop = edges.select("source_key", "no", "pos", F.col("target").alias("to_no"), F.col("to").alias("to_pos"))
    for _ in range(most_parts.bit_length()):
        on = on.union(on.join(hop, ["source_key", "no", "pos"]).select("source_key", F.col("to_no").alias("no"), F.col("to_pos").alias("pos"))).distinct().checkpoint()
        further = hop.select("source_key", F.col("no").alias("to_no"), F.col("pos").alias("to_pos"), F.col("to_no").alias("_no"), F.col("to_pos").alias("_pos"))
        hop = hop.join(further, ["source_key", "to_no", "to_pos"]).select("source_key", "no", "pos", F.col("_no").alias("to_no"), F.col("_pos").alias("to_pos")).checkpoint()
    return edges.join(on, ["source_key", "no", "pos"], "left_semi")


def _kept(parts: DataFrame) -> DataFrame:
    """parts (source_key, x, entry, lost: null or the place of a row that a later part drops) -> the rows kept."""

    def run(batches):
        for b in batches:
            entry, lost = b.column("entry").to_numpy(), b.column("lost").to_numpy(zero_copy_only=False)
            for at, to, start, end, ordinal, first, stop in _runs(b):
                base = np.unique(first) if len(start) else np.zeros(0, np.int64)
                following = successors(start, end, stop)
                keep = on_chains(following, stop, base + entry[at:to])
                keep &= (following == stop) | (start[np.minimum(following, len(start) - 1)] >= end)
                gone = ~np.isnan(lost[at:to].astype(float))
                keep[base[gone] + lost[at:to][gone].astype(np.int64)] = False
                i = np.flatnonzero(keep)
                source = b.column("source_key").take(pa.array(at + np.searchsorted(base, i, "right") - 1))
                yield pa.RecordBatch.from_arrays([source, ordinal.take(pa.array(i)), pa.array(start[i]), pa.array(end[i])], ["source_key", "ordinal", "start_s", "end_s"])

    return parts.select("source_key", "x", "entry", "lost").mapInArrow(run, "source_key string, ordinal long, start_s double, end_s double")


def longest_kept(rows: DataFrame, bucket_s: float, size: int = PART, fan: int = FAN) -> DataFrame:
    """rows (source_key, ordinal, start_s, end_s) -> those that stand when, of each two that overlap, the shorter goes, of equal ones the
    later. Rows with a null bound go. Parts are written once; where no source has two of them that is all."""
    parts = written(_parts(rows, bucket_s, size), "parts")
    of_source = parts.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("p1"), F.max("chunk").alias("c1"))
    most, total, last, chunks = of_source.agg(F.max("n"), F.sum("n"), F.max("p1"), F.max("c1")).first()  # four numbers
    if (most or 0) <= 1:
        return _kept(parts.select("source_key", "x", F.lit(0).cast("long").alias("entry"), F.lit(None).cast("long").alias("lost")))
    number = F.col("part") * (chunks + 1) + F.col("chunk")
    parts = parts.select("source_key", number.alias("no"), "x")
    ends = written(_ends(parts), "ends")
    t = ends.select("source_key", "no", F.explode("terminals").alias("t")).select("source_key", "no", "t.pos", "t.end", "t.length")
    asked = first_after(t, ends, (last + 1) * (chunks + 1) - 1, fan)
    edges = _reached(ends, written(_entered(parts, asked), "edges"), most)
    visits = edges.select("source_key", F.col("target").alias("no"), "entry").unionByName(ends.groupBy("source_key").agg(F.min("no").alias("no")).withColumn("entry", F.lit(0).cast("long")))
    plan = visits.join(edges.filter("not clear").select("source_key", "no", F.col("pos").alias("lost")), ["source_key", "no"], "left").checkpoint()  # one row a part at most
    return _kept(parts.join(F.broadcast(plan) if total <= FEW else plan, ["source_key", "no"]))
