"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and MinHash find candidates, whole sets decide.

1. Rows with equal shingle sets collapse to one.
2. The Gray-order index of `simhash` links sets whose fingerprints differ in few bits. Sets of a similarity of 0.8 mostly differ in
   more bits than any index of 64 bits can bear (README), so bands of MinHash values find the others.
3. Each set's minima under BANDS x ROWS permutations give it a bucket in every band. At a similarity of 0.8 two sets miss each
   other in all 28 bands of 4 with a probability of 4e-7, at more with less.
4. Every set of a bucket is compared with the least row of the bucket, and linked fingerprints' sets with each other; the links
   that hold give components.
5. Where a bucket still has several components, all its pairs across components are compared, chunk by chunk.

Nothing is linked unless its whole sets have the similarity. Hot buckets spread: a bucket's sets are dealt into chunks, and in
step 5 only those outside the bucket's largest component meet the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .shared import checked, shared_dir, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 4
SEED = 42
#: Sets in a chunk of a bucket.
CHUNK = 256

_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False)
_MIX = _rng.integers(0, 1 << 64, ROWS, np.uint64, endpoint=False) | np.uint64(1)
_BAND = _rng.integers(0, 1 << 64, BANDS, np.uint64, endpoint=False)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of k lower-cased words. Fewer words are one shingle; none give no shingle."""
    w = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if len(w) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    at = zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in at), np.uint64, len(w) - k + 1))


def band_keys(x: np.ndarray) -> np.ndarray:
    """A set's bucket in each band; none for an empty set."""
    if not len(x):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (x[i : i + 2048, None] * _A + _B).min(axis=0))
    return ((low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def _signed(docs: DataFrame, row: str, text: str, keep: list[str], k: int) -> DataFrame:
    """(row, keep..., h1, h2, fp, bands): the digest of the row's shingle set, its fingerprint and its buckets."""

    def run(batches):
        for b in batches:
            h, keys, fp = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                x = shingles(t, k)
                h.append(xxhash.xxh3_128_digest(x.tobytes()))
                keys.append(band_keys(x))
                fp.append(np.packbits(simhash.bits_set(x) * 2 > len(x)).view(">i8")[0])
            both = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.array(fp, np.int64)), bands], ["row", *keep, "h1", "h2", "fp", "bands"])

    own = docs.select(F.col(f"`{row}`").alias("row"), *[F.col(f"`{c}`").cast("long").alias(c) for c in keep], F.col(f"`{text}`").alias("_text"))
    return own.mapInArrow(run, ", ".join(["row long", *[f"`{c}` long" for c in keep], "h1 long", "h2 long", "fp long", "bands array<long>"]))


def _sets(docs: DataFrame, rows: DataFrame, row: str, text: str, k: int) -> DataFrame:
    """(row, x): the shingle sets of some rows."""

    def run(batches):
        for b in batches:
            x = [shingles(t, k).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["row", "x"])

    own = docs.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text}`").alias("_text")).join(rows, "row", "left_semi")
    return own.mapInArrow(run, "row long, x binary")


def _similar(n_common, n_x, n_y, similarity: float):
    return n_common >= similarity * (n_x + n_y - n_common) - 1e-9


def _held(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (u, v) those whose sets are similar."""

    def run(batches):
        for b in batches:
            x, y = ([np.frombuffer(s, np.uint64) for s in b.column(c).to_pylist()] for c in (2, 3))
            ok = [_similar(min(len(p), len(q)), len(p), len(q), similarity) and _similar(len(np.intersect1d(p, q, True)), len(p), len(q), similarity) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.withColumnsRenamed({"row": "u", "x": "_x"}), "u").join(sets.withColumnsRenamed({"row": "v", "x": "_y"}), "v")
    return both.select("u", "v", "_x", "_y").mapInArrow(run, "u long, v long")


def _joined(xs: list, ys: list, cx: list, cy: list, similarity: float) -> set:
    """Pairs of components that a similar pair of sets, one of xs and one of ys, joins."""
    y = [np.frombuffer(s, np.uint64) for s in ys]
    n_y, of = np.array([len(s) for s in y]), np.array(cy)
    flat = np.concatenate(y)
    starts = np.concatenate([[0], np.cumsum(n_y)[:-1]])
    found = set()
    for s, c in zip(xs, cx):
        x = np.frombuffer(s, np.uint64)
        at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
        common = np.add.reduceat((x[at] == flat).astype(np.int64), starts)
        hit = _similar(common, len(x), n_y, similarity) & (of != c)
        found |= {(max(c, d), min(c, d)) for d in np.unique(of[hit]).tolist()}
    return found


def _across(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """members (key, rep, component) of buckets with several components -> links (u, v) between components."""
    by = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    by = by.groupBy("key").agg(F.max(F.struct("n", "component")).alias("_m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_components"))
    by = by.filter("n_components > 1").select("key", F.col("_m.component").alias("most"), F.ceil(F.col("n") / CHUNK).alias("chunks"), F.ceil((F.col("n") - F.col("_m.n")) / CHUNK).alias("others"))
    m = members.join(by.checkpoint(), "key").join(sets.withColumnRenamed("row", "rep"), "rep")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    m = written(m.select("key", "rep", "component", "x", (F.col("component") != F.col("most")).alias("other"), deal("chunks").alias("chunk"), deal("others").alias("part"), "chunks"), "mixed")
    item = lambda c, x: (F.collect_list("component").alias(c), F.collect_list("x").alias(x))
    right = m.groupBy("key", "chunk").agg(*item("cy", "y"))
    left = m.filter("other").groupBy("key", "part", "chunks").agg(*item("cx", "x"))
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)))

    def run(batches):
        for b in batches:
            for cx, x, cy, y in zip(*[c.to_pylist() for c in b.columns]):
                found = sorted(_joined(x, y, cx, cy, similarity))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    return left.join(right, ["key", "chunk"]).select("cx", "x", "cy", "y").mapInArrow(run, "u long, v long")


def _alike(reps: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets by their fingerprints: equal ones, each with the least row, and those that the Gray-order index links."""
    first = reps.groupBy("fp").agg(F.min("rep").alias("v")).checkpoint()
    equal = reps.select("fp", F.col("rep").alias("u")).join(first, "fp").filter("u <> v").select("u", "v")
    a, b = first.withColumnsRenamed({"fp": "a", "v": "x"}), first.withColumnsRenamed({"fp": "b", "v": "y"})
    links = simhash.near_links(first.select("fp")).toDF("a", "b").filter("a <> b").join(a, "a").join(b, "b")
    return equal.union(links.select(F.greatest("x", "y"), F.least("x", "y")))


def similar_groups(docs: DataFrame, row: str = "_row", text: str = "text", keep: list[str] | tuple = (), k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(row, keep..., component) for each row of docs: component is the least row that links of similar texts reach.

    row: a long of its own for each row, the same at every reading, as in a written table. Columns in keep are longs that are
    passed on. Texts without a word are one group.
    """
    shared_dir(docs.sparkSession)
    keep = list(keep)
    signed = written(_signed(docs, row, text, keep, k), "signed")
    reps = written(signed.groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "reps")
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).filter("n > 1").checkpoint()
    members = written(buckets.join(shared, "key").filter("rep <> pivot"), "members")
    pairs = members.select(F.col("rep").alias("u"), F.col("pivot").alias("v")).union(_alike(reps)).distinct().checkpoint()
    rows = pairs.select(F.col("u").alias("row")).union(pairs.select(F.col("v").alias("row"))).distinct()
    sets = written(_sets(docs, checked(rows), row, text, k), "sets")
    first = components(_held(pairs, sets, similarity).checkpoint()).withColumnRenamed("node", "rep").checkpoint()

    def named(df: DataFrame, c: str, by: DataFrame, old: Column) -> DataFrame:
        return df.drop("component").join(by, c, "left").withColumn("component", F.coalesce("component", old))

    # the pivot has been compared with all
    left = named(members.filter("n > 2").select("key", "rep"), "rep", first, F.col("rep")).checkpoint()
    second = components(_across(left, sets, similarity).checkpoint()).withColumnsRenamed({"node": "one", "component": "two"}).checkpoint()
    tagged = named(reps.select("h1", "h2", "rep"), "rep", first, F.col("rep"))
    tagged = tagged.join(second, tagged["component"] == second["one"], "left").select("h1", "h2", F.coalesce("two", "component").alias("component")).checkpoint()
    return signed.join(tagged, ["h1", "h2"]).select("row", *keep, "component")
