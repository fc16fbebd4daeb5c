"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are range-sorted by Gray rank, so neighbours share most bits, and packed into blocks. Every node
above holds the bits that all below agree on (mask, value); a pair of nodes is dropped with all its leaves once the
agreed bits alone differ in more than the limit. The pairs that are left descend level by level, first as joins of node
tables, then inside a task within two blocks. A task gives a spanning forest of the links it finds, not the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import shared_dir, written

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints in a block, in a leaf of the tree inside a block, and children of a node above the blocks.
BLOCK, LEAF, FAN = 4096, 16, 8


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Bits that over half of the shingles' hashes have. No words: 0."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) <= k:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, digest = len(w) - k + 1, xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    at, to = starts[:n].tolist(), ends[k - 1 :].tolist()
    for i in range(0, n, 1 << 16):
        counts += bits_set(np.array([digest(joined[a:b], SEED) for a, b in zip(at[i : i + 65536], to[i : i + 65536])], np.uint64))
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp a long that holds the 64 bits. Null or blank text: 0."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(x, k) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """The fingerprint's place in the reflected Gray order, shifted so that signed order is unsigned order."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _agreed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over the last axis: the bits that all agree on, and their values."""
    both, some = np.bitwise_and.reduce(x, axis=-1), np.bitwise_or.reduce(x, axis=-1)
    return ~(both ^ some), both


def _padded(blob: bytes) -> np.ndarray:
    x = np.frombuffer(blob, np.uint64)
    return np.concatenate([x, np.repeat(x[-1:], -len(x) % LEAF)]).reshape(-1, LEAF)


def _links(a: bytes, b: bytes | None, distance: int):
    """Spanning links (u, v) among the fingerprints of two blocks, or inside one."""
    x = _padded(a)
    y = x if b is None else _padded(b)
    mx, vx = _agreed(x)
    my, vy = _agreed(y)
    shift = 0 if b is None else x.size
    values = x.ravel() if b is None else np.concatenate([x.ravel(), y.ravel()])
    label = np.arange(len(values))
    # two levels of the tree: nodes of LEAF leaves, then leaves
    for i in range(0, len(x), 64):
        may = np.bitwise_count((vx[i : i + 64, None] ^ vy[None, :]) & mx[i : i + 64, None] & my[None, :]) <= distance
        ia, ib = np.nonzero(may)
        ia += i
        if b is None:
            keep = ia <= ib
            ia, ib = ia[keep], ib[keep]
        for j in range(0, len(ia), 2048):
            p, q = ia[j : j + 2048], ib[j : j + 2048]
            near = np.bitwise_count(x[p][:, :, None] ^ y[q][:, None, :]) <= distance
            c, r, s = np.nonzero(near)
            if len(c):
                label = forest(p[c] * LEAF + r, q[c] * LEAF + s + shift, label)
    own = np.nonzero(label != np.arange(len(values)))[0]
    return values[own], values[label[own]]


def _blocks(reps: DataFrame, size: int) -> DataFrame:
    """(block, mask, value, fps): consecutive fingerprints in Gray order, cut where a partition ends."""

    def run(batches):
        from pyspark import TaskContext

        part, seq, rest = TaskContext.get().partitionId(), 0, np.zeros(0, np.uint64)

        def row(x):
            m, v = _agreed(x)
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([(part << 32) + seq], pa.int64()), "mask": pa.array([m.view(np.int64)], pa.int64()), "value": pa.array([v.view(np.int64)], pa.int64()), "fps": pa.array([x.tobytes()], pa.binary())}
            )

        for b in batches:
            rest = np.concatenate([rest, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            while len(rest) >= size:
                yield row(rest[:size])
                rest, seq = rest[size:], seq + 1
        if len(rest):
            yield row(rest)

    ranked = reps.select("fp", gray_rank(F.col("fp")).alias("g")).repartitionByRange("g").sortWithinPartitions("g").select("fp")
    return ranked.mapInArrow(run, "block long, mask long, value long, fps binary")


def near_blocks(blocks: DataFrame, distance: int = DISTANCE, fan: int = FAN) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose agreed bits differ in at most `distance` places, by descent from the root."""
    leaves = blocks.select("block", "mask", "value").repartitionByRange("block").sortWithinPartitions("block")
    # consecutive numbers: a partition's rows follow those of the partitions before it
    part = leaves.withColumn("_p", F.spark_partition_id()).checkpoint()
    before = {r["_p"]: r["n"] for r in part.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a partition
    at, first = 0, {}
    for p in sorted(before):
        first[p], at = at, at + before[p]
    from pyspark.sql import Window as W

    shift = F.create_map(*[F.lit(x) for kv in first.items() for x in kv]) if first else F.create_map(F.lit(0), F.lit(0))
    node = part.withColumn("node", (F.row_number().over(W.partitionBy("_p").orderBy("block")) - 1 + F.element_at(shift, F.col("_p"))).cast("long"))
    levels = [node.select("node", "mask", "value", "block").checkpoint()]
    n = at
    while n > fan:
        low = levels[-1].groupBy((F.col("node") / fan).cast("long").alias("node"))
        # bits agreed below, whose values agree too
        up = low.agg(F.bit_and("mask").alias("m"), F.bit_and("value").alias("x"), F.bit_or("value").alias("y"))
        levels.append(up.select("node", F.col("m").bitwiseAND(F.bitwise_not(F.col("x").bitwiseXOR(F.col("y")))).alias("mask"), F.col("x").alias("value")).checkpoint())
        n = -(-n // fan)
    spark = blocks.sparkSession
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in reversed(levels):
        kids = lambda c: F.explode(F.sequence(F.col(c) * fan, F.col(c) * fan + fan - 1))
        pairs = pairs.select(kids("a").alias("a"), "b").select("a", kids("b").alias("b")).filter("a <= b")
        x = level.select(F.col("node").alias("a"), F.col("mask").alias("ma"), F.col("value").alias("va"))
        y = level.select(F.col("node").alias("b"), F.col("mask").alias("mb"), F.col("value").alias("vb"))
        near = F.bit_count(F.col("va").bitwiseXOR(F.col("vb")).bitwiseAND(F.col("ma")).bitwiseAND(F.col("mb"))) <= distance
        pairs = pairs.join(x, "a").join(y, "b").filter(near).select("a", "b").checkpoint()
    name = levels[0].select("node", "block")
    return pairs.join(name.withColumnsRenamed({"node": "a", "block": "block_a"}), "a").join(name.withColumnsRenamed({"node": "b", "block": "block_b"}), "b").select("block_a", "block_b")


def near_links(reps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) with the same components as all pairs at `distance` bits or fewer."""
    blocks = written(_blocks(reps, block), "gray")
    pairs = near_blocks(blocks, distance)
    x = blocks.select(F.col("block").alias("block_a"), F.col("fps").alias("x"))
    y = blocks.select(F.col("block").alias("block_b"), F.col("fps").alias("y"))
    both = pairs.join(x, "block_a").join(y, "block_b").select("block_a", "block_b", "x", "y")
    tasks = max(2, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = both.repartition(tasks, F.xxhash64("block_a", "block_b"))

    def run(batches):
        for b in batches:
            for p, q, x, y in zip(*[c.to_pylist() for c in b.columns]):
                u, v = _links(x, None if p == q else y, distance)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64), pa.int64()), pa.array(v.view(np.int64), pa.int64())], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: component_id is the least doc_id that links reach.

    Equal fingerprints collapse to one before the search, so copies cost nothing there. Null or blank text has
    fingerprint 0 and links like any other. Null doc_ids count only if a group has no other. Extra columns aren't read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    fps = written(fingerprints(docs, doc_id, text, k), "fps")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comp = components(near_links(reps.select("fp"), distance)).withColumnRenamed("node", "fp").checkpoint()
    tagged = reps.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp")).checkpoint()
    least = tagged.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = tagged.join(least.checkpoint(), "component").select("fp", "component_id").checkpoint()
    return fps.join(named, "fp")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
