"""Embedding near-duplicates by an epsilon grid order join.

Cosine >= t between unit vectors is a distance <= eps = sqrt(2 - 2 t). Vectors are turned onto their principal axes
(from one distributed sum of products about their mean), sorted by the eps-wide grid cells of the leading axes, and cut into blocks.
Block pairs descend a tree of bounding boxes, dropped once the boxes are more than eps apart; inside a task two sequence
intervals are halved in the same way down to small leaves, which are compared in double precision. A task gives a count
for each vector and a spanning forest of its links, so the output grows with vectors and not with pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import shared_dir, written

COSINE = 0.95
#: Vectors in a block and in a leaf, leading axes of the grid (CELL_BITS each) and of the boxes above the blocks, children of a node. A
#: block goes as a whole to each block that it may have links with: large ones are sent less often, leaves prune within them.
BLOCK, LEAF, AXES, CELL_BITS, BOX, FAN = 8192, 128, 6, 10, 16, 4
#: Bytes that a block's vectors have in a task at most, in double precision, unless a leaf has more.
BLOCK_BYTES = 8 << 20
SLACK = 1e-9


def usable(v: Column) -> Column:
    """Not null, not empty, without null or non-finite components, not all zero."""
    big = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(reps: DataFrame, dim: int) -> np.ndarray:
    """Principal axes as columns, largest first, from dim x dim sums of products and dim + 1 sums. Each task sends the upper half of one
    matrix; the driver gets one such half as Arrow columns, 16 bytes for each of its (dim + 1) (dim + 2) / 2 numbers."""
    size = dim + 1

    def run(batches):
        total = np.zeros((size, size))
        for b in batches:
            x = _unit(_matrix(b.column(0)))
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            total += x.T @ x
        at = np.flatnonzero(np.triu(np.ones((size, size), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["i", "x"])

    sums = reps.select("v").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    m = np.zeros(size * size)
    m[sums["i"].to_numpy()] = sums["x"].to_numpy()
    m = m.reshape(size, size)
    m += np.triu(m, 1).T
    mean = m[:-1, -1] / max(1, m[-1, -1])
    about = m[:-1, :-1] - m[-1, -1] * np.outer(mean, mean)
    return np.linalg.eigh((about + about.T) / 2)[1][:, ::-1].copy()


def _led(y: np.ndarray, leading: int) -> np.ndarray:
    """The leading axes and the length of the rest, which is one more axis: distances are at least those of such points."""
    return np.concatenate([y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(axis=1, keepdims=True))], axis=1)


def _gap2(lo1, hi1, lo2, hi2):
    d = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return (d * d).sum(axis=-1)


class _Side:
    """A block: multiplicities, unit vectors, the same on the axes, and boxes of its leaves."""

    def __init__(self, raw: bytes, n: bytes, turn: np.ndarray):
        self.n = np.frombuffer(n, np.int64)
        kind = np.float32 if len(raw) == 4 * len(self.n) * len(turn) else np.float64
        self.x = _unit(np.frombuffer(raw, kind).astype(np.float64).reshape(len(self.n), -1))
        self.y = self.x @ turn

    def box(self, i, j):
        return self.y[i:j].min(axis=0), self.y[i:j].max(axis=0)


def _join(a: _Side, b: _Side, same: bool, cosine: float):
    """Counts for a and b and link places (i, j), by halving both intervals until boxes part or leaves are small."""
    eps2 = 2 - 2 * cosine + SLACK
    na, nb = np.zeros(len(a.n), np.int64), np.zeros(len(b.n), np.int64)
    links = []
    boxes: dict = {}

    def box(which, side, i, j):
        if (which, i, j) not in boxes:
            boxes[which, i, j] = side.box(i, j)
        return boxes[which, i, j]

    todo = [(0, len(a.n), 0, len(b.n))]
    while todo:
        i, j, k, m = todo.pop()
        if same and i > k:
            continue
        if _gap2(*box(0, a, i, j), *box(1, b, k, m)) > eps2:
            continue
        if j - i > LEAF or m - k > LEAF:
            left = [(i, (i + j) // 2), ((i + j) // 2, j)] if j - i > LEAF else [(i, j)]
            right = [(k, (k + m) // 2), ((k + m) // 2, m)] if m - k > LEAF else [(k, m)]
            todo += [(*p, *q) for p in left for q in right]
            continue
        c = a.x[i:j] @ b.x[k:m].T
        r, s = np.nonzero(c >= cosine - SLACK)
        if not len(r):
            continue
        r, s = r + i, s + k
        exact = np.einsum("ij,ij->i", a.x[r], b.x[s])  # one way to add up for all that are near the limit
        keep = exact >= cosine
        if same:
            keep &= r < s
        r, s = r[keep], s[keep]
        np.add.at(na, r, b.n[s])
        np.add.at(nb, s, a.n[r])
        links.append((r, s))
    return na, nb, np.concatenate([x for x, _ in links] or [np.zeros(0, int)]), np.concatenate([x for _, x in links] or [np.zeros(0, int)])


def _blocks(reps: DataFrame, turn: np.ndarray, cosine: float, size: int, leading: int) -> DataFrame:
    """(block, lo, hi, ids, vs, ns): vectors in grid order; ids, vectors and multiplicities packed."""
    eps = float(np.sqrt(max(2 - 2 * cosine, 1e-12)))
    single = reps.schema["v"].dataType.elementType.simpleString() == "float"

    def cells(batches):
        for b in batches:
            y = np.floor((_unit(_matrix(b.column(1))) @ turn[:, :AXES]) / eps).astype(np.int64) + (1 << CELL_BITS - 1)
            key = np.zeros(len(y), np.int64)
            for j in range(y.shape[1]):
                key = (key << CELL_BITS) | np.clip(y[:, j], 0, (1 << CELL_BITS) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], ["id", "v", "n", "cell"])

    def pack(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list = []
        have = 0

        def out(t, seq):
            x = _matrix(t.column("v"))
            y = _led(_unit(x) @ turn, leading)
            x = x.astype(np.float32) if single else x
            ids, n = (t.column(c).to_numpy().astype(np.int64) for c in ("id", "n"))
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([(part << 32) + seq], pa.int64()), "lo": pa.array([y.min(axis=0).tolist()], pa.list_(pa.float64())), "hi": pa.array([y.max(axis=0).tolist()], pa.list_(pa.float64())),
                 "ids": pa.array([ids.tobytes()], pa.binary()), "vs": pa.array([x.tobytes()], pa.binary()), "ns": pa.array([n.tobytes()], pa.binary())}
            )

        for b in batches:
            held.append(b.select(["id", "v", "n"]))
            have += b.num_rows
            if have >= size:
                t = pa.Table.from_batches(held).combine_chunks()
                at = 0
                while have - at >= size:
                    yield out(t.slice(at, size).combine_chunks(), seq)
                    at, seq = at + size, seq + 1
                held, have = t.slice(at).to_batches(), have - at
        if have:
            yield out(pa.Table.from_batches(held).combine_chunks(), seq)

    schema = reps.schema
    ordered = reps.mapInArrow(cells, f"id long, v {schema['v'].dataType.simpleString()}, n long, cell long")
    ordered = written(ordered, "cells").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    return ordered.mapInArrow(pack, "block long, lo array<double>, hi array<double>, ids binary, vs binary, ns binary")


def _near_blocks(blocks: DataFrame, cosine: float, fan: int = FAN) -> DataFrame:
    """Pairs of blocks whose boxes are within eps, by descent from the root."""
    from pyspark.sql import Window as W

    leaves = blocks.select("block", "lo", "hi")
    counts = {r["part"]: r["n"] for r in leaves.groupBy(F.shiftright("block", 32).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a partition
    at, shift = 0, []
    for p in sorted(counts):
        shift += [F.lit(p), F.lit(at)]
        at += counts[p]
    part = F.shiftright("block", 32)
    node = F.row_number().over(W.partitionBy(part).orderBy("block")) - 1 + F.element_at(F.create_map(*shift), part)
    levels = [leaves.withColumn("node", node.cast("long")).checkpoint()]
    n, axes_n = at, len(blocks.select("lo").first()["lo"])
    while n > fan:
        low = levels[-1].groupBy((F.col("node") / fan).cast("long").alias("node"))
        lo = [F.min(F.get("lo", F.lit(i))) for i in range(axes_n)]
        hi = [F.max(F.get("hi", F.lit(i))) for i in range(axes_n)]
        levels.append(low.agg(F.array(*lo).alias("lo"), F.array(*hi).alias("hi")).checkpoint())
        n = -(-n // fan)
    pairs = blocks.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in reversed(levels):
        kids = lambda c: F.explode(F.sequence(F.col(c) * fan, F.col(c) * fan + fan - 1))
        pairs = pairs.select(kids("a").alias("a"), "b").select("a", kids("b").alias("b")).filter("a <= b")
        x = level.select(F.col("node").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
        y = level.select(F.col("node").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
        apart = F.zip_with(
            F.zip_with("la", "hb", lambda p, q: p - q), F.zip_with("lb", "ha", lambda p, q: p - q), lambda p, q: F.pow(F.greatest(F.lit(0.0), p, q), 2)
        )
        gap = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)
        pairs = pairs.join(x, "a").join(y, "b").filter(gap <= 2 - 2 * cosine + SLACK).select("a", "b").checkpoint()
    name = levels[0].select("node", "block")
    return pairs.join(name.withColumnsRenamed({"node": "a", "block": "block_a"}), "a").join(name.withColumnsRenamed({"node": "b", "block": "block_b"}), "b").select("block_a", "block_b")


def linked(reps: DataFrame, dim: int, cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """reps (id, v, n): distinct usable vectors of one length, with their numbers of copies -> (u, v, k): a row with null v
    counts k vectors linked to u; a row with v is a spanning link."""
    turn = axes(reps, dim)
    blocks = written(_blocks(reps, turn, cosine, block or min(BLOCK, max(LEAF, BLOCK_BYTES // (8 * dim))), min(BOX, dim)), "grid")
    pairs = _near_blocks(blocks, cosine)
    x = blocks.select(F.col("block").alias("block_a"), *[F.col(c).alias(f"{c}_a") for c in ("ids", "vs", "ns")])
    y = blocks.select(F.col("block").alias("block_b"), *[F.col(c).alias(f"{c}_b") for c in ("ids", "vs", "ns")])
    both = pairs.join(x, "block_a").join(y, "block_b")
    tasks = max(2, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = both.select("block_a", "block_b", "ids_a", "vs_a", "ns_a", "ids_b", "vs_b", "ns_b").repartition(tasks, F.xxhash64("block_a", "block_b"))

    def run(batches):
        for b in batches:
            for p, q, ia, va, ca, ib, vb, cb in zip(*[c.to_pylist() for c in b.columns]):
                one = _Side(va, ca, turn)
                two = one if p == q else _Side(vb, cb, turn)
                na, nb, r, s = _join(one, two, p == q, cosine)
                ids_a, ids_b = np.frombuffer(ia, np.int64), np.frombuffer(ib, np.int64)
                shift = 0 if p == q else len(ids_a)
                ids = ids_a if p == q else np.concatenate([ids_a, ids_b])
                n = na + nb if p == q else np.concatenate([na, nb])
                label = forest(r, s + shift, np.arange(len(ids)))
                own, got = np.nonzero(label != np.arange(len(ids)))[0], np.nonzero(n)[0]
                u = np.concatenate([ids[own], ids[got]])
                v = pa.array(np.concatenate([ids[label[own]], ids[got]]), mask=np.arange(len(u)) >= len(own))
                k = np.concatenate([np.zeros(len(own), np.int64), n[got]])
                yield pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(k)], ["u", "v", "k"])

    return both.mapInArrow(run, "u long, v long, k long")


def embedding_groups(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Equal vectors collapse to one before the search and count as links of one another. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing; vectors of different lengths never link. A null vec_id stays a
    row; it counts as a link, but a component is named by the least vec_id that isn't null. Extra columns aren't read.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    e = F.col(f"`{embedding}`")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(usable(e), e).alias("v")).withColumn("h", F.xxhash64("v"))
    rows = written(rows, "vectors")
    reps = rows.filter("v is not null").groupBy("h", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    # a number of its own for each distinct vector, as vec_id may be null or repeat
    reps = written(reps.withColumn("id", F.monotonically_increasing_id()), "distinct")
    found = None
    for (dim,) in reps.select(F.size("v")).distinct().collect():  # one number for each length
        part = linked(reps.filter(F.size("v") == dim).select("id", "v", "n"), dim, cosine)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "u long, v long, k long")
    found = written(found, "links")
    counts = found.filter("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("k").alias("k"))
    comp = components(found.filter("v is not null").select("u", "v")).withColumnsRenamed({"node": "id", "component": "c"})
    tagged = reps.select("id", "h", "v", "n", "least").join(counts, "id", "left").join(comp, "id", "left")
    tagged = written(tagged.select("id", "h", "v", "n", "least", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("c", "id").alias("c")), "tagged")
    least = tagged.groupBy("c").agg(F.min("least").alias("component_id")).checkpoint()
    tagged = written(tagged.join(least, "c").select("h", F.col("v").alias("v2"), (F.col("k") + F.col("n") - 1).alias("n_links"), "component_id"), "named")
    full = rows.join(tagged.withColumnRenamed("h", "h2"), (F.col("h") == F.col("h2")) & (F.col("v") == F.col("v2")), "left")
    comp_id = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), (F.col("vec_id") == comp_id).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs, and all that they reach.
OP8_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
