"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry, all in whole numbers.

Nearest entries are found by equal-average search: entries are sorted by the sum of their components, and a part looks outward from its
own sum in both directions. The squared gap of two sums over the dimension is no more than the squared distance, so a direction ends
once that strictly exceeds the best distance so far; what stands beyond can't even tie. Codebooks live on the driver (entries x
dimension numbers); each task adds up its own parts by entry before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of this absolute value and more are as unusable as infinite ones: no double there has a fraction of 1 / SCALE.
HUGE = float(1 << 43)
#: Vectors that a task looks up at once.
STEP = 1 << 13
#: Labels, and bytes of their text, that are broadcast at most.
FEW_LABELS, FEW_BYTES = 1 << 16, 8 << 20


def usable(v: Column) -> Column:
    """Not null, without null, non-finite or huge components."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < HUGE)), F.lit(False))


class Book:
    """The entries of one part position, sorted by the sum of their components; of equal sums the lower index first."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.array(sorted(range(len(entries)), key=lambda i: (sums[i], i)), np.int64)
        self.entries, self.sums = entries[self.order], sums[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, its squared distance, how many distances were taken) for each row of x; ties go to the lower index."""
        n, width, last = len(x), x.shape[1], len(self.sums) - 1
        own = x.sum(axis=1)
        middle = np.searchsorted(self.sums, own)
        best, index, looked = np.full(n, -1, x.dtype), np.full(n, last + 1, np.int64), 0
        todo = {1: (np.arange(n), middle), -1: (np.arange(n), middle - 1)}  # rows that still look up, and down, and where
        while any(len(rows) for rows, _ in todo.values()):
            for way, (rows, at) in todo.items():
                inside = (at >= 0) & (at <= last)
                rows, at = rows[inside], at[inside]
                gap = self.sums[at] - own[rows]
                near = (best[rows] < 0) | (gap * gap <= best[rows] * width)
                rows, at = rows[near], at[near]
                d = x[rows] - self.entries[at]
                d = (d * d).sum(axis=1)
                entry = self.order[at]
                better = (best[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], entry[better]
                looked += len(rows)
                todo[way] = rows, at + way
        return index, best, looked


def _exact(x: np.ndarray, *others: np.ndarray) -> bool:
    """Whether sums and squares of these stay within 64 bits."""
    width = max(1, x.shape[-1])
    bits = 29 - int(np.ceil(np.log2(width)))
    return all(int(np.abs(v).max()) < 1 << bits for v in (x, *others) if v.size)


class Quantizer:
    """The codebooks of all part positions: (parts, entries, width) whole numbers."""

    def __init__(self, books: np.ndarray):
        self.raw, self.parts = books, len(books)
        self.wide = [Book(b.astype(object)) for b in books]
        self.books = [Book(b) for b in books] if _exact(books) else None

    def assign(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, squared distances), each (vectors, parts). Where 64 bits may not do, in Python's own whole numbers."""
        cut = q.reshape(len(q), self.parts, -1)
        fits = self.books is not None and _exact(cut)
        found = [(self.books if fits else self.wide)[p].nearest(cut[:, p] if fits else cut[:, p].astype(object)) for p in range(self.parts)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _vectors(batches, dim: int):
    """(batch, its `q` as a matrix) in steps."""
    for whole in batches:
        for at in range(0, whole.num_rows, STEP):
            b = whole.slice(at, STEP)
            yield b, b.column(b.schema.get_field_index("q")).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)


def _sums(rows: DataFrame, books: np.ndarray) -> list:
    """(part, entry, n, s...) of the entries that parts chose: as many rows as there are entries in all, at most."""
    parts, entries, width = books.shape

    def run(batches):
        of, n, total = Quantizer(books), np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for _, q in _vectors(batches, parts * width):
            index = of.assign(q)[0]
            cut = q.reshape(len(q), parts, width)
            for p in range(parts):
                n[p] += np.bincount(index[:, p], minlength=entries)
                own = np.zeros((entries, width), np.int64 if _exact(cut) else object)
                np.add.at(own, index[:, p], cut[:, p] if own.dtype == np.int64 else cut[:, p].astype(object))
                total[p] += own.astype(object)
        p, e = np.nonzero(n)
        s = pa.array([[Decimal(int(v)) for v in x] for x in total[p, e]], pa.list_(pa.decimal128(38)))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), s], ["part", "entry", "n", "s"])

    each = rows.select("q").mapInArrow(run, "part int, entry int, n long, s array<decimal(38,0)>")
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect()


def trained(rows: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """rows (q: whole numbers) and codebooks to start from -> codebooks after so many rounds: each entry becomes the floor of the mean of
    the parts that chose it; entries that none chose stay."""
    books = start
    for _ in range(rounds):
        new = books.astype(object)
        for r in _sums(rows, books):
            new[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(books.shape[2])]
        books = new.astype(np.int64)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def quantize(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(all columns, q): the usable rows and their components as floor(scale * x)."""
    v = F.col(f"`{embedding}`")
    q = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return vectors.withColumn("q", F.when(usable(v), q)).filter("q is not null")


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (q and others) -> the others, code (two hex digits a part) and error (squared distances, summed; null beyond 64 bits)."""
    others = [f for f in rows.schema if f.name != "q"]

    def run(batches):
        of = Quantizer(books)
        for b, q in _vectors(batches, books.shape[0] * books.shape[2]):
            index, d = of.assign(q)
            error = [int(x) if x < 1 << 63 else None for x in d.sum(axis=1)]
            raw = index.astype(np.uint8).tobytes().hex()
            code = [raw[i : i + 2 * of.parts] for i in range(0, len(raw), 2 * of.parts)]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in others], pa.array(code), pa.array(error, pa.int64())], [*[f.name for f in others], "code", "error"])

    kept = [F.col(f"`{f.name}`") for f in others]
    return rows.select(*kept, "q").mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "code string, error long"]))


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows (label, error, ...) with label_error, the error of all rows of a label; null labels are one. Sums are made in each task first;
    they are broadcast if they are counted to be few and short, else large labels are left to the join's own splitting."""
    totals = rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    totals = written(totals, "label_errors")
    n, size = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("_label").cast("string"))), F.lit(0))).first()
    small = n <= FEW_LABELS and size <= FEW_BYTES
    return rows.join(F.broadcast(totals) if small else totals, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each usable row.

    Null vectors and those with null, non-finite or huge components are left out. All others have one length, that of the least vec_id's
    vector, which `parts` divides, else it raises; vectors of other lengths are left out. Codebooks start from the `entries` least vec_ids
    (null ids last, of equal ids the least vector first), or from all rows if there are fewer. Rows of equal ids or vectors are rows of
    their own. Null labels count as one label. An empty table gives no row; extra columns aren't read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    column = lambda c: F.col(f"`{c}`")
    own = vectors.select(column(vec_id).cast("long").alias("vec_id"), column(label).alias("label"), column(embedding).alias("embedding"))
    rows = written(quantize(own).select("vec_id", "label", "q"), "quantized")
    order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    first = rows.orderBy(*order).select(F.size("q").alias("n")).first()
    dim = first["n"] if first else parts
    if dim % parts or not dim:
        raise ValueError(f"{dim} components aren't {parts} equal parts")
    rows = rows.filter(F.size("q") == dim)
    start = np.array([r["q"] for r in rows.orderBy(*order).select("q").limit(entries).collect()], np.int64)  # at most `entries` vectors
    start = start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2)
    books = trained(rows, start, rounds) if start.size else start
    done = written(coded(rows, books), "codes")
    return with_label_errors(done).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql(n: int) -> str:
    """All distances, round by round."""
    out = []
    for i in range(n + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, part, min((d, entry)) AS b FROM (SELECT vec_id, p.part, entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM p JOIN c{i} c ON c.part = p.part) GROUP BY 1, 2)""")
        if i < n:
            out.append(f"""m{i} AS (SELECT part, entry, list(f ORDER BY j) AS v FROM (SELECT part, b[2] AS entry, j, floor(sum(p.v[j])::DOUBLE / count(*))::BIGINT AS f FROM a{i} JOIN p USING (vec_id, part), range(1, 17) t(j) GROUP BY ALL) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry)""")
    return ",\n".join(out)


OP13_SQL = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, q[part * 16 + 1:part * 16 + 16] AS v FROM k, range(4) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{_rounds_sql(ROUNDS)},
e AS (SELECT vec_id, string_agg(printf('%02x', b[2]), '' ORDER BY part) AS code, sum(b[1])::BIGINT AS error FROM a{ROUNDS} GROUP BY 1),
l AS (SELECT k.label, sum(error)::BIGINT AS label_error FROM e JOIN k USING (vec_id) GROUP BY 1),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, 17)) AS j FROM c{ROUNDS}))
SELECT e.vec_id, code, error, label_error, codebooks_sha256 FROM e JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label, h"""
