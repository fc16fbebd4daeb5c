"""Codes against a plain loop over all entries, and the search itself against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from ostinato.llm import vq


def plain(rows, parts=4, entries=256, rounds=4):
    """rows (vec_id, embedding, label) -> the rows of the result, by loops."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, v, _ in kept:
                own[best(cut(v, p), book)[1]].append(cut(v, p))
            new.append([[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(own, book)])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, [best(cut(v, p), books[p]) for p in range(parts)], label) for i, v, label in kept]
    total = {}
    for _, found, label in out:
        total[label] = total.get(label, 0) + sum(d for d, _ in found)
    return [(i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), total[label], sha) for i, found, label in out]


KEY = lambda r: tuple(str(x) for x in r)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")


@pytest.mark.parametrize(("width", "high"), [(1, 3), (4, 40), (16, 1000)])
def test_the_search_finds_what_all_distances_find(width, high):
    rng = np.random.default_rng(13)
    for n in (1, 2, 50):
        entries, x = rng.integers(-high, high, (n, width)), rng.integers(-high, high, (300, width))
        index, d, looked = vq.Book(entries).nearest(x)
        every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all() and looked <= every.size
        wide = vq.Book(entries.astype(object)).nearest(x.astype(object))
        assert (wide[0] == index).all() and (wide[1].astype(np.int64) == d).all()


def test_the_search_leaves_far_entries_out():
    rng = np.random.default_rng(1)
    entries = np.repeat(np.arange(0, 25600, 100)[:, None], 8, axis=1) + rng.integers(0, 5, (256, 8))
    assert vq.Book(entries).nearest(entries + 1)[2] < 256 * 5


def test_ties_go_to_the_lower_index():
    entries = np.array([[3, -3], [1, 1], [0, 2], [2, 0], [1, 1], [-3, 3]])
    assert vq.Book(entries).nearest(np.array([[1, 1], [0, 0], [1, 0]]))[0].tolist() == [1, 1, 1]
    assert vq.Book(np.array([[5], [-5]])).nearest(np.array([[0]]))[0].tolist() == [0]
    assert vq.Book(np.array([[-5], [5]])).nearest(np.array([[0]]))[0].tolist() == [0]


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(KEY, map(tuple, vq.op13_vector_codes(spark, sf).collect()))) == sorted(map(KEY, plain(rows)))


def test_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(KEY, duck.execute(vq.OP13_SQL).fetchall())) == sorted(map(KEY, map(tuple, vq.op13_vector_codes(spark, sf).collect())))


def test_odd_rows(spark):
    rng = random.Random(13)
    vector = lambda n=8: [rng.choice([0.0, -0.0, -0.0001, rng.uniform(-2, 2), rng.uniform(-2, 2)]) for _ in range(n)]
    rows = [(rng.randrange(40), vector(), rng.choice(["a", "b", None])) for _ in range(60)]
    rows += [(None, vector(), "a"), (None, vector(), None), (3, None, "a"), (4, [None, *vector(7)], "a"), (5, [float("nan"), *vector(7)], "b"), (6, [float("inf"), *vector(7)], None)]
    rows += rows[:3] + [(-9, rows[0][1], "a")]
    for entries, parts in ((256, 4), (5, 4), (1, 2), (7, 8)):
        got = vq.vector_codes(frame(spark, rows).repartition(3), parts=parts, entries=entries)
        assert sorted(map(KEY, map(tuple, got.collect()))) == sorted(map(KEY, plain(rows, parts, entries)))


def test_large_components_are_exact_and_huge_ones_unusable(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e5, 4e5) for _ in range(4)], None) for i in range(20)]
    huge = [(50, [1e300, 0.0, 0.0, 0.0], None)]
    got = vq.vector_codes(frame(spark, rows + huge), entries=3)
    assert sorted(map(KEY, map(tuple, got.collect()))) == sorted(map(KEY, plain(rows, entries=3)))


def test_edges(spark):
    df = frame(spark, [(1, [1.0, 2.0, 3.0, 4.0], "a"), (2, [1.0, 2.0, 3.0], "a"), (3, [], "a")])
    clash = df.withColumns({"q": df["vec_id"], "code": df["vec_id"], "error": df["label"], "_label": df["label"]})
    assert [tuple(r)[:4] for r in vq.vector_codes(clash).collect()] == [(1, "00000000", 0, 0)]
    assert vq.vector_codes(df.limit(0)).collect() == []
    assert vq.vector_codes(df.filter("vec_id > 5")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vq.vector_codes(df.filter("vec_id > 1"))
    hot = frame(spark, [(i, [i % 3 * 1.0] * 4, None) for i in range(3000)])
    assert {tuple(r)[2:4] for r in vq.vector_codes(hot, entries=3).collect()} == {(0, 0)}
