"""Near-duplicate groups of the pipeline against all pairs' Jaccard similarity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ostinato.llm import near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(t):
    w = (t or "").lower().encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    """The least place that links of similar texts reach, of each text."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 10 * len(a & b) >= 8 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(texts))]


def changed(rng, text, share):
    """Some words replaced, in runs, so that similarities around 0.8 come about."""
    w = text.split()
    for _ in range(max(1, round(share * len(w)))):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    out = ["", None, " \n", "one", "One", "one two three four five", "one two three four five six"]
    for n in (8, 30, 120, 120, 600, 3000):
        base = prose(n)
        out += [base, base.upper(), *[changed(rng, base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1) for _ in range(4)]]
    hot = prose(200)  # one large group, in which many pairs are not similar
    out += [changed(rng, hot, 0.02) for _ in range(120)]
    return out + [prose(rng.randrange(5, 200)) for _ in range(60)]


@pytest.mark.parametrize("chunk", [near.CHUNK, 7])
def test_groups_are_those_of_all_pairs(spark, texts, chunk, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", chunk)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_row long, text string")
    got = {r["row"]: r["component"] for r in near.similar_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)


def test_near_stage_drops_texts_of_similarity_08(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, "").collect())
    assert kept == sorted(set(brute_groups(texts)))


def test_star_misses_are_found_across_components(spark):
    """A bucket whose least set is similar to neither of two that are similar to each other."""
    rng = np.random.default_rng(2)
    base = np.sort(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    x = {0: base[:60], 1: base, 2: base[2:], 3: np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64))}
    sets = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in x.items()], "row long, x binary")
    members = spark.createDataFrame([(9, 1, 1), (9, 2, 2), (9, 3, 3)], "key long, rep long, component long")
    assert [tuple(r) for r in near._across(members, sets, 0.8).collect()] == [(2, 1)]
    pairs = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "u long, v long")
    assert [tuple(r) for r in near._held(pairs, sets, 0.8).collect()] == [(2, 1)]


def test_no_texts(spark):
    df = spark.createDataFrame([], "_row long, text string")
    assert near.similar_groups(df).count() == 0
    assert near.similar_groups(df.withColumn("n", F.lit(1)), keep=["n"]).columns == ["row", "n", "component"]
