"""The pipeline's stages on null and repeated doc_ids and near copies, by their rows, against brute force."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ostinato.llm import mixing, packing, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOPICS = ["cat", "house", "river", "garden", "winter", "letter"]


def prose(n, start=0):
    return " ".join(f"{TOPICS[(start * 5 + i * i) % 6]}{(start * 977 + i * 7919) % 4001}" for i in range(n))


def row(doc_id, text, source="s1"):
    return (doc_id, text, "en", source, len(text))


def shingle_set(t):
    w = t.lower().encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    """Texts of the rows that stay: of each group the least doc_id's, null last; groups by all pairs."""
    sets, group = [shingle_set(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = {}
    for r, g in zip(rows, group):
        out.setdefault(g, []).append(r)
    # of equal ids any row may stay; all of a group's rows with its id that could
    return [[r for r in rs if r[0] == min((x[0] for x in rs if x[0] is not None), default=None)] for rs in out.values()]


@pytest.fixture(scope="module")
def rows():
    a, b, c, d = prose(100, 1), prose(100, 2), prose(80, 3), prose(300, 4)
    near = d.split()
    near[150] = "other"
    return [
        row(1, a), row(1, a), row(1, b), row(2, b), row(None, c), row(None, c), row(None, prose(90, 5), "s2"), row(3, d), row(None, " ".join(near)), row(4, " ".join(near[:-3])),
        row(5, prose(60, 6)), row(5, prose(60, 7)), row(5, prose(60, 8), "s2"), row(None, prose(60, 9), None),
    ]


def test_near_stage_keeps_one_row_of_each_group(spark, rows):
    got = [tuple(r) for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    want = brute_near(rows)
    assert len(got) == len(want) == 9
    for choices in want:
        assert sum(r in choices for r in set(got)) == 1
    assert Counter(got).most_common(1)[0][1] == 1


def test_mix_stage_gives_each_row_its_copies(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = corpus_pipeline.mix_stage(spark, df, "").collect()
    # words taken, of all rows of an id, and of all rows of a source
    taken = mixing.mixed(df).collect()
    for of in (lambda r: r["doc_id"], lambda r: r["source"]):
        want, have = Counter(), Counter()
        for r in taken:
            want[of(r)] += r["taken"]
        for r in got:
            have[of(r)] += len(r["text"].split())
        assert +want == +have
    texts = [" ".join(r[1].split()) for r in rows]
    copies = Counter(r["text"] for r in got)
    for t, n in copies.items():
        owners = [r for r, s in zip(rows, texts) if t in s]
        assert owners and n <= 2 * len(owners)
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}


def test_mix_stage_of_one_repeated_id(spark):
    """k rows of one id are k rows, not k times k."""
    rows = [row(7, prose(64, k)) for k in range(6)] + [row(None, prose(64, k), "s2") for k in range(10, 16)]
    got = corpus_pipeline.mix_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    n = sum(len(r["text"].split()) for r in got)
    assert abs(n - 1.5 * 64 * 12) <= 3 * mixing.BLOCK
    assert all(c <= 2 for c in Counter((r["source"], r["text"]) for r in got).values())


@pytest.fixture(scope="module")
def corpus(spark):
    """The table's rows, some again under null and other doc_ids, and odd ones."""
    own = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    again = [(None, *r[1:]) for r in own[:30]] + [(own[0][0], *r[1:]) for r in own[30:50]] + own[50:60]
    return own + again + [(None, None, None, None, None), (7, None, "en", None, None), (8, "", "en", "s", 0), (9, " \n\t", None, "s", 3)]


def test_quality_stage_against_sql(spark, corpus):
    import pandas as pd

    c = duckdb.connect()
    c.register("rows", pd.DataFrame({"doc_id": range(len(corpus)), "text": [r[1] for r in corpus]}))
    c.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text FROM rows")
    kept = [corpus[r[0]] for r in c.execute(f"SELECT doc_id FROM ({quality.OP3_SQL}) WHERE kept").fetchall()]
    got = [tuple(r) for r in corpus_pipeline.quality_stage(spark, spark.createDataFrame(corpus, SCHEMA), "").collect()]
    assert Counter(got) == Counter(kept) and 0 < len(kept) < len(corpus)


def test_line_stage_by_a_plain_count(spark, corpus):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\f\r"))
    seen = Counter()
    for _, text in {(r[0], r[1] or "") for r in corpus}:
        seen.update({key(x) for x in text.split("\n")} - {""})
    want = Counter()
    for doc_id, text, lang, source, _ in corpus:
        left = "\n".join(x for x in (text or "").split("\n") if seen[key(x)] < 10)
        want[doc_id, left, lang, source, len(left)] += 1
    got = Counter(tuple(r) for r in corpus_pipeline.line_stage(spark, spark.createDataFrame(corpus, SCHEMA), "").collect())
    assert got == want and any(n >= 10 for n in seen.values())


def test_packing_stage_and_the_run(spark, corpus):
    """Pieces of the pipeline's sequences are those of the mix's rows, each once."""
    docs = spark.createDataFrame(corpus, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), "stage")
    of, want = tokens.Encoder(packing.vocabulary()).of, Counter()
    for r in docs.collect():
        ids = of.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 4096):
            part = np.array(ids[a : a + 4096], "<u4").tobytes()
            want[r["doc_id"], a // 4096, a, len(part) // 4, zlib.crc32(part)] += 1
    got = corpus_pipeline.pack_stage(spark, docs, "").toPandas()
    assert Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096
