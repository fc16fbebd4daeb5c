"""Nulls, empty and very long texts, repeated rows, empty tables, and extra columns with clashing names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ostinato.llm import embdedup, langid, linededup, mixing, packing, pii, quality, simhash, substring, tokenfiles
from ostinato.llm.shared import new_path

#: Names that operators use inside.
CLASH = ["size", "kept", "_t", "_row", "_w", "n_words", "h1", "fp", "component", "id", "v", "piece", "length", "_id", "shard", "batch", "a", "b", "places", "taken", "_quality", "_kept", "_n_values", "rep", "_s", "value", "n"]
PROSE = "The cat sat on the mat and it was good for all of them in the house. " * 3
LONG = " ".join(f"word{i % 997} of the" for i in range(12_000))


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [
        (1, None, "en", "s1", None), (2, "", None, None, 0), (3, " \t\n\x0b", "en", "s1", 4), (4, PROSE, "en", None, 10), (4, PROSE, "en", None, 10),
        (None, PROSE, "en", "s2", 10), (None, None, None, None, None), (5, LONG, "en", "s2", 10), (6, "ÄÖÜ ß ñ 日本 \U0001f600 é", "de", "s1", 10), (7, "a\n\nA \n a", "fr", "s3", 1),
    ])


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_quality(odd, empty):
    got = {r["doc_id"]: r for r in quality.measured(odd).select("doc_id", "_quality").collect()}
    assert got[1]["_quality"]["n_words"] == 0 and got[1]["_quality"]["base_failed"]
    assert not got[3]["_quality"]["kept"] and got[5]["_quality"]["n_words"] == 36_000
    assert quality.passing(odd).columns == odd.columns
    assert quality.measured(empty).count() == 0


def test_lines(odd, empty):
    got = linededup.line_dedup(odd, min_docs=2).select("doc_id", "_n_lines", "_n_dropped", "_kept").collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["_n_lines"], by[1]["_n_dropped"], by[1]["_kept"]) == (1, 0, "")
    assert by[7]["_n_dropped"] == 0  # one document, however often it has the key
    assert [r["_n_dropped"] for r in got if r["doc_id"] == 4] == [1, 1]  # another document has the line
    assert linededup.line_dedup(empty).count() == 0


def test_lines_of_long_texts(spark):
    """Two documents of very many lines, half of which go, in time that grows with them alone; and the stretches between places."""
    rows = [(i, "\n".join(f"line {k % 50 if k % 2 else (i, k)}" for k in range(60_000)), None, None, 1) for i in (1, 2)]
    for r in linededup.line_dedup(table(spark, rows), min_docs=2).select("_n_lines", "_n_dropped", "_kept").collect():
        assert (r["_n_lines"], r["_n_dropped"], r["_kept"].count("\n")) == (60_000, 30_000, 29_999)
    items = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda x: x.cast("string"))
    for drop, want in (([0], "123456"), ([6], "012345"), ([0, 1, 3, 6], "245"), ([2, 3, 4], "0156"), (list(range(7)), "")):
        assert spark.range(1).select(F.array_join(linededup.without(items, F.array(*map(F.lit, drop))), "")).first()[0] == want


def test_line_runs_by_batches(spark):
    from ostinato.llm.linededup import LineRuns

    runs = LineRuns(min_docs=3, fan_in=2)
    for batch in ([(1, 1), (2, 2)], [(1, 1), (3, 3)], [(1, 1), (2, 2)], [(1, 1), (2, 2)]):
        runs.add(spark.createDataFrame(batch, "h1 long, h2 long"))
    assert sorted(r["h1"] for r in runs.frequent().collect()) == [1, 2]


@pytest.mark.parametrize("fan_in", [2, 3])
def test_line_runs_give_each_frequent_key_once(spark, fan_in):
    """Random batches, and a key that reaches the limit in one merge while an older run still counts it."""
    from ostinato.llm.linededup import LineRuns

    random.seed(fan_in)
    batches = [[7] * n + [random.randrange(20, 60) for _ in range(40)] for n in (2, 2, 2, 2, 3, 3, 5, 5)]
    runs = LineRuns(min_docs=10, fan_in=fan_in, buckets=3)
    for batch in batches:
        runs.add(spark.createDataFrame([(k, -k) for k in batch], "h1 long, h2 long"))
    counts = Counter(k for batch in batches for k in batch)
    assert sorted(r["h1"] for r in runs.frequent().collect()) == sorted(k for k, n in counts.items() if n >= 10)
    tables = list(runs.tables)
    runs.forget(spark)
    assert tables and not any(spark.catalog.tableExists(t) for t in tables)


def test_runs_are_merged_without_a_shuffle_or_a_sort(spark):
    from ostinato.llm.linededup import LineRuns, ordered_scans

    runs = LineRuns(buckets=4)
    rows = lambda i, j: spark.range(i, 5000, j).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).cast("long").alias("n"))
    a, b = (runs.stored(rows(i, 3), "run") for i in (0, 1))
    runs.hot = [[runs.stored(rows(0, 6).select("h1", "h2"), "hot")]]
    with ordered_scans(spark):
        merged = LineRuns.merged(runs.fresh(a), runs.fresh(b))
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Sort [" not in plan
        assert merged.count() == a.count() + b.count() - 834
    for placed in (merged, a.filter("h2 > 100")):  # a merge stays a file a bucket, and so does a filter of a run
        again = runs.stored(placed, "again", placed=True)
        assert len(again.inputFiles()) == 4
    with ordered_scans(spark):
        plan = LineRuns.merged(again, b)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort [" not in plan


def test_a_batch_reads_its_own_lines(spark, odd):
    """The lines of a batch are a folder of their own."""
    from ostinato.llm import linededup

    read = []
    add = linededup.LineRuns.add
    try:
        linededup.LineRuns.add = lambda self, keys: (read.append(keys._jdf.queryExecution().executedPlan().toString()), add(self, keys))[1]
        linededup.line_dedup(odd, min_docs=2).count()
    finally:
        linededup.LineRuns.add = add
    assert len(read) == linededup.LEAST_BATCHES
    assert all("PartitionFilters: [isnotnull(_b" in plan and f"= {b})]" in plan for b, plan in enumerate(read)), read


def test_mixing(odd, empty):
    got = mixing.mixed(odd).collect()
    assert len(got) == 10 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mixed(empty).count() == 0


def test_pii(odd, empty):
    got = pii.pseudonymized(odd, "k")
    assert got.filter("doc_id = 1").first()["text"] is None
    assert got.agg(F.sum("_n_values")).first()[0] == 0
    assert pii.pseudonymized(empty, "k").count() == 0


def test_packing(odd, empty):
    got = packing.pack_documents(odd, packing.vocabulary()).collect()
    assert [(r["length"], r["start"]) for r in got if r["doc_id"] == 1] == [(1, 0)]
    parts = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 5)
    assert all(n == 4096 for _, _, n in parts[:-1]) and [p for p, _, _ in parts] == list(range(len(parts)))
    assert packing.pack_documents(empty, packing.vocabulary()).count() == 0


def test_langid(odd, empty):
    learned = langid.profiles(odd, "text", "lang")
    got = langid.predicted(odd, langid.Ranks(learned)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and by[1]["lang_pred"] == by[3]["lang_pred"] == "und" and by[4]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    none = langid.Ranks(langid.profiles(empty, "text", "lang"))
    assert {r["lang_pred"] for r in langid.predicted(odd, none).collect()} == {"und"}


def test_token_files(spark, odd, empty):
    for df, n in ((odd, 10), (empty, 0)):
        path = new_path(spark, "t")
        tokenfiles.write_tokens(tokenfiles.encoded(df, tokenfiles.vocabulary()), path)
        got = tokenfiles.digests(spark, path).collect()
        assert len(got) == n
    assert [r["n_tokens"] for r in tokenfiles.digests(spark, path).collect() if r["doc_id"] == 1] == []
    path = new_path(spark, "t")
    tokenfiles.write_tokens(tokenfiles.encoded(odd, tokenfiles.vocabulary()), path, delta=True)
    assert tokenfiles.read_tokens(spark, path, 1, 3).filter("n_tokens = 1").count() == 2


def test_hot_ids_are_dealt_over_files(spark, tmp_path):
    """Null ids and one other hold a third of the rows each: no file holds much more than its share, and starts follow one another."""
    which = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id"))
    docs = spark.range(3000).select(which.cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.col("id").cast("string")).alias("text"))
    path = f"file://{tmp_path}/hot"
    tokenfiles.write_tokens(tokenfiles.encoded(docs, tokenfiles.vocabulary()), path)
    sizes = [r["n"] for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 900
    got = sorted((r["start"], r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in tokenfiles.digests(spark, path).collect())
    assert [x[1:3] for x in got] == sorted(x[1:3] for x in got)
    assert [x[0] for x in got] == [0, *[sum(n for *_, n in got[: i + 1]) for i in range(len(got) - 1)]]


@pytest.mark.parametrize("delta", [False, True])
def test_files_of_tokens(spark, tmp_path, monkeypatch, delta):
    """Encodings, row groups and page indexes as they are in the files; a range read skips what it doesn't need."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(tokenfiles, "ROW_GROUP_BYTES", 1 << 12)
    monkeypatch.setattr(tokenfiles, "PAGE_BYTES", 1 << 12)
    monkeypatch.setattr(tokenfiles, "PAGE_ROWS", 20)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(PROSE), F.col("id").cast("string")).alias("text"))
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write_tokens(tokenfiles.encoded(docs, tokenfiles.vocabulary()), path, delta=delta)
    spans, groups = [], 0
    for name in glob.glob(f"{tmp_path}/tokens/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        groups += meta.num_row_groups
        for i in range(meta.num_row_groups):
            columns = {meta.row_group(i).column(k).path_in_schema: meta.row_group(i).column(k) for k in range(3)}
            assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
            ids = columns["ids.list.element"].encodings
            assert ("DELTA_BINARY_PACKED" in ids) == delta and any("DICTIONARY" in e for e in ids) != delta
            spans.append((columns["doc_id"].statistics.min, columns["doc_id"].statistics.max))
    spans.sort()
    assert groups > 8 and spans[0][0] == 0 and spans[-1][1] == 3999 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    some = tokenfiles.read_tokens(spark, path, 1000, 1009, ("doc_id", "n_tokens"))
    assert some.count() == 10
    got = some.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1000, 1010))
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,1000)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan


def test_simhash(odd, empty):
    got = simhash.near_groups(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == 0
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[None]["component_id"] in (1, 4)
    assert simhash.near_groups(empty).count() == 0


def test_substring(odd, empty):
    got = substring.substring_dedup(odd).collect()
    assert len(got) == 10
    assert [r["n_removed"] for r in got if r["doc_id"] == 4] == [51, 51]
    assert {(r["n_words"], r["kept"]) for r in got if r["doc_id"] in (1, 2, 3)} == {(0, "")}
    assert substring.substring_dedup(empty).count() == 0


def test_embeddings(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("h", F.lit(1)).withColumn("n", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.embedding_groups(df).collect()}
    assert got[1] == got[2] == got[3] == (3, 1) and got[None] == (3, 1)
    assert all(got[k] == (0, k) for k in (4, 5, 6, 7, 8, 9, 10))
    assert embdedup.embedding_groups(df.limit(0)).count() == 0


def test_stages(spark, odd, empty):
    for df in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, "")
            assert set(corpus_pipeline.COLUMNS) <= set(out.columns), name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, df, "").collect()
