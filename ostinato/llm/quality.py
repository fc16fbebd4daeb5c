"""Quality rules: a threshold table compiled into one projection, without user functions.

Every measure is a built-in expression over one document, so the plan is a scan and projections: no
shuffle, and a task holds one document at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_CHARS, words

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for with der die das und zu den von ist nicht mit le la les de des et un une est que pour "
    "en el los las y se con por su"
).split()
#: Rules: measure, least, most (inclusive; None: open), fewest words of a document to which the rule applies.
RULES = [
    ("mean_word_length", 2.0, 16.0, 0),
    ("symbols_per_word", None, 0.1, 0),
    ("words_with_letter", 0.8, None, 0),
    ("upper_case_share", None, 0.3, 0),
    ("dup_line_share", None, 0.3, 0),
    ("stop_words", 1.0, None, 50),
]
WINDOW = 5


def _repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words in windows that the same text has twice or more. Windows are compared by 64-bit hash within one document."""
    n = F.size(w)
    hashes = F.when(
        n >= window,
        F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return hashes


def _order(hashes: Column) -> Column:
    """(hash, place) of the windows by hash, if any comes twice; else nothing."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs)


def _repeated(order: Column) -> Column:
    """Places, ascending, of windows whose neighbour in `order`, a column, has the same hash."""
    twice = lambda x, k: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
    marked = F.transform(order, lambda x, k: F.when(twice(x, k - 1) | twice(x, k + 1), x["i"]))
    return F.array_sort(F.array_compact(marked))


def _covered(at: Column, window: int = WINDOW) -> Column:
    """Positions that windows at these places cover."""
    return F.aggregate(
        at,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct((x + window).alias("end"), (a["n"] + (x + window) - F.greatest(x, a["end"])).alias("n")),
        lambda a: a["n"],
    )


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean expression over the measures."""
    verdict = F.lit(True)
    for measure, least, most, fewest in rules:
        ok = F.lit(True)
        if least is not None:
            ok = ok & (F.col(f"_m.{measure}") >= least)
        if most is not None:
            ok = ok & (F.col(f"_m.{measure}") <= most)
        verdict = verdict & (ok if not fewest else (ok | (F.col("_m.n_words") < fewest)))
    return verdict


def measured(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with one more column `_quality`: the counts, base_failed and kept.

    Null text counts as empty: all counts 0, base_failed true. Each row is judged by its own text, so equal rows get equal
    results and nothing depends on order; texts of any length are read whole. Other columns pass through untouched; a column
    called `_quality` in the input is replaced.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = [c for c in docs.columns if c != "_quality"]
    rest = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")
    a = docs.select(rest, body.alias("_t"), words(body).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    stop = F.array(*[F.lit(x) for x in STOP_WORDS] + [F.lit(x.capitalize()) for x in STOP_WORDS])
    b = a.select(
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        _repeat_words(F.col("_w")).alias("_h"),
        F.regexp_count("_t", F.lit(r"[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+")).alias("n_letter_words"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.size(F.array_intersect(F.col("_w"), stop)).alias("n_stop"),
    )
    b = b.withColumn("_o", _order(F.col("_h")))  # columns of their own, so that no lambda computes them again
    c = b.select(
        "_row", "n_words", "word_chars", "n_symbols", "n_letter_words", "n_upper", "n_stop",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(_repeated(F.col("_o"))), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    share = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0))
    d = c.withColumn(
        "_m",
        F.struct(
            F.col("n_words"),
            share("word_chars", "n_words").alias("mean_word_length"),
            share("n_symbols", "n_words").alias("symbols_per_word"),
            share("n_letter_words", "n_words").alias("words_with_letter"),
            share("n_upper", "word_chars").alias("upper_case_share"),
            share("n_dup_lines", "n_lines").alias("dup_line_share"),
            F.col("n_stop").cast("double").alias("stop_words"),
        ),
    )
    # a nondeterministic term keeps the optimizer from moving a filter on the verdict below, where it would compute the
    # windows again for each use of them
    here = F.spark_partition_id() >= 0
    made = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & compiled(rules) & here).alias("kept"), F.col("_m").alias("measures"),
    )
    return d.select("_row.*", made.alias("_quality"))


def passing(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    return measured(docs, text, rules).filter("_quality.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = [f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return measured(docs).select("doc_id", *q)


_STOP_SQL = ", ".join(f"'{x}', '{x.capitalize()}'" for x in STOP_WORDS)
#: Measures of `src` (doc_id, text), by other means: rows of words and windows, counted by grouping.
MEASURES_SQL = rf"""
t AS (SELECT doc_id, coalesce(text, '') AS x FROM src),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g2 AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM g),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g2),
g4 AS (SELECT doc_id, count(DISTINCT j) AS n_rep FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM g3 WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, x, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(x, '{SYMBOLS}')) AS n_symbols,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(n_rep, 0) AS n_repeat_words,
    len(list_filter(ws, lambda z: regexp_matches(z, '\p{{L}}'))) AS n_letter, len(regexp_extract_all(x, '\p{{Lu}}')) AS n_upper,
    len(list_distinct(list_filter(ws, lambda z: z IN ({_STOP_SQL})))) AS n_stop
  FROM w LEFT JOIN g4 USING (doc_id)),
v AS (
  SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
verdict AS (
  SELECT *, NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 16.0 AND n_symbols / n_words <= 0.1 AND n_letter / n_words >= 0.8
    AND n_upper / word_chars <= 0.3 AND n_dup_lines / len(ls) <= 0.3 AND (n_stop >= 1 OR n_words < 50) AS kept FROM v)"""
OP3_SQL = rf"""WITH src AS (SELECT doc_id, text FROM documents), {MEASURES_SQL}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, coalesce(kept, false) AS kept FROM verdict"""
