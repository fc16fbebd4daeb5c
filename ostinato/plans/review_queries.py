"""Queries of the review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.operators import review
from ostinato.plans import fixtures as x
from ostinato.plans.registry import query

COLS = ["source_key", "ordinal", "start_s", "end_s"]


@query(f"WITH {x.SEG} SELECT source_key, ordinal, start_s, end_s FROM seg WHERE NOT suspect")
def strict_fp_filter(spark, sf):
    return review.strict_filter(x.intervals(spark, sf))[0].select(*COLS)


@query(f"""WITH {x.SEG} SELECT source_key, row_number() OVER (PARTITION BY source_key ORDER BY start_s, ordinal) - 1 AS ordinal, start_s, end_s,
  CASE WHEN ordinal % 5 = 0 THEN 0 ELSE pred END AS pred, CASE WHEN ordinal % 4 = 0 THEN 'original' ELSE kind END AS kind, CASE WHEN ordinal % 2 = 0 THEN false ELSE suspect END AS suspect FROM seg""")
def flatten_segments(spark, sf):
    s = x.intervals(spark, sf)
    holes = s.select(
        *COLS, F.when(F.col("ordinal") % 5 != 0, F.col("pred")).alias("pred"), F.when(F.col("ordinal") % 4 != 0, F.col("kind")).alias("kind"),
        F.when(F.col("ordinal") % 2 != 0, F.col("suspect")).alias("suspect"),
    )
    return review.flatten(review.nested(holes))


@query(f"""WITH {x.SEG} SELECT source_key, ordinal, CASE WHEN suspect THEN 'Suspect' WHEN kind = 'new' THEN 'New' ELSE 'Original' END AS status, NOT suspect AS checked FROM seg""")
def review_status(spark, sf):
    s = x.intervals(spark, sf)
    return s.select("source_key", "ordinal", review.status(F.col("suspect"), F.col("kind")).alias("status"), (~F.col("suspect")).alias("checked"))


@query(f"WITH {x.SEG} SELECT source_key, count(*) AS n_total, count(*) FILTER (kind = 'new') AS n_new, count(*) FILTER (suspect) AS n_suspect FROM seg GROUP BY 1")
def review_summary(spark, sf):
    return review.summary(x.intervals(spark, sf))


PICKS = "picks AS (SELECT source_key, start_s + 0.004e0 AS s, end_s - 0.004e0 AS e FROM seg WHERE ordinal % 2 = 0 UNION ALL SELECT source_key, start_s + 0.02e0, end_s FROM seg WHERE ordinal % 2 = 1)"


def _picks(s):
    a = s.filter("ordinal % 2 = 0").select("source_key", (F.col("start_s") + 0.004).alias("start_s"), (F.col("end_s") - 0.004).alias("end_s"))
    return a.union(s.filter("ordinal % 2 = 1").select("source_key", F.col("start_s") + 0.02, "end_s"))


@query(f"""WITH {x.SEG}, {PICKS} SELECT source_key, ordinal, start_s, end_s FROM seg WHERE EXISTS (
  SELECT 1 FROM picks p WHERE p.source_key = seg.source_key AND abs(seg.start_s - s) < 0.01e0 AND abs(seg.end_s - e) < 0.01e0)""")
def selected_tolerance_semi(spark, sf):
    s = x.intervals(spark, sf).select(*COLS)
    return review.selected_semi(s, _picks(s))


#: Three edits of every tenth segment, one after another: the second moves what the first left, a little off, unless it is refused; the
#: third then finds the segment only if it was.
EDITS = """ed AS (SELECT source_key, ordinal * 3 AS edit_no, start_s AS s, end_s AS e, start_s + 1 AS ns, end_s + 1 AS ne FROM seg WHERE ordinal % 10 = 0
  UNION ALL SELECT source_key, ordinal * 3 + 1, start_s + 1.004e0, end_s + 1, start_s + 2, start_s + 2 + ordinal % 3 FROM seg WHERE ordinal % 10 = 0
  UNION ALL SELECT source_key, ordinal * 3 + 2, start_s + 1, end_s + 1, start_s + 5, end_s + 5 FROM seg WHERE ordinal % 10 = 0),
od AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY edit_no) AS k FROM ed WHERE ns < ne)"""


@query(f"""WITH RECURSIVE {x.SEG}, {EDITS},
st AS (SELECT source_key, ordinal, start_s, end_s, false AS edited, 0::BIGINT AS k FROM seg
  UNION ALL SELECT source_key, ordinal, CASE WHEN ordinal = hit THEN ns ELSE start_s END, CASE WHEN ordinal = hit THEN ne ELSE end_s END, edited OR coalesce(ordinal = hit, false), k
  FROM (SELECT st.source_key, st.ordinal, st.start_s, st.end_s, st.edited, od.k, ns, ne, min(CASE WHEN abs(st.start_s - s) < 0.01e0 AND abs(st.end_s - e) < 0.01e0 THEN st.ordinal END) OVER (PARTITION BY st.source_key) AS hit
    FROM st JOIN od ON od.source_key = st.source_key AND od.k = st.k + 1))
SELECT source_key, ordinal, start_s, end_s, edited FROM st WHERE (source_key, k) IN (SELECT source_key, max(k) FROM st GROUP BY 1)""")
def apply_time_edits(spark, sf):
    s = x.intervals(spark, sf).select(*COLS)
    t = s.filter("ordinal % 10 = 0")
    a, b, n = F.col("start_s"), F.col("end_s"), F.col("ordinal")
    edit = lambda i, *bounds: t.select("source_key", (n * 3 + i).alias("edit_no"), *[c.alias(name) for c, name in zip(bounds, ("old_start", "old_end", "new_start", "new_end"))])
    edits = edit(0, a, b, a + 1, b + 1).union(edit(1, a + 1.004, b + 1, a + 2, a + 2 + n % 3)).union(edit(2, a + 1, b + 1, a + 5, b + 5))
    return review.apply_edits(s, edits)


@query(f"WITH {x.SEG} SELECT source_key, ordinal, start_s, end_s FROM seg WHERE (source_key, round(start_s, 3), round(end_s, 3)) IN (SELECT (source_key, round(start_s, 3), round(end_s, 3)) FROM seg WHERE ordinal % 6 = 0)")
def requested_interval_semi(spark, sf):
    s = x.intervals(spark, sf).select(*COLS)
    return review.requested_semi(s, s.filter("ordinal % 6 = 0"))


REMOVED = """sel AS (SELECT * FROM seg WHERE ordinal % 4 <> 0 AND source_key <> 'view'),
rem AS (SELECT source_key, start_s, end_s FROM seg WHERE source_key IN (SELECT source_key FROM sel)
  AND (source_key, round(start_s, 3), round(end_s, 3)) NOT IN (SELECT (source_key, round(start_s, 3), round(end_s, 3)) FROM sel))"""


@query(f"WITH {x.SEG}, {REMOVED} SELECT * FROM rem")
def excluded_by_review(spark, sf):
    s = x.intervals(spark, sf).select(*COLS)
    return review.excluded_by_review(s, s.filter("ordinal % 4 <> 0 AND source_key <> 'view'"))


@query(f"WITH {x.SEG}, {REMOVED} SELECT * FROM rem UNION ALL SELECT source_key, start_s, end_s FROM seg WHERE suspect")
def excluded_union(spark, sf):
    return review.excluded_union(excluded_by_review(spark, sf), review.strict_filter(x.intervals(spark, sf))[1])


@query("""WITH d AS (SELECT doc_id, source, quality, toxic, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS e, n_chars FROM documents LEFT JOIN labels USING (doc_id))
SELECT source AS source_key, count(*) AS n_total, count(*) FILTER (coalesce(toxic, 0) = 1) AS n_suspect, max(CASE WHEN quality = 1 THEN e END)::BIGINT AS last_checked FROM d GROUP BY 1""")
def review_of_documents(spark, sf):
    """Documents as intervals of one source each: cumulative lengths, checked by quality, suspect by toxicity, unlabelled ones neither."""
    from pyspark.sql import Window as W

    d = x.table(spark, sf, "documents").join(x.table(spark, sf, "labels"), "doc_id", "left")
    end = F.sum("n_chars").over(W.partitionBy("source").orderBy("doc_id"))
    d = d.select(F.col("source").alias("source_key"), end.alias("e"), "quality", F.lit("original").alias("kind"), (F.col("toxic") == 1).alias("suspect"))
    s = review.summary(d).select("source_key", "n_total", "n_suspect")
    last = d.groupBy("source_key").agg(F.max(F.when(F.col("quality") == 1, F.col("e"))).alias("last_checked"))
    return s.join(last, "source_key")
