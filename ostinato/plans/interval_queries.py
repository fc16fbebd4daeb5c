"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.operators import intervals as iv
from ostinato.plans import fixtures as x
from ostinato.plans.registry import query

COLS = ["source_key", "ordinal", "start_s", "end_s"]


def merged_sql(base: str, keys: str, new: str, more: str = "") -> str:
    """Gaps and islands by a running maximum; `new` compares s with the highest end m before."""
    return f"""mx AS (SELECT *, max(end_s) OVER (PARTITION BY {keys} ORDER BY start_s, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {base}),
fl AS (SELECT *, CASE WHEN m IS NULL OR ({new}) THEN 1 ELSE 0 END AS f FROM mx),
gr AS (SELECT *, sum(f) OVER (PARTITION BY {keys} ORDER BY start_s, ordinal ROWS UNBOUNDED PRECEDING) AS g FROM fl),
merged AS (SELECT {keys}, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_merged{more} FROM gr GROUP BY {keys}, g)"""


DUR = "dur AS (SELECT source_key, max(end_s) - 3600 AS duration FROM seg GROUP BY 1)"
WIN = "win AS (SELECT source_key, ordinal, greatest(0e0, start_s - 5) AS start_s, least(end_s + 5, duration - 0.1e0) AS end_s FROM seg JOIN dur USING (source_key) WHERE least(end_s + 5, duration - 0.1e0) > greatest(0e0, start_s - 5))"


@query(f"WITH {x.SEG}, {DUR}, {WIN}, {merged_sql('win', 'source_key', 'start_s > m + 1')} SELECT * FROM merged")
def scan_windows(spark, sf):
    s = x.intervals(spark, sf)
    s = s.join(x.durations(s), "source_key")
    return iv.scan_windows(s.select(*COLS, "duration"), 5.0, cap=F.col("duration") - 0.1)


@query(f"""WITH {x.SEG}, {merged_sql('seg', 'source_key, kind', 'start_s > m + 2', ', max(pred) AS pred, min((start_s, ordinal)) AS f')}
SELECT m.source_key, m.kind, m.start_s, m.end_s, n_merged, m.pred, s.ordinal, s.suspect, s.user_id FROM merged m JOIN seg s ON s.ordinal = f[2]""")
def merge_reverify(spark, sf):
    return iv.merge_reverify(x.intervals(spark, sf))


#: Sequential, by recursion over a source's rows: the survivor so far is carried along, and given out when the next one clears it.
KEEP = """o AS (SELECT source_key, ordinal, start_s, end_s, row_number() OVER (PARTITION BY source_key ORDER BY start_s, ordinal) AS r FROM {base}),
fold AS (
  SELECT source_key, r, ordinal, start_s, end_s, NULL::BIGINT AS out_o, NULL::DOUBLE AS out_s, NULL::DOUBLE AS out_e FROM o WHERE r = 1
  UNION ALL
  SELECT o.source_key, o.r,
    CASE WHEN f.end_s > o.start_s AND o.end_s - o.start_s <= f.end_s - f.start_s THEN f.ordinal ELSE o.ordinal END,
    CASE WHEN f.end_s > o.start_s AND o.end_s - o.start_s <= f.end_s - f.start_s THEN f.start_s ELSE o.start_s END,
    CASE WHEN f.end_s > o.start_s AND o.end_s - o.start_s <= f.end_s - f.start_s THEN f.end_s ELSE o.end_s END,
    CASE WHEN f.end_s > o.start_s THEN NULL ELSE f.ordinal END, CASE WHEN f.end_s > o.start_s THEN NULL ELSE f.start_s END,
    CASE WHEN f.end_s > o.start_s THEN NULL ELSE f.end_s END
  FROM fold f JOIN o ON o.source_key = f.source_key AND o.r = f.r + 1),
kept AS (SELECT source_key, out_o AS ordinal, out_s AS start_s, out_e AS end_s FROM fold WHERE out_o IS NOT NULL
  UNION ALL SELECT source_key, ordinal, start_s, end_s FROM fold WHERE (source_key, r) IN (SELECT source_key, max(r) FROM o GROUP BY 1))"""


@query(f"WITH RECURSIVE {x.SEG}, {KEEP.format(base='seg')} SELECT * FROM kept WHERE end_s - start_s > 0.5")
def keep_longer(spark, sf):
    return iv.keep_longer(x.intervals(spark, sf).select(*COLS), 0.5, strict=True)


EXCL = "ex AS (SELECT source_key, ordinal, start_s, end_s FROM seg WHERE ordinal % 3 = 1), kp AS (SELECT source_key, ordinal, start_s, end_s FROM seg WHERE ordinal % 3 <> 1)"
BLOCKED = "bl AS (SELECT * FROM ex WHERE end_s > start_s AND NOT EXISTS (SELECT 1 FROM kp WHERE kp.source_key = ex.source_key AND kp.start_s < ex.end_s AND kp.end_s > ex.start_s))"


def _excluded_kept(spark, sf):
    s = x.intervals(spark, sf).select(*COLS)
    return s.filter("ordinal % 3 = 1"), s.filter("ordinal % 3 <> 1")


@query(f"WITH {x.SEG}, {EXCL}, {BLOCKED} SELECT * FROM bl")
def blocked_intervals(spark, sf):
    return iv.blocked_intervals(*_excluded_kept(spark, sf))


GAPS = """bf AS (SELECT *, max(end_s) OVER (PARTITION BY source_key ORDER BY start_s, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM kp),
gb AS (SELECT source_key, ordinal FROM bf WHERE start_s > m AND EXISTS (SELECT 1 FROM bl WHERE bl.source_key = bf.source_key AND bl.start_s < bf.start_s AND bl.end_s > bf.m))"""


@query(f"WITH {x.SEG}, {EXCL}, {BLOCKED}, {GAPS} SELECT * FROM gb")
def gap_blocked(spark, sf):
    excluded, kept = _excluded_kept(spark, sf)
    return iv.gap_blocked(kept, iv.blocked_intervals(excluded, kept))


MERGE_STOP = """st AS (SELECT kp.*, gb.ordinal IS NOT NULL AS stop FROM kp LEFT JOIN gb USING (source_key, ordinal)), """ + merged_sql(
    "st", "source_key", "start_s - m >= 60 OR stop"
)


@query(f"WITH {x.SEG}, {EXCL}, {BLOCKED}, {GAPS}, {MERGE_STOP} SELECT * FROM merged")
def merge_clips(spark, sf):
    excluded, kept = _excluded_kept(spark, sf)
    return iv.merge_clips(kept, iv.blocked_intervals(excluded, kept), gap=60.0)


@query(f"WITH {x.SEG} SELECT source_key, ordinal, start_s - 3 AS start_s, end_s + 3 AS end_s FROM seg")
def pad_plain(spark, sf):
    return iv.pad_plain(x.intervals(spark, sf).select(*COLS), 3.0, 3.0)


@query(f"""WITH {x.SEG}, a AS (SELECT source_key, ordinal, start_s, least(end_s + 3, coalesce(lead(start_s) OVER w, end_s + 3)) AS ee FROM seg WINDOW w AS (PARTITION BY source_key ORDER BY start_s, ordinal)),
b AS (SELECT source_key, ordinal, greatest(start_s - 3, coalesce(lag(ee) OVER w, start_s - 3)) AS ss, ee FROM a WINDOW w AS (PARTITION BY source_key ORDER BY start_s, ordinal))
SELECT source_key, ordinal, ss AS start_s, ee AS end_s, ee - ss AS duration, greatest(0e0, ss) AS fetch_start FROM b""")
def pad_clamped(spark, sf):
    return iv.pad_clamped(x.intervals(spark, sf).select(*COLS), 3.0, 3.0)


@query(f"""WITH {x.SEG}, {DUR}, j AS (SELECT s.*, CASE WHEN source_key = 'click' THEN NULL ELSE duration END AS d FROM seg s JOIN dur USING (source_key))
SELECT source_key, ordinal, greatest(0e0, start_s) AS start_s, CASE WHEN d IS NULL THEN end_s ELSE least(end_s, d - 0.5e0) END AS end_s FROM j
WHERE CASE WHEN d IS NULL THEN end_s - start_s >= 1 ELSE start_s < d - 0.5e0 AND least(end_s, d - 0.5e0) - greatest(0e0, start_s) >= 1 END""")
def safe_clip_filter(spark, sf):
    s = x.intervals(spark, sf)
    d = F.when(F.col("source_key") == "click", None).otherwise(F.col("duration"))
    s = s.join(x.durations(s), "source_key").select(*COLS, d.alias("duration"))
    return iv.safe_clip(s, F.col("duration"), F.lit(0.5)).select(*COLS)


@query(f"""WITH {x.SEG}, {DUR} SELECT source_key, count(*) FILTER (WHERE NOT (start_s < duration - 0.5e0 AND least(end_s, duration - 0.5e0) - greatest(0e0, start_s) >= 1)) AS n_dropped FROM seg JOIN dur USING (source_key) GROUP BY 1""")
def clips_dropped(spark, sf):
    s = x.intervals(spark, sf)
    return iv.clips_dropped(s.join(x.durations(s), "source_key"), F.col("duration"), F.lit(0.5))


@query(f"""WITH {x.SEG} SELECT source_key, ordinal, start_s, end_s, kind FROM seg a WHERE kind = 'new' OR NOT EXISTS (
  SELECT 1 FROM seg b WHERE b.kind = 'new' AND b.source_key = a.source_key AND b.start_s <= a.start_s AND b.end_s >= a.end_s)""")
def covered_original_anti(spark, sf):
    return iv.covered_original_anti(x.intervals(spark, sf).select(*COLS, "kind"))


@query(f"""WITH {x.SEG}, n AS (SELECT source_key, ordinal + 1000000 AS ordinal, start_s + CASE WHEN ordinal % 8 = 0 THEN 0 ELSE 0.25e0 END AS start_s, end_s + 0.25e0 AS end_s, 'new' AS kind, pred FROM seg WHERE ordinal % 4 = 0),
u AS (SELECT source_key, ordinal, start_s, end_s, 'original' AS kind, NULL AS pred FROM seg UNION ALL SELECT * FROM n)
SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY start_s, (kind = 'new'), ordinal) AS place FROM u""")
def union_original_new(spark, sf):
    s = x.intervals(spark, sf).select(*COLS, "pred")
    moved = F.col("start_s") + F.when(F.col("ordinal") % 8 == 0, 0.0).otherwise(0.25)
    new = s.filter("ordinal % 4 = 0").select("source_key", F.col("ordinal") + 1_000_000, moved, F.col("end_s") + 0.25, "pred").toDF(*COLS, "pred")
    return iv.union_original_new(s.select(*COLS), new)


@query(f"""WITH RECURSIVE {x.SEG}, {EXCL}, {DUR}, cl AS (SELECT source_key, ordinal, greatest(0e0, start_s) AS start_s, least(end_s, duration - 0.5e0) AS end_s FROM kp JOIN dur USING (source_key)
  WHERE start_s < duration - 0.5e0 AND least(end_s, duration - 0.5e0) - greatest(0e0, start_s) >= 1),
{KEEP.format(base='cl')}
SELECT source_key, row_number() OVER (PARTITION BY source_key ORDER BY start_s, end_s) AS clip_no, start_s, end_s FROM kept WHERE end_s - start_s >= 1""")
def clip_plan_unmerged(spark, sf):
    """Without merging, of overlapping clips the longer stays."""
    excluded, kept = _excluded_kept(spark, sf)
    return iv.clip_plan(kept, excluded, x.durations(x.intervals(spark, sf)), merge_gap=None)


@query(f"""WITH RECURSIVE {x.SEG}, {EXCL}, {BLOCKED}, {GAPS}, {MERGE_STOP}, {DUR},
cl AS (SELECT source_key, 0 AS ordinal, greatest(0e0, start_s) AS start_s, least(end_s, duration - 0.5e0) AS end_s FROM merged JOIN dur USING (source_key)
  WHERE start_s < duration - 0.5e0 AND least(end_s, duration - 0.5e0) - greatest(0e0, start_s) >= 1),
{KEEP.format(base='cl')}
SELECT source_key, row_number() OVER (PARTITION BY source_key ORDER BY start_s, end_s) AS clip_no, start_s, end_s FROM kept WHERE end_s - start_s >= 1""")
def clip_plan(spark, sf):
    excluded, kept = _excluded_kept(spark, sf)
    d = x.durations(x.intervals(spark, sf))
    return iv.clip_plan(kept, excluded, d, merge_gap=60.0)
