"""Queries of text sources, sinks and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions import timefmt
from ostinato.operators import match
from ostinato.plans import fixtures as x
from ostinato.plans.registry import query
from ostinato.sources import text

LINES = """lines AS (SELECT event_id AS ordinal, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '# note' ELSE '  https://a.example/' || (user_id % 50) || ' ' END AS value FROM events)"""
URLS = "urls AS (SELECT trim(value) AS url, min(ordinal) AS ordinal FROM lines WHERE trim(value) <> '' AND trim(value) NOT LIKE '#%' GROUP BY 1)"


def _lines(spark, sf):
    k = F.col("event_id") % 7
    value = F.when(k == 0, "").when(k == 1, "# note").otherwise(F.concat(F.lit("  https://a.example/"), (F.col("user_id") % 50).cast("string"), F.lit(" ")))
    return x.table(spark, sf, "events").select(F.col("event_id").alias("ordinal"), value.alias("value"))


@query(f"WITH {LINES}, {URLS} SELECT * FROM urls")
def read_url_list(spark, sf):
    return text.url_list(_lines(spark, sf))


@query(f"WITH {LINES}, {URLS} SELECT ordinal, url AS entry_id, url AS title, url AS webpage_url FROM urls ORDER BY ordinal LIMIT 1000")
def url_list_to_entries(spark, sf):
    return text.url_entries(read_url_list(spark, sf))


HMS = "printf('%d:%02d:%02d', {t} // 3600, ({t} // 60) % 60, {t} % 60)"
R, E = "round_even(start_s, 0)::BIGINT", "round_even(end_s, 0)::BIGINT"


@query(f"""WITH {x.SEG} SELECT source_key, source_key || chr(10) || string_agg({HMS.format(t=R)} || ' - ' || {HMS.format(t=E)} || ', confidence: ' || pred::VARCHAR, chr(10) ORDER BY start_s, ordinal) || chr(10) AS value
FROM seg GROUP BY 1""")
def write_timestamps_text(spark, sf):
    return text.timestamps_text(x.intervals(spark, sf))


@query(f"""WITH {x.SEG} SELECT source_key AS source_name, row_number() OVER (PARTITION BY source_key ORDER BY start_s, ordinal) - 1 AS seg_no,
  round_even(start_s, 0) AS start_s, round_even(end_s, 0) AS end_s, pred, true AS is_segment FROM seg
UNION ALL SELECT '0:00:01 - 0:00:02', NULL, NULL, NULL, NULL, false FROM (SELECT DISTINCT source_key FROM seg)""")
def read_timestamps_text(spark, sf):
    """Written by the sink, with stray names above each block, one of them a line without a confidence, and parsed back."""
    files = text.timestamps_text(x.intervals(spark, sf)).select(F.col("source_key").alias("path"), F.concat(F.lit("stray\n0:00:01 - 0:00:02\n"), "value", F.lit("\n \t\nlast\n0:00:01 - 0:00:02\n")).alias("value"))
    return text.parse_timestamps(files).select("source_name", F.col("seg_no").cast("long").alias("seg_no"), "start_s", "end_s", "pred", "is_segment")


@query(f"WITH {x.SEG} SELECT source_key, ordinal, {HMS.format(t=R)} AS hms FROM seg")
def format_hms_round(spark, sf):
    return x.intervals(spark, sf).select("source_key", "ordinal", timefmt.hms_round(F.col("start_s")).alias("hms"))


@query(f"WITH {x.SEG} SELECT source_key, ordinal, {HMS.format(t='floor(start_s)::BIGINT')} AS hms FROM seg")
def format_hms_floor(spark, sf):
    return x.intervals(spark, sf).select("source_key", "ordinal", timefmt.hms_floor(F.col("start_s")).alias("hms"))


CLOCKS = """c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 3 WHEN 0 THEN (l_partkey // 10) || ':' || lpad((l_suppkey % 60)::VARCHAR, 2, '0') || ':' || lpad((l_orderkey % 60)::VARCHAR, 2, '0')
  WHEN 1 THEN (l_partkey / 4)::VARCHAR ELSE '1:2:' || l_linenumber END AS v FROM lineitem)"""


@query(f"""WITH {CLOCKS} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN regexp_full_match(v, '\\d+:\\d\\d:\\d\\d') THEN split_part(v, ':', 1)::DOUBLE * 3600 + split_part(v, ':', 2)::DOUBLE * 60 + split_part(v, ':', 3)::DOUBLE
  ELSE try_cast(v AS DOUBLE) END AS seconds FROM c""")
def parse_hms_or_seconds(spark, sf):
    two = lambda c: F.lpad((F.col(c) % 60).cast("string"), 2, "0")
    k = F.col("l_partkey") % 3
    clock = F.concat_ws(":", F.floor(F.col("l_partkey") / 10).cast("string"), two("l_suppkey"), two("l_orderkey"))
    v = F.when(k == 0, clock).when(k == 1, (F.col("l_partkey") / 4).cast("string")).otherwise(F.concat(F.lit("1:2:"), F.col("l_linenumber").cast("string")))
    return x.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", timefmt.parse_hms(v).alias("seconds"))


MEDIA = "m AS (SELECT p_partkey AS ordinal, '/Media/' || (p_partkey % 9) || '/' || CASE WHEN p_partkey % 3 = 0 THEN 'a b' ELSE p_name END || '.mp4' AS path, CASE WHEN p_partkey % 4 = 0 THEN 'https://v.example/' || (p_partkey // 8) END AS url FROM part)"
SAVED = """s AS (SELECT p_partkey AS entry_id, CASE WHEN p_partkey % 8 = 0 THEN 'https://v.example/' || (p_partkey // 8) WHEN p_partkey % 5 = 0 THEN '/gone/' || p_partkey || '.mp4' WHEN p_partkey % 7 = 0 THEN '/Media/' || (p_partkey % 9) || '/' || upper(p_name) || '.MP4'
  WHEN p_partkey % 3 = 0 THEN '/Media//./x/../' || (p_partkey % 9) || '/a b.mp4' WHEN p_partkey % 11 = 0 THEN '/elsewhere/a b.mp4' ELSE '/Media/' || (p_partkey % 9) || '/' || p_name || '.mp4' END AS name FROM part)"""


MATCHED = f"""{MEDIA}, {SAVED}, b AS (SELECT entry_id, name, regexp_extract(name, '[^/]*$') AS base, replace(replace(replace(name, '//', '/'), '/./', '/'), '/x/../', '/') AS norm FROM s),
u AS (SELECT entry_id, max(ordinal) AS ordinal FROM b JOIN m ON m.url = b.name GROUP BY 1),
k AS (SELECT entry_id, ordinal, path = norm AS same, count(*) OVER (PARTITION BY entry_id) AS n, row_number() OVER (PARTITION BY entry_id ORDER BY (path = norm) DESC, ordinal) AS r
  FROM b JOIN m ON regexp_extract(path, '[^/]*$') = base WHERE m.url IS NULL AND entry_id NOT IN (SELECT entry_id FROM u)),
matched AS (SELECT b.entry_id, coalesce(u.ordinal, k.ordinal) AS media_ordinal, CASE WHEN u.ordinal IS NOT NULL THEN 'url' WHEN k.ordinal IS NULL THEN 'unmatched' WHEN n = 1 THEN 'name' WHEN same THEN 'path' ELSE 'ambiguous' END AS how
FROM b LEFT JOIN u USING (entry_id) LEFT JOIN k ON k.entry_id = b.entry_id AND k.r = 1)"""


@query(f"WITH {MATCHED} SELECT * FROM matched")
def match_saved_to_media(spark, sf):
    key, name, text_ = F.col("p_partkey"), F.col("p_name"), lambda *a: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in a])
    p = x.table(spark, sf, "part")
    url = text_("https://v.example/", F.floor(key / 8))
    path = text_("/Media/", key % 9, "/", F.when(key % 3 == 0, "a b").otherwise(name), ".mp4")
    media = p.select(key.alias("ordinal"), path.alias("path"), F.when(key % 4 == 0, url).alias("url"))
    saved = F.when(key % 8 == 0, url).when(key % 5 == 0, text_("/gone/", key, ".mp4")).when(key % 7 == 0, text_("/Media/", key % 9, "/", F.upper(name), ".MP4"))
    saved = saved.when(key % 3 == 0, text_("/Media//./x/../", key % 9, "/a b.mp4")).when(key % 11 == 0, "/elsewhere/a b.mp4").otherwise(text_("/Media/", key % 9, "/", name, ".mp4"))
    return match.match_saved(p.select(key.alias("entry_id"), saved.alias("name")), media)


@query(f"WITH {MATCHED}, n AS (SELECT count(*) AS n_saved, count(*) FILTER (how <> 'unmatched') AS n_loaded FROM matched) SELECT *, n_saved > 0 AND n_loaded = 0 AS failed FROM n")
def matched_summary(spark, sf):
    return match.matched_summary(match_saved_to_media(spark, sf))
