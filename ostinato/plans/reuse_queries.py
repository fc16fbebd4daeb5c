"""Queries of reuse, transfer logs and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato import params
from ostinato.operators import catalog, intervals, reuse, transfer
from ostinato.plans import fixtures as x
from ostinato.plans.registry import query
from ostinato.session import new_folder
from ostinato.sources import detections, wav

S = F.col


THRESHOLDS = [0.9, 0.0, 1.0, 0.25, 0.0001, 0.00001234, 1e-13]
KEYED = f"""n AS (SELECT o_orderkey, o_custkey, (o_custkey % 7 + 1)::VARCHAR AS p, o_custkey || CASE o_custkey % 5 WHEN 0 THEN '"q\\' ELSE '' END AS id, {THRESHOLDS}[1 + o_orderkey % 7]::DOUBLE AS t FROM orders),
k AS (SELECT o_orderkey, sha256('{{"block_size":600,"focus_idx":' || CASE WHEN o_custkey % 3 = 0 THEN 'null' ELSE '58' END || ',"model":"m","platform":"web","precision":"' || p || '","relevant_flags":' || CASE WHEN o_custkey % 2 = 0 THEN '{{"gpu":true}}' ELSE '{{}}' END
  || ',"source_id":' || to_json(id)::VARCHAR || ',"threshold":' || t::VARCHAR || '}}') AS cache_key FROM n)"""


def _keys(spark, sf):
    o, k = x.table(spark, sf, "orders"), S("o_custkey")
    source = F.concat(k.cast("string"), F.when(k % 5 == 0, '"q\\').otherwise(""))
    threshold = F.element_at(F.array(*map(F.lit, THRESHOLDS)), (1 + S("o_orderkey") % 7).cast("int"))
    flags = F.when(k % 2 == 0, F.create_map(F.lit("gpu"), F.lit("true")))
    key = reuse.detection_key(F.lit(" Web"), source, F.lit("m"), k % 7 + 1, F.lit(600), threshold, F.when(k % 3 != 0, F.lit(58)), flags)
    return o.select("o_orderkey", key.alias("cache_key"))


@query("""SELECT o_orderkey, sha256('{"end":"' || format('{:.12g}', o_totalprice / 7e0 + 1) || '","media_type":"video","padding":"' || format('{:.12g}', (o_custkey % 3) / 3e0) || '","source_identity":"web:' || o_custkey || '","start":"' || format('{:.12g}', o_totalprice / 7e9) || '"}') AS segment_key FROM orders""")
def segment_cache_key(spark, sf):
    price, k = S("o_totalprice"), S("o_custkey")
    key = reuse.segment_key(F.concat(F.lit("web:"), k.cast("string")), price / F.lit(7e9), price / F.lit(7.0) + 1, (k % 3) / F.lit(3.0), F.lit("Video"))
    return x.table(spark, sf, "orders").select("o_orderkey", key.alias("segment_key"))


@query(f"WITH {KEYED} SELECT * FROM k")
def cache_key(spark, sf):
    return _keys(spark, sf)


@query(f"""WITH {KEYED} SELECT o_orderkey, cache_key IN (SELECT cache_key FROM k WHERE o_orderkey % 3 = 0) AS reused FROM k""")
def detections_table(spark, sf):
    """Saves a third of the results, some of them twice, loads those that the requests name, and tells what is still to do. Results are one a key."""
    path, kept = new_folder(spark, "detections"), new_folder(spark, "keys")
    _keys(spark, sf).write.parquet(kept)
    k = spark.read.parquet(kept)
    third = k.filter("o_orderkey % 3 = 0").groupBy("cache_key").agg(F.min("o_orderkey").alias("result"))
    detections.save(third, path)
    detections.save(third.filter("result % 2 = 0"), path)
    saved = detections.load(spark, path, k)
    hit, todo = reuse.reuse(k, saved)
    done = k.join(hit.select("cache_key"), "cache_key")  # a result that came back twice would show
    return done.select("o_orderkey", F.lit(True).alias("reused")).union(todo.select("o_orderkey", F.lit(False)))


@query("""SELECT o_orderkey, o_custkey % 5 - 1 >= 0 AND o_orderkey % 600 >= 0 AND (o_custkey % 13 - 1) / 10e0 BETWEEN 0 AND 1 AND o_custkey % 600 < 527 AS valid,
  o_custkey % 9 - 1 >= 0 AND o_orderkey % 11 > o_custkey % 9 - 1 AND o_custkey % 4 - 1 >= 0 AS interval_valid FROM orders""")
def validate_params(spark, sf):
    k, n = S("o_custkey"), S("o_orderkey")
    valid = params.valid_detection(k % 5 - 1, n % 600, (k % 13 - 1) / F.lit(10.0), k % 600)
    return x.table(spark, sf, "orders").select("o_orderkey", valid.alias("valid"), params.valid_interval(k % 9 - 1, n % 11, k % 4 - 1, F.lit(0)).alias("interval_valid"))


EV = f"ev AS (SELECT event_id, user_id, event_type, (epoch_us(ts) - {x.EPOCH_US}) / 1e6 AS s, (epoch_us(ts) - {x.EPOCH_US}) / 1e6 + value * 1000 AS e FROM events)"


@query(f"""WITH {EV}, r AS (SELECT event_id, user_id, s - event_id % 3 * 10 AS s, e + event_id % 3 * 10 AS e, CASE WHEN event_id % 5 = 0 THEN 'audio' ELSE 'video' END AS m FROM ev WHERE event_type = 'click'),
c AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'audio' ELSE 'video' END AS m FROM ev WHERE event_type = 'view'),
j AS (SELECT r.event_id AS request_id, r.user_id AS source_key, c.event_id AS cached_id, row_number() OVER (PARTITION BY r.event_id ORDER BY c.e - c.s, c.s, c.event_id) AS q FROM r JOIN c ON r.user_id = c.user_id AND r.m = c.m AND c.s <= r.s AND c.e >= r.e)
SELECT request_id, source_key, cached_id FROM j WHERE q = 1""")
def covering_segment_lookup(spark, sf):
    s = x.intervals(spark, sf, 1000.0).select(S("ordinal"), S("user_id").alias("source_key"), "start_s", "end_s", S("source_key").alias("kind"))
    k = S("ordinal")
    requests = s.filter("kind = 'click'").select(k.alias("request_id"), "source_key", "start_s", "end_s", (k % 3 * 10.0).alias("padding"), F.when(k % 5 == 0, "AUDIO").otherwise("video").alias("media_type"))
    return reuse.covering_segment(requests, s.filter("kind = 'view'").select(k.alias("cached_id"), "source_key", "start_s", "end_s", F.when(k % 4 == 0, "audio").alias("media_type")))


@query("""WITH c AS (SELECT l_orderkey % 500 AS i, 'f' || l_linenumber AS f, l_orderkey % 500 || '-' || l_linenumber || '-' || l_partkey AS k, lpad(l_orderkey::VARCHAR, 12, '0') || '/' || l_linenumber || '/' || l_partkey AS p FROM lineitem WHERE l_suppkey % 3 = 0),
r AS (SELECT o_orderkey AS request_id, o_orderkey % 700 AS i, 'f' || (o_custkey % 9) AS f, o_orderkey % 700 || '-' || (o_custkey % 9) || '-' || (o_custkey % 200) AS k FROM orders),
a AS (SELECT k, min(p) AS p1 FROM c GROUP BY 1), b AS (SELECT i, f, min(p) AS p2 FROM c GROUP BY 1, 2)
SELECT request_id, coalesce(p1, p2) AS path, CASE WHEN p1 IS NOT NULL THEN 1 WHEN p2 IS NOT NULL THEN 2 END AS tier FROM r LEFT JOIN a USING (k) LEFT JOIN b USING (i, f)""")
def audio_cache_lookup(spark, sf):
    text = lambda c: c.cast("string")
    li, o = x.table(spark, sf, "lineitem").filter("l_suppkey % 3 = 0"), x.table(spark, sf, "orders")
    cached = li.select(
        F.concat_ws("/", F.lpad(text(S("l_orderkey")), 12, "0"), text(S("l_linenumber")), text(S("l_partkey"))).alias("path"), (S("l_orderkey") % 500).alias("identity"),
        F.concat(F.lit("f"), text(S("l_linenumber"))).alias("format"), F.concat_ws("-", text(S("l_orderkey") % 500), text(S("l_linenumber")), text(S("l_partkey"))).alias("exact_key"),
    )
    requests = o.select(
        S("o_orderkey").alias("request_id"), (S("o_orderkey") % 700).alias("identity"), F.concat(F.lit("f"), text(S("o_custkey") % 9)).alias("format"),
        F.concat_ws("-", text(S("o_orderkey") % 700), text(S("o_custkey") % 9), text(S("o_custkey") % 200)).alias("exact_key"),
    )
    return reuse.audio_lookup(requests, cached)


@query(f"WITH {x.SEG} SELECT source_key, ordinal, start_s, end_s, ordinal % 2 = 1 AS is_remote FROM seg")
def union_local_remote(spark, sf):
    s = x.intervals(spark, sf).select("source_key", "ordinal", "start_s", "end_s")
    return reuse.union_local_remote(s.filter("ordinal % 2 = 0"), s.filter("ordinal % 2 = 1"))


#: Transfers, some of them with negative, missing or odd values.
MOVED = """t AS (SELECT event_id, value * 1e6 - 5e6 AS c, (['5e7', NULL, '0', '2e7'])[1 + event_id % 4]::DOUBLE AS total, CASE WHEN event_id % 31 < 30 THEN (event_id % 30 - 1)::DOUBLE END AS el, (['600', NULL, 'n/a', '-3'])[1 + event_id // 4 % 4] AS d FROM events),
m AS (SELECT event_id, total, greatest(coalesce(c, 0), 0) AS cur, greatest(coalesce(el, 0), 0) AS t, try_cast(d AS DOUBLE) AS dur FROM t), r AS (SELECT *, CASE WHEN t > 0 THEN cur / t ELSE 0 END AS rate FROM m)"""


def _moved(spark, sf):
    k = S("event_id")
    total, length = F.element_at(F.array(F.lit(5e7), F.lit(None), F.lit(0.0), F.lit(2e7)), (1 + k % 4).cast("int")), F.element_at(F.array(F.lit("600"), F.lit(None), F.lit("n/a"), F.lit("-3")), (1 + F.floor(k / 4) % 4).cast("int"))
    return x.table(spark, sf, "events").select("event_id", (S("value") * 1e6 - 5e6).alias("current"), total.alias("total"), F.when(k % 31 < 30, (k % 30 - 1).cast("double")).alias("elapsed"), length.alias("source_duration"))


FIGURES = ["event_id", "percent", "speed_mb_s", "eta_seconds", "realtime", "stage"]


@query(f"""WITH {MOVED} SELECT event_id, CASE WHEN total > 0 THEN least(100, cur / total * 100) END AS percent, rate / 1048576 AS speed_mb_s, CASE WHEN total > 0 AND rate > 0 THEN greatest(0, (total - cur) / rate) END AS eta_seconds,
  CASE WHEN dur > 0 AND t > 0 THEN CASE WHEN total > 0 THEN cur / total * dur / t ELSE dur / t END END AS realtime, CASE WHEN total > 0 AND cur >= total THEN 'completed' ELSE 'transferring' END AS stage FROM r""")
def transfer_metrics(spark, sf):
    return transfer.metrics(_moved(spark, sf)).select(*FIGURES)


@query(f"""WITH {MOVED}, b AS (SELECT *, floor(cur) AS n, greatest(floor(coalesce(total, 1)), 1) AS of FROM r) SELECT event_id, least(100, n / of * 100) AS percent, NULL::DOUBLE AS speed_mb_s, NULL::DOUBLE AS eta_seconds,
  CASE WHEN dur > 0 AND t > 0 THEN n / of * dur / t END AS realtime, CASE WHEN n >= of THEN 'completed' ELSE 'transferring' END AS stage FROM b""")
def block_metrics(spark, sf):
    return transfer.block_metrics(_moved(spark, sf)).select(*FIGURES)


@query(f"""WITH {MOVED} SELECT event_id, CASE WHEN total > 0 THEN least(100, cur / total * 100) END AS percent, NULL::DOUBLE AS speed_mb_s, CASE WHEN total > 0 AND rate > 0 THEN (total - cur) / rate END AS eta_seconds,
  nullif(rate, 0) AS realtime, CASE WHEN total > 0 AND cur >= total THEN 'completed' ELSE 'compiling' END AS stage FROM r""")
def compile_metrics(spark, sf):
    return transfer.compile_metrics(_moved(spark, sf)).select(*FIGURES)


@query(f"""WITH {MOVED} SELECT event_id, CASE WHEN total > 0 THEN least(100, cur / total * 100) END AS percent, NULL::DOUBLE AS speed_mb_s, CASE WHEN total > 0 AND rate > 0 THEN greatest(0, (total - cur) / rate) END AS eta_seconds,
  CASE WHEN total > 0 AND t > 0 THEN cur / t END AS realtime, CASE WHEN total > 0 AND cur >= total THEN 'completed' ELSE 'transferring' END AS stage FROM r""")
def fetch_metrics(spark, sf):
    return transfer.fetch_metrics(_moved(spark, sf)).select(*FIGURES)


STREAK = """o AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value AS speed FROM events),
f AS (SELECT key, seq, 1 AS seen, 0 AS run, false AS alarm FROM o WHERE seq = 1
  UNION ALL SELECT o.key, o.seq, CASE WHEN f.seen >= 2 AND o.speed < 35 AND f.run + 1 >= 2 THEN 0 ELSE f.seen + 1 END,
    CASE WHEN f.seen >= 2 AND o.speed < 35 AND f.run + 1 < 2 THEN f.run + 1 ELSE 0 END, f.seen >= 2 AND o.speed < 35 AND f.run + 1 >= 2
  FROM f JOIN o ON o.key = f.key AND o.seq = f.seq + 1)"""


def speed_samples(spark, sf):
    from pyspark.sql import Window as W

    no = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return x.table(spark, sf, "events").select(S("user_id").alias("key"), no.alias("seq"), S("value").alias("speed"))


@query(f"WITH RECURSIVE {STREAK} SELECT key, seq FROM f WHERE alarm")
def slow_streak(spark, sf):
    return transfer.slow_streak(speed_samples(spark, sf), 35.0)


@query()
def scan_media_folder(spark, sf):
    """The tables' own files, by their ending, in natural order."""
    return wav.media_files(spark, sf, ("parquet",)).orderBy(catalog.smart_sort_key(S("path"))).select("path", "length")


def _wav_files(spark, sf):
    """Blocks of samples as WAV files in the shared folder; every fifth one is broken."""
    path, block = new_folder(spark, "wav"), F.floor(S("first_sample") / 1000)
    name = F.concat("source_key", F.lit("/"), block.cast("string"), F.lit(".wav"))
    lead = F.when(block % 5 == 4, F.lit(b"JUNK")).otherwise(F.lit(b""))
    wav.write_wav(x.chunks(spark, sf, 1000).select(name.alias("name"), F.lit(1000).alias("rate"), "payload", lead.alias("lead")), path)
    return path


@query(f"""WITH {x.SAMPLES}, b AS (SELECT source_key, sample_no // 1000 AS b, (sample_no % 1000) // 400 AS chunk_no, count(*) AS n, md5(string_agg(printf('%02X%02X', sample % 256, sample // 256), '' ORDER BY sample_no)) AS digest FROM samples GROUP BY ALL)
SELECT source_key || '/' || b || '.wav' AS path, chunk_no, 2 * n AS n_bytes, digest, NULL AS error FROM b WHERE b % 5 <> 4
UNION ALL SELECT DISTINCT source_key || '/' || b || '.wav', NULL, NULL, NULL, 'not a WAV file' FROM b WHERE b % 5 = 4""")
def read_pcm_wav(spark, sf):
    path = _wav_files(spark, sf)
    name = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")  # below the folder
    return wav.read_wav(spark, path, 400, 1600).select(name.alias("path"), "chunk_no", F.length("payload").cast("long").alias("n_bytes"), F.md5(F.hex("payload")).alias("digest"), "error")


@query(f"""WITH {x.SAMPLES}, p AS (SELECT source_key, sample_no // 3000 AS clip_no, sample_no, sample FROM samples WHERE sample_no % 3000 BETWEEN 100 AND 1349)
SELECT source_key, clip_no, 2 * count(*) AS n_bytes, md5(string_agg(printf('%02X%02X', sample % 256, sample // 256), '' ORDER BY sample_no)) AS digest FROM p GROUP BY 1, 2""")
def extract_clips(spark, sf):
    s = x.samples(spark, sf)
    n = s.groupBy("source_key").agg(F.max("sample_no").alias("n")).select("source_key", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(S("n") / 3000))).alias("clip_no"))
    plan = n.select("source_key", "clip_no", (S("clip_no") * 30.0 + 1.0).alias("start_s"), (S("clip_no") * 30.0 + 13.5).alias("end_s"))
    c = wav.extract_clips(intervals.pad_plain(plan, 0.0, 0.0), x.chunks(spark, sf), 100)
    return c.select("source_key", "clip_no", F.length("payload").cast("long").alias("n_bytes"), F.md5(F.hex("payload")).alias("digest"))
