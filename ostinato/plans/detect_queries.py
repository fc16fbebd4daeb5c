"""Queries of detection and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.operators import detect, rescan, signal
from ostinato.plans import fixtures as x
from ostinato.plans.registry import query

P = x.DETECT


@query(f"WITH {x.BUCKETS} SELECT * FROM buckets")
def subsample_max(spark, sf):
    return detect.subsample_max(detect.focus_scores(x.frames(spark, sf), P), P)


@query(f"WITH {x.ISLANDS} SELECT * FROM hits")
def threshold_filter(spark, sf):
    return detect.threshold_filter(subsample_max(spark, sf), P)


@query(f"WITH {x.ISLANDS} SELECT * FROM isl")
def islands(spark, sf):
    return detect.islands(threshold_filter(spark, sf))


@query(f"WITH {x.ISLANDS} SELECT * FROM agg")
def segment_aggregate(spark, sf):
    return detect.segment_aggregate(islands(spark, sf))


BOUNDS = """bounds AS (SELECT *, first_bucket * 2 / 100 + block_no * 100 AS start_s, last_bucket * 2 / 100 + block_no * 100 + 1 AS end_s FROM agg)"""


@query(f"WITH {x.ISLANDS}, {BOUNDS} SELECT * FROM bounds")
def segment_bounds(spark, sf):
    return detect.segment_bounds(segment_aggregate(spark, sf), P)


PEAK = """peak AS (SELECT a.source_key, a.block_no, island, first_bucket, last_bucket, pred, frame_no, scores,
    row_number() OVER (PARTITION BY a.source_key, a.block_no, island ORDER BY f.score DESC, frame_no) AS r
  FROM agg a JOIN frames f ON f.source_key = a.source_key AND f.block_no = a.block_no AND f.frame_no // 2 BETWEEN first_bucket AND last_bucket),
top AS (SELECT source_key, block_no, island, first_bucket, last_bucket, pred, frame_no::BIGINT AS peak_frame,
    (list_position(scores, list_max(scores)) - 1)::INT AS top1_idx, round(list_max(scores)::DOUBLE, 6) AS top1_score,
    list_position(scores, list_max(scores)) - 1 <> 58 AS suspect FROM peak WHERE r = 1)"""


@query(f"WITH {x.ISLANDS}, {PEAK} SELECT * FROM top")
def peak_frame_argmax(spark, sf):
    buckets = detect.threshold_filter(detect.bucket_peaks(detect.frame_peaks(x.frames(spark, sf), P), P), P)
    return detect.segment_peaks(detect.islands(buckets), P)


DETECTED = f"""{x.ISLANDS}, {PEAK}, detected AS (SELECT source_key, block_no, first_bucket * 2 / 100 + block_no * 100 AS start_s,
  last_bucket * 2 / 100 + block_no * 100 + 1 AS end_s, pred, suspect, top1_idx, top1_score FROM top)"""


@query(f"WITH {DETECTED} SELECT * FROM detected")
def detect_segments(spark, sf):
    return detect.detect_segments(x.frames(spark, sf), P)


@query(f"WITH {DETECTED} SELECT source_key, count(*) AS n_clips FROM detected GROUP BY ALL")
def detection_summary(spark, sf):
    return detect.detection_summary(detect_segments(spark, sf))


DURATION = "d AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS duration FROM customer)"


def _durations(spark, sf):
    d = F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_acctbal"))
    return x.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), d.alias("duration"))


@query(f"""WITH {DURATION} SELECT k, CASE WHEN duration IS NULL THEN 1 ELSE greatest(1, ceil(duration / 600)) END::BIGINT AS n_remote,
  CASE WHEN duration IS NULL THEN 1 ELSE greatest(1, floor(duration / 600) + 1) END::BIGINT AS n_local FROM d""")
def block_count(spark, sf):
    d = F.col("duration")
    return _durations(spark, sf).select("k", detect.block_count(d, 600).alias("n_remote"), detect.block_count(d, 600, local=True).alias("n_local"))


@query(f"""WITH {DURATION}, e AS (SELECT k, duration, unnest(range(greatest(1, ceil(duration / 600))::BIGINT)) AS block_no FROM d WHERE duration > 0)
SELECT k::VARCHAR AS source_key, block_no, (block_no * 600)::DOUBLE AS start_s, least(600.0::DOUBLE, duration - block_no * 600) AS length_s FROM e""")
def block_ranges(spark, sf):
    return detect.block_ranges(_durations(spark, sf).select(F.col("k").cast("string").alias("source_key"), "duration"), 600)


@query("""WITH e AS (SELECT o_orderkey::VARCHAR AS source_key, 1 + o_orderkey % 5 AS n_expected FROM orders),
p AS (SELECT l_orderkey::VARCHAR AS source_key, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL)
SELECT source_key, n_expected, coalesce(n, 0) AS n_processed, coalesce(n, 0) >= n_expected AS complete FROM e LEFT JOIN p USING (source_key)""")
def completeness_check(spark, sf):
    expected = x.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("source_key"), (1 + F.col("o_orderkey") % 5).alias("n_expected"))
    done = x.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_key"), F.col("l_linenumber").alias("block_no"))
    return detect.completeness(expected, done)


@query(f"""WITH {x.SAMPLES}, b AS (SELECT source_key, sample_no // 1000 AS block_no, count(*) AS n_samples, string_agg(printf('%02X%02X', sample % 256, sample // 256), '' ORDER BY sample_no) AS h FROM samples GROUP BY ALL)
SELECT source_key, block_no, n_samples, 2000 AS n_bytes, md5(rpad(h, 4000, '0')) AS digest FROM b""")
def block_pad(spark, sf):
    b = signal.block_pad(x.chunks(spark, sf), 1000)
    return b.select("source_key", "block_no", "n_samples", F.octet_length("payload").alias("n_bytes"), F.md5(F.hex("payload")).alias("digest"))


@query("SELECT vec_id, list_transform(range(1, 33), lambda i: embedding[i]::DOUBLE * 0.5::DOUBLE + embedding[i + 32]::DOUBLE * 0.5::DOUBLE)[7] AS mixed_7, 32 AS n FROM embeddings")
def downmix(spark, sf):
    as_double = F.transform("embedding", lambda v: v.cast("double"))
    e = x.table(spark, sf, "embeddings").select("vec_id", as_double.alias("e"))
    m = e.select("vec_id", signal.mono(F.slice("e", 1, 32), F.slice("e", 33, 32)).alias("m"))
    return m.select("vec_id", F.get("m", F.lit(6)).alias("mixed_7"), F.size("m").alias("n"))


@query(f"""WITH {x.SAMPLES}, r AS (SELECT source_key, sample_no // 1000 AS block_no, sqrt(avg((sample / 32767) * (sample / 32767))) AS rms FROM samples GROUP BY ALL)
SELECT source_key, block_no, round(rms, 9) AS rms, round(CASE WHEN rms > 0.005 THEN least(2.5, 0.25 / rms) ELSE 1.0 END, 9) AS gain FROM r""")
def block_rms_gain(spark, sf):
    g = signal.block_rms_gain(x.chunks(spark, sf), 1000)
    return g.select("source_key", "block_no", F.round("rms", 9).alias("rms"), F.round("gain", 9).alias("gain"))


#: Frames of 100 samples, ten to a block: the mean square, and one less that.
POWER = """power AS (SELECT source_key, sample_no // 1000 AS block_no, (sample_no % 1000 // 100)::INT AS frame_no, least(sum((sample / 32768)::FLOAT::DOUBLE * (sample / 32768)::FLOAT::DOUBLE) / 100, 1) AS p FROM samples GROUP BY ALL),
blocks AS (SELECT DISTINCT source_key, block_no FROM power), framed AS (SELECT b.source_key, b.block_no, i.i::INT AS frame_no, coalesce(p, 0) AS p FROM blocks b CROSS JOIN range(10) i(i) LEFT JOIN power q ON q.source_key = b.source_key AND q.block_no = b.block_no AND q.frame_no = i.i)"""


@query(f"WITH {x.SAMPLES}, {POWER} SELECT source_key, block_no, frame_no, p::FLOAT::DOUBLE AS power, (1 - p)::FLOAT::DOUBLE AS rest FROM framed")
def score_blocks(spark, sf):
    """Padded blocks through a scorer, then the same detection as on ready frames."""
    blocks = signal.block_pad(x.chunks(spark, sf), 1000)
    f = detect.score_blocks(blocks, detect.power_scorer(frame=100), detect.FRAME_SCHEMA)
    one = lambda i: F.get("scores", F.lit(i)).cast("double")
    return f.select("source_key", "block_no", "frame_no", one(0).alias("power"), one(1).alias("rest"))


RESCANNED = """o AS (SELECT source_key, sample_no, sample_no // 6000 AS minute, sample_no - row_number() OVER (PARTITION BY source_key, sample_no // 6000 ORDER BY sample_no) AS isl FROM samples WHERE sample > 4000),
h AS (SELECT source_key, min(sample_no) AS a, greatest(0, min(sample_no) / 100 - 10) AS s, max(sample_no) / 100 + 1 + 10 AS e FROM o GROUP BY source_key, minute, isl),
m AS (SELECT *, max(e) OVER (PARTITION BY source_key ORDER BY s, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM h),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY s, a) AS g FROM m), w AS (SELECT source_key, min(s) AS s, max(e) AS e FROM g GROUP BY source_key, g),
b AS (SELECT source_key, s, unnest(range(floor((e - s) / 10)::BIGINT)) AS n, round(s * 100)::BIGINT AS first FROM w WHERE e - s >= 10),
x AS (SELECT b.source_key, s, n, sample_no - first - n * 1000 AS f, sample / 32767 AS v FROM b JOIN samples q ON q.source_key = b.source_key AND sample_no >= first + n * 1000 AND sample_no < first + (n + 1) * 1000),
r AS (SELECT source_key, s, n, sqrt(avg(v * v)) AS rms FROM x GROUP BY ALL HAVING count(*) = 1000),
y AS (SELECT x.*, least(1, pow((v * CASE WHEN rms > 0.005 THEN least(2.5, 0.25 / rms) ELSE 1 END)::FLOAT::DOUBLE, 2)) AS p FROM x JOIN r USING (source_key, s, n)),
z AS (SELECT source_key, s, n, f, f // 10 AS bucket, p::FLOAT::DOUBLE AS p, (1 - p)::FLOAT::DOUBLE AS q FROM y), u AS (SELECT source_key, s, n, bucket, max(p) AS p FROM z GROUP BY ALL HAVING max(p) > 0.01),
i AS (SELECT *, bucket - row_number() OVER (PARTITION BY source_key, s, n ORDER BY bucket) AS isl FROM u),
a AS (SELECT source_key, s, n, isl, min(bucket) AS b0, max(bucket) AS b1, round(max(p), 6) AS pred FROM i GROUP BY ALL),
k AS (SELECT a.*, z.p, z.q, row_number() OVER (PARTITION BY a.source_key, a.s, a.n, isl ORDER BY z.p DESC, f) AS o FROM a JOIN z ON z.source_key = a.source_key AND z.s = a.s AND z.n = a.n AND z.bucket BETWEEN b0 AND b1)"""


@query(f"""WITH {x.SAMPLES}, {RESCANNED} SELECT source_key, n AS block_no, b0 * 10 / 100 + n * 10 + s AS start_s, b1 * 10 / 100 + n * 10 + 1 + s AS end_s, pred, q > p AS suspect, (q > p)::INT AS top1_idx, round(greatest(p, q), 6) AS top1_score,
  CASE WHEN pred > 0.75 THEN 'direct' WHEN q <= p THEN 'confirmed' ELSE 'rejected' END AS outcome, 'new' AS kind FROM k WHERE o = 1""")
def rescan_hits(spark, sf):
    """Windows around all hits, scored again with gain: accepted and rejected rows."""
    return rescan.demo(x.samples(spark, sf))


@query(f"""WITH {x.SEG}, w AS (SELECT source_key, ordinal, start_s, end_s, floor((end_s - start_s) / 10)::BIGINT AS n_blocks FROM seg
  WHERE end_s - start_s >= 1.0 AND end_s - start_s >= 10)
SELECT source_key, ordinal, start_s, start_s + n_blocks * 10 AS end_s, n_blocks FROM w""")
def interval_slice_prefilter(spark, sf):
    return rescan.whole_blocks(x.intervals(spark, sf).select("source_key", "ordinal", "start_s", "end_s"), 10)


@query(f"""WITH {x.SEG}, n AS (SELECT source_key, count(DISTINCT ordinal // 100) AS n, count(DISTINCT ordinal // 100) + (source_key = 'click')::INT AS e FROM seg GROUP BY 1)
SELECT source_key, ordinal, start_s, end_s FROM seg JOIN n USING (source_key) WHERE n >= e""")
def rescan_of_complete(spark, sf):
    s = x.intervals(spark, sf).select("source_key", "ordinal", "start_s", "end_s")
    blocks = s.select("source_key", F.floor(F.col("ordinal") / 100).alias("block_no"))
    expected = blocks.groupBy("source_key").agg(F.count_distinct("block_no").alias("n")).select("source_key", (F.col("n") + (F.col("source_key") == "click").cast("int")).alias("n_expected"))
    return rescan.of_complete(s, detect.completeness(expected, blocks))


@query(f"""WITH {x.SEG}, r AS (SELECT *, CASE WHEN pred > 0.75 THEN 'direct' WHEN NOT suspect THEN 'confirmed' ELSE 'rejected' END AS outcome FROM seg)
SELECT source_key, count(*) AS n_windows, count(*) FILTER (outcome = 'confirmed') AS n_confirmed, count(*) FILTER (outcome = 'direct') AS n_direct,
  count(*) FILTER (outcome = 'rejected') AS n_rejected FROM r GROUP BY ALL""")
def verify_summary(spark, sf):
    return rescan.verify_summary(rescan.verified(x.intervals(spark, sf)))
