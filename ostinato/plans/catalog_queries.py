"""Queries of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions import media, urls
from ostinato.operators import catalog, match, ordered
from ostinato.plans import fixtures as x
from ostinato.plans.registry import query
from ostinato.sources import playlist

S = F.col


def _pages(spark, sf):
    return x.table(spark, sf, "pages").select("page_id", "url")


PART = "part"
NAMES = "n AS (SELECT p_partkey AS k, p_name || '.' || (['mp4', 'MKV', 'webm', 'flac', 'ogg', 'txt'])[1 + p_partkey % 6] AS path FROM part)"


@query(f"""WITH {NAMES}, t AS (SELECT k, path, CASE WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('mp4','avi','mkv','m4v','mov','webm','flv','ts') THEN 'video'
  WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('mp3','wav','flac','ogg','m4a','aac') THEN 'audio' END AS media_type FROM n)
SELECT * FROM t WHERE media_type IS NOT NULL AND path NOT IN (SELECT path FROM n WHERE k % 10 = 0)""")
def classify_media_type(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, ("mp4", "MKV", "webm", "flac", "ogg", "txt"))), (1 + S("p_partkey") % 6).cast("int"))
    n = x.table(spark, sf, "part").select(S("p_partkey").alias("k"), F.concat_ws(".", "p_name", ext).alias("path"))
    listed = n.filter("k % 10 = 0").select("path")
    return n.join(listed, "path", "left_anti").select("k", "path", media.media_type(S("path")).alias("media_type")).filter("media_type is not null")


@query("""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN upper(regexp_extract(url, '^[a-z]+://[^/]+')) || regexp_replace(url, '^[a-z]+://[^/]+', '') || '?q=' || page_id || '#f' ELSE url END AS url FROM pages)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'web:id' || page_id ELSE 'web:' || lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) END AS source_key FROM p""")
def stable_source_id(spark, sf):
    lead = F.regexp_extract("url", r"^[a-z]+://[^/]+", 0)
    odd = F.concat(F.upper(lead), F.regexp_replace("url", r"^[a-z]+://[^/]+", ""), F.lit("?q="), S("page_id").cast("string"), F.lit("#f"))
    p = _pages(spark, sf).select("page_id", F.when(S("page_id") % 3 == 0, odd).otherwise(S("url")).alias("url"))
    own = F.when(S("page_id") % 4 == 0, F.concat(F.lit("id"), S("page_id").cast("string")))
    return p.select("page_id", urls.stable_source_id(F.lit("Web"), own, S("url")).alias("source_key"))


#: Addresses, in which # stands for a number, and extractors' names.
ADDRESSES = [
    "https://space.bilibili.com/#", "https://space.bilibili.com/#/upload/video", "https://space.bilibili.com/#/lists/9?type=series", "https://space.bilibili.com/#/lists/9?type=season",
    "https://www.bilibili.com/list/#?sid=4", "https://www.bilibili.com/list/#", "https://b23.tv/BV#", "https://WWW.Twitch.tv/u#/videos", "https://www.twitch.tv/videos/#",
    "https://www.youtube.com/playlist?list=PL#", "http://m.youtube.com/watch?v=1&list=L%2D#&x=2", "https://www.youtube.com/watch?list=&v=#", "https://YouTube.com/watch?v=#&list=A#&list=B",
    "https://youtu.be/watch?list=#", "https://www.youtube.com/@n#/streams", "https://www.youtube.com/channel/C#/videos/", "https://www.youtube.com/@n#", "https://x.example/watch?list=#", "https://www.youtube.com/watch/?list=#",
]
EXTRACTORS = ["YoutubeTab", "YoutubePlaylist", "Generic", "", None, "BiliBili", "youtube:tab"]


def listed(values) -> str:
    """A list as SQL."""
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, k):
    """The k-th of some values, round and round."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (1 + k % len(values)).cast("int"))


HOSTS = f"""h AS (SELECT page_id, replace({listed(ADDRESSES)}[1 + page_id % {len(ADDRESSES)}], '#', page_id::VARCHAR) AS url, {listed(EXTRACTORS)}[1 + page_id % {len(EXTRACTORS)}] AS ex FROM pages),
g AS (SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS place, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, '&' || regexp_extract(url, '\\?([^#]*)', 1) AS q FROM h),
l AS (SELECT *, lower(place) AS host, rtrim(path, '/') AS bare, url_decode(regexp_extract(q, '&list=([^&]+)', 1)) AS list FROM g)"""


def _hosts(spark, sf):
    k = S("page_id")
    return _pages(spark, sf).select("page_id", F.replace(pick(ADDRESSES, k), F.lit("#"), k.cast("string")).alias("url"), pick(EXTRACTORS, k).alias("ex"))


@query(f"""WITH {HOSTS} SELECT page_id, CASE WHEN (host LIKE '%.bilibili.com' OR host IN ('bilibili.com', 'b23.tv')) AND regexp_full_match(bare, '/[^/]+/lists/[^/]+') AND q LIKE '%&type=series%' THEN 'bilibili-series'
  WHEN host LIKE '%.bilibili.com' AND regexp_full_match(bare, '/list/[^/]+') AND regexp_matches(q, '&sid=[^&]') THEN 'bilibili-collection'
  WHEN host LIKE '%.bilibili.com' AND regexp_full_match(bare, '/[^/]+/upload/video') THEN 'bilibili-uploads' WHEN host = 'space.bilibili.com' AND regexp_full_match(bare, '/[^/]+') THEN 'bilibili-uploads'
  WHEN host LIKE '%twitch.tv' AND regexp_full_match(bare, '/[^/]+/videos') THEN 'twitch-vods' WHEN host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com') AND bare = '/playlist' AND list <> '' THEN 'youtube'
  WHEN host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com') AND regexp_full_match(bare, '/(@[^/]+|channel/[^/]+|user/[^/]+|c/[^/]+)/(videos|streams|shorts)') THEN 'youtube-uploads'
  WHEN lower(ex) IN ('youtubetab', 'youtubeplaylist') THEN 'youtube' WHEN coalesce(ex, '') = '' THEN 'unknown' ELSE lower(ex) END AS platform FROM l""")
def classify_platform(spark, sf):
    return _hosts(spark, sf).select("page_id", urls.classify_platform(S("url"), S("ex")).alias("platform"))


@query(f"""WITH {HOSTS} SELECT page_id, CASE WHEN host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com') AND path = '/watch' AND list <> '' THEN scheme || '://' || place || '/playlist?list=' || list ELSE url END AS url FROM l""")
def canonical_playlist_url(spark, sf):
    return _hosts(spark, sf).select("page_id", urls.canonical_playlist_url(S("url")).alias("url"))


@query("""WITH v AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN ' HTTP://x/' || page_id ELSE 'ftp://x/' || page_id END AS v FROM pages)
SELECT page_id, regexp_matches(v, '(?i)^\\s*https?://') AS is_url FROM v""")
def is_url(spark, sf):
    k = S("page_id") % 3
    v = F.when(k == 0, S("url")).when(k == 1, F.concat(F.lit(" HTTP://x/"), S("page_id").cast("string"))).otherwise(F.concat(F.lit("ftp://x/"), S("page_id").cast("string")))
    return _pages(spark, sf).select("page_id", urls.is_url(v).alias("is_url"))


@query("""WITH v AS (SELECT page_id, url, ['https://cdn-a.example' || regexp_replace(url, '^https?://[^/]+', ''), 'https://cdn-b.example' || regexp_replace(url, '^https?://[^/]+', '')] AS o, regexp_extract(url, '^https?://') AS sch FROM pages),
w AS (SELECT page_id, [url, replace(o[1], 'https://', sch), replace(o[2], 'https://', sch)] AS vs FROM v)
SELECT page_id, unnest(range(3)) AS variant, unnest(vs) AS url FROM w""")
def cdn_variants(spark, sf):
    v = _pages(spark, sf).select("page_id", F.posexplode(urls.cdn_variants(S("url"), ["cdn-a.example", "cdn-b.example"])).alias("variant", "url"))
    return v.withColumn("variant", S("variant").cast("long"))


@query("""WITH d AS (SELECT pages.*, 1 AS rep FROM pages UNION ALL SELECT page_id + 100000, upper(regexp_extract(url, '^[a-z]+://[^/]+')) || regexp_replace(url, '^[a-z]+://[^/]+', ''), html, 2 FROM pages),
k AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS key FROM d)
SELECT 'web:' || key AS source_key, min(page_id) AS ordinal FROM k GROUP BY key""")
def dedupe_first_seen(spark, sf):
    p = _pages(spark, sf)
    again = F.concat(F.upper(F.regexp_extract("url", r"^[a-z]+://[^/]+", 0)), F.regexp_replace("url", r"^[a-z]+://[^/]+", ""))
    both = p.union(p.select(S("page_id") + 100_000, again)).select(S("page_id").alias("ordinal"), urls.stable_source_id(F.lit("web"), F.lit(None), S("url")).alias("source_key"))
    return catalog.first_seen(both, ["source_key"]).select("source_key", "ordinal")


ACODECS, VCODECS = ["none", "aac", "", "NONE", None], [None, "h264", "none", ""]
CAND = f"""cand AS (SELECT l_orderkey AS source_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'f' || (l_partkey % 5) END AS format_id,
  CASE WHEN l_suppkey % 11 > 0 THEN 'u' || (l_suppkey % 6) END AS url, {listed(ACODECS)}[1 + l_partkey % 5] AS acodec, {listed(VCODECS)}[1 + l_suppkey % 4] AS vcodec,
  l_quantity - 20 AS abr, l_extendedprice / 1000 AS tbr, (l_partkey % 10 * 144)::DOUBLE AS height, l_suppkey % 7 = 0 AS requested, CASE WHEN l_partkey % 4 > 0 THEN l_discount * 20 END AS speed FROM lineitem)"""


def _candidates(spark, sf):
    from pyspark.sql import Window as W

    no = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return x.table(spark, sf, "lineitem").select(
        S("l_orderkey").alias("source_key"), no.cast("long").alias("ordinal"), F.when(S("l_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("f"), (S("l_partkey") % 5).cast("string"))).alias("format_id"),
        F.when(S("l_suppkey") % 11 > 0, F.concat(F.lit("u"), (S("l_suppkey") % 6).cast("string"))).alias("url"), pick(ACODECS, S("l_partkey")).alias("acodec"),
        pick(VCODECS, S("l_suppkey")).alias("vcodec"), (S("l_quantity") - 20).alias("abr"), (S("l_extendedprice") / 1000).alias("tbr"),
        (S("l_partkey") % 10 * 144).cast("double").alias("height"), (S("l_suppkey") % 7 == 0).alias("requested"), F.when(S("l_partkey") % 4 > 0, S("l_discount") * 20).alias("speed"),
    )


@query(f"WITH {CAND} SELECT source_key, ordinal, format_id, url, acodec, vcodec FROM cand WHERE acodec IS NOT NULL AND acodec <> 'none' AND (vcodec IS NULL OR vcodec = 'none')")
def stream_kind_filter(spark, sf):
    return catalog.stream_kind(_candidates(spark, sf), "audio").select("source_key", "ordinal", "format_id", "url", "acodec", "vcodec")


@query(f"""WITH RECURSIVE {CAND}, n AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY ordinal) AS no FROM cand WHERE url IS NOT NULL),
f AS (SELECT source_key, no, [format_id] AS fs, [url] AS us, true AS took FROM n WHERE no = 1
  UNION ALL SELECT c.source_key, c.no, CASE WHEN s THEN fs ELSE list_append(fs, c.format_id) END, CASE WHEN s THEN us ELSE list_append(us, c.url) END, NOT s
  FROM (SELECT c.*, fs, us, (c.format_id <> '' AND list_contains(fs, c.format_id)) OR list_contains(us, c.url) AS s FROM f JOIN n c ON c.source_key = f.source_key AND c.no = f.no + 1) c)
SELECT source_key, ordinal, n.format_id, n.url FROM f JOIN n USING (source_key, no) WHERE took AND vcodec IS NOT NULL AND vcodec <> 'none'""")
def dedupe_candidates(spark, sf):
    return catalog.distinct_candidates(_candidates(spark, sf), "video").select("source_key", "ordinal", "format_id", "url")


RANK = "row_number() OVER (PARTITION BY source_key ORDER BY greatest(abr, tbr, 0) DESC, requested DESC, greatest(abr, 0) + greatest(tbr, 0) DESC, format_id DESC)"


@query(f"WITH {CAND}, r AS (SELECT source_key, greatest(abr, tbr) AS best, {RANK}::INT AS rank FROM cand) SELECT * FROM r")
def rank_candidates(spark, sf):
    return catalog.rank(_candidates(spark, sf), "audio").select("source_key", F.greatest("abr", "tbr").alias("best"), "rank")


VRANK = "row_number() OVER (PARTITION BY source_key ORDER BY requested DESC, height DESC, tbr DESC, format_id DESC)"


@query(f"""WITH {CAND}, r AS (SELECT source_key, format_id, height, {VRANK}::INT AS rank FROM cand),
o AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY CASE WHEN height > 0 AND height <= 700 THEN 0 WHEN height > 0 THEN 1 ELSE 2 END,
  CASE WHEN height > 0 AND height <= 700 THEN -height ELSE height END, rank) AS q FROM r) SELECT source_key, format_id, height, rank FROM o WHERE q = 1""")
def quality_cap(spark, sf):
    return catalog.quality_cap(catalog.rank(_candidates(spark, sf), "video"), 700.0)


@query(f"""WITH {CAND}, r AS (SELECT source_key, format_id AS group_id, ordinal AS variant, speed, {RANK} AS rank FROM cand),
g AS (SELECT *, min(rank) OVER (PARTITION BY source_key, group_id) AS gr, row_number() OVER (PARTITION BY source_key, group_id ORDER BY coalesce(speed, -1) DESC, rank) AS fr FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY gr) AS o FROM g WHERE fr = 1 AND speed >= 1.0)
SELECT r.source_key, coalesce(w.group_id, r.group_id) AS group_id, coalesce(w.variant, r.variant) AS variant, CASE WHEN w.source_key IS NULL THEN r.speed ELSE w.speed END AS speed, w.source_key IS NOT NULL AS fast_enough
FROM r LEFT JOIN w ON w.source_key = r.source_key AND w.o = 1 WHERE r.rank = 1""")
def probe_select(spark, sf):
    ranked = catalog.rank(_candidates(spark, sf), "audio").select("source_key", S("format_id").alias("group_id"), S("ordinal").alias("variant"), "speed", "rank")
    return catalog.probe_select(ranked)


TEXTS = ["Unknown", "name 2024年3月5日", "name", "2024年 3月5日", "2023年13月40日 x"]
ENTRIES = f"""e AS (SELECT p_partkey AS entry_id, {listed(TEXTS)}[1 + p_partkey % 5] AS title, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS duration, CASE WHEN p_partkey % 9 = 0 THEN '2023-01-02' ELSE '' END AS upload_date FROM part),
r AS (SELECT p_partkey AS entry_id, CASE p_partkey % 3 WHEN 0 THEN 'T2022年1月2日' WHEN 1 THEN '' END AS title, CASE WHEN p_partkey % 3 = 0 THEN 'n/a' WHEN p_partkey % 3 = 1 THEN p_retailprice::VARCHAR END AS duration, p_size * 100 AS ms,
  CASE p_partkey % 7 WHEN 0 THEN '20221231' WHEN 1 THEN 'soon' END AS upload_date, CASE WHEN p_partkey % 7 < 3 THEN p_size * 86400 END AS timestamp FROM part WHERE p_partkey % 4 <> 0)"""


def _entries(spark, sf):
    k = S("p_partkey")
    p = x.table(spark, sf, "part")
    e = p.select(
        k.alias("entry_id"), pick(TEXTS, k).alias("title"), F.when(k % 2 == 0, S("p_size").cast("double")).alias("duration"), F.when(k % 9 == 0, "2023-01-02").otherwise("").alias("upload_date"),
        F.create_map(F.lit("id"), k.cast("string"), F.lit("own"), F.lit("1")).alias("metadata"),
    )
    fields = {
        "title": F.when(k % 3 == 0, "T2022年1月2日").when(k % 3 == 1, ""), "duration": F.when(k % 3 == 0, "n/a").when(k % 3 == 1, S("p_retailprice").cast("string")), "duration_ms": (S("p_size") * 100).cast("string"),
        "upload_date": F.when(k % 7 == 0, "20221231").when(k % 7 == 1, "soon"), "timestamp": F.when(k % 7 < 3, (S("p_size") * 86400).cast("string")), "id": F.lit("7"), "URL": F.lit("u"), "manifest_url": F.lit("m"),
    }
    r = p.filter("p_partkey % 4 <> 0").select(k.alias("entry_id"), F.create_map(*[v for name, c in fields.items() for v in (F.lit(name), c)]).alias("metadata"))
    return e, r


@query(f"""WITH {ENTRIES}, j AS (SELECT e.entry_id, CASE WHEN e.title = 'Unknown' AND coalesce(r.title, '') <> '' THEN r.title ELSE e.title END AS title, coalesce(e.duration, CASE WHEN r.duration IS NOT NULL THEN try_cast(r.duration AS DOUBLE) ELSE ms / 1000 END) AS duration,
  nullif(e.upload_date, '') AS d1, CASE WHEN regexp_full_match(r.upload_date, '\\d{{8}}') THEN r.upload_date[1:4] || '-' || r.upload_date[5:6] || '-' || r.upload_date[7:8] ELSE strftime(make_timestamp(timestamp * 1000000::BIGINT), '%Y-%m-%d') END AS d2,
  r.entry_id IS NULL AS hydration_failed FROM e LEFT JOIN r USING (entry_id)), d AS (SELECT *, regexp_extract(title, '(\\d{{4}})年(\\d{{1,2}})月(\\d{{1,2}})日', ['y', 'm', 'd']) AS t FROM j)
SELECT entry_id, title, duration, coalesce(d1, d2, CASE WHEN t.y <> '' THEN t.y || '-' || lpad(t.m, 2, '0') || '-' || lpad(t.d, 2, '0') ELSE '' END) AS upload_date, hydration_failed,
  CASE WHEN hydration_failed THEN 'id=' || entry_id || ',own' ELSE 'duration,duration_ms,id=7,own,timestamp,title,upload_date' END AS keys FROM d""")
def hydrate_metadata(spark, sf):
    h = catalog.hydrate(*_entries(spark, sf))
    shown = F.transform(F.array_sort(F.map_keys("metadata")), lambda k: F.when(k == "id", F.concat(F.lit("id="), F.element_at("metadata", "id"))).otherwise(k))
    return h.select("entry_id", "title", "duration", "upload_date", "hydration_failed", F.array_join(shown, ",").alias("keys"))


KEYS = [
    "id", "title", "author", "auth_token", "Cookie", "cookies", "cookie_header", "HTTP_Headers", "http", "password", "formats", "requested_formats", "url", "manifest_url", "Audio_URL", "video_url", "format", "format_id",
    "codec", "acodec", "abr", "tbr", "sample_rate", "channels", "Format", "uploader",
]
KEPT = "array_to_string(list_sort(list_filter(keys, lambda x: {}), 'ASC'), ',')"


@query(f"""WITH k AS (SELECT p_partkey, list_filter({listed(KEYS)}, lambda x, i: (p_partkey + i - 1) % 3 <> 0) AS keys FROM part)
SELECT p_partkey, {KEPT.format("lower(x) NOT IN ('cookie', 'cookies', 'cookie_header', 'http_headers', 'formats', 'requested_formats')")} AS kept,
  {KEPT.format("lower(x) NOT IN ('formats', 'requested_formats', 'url', 'manifest_url', 'audio_url', 'video_url')")} AS entry,
  {KEPT.format("x IN ('format', 'format_id', 'codec', 'acodec', 'abr', 'tbr', 'sample_rate', 'channels')")} AS cached FROM k""")
def redact_metadata(spark, sf):
    held = F.filter(F.array(*map(F.lit, KEYS)), lambda v, i: (S("p_partkey") + i) % 3 != 0)
    m = F.map_from_arrays(held, F.transform(held, lambda v: F.lit("1")))
    keys = lambda c: F.array_join(F.array_sort(F.map_keys(c)), ",")
    return x.table(spark, sf, "part").select("p_partkey", keys(catalog.redact(m)).alias("kept"), keys(catalog.entry_metadata(m)).alias("entry"), keys(catalog.cached_metadata(m)).alias("cached"))


GONE = ["[Private video]", " [Deleted video]", "[Deleted video]", "[private video]", None, "", "name"]


@query(f"""SELECT p_partkey, 'u' || p_partkey AS url FROM part WHERE {listed(GONE)}[1 + p_partkey % 7] NOT IN ('[Private video]', '[Deleted video]') AND p_partkey % 5 > 1 AND p_partkey % 11 <> 0""")
def available_video_filter(spark, sf):
    k = S("p_partkey")
    who = F.when(k % 5 == 0, "").when(k % 5 > 1, S("p_brand"))
    e = x.table(spark, sf, "part").select("p_partkey", pick(GONE, k).alias("title"), who.alias("uploader"), F.when(k % 11 != 0, F.concat(F.lit("u"), k.cast("string"))).alias("url"))
    return catalog.available(e).select("p_partkey", "url")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_partkey % 9 < 2 OR o_totalprice < 1 OR abs(o_totalprice / 1000 - l_quantity) <= greatest(5.0, o_totalprice / 1000 * 0.01e0)""")
def external_audio_match(spark, sf):
    j = x.table(spark, sf, "lineitem").join(x.table(spark, sf, "orders"), S("l_orderkey") == S("o_orderkey"))
    found = F.when(S("l_partkey") % 9 == 1, F.lit(0.0)).when(S("l_partkey") % 9 > 1, S("l_quantity"))
    return j.filter(catalog.duration_matches(S("o_totalprice") / 1000, found)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH s AS (SELECT c_custkey AS ordinal, 's' || c_custkey AS source_id, c_custkey % 10 <> 0 AS is_remote FROM customer), r AS (SELECT 's' || o_custkey AS source_id, min(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT ordinal, source_id, is_remote, NOT is_remote OR (k IS NOT NULL AND k % 5 <> 0) AS ok, CASE WHEN is_remote AND k IS NULL THEN 'no result' WHEN is_remote AND k % 5 = 0 THEN 'error ' || k END AS error FROM s LEFT JOIN r USING (source_id)""")
def resolve_with_failures(spark, sf):
    name = lambda c: F.concat(F.lit("s"), S(c).cast("string"))
    requests = x.table(spark, sf, "customer").select(S("c_custkey").alias("ordinal"), name("c_custkey").alias("source_id"), (S("c_custkey") % 10 != 0).alias("is_remote"))
    r = x.table(spark, sf, "orders").groupBy(name("o_custkey").alias("source_id")).agg(F.min("o_orderkey").alias("k"))
    bad = S("k") % 5 == 0
    results = r.select("source_id", F.when(~bad, S("k").cast("string")).alias("url"), F.when(bad, F.concat(F.lit("error "), S("k").cast("string"))).alias("error"))
    return match.resolve(requests, results)


@query("""WITH s AS (SELECT c_custkey % 50 AS k, c_custkey % 10 <> 0 AND c_custkey % 50 <> 7 AS is_remote, c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS o FROM customer),
r AS (SELECT k, is_remote, NOT is_remote OR (o IS NOT NULL AND o % 5 <> 0) AS ok FROM s)
SELECT k, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, bool_or(is_remote) AND NOT bool_or(is_remote AND ok) AND bool_and(is_remote) AS fatal FROM r GROUP BY k""")
def require_any(spark, sf):
    """Batches of requests: fatal where something remote was asked for, nothing remote came and nothing local is there."""
    name = lambda c: F.concat(F.lit("s"), S(c).cast("string"))
    k = S("c_custkey")
    requests = x.table(spark, sf, "customer").select((k % 50).alias("k"), k.alias("ordinal"), name("c_custkey").alias("source_id"), ((k % 10 != 0) & (k % 50 != 7)).alias("is_remote"))
    r = x.table(spark, sf, "orders").groupBy(name("o_custkey").alias("source_id")).agg(F.min("o_orderkey").alias("o"))
    bad = S("o") % 5 == 0
    results = r.select("source_id", F.when(~bad, S("o").cast("string")).alias("url"), F.when(bad, "error").alias("error"))
    done = match.resolve(requests, results).join(requests.select("ordinal", "k"), "ordinal")
    return match.require_any(done, ["k"])


PLAY = """pl AS (SELECT event_id AS entry_id, event_type AS list_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS idx FROM events)"""


@query(f"WITH {PLAY}, p AS (SELECT event_id AS entry_id, min(10000000 - event_id) AS pick_no FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT entry_id, event_type AS list_id, pick_no FROM p JOIN events ON event_id = entry_id")
def select_entries(spark, sf):
    e = x.table(spark, sf, "events").select(S("event_id").alias("entry_id"), S("event_type").alias("list_id"))
    return catalog.select_entries(e, e.filter("entry_id % 3 = 0").select("entry_id", (10_000_000 - S("entry_id")).alias("pick_no")))


@query("SELECT event_id AS index, user_id FROM events ORDER BY 1 LIMIT 1000")
def topk_cap(spark, sf):
    return catalog.top_entries(x.table(spark, sf, "events").select(S("event_id").alias("index"), "user_id"))


@query("WITH n AS (SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY 1) SELECT count(*) AS n_expanded, coalesce(sum(n), 0)::BIGINT AS n_parts FROM n WHERE n > 1")
def expansion_stats(spark, sf):
    return catalog.expansion_stats(x.table(spark, sf, "events").select(S("user_id").alias("list_id"), S("event_id").alias("part_id")))


@query("""WITH v AS (SELECT l_orderkey * 8 + l_linenumber AS o, (l_partkey % 3 + 1) * 640 AS w, (l_suppkey % 2 + 1) * 360 AS h FROM lineitem),
n AS (SELECT w, h, count(*) AS n, min(o) AS f FROM v GROUP BY 1, 2)
SELECT arg_min(w, (-n, f))::INT AS width, arg_min(h, (-n, f))::INT AS height, count(*) > 1 AS mixed, string_agg(printf('%05dx%05d', w, h), ',' ORDER BY w, h) AS sizes FROM n""")
def mode_resolution(spark, sf):
    v = x.table(spark, sf, "lineitem").select(
        (S("l_orderkey") * 8 + S("l_linenumber")).alias("ordinal"), ((S("l_partkey") % 3 + 1) * 640).cast("int").alias("width"), ((S("l_suppkey") % 2 + 1) * 360).cast("int").alias("height")
    )
    return catalog.mode_resolution(v)


@query("""WITH f AS (SELECT l_orderkey AS k, list(CASE WHEN l_partkey % 10 > 0 THEN l_partkey WHEN l_suppkey % 3 > 0 THEN l_suppkey * 2 END) AS parts, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT k, CASE WHEN k % 4 = 0 AND k > 0 THEN k * 1000 WHEN k % 4 = 1 THEN k * 10 WHEN (k % 8 < 4 OR n = 2) AND len(list_filter(parts, lambda x: x IS NULL)) = 0 THEN list_sum(parts)::BIGINT END AS size FROM f)
SELECT k, size, floor(size * 1.2e0 + 536870912)::BIGINT AS needed FROM s""")
def estimate_size(spark, sf):
    """A third of the orders name their parts as requested, the others as formats, which count if they are two."""
    exact, about = F.when(S("l_partkey") % 10 > 0, S("l_partkey")).otherwise(0), F.when(S("l_suppkey") % 3 > 0, S("l_suppkey") * 2)
    f = x.table(spark, sf, "lineitem").groupBy(S("l_orderkey").alias("k")).agg(F.collect_list(F.struct(exact.alias("filesize"), about.alias("filesize_approx"))).alias("parts"))
    none, asked = F.slice("parts", 1, 0), S("k") % 8 < 4
    size = catalog.estimate_size(F.when(S("k") % 4 == 0, S("k") * 1000), F.when(S("k") % 4 == 1, S("k") * 10), F.when(asked, S("parts")).otherwise(none), F.when(~asked, S("parts")).otherwise(none))
    return f.select("k", size.alias("size")).withColumn("needed", catalog.space_needed(S("size")))


FOLDERS = ["2024年#月", "2024年3月#日8点场", "Show 12", "show 9", "2024-01", "x#", "12 b", "2023年1月2日"]
FILES = [
    "2024年3月5日#点场.mp4", "2024年3月5日8点 part # Original.mp4", "2024年3月5日8点 Part #.mp4", "2023_07_1#_b_part2.mp4", "p#-title.mp4", "#_Title B.mp4", "video_p#.mp4", "Video part_#.mp4", "movie (#) .mp4", "clip #.mp4",
    "Clip.mp4", "2024-05 clip #", "clip # b.mp4", "123456789012345678901#.mp4",
]
NATURAL = r"""list_transform(regexp_extract_all(CASE WHEN regexp_matches({0}, '^\d') THEN chr(1) ELSE '' END || lower({0}), '\d+|\D+'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN {{'n': x::HUGEINT, 't': ''}} ELSE {{'n': 0::HUGEINT, 't': replace(x, chr(1), '')}} END)"""


@query(rf"""WITH f AS (SELECT p_partkey AS k, replace({listed(FOLDERS)}[1 + p_partkey // 3 % {len(FOLDERS)}], '#', (1 + p_partkey % 12)::VARCHAR) AS folder, replace({listed(FILES)}[1 + p_partkey % {len(FILES)}], '#', (p_partkey % 13)::VARCHAR) AS name FROM part),
g AS (SELECT k, lower(folder) AS folder, name, regexp_replace(name, '\.mp4$', '') AS bare, CASE WHEN regexp_matches(folder, '\d{{4}}年') THEN lower(folder) ELSE name END AS src FROM f),
h AS (SELECT *, regexp_extract(src, '(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日', ['y', 'm', 'd']) AS a, regexp_extract(src, '(\d{{4}})年(\d{{1,2}})月', ['y', 'm']) AS b, regexp_extract(src, '(\d{{4}})[-_](\d{{2}})[-_](\d{{2}})', ['y', 'm', 'd']) AS c,
  regexp_extract(src, '(\d{{4}})[-_](\d{{2}})', ['y', 'm']) AS d, regexp_extract(src, '(\d{{1,2}})点场?', 1) AS hour, regexp_extract(name, '(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日(\d{{1,2}})点场?', ['y', 'm', 'd', 'h']) AS e,
  regexp_extract(name, '(\d{{4}})[-_](\d{{2}})[-_](\d{{2}})', ['y', 'm', 'd']) AS i, regexp_extract(bare, '(?i)^p?(\d{{1,2}})[\s_\-]+(.+)$', ['n', 't']) AS p1, regexp_extract(bare, '(?i)^(.*?)[\s_\-]+p(?:art[\s_]*)?(\d+)$', ['t', 'n']) AS p2,
  regexp_extract(bare, '^(.*?)\s*\((\d+)\)\s*$', ['t', 'n']) AS p3, regexp_extract(name, '^p?(\d{{1,2}})[\s_\-]', 1) AS q1, regexp_extract(name, '(?i)part\s*(\d+)', 1) AS q2 FROM g),
o AS (SELECT *, CASE WHEN a.y <> '' THEN a.y || lpad(a.m, 2, '0') || lpad(a.d, 2, '0') WHEN b.y <> '' THEN b.y || lpad(b.m, 2, '0') WHEN c.y <> '' THEN c.y || c.m || c.d WHEN d.y <> '' THEN d.y || d.m END AS day,
  CASE WHEN e.y <> '' THEN e.y || lpad(e.m, 2, '0') || lpad(e.d, 2, '0') || '_' || lpad(e.h, 2, '0') WHEN i.y <> '' THEN i.y || i.m || i.d END AS stamp,
  CASE WHEN p1.n <> '' THEN lower(trim(p1.t)) WHEN p2.n <> '' THEN regexp_replace(lower(trim(p2.t)), '[\s_\-]+$', '') WHEN p3.n <> '' THEN regexp_replace(lower(trim(p3.t)), '[\s_\-]+$', '') END AS base,
  coalesce(nullif(p1.n, ''), nullif(p2.n, ''), nullif(p3.n, ''))::BIGINT AS num FROM h)
SELECT k, row_number() OVER (ORDER BY day IS NULL, coalesce(day, ''), CASE WHEN day IS NULL THEN '' WHEN hour = '' THEN chr(65535) ELSE lpad(hour, 2, '0') END, CASE WHEN day IS NULL THEN {NATURAL.format("folder")} ELSE [] END, CASE WHEN day IS NULL THEN folder ELSE '' END,
  CASE WHEN stamp IS NOT NULL THEN 0 WHEN base IS NOT NULL THEN 1 ELSE 2 END, coalesce(stamp, base, ''), CASE WHEN stamp IS NOT NULL THEN regexp_matches(name, '\bOriginal\b')::BIGINT WHEN base IS NOT NULL THEN num ELSE 0 END,
  CASE WHEN stamp IS NOT NULL THEN coalesce(nullif(q1, ''), nullif(q2, ''), '0')::BIGINT ELSE 0 END, CASE WHEN stamp IS NULL AND base IS NULL THEN {NATURAL.format("name")} ELSE [] END, k) AS place FROM o""")
def smart_sort(spark, sf):
    k = S("p_partkey")
    folder, name = F.replace(pick(FOLDERS, F.floor(k / 3)), F.lit("#"), (1 + k % 12).cast("string")), F.replace(pick(FILES, k), F.lit("#"), (k % 13).cast("string"))
    f = x.table(spark, sf, "part").select(k.alias("k"), F.concat_ws("/", F.lit("/m"), folder, name).alias("path"))
    return ordered.numbered(f, [catalog.smart_sort_key(S("path")), S("k")], hold=True).select("k", "place")


SHOWS = ["Show Part # end", "Show P#", "Show p 0#/12", "第 # 集 Show", "第 #/12 部分 Show", "Show Ep. #", "Show (#)", "SHOW - #", "straße PART #", "STRASSE", "", None, "part#", "Show #/12 end"]
TITLES = f"t AS (SELECT p_partkey AS k, p_brand, replace({listed(SHOWS)}[1 + p_partkey % {len(SHOWS)}], '#', (p_partkey % 40)::VARCHAR) AS title FROM part)"
PARTED = r"""p AS (SELECT *, coalesce(nullif(regexp_extract(title, '(?i)第\s*(\d+)\s*(部分|集)', 1), ''), nullif(regexp_extract(title, '(?i)\bp\s*0*(\d+)\b', 1), ''), nullif(regexp_extract(title, '(?i)\bpart\s+0*(\d+)\b', 1), ''),
  nullif(regexp_extract(title, '第\s*(\d+)\s*/\s*\d+\s*部分', 1), ''))::BIGINT AS part, replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(title, ''), 'Unknown'),
  '(?i)第\s*\d+\s*(部分|集)', '', 'g'), '(?i)\bp\s*0*\d+\b', '', 'g'), '(?i)\bpart\s+0*\d+\b', '', 'g'), '\b0*\d+\s*/\s*\d+\b', '', 'g'), '\s+', ' ', 'g'))), 'ß', 'ss') AS bare FROM t)"""


def _titles(spark, sf):
    k = S("p_partkey")
    return x.table(spark, sf, "part").select(k.alias("k"), "p_brand", F.replace(pick(SHOWS, k), F.lit("#"), (k % 40).cast("string")).alias("title"))


@query(rf"""WITH {TITLES}, {PARTED}, q AS (SELECT *, lower(coalesce(CASE WHEN k % 4 = 0 THEN upper(p_brand) ELSE '' END, '')) AS g, coalesce(CASE k % 5 WHEN 0 THEN k % 7 END, part) AS no, CASE WHEN k % 3 = 0 THEN '2024-01-02' ELSE '' END AS day FROM p),
r AS (SELECT *, CASE WHEN g = '' THEN CASE WHEN k % 2 = 0 THEN lower(p_brand) ELSE '' END ELSE g END AS grp FROM q) SELECT k AS index, row_number() OVER (ORDER BY grp, day, bare, no IS NULL, coalesce(no, k), k) AS place FROM r""")
def playlist_sort(spark, sf):
    k = S("k")
    t = _titles(spark, sf).select(
        k.alias("index"), "title", F.when(k % 4 == 0, F.upper("p_brand")).otherwise("").alias("group"), F.when(k % 2 == 0, S("p_brand")).alias("series"), F.when(k % 3 == 0, "2024-01-02").alias("upload_date"),
        F.when(k % 5 == 0, (k % 7).cast("string")).when(k % 5 == 1, "x").alias("part_number"),
    )
    return ordered.numbered(t, catalog.playlist_order(t), hold=True).select("index", "place")


DAYS = ["20240230", "99999999999999999999", "2024-02-30 later", " 2024/0102 ", "20240102T030405", "2024-1-2", "86400", "soon", "", None, "2024-05-06T07:08:09Z", "1704153600.5", "0"]


@query(rf"""WITH d AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {listed(DAYS)}[1 + event_id // 2 % {len(DAYS)}] WHEN event_id % 3 = 0 THEN epoch_ms(ts)::VARCHAR WHEN event_id % 3 = 1 THEN (epoch_ms(ts) // 1000)::VARCHAR ELSE strftime(ts, '%Y%m%d') END AS v FROM events),
n AS (SELECT event_id, trim(v) AS v, CASE WHEN regexp_full_match(trim(v), '\d+') AND length(trim(v)) <> 8 THEN try_cast(v AS DOUBLE) END AS n FROM d), s AS (SELECT *, floor(CASE WHEN n > 1e11 THEN n / 1000 ELSE n END) AS sec FROM n),
r AS (SELECT *, regexp_extract(v, '^(\d{{4}})[-/]?(\d{{2}})[-/]?(\d{{2}})', ['y', 'm', 'd']) AS t FROM s)
SELECT event_id, CASE WHEN n IS NOT NULL THEN coalesce(CASE WHEN sec <= 253402300799 THEN strftime(make_timestamp((sec * 1000000)::BIGINT), '%Y-%m-%d') END, '') WHEN t.y <> '' THEN t.y || '-' || t.m || '-' || t.d ELSE '' END AS day FROM r""")
def normalize_date(spark, sf):
    t, k = S("ts").cast("timestamp"), S("event_id")
    v = F.when(k % 2 == 0, pick(DAYS, F.floor(k / 2))).when(k % 3 == 0, F.unix_millis(t).cast("string")).when(k % 3 == 1, F.unix_seconds(t).cast("string")).otherwise(F.date_format(t, "yyyyMMdd"))
    return x.table(spark, sf, "events").select("event_id", media.first_date(F.lit(""), v).alias("day"))


LIVE = ["live", "2024年3月5日 rerun", "2024 年 3月5日", "2024年3月5号", "x2024年13月40日", "12024年1月2日2023年2月3日", None]


@query(rf"""WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {listed(LIVE)}[1 + event_id // 2 % {len(LIVE)}] ELSE 'live ' || year(ts) || '年' || month(ts) || '月' || day(ts) || '日' END AS title FROM events),
r AS (SELECT event_id, regexp_extract(title, '(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日', ['y', 'm', 'd']) AS t FROM t)
SELECT event_id, CASE WHEN t.y <> '' THEN t.y || '-' || lpad(t.m, 2, '0') || '-' || lpad(t.d, 2, '0') ELSE '' END AS day FROM r""")
def title_date(spark, sf):
    t, k = S("ts").cast("timestamp"), S("event_id")
    title = F.concat(F.lit("live "), F.year(t).cast("string"), F.lit("年"), F.month(t).cast("string"), F.lit("月"), F.day(t).cast("string"), F.lit("日"))
    return x.table(spark, sf, "events").select("event_id", F.coalesce(media.title_date(F.when(k % 2 == 0, pick(LIVE, F.floor(k / 2))).otherwise(title)), F.lit("")).alias("day"))


LENGTHS, MILLIS = ["n/a", "12.5", " 5 ", "", None, "1e3"], ["5000", "x", None]


@query(f"""WITH d AS (SELECT event_id, {listed(LENGTHS)}[1 + event_id % 6] AS d, {listed(MILLIS)}[1 + event_id // 6 % 3] AS ms FROM events)
SELECT event_id, CASE WHEN d IS NOT NULL THEN try_cast(d AS DOUBLE) ELSE try_cast(ms AS DOUBLE) / 1000 END AS seconds FROM d""")
def normalize_duration(spark, sf):
    k = S("event_id")
    return x.table(spark, sf, "events").select("event_id", media.normalize_duration(pick(LENGTHS, k), pick(MILLIS, F.floor(k / 6))).alias("seconds"))


@query(f"WITH {TITLES}, {PARTED} SELECT k, part FROM p")
def part_number(spark, sf):
    return _titles(spark, sf).select("k", media.part_number(S("title")).alias("part"))


@query(f"WITH {TITLES}, {PARTED} SELECT k, bare FROM p")
def title_without_part(spark, sf):
    return _titles(spark, sf).select("k", media.title_without_part(S("title")).alias("bare"))


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN least(p_size, 144) END::INT AS quality FROM part")
def parse_quality(spark, sf):
    k, n = S("p_partkey"), S("p_size").cast("string")
    q = F.when(k % 3 == 0, F.concat(n, F.lit("p"))).when(k % 3 == 1, F.concat(n, F.lit("x144"))).otherwise("No Limit")
    return x.table(spark, sf, "part").select(k.alias("k"), media.parse_quality(q).alias("quality"))


LOG = r"""l AS (SELECT p_partkey AS k, printf('Duration: %02d:%02d:%02d.%02d, start', p_size, p_partkey % 60, p_partkey % 59, p_partkey % 100)
  || CASE WHEN p_partkey % 3 > 0 THEN chr(10) || '  Stream #0:0: Video: h264, yuv420p, ' || (640 + p_size) || 'x' || (360 + p_size) || CASE WHEN p_partkey % 3 = 1 THEN ', 25 fps' ELSE ', ?' END ELSE '' END
  || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '  Stream #0:1: Audio: aac' ELSE '' END || chr(10) || 'speed=1.5x' AS log FROM part)"""


@query(rf"""WITH {LOG}, g AS (SELECT k, log, regexp_extract(log, 'Duration:\s*(\d+):(\d\d):(\d\d)\.(\d\d)', ['h', 'm', 's', 'c']) AS d, regexp_extract(log, 'Video:[^\n]*?\b(\d{{2,5}})x(\d{{2,5}})\b', ['w', 'h']) AS v FROM l)
SELECT k, d.h::DOUBLE * 3600 + d.m::DOUBLE * 60 + d.s::DOUBLE + d.c::DOUBLE / 100 AS duration, nullif(v.w, '')::INT AS width, nullif(v.h, '')::INT AS height, coalesce(nullif(regexp_extract(log, '(\d+(\.\d+)?) fps', 1), '')::DOUBLE, 30.0::DOUBLE) AS fps,
  nullif(regexp_extract(log, 'Audio:\s*(\w+)', 1), '') AS audio_codec, contains(log, 'Video:') AS has_video, contains(log, 'Audio:') AS has_audio, nullif(regexp_extract(log, 'speed=\s*(\d+(\.\d+)?)x', 1), '')::DOUBLE AS speed FROM g""")
def parse_probe_log(spark, sf):
    k, n = S("p_partkey"), S("p_size")
    head = F.format_string("Duration: %02d:%02d:%02d.%02d, start", n, k % 60, k % 59, k % 100)
    video = F.concat(F.lit("\n  Stream #0:0: Video: h264, yuv420p, "), (640 + n).cast("string"), F.lit("x"), (360 + n).cast("string"), F.when(k % 3 == 1, ", 25 fps").otherwise(", ?"))
    log = F.concat(head, F.when(k % 3 > 0, video).otherwise(""), F.when(k % 2 == 0, "\n  Stream #0:1: Audio: aac").otherwise(""), F.lit("\nspeed=1.5x"))
    return x.table(spark, sf, "part").select(k.alias("k"), log.alias("log")).select("k", *media.probe_log(S("log")))


LISTS = ["BilibiliPlaylist", "YoutubeTab", "Other"]


@query(f"""WITH r AS (SELECT l_orderkey AS list_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS index, l_partkey AS k, l_suppkey AS s FROM lineitem),
f AS (SELECT *, CASE list_id % 3 WHEN 0 THEN 'bilibiliplaylist' WHEN 1 THEN 'youtube' ELSE 'other' END AS platform, row_number() OVER w AS no, count(*) OVER (PARTITION BY list_id) AS n FROM r WHERE k % 7 <> 0 AND k % 5 < 3 WINDOW w AS (PARTITION BY list_id ORDER BY index))
SELECT list_id, platform, index::INT AS index, CASE WHEN k % 11 = 0 THEN 'https://v.example/' || k ELSE k::VARCHAR END AS entry_id, CASE WHEN k % 2 = 0 THEN ' t' || k ELSE 'Unknown' END AS title, 'https://v.example/' || k AS webpage_url,
  CASE WHEN s % 3 = 0 THEN s ELSE s / 1000 END::DOUBLE AS duration, CASE WHEN s % 4 = 0 THEN strftime(make_timestamp(s * 86400000000::BIGINT), '%Y-%m-%d') ELSE '' END AS upload_date,
  array_to_string(list_sort(list_filter(['duration_ms', CASE WHEN s % 3 = 0 THEN 'duration' END, CASE WHEN k % 11 <> 0 THEN 'id' END, CASE WHEN k % 2 = 0 THEN 'title' END, CASE WHEN k % 5 = 0 THEN 'webpage_url' WHEN k % 5 = 1 THEN 'original_url' END, CASE WHEN s % 4 = 0 THEN 'release_timestamp' END, 'upload_date'], lambda x: x IS NOT NULL)), ',') AS keys,
  CASE WHEN list_id % 3 = 0 AND n > 1 THEN no END::INT AS part_number, CASE WHEN list_id % 3 = 0 AND n > 1 THEN n END AS part_count FROM f""")
def read_playlist_json(spark, sf):
    """Line items as playlists, written as JSON and read back."""
    k, n = S("l_partkey"), S("l_suppkey")
    url = lambda m: F.when(k % 5 == m, F.concat(F.lit("https://v.example/"), k.cast("string")))
    e = F.struct(
        F.when(k % 11 != 0, k.cast("string")).alias("id"), F.when(k % 2 == 0, F.concat(F.lit(" t"), k.cast("string"))).alias("title"), url(0).alias("webpage_url"), url(1).alias("original_url"), url(2).alias("url"),
        F.when(n % 3 == 0, n).alias("duration"), n.alias("duration_ms"), F.lit("soon").alias("upload_date"), F.when(n % 4 == 0, n * 86400).alias("release_timestamp"),
    )
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(k % 7 != 0, e).alias("e"))
    lists = x.table(spark, sf, "lineitem").groupBy(S("l_orderkey").alias("list_id")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda v: v["e"]).alias("entries"))
    lists = lists.select("list_id", F.lit("https://x.example/").alias("url"), F.to_json(F.struct(pick(LISTS, S("list_id")).alias("extractor_key"), "entries")).alias("value"))
    out = playlist.playlist_entries(lists)
    return out.withColumn("metadata", F.array_join(F.array_sort(F.map_keys("metadata")), ",")).withColumnRenamed("metadata", "keys")


@query("""WITH n AS (SELECT o_custkey AS list_id, o_orderkey AS node_id, NULL::BIGINT AS parent_id, o_orderkey AS pos, NULL AS url FROM orders
UNION ALL SELECT o_custkey, 100000000 + l_orderkey * 100 + l_linenumber, l_orderkey, l_linenumber, 'u' || l_orderkey || '-' || l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)
SELECT c.list_id, row_number() OVER (PARTITION BY c.list_id ORDER BY p.pos, c.pos) AS place, c.url FROM n c JOIN n p ON p.node_id = c.parent_id AND p.list_id = c.list_id WHERE c.url IS NOT NULL""")
def flatten_nested_playlist(spark, sf):
    o, li = x.table(spark, sf, "orders"), x.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    lists = o.select(S("o_custkey").alias("list_id"), S("o_orderkey").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), S("o_orderkey").alias("pos"), F.lit(None).cast("string").alias("url"))
    leaf = F.concat(F.lit("u"), S("l_orderkey").cast("string"), F.lit("-"), S("l_linenumber").cast("string"))
    leaves = li.join(o, S("l_orderkey") == S("o_orderkey")).select(
        S("o_custkey").alias("list_id"), (100_000_000 + S("l_orderkey") * 100 + S("l_linenumber")).alias("node_id"), S("l_orderkey").alias("parent_id"), S("l_linenumber").cast("long").alias("pos"), leaf.alias("url")
    )
    return playlist.flatten_nested(lists.unionByName(leaves))
