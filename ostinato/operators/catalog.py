"""Catalogue: candidates of streams, playlists, sizes, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.functions import media
from ostinato.session import written


def first_seen(df: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The first row of each key, in order."""
    by = W.partitionBy(*keys).orderBy(ordinal)
    return df.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def distinct_candidates(candidates: DataFrame, kind: str) -> DataFrame:
    """Candidates whose format_id and url are both new in their source's order, then those of the kind.

    candidates: source_key, ordinal, format_id, url, acodec, vcodec. Those without a url are left out; a null or empty format_id is
    never seen before. Whether a row is new depends on the rows before it that were taken, of whatever kind: so rows that share a format
    or a url are rivals, and in each round every row that comes first among its live rivals is taken, and its rivals go. A round is
    linear in the rows still live; lists are done in a few, only rivals in a chain (each with the next alone) take one for each second row.
    """
    same = W.partitionBy("source_key", "ordinal").orderBy("format_id", "url", "acodec", "vcodec")
    c = candidates.filter("url <> ''").select("source_key", "ordinal", "format_id", "url", "acodec", "vcodec").withColumn("_tie", F.row_number().over(same))
    c = written(c, "candidates").withColumn("_at", F.struct("ordinal", "_tie"))
    # rounds carry what rivals are told by; the rest of a row is looked up at the end, for the kind alone
    live, taken = c.select("source_key", F.nullif("format_id", F.lit("")).alias("_format"), "url", "_at", _of_kind(kind).alias("_of_kind")), None
    while True:
        by_format = live.filter("_format is not null").groupBy("source_key", "_format").agg(F.min("_at").alias("_first_format"))
        by_url = live.groupBy("source_key", "url").agg(F.min("_at").alias("_first_url"))
        first = (F.col("_at") == F.col("_first_url")) & F.coalesce(F.col("_at") == F.col("_first_format"), F.lit(True))
        judged = written(live.join(by_url, ["source_key", "url"]).join(by_format, ["source_key", "_format"], "left").select(*live.columns, first.alias("_won")), "judged")
        won, lost = judged.filter("_won"), judged.filter("not _won").drop("_won")
        own = won.filter("_of_kind").select("source_key", "_at")
        taken = own if taken is None else taken.union(own)
        if lost.isEmpty():
            break
        live = lost.join(won.select("source_key", "url"), ["source_key", "url"], "left_anti").join(won.select("source_key", "_format"), ["source_key", "_format"], "left_anti")
        live = written(live.select(*lost.columns), "live")
        if live.isEmpty():
            break
    return stream_kind(c, kind).join(taken, ["source_key", "_at"], "left_semi").drop("_at", "_tie")


def has_codec(c: Column) -> Column:
    """Only null and 'none', in lower case, say that there is none."""
    return F.coalesce(c != "none", F.lit(False))


def _of_kind(kind: str) -> Column:
    audio, video = has_codec(F.col("acodec")), has_codec(F.col("vcodec"))
    return audio & ~video if kind == "audio" else video


def stream_kind(candidates: DataFrame, kind: str) -> DataFrame:
    return candidates.filter(_of_kind(kind))


def rank(candidates: DataFrame, kind: str) -> DataFrame:
    """`rank` from 1 within a source, best first. Unknown and negative numbers count as 0."""
    z = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    audio = [F.greatest(z("abr"), z("tbr")), F.col("requested"), z("abr") + z("tbr"), F.col("format_id")]
    video = [F.col("requested"), z("height"), z("tbr"), F.col("format_id")]
    by = W.partitionBy("source_key").orderBy(*[k.desc() for k in (audio if kind == "audio" else video)])
    return candidates.withColumn("rank", F.row_number().over(by))


def quality_cap(ranked: DataFrame, limit: float) -> DataFrame:
    """For each source the candidate of the highest height within (0, limit]; else the lowest positive; else the first."""
    h, within = F.coalesce("height", F.lit(0.0)), F.coalesce("height", F.lit(0.0)).between(1e-9, limit)
    key = F.struct(F.when(within, 0).when(h > 0, 1).otherwise(2), F.when(within, -h).when(h > 0, h).otherwise(F.lit(0.0)), F.col("rank"))
    best = ranked.groupBy("source_key").agg(F.min_by(F.struct("format_id", "height", "rank"), key).alias("_b"))
    return best.select("source_key", "_b.format_id", "_b.height", "_b.rank")


def probe_select(ranked: DataFrame, least: float = 1.0) -> DataFrame:
    """The first group (variants of a format, by its best rank) whose fastest measured speed is enough, with that variant; else rank 1.

    ranked: source_key, group_id, variant, rank, speed (null: no answer).
    """
    fastest = F.max_by(F.struct("variant", "speed"), F.struct(F.coalesce("speed", F.lit(-1.0)), -F.col("rank")))
    groups = ranked.groupBy("source_key", "group_id").agg(F.min("rank").alias("_rank"), fastest.alias("_f"))
    good = F.coalesce(F.col("_f.speed") >= least, F.lit(False))
    pick = groups.groupBy("source_key").agg(F.min_by(F.struct("group_id", F.col("_f.variant").alias("variant"), "_f.speed"), F.when(good, F.col("_rank"))).alias("_g"))
    first = ranked.groupBy("source_key").agg(F.min_by(F.struct("group_id", "variant", "speed"), "rank").alias("_d"))
    out = first.join(pick, "source_key")
    return out.select("source_key", F.coalesce("_g", "_d").alias("_p"), F.col("_g").isNotNull().alias("fast_enough")).select("source_key", "_p.group_id", "_p.variant", "_p.speed", "fast_enough")


def hydrate(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Fill what a look-up knows: title only if 'Unknown', duration only if null, date only if blank (then the title's).

    entries: entry_id, title, duration, upload_date, metadata. results: entry_id and metadata, a map that holds all that was found:
    duration (else duration_ms), the date by the first of its fields that reads as one. Addresses of media don't enter metadata.
    """
    r = results.select("entry_id", F.col("metadata").alias("_found"), F.lit(True).alias("_hit"))
    e = entries.join(r, "entry_id", "left")
    found = lambda k: F.element_at("_found", k)
    title = F.when((F.col("title") == "Unknown") & (F.coalesce(found("title"), F.lit("")) != ""), found("title")).otherwise(F.col("title"))
    date = F.coalesce(F.nullif(F.col("upload_date"), F.lit("")), F.nullif(media.entry_date(found), F.lit("")), media.title_date(title))
    none = F.create_map().cast("map<string,string>")
    more = entry_metadata(F.coalesce("_found", none))
    own = F.map_filter(F.coalesce("metadata", none), lambda k, v: ~F.coalesce(F.map_contains_key(more, k), F.lit(False)))
    return e.select(
        "entry_id", title.alias("title"), F.coalesce("duration", media.normalize_duration(found("duration"), found("duration_ms"))).alias("duration"), date.alias("upload_date"),
        F.map_concat(own, more).alias("metadata"), F.col("_hit").isNull().alias("hydration_failed"),
    )


#: Keys, in lower case, that a source's metadata never hold; those that an entry's never hold; all that a cache keeps.
SECRET = ("cookie", "cookies", "cookie_header", "http_headers", "formats", "requested_formats")
ADDRESSES = ("formats", "requested_formats", "url", "manifest_url", "audio_url", "video_url")
CACHED = ("format", "format_id", "codec", "acodec", "abr", "tbr", "sample_rate", "channels")


def redact(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, v: ~F.lower(k).isin(*SECRET))


def entry_metadata(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, v: ~F.lower(k).isin(*ADDRESSES))


def cached_metadata(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, v: k.isin(*CACHED))


def available(entries: DataFrame) -> DataFrame:
    """Entries with a title, which isn't one that stands for a video that is gone, an uploader and an address."""
    known = (F.coalesce("uploader", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    return entries.filter(F.col("title").isNotNull() & ~F.col("title").isin("[Private video]", "[Deleted video]") & known)


def duration_matches(a: Column, b: Column) -> Column:
    """Unknown lengths (null or 0) match anything; known ones within 5 seconds or a hundredth of the source's."""
    unknown = lambda c: F.coalesce(c, F.lit(0)) == 0
    return unknown(a) | unknown(b) | (F.abs(a - b) <= F.greatest(F.lit(5.0), a * 0.01))


def estimate_size(filesize: Column, approx: Column, requested: Column, formats: Column) -> Column:
    """Bytes: exact, else about, else the sum over the requested formats, or where there are none over `formats` if they are two, each
    of them known exactly or about. requested and formats: arrays of (filesize, filesize_approx). Only sizes above 0 are known."""
    known = lambda exact, about: F.coalesce(F.when(exact > 0, exact), F.when(about > 0, about))
    parts = F.transform(F.when(F.size(requested) > 0, requested).when(F.size(formats) == 2, formats), lambda x: known(x["filesize"], x["filesize_approx"]))
    total = F.when(F.forall(parts, lambda x: x.isNotNull()), F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.coalesce(known(filesize, approx), total)


def space_needed(size: Column, overhead: float = 1.2, reserve: int = 512 << 20) -> Column:
    return F.floor(size * F.lit(overhead) + F.lit(reserve)).cast("long")


def mode_resolution(videos: DataFrame) -> DataFrame:
    """videos (ordinal, width, height) -> one row: the most frequent size, the first seen of equals; mixed; all sizes, sorted."""
    n = videos.groupBy("width", "height").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    top = F.min_by(F.struct("width", "height"), F.struct(-F.col("n"), F.col("first")))
    out = n.agg(top.alias("_t"), (F.count(F.lit(1)) > 1).alias("mixed"), F.sort_array(F.collect_list(F.format_string("%05dx%05d", "width", "height"))).alias("sizes"))
    return out.select("_t.width", "_t.height", "mixed", F.array_join("sizes", ",").alias("sizes"))


def _matched(text: Column, pattern: str, *groups: int) -> Column:
    """The groups of the first match, numbers of one digit filled up to two, one after another; null without a match."""
    two = lambda g: F.when(F.length(g) == 1, F.lpad(g, 2, "0")).otherwise(g)
    return F.when(text.rlike(pattern), F.concat(*[media.let(F.regexp_extract(text, pattern, i), two) for i in groups]))


#: Dates in names.
DAY, MONTH, HOUR = r"(?U)(\d{4})年(\d{1,2})月(\d{1,2})日", r"(?U)(\d{4})年(\d{1,2})月", r"(?U)(\d{1,2})点场?"
ISO_DAY, ISO_MONTH = r"(?U)(\d{4})[-_](\d{2})[-_](\d{2})", r"(?U)(\d{4})[-_](\d{2})"
#: A part's number before a title, and behind it.
BEFORE = r"(?iU)^p?(\d{1,2})[\s_\-]+(.+)$"
BEHIND = (r"(?iU)^(.*?)[\s_\-]+p(?:art[\s_]*)?(\d+)$", r"(?U)^(.*?)\s*\((\d+)\)\s*$")


def smart_sort_key(path: Column) -> Column:
    """Orders files by folder, then within it.

    Folders: by the date, and the hour, in the folder's name if it tells a Chinese year, else in the file's; without a date, behind
    those, naturally by name. Files: by date and hour, originals last, and part; then by title and part; then naturally by name.
    """
    none = F.slice(media.natural_key(F.lit("")), 1, 0)
    number = lambda c, p, i: F.when(c.rlike(p), F.regexp_extract(c, p, i).try_cast("long"))

    def names(x: Column) -> Column:
        bare = F.regexp_replace(x["name"], r"^(\.*[^.].*)\.[^.]*$", "$1")
        return media.let(F.struct(x["name"], x["folder"], bare.alias("bare"), F.when(x["folder"].rlike(r"(?U)\d{4}年"), x["folder"]).otherwise(x["name"]).alias("dated")), read)

    def read(x: Column) -> Column:
        name, bare, dated = x["name"], x["bare"], x["dated"]
        date = F.coalesce(_matched(dated, DAY, 1, 2, 3), _matched(dated, MONTH, 1, 2), _matched(dated, ISO_DAY, 1, 2, 3), _matched(dated, ISO_MONTH, 1, 2))
        at = F.coalesce(F.concat(_matched(name, DAY + HOUR[4:], 1, 2, 3), F.lit("_"), _matched(name, DAY + HOUR[4:], 4)), _matched(name, ISO_DAY, 1, 2, 3))
        part = F.coalesce(number(name, r"(?U)^p?(\d{1,2})[\s_\-]", 1), number(name, r"(?iU)part\s*(\d+)", 1), F.lit(0).cast("long"))
        title = lambda p, i: F.when(bare.rlike(p), F.lower(F.trim(F.regexp_extract(bare, p, i))))
        text = F.coalesce(title(BEFORE, 2), *[F.regexp_replace(title(p, 1), r"(?U)[\s_\-]+$", "") for p in BEHIND])
        return media.let(F.struct(
            name, x["folder"], date.alias("date"), F.coalesce(_matched(dated, HOUR, 1), F.lit("\uffff")).alias("hour"), at.alias("at"), text.alias("text"),
            F.coalesce(number(bare, BEFORE, 1), *[number(bare, p, 2) for p in BEHIND]).alias("of"), name.rlike(r"(?U)\bOriginal\b").cast("long").alias("original"), part.alias("part"),
        ), key)

    def key(x: Column) -> Column:
        undated, timed, titled, zero = x["date"].isNull(), x["at"].isNotNull(), x["text"].isNotNull(), F.lit(0).cast("long")
        group = F.struct(
            undated.alias("undated"), F.coalesce(x["date"], F.lit("")).alias("date"), F.when(undated, "").otherwise(x["hour"]).alias("hour"),
            F.when(undated, media.natural_key(x["folder"])).otherwise(none).alias("natural"), F.when(undated, x["folder"]).otherwise("").alias("folder"),
        )
        own = F.struct(
            F.when(timed, 0).when(titled, 1).otherwise(2).alias("kind"), F.coalesce(x["at"], x["text"], F.lit("")).alias("text"),
            F.when(timed, x["original"]).when(titled, x["of"]).otherwise(zero).alias("a"), F.when(timed, x["part"]).otherwise(zero).alias("b"),
            F.when(timed | titled, none).otherwise(media.natural_key(x["name"])).alias("natural"),
        )
        return F.struct(group.alias("group"), own.alias("own"))

    both = F.struct(F.regexp_extract(path, r"[^/]*$", 0).alias("name"), F.lower(F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)).alias("folder"))
    return media.let(both, names)


def playlist_order(entries: DataFrame) -> list[Column]:
    """Columns to order a playlist by: group or series, date, title without its part, part unknown, part or place, place.

    entries: group, series, upload_date, title, part_number (as text, or null), index.
    """
    part = media.part_number(F.col("title"), F.col("part_number"))
    group = F.coalesce(F.nullif(F.col("group"), F.lit("")), F.col("series"), F.lit(""))
    return [
        media.folded(group), F.coalesce("upload_date", F.lit("")), media.title_without_part(F.col("title")), part.isNull(),
        F.coalesce(part, F.col("index").cast("long")), F.col("index"),
    ]


def top_entries(entries: DataFrame, cap: int = 1000) -> DataFrame:
    return entries.orderBy("index").limit(cap)


def select_entries(entries: DataFrame, picks: DataFrame) -> DataFrame:
    """picks (entry_id, pick_no): the chosen ones in the order of choice, each once."""
    p = picks.groupBy("entry_id").agg(F.min("pick_no").alias("pick_no"))
    return entries.join(p, "entry_id")


def expansion_stats(entries: DataFrame) -> DataFrame:
    """Rows (list_id, part_id) -> lists that gave more than themselves, distinct parts in them."""
    per = entries.groupBy("list_id").agg(F.count_distinct("part_id").alias("n"))
    return per.filter("n > 1").agg(F.count(F.lit(1)).alias("n_expanded"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_parts"))
