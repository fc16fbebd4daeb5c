"""Dates, durations, titles, qualities and probe logs of media."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIDEO, AUDIO = ("mp4", "avi", "mkv", "m4v", "mov"), ("mp3", "wav", "flac")
#: What dropping files accepts besides.
MORE_VIDEO, MORE_AUDIO = ("webm", "flv", "ts"), ("ogg", "m4a", "aac")


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def media_type(path: Column, wide: bool = True) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    video, audio = (VIDEO + MORE_VIDEO, AUDIO + MORE_AUDIO) if wide else (VIDEO, AUDIO)
    return F.when(ext.isin(*video), "video").when(ext.isin(*audio), "audio")


#: The last second of the year 9999.
LAST_SECOND = 253_402_300_799


def normalize_date(value: Column, stamp: bool = False) -> Column:
    """An ISO day, or ''. Eight digits are a day, other whole numbers epoch seconds or (above 1e11) milliseconds; else the day that
    the text begins with, with -, / or nothing between its parts. Days aren't checked against the calendar. stamp: the value is known
    to be a time, so eight digits are a day only if their month and day can be ones."""
    v = F.trim(F.coalesce(value, F.lit("")))
    of_day = v.rlike(r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$") if stamp else F.length(v) == 8
    number = F.when(v.rlike(r"^\d+$") & ~of_day, v.try_cast("double"))
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    epoch = F.date_format(F.timestamp_seconds(F.when(seconds <= LAST_SECOND, F.floor(seconds))), "yyyy-MM-dd")
    lead = r"^(\d{4})[-/]?(\d{2})[-/]?(\d{2})"
    day = F.when(v.rlike(lead), F.concat_ws("-", *[F.regexp_extract(v, lead, i) for i in (1, 2, 3)]))
    return F.coalesce(F.when(number.isNotNull(), epoch).otherwise(day), F.lit(""))


#: The fields that may hold a date, the best first.
DATES = ("upload_date", "release_date", "timestamp", "release_timestamp", "created_at", "pubdate")
#: Those of them that hold epoch seconds.
STAMPS = ("timestamp", "release_timestamp")


def entry_date(field) -> Column:
    """The first of an entry's dates that reads as one; field: a name -> its value."""
    return F.coalesce(*[F.nullif(normalize_date(field(k), k in STAMPS), F.lit("")) for k in DATES], F.lit(""))


def first_date(*values: Column) -> Column:
    """The first of several fields that reads as a date."""
    return F.coalesce(*[F.nullif(normalize_date(v), F.lit("")) for v in values], F.lit(""))


def title_date(title: Column) -> Column:
    """The Chinese date in a title, unchecked, as an ISO day; else ''."""
    g = lambda i: F.regexp_extract(title, r"(\d{4})年(\d{1,2})月(\d{1,2})日", i)
    return F.when(g(1) != "", F.concat_ws("-", g(1), F.lpad(g(2), 2, "0"), F.lpad(g(3), 2, "0"))).otherwise("")


def normalize_duration(duration: Column, duration_ms: Column) -> Column:
    """Seconds: the duration if there is one, which may be no number (null), else the milliseconds."""
    return F.when(duration.isNotNull(), duration.try_cast("double")).otherwise(duration_ms.try_cast("double") / 1000)


#: Ways to write a part's number in a title, in the order in which they are tried.
PARTS = [
    r"(?iU)第\s*(\d+)\s*(?:部分|集)",
    r"(?iU)\bP\s*0*(\d+)\b",
    r"(?iU)\bPart\s+0*(\d+)\b",
    r"(?iU)\bP\s*0*(\d+)\s*/\s*\d+\b",
    r"(?iU)\bPart\s+0*(\d+)\s*/\s*\d+\b",
    r"(?iU)第\s*(\d+)\s*/\s*\d+\s*部分",
]
#: What a title loses, in this order, before titles are compared.
WITHOUT = [r"(?iU)第\s*\d+\s*(?:部分|集)", r"(?iU)\bP\s*0*\d+\b", r"(?iU)\bPart\s+0*\d+\b", r"(?U)\b0*\d+\s*/\s*\d+\b"]


def part_number(title: Column, known: Column | None = None) -> Column:
    """A part's number as known, else as the title gives it, else null."""
    found = [F.nullif(F.regexp_extract(title, p, 1), F.lit("")).try_cast("long") for p in PARTS]
    return F.coalesce(*([known.try_cast("long")] if known is not None else []), *found)


def folded(text: Column) -> Column:
    """Text for comparisons whatever its case, sharp and final s included."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ς", "σ")


def title_without_part(title: Column) -> Column:
    title = F.coalesce(F.nullif(title, F.lit("")), F.lit("Unknown"))
    for p in WITHOUT:
        title = F.regexp_replace(title, p, "")
    return folded(F.trim(F.regexp_replace(title, r"(?U)\s+", " ")))


def parse_quality(text: Column) -> Column:
    """The number in a quality's name, or the lesser of two; else null."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.when(F.size(n).isin(1, 2), F.array_min(n))


def probe_log(text: Column) -> list[Column]:
    """Columns read from a media probe's output; frames a second are 30 where none are given."""
    g = lambda p, i=1: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    d = r"Duration:\s*(\d+):(\d{2}):(\d{2})\.(\d{2})"
    seconds = g(d, 1).cast("double") * 3600 + g(d, 2).cast("double") * 60 + g(d, 3).cast("double") + g(d, 4).cast("double") / 100
    video = r"Stream #[^\n]*Video:[^\n]*?\b(\d{2,5})x(\d{2,5})\b"
    return [
        seconds.alias("duration"), g(video, 1).cast("int").alias("width"), g(video, 2).cast("int").alias("height"),
        F.coalesce(g(r"(\d+(?:\.\d+)?) fps").cast("double"), F.lit(30.0)).alias("fps"), g(r"Audio:\s*(\w+)").alias("audio_codec"),
        text.contains("Video:").alias("has_video"), text.contains("Audio:").alias("has_audio"), g(r"speed=\s*(\d+(?:\.\d+)?)x").cast("double").alias("speed"),
    ]


def natural_key(text: Column) -> Column:
    """Runs of digits and of other characters by turns, the latter first and perhaps empty, as an array of (digits, number, text):
    sorts as numbers count, whatever their length, and without regard to case."""
    runs = F.regexp_extract_all(F.concat(F.when(text.rlike(r"^\d"), "\0").otherwise(""), F.lower(text)), F.lit(r"\d+|\D+"), F.lit(0))

    def item(x: Column) -> Column:
        number = F.when(x.rlike(r"^\d"), F.regexp_replace(x, "^0+(?=.)", ""))
        text = F.replace(x, F.lit("\0"), F.lit(""))
        return let(number, lambda n: F.struct(F.coalesce(F.length(n), F.lit(0)).alias("digits"), F.coalesce(n, F.lit("")).alias("number"), F.when(n.isNull(), text).otherwise("").alias("text")))

    return F.transform(runs, item)
