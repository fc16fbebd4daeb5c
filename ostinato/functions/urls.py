"""Source identities and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Parts of an address by pattern: real ones are often not well-formed, and a strict parser gives null for the whole.
PATTERNS = {"PROTOCOL": r"^([A-Za-z][A-Za-z0-9+.-]*)://", "HOST": r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", "PATH": r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"}


def url_part(url: Column, part: str, key: str | None = None) -> Column:
    """A part of an address, or the value of a query's key; '' where it has none."""
    return F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*&)?{key}=([^&#]*)" if key else PATTERNS[part], 1)


def stable_source_id(platform: Column, source_id: Column, url: Column) -> Column:
    """platform:id, or without an id platform:scheme://host/path; platform, scheme and host in lower case. No platform: `unknown`."""
    url, own = F.trim(url), F.nullif(F.trim(source_id), F.lit(""))
    place = F.concat(F.lower(url_part(url, "PROTOCOL")), F.lit("://"), F.lower(url_part(url, "HOST")), F.coalesce(url_part(url, "PATH"), F.lit("")))
    return F.concat(F.lower(F.trim(F.coalesce(F.nullif(platform, F.lit("")), F.lit("unknown")))), F.lit(":"), F.coalesce(own, place, F.lit("")))


def is_url(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?i)^\s*https?://"), F.lit(False))


def query_value(url: Column, key: str) -> Column:
    """The first value of a query's key that isn't blank, decoded; '' where it has none."""
    raw = F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*?&)??{key}=([^&#]+)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def host_name(url: Column) -> Column:
    """In lower case, without user and port."""
    return F.lower(F.regexp_extract(url_part(url, "HOST"), r"([^@:]*)(?::\d*)?$", 1))


#: Hosts of one platform's pages, domains of another's.
WATCH_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com")
BILI_HOST, TWITCH_HOST = r"(^|\.)(bilibili\.com|b23\.tv)$", r"(^|\.)twitch\.tv$"


def canonical_playlist_url(url: Column) -> Column:
    """A watch page that names a list becomes the list's page on the same host; other addresses stay."""
    key = query_value(url, "list")
    watch = F.lower(url_part(url, "HOST")).isin(*WATCH_HOSTS) & (url_part(url, "PATH") == "/watch") & (key != "")
    page = F.concat(F.lower(url_part(url, "PROTOCOL")), F.lit("://"), url_part(url, "HOST"), F.lit("/playlist?list="), key)
    return F.when(F.coalesce(watch, F.lit(False)), page).otherwise(url)


#: extractors' names that stand for one platform.
ALIASES = {"youtubetab": "youtube", "youtubeplaylist": "youtube"}


def forced_platform(url: Column) -> Column:
    """The kind of list that an address alone tells, by its host, path and query; else null. First match counts."""
    host, path = host_name(url), F.regexp_replace(url_part(url, "PATH"), "/+$", "")
    bili, tube = host.rlike(BILI_HOST), host.isin(*WATCH_HOSTS)
    return (
        F.when(bili & path.rlike("^/[^/]+/lists/[^/]+$") & (query_value(url, "type") == "series"), "bilibili-series")
        .when(bili & path.rlike("^/list/[^/]+$") & (query_value(url, "sid") != ""), "bilibili-collection")
        .when(bili & (path.rlike("^/[^/]+/upload/video$") | (path.rlike("^/[^/]+$") & host.startswith("space."))), "bilibili-uploads")
        .when(host.rlike(TWITCH_HOST) & path.rlike("^/[^/]+/videos$"), "twitch-vods")
        .when(tube & (path == "/playlist") & (query_value(url, "list") != ""), "youtube")
        .when(tube & path.rlike("^/(@[^/]+|(channel|user|c)/[^/]+)/(videos|streams|shorts)$"), "youtube-uploads")
    )


def classify_platform(url: Column, extractor: Column) -> Column:
    """The platform that the address tells, else the extractor's name in lower case with aliases folded, else `unknown`."""
    name = F.lower(F.coalesce(F.nullif(extractor, F.lit("")), F.lit("unknown")))
    for alias, platform in ALIASES.items():
        name = F.when(name == alias, platform).otherwise(name)
    return F.coalesce(forced_platform(url), name)


def cdn_variants(url: Column, hosts: list[str]) -> Column:
    """The address and the same on each known host, distinct, the original first."""
    return F.array_distinct(F.array(url, *[F.regexp_replace(url, r"^(https?://)[^/]+", "$1" + h) for h in hosts]))
