"""Saved entries against the media at hand; resolved items against requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def normal_path(path: Column) -> Column:
    """Without empty and . parts, a .. taken together with the part before it, as far as there is one."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    rooted, last = path.startswith("/"), lambda a: F.try_element_at(a, F.lit(-1))
    climbs = lambda a: F.coalesce(last(a) != "..", F.lit(False))
    step = lambda a, x: F.when((x == "..") & climbs(a), F.slice(a, 1, F.size(a) - 1)).when((x == "..") & rooted, a).otherwise(F.concat(a, F.array(x)))
    out = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(parts, F.slice(parts, 1, 0), step), "/"))
    return F.when(out == "", ".").otherwise(out)


def match_saved(saved: DataFrame, media: DataFrame) -> DataFrame:
    """saved (entry_id, name), media (ordinal, path, url or null) -> (entry_id, media_ordinal, how). Case counts.

    how: url (the name is a remote medium's address; of several the last), name (one local file of that name), path (several, the first
    of those at that path), ambiguous (several, the first is taken), unmatched. Remote media have no file name.
    """
    s = saved.select("entry_id", "name", base_name(F.col("name")).alias("_base"), normal_path(F.col("name")).alias("_norm"))
    remote = media.filter("url is not null").groupBy("url").agg(F.max("ordinal").alias("_u"))
    by_url = s.join(remote, s["name"] == F.col("url")).select("entry_id", "_u")
    rest = s.join(by_url.select("entry_id"), "entry_id", "left_anti")
    local = media.filter("url is null")
    # one row for each file name and for each path, so that a name that many files share makes no pairs
    names = local.groupBy(base_name(F.col("path")).alias("_base")).agg(F.count(F.lit(1)).alias("_n"), F.min("ordinal").alias("_first"))
    paths = local.groupBy(base_name(F.col("path")).alias("_base"), normal_path(F.col("path")).alias("_norm")).agg(F.min("ordinal").alias("_same"))
    best = rest.join(names, "_base").join(paths, ["_base", "_norm"], "left").select("entry_id", "_n", "_first", "_same")
    how = F.when(F.col("_u").isNotNull(), "url").when(F.col("_n").isNull(), "unmatched").when(F.col("_n") == 1, "name").when(F.col("_same").isNotNull(), "path").otherwise("ambiguous")
    found = F.coalesce("_u", F.when(F.col("_n") > 1, F.col("_same")), "_first")
    return s.join(by_url, "entry_id", "left").join(best, "entry_id", "left").select("entry_id", found.alias("media_ordinal"), how.alias("how"))


def resolve(requests: DataFrame, results: DataFrame) -> DataFrame:
    """requests (ordinal, source_id, is_remote), results (source_id, url, error) -> ok, error. A request without a result fails."""
    r = results.select("source_id", "url", F.col("error").alias("_e"))
    out = requests.join(r, "source_id", "left")
    ok = ~F.col("is_remote") | (F.col("url").isNotNull() & F.col("_e").isNull())
    return out.select("ordinal", "source_id", "is_remote", ok.alias("ok"), F.when(~ok, F.coalesce("_e", F.lit("no result"))).alias("error"))


def require_any(resolved: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row, or one for each of the keys: n_ok, n_failed, fatal (something remote was asked for, nothing remote came, nothing local
    is there)."""
    ok, remote = F.col("ok"), F.col("is_remote")
    counts = resolved.groupBy(*(keys or [])).agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.count_if(remote & ok).alias("_r"), F.count_if(remote).alias("_all"), F.count_if(~remote).alias("_l")
    )
    return counts.select(*(keys or []), "n_ok", "n_failed", ((F.col("_all") > 0) & (F.col("_r") == 0) & (F.col("_l") == 0)).alias("fatal"))


def matched_summary(matches: DataFrame) -> DataFrame:
    """match_saved's rows -> one row: n_saved, n_loaded, failed (there were saved entries, and none met a medium)."""
    n = matches.agg(F.count(F.lit(1)).alias("n_saved"), F.count_if(F.col("how") != "unmatched").alias("n_loaded"))
    return n.select("n_saved", "n_loaded", ((F.col("n_saved") > 0) & (F.col("n_loaded") == 0)).alias("failed"))
