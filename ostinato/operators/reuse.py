"""Reuse of results: keys, look-ups of cached rows, and the work that is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.functions.media import let
from ostinato.operators.ordered import running
from ostinato.session import written


def number(c: Column) -> Column:
    """A number as text of at most 12 significant digits, without trailing zeros; with an exponent below 1e-4 and from 1e12 on."""
    text = F.format_string("%.12g", c.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")


def exact(c: Column) -> Column:
    """A number as the shortest decimal that reads back as the same double; with an exponent below 1e-4 and from 1e16 on."""

    def spelled(x: Column) -> Column:
        power, digits, sign = x["power"], x["digits"], F.when(c < 0, "-").otherwise("")
        plain = F.replace(digits, F.lit("."), F.lit(""))
        far = F.abs(power).cast("string")
        tail = F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(far, F.greatest(F.lit(2), F.length(far)), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -1 - power), plain)
        large = F.concat(F.rpad(plain, power + 1, "0"), F.lit(".0"))
        inside = F.when(power < 0, small).when(F.length(plain) <= power + 1, large).otherwise(F.concat(F.substr(plain, F.lit(1), power + 1), F.lit("."), F.substr(plain, power + 2)))
        return F.when(power.isNull(), x["java"]).when((power < -4) | (power >= 16), F.concat(sign, digits, tail)).otherwise(F.concat(sign, inside))

    def read(java: Column) -> Column:
        digits = F.replace(F.regexp_replace(F.regexp_replace(java, "E.*$", ""), r"\.0$", ""), F.lit("-"), F.lit(""))
        return let(F.struct(java.alias("java"), F.regexp_extract(java, r"E(-?\d+)$", 1).try_cast("int").alias("power"), digits.alias("digits")), spelled)

    return let(c.cast("double").cast("string"), read)


def text(c: Column) -> Column:
    """As a JSON string in ASCII: quotes, backslashes and controls escaped, other characters as UTF-16 units."""
    units = lambda x: F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1")
    ascii_ = lambda j: F.array_join(F.transform(F.split(j, ""), lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), units(x)).otherwise(x)), "")
    json = F.regexp_extract(F.to_json(F.struct(F.coalesce(c.cast("string"), F.lit("")).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return let(json, lambda j: F.when(j.rlike(r"[^\x00-\x7f]"), ascii_(j)).otherwise(j))


def hashed(**fields: Column) -> Column:
    """SHA-256 of a JSON object with its keys in order; the fields are JSON already, nulls stay null."""
    items = [F.concat(F.lit(f'"{k}":'), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}")).cast("binary"), 256)


def detection_key(platform: Column, source_id: Column, model: Column, precision: Column, block_size: Column, threshold: Column, focus_idx: Column, flags: Column | None = None) -> Column:
    """The key of a source's detection: all that its result depends on. flags: a map of JSON values by name, null or empty if none."""
    pairs = F.transform(F.array_sort(F.map_keys(flags)), lambda k: F.concat(text(k), F.lit(":"), F.element_at(flags, k))) if flags is not None else None
    other = F.lit("{}") if pairs is None else F.concat(F.lit("{"), F.coalesce(F.array_join(pairs, ","), F.lit("")), F.lit("}"))
    return hashed(
        platform=text(F.lower(F.trim(platform))), source_id=text(F.trim(source_id)), model=text(model), precision=text(precision), block_size=block_size.cast("long").cast("string"),
        threshold=exact(threshold), focus_idx=focus_idx.cast("long").cast("string"), relevant_flags=other,
    )


def segment_key(source_key: Column, start_s: Column, end_s: Column, padding: Column, media_type: Column) -> Column:
    return hashed(source_identity=text(source_key), start=text(number(start_s)), end=text(number(end_s)), padding=text(number(padding)), media_type=text(F.lower(media_type)))


def reuse(requests: DataFrame, cached: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(rows to reuse, requests still to do)."""
    return cached.join(requests.select(key).distinct(), key, "left_semi"), requests.join(cached.select(key).distinct(), key, "left_anti")


#: Seconds of a source that are ordered together.
BUCKET_S = 6 * 3600.0


def covering_segment(requests: DataFrame, cached: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """requests (request_id, source_key, start_s, end_s, padding, media_type), cached (cached_id, source_key, start_s, end_s, media_type:
    null for video): the narrowest cached segment of the source and type that holds the request with its padding on both sides, then
    the earliest, then the least id. Requests without one are left out.

    Segments are numbered by their start, so those that begin in time for a request are the first c, which are as many blocks of 1, 2, 4
    ... segments as c has binary ones. In each block segments and requests are swept from the latest end on, with the narrowest segment
    so far. So a row is met once for each binary digit of its source's number of segments, and no pairs are made.
    """
    kind = lambda c: F.lower(F.coalesce(c, F.lit("video")))
    keys, width = ["source_key", "_kind"], (F.col("_e") - F.col("_s")).alias("w")
    c = cached.filter("end_s >= start_s").select("source_key", kind(F.col("media_type")).alias("_kind"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.lit(None).cast("long").alias("request_id"), "cached_id")
    c = c.withColumn("_own", F.struct(width, F.col("_s").alias("s"), F.col("cached_id").alias("id"))).drop("cached_id")
    pad, none = F.coalesce("padding", F.lit(0.0)), F.lit(None).cast(c.schema["_own"].dataType)
    r = requests.select("source_key", kind(F.col("media_type")).alias("_kind"), (F.col("start_s") - pad).alias("_s"), (F.col("end_s") + pad).alias("_e"), "request_id", none.alias("_own"))
    asks, one = F.col("_own").isNull(), F.col("_own").isNotNull().cast("long")
    rows = running(c.union(r), keys, F.floor(F.col("_s") / bucket_s), [F.col("_s"), asks], {"_n": (one, "sum", True)})
    rows = written(rows.filter(~asks | (F.col("_n") > 0)), "begun")
    total = rows.groupBy(*keys).agg(F.max("_n").alias("_total"))
    digits = F.transform(F.sequence(F.lit(0), F.length(F.bin("_total")) - 1), lambda k: k.cast("int"))
    high = lambda n, k: F.call_function("shiftright", n, k)
    # request: a block for each one in its number, the even one behind which the rest begins; segment: the even block of each size that it is in
    asked = F.filter(digits, lambda k: high(F.col("_n"), k) % 2 == 1)
    held = F.filter(digits, lambda k: high(F.col("_n") - 1, k) % 2 == 0)
    place = lambda k: F.struct(k.alias("size"), F.when(asks, high(F.col("_n"), k) - 1).otherwise(high(F.col("_n") - 1, k)).alias("no"))
    blocks = rows.join(total, keys).withColumn("_block", F.explode(F.transform(F.when(asks, asked).otherwise(held), place)))
    swept = running(blocks.select(*keys, "_block", "_e", "request_id", "_own"), [*keys, "_block"], F.floor(-F.col("_e") / bucket_s), [F.col("_e").desc(), asks], {"_best": (F.col("_own"), "min", True)})
    found = swept.filter(asks & F.col("_best").isNotNull()).groupBy("request_id", "source_key").agg(F.min("_best").alias("_b"))
    return found.select("request_id", "source_key", F.col("_b.id").alias("cached_id"))


def audio_lookup(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """requests (request_id, identity, format, exact_key), cached (path, identity, format, exact_key): an exact hit, else the first
    path of that source and format; `tier` 1, 2 or null."""
    one = cached.groupBy("exact_key").agg(F.min("path").alias("_p1"))
    two = cached.groupBy("identity", "format").agg(F.min("path").alias("_p2"))
    out = requests.join(one, "exact_key", "left").join(two, ["identity", "format"], "left")
    return out.select("request_id", F.coalesce("_p1", "_p2").alias("path"), F.when(F.col("_p1").isNotNull(), 1).when(F.col("_p2").isNotNull(), 2).alias("tier"))


def union_local_remote(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Both in one plan; their own `ordinal`, which counts over both, tells its order."""
    return local.withColumn("is_remote", F.lit(False)).unionByName(remote.withColumn("is_remote", F.lit(True)))
