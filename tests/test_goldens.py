"""Boundary rules, derived by hand."""

import pytest
from pyspark.sql import functions as F

from ostinato.functions import media, timefmt, urls
from ostinato.operators import catalog, detect, intervals, match, ordered, rescan, reuse, signal, transfer
from ostinato.params import Detection, Planning
from ostinato.sources import text, wav


def spans(spark, *pairs, kind=None, key="a"):
    rows = [(key, i, float(s), float(e), 0.5, kind[i] if kind else "original") for i, (s, e) in enumerate(pairs)]
    return spark.createDataFrame(rows, "source_key string, ordinal long, start_s double, end_s double, pred double, kind string")


def bounds(df):
    return sorted((round(r["start_s"], 6), round(r["end_s"], 6)) for r in df.collect())


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_parameters():
    for bad in ({"precision": 0}, {"block_size": 0}, {"threshold": 1.1}, {"focus_idx": 527}):
        with pytest.raises(ValueError):
            Detection(**bad)
    with pytest.raises(ValueError):
        Planning(before=-1)


def frames(spark, scores, other=None, block=0):
    rows = [("a", block, i, [float(s), float(other[i]) if other else 0.0]) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, detect.FRAME_SCHEMA)


def test_subsample_keeps_the_rest(spark):
    p = Detection(precision=2, focus_idx=0)
    got = detect.subsample_max(detect.focus_scores(frames(spark, [1, 3, 2, 5, 4]), p), p).orderBy("bucket")
    assert [r["score"] for r in got.collect()] == [3, 5, 4]


def test_threshold_is_strict_and_islands_part(spark):
    p = Detection(precision=1, focus_idx=0, threshold=0.5, block_size=1)
    found = detect.detect_segments(frames(spark, [0.5, 0.75, 0.75, 0.25, 0.75]), p)
    assert bounds(found) == [(0.01, 1.02), (0.04, 1.04)]


def test_bounds_add_a_second_whatever_the_precision(spark):
    row = spark.createDataFrame([("a", 1, 3, 4)], "source_key string, block_no long, first_bucket long, last_bucket long")
    assert bounds(detect.segment_bounds(row, Detection(precision=10, block_size=600))) == [(600.3, 601.4)]


def test_blocks_do_not_join(spark):
    p = Detection(precision=1, focus_idx=0, threshold=0.5, block_size=1)
    f = frames(spark, [0.0, 0.9], block=0).union(frames(spark, [0.9, 0.0], block=1))
    assert detect.detect_segments(f, p).count() == 2


def test_first_peak_and_suspect(spark):
    p = Detection(precision=4, focus_idx=0, threshold=0.5)
    r = detect.detect_segments(frames(spark, [0.75, 0.875, 0.875, 0.5], [0, 1, 0, 1]), p).first()
    assert (r["suspect"], r["top1_idx"], r["pred"]) == (True, 1, 0.875)


def test_block_count(spark):
    r = one(spark, *[detect.block_count(F.lit(d).cast("double"), 600, local) for d, local in ((1200, False), (1200, True), (None, False), (0, False))])
    assert tuple(r) == (2, 3, 1, 1)


@pytest.mark.parametrize(
    ("pairs", "blocked", "want"),
    [
        ([(0, 3), (5, 6)], [], [(0, 3), (5, 6)]),
        ([(0, 3), (4.9, 6)], [], [(0, 6)]),
        ([(0, 3), (4, 6)], [(3.2, 3.5)], [(0, 3), (4, 6)]),
        ([(0, 5), (4, 6)], [(4.2, 4.5)], [(0, 6)]),
    ],
)
def test_merge_clips(spark, pairs, blocked, want):
    b = spans(spark, *blocked) if blocked else spans(spark, (90, 91))
    assert bounds(intervals.merge_clips(spans(spark, *pairs), b)) == want


def test_excluded_inside_kept_does_not_block(spark):
    assert intervals.blocked_intervals(spans(spark, (1, 2)), spans(spark, (0, 3))).count() == 0


def test_merge_keeps_the_first_rows_fields(spark):
    s = spans(spark, (0, 3), (2, 9), (1, 2)).withColumns({"suspect": F.col("ordinal") != 0, "top1_idx": F.col("ordinal") + 70, "pred": F.col("ordinal") / 10.0})
    r = intervals.merge_reverify(s).first()
    assert (r["start_s"], r["end_s"], r["n_merged"], r["pred"], r["ordinal"], r["suspect"], r["top1_idx"]) == (0, 9, 3, 0.2, 0, False, 70)


def test_union_is_tagged_and_sorted(spark):
    a, b = spans(spark, (5, 6), (1, 2)).drop("kind"), spans(spark, (5, 9), (0, 1)).drop("kind").withColumn("top1_idx", F.lit(1))
    got = [(r["place"], r["start_s"], r["kind"], r["top1_idx"]) for r in intervals.union_original_new(a, b).orderBy("place").collect()]
    assert got == [(1, 0, "new", 1), (2, 1, "original", None), (3, 5, "original", None), (4, 5, "new", 1)]


def test_a_plan_is_built_without_a_job_and_shuffles_rows_once(spark):
    s = spans(spark, (10, 12), (14, 16))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "")
    try:
        padded, merged = intervals.pad_clamped(s, 3, 3), intervals.merge_clips(s, spans(spark, (13, 13.5)))
        assert not tracker.getJobIdsForGroup("lazy")
        assert bounds(merged) == [(10, 12), (14, 16)]
        assert len(bounds(padded)) == 2
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_merge_reverify_is_inclusive_and_by_kind(spark):
    assert bounds(intervals.merge_reverify(spans(spark, (0, 3), (5, 6)))) == [(0, 6)]
    assert bounds(intervals.merge_reverify(spans(spark, (0, 3), (4, 6), kind=["original", "new"]))) == [(0, 3), (4, 6)]


@pytest.mark.parametrize(
    ("pairs", "want"),
    [([(0, 5), (4, 10), (9, 10.5), (20, 21)], [(4, 10), (20, 21)]), ([(0, 4), (2, 6)], [(0, 4)]), ([(0, 4), (4, 6)], [(0, 4), (4, 6)])],
)
def test_keep_longer(spark, pairs, want):
    assert bounds(intervals.keep_longer(spans(spark, *pairs))) == want


def test_length_limits(spark):
    assert bounds(intervals.keep_longer(spans(spark, (0, 0.5), (2, 3)), 0.5, strict=True)) == [(2, 3)]


def test_safe_clip(spark):
    s = spans(spark, (8, 12), (9.5, 12), (9, 12))
    ten, none = F.lit(10.0), F.lit(None).cast("double")
    assert bounds(intervals.safe_clip(s, ten, F.lit(0.5))) == [(8, 9.5)]
    assert bounds(intervals.safe_clip(spans(spark, (9, 12)), ten, F.lit(0.0))) == [(9, 10)]
    assert bounds(intervals.safe_clip(spans(spark, (-0.5, 0.6)), none, F.lit(0.5))) == [(0, 0.6)]


def test_pads(spark):
    s = spans(spark, (10, 12), (14, 16))
    assert bounds(intervals.pad_clamped(s, 3, 3)) == [(7, 14), (14, 19)]
    assert bounds(intervals.pad_plain(s, 3, 3)) == [(7, 15), (11, 19)]


def test_scan_windows(spark):
    s = spans(spark, (10, 12), (22, 23), (98, 99))
    assert bounds(intervals.scan_windows(s, 5.0, F.lit(99.9))) == [(5, 28), (93, 99.9)]


def test_covered(spark):
    s = spans(spark, (1, 2), (0, 3), (5, 6), kind=["original", "new", "original"])
    assert bounds(intervals.covered_original_anti(s)) == [(0, 3), (5, 6)]


def test_gain(spark):
    r = one(spark, *[signal.gain(F.lit(v)) for v in (0.05, 0.5, 0.004)])
    assert tuple(r) == (2.5, 0.5, 1.0)


def test_outcome(spark):
    r = one(spark, *[rescan.outcome(F.lit(p), F.lit(s)) for p, s in ((0.75, False), (0.76, True), (0.75, True))])
    assert tuple(r) == ("confirmed", "direct", "rejected")


def test_clock(spark):
    r = one(spark, timefmt.hms_round(F.lit(3599.6)), timefmt.hms_round(F.lit(2.5)), timefmt.hms_floor(F.lit(3599.6)))
    assert tuple(r) == ("1:00:00", "0:00:02", "0:59:59")
    r = one(spark, *[timefmt.parse_hms(F.lit(v)) for v in ("1:02:03", "7.5", "1:2:3")])
    assert tuple(r) == (3723.0, 7.5, None)


def test_timestamps_text(spark):
    f = spark.createDataFrame([("f", "one\ntwo\n0:00:01 - 0:00:03, confidence: 0.9\n\n0:00:01 - 0:00:02\n\nthree\n")], "path string, value string")
    got = [(r["source_name"], r["start_s"], r["is_segment"]) for r in text.parse_timestamps(f).orderBy("block_no").collect()]
    assert got == [("two", 1.0, True), ("0:00:01 - 0:00:02", None, False), ("three", None, False)]


def test_identity(spark):
    assert one(spark, urls.stable_source_id(F.lit("YouTube"), F.lit(None).cast("string"), F.lit("HTTPS://A.com/P?q=1#f")))[0] == "youtube:https://a.com/P"


@pytest.mark.parametrize(
    ("title", "part", "bare"),
    [
        ("Show (3)", None, "show (3)"), ("Show - 3", None, "show - 3"), ("Ep 3", None, "ep 3"), ("第3话", None, "第3话"), ("第 2/5 部分", 2, "第 部分"), ("第3集 x", 3, "x"), ("p 007 a", 7, "a"), ("Part 2/5", 2, "/5"),
        ("xp3", None, "xp3"), ("第3 部分 P9", 3, ""), ("2/5 End", None, "end"), ("", None, "unknown"), ("第P3集", None, "第p3集"), ("STRASSE straße", None, "strasse strasse"),
    ],
)
def test_parts(spark, title, part, bare):
    t = F.lit(title)
    assert tuple(one(spark, media.part_number(t), media.title_without_part(t), media.part_number(t, F.lit("12")), media.part_number(t, F.lit("x")))) == (part, bare, 12, part)


@pytest.mark.parametrize(
    ("url", "platform", "page"),
    [
        ("https://space.bilibili.com/7/", "bilibili-uploads", None), ("https://www.bilibili.com/7", "x", None), ("https://space.bilibili.com/7/lists/9?type=series", "bilibili-series", None), ("https://space.bilibili.com/7/lists/9", "x", None),
        ("https://www.bilibili.com/list/9?sid=1", "bilibili-collection", None), ("https://www.bilibili.com/list/9", "x", None), ("https://notbilibili.com/7/upload/video", "x", None), ("https://twitch.tv/a/videos", "twitch-vods", None),
        ("https://www.youtube.com/user/a/shorts", "youtube-uploads", None), ("https://user@m.youtube.com:443/@a/streams", "youtube-uploads", None), ("HTTP://m.youtube.com/watch?v=1&list=L", "x", "http://m.youtube.com/playlist?list=L"),
        ("http://m.youtube.com/watch/?list=L", "x", None), ("https://www.youtube.com/watch?list=&list=B%20c", "x", "https://www.youtube.com/playlist?list=B c"),
    ],
)
def test_addresses(spark, url, platform, page):
    u = F.lit(url)
    assert tuple(one(spark, urls.classify_platform(u, F.lit("X")), urls.canonical_playlist_url(u))) == (platform, page or url)


def test_extractors(spark):
    u = F.lit("https://v.example/")
    assert tuple(one(spark, *[urls.classify_platform(u, F.lit(v)) for v in ("YoutubePlaylist", "Generic", "", None)])) == ("youtube", "generic", "unknown", "unknown")
    assert one(spark, urls.stable_source_id(F.lit(None).cast("string"), F.lit(" 7 "), u))[0] == "unknown:7"


def test_more_dates(spark):
    days = {"86400": "1970-01-02", "20240230": "2024-02-30", "20240102T030405": "2024-01-02", "2024/0102": "2024-01-02", "2024-1-2": "", "9" * 20: "", "1704153600.5": "1704-15-36", "0": "1970-01-01", "100000000000": "5138-11-16"}
    assert list(one(spark, *[media.normalize_date(F.lit(k)) for k in days])) == list(days.values())
    titles = {"2024年3月5日": "2024-03-05", "2024 年3月5日": "", "2024年3月5号": "", "x2024年13月40日": "2024-13-40"}
    assert list(one(spark, *[media.title_date(F.lit(k)) for k in titles])) == list(titles.values())


@pytest.mark.parametrize(("seconds", "ms", "want"), [("n/a", "5000", None), (None, "5000", 5.0), ("7", "5000", 7.0), (None, "x", None)])
def test_durations(spark, seconds, ms, want):
    assert one(spark, media.normalize_duration(F.lit(seconds).cast("string"), F.lit(ms)))[0] == want


def test_numbers_of_keys(spark):
    short = {1e-13: "1e-13", 0.1: "0.1", 1.0: "1", 1234567.125: "1234567.125", 1e12: "1e+12", 123456789012.0: "123456789012", 1 / 3: "0.333333333333", 0.0001: "0.0001", 0.00001: "1e-05", 0.0: "0", -2.5: "-2.5"}
    assert list(one(spark, *[reuse.number(F.lit(k)) for k in short])) == list(short.values())
    for v in (0.9, 0.0, 1.0, 1e-13, 0.0001, 0.00001234, 123456.75, 1e15, 1e16, 1.5e22, 12345678.9, -0.00025, 1e7, 1e-100):
        assert one(spark, reuse.exact(F.lit(v)))[0] == repr(v)


def test_detection_key(spark):
    import hashlib
    import json

    for source, focus, flags in (("a\"b\\c\n", 58, {}), (" é日\U0001f600\x01", None, {"b": True, "a": [1, 2]})):
        want = {"platform": "web", "source_id": source.strip(), "model": "m", "precision": "100", "block_size": 600, "threshold": 0.9, "focus_idx": focus, "relevant_flags": flags}
        given = F.create_map(*[F.lit(x) for k, v in flags.items() for x in (k, json.dumps(v, separators=(",", ":")))]) if flags else None
        got = one(spark, reuse.detection_key(F.lit(" WEB "), F.lit(source.strip()), F.lit("m"), F.lit(100), F.lit(600), F.lit(0.9), F.lit(focus).cast("int"), given))[0]
        assert got == hashlib.sha256(json.dumps(want, ensure_ascii=True, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_transfers(spark):
    row = spark.createDataFrame([(1048576.0 * 4, None, 2.0, "10"), (5.0, 4.0, 2.0, "10"), (-1.0, 0.0, 0.0, None)], "current double, total double, elapsed double, source_duration string")
    got = [(r["percent"], r["speed_mb_s"], r["eta_seconds"], r["realtime"], r["stage"]) for r in transfer.metrics(row).collect()]
    assert got == [(None, 2.0, None, 5.0, "transferring"), (100.0, 2.5 / 1048576, 0.0, 6.25, "completed"), (None, 0.0, None, None, "transferring")]
    assert [r["eta_seconds"] for r in transfer.compile_metrics(row).collect()] == [None, -0.4, None]
    assert [r["realtime"] for r in transfer.fetch_metrics(row).collect()] == [None, 2.5, None]
    assert [(r["current"], r["percent"], r["realtime"]) for r in transfer.block_metrics(row).collect()][1:] == [(5.0, 100.0, 6.25), (0.0, 0.0, None)]


def test_metadata_keys(spark):
    m = F.create_map(*[F.lit(x) for k in ("author", "Cookies", "url", "formats", "format", "Format", "http_headers") for x in (k, "1")])
    r = one(spark, *[F.map_keys(f(m)) for f in (catalog.redact, catalog.entry_metadata, catalog.cached_metadata)])
    assert [sorted(v) for v in r] == [["Format", "author", "format", "url"], ["Cookies", "Format", "author", "format", "http_headers"], ["format"]]


def test_saved_names(spark):
    media_ = spark.createDataFrame([(1, "/a/x.mp4", None), (2, "/b/x.mp4", None), (3, "/a/y.mp4", None), (4, "/r/z.mp4", "https://v/1"), (5, "/r/z.mp4", "https://v/1")], "ordinal long, path string, url string")
    want = {"https://v/1": (5, "url"), "/q/Y.mp4": (None, "unmatched"), "q/y.mp4": (3, "name"), "/c/../b//./x.mp4": (2, "path"), "/c/x.mp4": (1, "ambiguous"), "/r/z.mp4": (None, "unmatched")}
    saved = spark.createDataFrame(list(enumerate(want)), "entry_id long, name string")
    got = {r["entry_id"]: (r["media_ordinal"], r["how"]) for r in match.match_saved(saved, media_).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
    assert tuple(one(spark, *[match.normal_path(F.lit(v)) for v in ("../a/../../b", "/../a/", "", "a/..")])) == ("../../b", "/a", ".", ".")


def test_candidates_seen_before(spark):
    rows = [(1, "f1", "a", "v"), (2, "f1", "b", "v"), (3, "f2", "a", "v"), (4, "", "c", "v"), (5, "", "d", "v"), (6, None, "e", "v"), (7, "f3", None, "v"), (8, "f3", "g", "v"), (9, "f4", "h", "none"), (10, "f4", "i", "v")]
    df = spark.createDataFrame([("s", i, f, u, "aac", v) for i, f, u, v in rows], "source_key string, ordinal long, format_id string, url string, acodec string, vcodec string")
    assert sorted(r["ordinal"] for r in catalog.distinct_candidates(df, "video").collect()) == [1, 4, 5, 6, 8]


def test_streams_and_sizes(spark):
    c = spark.createDataFrame([("aac", None), ("", "none"), ("NONE", None), ("none", None), (None, ""), ("aac", "h264")], "acodec string, vcodec string")
    assert (catalog.stream_kind(c, "audio").count(), catalog.stream_kind(c, "video").count()) == (3, 2)
    parts = lambda *v: F.array(*[F.struct(F.lit(a).cast("long").alias("filesize"), F.lit(b).cast("long").alias("filesize_approx")) for a, b in v])
    none, two, three = F.slice(parts((1, 1)), 1, 0), parts((None, 7), (0, 5)), parts((1, 1), (1, 1), (1, 1))
    zero = F.lit(0).cast("long")
    assert tuple(one(spark, *[catalog.estimate_size(zero, zero, a, b) for a, b in ((none, two), (none, three), (three, two), (parts((1, 1), (0, None)), two))])) == (12, None, 3, None)


def test_sorted_paths(spark):
    want = [
        "/m/x/2023年9月 z.mp4", "/m/2024年3月5日8点场/10.mp4", "/m/2024年3月5日8点场/p2-a.mp4", "/m/2024年3月5日8点场/a (2).mp4", "/m/2024年3月5日8点场/a_p10.mp4", "/m/2024年3月5日8点场/clip.mp4", "/m/2024年3月5日/a.mp4",
        "/m/y/2024-03-06 Original.mp4", "/m/9/b2.mp4", "/m/9/b10.mp4", "/m/10/a.mp4", "/m/a9/x.mp4", "/m/a" + "1" * 20 + "/x.mp4",
    ]
    rows = spark.createDataFrame([(p,) for p in sorted(want)], "path string")
    got = [r["path"] for r in ordered.numbered(rows, [catalog.smart_sort_key(F.col("path"))]).orderBy("place").collect()]
    assert sorted(got) == sorted(want) and got[0] == want[0] and got[-6:] == want[-6:]


def test_covering_segment(spark):
    cached = spark.createDataFrame([(1, "a", 0.0, 100.0, None), (2, "a", 10.0, 30.0, "video"), (3, "a", 12.0, 29.0, "audio"), (4, "a", -5.0, 3.0, None)], "cached_id long, source_key string, start_s double, end_s double, media_type string")
    asked = spark.createDataFrame([(1, "a", 15.0, 20.0, 5.0, "video"), (2, "a", 15.0, 20.0, 6.0, None), (3, "a", 15.0, 20.0, 0.0, "Audio"), (4, "a", 1.0, 2.0, 2.0, "video"), (5, "b", 1.0, 2.0, 0.0, "video")], "request_id long, source_key string, start_s double, end_s double, padding double, media_type string")
    assert {r["request_id"]: r["cached_id"] for r in reuse.covering_segment(asked, cached).collect()} == {1: 2, 2: 1, 3: 3}


def test_dates_and_qualities(spark):
    r = one(spark, *[media.normalize_date(F.lit(v)) for v in ("20240102", "1704153600000", "2024-01-02T03:04:05Z", "x")])
    assert tuple(r) == ("2024-01-02", "2024-01-02", "2024-01-02", "")
    assert tuple(one(spark, *[media.parse_quality(F.lit(v)) for v in ("720p", "256x144", "No Limit")])) == (720, 144, None)


@pytest.mark.parametrize(("heights", "want"), [([1080, 720, 480], 480), ([1080, 720], 720)])
def test_quality_cap(spark, heights, want):
    rows = [("a", f"f{h}", float(h), i + 1) for i, h in enumerate(heights)]
    assert catalog.quality_cap(spark.createDataFrame(rows, "source_key string, format_id string, height double, rank int"), 700.0).first()["height"] == want


def test_slow_streak(spark):
    rows = [(1, i + 1, v) for i, v in enumerate([0.1, 0.1, 0.5, 0.5, 0.5, 0.5])]
    got = transfer.slow_streak(spark.createDataFrame(rows, "key long, seq long, speed double"), 1.0)
    assert [r["seq"] for r in got.collect()] == [4]


def test_wav(spark):
    raw = b"\x01\x00\x03\x00\x05\x00\x07\x00"
    rows = [("mono", wav.header(8, 1000) + raw), ("stereo", wav.header(8, 1000, channels=2) + raw), ("wide", wav.header(8, 1000, bits=24) + raw), ("junk", b"x")]
    got = {r["path"]: r for r in wav.decode(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert bytes(got["mono"]["payload"]) == raw and bytes(got["stereo"]["payload"]) == b"\x02\x00\x06\x00"
    assert got["wide"]["error"] and got["junk"]["error"]


def test_random_intervals_against_a_fold(spark):
    """The set-based forms against plain sequential ones, on integer bounds, so that ties and exact gaps occur."""
    import random

    rng = random.Random(5)
    data = {f"s{k}": sorted(((s := rng.randint(0, 40)), s + rng.randint(1, 8)) for _ in range(rng.randint(1, 25))) for k in range(60)}
    rows = [(k, i, float(s), float(e), 0.5, "original") for k, v in data.items() for i, (s, e) in enumerate(v)]
    df = spark.createDataFrame(rows, "source_key string, ordinal long, start_s double, end_s double, pred double, kind string")

    def merge(v, joins):
        out = []
        for s, e in v:
            if out and joins(s, out[-1][1]):
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                out.append((s, e))
        return out

    def longer(v):
        out = []
        for s, e in v:
            if out and out[-1][1] > s:
                if e - s > out[-1][1] - out[-1][0]:
                    out[-1] = (s, e)
            else:
                out.append((s, e))
        return out

    def by_source(d):
        got = {}
        for r in d.collect():
            got.setdefault(r["source_key"], []).append((r["start_s"], r["end_s"]))
        return {k: sorted(v) for k, v in got.items()}

    assert by_source(intervals.merge_clips(df)) == {k: merge(v, lambda s, e: s - e < 2) for k, v in data.items()}
    assert by_source(intervals.merge_reverify(df)) == {k: merge(v, lambda s, e: s <= e + 2) for k, v in data.items()}
    assert by_source(intervals.keep_longer(df)) == {k: longer(v) for k, v in data.items()}
