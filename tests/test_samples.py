"""Chunks of PCM against plain slices, and the ordered helpers against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import detect, ordered, signal
from ostinato.sources import wav


@pytest.fixture(scope="module")
def pcm():
    rng = np.random.default_rng(4)
    return {k: rng.integers(-32768, 32767, n).astype("<i2") for k, n in (("a", 1003), ("b", 17), ("c", 400))}


def chunked(spark, pcm, seed=1):
    """Chunks of odd lengths, out of order, with an empty one."""
    rng, rows = random.Random(seed), []
    for k, x in pcm.items():
        at = 0
        while at < len(x):
            n = rng.choice([1, 7, 50, 130])
            rows.append((k, at, bytearray(x[at : at + n].tobytes())))
            at += n
        rows.append((k, 3, bytearray()))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "source_key string, first_sample long, payload binary")


@pytest.mark.parametrize("cell", [signal.CELL, 40])
def test_stretches(spark, pcm, cell):
    want = {("a", 1): (0, 1003), ("a", 2): (5, 6), ("a", 3): (990, 2000), ("b", 4): (10, 30), ("c", 5): (39, 81), ("c", 6): (80, 120)}
    rows = [(k, n, a, b) for (k, n), (a, b) in want.items()] + [("a", 7, 5, 5), ("a", 8, 5000, 6000), ("x", 9, 0, 5)]
    s = spark.createDataFrame(rows, "source_key string, no long, from long, to long")
    got = {(r["source_key"], r["no"]): bytes(r["payload"]) for r in signal.cut(s, chunked(spark, pcm), ["no"], cell).collect()}
    assert got == {(k, n): pcm[k][a:b].tobytes() for (k, n), (a, b) in want.items()}


def test_blocks_loudness_and_clips(spark, pcm):
    c = chunked(spark, pcm)
    got = {(r["source_key"], r["block_no"]): (r["n_samples"], bytes(r["payload"])) for r in signal.block_pad(c, 200).collect()}
    assert got == {(k, i): (len(x[200 * i : 200 * i + 200]), x[200 * i : 200 * i + 200].tobytes().ljust(400, b"\0")) for k, x in pcm.items() for i in range(-(-len(x) // 200))}
    for r in signal.block_rms_gain(c, 200).collect():
        x = pcm[r["source_key"]][200 * r["block_no"] :][:200] / 32767
        assert r["rms"] == pytest.approx(np.sqrt((x * x).mean())) and r["gain"] == pytest.approx(min(2.5, 0.25 / r["rms"]))
    plan = spark.createDataFrame([("a", 1, 0.1, 2.0), ("a", 2, 9.9, 99.0), ("c", 1, 1.0, 1.0)], "source_key string, clip_no long, start_s double, end_s double")
    clips = {(r["source_key"], r["clip_no"]): bytes(r["payload"]) for r in wav.extract_clips(plan, c, 100).collect()}
    assert clips == {("a", 1): pcm["a"][10:200].tobytes(), ("a", 2): pcm["a"][990:].tobytes()}


def test_scores_of_blocks_with_gain(spark):
    raw = np.full(200, 8000, "<i2").tobytes()
    blocks = spark.createDataFrame([("a", 0, bytearray(raw), 2.0)], "source_key string, block_no long, payload binary, gain double")
    power = lambda df, scale: [round(r["scores"][0], 6) for r in detect.score_blocks(df, detect.power_scorer(100), detect.FRAME_SCHEMA, scale).collect()]
    assert power(blocks, 32767.0) == [round((16000 / 32767) ** 2, 6)] * 2
    assert power(blocks.drop("gain"), 32768.0) == [round((8000 / 32768) ** 2, 6)] * 2


def test_neighbours_numbers_and_running_values(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.randrange(1000)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    bucket, order = F.floor(F.col("i") / 7), [F.col("i")]
    out = ordered.beside(df, ["k"], bucket, order, {"next": (F.col("v"), True), "last": (F.col("v"), False)})
    out = ordered.running(out, ["k"], bucket, order, {"total": (F.col("v"), "sum", True), "most": (F.col("v"), "max", False)})
    out = ordered.numbered(out, [F.col("v"), F.col("i")], "no", ["k"])
    got = {r["i"]: (r["next"], r["last"], r["total"], r["most"], r["no"]) for r in out.collect()}
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        ranks = {r[1]: n for n, r in enumerate(sorted(own, key=lambda r: (r[2], r[1])), 1)}
        for n, (_, i, _) in enumerate(own):
            assert got[i] == (own[n + 1][2] if n + 1 < len(own) else None, own[n - 1][2] if n else None, sum(r[2] for r in own[: n + 1]), max((r[2] for r in own[:n]), default=None), ranks[i])


def test_a_recording_over_two_gib_is_read_by_many_tasks(spark, tmp_path):
    """A sparse file: zeros but for a few places, in blocks that are read whole and padded without a shuffle."""
    n, block = (9 << 28) + 1234, 16 << 20  # samples, over 4.8 GB: more than a header's 32 bits hold
    marked = {0: 7, block: 8, n // 2: 9, n - 1: 10}
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(wav.header(2 * n, 32000))
        start = f.tell()
        f.truncate(start + 2 * n)
        for i, v in marked.items():
            f.seek(start + 2 * i)
            f.write(int(v).to_bytes(2, "little"))
    (tmp_path / "junk.wav").write_bytes(b"JUNK" * 10)
    reader = wav.WavReader({"path": str(tmp_path), "chunk": str(block)})
    parts = reader.partitions()
    assert len(parts) > 60 and sum(len(p.parts) for p in parts) >= len(parts)
    spans = [(a, b) for p in parts for path, _, a, b in p.parts if path.endswith("long.wav")]
    assert [i for a, b in spans for i in range(a, b)] == list(range(-(-n // block))) and max(b - a for a, b in spans) == 2
    for i, v in marked.items():
        rows = [r for p in parts for path, found, a, b in p.parts if path.endswith("long.wav") and a <= i // block < b for r in reader.read(wav.Ranges([(path, found, i // block, i // block + 1)]))]
        raw = rows[0]["payload"][0].as_buffer()
        assert (rows[0]["chunk_no"][0].as_py(), int(np.frombuffer(raw, "<i2")[i % block])) == (i // block, v)
    (tmp_path / "some").mkdir()
    x = np.random.default_rng(1).integers(-32768, 32767, 2500).astype("<i2").tobytes()
    (tmp_path / "some" / "A.WAV").write_bytes(wav.header(5000, 100) + x)
    (tmp_path / "some" / "b.wav").write_bytes(wav.header(5000, 100, channels=2)[:40] + b"\xff\xff\xff\xff" + x + b"\1")
    got = wav.read_wav(spark, str(tmp_path / "some"), 1000, 2000)
    assert got.rdd.getNumPartitions() == 5
    blocks = got.select(F.element_at(F.split("path", "/"), -1).alias("source_key"), F.col("chunk_no").alias("block_no"), "payload")
    done = signal.padded(blocks, 1000)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    mono = np.frombuffer(x, "<i2").reshape(-1, 2).mean(axis=1).astype("<i2").tobytes()
    want = [(k, i, len(y[2000 * i :][:2000]) // 2, y[2000 * i :][:2000].ljust(2000, b"\0")) for k, y in (("A.WAV", x), ("b.wav", mono)) for i in range(-(-len(y) // 2000))]
    assert sorted((r["source_key"], r["block_no"], r["n_samples"], bytes(r["payload"])) for r in done.collect()) == want


def test_many_small_recordings_take_few_tasks(tmp_path, monkeypatch):
    """Shares grow beyond so many tasks; headers of what is shorter than a share aren't read while the plan is made."""
    raw = np.arange(30, dtype="<i2").tobytes()
    for i in range(400):
        (tmp_path / f"{i:03d}.wav").write_bytes(b"JUNK" * (i % 50 == 7) + wav.header(60, 100) + raw)
    monkeypatch.setattr(wav, "TASKS", 20)
    reader, opened, layout = wav.WavReader({"path": str(tmp_path), "chunk": "20", "rangebytes": "40"}), [], wav.layout
    monkeypatch.setattr(wav, "layout", lambda f, size: opened.append(size) or layout(f, size))
    parts = reader.partitions()
    assert len(parts) <= 22 and not opened
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    want = []
    for i in range(400):
        path = str(tmp_path / f"{i:03d}.wav")
        want += [(path, None, None, None, "not a WAV file")] if i % 50 == 7 else [(path, 0, 100, raw[:40], None), (path, 1, 100, raw[40:], None)]
    assert [tuple(r.values()) for r in rows] == want
    (tmp_path / "long.wav").write_bytes(wav.header(20_000, 100) + b"\0" * 20_000)
    spans = [(a, b) for p in reader.partitions() for path, _, a, b in p.parts if path.endswith("long.wav")]
    assert len(spans) > 5 and [i for a, b in spans for i in range(a, b)] == list(range(500)) and len(opened) == 401


def test_wav_headers(tmp_path):
    import io
    import struct

    raw = b"\1\0" * 10
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    plain = wav.header(20, 100)
    for head in (plain, plain[:12] + extra + plain[12:], b"RF64\xff\xff\xff\xffWAVEds64" + struct.pack("<IQQQI", 28, 0, 20, 10, 0) + plain[12:40] + b"\xff\xff\xff\xff"):
        found = wav.layout(io.BytesIO(head + raw), len(head + raw))
        assert (found.start, found.n_frames, found.rate) == (len(head), 10, 100)
    for bad in (b"", b"RIFF", plain[:20], wav.header(20, 100, bits=8) + raw, plain[:36]):
        with pytest.raises(Exception):
            wav.layout(io.BytesIO(bad), len(bad))
    with pytest.raises(FileNotFoundError):
        wav.WavReader({"path": str(tmp_path / "none")}).partitions()
    assert wav.WavReader({"path": str(tmp_path)}).partitions() == [wav.Ranges([])]


def test_many_chunks_of_a_stretch_take_linear_time(spark):
    import time

    def took(n):
        rows = spark.range(n).select(F.lit("a").alias("source_key"), (F.col("id") * 2000).alias("first_sample"), F.unhex(F.repeat(F.lit("0100"), 2000)).alias("payload")).checkpoint()
        s = spark.createDataFrame([("a", 1, 0, n * 2000)], "source_key string, no long, from long, to long")
        t = time.perf_counter()
        assert signal.cut(s, rows, ["no"]).select(F.octet_length("payload")).first()[0] == n * 4000
        return time.perf_counter() - t

    took(100)
    assert took(2000) < 1 + 10 * took(500)
