"""Frames and fill-in-middle against plain Python on whole texts."""

import hashlib
import random
import re

import pytest

from ostinato.llm import fim, frames

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(doc_id, text, seed=42, fim_rate=50, spm_rate=80):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:z], units[z:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(n=300):
    rng = random.Random(12)
    parts = ["a", "word", "é", "中", "\U0001f600", " ", "  ", "\n", "\t\r", "\x0b", "\x0c", " ", "\x1c", "<P", ">", "<S>", "<", "M", "."]
    out = ["".join(rng.choices(parts, [9] * 5 + [5] * 6 + [2] * 2 + [1] * 6, k=rng.randrange(80))) for _ in range(n)]
    return [None, "", " ", "\n\n", "x", "x ", " x", "é" * 300, " " * 300, "a b " * 100, *out]


KEY = lambda r: tuple(str(x) for x in r)


@pytest.mark.parametrize(("frame", "pack"), [(1, 1), (7, 50), (64, 1000), (frames.FRAME, frames.PACK)])
def test_outputs_digests_and_round_trip(spark, frame, pack):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts())] + [(5, "twice over"), (5, "twice over")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stored = frames.read_store(spark, frames.store(df, frame=frame, pack=pack))
    want = sorted((plain(*r, fim_rate=90) for r in rows), key=KEY)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    got = fim.transformed(stored, fim_rate=90).collect()
    assert sorted((tuple(r) for r in got), key=KEY) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text_of = sorted(((*plain(*r, fim_rate=90)[:5], sha(plain(*r, fim_rate=90)[5]), sha(r[1] or "")) for r in rows), key=KEY)
    assert sorted((tuple(r) for r in fim.digests(stored, fim_rate=90).collect()), key=KEY) == text_of


def test_only_the_frames_of_the_cuts_are_decompressed(spark):
    text = "".join(f"word{i} " for i in range(20_000))
    stored = frames.packs(spark.createDataFrame([(1, text)], "doc_id long, text string"), frame=1000)
    import pyarrow as pa

    p = frames.Pack(stored.toArrow().combine_chunks().to_batches()[0], 0)
    opened = []
    inner = p._opened
    p._opened = lambda f: opened.append(f) or inner(f)
    at, chars = p.place(0, 12_345)
    assert text[at:].startswith(" word12345 ") and chars == at and len(opened) == 1
    assert isinstance(p._data, pa.Array) and len(p._data) > 100
    assert b"".join(p.stream(at, at + 5000)) == text[at : at + 5000].encode()


def test_a_rebuilt_text_needs_output_and_form_alone(spark):
    class Given(fim.Output):
        """An output from elsewhere, in chunks of three bytes."""

        def __init__(self, raw):
            self.raw = raw

        def chunks(self, start=0, stop=None):
            x = self.raw[start:stop]
            return (x[i : i + 3] for i in range(0, len(x), 3))

    for form, raw in (("psm", b"<P>one two<S> four<M> three"), ("spm", b"<S> four<P>one two<M> three"), ("plain", b"one two three four")):
        assert b"".join(fim.rebuilt(Given(raw), form)) == b"one two three four"
    assert b"".join(fim.rebuilt(Given(b"<S><P><M>x"), "spm")) == b"x"


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, n int")
    assert fim.digests(frames.packs(df.limit(0))).collect() == []
    long = "x" * 500_000 + " y" * 500_000
    got = fim.digests(frames.packs(spark.createDataFrame([(i, long) for i in range(6)], "doc_id long, text string"))).collect()
    assert {r["restored_sha256"] for r in got} == {hashlib.sha256(long.encode()).hexdigest()}
    assert sorted((r["doc_id"], r["output_sha256"]) for r in got) == [(i, hashlib.sha256(plain(i, long)[5].encode()).hexdigest()) for i in range(6)]


def test_table(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(map(KEY, duck.execute(fim.OP12_SQL).fetchall()))
    assert sorted(KEY(tuple(r)) for r in fim.op12_fill_in_middle(spark, sf).collect()) == want
