"""Substring deduplication by fixed-block anchors.

Any WINDOW consecutive words hold a whole block of ANCHOR words that begins at a multiple of ANCHOR, as
2 * ANCHOR - 1 <= WINDOW. So:

1. Index the non-overlapping blocks of all documents, and probe them with every rolling window of ANCHOR words.
   Both sides go to buckets by hash, as packed arrays of a few bytes a window. What a task can settle itself (a hash that
   it has twice, once as a block) it sends once, so a hot passage brings a few entries of each task to its bucket.
2. A hit extends to the windows of WINDOW words around it. These are matched in the same way on more bits; what repeated
   windows cover together are the maximal exact repeats.
3. Covered words are cut from their documents.

A bucket holds about BUCKET_WORDS windows at any size of input, as the number of buckets grows with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, written

WINDOW = 35
ANCHOR = 18
#: Windows that a task holds before it sends them on, and that one bucket is to get.
FLUSH = 2_000_000
BUCKET_WORDS = 2_000_000
MULTIPLIER = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_CACHE = 1 << 20
_hashes: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > WORD_CACHE:
        _hashes.clear()
    h = _hashes
    for w in set(words):
        if w not in h:
            h[w] = xxhash.xxh64_intdigest(w)
    return np.array([h[w] for w in words], np.uint64)


def _powers(m: int, n: int) -> np.ndarray:
    x = np.full(n + 1, m, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


_table: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def rolling(h: np.ndarray, k: int, m: int = MULTIPLIER[0]) -> np.ndarray:
    """Hashes of all windows of k of the values, from prefix sums of h[i] * m^i, each divided by its first power."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    if m not in _table or len(_table[m][0]) <= n:
        size = max(2 * n, 1 << 14)
        _table[m] = (_powers(m, size), _powers(pow(m, -1, 1 << 64), size))
    up, down = _table[m]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
    x = (total[k:] - total[:-k]) * down[: n - k + 1]
    x ^= x >> np.uint64(32)  # spread the low bits, which the sum mixes least, before buckets are taken
    return x * np.uint64(0xD6E8FEB86659FD93) ^ (x >> np.uint64(29))


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


SENT = "bucket int, flush long, h binary, known binary, block binary, gaps binary, wide boolean, n int, a binary, b binary, starts binary"
FOUND = "flush long, places binary, a binary, b binary, starts binary"


def _row(schema: str, **x) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x.get(n)], kinds[k]) for n, k in names], [n for n, _ in names])


class _Flush:
    """The windows of some documents of a task, numbered through; `send` gives the rows for the buckets.

    Every row goes to a bucket: packed hashes to their own; the documents' index and the places that are settled here
    already pass through one of the negative buckets.
    """

    def __init__(self, buckets: int, number: int):
        self.buckets, self.number, self.size = buckets, number, 0
        self.parts: list = []
        self.index: list = []

    def add(self, key: tuple[int, int], hashes: np.ndarray, more: np.ndarray | None, block: np.ndarray, place: np.ndarray) -> None:
        self.index.append((*key, self.size))
        self.parts.append((hashes, more if more is not None else hashes[:0], block, place))
        self.size += int(place[-1]) + 1 if len(place) else 0

    def send(self):
        base = np.array([x[2] for x in self.index], np.int64)
        h, more, block = (np.concatenate(x) for x in list(zip(*self.parts))[:3])
        at = np.concatenate([p[3] + s for p, s in zip(self.parts, base)]).astype(np.int64)
        order = np.lexsort((h, more)) if len(more) else np.argsort(h, kind="stable")
        g = h[order]
        edge = np.concatenate([[True], g[1:] != g[:-1]])
        if len(more):
            m = more[order]
            edge[1:] |= m[1:] != m[:-1]
        first = np.nonzero(edge)[0]
        n = np.diff(np.append(first, len(g)))
        has = np.logical_or.reduceat(block[order], first)
        settled = np.zeros(len(h), bool)
        settled[order] = np.repeat((n > 1) & has, n)  # twice here, once as a block: all of them are hits
        speaker = np.zeros(len(h), bool)
        speaker[order[first]] = True
        rest = -1 - self.number % self.buckets
        a, b = (np.array([x[i] for x in self.index], np.int64) for i in (0, 1))
        yield _row(SENT, bucket=rest, flush=self.number, a=a.tobytes(), b=b.tobytes(), starts=base.tobytes(), gaps=np.sort(at[settled]).tobytes())
        # one entry for a settled hash, one for each other window
        go = np.nonzero(~settled | speaker)[0]
        go = go[np.argsort((h[go] >> np.uint64(32)) % np.uint64(self.buckets), kind="stable")]
        bucket = ((h[go] >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for i in np.nonzero(np.diff(cut))[0]:
            x = go[cut[i] : cut[i + 1]]
            gaps = np.diff(at[x], prepend=0)
            wide = bool(gaps.max() > 65535)
            low = (h[x] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (more[x].tobytes() if len(more) else b"")
            yield _row(
                SENT, bucket=int(i), flush=self.number, h=low, known=np.packbits(settled[x]).tobytes(), block=np.packbits(block[x] | settled[x]).tobytes(),
                gaps=gaps.astype(np.uint32 if wide else np.uint16).tobytes(), wide=wide, n=len(x),
            )


def _matched(table: pa.Table) -> pa.Table:
    """One bucket: answers to the flushes whose windows repeat elsewhere. Negative buckets pass on."""
    rows = table.to_pylist()
    if rows[0]["bucket"] < 0:
        out = [(r["flush"], r["gaps"], r["a"], r["b"], r["starts"]) for r in rows]
    else:
        low, more, known, block, at, which = [], [], [], [], [], []
        for i, r in enumerate(rows):
            n = r["n"]
            low.append(np.frombuffer(r["h"], np.uint32, n))
            more.append(np.frombuffer(r["h"], np.uint64, offset=4 * n))
            known.append(np.unpackbits(np.frombuffer(r["known"], np.uint8), count=n).astype(bool))
            block.append(np.unpackbits(np.frombuffer(r["block"], np.uint8), count=n).astype(bool))
            at.append(np.cumsum(np.frombuffer(r["gaps"], np.uint32 if r["wide"] else np.uint16), dtype=np.int64))
            which.append(np.full(n, i, np.int32))
        low, more, known, block, at, which = map(np.concatenate, (low, more, known, block, at, which))
        order = np.lexsort((low, more)) if len(more) else np.argsort(low, kind="stable")
        g = low[order]
        edge = np.concatenate([[True], g[1:] != g[:-1]])
        if len(more):
            m = more[order]
            edge[1:] |= m[1:] != m[:-1]
        first = np.nonzero(edge)[0]
        n = np.diff(np.append(first, len(g)))
        hit = ((n > 1) | np.logical_or.reduceat(known[order], first)) & np.logical_or.reduceat(block[order], first)
        yes = order[np.repeat(hit, n)]
        yes = np.sort(yes[~known[yes]])
        cut = np.searchsorted(which[yes], np.arange(len(rows) + 1))
        out = [(r["flush"], at[yes[cut[i] : cut[i + 1]]].tobytes(), None, None, None) for i, r in enumerate(rows) if cut[i + 1] > cut[i]]
    kinds = [pa.int64()] + [pa.binary()] * 4
    names = ["flush", "places", "a", "b", "starts"]
    return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds))})


def _spans(table: pa.Table) -> pa.Table:
    """One flush: the places of its hits by document, (a, b, places)."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["a"] is not None)
    starts = np.frombuffer(head["starts"], np.int64)
    at = np.sort(np.concatenate([np.frombuffer(r["places"], np.int64) for r in rows]))
    doc = np.searchsorted(starts, at, side="right") - 1
    cut = np.searchsorted(doc, np.arange(len(starts) + 1))
    some = np.nonzero(np.diff(cut))[0]
    a, b = np.frombuffer(head["a"], np.int64), np.frombuffer(head["b"], np.int64)
    places = [(at[cut[i] : cut[i + 1]] - starts[i]).astype(np.int32).tobytes() for i in some]
    return pa.table({"a": pa.array(a[some]), "b": pa.array(b[some]), "places": pa.array(places, pa.binary())})


def _repeats(rows: DataFrame, windows, buckets: int, name: str) -> DataFrame:
    """(a, b, places) of windows that have an equal elsewhere; windows(batch row) -> (hashes, more, block, places)."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        flush = _Flush(buckets, number)
        for batch in batches:
            for row in batch.to_pylist():
                flush.add((row["a"], row["b"]), *windows(row))
                if flush.size >= FLUSH:
                    yield from flush.send()
                    number += 1
                    flush = _Flush(buckets, number)
        if flush.size:
            yield from flush.send()

    found = rows.mapInArrow(run, SENT).groupBy("bucket").applyInArrow(_matched, FOUND)
    places = written(found, name).groupBy("flush").applyInArrow(_spans, "a long, b long, places binary")
    return places.groupBy("a", "b").agg(F.collect_list("places").alias("places"))


def _anchors(row):
    """All windows of ANCHOR words of a text; those at multiples of ANCHOR are the indexed blocks."""
    h = rolling(_word_hashes(_split(row["text"])), ANCHOR)
    place = np.arange(len(h))
    return h, None, place % ANCHOR == 0, place


def _around(row):
    """The windows of WINDOW words that hold a hit, by two hashes; each stands for itself."""
    h = _word_hashes(_split(row["text"]))
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    hits = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in row["places"]])).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(hits - (WINDOW - ANCHOR), 0, n), 1)
    np.add.at(edge, np.clip(hits + 1, 0, n), -1)
    place = np.nonzero(np.cumsum(edge[:-1]) > 0)[0]
    one = rolling(h, WINDOW, MULTIPLIER[0])[place]
    two = rolling(h * np.uint64(0xFF51AFD7ED558CCD) ^ (h >> np.uint64(31)), WINDOW, MULTIPLIER[1])[place]
    return one, two, np.ones(len(place), bool), place


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, places): starts of the windows of WINDOW words that occur elsewhere, for rows keyed as `keyed` does."""
    spark = docs.sparkSession
    shared_dir(spark)
    base = keyed(docs, doc_id, text)
    size = base.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-size // (6 * BUCKET_WORDS)))
    hits = _repeats(base.select("a", "b", "text"), _anchors, buckets, "anchors")
    held = written(base.select("a", "b", "text").join(hits, ["a", "b"]), "hits")
    return _repeats(held, _around, buckets, "windows")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, a, b): null text is empty; rows equal in id and text share a key, and so their repeats."""
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return own.withColumns({"a": F.coalesce("doc_id", F.lit(-(1 << 63))), "b": F.xxhash64("text")})


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's text without the words that a repeated window covers, joined by spaces.

    Null or blank text has no words. A row that is there twice is two documents, and each repeats the other. Extra columns
    aren't read.
    """
    places = repeated_windows(docs, doc_id, text)

    def run(batches):
        for b in batches:
            out = []
            for i, t, p in zip(*[c.to_pylist() for c in b.columns]):
                w = _split(t)
                n = len(w)
                if p:
                    at = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in p])).astype(np.int64)
                    edge = np.zeros(n + 1, np.int64)
                    edge[at] += 1
                    edge[at + WINDOW] -= 1
                    w = [w[k] for k in np.nonzero(np.cumsum(edge[:-1]) == 0)[0]]
                out.append((i, n, n - len(w), b" ".join(w).decode()))
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_words", "n_removed", "kept"])

    full = keyed(docs, doc_id, text).join(places, ["a", "b"], "left").select("doc_id", "text", "places")
    return full.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op10_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, array_to_string(ws[i:i+34], ' ') AS k FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
x AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
y AS (SELECT w.doc_id, ws, CASE WHEN js IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: NOT list_contains(js, z[2])), lambda z: z[1]) END AS kept
  FROM w LEFT JOIN x USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM y"""
