"""Text as seekable zstandard frames.

A row of a store is a pack: the texts of some documents, one behind another, cut into frames of about FRAME bytes that are compressed
apart. Frames end between characters, not at documents, so short documents share one and a long one has many. Each frame and each
document knows how many bytes, characters and units of the pack come before it; a unit is a word with the white space before it, or
white space at a text's end. So the place of any unit is found by a binary search and one decompressed frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path

#: Bytes of text in a frame and in a pack, unless one document has more.
FRAME, PACK = 1 << 16, 1 << 20
#: Bytes of a store's row groups: Spark reads the rows of one at once.
ROW_GROUP = 16 << 20
LEVEL = 3
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(9, 14)]] = True
_DOC = {"doc_id": pa.int64(), "byte": pa.int64(), "chars": pa.int64(), "units": pa.int64(), "marked": pa.bool_()}
_FRAME = {"byte": pa.int64(), "chars": pa.int64(), "units": pa.int64(), "data": pa.binary()}
_SPARK = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary"}


def _struct(fields: dict) -> str:
    return "array<struct<" + ",".join(f"{k}:{_SPARK[v]}" for k, v in fields.items()) + ">>"


SCHEMA = f"docs {_struct(_DOC)}, frames {_struct(_FRAME)}, n_bytes long, n_chars long, n_units long"


def unit_starts(x: np.ndarray, before: int | None, firsts: np.ndarray) -> np.ndarray:
    """Places in x, some bytes of a pack, where units start: at a document's first byte, and at white space behind a word. before: the
    byte in front of x, None if there is none."""
    white = _WHITE[x]
    start = white.copy()
    start[1:] &= ~white[:-1]
    if len(x):
        start[0] = white[0] and before is not None and not _WHITE[before]
    start[firsts] = True
    return np.flatnonzero(start)


def _chars(x: np.ndarray) -> int:
    return int(np.count_nonzero((x & 0xC0) != 0x80))


def _one(values: dict, kinds: dict) -> pa.ListArray:
    rows = pa.StructArray.from_arrays([pa.array(values[k], v) for k, v in kinds.items()], list(kinds))
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)


def _pack(ids: pa.Array, marked: pa.Array, data: np.ndarray, ends: np.ndarray, frame: int) -> pa.RecordBatch:
    """ends: where each document ends in data, the bytes of all."""
    import zstandard

    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full, press = np.unique(starts[ends > starts]), zstandard.ZstdCompressor(level=LEVEL)
    doc_chars, doc_units = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    rows: dict[str, list] = {k: [] for k in _FRAME}
    at = chars = units = 0
    while at < len(data):
        to = min(len(data), at + frame)
        while to < len(data) and to > at + 1 and data[to] & 0xC0 == 0x80:
            to -= 1
        x = data[at:to]
        firsts = full[np.searchsorted(full, at) : np.searchsorted(full, to)] - at
        found = unit_starts(x, data[at - 1] if at else None, firsts)
        for k, v in (("byte", at), ("chars", chars), ("units", units), ("data", press.compress(x))):
            rows[k].append(v)
        own = slice(*np.searchsorted(starts, [at, to]))
        inside = starts[own] - at
        doc_units[own] = units + np.searchsorted(found, inside)
        lead = np.concatenate([[0], np.cumsum((x & 0xC0) != 0x80)])
        doc_chars[own] = chars + lead[inside]
        at, chars, units = to, chars + int(lead[-1]), units + len(found)
    last = starts >= len(data)
    doc_chars[last], doc_units[last] = chars, units
    docs = {"doc_id": ids, "byte": starts, "chars": doc_chars, "units": doc_units, "marked": marked}
    n = [pa.array([v], pa.int64()) for v in (len(data), chars, units)]
    return pa.RecordBatch.from_arrays([_one(docs, _DOC), _one(rows, _FRAME), *n], ["docs", "frames", "n_bytes", "n_chars", "n_units"])


def packs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", marks: str = "<[PSM]>", frame: int = FRAME, pack: int = PACK) -> DataFrame:
    """Rows of SCHEMA. Null text is empty; null and repeated ids are kept, each row is a document. `marked`: whether its text has a match
    of `marks`. An empty table gives no pack; extra columns aren't read; a text of any length is one document of one pack."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), pc.fill_null(b.column(1), "")
            marked = pc.match_substring_regex(texts, marks)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            held = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + pack, "right")) - 1)
                own = slice(at, to)
                yield _pack(ids[own], marked[own], held[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], frame)
                at = to

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, SCHEMA)


def store(docs: DataFrame, path: str | None = None, **how) -> str:
    """Writes the packs as Parquet, whose own compression is off, and returns the folder: a new one in the shared folder if none is given."""
    path = path or new_path(docs.sparkSession, "frames")
    packs(docs, **how).write.option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP).parquet(path)
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


class Pack:
    """One row of a store. Two frames are held decompressed at most."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        docs, frames = batch.column("docs")[i].values, batch.column("frames")[i].values
        of = lambda rows, k: rows.field(k).to_numpy(zero_copy_only=False)
        total = {k: batch.column(f"n_{k}")[i].as_py() for k in ("chars", "units")} | {"byte": batch.column("n_bytes")[i].as_py()}
        self.ids, self.marked = docs.field("doc_id").to_pylist(), docs.field("marked").to_pylist()
        #: Before each document, and in all at the end.
        self.byte, self.chars, self.units = ([*of(docs, k).tolist(), total[k]] for k in ("byte", "chars", "units"))
        self._full = np.unique([a for a, b in zip(self.byte, self.byte[1:]) if b > a]).astype(np.int64)
        self._at = {k: np.concatenate([of(frames, k), [total[k]]]).astype(np.int64) for k in ("byte", "chars", "units")}
        self._data, self._held = frames.field("data"), {}

    def __len__(self):
        return len(self.ids)

    def frame(self, f: int) -> tuple[bytes, np.ndarray]:
        """(text, where its units start)"""
        if f not in self._held:
            self._held = dict([*self._held.items()][-1:])
            self._held[f] = self._opened(f)
        return self._held[f]

    def _opened(self, f: int) -> tuple[bytes, np.ndarray]:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(self._data[f].as_py())
        at, to = self._at["byte"][f : f + 2]
        firsts = self._full[np.searchsorted(self._full, at) : np.searchsorted(self._full, to)] - at
        found = unit_starts(np.frombuffer(raw, np.uint8), None, firsts)
        if self._at["units"][f + 1] - self._at["units"][f] > len(found):  # the first byte is one too, which the frame alone can't tell
            found = np.concatenate([[0], found])
        return raw, found

    def place(self, doc: int, unit: int) -> tuple[int, int]:
        """(byte in the pack, characters of the document before it) where a document's unit starts; its end for the number of its units."""
        if unit == 0 or unit == self.units[doc + 1] - self.units[doc]:
            return (self.byte[doc], 0) if unit == 0 else (self.byte[doc + 1], self.chars[doc + 1] - self.chars[doc])
        of = self.units[doc] + unit
        f = int(np.searchsorted(self._at["units"], of, "right")) - 1
        raw, found = self.frame(f)
        at = int(found[of - self._at["units"][f]])
        base = int(self._at["byte"][f])
        if base <= self.byte[doc]:
            chars = _chars(np.frombuffer(raw, np.uint8)[self.byte[doc] - base : at])
        else:
            chars = int(self._at["chars"][f]) - self.chars[doc] + _chars(np.frombuffer(raw, np.uint8)[:at])
        return base + at, chars

    def stream(self, start: int, stop: int):
        """The bytes between two places of the pack, frame by frame."""
        f = int(np.searchsorted(self._at["byte"], start, "right")) - 1
        while start < stop:
            base = int(self._at["byte"][f])
            part = memoryview(self.frame(f)[0])[start - base : stop - base]
            yield part
            start, f = start + len(part), f + 1
