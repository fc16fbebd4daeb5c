"""Fill-in-middle over seekable compressed frames.

Texts are stored as frames (frames.py). For each document two cuts are drawn by hash; only the frames that hold them are decompressed
to find their places. Output is a list of marks and stretches of the store, streamed frame by frame in output order: into a digest, or
into a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames

SEED, FIM_RATE, SPM_RATE = 42, 50, 80
#: Marks before the three parts; texts that hold one stay plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The parts' order in the output.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document; a null id is hashed as an empty text."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(raw[i : i + 4], "big") for i in (0, 4, 8, 12)]


def form_of(empty: bool, marked: bool, third: int, fourth: int, fim_rate: int, spm_rate: int) -> str:
    if empty or marked or third % 100 >= fim_rate:
        return "plain"
    return "spm" if fourth % 100 < spm_rate else "psm"


class Output:
    """A document's output: marks (bytes) and stretches of its pack (pairs of places), in order."""

    def __init__(self, pack: frames.Pack, parts: list):
        self.pack, self.parts = pack, parts

    def chunks(self, start: int = 0, stop: int | None = None) -> Iterator[bytes | memoryview]:
        """The bytes from place start to place stop of the output, in pieces of at most a frame."""
        at = 0
        for part in self.parts:
            size = len(part) if isinstance(part, bytes) else part[1] - part[0]
            a, b = max(0, start - at), size if stop is None else min(size, stop - at)
            if a < b:
                if isinstance(part, bytes):
                    yield part[a:b]
                else:
                    yield from self.pack.stream(part[0] + a, part[0] + b)
            at += size

    def text(self) -> str:
        return b"".join(self.chunks()).decode()


def marks_at(output: Output, marks: tuple[bytes, ...]) -> tuple[list[int], int]:
    """(where each mark first stands in the output, the output's length); looks at one chunk and the last bytes before it."""
    found: list[int] = [-1] * len(marks)
    size, tail = 0, b""
    for chunk in output.chunks():
        seen = tail + bytes(chunk)
        for i, m in enumerate(marks):
            if found[i] < 0 and (p := seen.find(m)) >= 0:
                found[i] = size - len(tail) + p
        size += len(chunk)
        tail = seen[-(max(map(len, marks)) - 1) :]
    return found, size


def rebuilt(output: Output, form: str) -> Iterator[bytes | memoryview]:
    """The text again, from an output and its form alone: the parts behind the marks, in the text's order."""
    if form == "plain":
        yield from output.chunks()
        return
    marks = ORDERS[form]
    found, size = marks_at(output, marks)
    ends = dict(zip(marks, [*found[1:], size]))
    starts = {m: p + len(m) for m, p in zip(marks, found)}
    for m in (PREFIX, MIDDLE, SUFFIX):
        yield from output.chunks(starts[m], ends[m])


def _digest(chunks) -> str:
    h = hashlib.sha256()
    for c in chunks:
        h.update(c)
    return h.hexdigest()


def _outputs(batches, seed: int, fim_rate: int, spm_rate: int, more):
    """One batch for each pack: doc_id, n, form, prefix_chars, middle_chars and what `more` makes of (output, form)."""
    for b in batches:
        for i in range(b.num_rows):
            pack = frames.Pack(b, i)
            rows = []
            for d in range(len(pack)):
                n, (start, stop) = pack.units[d + 1] - pack.units[d], pack.byte[d : d + 2]
                h1, h2, h3, h4 = draws(pack.ids[d], seed)
                form = form_of(start == stop, pack.marked[d], h3, h4, fim_rate, spm_rate)
                if form == "plain":
                    out, counts = Output(pack, [(start, stop)]), (None, None)
                else:
                    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
                    (first, before), (last, until) = pack.place(d, a), pack.place(d, z)
                    own = {PREFIX: (start, first), MIDDLE: (first, last), SUFFIX: (last, stop)}
                    out, counts = Output(pack, [x for m in ORDERS[form] for x in (m, own[m])]), (before, until - before)
                rows.append((pack.ids[d], n, form, *counts, *more(out, form)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows))
            kinds += [pa.string()] * (len(columns) - len(kinds))
            yield [pa.array(c, k) for c, k in zip(columns, kinds)]


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]


def _mapped(stored: DataFrame, names: list[str], seed: int, fim_rate: int, spm_rate: int, more) -> DataFrame:
    def run(batches):
        for columns in _outputs(batches, seed, fim_rate, spm_rate, more):
            yield pa.RecordBatch.from_arrays(columns, COLUMNS + names)

    return stored.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, " + ", ".join(f"{n} string" for n in names))


def transformed(stored: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """stored (rows of frames.SCHEMA) -> doc_id, n (units), form, prefix_chars, middle_chars, output: the text to train on, whole.

    plain: the text; psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle. Of 100 documents fim_rate are taken apart, of
    100 of these spm_rate as spm; a text that is null, empty or holds a mark stays plain, its counts of characters are null. Documents are
    told apart by doc_id alone, so equal ids are cut by the same numbers; each row has a row of its own. An empty table gives none.
    """
    return _mapped(stored, ["output"], seed, fim_rate, spm_rate, lambda out, form: (out.text(),))


def digests(stored: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """As transformed, but output_sha256 in place of the output, and restored_sha256, of the text rebuilt from output and form. Both
    stream ordered frames; no text is held whole."""
    return _mapped(stored, ["output_sha256", "restored_sha256"], seed, fim_rate, spm_rate, lambda out, form: (_digest(out.chunks()), _digest(rebuilt(out, form))))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(frames.read_store(spark, frames.store(docs)))


#: Units as a list, cut and joined.
OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:z], '') AS m, array_to_string(u[z + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM p"""
