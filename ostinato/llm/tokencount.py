"""Token counts: Arrow batches go through the tokenizer and only lengths come back.

A batch is cut into steps of about equal bytes. A text of more than PIECE bytes is first cut where no token can lie across, and its
pieces are counted like texts of their own; so a step holds few bytes whatever the texts are. Nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

LIMIT = 1024
#: Bytes of a step, and characters of a piece of a long text.
STEP, PIECE = 1 << 22, 1 << 18
#: Places where both vocabularies of kind .json begin a new word: before a single space or line feed between two printable ASCII
#: characters, and before a mark behind an ASCII letter or digit or a letter of a script without spaces.
_CUT = re.compile("(?<=[!-~])(?=[ \n][!-~])|(?<=[0-9A-Za-zぁ-ゖァ-ヺ一-鿿가-힣])(?=[,.;:!?、。！，：；？])")
#: Characters looked back over at first for a place to cut.
_BACK = 1 << 10


def _last_cut(text: str, after: int, to: int) -> int | None:
    """The last place in (after, to], found by looking back over longer and longer stretches."""
    back = _BACK
    while True:
        found = None
        for m in _CUT.finditer(text, max(after + 1, to - back), min(len(text), to + 2)):
            if m.start() <= to:
                found = m.start()
        if found is not None or to - back <= after:
            return found
        back *= 8


def cut(text: str, size: int = PIECE, special: tuple[str, ...] = ()) -> list[str]:
    """Pieces of at most `size` characters, whose tokens in order are the text's. Where a stretch has no safe place, the piece goes on
    to the next one. No cut lies within a special token's string."""
    inside = [range(m.start() + 1, m.end()) for s in special for m in re.finditer(re.escape(s), text)]
    out, at = [], 0
    while len(text) - at > size:
        to = _last_cut(text, at, at + size)
        if to is None:
            m = _CUT.search(text, at + size)
            to = m.start() if m else len(text)
        while any(to in r for r in inside):  # not with the vocabularies at hand, whose special strings hold no such place
            m = _CUT.search(text, to + 1)
            to = m.start() if m else len(text)
        out.append(text[at:to])
        at = to
    if at < len(text) or not out:
        out.append(text[at:])
    return out


def steps(n_bytes: np.ndarray, size: int = STEP) -> list[tuple[int, int]]:
    """Runs of rows with about equal bytes, as many as keep them at `size` or below; a row of more is a run of its own or ends one."""
    ends = np.cumsum(n_bytes)
    total = int(ends[-1]) if len(ends) else 0
    n = max(1, -(-total // size))
    at = np.searchsorted(ends, [total * i / n for i in range(1, n)], "left") + 1
    at = np.unique(np.concatenate([[0], at, [len(ends)]]))
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


class _Pieces:
    """sentencepiece, whose pieces depend on the whole text: texts aren't cut."""

    special = ()

    def __init__(self, path: str):
        import sentencepiece

        self.of = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: pa.Array):
        found = self.of.encode(pc.fill_null(texts, "").to_pylist(), num_threads=1)
        return None, np.cumsum([len(x) for x in found])


_held: dict[str, _Pieces] = {}


def _counter(path: str):
    """(encoder, whether texts may be cut)"""
    if path.endswith(".json"):
        return tokens.encoder(path), True
    if path not in _held:
        _held[path] = _Pieces(path)
    return _held[path], False


def lengths(path: str, texts: pa.Array, piece: int = PIECE, step: int = STEP) -> np.ndarray:
    """Tokens of each text; null is empty."""
    enc, cuts = _counter(path)
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n_of = np.ones(len(texts), np.int64)
    if cuts and (long := np.flatnonzero(size > piece)).size:
        parts, at = [], 0
        for i in long.tolist():
            own = cut(texts[i].as_py(), piece, tuple(enc.special))
            parts += [texts.slice(at, i - at), pa.array(own, texts.type)]
            at, n_of[i] = i + 1, len(own)
        texts = pa.concat_arrays([*parts, texts.slice(at)])
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n = [np.diff(enc.encode(texts.slice(a, b - a))[1], prepend=0) for a, b in steps(size, step) if b > a]
    ends = np.concatenate([[0], np.cumsum(np.concatenate([*n, np.zeros(0, np.int64)]))])
    row = np.concatenate([[0], np.cumsum(n_of)])
    return ends[row[1:]] - ends[row[:-1]]


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row.

    tokenizer: a .json file of the tokenizers library or a .model file of sentencepiece. Counts are those of the library without begin,
    end or added tokens; a special token's string inside a text counts as the library takes it. Null and empty texts have 0 bytes and
    0 tokens. A null or repeated doc_id stays as it is, equal rows each have a row, an empty table gives none; extra columns aren't read.
    A text of any length is counted whole, a long one in pieces.
    """

    def run(batches):
        for b in batches:
            ids, texts = b.columns
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(lengths(tokenizer, texts))], ["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
