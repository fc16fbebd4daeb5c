"""Language identification by rank-order n-gram profiles.

A profile is the PROFILE most frequent n-grams (one to three letters, word ends marked) of a language's training texts; a
document's own most frequent n-grams are compared with it by out-of-place distance. Counts cover all training documents:
tasks count their own, Spark sums by (language, n-gram). What is collected is PROFILE n-grams for each language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROFILE = 300
#: Bits of a letter in an n-gram's code; the two bits above three letters hold n. While texts are counted, what is above holds whose.
BITS = 18
SALTS = 16
UNKNOWN = "und"
#: Documents and characters that are counted at once; a longer text is counted by itself, in CHARS at a time.
DOCS, CHARS = 512, 1 << 21
_letters: np.ndarray | None = None


def _codes() -> np.ndarray:
    """A letter's code by its code point, 0 for what is no letter: the code point, or above U+FFFF its number among the letters there."""
    global _letters
    if _letters is None:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        codes = np.arange(0x110000)
        codes[0x10000:] = 0x10000 + np.cumsum(letter[0x10000:])
        _letters = codes * letter
    return _letters


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    return keys[first], np.add.reduceat(n, first)


def _trigrams(owner: np.ndarray, texts: list[str], before: str = "\n", after: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """Counts of (owner, letter before, letter, letter after), 0 for no letter. before, after: the characters around the texts."""
    joined = "\n".join(texts)
    c = _codes()[np.frombuffer((before + joined + after).encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    whose = np.repeat(owner.astype(np.int64), sizes)
    mid = np.nonzero(c[1:-1])[0] + 1
    key = (((whose[mid - 1] << BITS | c[mid - 1]) << BITS | c[mid]) << BITS) | c[mid + 1]
    key.sort()
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


def ngram_counts(owner: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, n) of n-grams, from the trigrams around each letter: those hold the shorter ones too."""
    texts = [t.lower() for t in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    keys, n = [], []
    at = 0
    while at < len(texts):
        if size[at] > CHARS:  # a part's letters are counted with the characters on both sides of it
            t = "\n" + texts[at] + "\n"
            for i in range(1, len(t) - 1, CHARS):
                to = min(i + CHARS, len(t) - 1)
                k, m = _trigrams(owner[at : at + 1], [t[i:to]], t[i - 1], t[to])
                keys.append(k), n.append(m)
            at += 1
            continue
        to, total = at, 0
        while to < len(texts) and to - at < DOCS and (to == at or total + size[to] <= CHARS):
            total += size[to]
            to += 1
        k, m = _trigrams(owner[at:to], texts[at:to])
        keys.append(k), n.append(m)
        at = to
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    tri, m = _summed(np.concatenate(keys), np.concatenate(n))
    low = (1 << BITS) - 1
    who, a, b, c = tri >> 3 * BITS, tri >> 2 * BITS & low, tri >> BITS & low, tri & low
    kinds = [
        (who, 3 << 3 * BITS | (tri & ((1 << 3 * BITS) - 1)), m),
        (who, 2 << 3 * BITS | b << BITS | c, m),
        (who[a == 0], 2 << 3 * BITS | b[a == 0], m[a == 0]),
        (who, 1 << 3 * BITS | b, m),
    ]
    out = []
    for w, code, count in kinds:
        k, s = _summed((w << 3 * BITS) | (code & ((1 << 3 * BITS) - 1)), count)
        tag = int(code[0] >> 3 * BITS) if len(code) else 0
        out.append((k >> 3 * BITS, k & ((1 << 3 * BITS) - 1) | tag << 3 * BITS, s))
    return tuple(np.concatenate(x) for x in zip(*out))


def profiles(docs: DataFrame, text: str, lang: str, size: int = PROFILE) -> dict[str, np.ndarray]:
    """language -> codes of its most frequent n-grams, most frequent first, ties by code."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, DOCS):  # as many owners as the bits above a code tell apart
                part = b.slice(at, DOCS)
                names = part.column(1).dictionary_encode()
                who, code, n = ngram_counts(names.indices.to_numpy(zero_copy_only=False), part.column(0).to_pylist())
                lang = names.dictionary.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(code), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    rows = docs.select(F.col(f"`{text}`"), F.col(f"`{lang}`")).dropna().mapInArrow(run, "lang string, code long, n long")
    counts = rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = [F.col("n").desc(), F.col("code")]
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(SALTS)))
    some = salted.withColumn("r", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("r") <= size)
    top = some.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(*best))).filter(F.col("r") <= size)
    found: dict[str, list] = {}
    for x in sorted(top.select("lang", "r", "code").collect()):
        found.setdefault(x["lang"], []).append(x["code"])
    return {k: np.array(v, np.int64) for k, v in found.items()}


class Ranks:
    """Profiles as one table: rank of each n-gram in each language, `size` where it has none."""

    def __init__(self, of: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(of), size
        self.codes = np.unique(np.concatenate([*of.values(), np.zeros(0, np.int64)]).astype(np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), size, np.int64)
        for j, k in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, of[k]), j] = np.arange(len(of[k]))

    def best(self, texts: list[str]) -> list[tuple[str, float]]:
        who, code, n = ngram_counts(np.arange(len(texts)), texts)
        order = np.lexsort((code, -n, who))
        who, code = who[order], code[order]
        first = np.nonzero(np.concatenate([[True], who[1:] != who[:-1]]))[0] if len(who) else np.zeros(0, np.int64)
        place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        keep = place < self.size
        who, code, place = who[keep], code[keep], place[keep]
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != code] = len(self.codes)
        rank = self.rank[at]
        off = np.where(rank == self.size, self.size, np.abs(rank - place[:, None]))
        total = np.stack([np.bincount(who, off[:, j], len(texts)) for j in range(len(self.langs))], axis=1)
        worst = np.bincount(who, minlength=len(texts)) * self.size
        pick = total.argmin(axis=1)
        return [(self.langs[j], 1 - total[i, j] / worst[i]) if worst[i] else (UNKNOWN, 0.0) for i, j in enumerate(pick)]


def predicted(docs: DataFrame, ranks: Ranks, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, by its text alone.

    Null text, text without a letter, and any text when no language was learned: `und`, 0. Ties go to the first language
    by code point.
    """

    def run(batches):
        for b in batches:
            texts, out = [x or "" for x in b.column(1).to_pylist()], []
            for i in range(0, len(texts), DOCS):
                part = texts[i : i + DOCS]
                out += ranks.best(part) if ranks.langs else [(UNKNOWN, 0.0)] * len(part)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([float(y) for _, y in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = profiles(docs.filter(~held_out() & F.col("doc_id").isNotNull()), "text", "lang")
    out = predicted(docs, Ranks(learned))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
