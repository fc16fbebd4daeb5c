"""Token ids by the tokenizers library, encoded once for each distinct piece of text.

Both vocabularies split a text at a single space or line feed between two other characters before anything is merged, and
before the punctuation that follows a word of Latin letters. So the ids of a text are those of its pieces in order. Arrow
splits a batch and numbers its distinct pieces, a worker looks up the ids of those, up to CACHE of which it keeps, and
numpy lays them out. Texts that the rule doesn't cover (runs of white space, special tokens) go a slower way.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; then it forgets all and begins again.
CACHE = 1 << 19
#: Bytes of text that are encoded at once.
STEP = 1 << 22
#: White space as the vocabularies' patterns know it, for re and for Arrow.
_SPACE = "\t-\r \x85\xa0  -     　"
_RUN = re.compile(rf"^[{_SPACE}]+|[{_SPACE}]{{2,}}|[{_SPACE}]+$")
_WIDE = f"[{_SPACE}][{_SPACE}]|^[{_SPACE}]|[{_SPACE}]$"
#: A word of Latin letters whose lower case is one letter everywhere, and marks that begin a piece of their own behind it.
_LATIN = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
_WORD = f"^(?P<word>[{_LATIN}]+)(?P<marks>[.,;:!?#*$%&|]*)$"
_LETTERS = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), _LATIN) + "]+")
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}
_held: dict[str, "Encoder"] = {}


def _listed(x: pa.Array) -> list:
    """As to_pylist, which is slow, of arrays without nulls."""
    return x.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """encode(texts) gives what Tokenizer.encode(text, add_special_tokens=False) gives for each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        #: Whether case, and a space before a word, change nothing.
        self.folds, self.spaced = self._raw("Aé") == self._raw("aé"), self._raw(" a") != self._raw("a")
        self.special = [t.content for t in self.of.get_added_tokens_decoder().values()]
        #: Ids of pieces that begin a line, and of those that follow a space.
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {} if self.spaced else self.first

    def _raw(self, text: str) -> bytes:
        return np.array(self.of.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, cache: dict[str, bytes], new: list[str], before: str) -> None:
        """A word of Latin letters is one pre-token: it needs neither normalizer nor pre-tokenizer, only the model."""
        tokenize, lead = self.of.model.tokenize, before.encode().decode("latin-1").translate(_BYTES) if self.spaced else ""
        plain, lengths, flat = [], [], []
        for p in new:
            if not _LETTERS.fullmatch(p):
                cache[p] = self._raw(before + p)
                continue
            found = tokenize(lead + (p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES)))
            plain.append(p)
            lengths.append(len(found))
            flat += [x.id for x in found]
        raw, at = np.array(flat, "<u4").tobytes(), 0
        for p, n in zip(plain, lengths):
            cache[p] = raw[at : at + 4 * n]
            at += 4 * n

    def _known(self, names: list[str], spaced: bool) -> list[bytes]:
        cache = self.later if spaced else self.first
        found = list(map(cache.get, names))
        if None in found:
            self._learn(cache, [p for p, ids in zip(names, found) if ids is None], " " if spaced else "")
            found = list(map(cache.__getitem__, names))
        return found

    def _ids(self, pieces: pa.Array, spaced: bool) -> list[bytes]:
        """Of distinct pieces: those of the word, once for all its cases and the marks behind it, and those of the marks."""
        cut = pc.extract_regex(pieces, _WORD)
        word, marks = pc.struct_field(cut, "word"), pc.fill_null(pc.struct_field(cut, "marks"), "").dictionary_encode()
        word = pc.coalesce(pc.utf8_lower(word) if self.folds else word, pieces).dictionary_encode()
        own, behind = self._known(_listed(word.dictionary), spaced), [self._raw(m) for m in _listed(marks.dictionary)]
        return [own[i] + behind[j] for i, j in zip(_listed(word.indices), _listed(marks.indices))]

    def _narrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of texts in which no white space stands at an end or beside another, if a space before a word matters."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n " if self.spaced else " "), " ")
        coded, starts = parts.flatten().dictionary_encode(), parts.offsets.to_numpy().astype(np.int64)
        at, pieces = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        if self.spaced:
            feeds = pc.equal(pieces, "\n").to_numpy(zero_copy_only=False)[at]
            head = feeds.copy()
            head[1:] |= feeds[:-1]
            head[starts[:-1]] = True
            value = [b""] * (2 * len(pieces))
            for shift, some in ((0, head), (len(pieces), ~head)):
                used = np.zeros(len(pieces), bool)
                used[at[some]] = True
                used = np.flatnonzero(used)
                for i, ids in zip(used.tolist(), self._ids(pieces.take(pa.array(used)), bool(shift))):
                    value[i + shift] = ids
            at = np.where(head, at, at + len(pieces))
        else:
            value = self._ids(pieces, False)
        n_of = np.fromiter(map(len, value), np.int64, len(value)) // 4
        table, begin = np.frombuffer(b"".join(value), "<u4"), np.cumsum(n_of) - n_of
        n = n_of[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        return table[np.repeat(begin[at] - ends[:-1], n) + np.arange(ends[-1])], ends[starts[1:]]

    def _wide(self, text: str) -> bytes:
        """Of a run of white space before a word all but the last character is one piece; a last space goes with the word."""
        if any(s in text for s in self.special):
            return self._raw(text)
        out, at, after = [], 0, False
        for run in [*_RUN.finditer(text), None]:
            for i, line in enumerate(text[at : run.start() if run else len(text)].split("\n")):
                head, *rest = line.split(" ")
                out += self._known(["\n"], False) * (i > 0) + self._known([head], after and not i) * (head != "") + self._known(rest, True)
            if run:
                white, at = run[0], run.end()
                after = white[-1] == " " and at < len(text)
                cut = [white] if at == len(text) else [white[:-1], "" if after else white[-1]]
                out += [self._raw(x) for x in cut if x]
        return b"".join(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in their order, where each one's end); null is empty."""
        for cache in (self.first, self.later):
            if len(cache) > CACHE:
                cache.clear()
        texts = pc.fill_null(texts, "")
        if not self.spaced:
            return self._narrow(texts)
        odd = pc.match_substring_regex(texts, _WIDE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._narrow(texts)
        ids, ends = self._narrow(pc.if_else(pa.array(odd), "", texts))
        cut = np.split(ids, ends[:-1])
        for i in np.flatnonzero(odd).tolist():
            cut[i] = np.frombuffer(self._wide(texts[i].as_py()), "<u4")
        return np.concatenate(cut), np.cumsum([len(x) for x in cut])


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def encoded(enc: Encoder, texts: pa.Array, end_id: int):
    """(first row, [ids of a text and end_id, as little-endian unsigned 32-bit integers]) of runs of about STEP bytes, or of one text."""
    last = int(end_id).to_bytes(4, "little")
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, STEP + (size[at - 1] if at else 0), "right")))
        ids, ends = enc.encode(texts.slice(at, to - at))
        raw = ids.tobytes()
        yield at, [raw[4 * x : 4 * y] + last for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]
        at = to


crc32 = zlib.crc32
