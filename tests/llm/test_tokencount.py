"""Token counts against the libraries themselves."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ostinato.llm import tokencount

BYTE, WORD, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def odd_texts(n=400):
    rng = random.Random(11)
    parts = ["word", "Word's", "don't", " ", "  ", "\n", "\n\n", "\t", "12", "3.5", ",", "!?", "...", "é", "ß", "Σ", "İ", "中文", "。", "テスト", "한국어", " ", " ", "<|endoftext|>", "<|endof", "\U0001f600", "é", "'s", "'", "|", "\r\n", "\x0b", "_x", "a,b", "a.b"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_have_the_tokens_of_the_text(path):
    t = Tokenizer.from_file(path)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    special = tuple(v.content for v in t.get_added_tokens_decoder().values())
    n_cut = 0
    for text in odd_texts():
        for size in (1, 5, 20):
            pieces = tokencount.cut(text, size, special)
            assert "".join(pieces) == text
            n_cut += len(pieces) > 1
            assert [i for p in pieces for i in ids(p)] == ids(text), (text, pieces)
    assert n_cut > 500


def test_pieces_are_short_and_no_cut_lies_in_a_special_string():
    text = "ab cd, " * 1000
    assert max(map(len, tokencount.cut(text, 50))) <= 50
    assert tokencount.cut("x" * 500, 50) == ["x" * 500] and tokencount.cut("", 50) == [""]
    assert tokencount.cut("aa,<a, b>,bb" * 2, 4, ("<a, b>",)) == ["aa", ",<a, b>,bbaa", ",<a, b>,bb"]


def test_steps_are_balanced_by_bytes():
    n = np.array([1] * 1000 + [400] + [1] * 600)
    got = tokencount.steps(n, 500)
    assert got[0][0] == 0 and got[-1][1] == len(n) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert max(int(n[a:b].sum()) for a, b in got) <= 900 and len(got) == 4
    assert tokencount.steps(np.array([], int)) == []


@pytest.mark.parametrize("piece", [7, tokencount.PIECE])
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_lengths(path, piece):
    t, texts = Tokenizer.from_file(path), [None, "", *odd_texts()]
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert tokencount.lengths(path, pa.array(texts), piece, 300).tolist() == want


def test_sentencepiece():
    import sentencepiece

    sp, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), [None, *odd_texts(50)]
    assert tokencount.lengths(PIECES, pa.array(texts), 7, 300).tolist() == [len(sp.encode(x or "")) for x in texts]


def test_table(spark):
    t = Tokenizer.from_file(BYTE)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r[0], r[1], r[2]) for r in tokencount.op11_token_counts(spark, "/root/testdata/sf0.001").collect()) == want


def test_edges(spark):
    long = "word " * 300_000
    rows = [(None, None, 1), (7, "", 2), (7, "", 2), (None, "a b", 3), (8, long, 4), (9, "x" * 600_000, 5), (10, "<|endoftext|>", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.token_counts(df, BYTE).collect())
    t = Tokenizer.from_file(BYTE)
    want = sorted((str(i), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x, _ in rows)
    assert got == want
    assert tokencount.token_counts(df.limit(0), BYTE).collect() == []
