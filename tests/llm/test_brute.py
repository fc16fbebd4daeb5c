"""Operators that SQL can't express, against brute force, round trips and held-out accuracy."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from ostinato.llm import embdedup, langid, mixing, packing, pii, simhash, tokenfiles, tokens
from ostinato.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "x<|endoftext|>y <|endoftext|> z", "don't, we'll! it's.", "\ta\tb", "ÉCOLE, straße. ẞ", "a b c", "é a",
    "İstanbul ΣΑΣ. ΟΔΟΣ,", "foo!!\nbar### baz%%%.", "12,345. 7%", "a\r\nb", "x ́y", "'s 't. a's,", "日本語, テスト. 中", "a\x1cb c", "<|startoftext|>. hi,", "Å, Å.", "ab́, cd",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").toPandas()


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


#: Parts of texts whose pieces are hard to tell apart.
PARTS = [
    "a", "B", "é", "İ", "ß", "ǅ", "ŉ", "µ", "ª", "fi", "Σ", "ς", "'s", "'", "don't", "|", "...", "!", "<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "\x1c",
    "\x85", "\xa0", "\u2028", "\u3000", "1", "½", "日本", "\u1112", "\u1161", "e\u0301", "\u0301", "\u0307", "\U0001f600", "-", "word", "The", "\u200b", "\x00", "\u212a", "#", "$5", "\u0323\u0307",
]


@pytest.mark.parametrize("path", [packing.vocabulary(), tokenfiles.vocabulary()])
def test_pieces_give_the_tokenizers_ids(path, docs):
    enc, rng = tokens.Encoder(path), random.Random(7)
    fuzz = ["".join(rng.choice(PARTS) + rng.choice(["", "", " "]) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    for texts in (ODD, docs["text"].tolist(), fuzz):
        got = [np.frombuffer(x, "<u4").tolist() for _, found in tokens.encoded(enc, pa.array([*texts, None]), 7) for x in found]
        want = [e.ids + [7] for e in enc.of.encode_batch([x or "" for x in [*texts, None]], add_special_tokens=False)]
        assert len(got) == len(want)
        for t, x, y in zip(texts, got, want):
            assert x == y, repr(t)[:80]


def ids_of(path, text, end):
    return tokens.Encoder(path).of.encode(text or "", add_special_tokens=False).ids + [end]


def test_packing(spark, docs):
    got = QUERIES["op1_packing"](spark, SF).toPandas()
    of = tokens.Encoder(packing.vocabulary()).of
    want = {}
    for i, t in zip(docs["doc_id"], docs["text"]):
        ids = of.encode(t or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 4096):
            want[i, a // 4096] = (a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1


def best_fit_decreasing(lengths, size):
    """Sequences that plain best-fit decreasing needs."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        gap = gaps.pop(k) if k < len(gaps) else size
        bisect.insort(gaps, gap - n)
    return len(gaps)


LENGTHS = {
    "mixed": lambda r: [*r.integers(1, 4097, 300), *r.integers(1, 300, 1500)], "small": lambda r: r.integers(1, 40, 3000), "large": lambda r: r.integers(1500, 4097, 400), "equal": lambda r: [1500] * 500,
    "ones": lambda r: [1] * 9000, "third": lambda r: [*r.integers(200, 3000, 600), *[1] * 300], "full": lambda r: [4096] * 50, "few": lambda r: [5, 7, 4096],
}


@pytest.mark.parametrize("kind", LENGTHS)
def test_packings_are_as_tight_as_best_fit_decreasing(spark, kind):
    lengths = [int(x) for x in LENGTHS[kind](np.random.default_rng(3))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "doc_id long, length int")
    got = packing.packed(rows).toPandas()
    assert sorted(zip(got["doc_id"], got["length"])) == list(enumerate(lengths))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= 1.02 * best_fit_decreasing(lengths, 4096) + 1


def test_token_files(spark, docs):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op7_token_files"](spark, SF).collect()}
    of, at = tokens.Encoder(tokenfiles.vocabulary()).of, 0
    for i, t in zip(docs["doc_id"], docs["text"]):
        ids = of.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_language_accuracy(spark, docs):
    got = QUERIES["op2_langid"](spark, SF).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    assert ((got["doc_id"].astype(str).map(lambda x: zlib.crc32(x.encode()) % 4) == 2) == got["held_out"]).all()
    assert (got[got["held_out"]]["lang_pred"] == got[got["held_out"]]["lang"]).mean() > 0.95


def test_rank_distance_by_hand():
    ranks = langid.Ranks({"x": np.array([1 << 3 * langid.BITS | ord("a"), 1 << 3 * langid.BITS | ord("b")]), "y": np.array([1 << 3 * langid.BITS | ord("b")])}, size=2)
    who, code, n = langid.ngram_counts(np.array([0]), ["ab a"])
    assert dict(zip(code.tolist(), n.tolist()))[1 << 3 * langid.BITS | ord("a")] == 2
    assert ranks.best(["aa", "", "bb"])[1] == ("und", 0.0)


def test_simhash(spark, docs):
    def brute(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: brute(t) for i, t in zip(docs["doc_id"], docs["text"])}
    ids = list(fp)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3]
    want = least_reachable(ids, links)
    got = QUERIES["op9_simhash"](spark, SF).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {i: (fp[i], want[i]) for i in ids}


def test_simhash_links_in_small_blocks(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    fps = {int(b) for b in base}
    for b in base[:40]:
        x = int(b)
        for _ in range(4):
            x ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False))
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    got = simhash.near_links(df, block=16).collect()
    links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in got]
    assert all((a ^ b).bit_count() <= 3 * len(fps) for a, b in links)
    want = least_reachable(fps, [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3])
    assert least_reachable(fps, links) == want


def linked_by_cosine(x, limit=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.einsum("ik,jk->ij", unit, unit) >= limit
    np.fill_diagonal(near, False)
    return near.sum(axis=1), least_reachable(range(len(x)), np.argwhere(near).tolist())


def test_axes_are_principal(spark):
    """On the axes, what the tasks' sums give is uncorrelated, largest first, whatever the number of tasks."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12)) * np.linspace(3, 0.5, 12) + 1
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>")
    for parts in (1, 7):
        turn = embdedup.axes(df.repartition(parts), 12)
        spread = turn.T @ np.cov(unit.T) @ turn
        assert np.allclose(turn.T @ turn, np.eye(12)) and np.allclose(spread, np.diag(np.diag(spread)), atol=1e-9) and (np.diff(np.diag(spread)) <= 1e-12).all()


@pytest.mark.parametrize("kind", ["double", "float"])
def test_embeddings_in_clusters(spark, kind, monkeypatch):
    """Small blocks, so that the descent has several levels; it keeps clusters that lie apart from one another."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(embdedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24)) * np.array([4.0] * 6 + [1.0] * 18)
    x = (centres[rng.integers(0, 40, 900)] + rng.normal(size=(900, 24)) * rng.choice([0.02, 0.1, 0.4], (900, 1))).astype(np.float32).astype(float)
    x = np.concatenate([x, x[:60], 3 * x[60:90]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>").withColumn("label", F.lit(0))
    seen, near_blocks = [], embdedup._near_blocks
    monkeypatch.setattr(embdedup, "_near_blocks", lambda blocks, *a: seen.append((blocks.count(), near_blocks(blocks, *a).count())) or near_blocks(blocks, *a))
    n, least = linked_by_cosine(x)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.embedding_groups(df).collect()}
    assert got == {i: (int(n[i]), least[i], least[i] == i) for i in range(len(x))}
    assert n.sum() > 1000 and seen[0][0] > 16 * embdedup.FAN // 2 and seen[0][1] < 0.3 * seen[0][0] ** 2 / 2


def test_embeddings_of_the_table(spark):
    """The table's own vectors, at a cosine that links some of them."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(rows["embedding"]).astype(float)
    n, least = linked_by_cosine(x, 0.4)
    got = embdedup.embedding_groups(spark.read.parquet(f"{SF}/embeddings.parquet"), cosine=0.4).toPandas().sort_values("vec_id")
    ids = rows["vec_id"].tolist()
    assert n.sum() > 10 and got["n_links"].tolist() == n.tolist() and got["component_id"].tolist() == [ids[least[i]] for i in range(len(ids))]


@pytest.mark.parametrize(("shard", "wing"), [(mixing.SHARD_TOKENS, mixing.WING), (512, 3)])
def test_mixing(spark, docs, shard, wing, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", shard)
    monkeypatch.setattr(mixing, "WING", wing)
    got = QUERIES["op5_mixing"](spark, SF).toPandas()
    again = QUERIES["op5_mixing"](spark, SF).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    size = docs.assign(n=docs["text"].fillna("").map(lambda t: len(t.encode().split())))
    assert dict(zip(got["doc_id"], got["size"])) == dict(zip(size["doc_id"], size["n"]))
    by = size.groupby("source")["n"].sum().sort_index(key=lambda k: k.map(lambda s: s.encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(by.index)}
    full, total = set(), 1.5 * by.sum()
    while True:
        rate = (total - 2 * sum(by[s] for s in full)) / sum(weight[s] for s in by.index if s not in full)
        more = {s for s in by.index if s not in full and weight[s] * rate > 2 * by[s]}
        if not more:
            break
        full |= more
    merged = got.merge(docs[["doc_id", "source"]], on="doc_id")
    for s, g in merged.groupby("source"):
        target = 2 * by[s] if s in full else weight[s] * rate
        assert g["target"].iloc[0] == pytest.approx(target) and (g["taken"] <= 2 * g["size"]).all()
        assert abs(g["taken"].sum() - target) <= (3 if wing == mixing.WING and wing > 3 else 2 * by[s] / shard + 3) * mixing.BLOCK


def test_pseudonyms(spark):
    values = [
        "hein.19@mail5.example.com", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "152.143.123.131", "2024-02-29", "31/12/1999", "31.12.1999", "123-45-6789", "4111 1111 1111 1111",
        "4111-1111-1111-1111", "+1 (743) 555-3824", "GB82 WEST 1234 5698 7654 32", "+1 743 555 3824", "743-555-3824", "(743) 555-3824", "+17435553824", "743.555-3824", "+49 30 901820",
    ]
    stay = ["29.02.2023", "4111111111111112", "GB82 WEST 1234 5698 7654 33", "999.1.1.1", "3.1", "12345"]
    df = spark.createDataFrame([(f"see {v}, twice {v}.",) for v in values + stay], "t string")
    once = pii.pseudonymized(df, "k", "t")
    out = [r["t"] for r in once.collect()]
    for v, o in zip(values, out):
        assert v not in o and o.split(", twice ")[0][4:] == o.split(", twice ")[1][:-1]
    assert out[len(values) :] == [f"see {v}, twice {v}." for v in stay]
    back = pii.pseudonymized(once.drop("_n_values"), "k", "t", back=True)
    assert [r["t"] for r in back.collect()] == [f"see {v}, twice {v}." for v in values + stay]
    digits = [o.split(", twice ")[0][4:].replace(" ", "").replace("-", "") for o in out[7:9]]
    assert digits[0] == digits[1]  # one number, in two ways to write it
    local = [re.sub(r"\D", "", out[i].split(", twice ")[0][4:].removeprefix("+1")) for i in (9, *range(11, 16))]
    assert len(set(local)) == 1 and out[9][4:6] == "+1"


def plain_feistel(values, sizes, tweak, key):
    values, half = list(values), len(values) // 2
    for r in range(pii.ROUNDS):
        mine = range(half) if r % 2 == 0 else range(half, len(values))
        side = [v for i, v in enumerate(values) if i not in mine]
        digest = hashlib.sha256("|".join([key, tweak, str(r), ",".join(map(str, side))]).encode()).hexdigest()
        for i in mine:
            if sizes[i] > 1:
                values[i] = (values[i] + int(hashlib.sha256(f"{digest}|{i}".encode()).hexdigest()[:12], 16)) % sizes[i]
    return values


def plain_spelled(text, alphabet, tweak, key):
    sets = [alphabet(c) for c in text]
    out = plain_feistel([max(0, a.find(c)) for a, c in zip(sets, text)], [max(1, len(a)) for a in sets], tweak, key)
    return "".join(a[v] if a else c for a, c, v in zip(sets, text, out))


def plain_laid(value, plain):
    it = iter(plain)
    return "".join(next(it) if re.match("[0-9A-Za-z]", c) else c for c in value)


def luhn(n):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n)))


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def plain_kind(value):
    for kind in ("email", "secret", "ip", "date", "ssn", "iban", "phone", "card"):
        if re.fullmatch(pii.FORMATS[kind], value, re.ASCII):
            return kind


def plain_pseudonym(value, key):
    """What the operator's docstrings say, one value at a time; None where check digits fail."""
    kind, plain = plain_kind(value), re.sub("[^0-9A-Za-z]", "", value)
    group = lambda c: next((a for a in (pii.DIGITS, pii.LOWER, pii.UPPER) if c in a), "")
    if kind == "email":
        name, at, domain = value.partition("@")
        return plain_spelled(name, group, kind, key) + at + domain
    if kind == "secret":
        return plain_spelled(value, lambda c: pii.HEX if re.fullmatch("[0-9a-f]+", value) else pii.HEX_UPPER, kind, key)
    if kind == "ip":
        return ".".join(map(str, plain_feistel(list(map(int, value.split("."))), [256] * 4, kind, key)))
    if kind == "date":
        form = f"%Y{value[4]}%m{value[4]}%d" if value[4] in "-/" else f"%d{value[2]}%m{value[2]}%Y"
        try:
            n = (datetime.strptime(value, form) - datetime(1900, 1, 1)).days
        except ValueError:
            return value
        a, b = plain_feistel(divmod(n, 4297), [17, 4297], kind, key)
        return (datetime(1900, 1, 1) + timedelta(days=a * 4297 + b)).strftime(form)
    if kind == "ssn":
        a, b, c = map(int, re.split("[ -]", value))
        x, y, z = plain_feistel([a - 1 - (a > 666), b - 1, c - 1], [898, 99, 9999], kind, key)
        return value[3].join((f"{x + 1 + (x >= 665):03d}", f"{y + 1:02d}", f"{z + 1:04d}"))
    if kind == "iban" and mod97(plain) == 1:
        upper = plain.upper()
        account = plain_spelled(upper[4:], group, kind, key)
        new = upper[:2] + f"{98 - mod97(upper[:2] + '00' + account):02d}" + account
        return plain_laid(value, new.lower() if value[0].islower() else new)
    if kind == "phone":
        lead = re.match(r"\+(?:1(?=(?:[ .()-]*\d){10}$)|\d{1,3}(?=[ .(-]))|", value)[0]
        rest = value[len(lead) :]
        return lead + plain_laid(rest, plain_spelled(re.sub(r"\D", "", rest), lambda c: pii.HIGH if c >= "2" else "01", kind, key))
    if kind == "card" and luhn(plain) % 10 == 0:
        body = plain_spelled(plain[:-1], lambda c: pii.DIGITS, kind, key)
        return plain_laid(value, body + str(-luhn(body + "0") % 10))


def plain_rewritten(value, key):
    known = plain_pseudonym(value, key)
    if known is not None:
        return known
    groups, out, at = re.findall("[ -]?[0-9A-Za-z]+", value), "", 0
    while at < len(groups):
        for to in range(min(len(groups), at + 19), at, -1):
            run = re.sub("^[ -]", "", "".join(groups[at:to]))
            if plain_kind(run) in ("iban", "card") and (new := plain_pseudonym(run, key)) is not None:
                out, at = out + re.match("[ -]?", groups[at])[0] + new, to
                break
        else:
            out, at = out + groups[at], at + 1
    return out


def test_pseudonyms_of_all_documents(spark, docs):
    want = {}
    for i, t in zip(docs["doc_id"], docs["text"]):
        values = []
        new = t if t is None else re.sub(pii.ANY, lambda m: values.append((m[0], plain_rewritten(m[0], pii.QUERY_KEY))) or values[-1][1], t, flags=re.ASCII)
        want[i] = (sum(a != b for a, b in values), new)
    got = {r["doc_id"]: (r["n_values"], r["text"]) for r in QUERIES["op6_pii"](spark, SF).collect()}
    assert sum(n for n, _ in want.values()) > 20
    for i in want:
        assert got[i] == want[i], i


def test_feistel_is_one_to_one(spark):
    from pyspark.sql import functions as F

    syms = F.array(*[F.struct((F.floor(F.col("id") / d) % n).cast("bigint").alias("v"), F.lit(n).cast("bigint").alias("n")) for d, n in ((1, 3), (3, 5), (15, 4))])
    df = spark.range(60).select(syms.alias("s"))
    df = df.select("s", pii.feistel(F.col("s"), F.lit("t"), "k").alias("o"))
    df = df.select("s", "o", pii.feistel(F.col("o"), F.lit("t"), "k", back=True).alias("b")).collect()
    assert len({tuple(x["v"] for x in r["o"]) for r in df}) == 60 and all(r["s"] == r["b"] for r in df)


def test_pipeline(spark, docs):
    """The run as a whole gives sequences of documents of the table; test_stages.py compares each stage with brute force."""
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got["doc_id"]) <= set(docs["doc_id"])
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096


def plain_counts(text):
    """n-grams of one to three letters with an edge for what is no letter beside them, as the profiles count them."""
    out, t = Counter(), "\n" + text.lower() + "\n"
    for i in range(1, len(t) - 1):
        a, b, c = (x if x.isalpha() else "" for x in t[i - 1 : i + 2])
        if b:
            out.update([(3, a, b, c), (2, b, c), (1, b)] + [(2, "", b)] * (not a))
    return out


def test_large_texts_in_slices(monkeypatch):
    texts = ["ab abc x. " * 40, "Ünï\U00020000\U00020001 \U00030000\U00020001ß İi ", "", "\n", "日本語 日本"]
    code = {0: ""} | {int(langid._codes()[ord(x)]): x for t in texts for x in t.lower() if x.isalpha()}
    for chars in (langid.CHARS, 7, 1):
        monkeypatch.setattr(langid, "CHARS", chars)
        got = [Counter() for _ in texts]
        low = (1 << langid.BITS) - 1
        for who, x, n in zip(*[v.tolist() for v in langid.ngram_counts(np.arange(len(texts)), texts)]):
            size = x >> 3 * langid.BITS
            got[who][(size, *[code[x >> i * langid.BITS & low] for i in range(size)][::-1])] += n
        assert got == [plain_counts(t) for t in texts]


def test_languages_by_a_plain_loop(spark, docs):
    """Profiles and predictions of the whole table again, one document at a time."""
    learned = {}
    for i, t, lang in zip(docs["doc_id"], docs["text"], docs["lang"]):
        if lang and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            learned.setdefault(lang, Counter()).update(plain_counts(t))
    order = lambda c: sorted(c, key=lambda g: (-c[g], g[0], *[ord(x) if x else 0 for x in g[1:]]))[: langid.PROFILE]
    ranks = {k: {g: r for r, g in enumerate(order(c))} for k, c in sorted(learned.items())}
    want = {}
    for i, t in zip(docs["doc_id"], docs["text"]):
        own = order(plain_counts(t or ""))
        far = {k: sum(abs(r - p) if (p := of.get(g)) is not None else langid.PROFILE for r, g in enumerate(own)) for k, of in ranks.items()}
        best = min(far, key=lambda k: far[k])
        want[i] = (best, 1 - far[best] / (len(own) * langid.PROFILE)) if own else ("und", 0.0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in QUERIES["op2_langid"](spark, SF).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_oracles(spark):
    import duckdb

    from ostinato.llm.queries import ORACLES

    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in ORACLES.items():
        want = c.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect()) == sorted(want.fetchall()), name
