"""Spellings written down by hand, not taken from the operator's patterns."""

import re

from ostinato.llm import pii

#: Spellings of one value each.
SAME = [
    ["743-555-3824", "743.555.3824", "743 555 3824", "7435553824", "(743) 555-3824"],
    ["123-45-6789", "123 45 6789"],
    ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "gb82 west 1234 5698 7654 32", "gb82west12345698765432"],
    ["2024-01-02", "2024/01/02"],
    ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"],
]
STAY = ["0.7435553824", "1704153600", "1435553824", "743 155 3824", "12 743 555 3824", "743 555 3824 12", "000 45 6789", "1 123 45 6789", "gb82 west 1234 5698 7654 33", "2024/13/02", "1,7435553824", "74355538241"]


def test_spellings(spark):
    values = [v for same in SAME for v in same]
    rows = [(i, f"at {v}.") for i, v in enumerate([*values, *STAY])]
    df = spark.createDataFrame(rows, "i long, t string").coalesce(1)
    once = pii.pseudonymized(df, "k", "t")
    got = {r["i"]: (r["t"], r["_n_values"]) for r in once.collect()}
    at = 0
    for same in SAME:
        bare = set()
        for v in same:
            text, n = got[at]
            new = text[3:-1]
            assert n == 1 and new != v and re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v))), v
            bare.add(re.sub("[^0-9A-Z]", "", new.upper()))
            at += 1
        assert len(bare) == 1, same
    for i, v in enumerate(STAY, len(values)):
        assert got[i] == (f"at {v}.", 0)
    back = pii.pseudonymized(once.drop("_n_values"), "k", "t", back=True)
    assert {r["i"]: r["t"] for r in back.collect()} == dict(rows)
