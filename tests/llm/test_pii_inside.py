"""Valid numbers inside matches that as a whole fail their check digits."""

from ostinato.llm import pii


def test_valid_numbers_with_groups_around_them(spark):
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    cases = [("", card, " 123"), ("", iban, " CALL"), ("12 ", card, ""), ("", "3782 822463 10005", " 4111"), ("", "4111-1111-1111-1111", " 12")]
    stay = ["4111 1111 1111 1112 123", "ES91 2100 0418 4502 0005 1333 CALL"]
    df = spark.createDataFrame([(f"see {a}{v}{b}.",) for a, v, b in cases] + [(f"see {x}.",) for x in stay], "t string").coalesce(1)
    out = pii.pseudonymized(df, "k", "t").collect()
    for (a, v, b), r in zip(cases, out):
        assert r["_n_values"] == 1 and v not in r["t"] and len(r["t"]) == len(f"see {a}{v}{b}.")
        assert r["t"].startswith(f"see {a}") and r["t"].endswith(f"{b}.")
    assert [r["t"] for r in out[len(cases) :]] == [f"see {x}." for x in stay]
