"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A value that is found and validated is read as a list of symbols, each with its radix (a digit 10, an octet 256, a date's
day number in two parts), and an alternating Feistel network permutes it within exactly that format. Under one key equal
values get equal pseudonyms everywhere, different values different ones, and the key's holder can go back. All of it is
one projection of built-in functions: no shuffle, no join table of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, LOWER, UPPER, HEX, HEX_UPPER, HIGH = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEF", "23456789"
#: Formats, tried from the left at each place. Spaces alone or nothing between its digits make a number a telephone or social security
#: number only if it stands apart from other digits and, for telephones, if area and exchange begin with 2 to 9.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?:(?:19|20)\d\d-\d\d-\d\d|(?:19|20)\d\d/\d\d/\d\d|\d\d[./]\d\d[./](?:19|20)\d\d)(?![\w]|[./-]\d)",
    "iban": r"(?<![0-9A-Za-z])(?:[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d\d(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?![0-9A-Za-z])",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w]|-\d)|(?<![\w-])(?<!\d[ -])(?!000|666|9)\d{3} (?!00)\d\d (?!0000)\d{4}(?![\w]|[ -]\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3,4}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)"
    r"|(?<![\w+.,-])(?<!\d[ -])[2-9]\d\d(?: [2-9]\d\d |[2-9]\d\d)\d{4}(?![\w]|[ .,-]\d)",
    "card": r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)",
}
ANY = "|".join(f"(?:{p})" for p in FORMATS.values())
#: 1900-01-01 to 2099-12-31 are 17 x 4297 days.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(symbols: Column, tweak: Column, key: str, back: bool = False) -> Column:
    """symbols: array<struct<v, n>>, 0 <= v < n. Even rounds shift the left half by the right one's digest, odd ones the
    other way; each round is one-to-one, so the whole permutes the format. back: the inverse.

    A round takes two steps of the fold, so that its digest is computed once and not for each symbol.
    """

    def one(acc: Column, step: Column) -> Column:
        state, round_ = acc["s"], F.floor(step / 2).cast("int")
        r = (F.lit(ROUNDS - 1) - round_) if back else round_
        left, half = r % 2 == 0, F.floor(F.size(state) / 2).cast("int")
        side = F.transform(F.filter(state, lambda x, i: F.when(left, i >= half).otherwise(i < half)), lambda x: x["v"].cast("string"))
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(side, ",")).cast("binary"), 256)

        def moved(x: Column, i: Column) -> Column:
            shift = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", acc["d"], i.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("bigint"), x["n"])
            mine = F.when(left, i < half).otherwise(i >= half) & (x["n"] > 1)
            v = F.when(mine, F.pmod(x["v"] - shift, x["n"]) if back else (x["v"] + shift) % x["n"]).otherwise(x["v"])
            return F.struct(v.cast("bigint").alias("v"), x["n"].alias("n"))

        look = F.struct(state.alias("s"), digest.alias("d"))
        return F.when(step % 2 == 0, look).otherwise(F.struct(F.transform(state, moved).alias("s"), acc["d"].alias("d")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), F.struct(symbols.alias("s"), F.lit("").alias("d")), one, lambda a: a["s"])


def _symbol(v: Column, n: Column) -> Column:
    return F.struct(v.cast("bigint").alias("v"), n.cast("bigint").alias("n"))


def _spelled(value: Column, alphabet, tweak: Column, key: str, back: bool) -> Column:
    """Characters permuted within the alphabets that alphabet(character, place) names; "" leaves one as it is."""
    letters = F.transform(F.split(value, ""), lambda c, i: F.struct(c.alias("c"), alphabet(c, i).alias("a")))

    def spell(known: Column) -> Column:
        symbols = F.transform(known, lambda x: _symbol(F.greatest(F.lit(0), F.position(x["c"], x["a"]) - 1), F.greatest(F.lit(1), F.length(x["a"]))))
        out = feistel(symbols, tweak, key, back)
        return F.array_join(F.zip_with(known, out, lambda x, y: F.when(x["a"] == "", x["c"]).otherwise(F.substr(x["a"], (y["v"] + 1).cast("int"), F.lit(1)))), "")

    return _let(letters, spell)


def _class(c: Column) -> Column:
    return F.when(c.between("0", "9"), DIGITS).when(c.between("a", "z"), LOWER).when(c.between("A", "Z"), UPPER).otherwise("")


def _luhn(digits: Column) -> Column:
    """Sum of a number whose last digit is the check digit."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c: c.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    """The rest of an IBAN (country and check digits moved behind, letters as numbers) by 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    return F.aggregate(
        F.split(moved, ""), F.lit(0),
        lambda a, c: (F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97).cast("int"),
    )


def _in_place(value: Column, plain: Column) -> Column:
    """The characters of `plain` in the places that letters and digits have in value."""
    at = F.aggregate(
        F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["s"], F.substr(plain, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))),
        lambda a: a["s"],
    )
    return at


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one found value, or the value itself where its check digits or its date are not valid."""
    whole = lambda kind: value.rlike(f"^(?:{FORMATS[kind]})$")
    spelled = lambda v, alphabet, kind: _spelled(v, alphabet, F.lit(kind), key, back)
    plain = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    at = F.instr(value, "@")
    email = F.concat(spelled(F.substr(value, F.lit(1), at - 1), lambda c, i: _class(c), "email"), F.substr(value, at))
    secret = F.when(value.rlike("^[0-9a-f]+$"), spelled(value, lambda c, i: F.lit(HEX), "secret")).otherwise(spelled(value, lambda c, i: F.lit(HEX_UPPER), "secret"))
    numbers = lambda v, sep: F.transform(F.split(v, sep), lambda x: x.cast("bigint"))
    octets = feistel(F.transform(numbers(value, r"\."), lambda x: _symbol(x, F.lit(256))), F.lit("ip"), key, back)
    ip = F.array_join(F.transform(octets, lambda x: x["v"].cast("string")), ".")
    # dates: the day's number, split in two symbols
    iso, slashed, dotted = value.rlike("^....-"), value.rlike("^..../"), F.substr(value, F.lit(3), F.lit(1))
    day = F.when(iso, F.try_to_date(value, "yyyy-MM-dd")).when(slashed, F.try_to_date(value, "yyyy/MM/dd")).when(dotted == ".", F.try_to_date(value, "dd.MM.yyyy")).otherwise(F.try_to_date(value, "dd/MM/yyyy"))
    number = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    pair = feistel(F.array(_symbol(F.floor(number / DAYS[1]), F.lit(DAYS[0])), _symbol(number % DAYS[1], F.lit(DAYS[1]))), F.lit("date"), key, back)
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), _let(pair, lambda q: (F.get(q, F.lit(0))["v"] * DAYS[1] + F.get(q, F.lit(1))["v"]).cast("int")))
    date = F.when(iso, F.date_format(moved, "yyyy-MM-dd")).when(slashed, F.date_format(moved, "yyyy/MM/dd")).when(dotted == ".", F.date_format(moved, "dd.MM.yyyy")).otherwise(F.date_format(moved, "dd/MM/yyyy"))
    # social security numbers: area 001-899 without 666, group 01-99, serial 0001-9999
    part = lambda i: F.substr(plain, F.lit((1, 4, 6)[i - 1]), F.lit((3, 2, 4)[i - 1])).try_cast("bigint")
    area = part(1) - F.when(part(1) > 666, 2).otherwise(1)
    three = feistel(F.array(_symbol(area, F.lit(898)), _symbol(part(2) - 1, F.lit(99)), _symbol(part(3) - 1, F.lit(9999))), F.lit("ssn"), key, back)
    v = lambda q, i: F.get(q, F.lit(i))["v"]
    ssn = _let(three, lambda q: _in_place(value, F.format_string("%03d%02d%04d", v(q, 0) + F.when(v(q, 0) >= 665, 2).otherwise(1), v(q, 1) + 1, v(q, 2) + 1)))
    # telephone numbers: a country code stays; the digits alone are permuted, so that all spellings of a number stay linked; a digit
    # from 2 stays one
    lead = F.regexp_extract(value, r"^\+(?:1(?=(?:[ .()-]*\d){10}$)|\d{1,3}(?=[ .(-]))", 0)
    rest = F.substr(value, F.length(lead) + 1)
    local = spelled(F.regexp_replace(rest, "[^0-9]", ""), lambda c, i: F.when(c.between("2", "9"), HIGH).otherwise("01"), "phone")
    phone = F.concat(lead, _let(local, lambda n: _in_place(rest, n)))
    # cards: all digits but the last, which is the Luhn check digit
    body = spelled(F.substr(plain, F.lit(1), F.length(plain) - 1), lambda c, i: F.lit(DIGITS), "card")
    check = lambda b: F.pmod(10 - _luhn(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = F.when(_luhn(plain) % 10 == 0, _let(body, lambda b: _in_place(value, F.concat(b, check(b))))).otherwise(value)
    # accounts: as written in capitals, so that both spellings stay linked
    capital = F.upper(plain)
    country = F.substr(capital, F.lit(1), F.lit(2))
    account = spelled(F.substr(capital, F.lit(5)), lambda c, i: _class(c), "iban")
    checked = lambda a: F.lpad((98 - _mod97(F.concat(country, F.lit("00"), a))).cast("string"), 2, "0")
    written = lambda x: F.when(value.rlike("^[a-z]"), F.lower(x)).otherwise(x)
    iban = F.when(_mod97(capital) == 1, _let(account, lambda a: _in_place(value, written(F.concat(country, checked(a), a))))).otherwise(value)
    return (
        F.when(at > 0, email).when(whole("secret"), secret).when(whole("ip"), ip)
        .when(whole("date"), F.coalesce(date, value)).when(whole("ssn"), ssn).when(whole("iban"), iban).when(whole("phone"), phone).otherwise(card)
    )


def _valid(value: Column) -> Column:
    """Whether all of value is a card or IBAN number with right check digits."""
    plain = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    whole = lambda kind: value.rlike(f"^(?:{FORMATS[kind]})$")
    return F.when(whole("iban"), _mod97(F.upper(plain)) == 1).when(whole("card"), _luhn(plain) % 10 == 0).otherwise(False)


def rewritten(value: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a found value; where its check digits fail, the valid cards and IBANs inside have theirs: from the left,
    at each group of characters, the longest one that ends with a group. What is around them stays."""
    groups = F.regexp_extract_all(value, F.lit("[ -]?[0-9A-Za-z]+"), F.lit(0))

    def inside(g: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            last = F.least(F.size(g), i + 19)
            ends = F.sequence(last, i + 1, F.lit(-1))
            run = lambda to: F.regexp_replace(F.array_join(F.slice(g, i + 1, to - i), ""), "^[ -]", "")
            to = F.get(F.filter(ends, lambda e: _valid(run(e))), F.lit(0))
            sep = F.regexp_extract(F.get(g, i), "^[ -]", 0)
            found = lambda e: F.when(
                e.isNull(), F.struct(F.concat(acc["s"], F.get(g, i)).alias("s"), (i + 1).alias("next"))
            ).otherwise(F.struct(F.concat(acc["s"], sep, pseudonym(run(e), key, back)).alias("s"), e.alias("next")))
            return F.when(i < acc["next"], acc).otherwise(_let(to, found))

        return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), F.struct(F.lit("").alias("s"), F.lit(0).alias("next")), step, lambda a: a["s"])

    other = F.lit(False)
    for kind in ("email", "secret", "ip", "date", "ssn"):
        other = other | value.rlike(f"^(?:{FORMATS[kind]})$")
    phone = ~value.rlike(f"^(?:{FORMATS['iban']})$") & value.rlike(f"^(?:{FORMATS['phone']})$")
    return F.when(other | phone | _valid(value), pseudonym(value, key, back)).otherwise(_let(groups, inside))


def pseudonymized(docs: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """docs with `text` rewritten under a secret key and one more column `_n_values`: values that were replaced.

    Null text stays null, with 0. An e-mail address keeps its domain, a telephone number its country code; a digit of it from 2 to 9 stays
    one of these, 0 and 1 stay 0 or 1, so that a pseudonym is a number of the same kind. Where a card's or IBAN's match takes in groups that don't belong to it, the valid number inside
    is replaced. Going back finds such a number unless its pseudonym happens to be valid with a neighbouring group too. Numbers that
    fail their check digits, impossible dates and version-like numbers stay as they are. Repeated rows get equal results; other columns pass through; a column `_n_values` in the input is replaced.
    """
    t = F.col(f"`{text}`")
    keep = [c for c in docs.columns if c not in ("_n_values", text)]
    rest = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_zero")).alias("_row")
    found = docs.select(rest, t.alias("_t"), F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).alias("_found"))
    found = found.select("_row", "_t", "_found", F.when(F.size("_found") > 0, F.transform("_found", lambda x: rewritten(x, key, back))).alias("_new"))
    between = F.when(F.col("_new").isNotNull(), F.split("_t", ANY))
    found = found.select("_row", "_t", "_found", "_new", between.alias("_between"))
    joined = F.array_join(F.zip_with("_between", F.concat("_new", F.array(F.lit(""))), lambda x, y: F.concat(x, y)), "")
    changed = F.size(F.filter(F.zip_with("_found", "_new", lambda x, y: x != y), lambda x: x))
    n = F.when(F.col("_new").isNull(), 0).otherwise(changed).cast("long")
    out = [F.when(F.col("_new").isNull(), F.col("_t")).otherwise(joined).alias(c) if c == text else F.col(f"_row.{c}") for c in docs.columns if c != "_n_values"]
    return found.select(*out, n.alias("_n_values"))


#: Of the registered query alone; whoever uses the operator gives a secret one.
QUERY_KEY = "key of the registered query"


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymized(docs, QUERY_KEY).select("doc_id", F.col("_n_values").alias("n_values"), "text")
