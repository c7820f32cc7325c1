"""Pseudonyms for personal data with a format-preserving Feistel network, in DataFrame expressions only.

A number is found by its shape and *validated* (check digits of cards, octets of addresses, days of
the calendar) before it is touched.  Its digits are then permuted by a keyed Feistel network whose
domain is the format itself: so many digits, four octets, the valid social security numbers, the days
of 400 years.  The same value therefore gets the same pseudonym in every document, two values never get the
same one, and a pseudonym passes the validation that its original passed.  E-mail addresses, which have no fixed
domain, get a keyed name.

The text is split at the matches, and matches and gaps are joined again in one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the network.
ROUNDS = 8
#: Key of the registered query alone; every other run must bring its own.
QUERY_KEY = "quillgraph-pseudonyms"

# Shapes of personal data.
_LOCAL = r"[\p{L}\p{N}._%+\-]"
SHAPES = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@(?:[A-Za-z0-9\-]+\.){{1,127}}[A-Za-z]{{2,24}}",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "date": r"(?<![\d\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d\-/]\d|\d)",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]\d|\d)",
    "phone": r"(?<!\d)(?:\+\d{1,3}[^\w\n]{0,6}\(?\d{3}\)?[^\w\n]{1,6}|\(\d{3}\)[^\w\n]{0,6}|\d{3}[.\-])\d{3}[ .\-]\d{4}(?!\d)",
}
KINDS = tuple(SHAPES)
ANY = "|".join(f"(?:{SHAPES[k]})" for k in KINDS)

#: Days of a full Gregorian cycle and how the network halves them: DAYS = HIGH * LOW.  Each date stays within
#: its cycle of 400 years; dates outside the whole cycles between these years are left alone.
FIRST_DAY, DAYS, HIGH, LOW = "0200-01-01", 146_097, 5411, 27
LAST_CYCLE = 23  # the one that ends with the year 9799
#: Valid social security numbers: areas 001-665 and 667-899, groups 01-99 and serials 0001-9999.
AREAS, SERIALS = 898, 9999


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _feistel(left: Column, right: Column, m_left: Column, m_right: Column, tweak: Column) -> Column:
    """A keyed permutation of pairs below (m_left, m_right), as a struct (l, r)."""
    prf = lambda r, x: F.conv(F.substring(F.sha2(F.concat_ws("|", tweak, r.cast("string"), x.cast("string")).cast("binary"), 256), 1, 13), 16, 10).cast("bigint")
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    turn = lambda s, r: F.when(r % 2 == 0, F.struct(F.pmod(s["l"] + prf(r, s["r"]), m_left).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + prf(r, s["l"]), m_right).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(digits: Column, tweak: Column) -> Column:
    """Digits to as many digits, one to one under a key and tweak."""

    def of(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        number = lambda s: F.coalesce(F.nullif(s, F.lit("")).cast("bigint"), F.lit(0))
        power = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
        pair = _feistel(number(F.substring(d, F.lit(1), a)), number(F.substring(d, a + 1, n - a)), power(a), power(n - a), F.concat_ws("|", tweak, n.cast("string")))
        digits_of = lambda x, k: F.when(k > 0, F.lpad(x.cast("string"), k, F.lit("0"))).otherwise(F.lit(""))
        return _let(pair, lambda p: F.concat(digits_of(p["l"], a), digits_of(p["r"], n - a)))

    return _let(digits, of)


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number, its last digit taken as the check digit."""

    def term(c: Column, i: Column) -> Column:
        x = c.cast("int")
        return F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, F.lit(9)).otherwise(F.lit(0)))

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), term), F.lit(0), lambda a, x: a + x)


def _filled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in turn by ``digits``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    put = lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(only_digits(F.substring(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(chars, put), "")


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("int"))


def _day(m: Column) -> Column:
    """The date that a match writes (month before day unless only the reverse is a day), or null."""
    iso = lambda y, mo, d: F.concat_ws("-", F.substring(m, y, 4), F.substring(m, mo, 2), F.substring(m, d, 2)).try_cast("date")
    found = F.when(m.contains("/"), F.coalesce(iso(7, 1, 4), iso(7, 4, 1))).otherwise(m.try_cast("date"))
    at = F.datediff(found, F.lit(FIRST_DAY).cast("date"))
    return F.when((at >= 0) & (at < DAYS * (LAST_CYCLE + 1)), found)


def kind_of(m: Column) -> Column:
    """The kind of a match that passes its validation, else null."""
    full = lambda k: m.rlike(f"^(?:{SHAPES[k]})$")
    kinds = F.when(m.contains("@"), F.lit("email"))
    kinds = kinds.when(full("ip"), F.when(F.forall(_octets(m), lambda x: x <= 255), F.lit("ip")))
    kinds = kinds.when(full("date"), F.when(_day(m).isNotNull(), F.lit("date")))
    kinds = kinds.when(full("card"), F.when(luhn_sum(only_digits(m)) % 10 == 0, F.lit("card")))
    kinds = kinds.when(full("ssn"), F.when(~m.rlike("^(000|666|9..)|-00-|-0000$"), F.lit("ssn")))
    return kinds.when(full("phone"), F.lit("phone"))


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    """The pseudonym of a match of a kind; the match itself where the kind is null."""
    tweak = F.concat_ws("|", key, kind)

    def card(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), tweak)
        return _let(body, lambda b: _filled(m, F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))

    ip = _let(_octets(m), lambda o: _let(_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), tweak), lambda p: F.concat_ws(".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)))
    at = F.datediff(_day(m), F.lit(FIRST_DAY).cast("date"))
    cycle, inside = F.floor(at / DAYS), at % DAYS
    day = _let(_feistel(F.floor(inside / LOW), inside % LOW, F.lit(HIGH), F.lit(LOW), F.concat_ws("|", tweak, cycle)), lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (cycle * DAYS + p["l"] * LOW + p["r"]).cast("int")))
    # a month above twelve in first place tells that the match had its day first
    slashed = F.when(F.substring(m, 1, 2).cast("int") > 12, F.lit("dd/MM/yyyy")).otherwise(F.lit("MM/dd/yyyy"))
    date = _let(day, lambda d: F.when(m.contains("/"), F.when(slashed == "dd/MM/yyyy", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))).otherwise(F.date_format(d, "yyyy-MM-dd")))
    # the country code of a phone number stays, the rest is permuted
    code = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    phone = F.concat(code, _filled(rest, permute_digits(only_digits(rest), tweak)))
    part = lambda i, n: F.substring(m, i, n).cast("int")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    serial = (part(5, 2) - 1) * SERIALS + part(8, 4) - 1
    ssn = _let(_feistel(area, serial, F.lit(AREAS), F.lit(99 * SERIALS), tweak), lambda p: F.concat_ws("-", F.lpad((p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(p["r"] / SERIALS) + 1).cast("string"), 2, "0"), F.lpad((p["r"] % SERIALS + 1).cast("string"), 4, "0")))
    email = F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws("|", tweak, F.lower(m)).cast("binary"), 256), 1, 20), F.lit("@pseudonym.invalid"))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "date", date).when(kind == "card", _let(only_digits(m), card)).when(kind == "ssn", ssn).when(kind == "phone", phone).otherwise(m)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, text with pseudonyms, found (was, kind, put) and counts by kind.

    Whoever has the key can link and undo pseudonyms: it must be secret, and an empty one is refused.

    A null text stays null with nothing found; empty texts stay empty.  What fails its validation stays
    as it is.  Repeated rows stay; an empty table gives an empty result; other columns are not read.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    rows = docs.select(id_col, F.col("text").cast("string").alias("text"))
    seen = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    known = rows.withColumn("seen", F.coalesce(seen, F.array().cast("array<string>")))
    put = lambda m: _let(kind_of(m), lambda k: F.struct(m.alias("was"), k.alias("kind"), pseudonym(m, k, F.lit(key)).alias("put")))
    known = known.withColumn("found", F.when(F.size("seen") > 0, F.transform("seen", put)).otherwise(F.array().cast("array<struct<was:string,kind:string,put:string>>")))
    joined = F.array_join(F.zip_with(F.split("text", ANY, -1), "found", lambda g, f: F.concat(g, F.coalesce(f["put"], F.lit("")))), "")
    text = F.when(F.size("seen") > 0, joined).otherwise(F.col("text"))
    count = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return known.select(id_col, text.alias("text"), F.filter("found", lambda f: f["kind"].isNotNull()).alias("found"), *counts)


def op10(spark, sf_dir: str) -> DataFrame:
    found = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_KEY)
    return found.drop("found")
