"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions only.

A value that passes its check (Luhn, calendar, octet range, number ranges) is
permuted by a keyed Feistel network over exactly the values of its format.
The same value becomes the same pseudonym in every document, two values never
become one, and the result passes the same check.  Numbers that fail their
check are left alone.  Mail addresses and hexadecimal secrets, which are
neither numbers nor dates, become keyed digests, linked the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.common import text_of

ROUNDS = 10
# one alternative for each kind; a run is entered at its start only and never given back, so time is linear
_MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3})(?![0-9A-Za-z])"
_PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])"
_SECRET = r"(?<![0-9A-Za-z])(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
PATTERN = "|".join((_MAIL, _PHONE, _SSN, _IP, _DATE, _SECRET, _CARD))

# the days 1800-01-01 to 2199-12-31 are one 400-year cycle: 146097 = 189 * 773
_DAYS = (189, 773)
# (area 001-899 without 666, group 01-99) and serial 0001-9999
_SSN_RANGE = (898 * 99, 9999)


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with ``value`` computed once."""
    return F.transform(F.array(value), fn)[0]


def _round(key: str, kind: str, size: Column, i: Column, half: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), size, i, half).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), modulus)


def feistel(x: Column, y: Column, nx: Column, ny: Column, key: str, kind: str, size: Column) -> Column:
    """Struct (x, y) after the rounds: a permutation of the pairs with 0 <= x < nx, 0 <= y < ny."""
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start,
        lambda s, i: F.when(i % 2 == 0, F.struct(
            F.pmod(s["x"] + _round(key, kind, size, i, s["y"], nx), nx).alias("x"), s["y"].alias("y")))
        .otherwise(F.struct(
            s["x"].alias("x"), F.pmod(s["y"] + _round(key, kind, size, i, s["x"], ny), ny).alias("y"))))


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Another string of as many digits (2 to 36)."""
    def run(d: Column) -> Column:
        n = F.length(d)
        u = (n / 2).cast("int")
        v = n - u
        pair = feistel(F.substr(d, F.lit(1), u).cast("bigint"), F.substr(d, u + 1).cast("bigint"), _ten(u), _ten(v),
                       key, kind, n)
        return _let(pair, lambda p: F.concat(F.lpad(p["x"].cast("string"), u, "0"),
                                             F.lpad(p["y"].cast("string"), v, "0")))
    return _let(digits, run)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum; a valid number's is a multiple of 10."""
    def run(d: Column) -> Column:
        n = F.length(d)

        def add(acc: Column, i: Column) -> Column:
            x = F.substr(d, n - i, F.lit(1)).cast("int")
            twice = x * 2
            return acc + F.when(i % 2 == 0, x).when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return _let(digits, run)


def _fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    end = F.aggregate(
        F.filter(F.split(shape, ""), lambda c: c != ""), start,
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(
            F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))))
    return end["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    def run(d: Column) -> Column:
        body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        check = _let(body, lambda b: F.concat(
            b, F.pmod(F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, _let(check, lambda c: _fill(m, c))).otherwise(m)
    return _let(_digits(m), run)


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the ten national digits are permuted."""
    def run(d: Column) -> Column:
        code = F.length(d) - 10
        new = F.concat(F.substr(d, F.lit(1), code), permute_digits(F.substr(d, code + 1), key, "phone"))
        return _let(new, lambda x: _fill(m, x))
    return _let(_digits(m), run)


def _ssn(m: Column, key: str) -> Column:
    def run(p: Column) -> Column:
        area, group, serial = (F.get(p, F.lit(i)).cast("int") for i in range(3))
        valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
        place = F.when(area > 666, area - 2).otherwise(area - 1)
        pair = feistel(place * 99 + group - 1, serial - 1, F.lit(_SSN_RANGE[0]), F.lit(_SSN_RANGE[1]), key, "ssn",
                       F.lit(9))

        def text(q: Column) -> Column:
            place2 = F.floor(q["x"] / 99)
            area2 = F.when(place2 >= 665, place2 + 2).otherwise(place2 + 1)
            return F.concat_ws("-", F.lpad(area2.cast("string"), 3, "0"),
                               F.lpad((q["x"] % 99 + 1).cast("string"), 2, "0"),
                               F.lpad((q["y"] + 1).cast("string"), 4, "0"))
        return F.when(valid, _let(pair, text)).otherwise(m)
    return _let(F.split(m, "-"), run)


def _ip(m: Column, key: str) -> Column:
    def run(p: Column) -> Column:
        o = [F.get(p, F.lit(i)).cast("int") for i in range(4)]
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip", F.lit(4))

        def text(q: Column) -> Column:
            return F.concat_ws(".", *[x.cast("string") for h in ("x", "y")
                                      for x in (F.floor(q[h] / 256), q[h] % 256)])
        return F.when((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), _let(pair, text)).otherwise(m)
    return _let(F.split(m, r"\."), run)


def _date(m: Column, key: str) -> Column:
    """One day is one value, in whatever of the formats it is written."""
    first = F.lit("1800-01-01").cast("date")

    def with_format(fmt: str) -> Column:
        def run(day: Column) -> Column:
            n = F.date_diff(day, first)
            pair = feistel(F.floor(n / _DAYS[1]), n % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, "date", F.lit(8))
            new = _let(pair, lambda q: F.date_format(
                F.date_add(first, (q["x"] * _DAYS[1] + q["y"]).cast("int")), fmt))
            return F.when((n >= 0) & (n < _DAYS[0] * _DAYS[1]), new)
        return F.coalesce(_let(F.try_to_date(m, fmt), run), m)
    return F.when(m.contains("-"), with_format("yyyy-MM-dd")).when(m.contains("/"), with_format("MM/dd/yyyy")).otherwise(
        with_format("dd.MM.yyyy"))


def _digest(m: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lower(m)).cast("binary"), 256)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of ``PATTERN``; a number that fails its check stays."""
    name = F.translate(F.substring(_digest(m, key, "mail"), 1, 16), "0123456789", "ghijklmnop")
    return (F.when(m.contains("@"), F.concat(name, F.lit("@mail.invalid")))
            .when(m.startswith("+"), _phone(m, key))
            .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(m, key))
            .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), _ip(m, key))
            .when(m.rlike("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$"), _date(m, key))
            .when(m.rlike("[A-Fa-f]"), F.substr(_digest(m, key, "secret"), F.lit(1), F.length(m)))
            .otherwise(_card(m, key)))


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal values in ``text_col`` replaced, and ``n_values`` (long), how many were.

    Texts without digits or ``@`` are passed through untouched.  A null text
    becomes the empty text.  Every row is treated by itself, so repeated rows
    stay repeated, and the result does not depend on order or partitioning.
    """
    text = text_of(text_col)
    names = [c for c in docs.columns if c != "n_values"]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text.alias("body"))
    body = F.col("body")
    found = F.when(body.rlike("[0-9@]"), F.regexp_extract_all(body, F.lit(f"({PATTERN})"), 1)).otherwise(
        F.array().cast("array<string>"))

    def run(s: Column) -> Column:
        new = F.transform(s["found"], lambda m: pseudonym(m, key))
        gaps = F.split(s["body"], PATTERN)
        return _let(new, lambda p: F.struct(
            F.array_join(F.zip_with(gaps, p, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "").alias("text"),
            F.aggregate(F.zip_with(s["found"], p, lambda a, b: (a != b).cast("bigint")), F.lit(0).cast("bigint"),
                        lambda acc, x: acc + x).alias("n")))

    whole = _let(F.struct(found.alias("found"), body.alias("body")), lambda s: F.when(
        F.size(s["found"]) > 0, run(s)).otherwise(F.struct(s["body"].alias("text"), F.lit(0).cast("bigint").alias("n"))))
    return base.select("row", whole.alias("new")).select(
        *[F.col("new.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names],
        F.col("new.n").alias("n_values"))
