"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Values are found by pattern and validated. Their digits (of e-mail addresses, the letters and digits
before the @) are then permuted among the values of the same form by a Feistel network over two
parts, keyed by SHA-256: equal values get equal pseudonyms in all documents, different values
different ones, and separators stay. What makes a value valid is kept: card numbers pass the Luhn
check, addresses have four bytes, social security numbers no void part, and dates are dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.names import col

from .common import fresh
from .fingerprint import let

#: Rounds, alternately on the left and the right part.
ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31; other dates aren't taken for personal. Two parts that hold them.
FIRST_DAY, DAYS, DAY_PARTS = "1900-01-01", 73049, (271, 270)
#: Steps of a walk until a date is in the range again; all but one in 10^25 walks are shorter.
WALK = 64
#: Social security numbers: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Alternatives in the order in which they are tried at a place. All bounded, so matching is linear in the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d|[./-]\d)",
    "card": r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\d.+-])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d|[.-]\d)",
}
ANY = "|".join(PATTERNS.values())


def feistel(value: Column, left: Column, right: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of the numbers below left * right, both parts below 2^31."""

    def added(part: Column, other: Column, size: Column, i: Column) -> Column:
        hashed = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), other.cast("string")), 256)
        return F.pmod(part + F.pmod(F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long"), size), size)

    def turn(s: Column, i: Column) -> Column:
        odd = F.pmod(i, F.lit(2)) == 1
        return F.when(odd, _pair(added(s["l"], s["r"], left, i), s["r"])).otherwise(_pair(s["l"], added(s["r"], s["l"], right, i)))

    start = _pair(F.round((value - F.pmod(value, right)) / right), F.pmod(value, right))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * right + s["r"])


def _pair(l: Column, r: Column) -> Column:  # noqa: E741
    return F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))


def _number(digits: Column, base: int, tweak: Column, key: str) -> Column:
    """A string of digits of ``base``, permuted among all of its length (at most 18 of base 10, 11 of base 36)."""
    power = lambda n: F.get(F.array(*[F.lit(base**k).cast("long") for k in range(10 if base == 10 else 7)]), n)
    n = F.length(digits)
    low = F.floor((n + 1) / 2).cast("int")

    def parts(left: Column, right: Column) -> Column:
        high = F.conv(F.concat(F.lit("0"), F.substr(digits, F.lit(1), n - low)), base, 10).cast("long")
        value = high * right + F.conv(F.substr(digits, n - low + 1, low), base, 10).cast("long")
        return let(value, lambda v: feistel(v, left, right, F.concat_ws(":", tweak, n.cast("string")), key))

    mixed = let(power(n - low), lambda left: let(power(low), lambda right: parts(left, right)))
    return let(mixed, lambda v: F.lpad(F.lower(F.conv(v.cast("string"), 10, base)), n, "0"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _fill(value: Column, digits: Column) -> Column:
    """The digits in the places of the value's own; a value ends with a digit."""
    at = F.regexp_extract_all(value, F.lit(r"\D*\d"), F.lit(0))
    return F.array_join(F.transform(at, lambda x, i: F.concat(F.substr(x, F.lit(1), F.length(x) - 1), F.substr(digits, i + 1, F.lit(1)))), "")


def luhn(digits: Column, first: int) -> Column:
    """The Luhn sum of digits, from the last, whose weight is ``first``."""
    other = 3 - first

    def add(s: Column, x: Column) -> Column:
        v = x["c"].cast("int") * F.when(F.pmod(x["i"], F.lit(2)) == 0, first).otherwise(other)
        return s + v - F.when(v > 9, 9).otherwise(0)

    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(F.filter(each, lambda x: x["c"] != ""), F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    def number(d: Column) -> Column:
        body = let(F.substr(d, F.lit(1), F.length(d) - 1), lambda b: _number(b, 10, F.lit("card"), key))
        whole = let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn(b, 2), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(F.pmod(luhn(d, 1), F.lit(10)) == 0, let(whole, lambda w: _fill(value, w))).otherwise(value)

    return let(_digits(value), number)


def _ip(value: Column, key: str) -> Column:
    number = F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    size = F.lit(65536).cast("long")
    mixed = let(number, lambda v: feistel(v, size, size, F.lit("ip"), key))
    return let(mixed, lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))


def _ssn(value: Column, key: str) -> Column:
    def number(p: Column) -> Column:
        area, group, serial = (F.get(p, k).cast("long") for k in range(3))
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        v = ((area - F.when(area > 666, 2).otherwise(1)) * GROUPS + group - 1) * SERIALS + serial - 1
        mixed = let(v, lambda x: feistel(x, F.lit(AREAS * GROUPS).cast("long"), F.lit(SERIALS).cast("long"), F.lit("ssn"), key))

        def text(x: Column) -> Column:
            rest = F.round((x - F.pmod(x, F.lit(SERIALS))) / SERIALS).cast("long")
            area = F.round((rest - F.pmod(rest, F.lit(GROUPS))) / GROUPS).cast("long") + 1
            area = area + F.when(area >= 666, 1).otherwise(0)
            return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.pmod(rest, F.lit(GROUPS)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(x, F.lit(SERIALS)) + 1).cast("string"), 4, "0"))

        return F.when(valid, let(mixed, text)).otherwise(value)

    return let(F.split(value, "-"), number)


def _day(value: Column, key: str, form: str, late: bool) -> Column:
    """Null unless the value is a date of this form. ``late``: of days after the twelfth, which stay so."""
    day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    date = lambda d: F.date_add(F.lit(FIRST_DAY).cast("date"), d.cast("int"))
    fits = lambda d: (d >= 0) & (d < DAYS) & ((F.dayofmonth(date(d)) > 12) if late else F.lit(True))
    left, right = (F.lit(n).cast("long") for n in DAY_PARTS)
    once = lambda d: feistel(d, left, right, F.lit(f"date{late}"), key)
    walked = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(d), lambda s, i: F.when(fits(s), s).otherwise(once(s)))
    wide = form.replace("M", "MM").replace("d", "dd") if "MM" not in form else form
    short = F.regexp_replace(value, r"^(\d{1,2}).*$", "$1")
    text = lambda d: F.when((F.length(short) == 1) & F.lit(form[0] != "y"), F.date_format(date(d), form)).otherwise(F.date_format(date(d), wide))
    return let(day, lambda d: F.when(d.isNotNull() & fits(d), let(walked(d), lambda w: F.when(fits(w), text(w)))))


def _date(value: Column, key: str) -> Column:
    return (
        F.when(value.contains("-"), F.coalesce(_day(value, key, "yyyy-MM-dd", False), value))
        .when(value.contains("."), F.coalesce(_day(value, key, "d.M.yyyy", False), value))
        .otherwise(F.coalesce(_day(value, key, "M/d/yyyy", False), _day(value, key, "d/M/yyyy", True), value))
    )


def _phone(value: Column, key: str) -> Column:
    """The country code, or the first digit where it isn't set apart, stays."""
    head = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-])|\+\d)?", 0)

    def rest(tail: Column) -> Column:
        return let(_digits(tail), lambda d: F.concat(head, _fill(tail, _number(d, 10, F.lit("phone"), key))))

    return let(F.substr(value, F.length(head) + 1, F.length(value)), rest)


def _email(value: Column, key: str) -> Column:
    """Addresses are equal whatever their case; the part after the @ stays."""
    parts = F.regexp_extract_all(F.lower(F.substring_index(value, "@", 1)), F.lit("[a-z0-9]{1,11}|[^a-z0-9]"), F.lit(0))
    mixed = F.transform(parts, lambda x, i: F.when(x.rlike("[a-z0-9]"), _number(x, 36, F.concat(F.lit("email"), i.cast("string")), key)).otherwise(x))
    return F.concat(F.array_join(mixed, ""), F.lit("@"), F.substring_index(value, "@", -1))


def pseudonym(value: Column, key: str) -> Column:
    """Of a string that one of PATTERNS matched: its pseudonym, or itself if it isn't valid."""
    return (
        F.when(value.contains("@"), _email(value, key))
        .when(value.rlike(r"^\d+\.\d+\.\d+\.\d+$"), _ip(value, key))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(value, key))
        .when(value.rlike(r"^(\d{4}-\d\d-\d\d|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4})$"), _date(value, key))
        .when(value.rlike(r"^\d(?:[ -]?\d){12,18}$"), _card(value, key))
        .otherwise(_phone(value, key))
    )


def pseudonymise(docs: DataFrame, *, key: str, text_column: str = "text") -> DataFrame:
    """All rows and columns, with pseudonyms in the text, and ``pii_values``, the number of values replaced (a column of that name is replaced).

    Null and empty texts stay, with 0 values. Texts without a digit aren't searched twice. Rows
    are independent of each other: nothing is shuffled, so skew, repeated rows and ties have no
    effect. An empty table gives no rows. Invalid values (a card number that fails the Luhn check,
    a 31st of April) stay. The part of an e-mail address behind the @ stays in clear, and so does an address
    whose part before it has over 64 characters, the standard's limit. ``key`` should be long and secret; it is part of the query plan.
    """
    docs = docs.drop("pii_values")
    text = col(text_column)
    old, new = fresh(docs, "old", "new")
    found = docs.withColumn(old, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    found = found.withColumn(new, F.transform(old, lambda v: pseudonym(v, key)))
    some = F.size(old) > 0
    parts = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(parts, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x)).cast("long")
    out = [F.when(some, joined).otherwise(text).alias(c) if c == text_column else col(c) for c in docs.columns]
    return found.select(*out, F.when(some, changed).otherwise(0).alias("pii_values"))
