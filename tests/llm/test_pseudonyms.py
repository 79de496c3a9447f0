"""Pseudonyms of every form against a Feistel network in plain Python; very long texts for operators 1, 6, 7, 8 and 10."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import fingerprint, katz, pii, shards, urlfilter

KEY = "a key"
FIRST = datetime.date(1900, 1, 1)


def feistel(value, left, right, tweak):
    a, b = divmod(value, right)
    for i in range(1, 11):
        added = lambda other: int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{other}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        if i % 2:
            a = (a + added(b) % left) % left
        else:
            b = (b + added(a) % right) % right
    return a * right + b


def number(text, base, tweak):
    n = len(text)
    low = (n + 1) // 2
    v, out = feistel(int(text, base), base ** (n - low), base**low, f"{tweak}:{n}"), ""
    for _ in range(n):
        v, d = divmod(v, base)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out


def fill(text, digits):
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), text)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10


def card(x):
    d = re.sub(r"\D", "", x)
    if luhn(d):
        return x
    body = number(d[:-1], 10, "card")
    return fill(x, body + next(c for c in "0123456789" if luhn(body + c) == 0))


def ip(x):
    v = 0
    for p in x.split("."):
        v = v * 256 + int(p)
    v = feistel(v, 65536, 65536, "ip")
    return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))


def ssn(x):
    a, g, s = map(int, x.split("-"))
    if not (0 < a < 900 and a != 666 and g and s):
        return x
    v = feistel(((a - (2 if a > 666 else 1)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn")
    rest, s = divmod(v, 9999)
    a, g = divmod(rest, 99)
    return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def day(y, m, d, late):
    """The other day, or None if it is none or isn't taken."""
    try:
        n = (datetime.date(y, m, d) - FIRST).days
    except ValueError:
        return None
    fits = lambda k: 0 <= k < 73049 and (not late or (FIRST + datetime.timedelta(k)).day > 12)
    if not fits(n):
        return None
    for _ in range(64):
        n = feistel(n, 271, 270, f"date{late}")
        if fits(n):
            return FIRST + datetime.timedelta(n)
    return None


def date(x):
    if "-" in x:
        new = day(*map(int, x.split("-")), False)
        return new.isoformat() if new else x
    sep = "." if "." in x else "/"
    a, b, y = x.split(sep)
    forms = [(int(b), int(a), False, "dm")] if sep == "." else [(int(a), int(b), False, "md"), (int(b), int(a), True, "dm")]
    for m, d, late, order in forms:
        if new := day(int(y), m, d, late):
            w = "{}" if len(a) == 1 else "{:02d}"
            return sep.join([*(w.format(v) for v in ((new.month, new.day) if order == "md" else (new.day, new.month))), f"{new.year:04d}"])
    return x


def phone(x):
    head = re.match(r"(\+\d{1,3}(?=[ .(-])|\+\d)?", x)[0]
    tail = x[len(head) :]
    return head + fill(tail, number(re.sub(r"\D", "", tail), 10, "phone"))


def email(x):
    name, host = x.split("@")
    parts = re.findall(r"[a-z0-9]{1,11}|[^a-z0-9]", name.lower())
    return "".join(number(p, 36, f"email{k}") if p[0].isalnum() else p for k, p in enumerate(parts)) + "@" + host


def values():
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    out = []
    for _ in range(60):
        body = digits(rng.randrange(12, 19))
        d = body + next(c for c in "0123456789" if luhn(body + c) == 0)
        out += [(card, d), (card, " ".join(d[k : k + 4] for k in range(0, len(d), 4))), (card, d[:-1] + str((int(d[-1]) + 1) % 10))]
        out += [(ip, ".".join(str(rng.randrange(256)) for _ in range(4))), (ssn, f"{digits(3)}-{digits(2)}-{digits(4)}")]
        y, m, d = rng.randrange(1880, 2120), rng.randrange(1, 14), rng.randrange(1, 33)
        out += [(date, f"{y}-{m:02d}-{d:02d}"), (date, f"{m}/{d}/{y}"), (date, f"{d:02d}/{m:02d}/{y}"), (date, f"{d}.{m}.{y}"), (date, f"{d:02d}.{m:02d}.{y}")]
        out += [(phone, f"({digits(3)}) {digits(3)}-{digits(4)}"), (phone, f"+{rng.randrange(1, 999)} {digits(3)} {digits(3)} {digits(3)}"), (phone, f"{digits(3)}.{digits(3)}.{digits(4)}")]
        out += [(email, f"{rng.choice('aZ9')}{digits(3)}.{rng.choice(['Bob', 'eve_x', 'averyverylongname'])}+t@Host{digits(2)}.example.com")]
    return out + [(ssn, "666-12-1234"), (ssn, "000-12-1234"), (ssn, "899-99-9999"), (ip, "0.0.0.0"), (ip, "255.255.255.255"), (date, "29.2.1900"), (date, "2000-02-29"), (date, "12/12/2099")]


def test_every_form_equals_plain_python(spark):
    rows = [(k, x) for k, (_, x) in enumerate(values())]
    got = {r["k"]: r["y"] for r in spark.createDataFrame(rows, "k long, x string").select("k", pii.pseudonym(F.col("x"), KEY).alias("y")).collect()}
    wrong = [(f.__name__, x, got[k], f(x)) for k, (f, x) in enumerate(values()) if got[k] != f(x)]
    assert not wrong, wrong[:5]


@pytest.fixture(scope="module")
def long_texts(spark):
    word = "some words of a very long text with 4111 1111 1111 1111 in it. "
    return spark.createDataFrame([(1, word * 30_000), (2, "x" * 1_000_000), (3, None), (4, word)], "doc_id long, text string")


def test_very_long_texts(spark, long_texts):
    out = {r["doc_id"]: r for r in pii.pseudonymise(long_texts, key=KEY).collect()}
    assert out[1]["pii_values"] == 30_000 and out[2]["pii_values"] == 0 and out[1]["text"] == out[4]["text"] * 30_000
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(long_texts).collect()}
    assert len(found) == 4
    scored = {r["doc_id"]: r for r in katz.score(long_texts, train=F.lit(True)).collect()}
    assert scored[1]["n_tokens"] == 14 * 30_000 + 1 and scored[2]["n_tokens"] == 2 and scored[3]["n_tokens"] == 1
    assert shards.materialise(long_texts, key=7).count() > 100
    assert shards.materialise(long_texts.filter("text is null"), key=7).count() == 1


def test_very_long_addresses(spark):
    rows = [(1, "http://a.example.com/" + "p/" * 20_000, datetime.datetime(2024, 5, 1)), (2, "http://" + "l." * 2_000 + "example.com/", datetime.datetime(2024, 5, 1))]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([("l", "example.com", "add", datetime.datetime(2024, 1, 1)), ("l", "a.example.com/p/p", "add", datetime.datetime(2024, 1, 1))], "list string, key string, action string, at timestamp")
    got = {r["page_id"]: r["matched_key"] for r in urlfilter.as_of(captures, entries).collect()}
    assert got == {1: "a.example.com/p/p", 2: "example.com"}
