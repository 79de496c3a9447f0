"""Operators 11 to 13 against brute force, with awkward rows."""

import datetime
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import funnel, lexical, recompress

from .fixtures import frame, prose

FUNNELS = [funnel.Funnel("A", ("v", "c", "v", "p"), ("e",)), funnel.Funnel("B", ("s", "v", "c"), ("e", "s")), funnel.Funnel("C", ("c", "c", "p", "v"), ("s",)), funnel.Funnel("D", ("v", "p"))]


def brute_funnels(rows, funnels, within, percent):
    rows = {r for r in rows if None not in r}
    out = {}
    for f in funnels:
        for client in {r[0] for r in rows}:
            own = sorted((t, k) for c, k, t in rows if c == client)
            times, n = {}, Counter()
            for t0, k0 in own:
                if k0 != f.steps[0]:
                    continue
                n[1] += 1
                t = t0
                for step, kind in enumerate(f.steps[1:], 2):
                    nxt = next((u for u, k in own if u > t and k == kind), None)
                    if nxt is None or nxt - t > within or any(t < u <= nxt and k in f.excluding for u, k in own):
                        break
                    n[step] += 1
                    times.setdefault(step, []).append(nxt - t)
                    t = nxt
            if n[1]:
                out[f.name, client] = (*(n[k] for k in range(1, 5)), max(n), *(sorted(times[k])[-(-percent * len(times[k]) // 100) - 1] if k in times else None for k in range(2, 5)))
    depth = Counter((f, v[4]) for (f, _), v in out.items())
    return {k: (*v, depth[k[0], v[4]]) for k, v in out.items()}


def clicks(spark, rows):
    start = datetime.datetime(2024, 3, 10, 1, 0)  # a night with an hour left out in some zones
    rows = [(c, k, None if t is None else start + datetime.timedelta(microseconds=t)) for c, k, t in rows]
    return spark.createDataFrame(rows, "client_id long, kind string, ts timestamp_ntz")


@pytest.mark.parametrize("percent", [50, 90])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_funnels_equal_brute_force(spark, percent, zone):
    rng = random.Random(percent)
    step = 60_000_000
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["v", "v", "c", "c", "p", "e", "s", "other", None]), rng.choice([rng.randrange(300) * step, rng.randrange(300 * step), None])) for _ in range(1500)]
    rows += rows[:100] + [(9, "v", 0), (9, "c", 15 * step), (9, "v", 30 * step), (9, "p", 45 * step + 1), (10, "v", 0), (10, "e", 5), (10, "c", 5), (11, "v", 7), (11, "c", 7)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = clicks(spark, rows).withColumns({"client": F.lit(1), "at": F.lit("x"), "pair": F.lit(0), "a.b": F.lit(2), "funnel": F.lit("z")})
        found = funnel.funnels(df, FUNNELS, percent=percent).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert len(found) == len({(r["funnel"], r["client_id"]) for r in found})
    assert {(r["funnel"], r["client_id"]): tuple(r)[2:] for r in found} == brute_funnels(rows, FUNNELS, 15 * step, percent)


def test_funnels_with_narrow_slices_and_empty(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.choice("vcpes"), rng.randrange(5000)) for _ in range(800)]
    found = funnel.funnels(clicks(spark, rows), FUNNELS, within=40, part=1).collect()
    assert {(r["funnel"], r["client_id"]): tuple(r)[2:] for r in found} == brute_funnels(rows, FUNNELS, 40, 50)
    assert funnel.funnels(clicks(spark, rows).limit(0), FUNNELS).count() == 0
    with pytest.raises(ValueError):
        funnel.funnels(clicks(spark, rows), [funnel.Funnel("A", ("v",))])


def brute_repeats(rows, window):
    first, out = {}, []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, d), d)
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if d is not None and first[tuple(w[k : k + window])] < d:
                gone |= set(range(k, k + window))
        out.append((d, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def passages(seed, n, vocabulary):
    rng = random.Random(seed)
    some = [prose(rng, rng.randrange(10, 40), vocabulary) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [prose(rng, rng.randrange(0, 60), vocabulary)]
        for p in rng.sample(some, rng.randrange(3)):
            w = p.split(" ")
            a = rng.randrange(len(w))
            parts += [" ".join(w[a : a + rng.randrange(1, len(w))]), prose(rng, rng.randrange(0, 20), vocabulary)]
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    texts += texts[:4] + [" ".join(texts[0].split()), None, "", " \n ", "one", "a a a", "x " * 40, "x " * 25 + "y " * 30, "y " * 14 + "x " * 20, "Café au lait é " * 9, "café au lait é " * 9]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(100 + i, t) for i, t in zip(ids, texts, strict=True)]
    return rows + [rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (None, rows[4][1]), (-5, rows[5][1])]


@pytest.mark.parametrize(("window", "rounds", "size", "vocabulary"), [(13, 3, 1 << 20, 400), (13, 3, 600, 400), (13, 3, 600, 2), (13, 2, 300, 30), (5, 1, 500, 12), (30, 4, 700, 3), (1, 1, 400, 400)])
def test_repeats_equal_brute_force(spark, window, rounds, size, vocabulary):
    rows = passages(window + vocabulary, 50, vocabulary)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("id", "n_words", "batch", "a.b")})
    found = recompress.remove_repeats(df, window=window, rounds=rounds, batch_bytes=size, bucket_bytes=1000).collect()
    assert sorted([(r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in found], key=str) == brute_repeats(rows, window)


def test_symbols_of_equal_substrings_are_equal():
    import numpy as np

    rng = random.Random(2)
    inner = [rng.randrange(50) for _ in range(40)]
    names = []
    for _ in range(2):
        text = " ".join(f"w{x}" for x in [rng.randrange(50) for _ in range(30)] + inner + [rng.randrange(50) for _ in range(30)])
        t = recompress.Texts({"ids": [1], "sizes": [len(text)], "texts": recompress._packed(np.frombuffer(text.encode(), np.uint8))}, 13)
        t.hashed()
        lo, hi, name = t.symbols(3)
        names.append([(int(a), int(b), int(n)) for a, b, n in zip(lo, hi, name, strict=True) if a >= 31 and b <= 71])
    assert names[0] == names[1] and len(names[0]) > 5 and all(b - a <= 13 for a, b, _ in names[0])


def test_repeats_of_long_texts_and_empty(spark):
    rng = random.Random(7)
    long = prose(rng, 300_000, 5000)
    rows = [(1, long), (2, long[500_000:] + " new end"), (3, "w" * 6_000_000 + " " + long[:3000])]
    found = {r["doc_id"]: r for r in recompress.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=1 << 19).collect()}
    assert found[1]["n_removed"] == 0 and found[1]["text"] == long
    assert 0 < found[2]["n_words"] - found[2]["n_removed"] <= 3 and found[2]["text"].endswith("new end")
    assert found[3]["text"].startswith("www") and found[3]["n_removed"] >= len(long[:3000].split()) - 1
    assert recompress.remove_repeats(frame(spark).limit(0)).count() == 0
    assert recompress.remove_repeats(frame(spark, [(1, None, None, None, None)])).collect()[0][1:] == ("", 0, 0)


def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for i, text in set(items):
        scored = []
        for d, c in found:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d, s))
        out += [(i, r, d, s) for r, (_, _, d, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "size", "block"), [(10, 1 << 20, 1 << 16), (3, 2000, 7), (1, 300, 40)])
def test_search_equals_brute_force(spark, monkeypatch, k, size, block):
    rng = random.Random(k)
    monkeypatch.setattr(lexical, "_BLOCK", block)
    docs = [(d, prose(rng, rng.randrange(1, 80), 60)) for d in range(60)]
    docs += [(d + 200, t) for d, t in docs[:20]] + [docs[3], (None, docs[4][1]), (None, None), (70, None), (71, ""), (72, "!? \x00\x7f"), (73, "Straße STRASSE straße İ 12a-B"), (74, "w1x " * 3000)]
    items = [(i, prose(rng, rng.randrange(1, 12), 80)) for i in range(15)] + [(0, "w1x w1x w1x"), (20, None), (21, ""), (22, "nothing here"), (23, "STRASSE straße 12A"), (24, "W2X. w2x"), (24, "W2X. w2x"), (None, "w3x w4x")]
    found = lexical.search(lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({"id": F.lit(1), "a.b": F.lit(1)}), shard_bytes=size), spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit(5), "term": F.lit("x"), "a.b": F.lit(1)}), k=k)
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute_search(docs, items, k)


def test_search_of_empty_tables(spark):
    docs, items = frame(spark), spark.createDataFrame([(1, "w1x w2x")], "item_id long, text string")
    assert lexical.search(lexical.build(docs.limit(0)), items).count() == 0
    assert lexical.search(lexical.build(docs), items.limit(0)).count() == 0
    assert lexical.search(lexical.build(docs), items).count() == 10


def test_kept_text_digest(spark):
    rows = [(1, "a b  c"), (2, None)]
    kept = recompress.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r[0]: r[1] for r in kept.select("doc_id", F.sha2(F.col("text").cast("binary"), 256)).collect()}
    assert got == {1: hashlib.sha256(b"a b c").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
