"""Each operator against brute force or exact inverses, and on awkward rows."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, decontam, fingerprint, katz, langid, linededup, minhash, packing, pii, shards, urlfilter

from .fixtures import SCHEMA, components, documents, frame, prose, shingles, words


CLASH = "_r _gone _key _lines _found _runs key rep batch seed bands residue residue_0 gone_0 key_0 key_0_ old_0 new_0 said_0 language_0 sure_0 name_0 Lines_0 row0_0 kept_0".split()


def clash(df):
    """Columns whose names operators use inside, now or before, and those that some return."""
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASH)} | {c: F.lit("own") for c in ("lang_pred", "removed_lines", "pii_values")})


def unchanged(out, but=()):
    """Clashing columns came back as they were."""
    for r in out.collect():
        assert [r[c] for c in CLASH] == list(range(len(CLASH)))
        assert all(r[c] == "own" for c in ("lang_pred", "removed_lines", "pii_values") if c not in but)


def test_clashing_columns_come_back(spark):
    rows = documents(n=12)
    docs = clash(frame(spark, rows))
    tests = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    unchanged(linededup.remove_repeats(docs), ["removed_lines"])
    unchanged(pii.pseudonymise(docs, key="k"), ["pii_values"])
    unchanged(langid.language_filter(docs))
    unchanged(langid.tag(docs, langid.learn(docs, train=F.lit(True))), ["lang_pred"])
    unchanged(minhash.drop_near_duplicates(docs))
    left = decontam.drop_contaminated(docs, tests)
    unchanged(left)
    assert left.columns == docs.columns and left.count() < len(rows)


def exact_ids():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(bpe.default_path())
    return lambda t: coder.encode(t or "", add_special_tokens=False).ids


# --- 1 URL filters ------------------------------------------------------------------------


def test_url_filter_against_every_interval(spark):
    rng = random.Random(3)
    hosts = ["a.com", "x.a.com", "b.org", "c.b.org"]
    day = lambda d: f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}"
    entries = [("l", rng.choice([*hosts, "a.com/p", "x.a.com/p/q"]), rng.choice(["add", "remove"]), day(rng.randrange(300))) for _ in range(60)]
    entries = [e for k, e in enumerate(entries) if (e[1], e[3]) not in {(x[1], x[3]) for x in entries[:k]}]
    caps = [(k, rng.choice(["http://", "HTTPS://u@"]) + rng.choice(hosts) + rng.choice(["", "/p", "/p/q?x", "/px", "#f"]), day(rng.randrange(300))) for k in range(200)]
    caps += [(900, None, day(1)), (901, "http://a.com", None), (902, "", day(3)), (903, "no url", day(3)), caps[0]]
    e = spark.createDataFrame([*entries, ("l", None, "add", day(1)), ("l", "a.com", "add", None)], "list string, key string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    c = spark.createDataFrame(caps, "id long, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = urlfilter.as_of(c.withColumn("blocked", F.lit("x")), e)
    assert got.columns.count("blocked") == 1

    def state(key, t):
        past = sorted((x[3], x[2]) for x in entries if x[1] == key and x[3] <= t)
        return past[-1][0] if past and past[-1][1] == "add" else None

    rows = got.collect()
    assert len(rows) == len(caps)
    for r in rows:
        want = None
        if r["url"] and r["fetched_at"] and "://" in r["url"]:
            rest = r["url"].split("://")[1].replace("u@", "")
            host = rest.split("/")[0].split("#")[0].split("?")[0]
            path = rest[len(host) :].split("?")[0].split("#")[0]
            parts, labels = [p for p in path.split("/") if p], host.split(".")
            keys = [".".join(labels[k:]) for k in range(len(labels) - 1)][::-1] + [host + "/" + "/".join(parts[:k]) for k in range(1, len(parts) + 1)]
            want = next((k for k in reversed(keys) if state(k, str(r["fetched_at"])[:10])), None)
        assert (r["blocked"], r["matched_key"]) == (want is not None, want), r
    assert urlfilter.as_of(c, e.limit(0)).filter("blocked").count() == 0
    assert urlfilter.as_of(c.limit(0), e).count() == 0


def test_url_filter_ties_and_clashing_names(spark):
    lists = [f"list{k}" for k in range(40)]
    e = spark.createDataFrame([(x, f"h{k}.com", "add", "2024-01-01") for k in range(8) for x in random.Random(k).sample(lists, 5)], "list string, key string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    first = {r["key"]: r["m"] for r in e.groupBy("key").agg(F.min("list").alias("m")).collect()}
    c = spark.createDataFrame([(f"http://h{k}.com/{k}", "2024-02-01", 5, 6, 7) for k in range(8)] * 3 + [(None, None, 5, 6, 7)], "url string, fetched_at string, _row long, row0_0 long, key long").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = urlfilter.as_of(c, e).collect()
    assert len(got) == 25 and all((r["_row"], r["row0_0"], r["key"]) == (5, 6, 7) for r in got)
    assert all(r["matched_list"] == (first[r["matched_key"]] if r["url"] else None) for r in got) and sum(r["blocked"] for r in got) == 24


def test_url_filter_of_deep_hosts_and_paths_and_capitals(spark):
    deep, path = ".".join("abcdefghijkl") + ".com", "/".join(f"s{k}" for k in range(12))
    entries = [("l", k, "add", "2024-01-01") for k in (deep, f"p.com/{path}", "A.com/Blog", "q.com/x")]
    urls = {f"http://{deep}/x": deep, f"http://z.{deep}/": deep, f"http://y{deep}": None, f"http://p.com/{path}/more": f"p.com/{path}", "http://p.com/s0": None}
    urls |= {"http://a.COM/Blog/1": "a.com/Blog", "http://a.com/blog/1": None, "http://q.com/x": "q.com/x", "http://q.com/X": None}
    e = spark.createDataFrame(entries, "list string, key string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    c = spark.createDataFrame([(u, "2024-02-01") for u in urls], "url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    assert {r["url"]: r["matched_key"] for r in urlfilter.as_of(c, e).collect()} == urls
    one = [e.filter(F.col("key") == k) for k in (deep, "q.com/x")]
    assert [urlfilter.as_of(c, x).filter("blocked").count() for x in one] == [2, 1]
    every = spark.createDataFrame([(u,) for u in urls], "u string").select(F.size(urlfilter.keys_of(F.col("u"))).alias("n"))
    assert [r["n"] for r in every.collect()] == [13, 13, 12, 14, 2, 3, 3, 2, 2]


# --- 2 packing ----------------------------------------------------------------------------


@pytest.mark.parametrize("block", [7, 100_000])
def test_packing_covers_every_id_once(spark, block):
    rows = documents()
    out = packing.pack(clash(frame(spark, rows)), capacity=64, block_docs=block).toPandas()
    ids = {d: exact_ids()(t) + [1] for d, t, *_ in rows}
    for d, part in out.sort_values("start").groupby("doc_id"):
        assert [i for b in part.ids for i in np.frombuffer(b, "<u4")] == ids[d]
        assert (part.doc_tokens == len(ids[d])).all()
        assert all(zlib.crc32(b) == c for b, c in zip(part.ids, part.ids_crc32))
    assert set(out.doc_id) == set(ids)
    for _, w in out.sort_values("offset").groupby("sequence_id"):
        size = w.length.sum()
        assert list(w.offset) == [0, *w.length.cumsum()[:-1]]
        assert size == 64 or size & (size - 1) == 0
    assert packing.pack(frame(spark).limit(0)).count() == 0


def test_few_tokens_leave_their_window():
    rng = random.Random(20)
    packer, total = packing.Packer(2048), 0
    for k in range(20_000):
        n = int(rng.lognormvariate(6, 1)) + 1
        total += n
        assert all(sum(len(p[2]) for p in w) == 4 * size for size, w in packer.add(k, b"1234" * n))
    assert all(sum(len(p[2]) for p in w) == 4 * size and (size == 2048 or size & (size - 1) == 0) for size, w in packer.finish())
    assert 0 < packer.recut < 0.05 * total


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(10)
    assert p.place(4, "a") is None
    assert p.place(4, "b") is None
    # the second went on the first, as two windows of 4 would make 4 and one of 8 makes 1
    assert p.level[8] == 1 and p.place(2, "c") == ["a", "b", "c"]
    for _ in range(200):
        n = p.level.copy()
        size = random.Random(int(n.sum())).randrange(1, 10)
        full = p.place(size, 0)
        after = int((p.level[1:10] ** 2).sum())
        options = []
        for h in range(10 - size + 1):
            if h == 0 or n[h]:
                m = n.copy()
                m[h] -= h > 0
                m[h + size] += h + size < 10
                options.append(int((m[1:10] ** 2).sum()))
        assert after == min(options)
        assert full is None or len(full)


# --- 3 decontamination ----------------------------------------------------------------------


def test_decontamination_finds_substituted_passages_only(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, 40, 5000)) for k in range(20)] + [(90, "too short"), (91, None), (92, ""), (93, prose(rng, 9, 5000))]
    docs, want = [], {}
    for k in range(60):
        body = prose(rng, 200, 5000).split(" ")
        if k % 3 == 0:
            item = items[k % 20][1].split(" ")
            for j in range(0, len(item), 14):
                item[j] = "other"
            body[50:50] = item
            want[k] = k % 20
        docs.append((k, " ".join(body), None, None, 0))
    docs += [(100, items[3][1].upper().replace("X", "x"), None, None, 0), (101, None, None, None, 0), (102, "", None, None, 0), (103, items[23][1] + " tail", None, None, 0), docs[0]]
    want |= {100: 3, 103: 23}
    tests = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.overlaps(clash(frame(spark, docs)), tests).collect()
    got = {r["doc_id"]: {0: r["item_id"]}[0] for r in out}
    want[103] = 93
    assert got == want
    assert all(r["matches"] >= 0.8 * r["tokens"] for r in out)
    left = decontam.drop_contaminated(frame(spark, docs), tests)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d[0] for d in docs if d[0] not in want)
    assert decontam.overlaps(frame(spark, docs), tests.limit(0)).count() == 0
    assert decontam.overlaps(frame(spark).limit(0), tests).count() == 0


def brute_stretch(equal, least, share):
    sums = np.concatenate([[0], np.cumsum(equal)]).tolist()
    found = [(sums[a] - sums[b], b - a, a) for a in range(len(equal)) for b in range(a + least, len(equal) + 1) if sums[b] - sums[a] >= share * (b - a) - 1e-9]
    return (min(found)[2], min(found)[2] + min(found)[1], -min(found)[0]) if found else None


def test_every_stretch_is_tested():
    rng = np.random.default_rng(8)
    for k in range(300):
        equal = rng.random(rng.integers(0, 120)) >= rng.uniform(0.15, 0.6)
        assert decontam.best_stretch(equal, 13, 0.8) == brute_stretch(equal, 13, 0.8), equal
    gaps = np.array(([1] * 20 + [0] * 9) * 6, bool)
    assert decontam.best_stretch(gaps, 13, 0.8)[2] >= 20


def test_stretches_in_worse_surroundings(spark):
    rng = random.Random(15)
    items = [(k, " ".join(f"i{rng.randrange(10**9)}" for _ in range(200))) for k in range(40)]
    docs, want = [], {}
    for k, text in items:
        item = text.split(" ")
        share = (0.15, 0.2, 0.25, 0.3)[k % 4]
        run = rng.randrange(187)
        equal = [run <= j < run + 13 or rng.random() >= share for j in range(200)]
        if k == 0:
            equal = [j % 29 < 20 for j in range(200)]
        docs.append((k, "head " + " ".join(w if e else "other" for w, e in zip(item, equal)), None, None, 0))
        a, b, same = brute_stretch(np.array(equal), 13, 0.8)
        want[k] = (k, a + 1, a, b - a, same)
    out = decontam.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == want
    assert decontam.drop_contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# --- 4 language ID --------------------------------------------------------------------------


def test_code_lengths_add_up_and_tell_languages(spark):
    rng = random.Random(2)
    letters = {"en": "etaoinshr", "fr": "éeasintru", "de": "ünegirsta"}
    rows = []
    for k in range(300):
        lang = list(letters)[k % 3]
        text = " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(30))
        rows.append((k, text, lang if k % 11 else None, "s", 0))
    rows += [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, "123 !?", None, "s", 0), (903, "日本", None, "s", 0), rows[0]]
    docs = frame(spark, rows)
    model = langid.learn(docs, train=~langid.held_out(F.col("doc_id")), least=2)
    assert model.languages == ["de", "en", "fr"]
    assert all(np.allclose(np.exp2(-b.astype(float)).sum(1), 1, atol=1e-4) for b in model.bits)
    out = langid.tag(clash(docs), model).toPandas()
    assert out.columns.tolist().count("lang_pred") == 1
    assert len(out) == len(rows)
    held = out[out.doc_id.map(lambda d: d < 900 and zlib.crc32(str(d).encode()) % 4 == 2)]
    assert (held.lang_pred == [list(letters)[d % 3] for d in held.doc_id]).mean() > 0.95
    assert set(out[out.doc_id.isin([900, 901, 902])].lang_pred) == {"und"}
    assert out[out.doc_id == 903].lang_pred.iloc[0] in model.languages
    assert out.lang_score.between(0, 1).all()
    kept = langid.language_filter(docs)
    assert kept.columns == docs.columns
    assert not {900, 901, 902} & {r["doc_id"] for r in kept.collect()}
    nothing = langid.learn(docs.withColumn("lang", F.lit(None).cast("string")), train=F.lit(True))
    assert set(langid.tag(docs, nothing).toPandas().lang_pred) == {"und"}
    assert langid.language_filter(docs.limit(0)).count() == 0


def brute_bits(model, learned, text, least):
    """Code lengths from plain dictionaries: a probability for each byte by recursion over its context's suffixes."""
    classes = lambda t: [0, 0, 0, *(int(model.byte_class[b]) for b in t.encode())]
    seen, every = defaultdict(lambda: defaultdict(Counter)), Counter()
    for language, t in learned:
        c = classes(t)
        for i in range(3, len(c)):
            every[tuple(c[i - 3 : i])] += 1
            for n in range(4):
                seen[language][tuple(c[i - n : i])][c[i]] += 1

    def p(language, context, symbol):
        if len(context) == 3 and every[context] < least:
            return p(language, context[1:], symbol)
        below = (lambda s: p(language, context[1:], s)) if context else lambda s: 1 / 64
        c = seen[language][context]
        if not c:
            return below(symbol)
        total = sum(c.values()) + (len(c) if len(c) < 64 else 0)
        if symbol in c:
            return c[symbol] / total
        return len(c) / total * below(symbol) / sum(below(s) for s in range(64) if s not in c)

    code = classes(text)
    own = sum(float(model.byte_bits[b]) for b in text.encode())
    return [own - sum(math.log2(p(k, tuple(code[i - 3 : i]), code[i])) for i in range(3, len(code))) for k in model.languages]


def test_code_lengths_equal_brute_force(spark):
    rng = random.Random(6)
    learned = [(k, "".join(rng.choice({"a": "abcd e", "b": "bcdeéß ", "c": "xyz日 "}[k]) for _ in range(200))) for k in "aabbc"]
    docs = frame(spark, [(k, t, lang, "s", 0) for k, (lang, t) in enumerate(learned)])
    model = langid.learn(docs, train=F.lit(True), least=3)
    texts = ["abc dé", "Xyz zyx", "", "new €", "bcdeéß bcde"]
    want = [brute_bits(model, learned, t, 3) for t in texts]
    names, sure, bits = langid.score(model, pa.array(texts))
    for t, w, name, s, b in zip(texts, want, names, sure, bits):
        if t:
            k = int(np.argmin(w))
            assert name == model.languages[k] and math.isclose(b * len(t.encode()), w[k], rel_tol=1e-4)
            assert math.isclose(s, 1 / sum(2 ** (w[k] - x) for x in w), rel_tol=1e-2)


# --- 5 near-duplicates ----------------------------------------------------------------------


def test_components_equal_brute_force(spark):
    rows = documents()
    out = {r["doc_id"]: r for r in minhash.near_duplicates(clash(frame(spark, rows))).collect()}
    want = components(rows)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in out.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in out.items())
    assert sum(not r["kept"] for r in out.values()) > 10


def test_near_duplicates_awkward_rows(spark):
    rows = [*documents(n=5), *documents(n=5)[:3], (None, "a b c", None, None, 0)]
    docs = frame(spark, rows)
    assert minhash.near_duplicates(docs).count() == len(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert left.filter("doc_id is null").count() == 1


def test_chain_of_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in minhash.components(links).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    s = minhash.signatures(np.concatenate([a, b]), np.array([0, 2000]), 1024)
    assert abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.05


# --- 6 pseudonyms ---------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


def test_pseudonyms_keep_form_and_links(spark):
    rows = ["card 4041894974608795, 4041 8949 7460 8795; not 4041894974608796", "ip 70.123.182.155 no 256.1.1.1", "a.42@mail8.example.com A.42@mail8.example.com", "+1 (988) 555-2485 and 555-123-4567", "123-45-6789 000-12-3456", "2000-02-29 2001-02-29 12/25/2010 25/12/2010 3.4.1999", None, "", "none", "4041894974608795"]
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(rows)], SCHEMA)
    out = [r["text"] for r in pii.pseudonymise(clash(df), key="k").orderBy("doc_id").collect()]
    card = out[0].split(" ")[1].rstrip(",")
    assert card != "4041894974608795" and luhn(card) and out[9] == card and out[0].endswith("not 4041894974608796")
    assert out[0].split(", ")[1].split(";")[0].replace(" ", "") == card
    assert all(0 <= int(o) < 256 for o in out[1].split(" ")[1].split(".")) and out[1].endswith("no 256.1.1.1")
    x, y = out[2].split(" ")
    assert x == y != "a.42@mail8.example.com" and x.endswith("@mail8.example.com")
    assert out[3].startswith("+1 (") and "988" not in out[3][:9]
    assert out[4].endswith(" 000-12-3456") and not out[4].startswith("123-45-6789")
    assert out[5].split(" ")[1] == "2001-02-29" and int(out[5].split(" ")[3].split("/")[0]) > 12
    assert out[6:9] == [None, "", "none"]
    assert pii.pseudonymise(df.limit(0), key="k").count() == 0
    assert [r["text"] for r in pii.pseudonymise(df, key="other").orderBy("doc_id").collect()][9] != card


@pytest.mark.parametrize(("n", "base"), [(1, 10), (3, 10), (2, 36)])
def test_number_permutation_is_one_to_one(spark, n, base):
    df = spark.range(base**n).select(F.lpad(F.lower(F.conv(F.col("id").cast("string"), 10, base)), n, "0").alias("x"))
    got = {r[0] for r in df.select(pii._number(F.col("x"), base, F.lit("t"), "k")).collect()}
    assert len(got) == base**n and all(len(x) == n for x in got)


def test_dates_are_one_to_one(spark):
    df = spark.range(pii.DAYS).select(F.date_format(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("x"))
    r = df.select(pii._date(F.col("x"), "k").alias("y")).agg(F.count_distinct("y"), F.min("y"), F.max("y")).first()
    assert tuple(r) == (pii.DAYS, "1900-01-01", "2099-12-31")


# --- 7 training order -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_slots_are_a_permutation(n):
    assert sorted(shards.permute(np.arange(n), n, 7)) == list(range(n))
    assert n < 64 or list(shards.permute(np.arange(n), n, 7)) != list(shards.permute(np.arange(n), n, 8))


def test_shards_round_trip(spark, tmp_path):
    rows = [*documents(n=20), (3, "the same id again", None, None, 0), (None, "no id", None, None, 0)]
    out = shards.materialise(clash(frame(spark, rows)), key=5, length=32, shard=8)
    table = out.toPandas().sort_values("slot")
    code = exact_ids()
    stream = []
    for _, t, *_ in rows:
        stream += [*code(t), 1]
    n = -(-len(stream) // 32)
    assert list(table.slot) == list(range(n))
    whole = np.array(stream + [1] * (n * 32 - len(stream)), "<u2").reshape(n, 32)
    order = shards.permute(np.arange(n), n, 5)
    shards.write_shards(out, str(tmp_path / "s"))
    for k in range(-(-n // 8)):
        files = list((tmp_path / "s" / f"shard={k}").glob("part-*"))
        assert len(files) == 1
        got = shards.read_slots(files[0].read_bytes(), 0, 8, 32)
        for j, ids in enumerate(got):
            assert (ids == whole[np.flatnonzero(order == 8 * k + j)[0]]).all()
    assert shards.materialise(frame(spark).limit(0), key=1).count() == 0


def test_offsets_are_those_in_the_files(spark, tmp_path):
    out = shards.materialise(frame(spark), key=6, length=16, shard=8)
    want = {r["slot"]: r for r in out.collect()}
    path = str(tmp_path / "s")
    shards.write_shards(out, path)
    for slot, r in want.items():
        (file,) = (tmp_path / "s" / f"shard={r['shard']}").glob("part-*")
        assert file.read_bytes()[r["byte_offset"] :][:32] == bytes(r["record"]), slot
    back = shards.read_back(spark, path, length=16, shard=8).collect()
    assert len(back) == len(want) > 16
    assert {r["slot"]: (r["shard"], r["byte_offset"], r["record_crc32"]) for r in back} == {s: (r["shard"], r["byte_offset"], zlib.crc32(r["record"])) for s, r in want.items()}
    (file.parent / f".{file.name}.crc").unlink()
    file.write_bytes(file.read_bytes()[:-3])
    with pytest.raises(Exception, match="whole records"):
        shards.read_back(spark, path, length=16, shard=8).collect()


def test_training_order_writes_its_shards(spark):
    from quern.llm import common, queries

    rows = queries.QUERIES["op7_training_order"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and len(rows) > 50
    whole = shards.materialise(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), key=20240101)
    assert {r["slot"]: (r["byte_offset"], r["record_crc32"]) for r in rows} == {r["slot"]: (r["byte_offset"], zlib.crc32(r["record"])) for r in whole.collect()}
    import os

    assert any(f.startswith("shards-") for f in os.listdir(common.scratch(spark).replace("file:", "")))


SPILLS = """
import sys
from pyspark.sql import SparkSession, functions as F
from quern.llm import shards
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.shuffle.spill.numElementsForceSpillThreshold", "150").getOrCreate()
rows = spark.range(0, 6000, 1, 2).select(F.col("id").alias("slot"), F.floor(F.col("id") / 500).alias("shard"), F.encode(F.lpad(F.col("id").cast("string"), 8, "0"), "utf-8").alias("record"))
same = rows.mapInArrow(lambda batches: batches, rows.schema)
shards.write_shards(same, sys.argv[1])
"""


def test_slots_keep_their_places_when_the_writer_spills(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    path = tmp_path / "s"
    subprocess.run([sys.executable, "-c", SPILLS, str(path)], check=True, timeout=300, cwd=Path(__file__).parents[2], capture_output=True)
    for k in range(12):
        (file,) = (path / f"shard={k}").glob("part-*")
        data = file.read_bytes()
        assert [int(data[i : i + 8]) for i in range(0, len(data), 9)] == list(range(500 * k, 500 * k + 500))


# --- 8 language model -----------------------------------------------------------------------


def brute_katz(rows, order):
    tokens = [[*words(t), b"\0end"] for _, t, *_ in rows]
    learn = [zlib.crc32(str(d).encode()) % 7 != 2 for d, *_ in rows]
    runs = lambda w, k: list(zip(*([b"\0start"] * (k - 1 - j) + w for j in range(k))))
    counts = [None] + [Counter(g for w, ok in zip(tokens, learn) if ok for g in runs(w, k)) for k in range(1, order + 1)]
    one = counts[1]
    n, v = sum(one.values()), len(one)
    seen = lambda c: [len(c), sum(c.values()), *(sum(x == k for x in c.values()) for k in range(1, katz.K + 2))]
    d = [None] + [katz.discounts(seen(c)) for c in counts[1:]]
    kept = lambda k, c: d[k][min(c, katz.K + 1)] * c
    unknown = sum(c - kept(1, c) for c in one.values()) / n
    follow = defaultdict(list)
    for k in range(2, order + 1):
        for g in counts[k]:
            follow[g[:-1]].append(g[-1])

    def p(h, w):
        if not h:
            return kept(1, one[w,]) / n if one[w,] else unknown
        if h not in follow:
            return p(h[1:], w)
        c, k = counts[len(h) + 1], len(h) + 1
        return kept(k, c[*h, w]) / total(h) if c[*h, w] else weight(h) * p(h[1:], w)

    @cache
    def total(h):
        return sum(counts[len(h) + 1][*h, w] for w in follow[h]) + katz.HELD_BACK

    @cache
    def weight(h):
        return (1 - sum(p(h, w) for w in follow[h])) / (1 - sum(p(h[1:], w) for w in follow[h]))

    for h in [h for k in range(1, order) for h in [h for h in follow if len(h) == k][:5]]:
        assert abs(sum(p(h, w) for (w,) in one) + p(h, b"unknown") - 1) < 1e-9
    return {i: (len(w), sum(one[x,] > 0 for x in w), n, sum(math.log10((one[x,] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(g[:-1], g[-1])) for g in runs(w, order))) for (i, *_), w in zip(rows, tokens)}


@pytest.mark.parametrize(("size", "order"), [(2000, 2), (2000, 3), (1 << 24, 3), (2000, 4)])
def test_katz_equals_brute_force(spark, size, order):
    rows = documents()
    got = {r["doc_id"]: r for r in katz.score(clash(frame(spark, rows)), train=~katz.held_out(F.col("doc_id")), order=order, batch_bytes=size, bucket_bytes=5000).collect()}
    for d, want in brute_katz(rows, order).items():
        assert tuple(got[d])[1:4] == want[:3]
        assert np.allclose(tuple(got[d])[4:], want[3:], rtol=1e-9)


def test_counts_above_32_bits():
    big = np.array([0, 5_000_000_000, (1 << 40) + 3, 7])
    assert (katz._wide(katz._narrow(big)) == big).all()
    for top in (0, 255, 256, 65_535, 65_536, (1 << 32) - 1, 1 << 32):
        assert (katz._wide(katz._narrow(np.array([1, top]))) == [1, top]).all()
    assert len(katz._wide(katz._narrow(np.zeros(0, np.int64)))) == 0


def test_katz_of_repeated_batches_and_null_ids(spark):
    rows = documents(n=12)
    docs = frame(spark, rows).coalesce(1)
    twice = docs.union(docs).union(docs.select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:]))
    got = katz.score(clash(twice), train=F.lit(True), batch_bytes=1 << 24).toPandas()
    assert len(got) == 3 * len(rows) and got.doc_id.isna().sum() == len(rows)
    assert (got.groupby("doc_id").score.nunique() == 1).all()
    once = katz.score(docs.union(docs).union(docs), train=F.lit(True)).toPandas()
    assert np.allclose(sorted(once.score), sorted(got.score))


def test_katz_without_learning_texts(spark):
    out = katz.score(frame(spark), train=F.lit(False)).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in out)
    assert katz.score(frame(spark).limit(0), train=F.lit(True)).count() == 0


# --- 9 line de-duplication ------------------------------------------------------------------


def brute_lines(rows, least):
    """Every run of whole lines of ``least`` words or more that equals an earlier one goes. Runs of fewest words are enough, as they make up all others."""
    import re

    white = " \t\n\x0b\x0c\r"
    first, out = {}, {}
    for d, t, *_ in sorted(rows):
        lead = t[: len(t) - len(t.lstrip(white))]
        cuts = [0, *(m.end() for m in re.finditer(r"(?:[.!?] |\n)[\x20\x09-\x0D]*", t[len(lead) :])), len(t) - len(lead)]
        lines = [t[len(lead) :][a:b] for a, b in zip(cuts, cuts[1:])]
        lines[0] = lead + lines[0]
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if n[j - 1] and n[i] and sum(n[i:j]) >= least:
                    run = tuple(x.strip(white) for x in lines[i:j])
                    if first.setdefault(run, (d, i)) != (d, i):
                        gone |= set(range(i, j))
                    if sum(n[i + 1 : j - 1]) >= least:
                        break
        out[d] = "".join(x for k, x in enumerate(lines) if k not in gone), len(gone), sum(n[k] for k in gone)
    return out


def removed(out):
    return {r["doc_id"]: (r["text"], r["removed_lines"], r["removed_words"]) for r in out.collect()}


def test_repeated_runs_equal_brute_force(spark):
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = documents(n=12)
    rows += [(200 + k, f"{prose(rng, 40)}\n{prose(rng, 7)} {passage} {prose(rng, 20)}\n\n{prose(rng, 9)}", None, None, 0) for k in range(4)]
    rows += [(300, "\n".join(["same words in a line here"] * 12), None, None, 0), (301, "short.\nshort.\nshort.", None, None, 0)]
    rows += [(310, " \n " + rows[2][1] + "  \n\n", None, None, 0), (311, rows[3][1].replace(" ", "\t") + "!? .. " + rows[4][1], None, None, 0), (312, "...." * 50_000, None, None, 0), (313, " ".join([prose(rng, 9) + "."] * 4000), None, None, 0)]
    out = linededup.remove_repeats(clash(frame(spark, rows)), min_words=30)
    got, want = removed(out), brute_lines([r for r in rows if r[1]], 30)
    assert {d: got[d] for d in want} == want
    assert got[200][2] == 0 and all(got[d][2] >= 30 for d in (201, 202, 203, 300, 310, 313))
    assert [got[r[0]][0] for r in rows if not r[1]] == [r[1] for r in rows if not r[1]]


def test_lines_make_up_the_text(spark):
    texts = [t for _, t, *_ in documents() if t] + ["a. \n\n b!? c.d", ". . .", "\r\n x\r\n\x85y\u2028z. ", "x" * 300_000, ". " * 100_000, "?" * 300_000, " " * 300_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", linededup.lines_of(F.col("t")).alias("l"))
    assert [("".join(r["l"]), r["t"]) for r in df.collect() if "".join(r["l"]) != r["t"]] == []


def test_repeats_awkward_rows(spark):
    rows = documents(n=4)
    docs = frame(spark, [*rows, rows[0], (None, rows[1][1], None, None, 0), (7, rows[2][1], None, None, 0), (900, "\n\n one \n" + rows[2][1], None, None, 0)])
    out = linededup.remove_repeats(docs).toPandas()
    assert len(out) == len(rows) + 4
    twice = out[out.doc_id == 0]
    assert (twice.text == rows[0][1]).all() and (twice.removed_lines == 0).all()
    assert (out[out.doc_id == 1].text == "").all()
    assert out[out.doc_id == 900].text.iloc[0] == "\n\n one \n"
    assert linededup.remove_repeats(docs.limit(0)).count() == 0


def lines_of_words(rng, *sizes):
    return "".join(" ".join(f"v{rng.randrange(10**9)}" for _ in range(n)) + ".\n" for n in sizes)


def test_repeats_are_extended_both_ways(spark):
    """Also where the first occurrence of a run's middle goes on differently: C shares the middle with A, and its ends only with B."""
    rng = random.Random(11)
    runs = [lines_of_words(rng, *s) for s in ([40, 20], [20, 40], [25, 10, 10], [11, 11, 11], [3, 90, 4], [29], [12, 17], [4] * 9)]
    rows = [(2 * k + j, lines_of_words(rng, 9) + r + lines_of_words(rng, 6), None, None, 0) for k, r in enumerate(runs) for j in (0, 1)]
    rows += [(100 + j, runs[0], None, None, 0) for j in (0, 1)]
    head, middle, tail = (lines_of_words(rng, *s) for s in ([7], [20, 15], [10]))
    rows += [(200, middle, None, None, 0), (201, head + middle + tail, None, None, 0), (202, lines_of_words(rng, 5) + head + middle + tail + lines_of_words(rng, 8), None, None, 0)]
    got = removed(linededup.remove_repeats(clash(frame(spark, rows)), min_words=30))
    assert got == brute_lines(rows, 30)
    assert [got[d][2] for d in (1, 3, 5, 7, 9, 11, 13, 15, 101, 200, 201, 202)] == [60, 60, 45, 33, 97, 0, 0, 36, 60, 0, 35, 52]
    assert removed(linededup.remove_repeats(frame(spark, rows))) == brute_lines(rows, 15)


@pytest.mark.parametrize("min_words", [1, 15])
def test_runs_need_no_sorted_lines(spark, monkeypatch, min_words):
    """The same as by windows over all lines, without sorting them; also where a run goes over the end of a part."""
    monkeypatch.setattr(linededup, "_PART", 8)
    rng = random.Random(12)
    some = [lines_of_words(rng, *[rng.randrange(1, 20) for _ in range(rng.randrange(1, 9))]) for _ in range(12)]
    rows = [(k, "".join(rng.choice(some) for _ in range(rng.randrange(1, 12))), None, None, 0) for k in range(25)]
    placed = linededup.orders(frame(spark, rows))
    hits = linededup.candidates(placed, min_words)
    found = linededup.runs(placed, hits, min_words)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(linededup, "_BESIDE", 0)
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(found) == same(linededup.runs(placed, hits, min_words)) != []


def test_fingerprints_are_a_part_of_the_lines(spark):
    rng = random.Random(10)
    docs = frame(spark, [(k, lines_of_words(rng, *[rng.randrange(1, 7) for _ in range(300)]), None, None, 0) for k in range(20)])
    n = linededup.fingerprints(linededup.orders(docs), 15).count()
    assert 20 * 300 * 0.2 < n < 20 * 300 * 0.6


# --- 10 fingerprints ------------------------------------------------------------------------


def test_fingerprints_of_edits(spark):
    rows = documents()
    got = {r["doc_id"]: r for r in fingerprint.digest(fingerprint.fingerprints(clash(frame(spark, rows)))).collect()}
    texts = [t or "" for _, t, *_ in rows]
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    errors, by_text = [], {}
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = got[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        low = lambda x: {tuple(w) for w in shingles(x.lower())}
        errors += [abs(r["near_edited"] - jaccard(low(t), low(edited))), abs(r["near_next"] - jaccard(low(t), low(after)))]
        bound, body = r["fingerprint"].split(":")
        assert len(base64.b64decode(body)) % 6 == 0 and int(bound, 16) < fingerprint.RANGE
    assert np.mean(errors) < 0.03 and max(errors) < 0.25


def test_containment_and_merge(spark):
    rng = random.Random(4)
    part = prose(rng, 400, 9000)
    whole = part + " " + prose(rng, 6000, 9000)
    df = spark.createDataFrame([(part, whole, whole[len(part) :])], "a string, b string, c string").select(*(fingerprint.sketch(F.col(c)).alias(c) for c in "abc"))
    r = df.select(fingerprint.containment(F.col("a"), F.col("b")).alias("x"), fingerprint.likeness(fingerprint.merge(F.col("a"), F.col("c")), F.col("b")).alias("y"), fingerprint.likeness(F.col("a"), F.col("b")).alias("z")).first()
    assert r["x"] > 0.9 and r["y"] > 0.9 and r["z"] < 0.2


def test_fingerprints_awkward_rows(spark):
    docs = frame(spark, [(5, "a b c d e f g h", None, None, 0), (5, "other words here", None, None, 0), (None, "x y z w v", None, None, 0)])
    assert fingerprint.digest(fingerprint.fingerprints(docs)).count() == 3
    one = fingerprint.digest(fingerprint.fingerprints(docs.limit(1))).first()
    assert one["near_next"] == 1.0
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
