"""Operators on tables whose key columns have dots in their names, among others that have, too."""

import datetime

import pytest
from pyspark.sql import functions as F

from quern.llm import decontam, fingerprint, funnel, katz, langid, lexical, linededup, minhash, packing, pii, recompress, shards, urlfilter

from .fixtures import frame

ODD = ("a.b", "a`c", "_r", "_n", "_c", "_k")


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark).withColumnsRenamed({"doc_id": "doc.id", "text": "the.text"}).withColumns({c: F.lit(7) for c in ODD})


NAMES = {"id_column": "doc.id", "text_column": "the.text"}


def kept(df, out):
    assert set(df.columns) <= set(out.columns)
    rows = out.collect()
    assert all(r[c] == 7 for r in rows for c in ODD)
    return len(rows)


def test_operators_that_keep_all_columns(spark, odd):
    n = odd.count()
    assert kept(odd, linededup.remove_repeats(odd, **NAMES)) == n
    assert 0 < kept(odd, minhash.drop_near_duplicates(odd, **NAMES)) < n
    assert kept(odd, pii.pseudonymise(odd, key="k", text_column="the.text")) == n
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and then runs far away from it")], "`item.id` long, `item.text` string")
    assert kept(odd, decontam.drop_contaminated(odd, items, item_column="item.id", item_text="item.text", **NAMES)) == n
    model = langid.learn(odd.withColumnRenamed("lang", "its.lang"), train=F.lit(True), language="its.lang", **NAMES)
    assert kept(odd, langid.tag(odd, model, text_column="the.text")) == n
    captures = odd.select(F.lit("http://a.example.com/x").alias("the.url"), F.lit(datetime.datetime(2024, 5, 1)).alias("the.time"), *(F.col(f"`{c.replace('`', '``')}`") for c in ODD))
    entries = spark.createDataFrame([("l", "example.com", "add", datetime.datetime(2024, 1, 1))], "list string, key string, action string, at timestamp")
    out = urlfilter.as_of(captures, entries, url_column="the.url", time_column="the.time")
    assert kept(captures, out) == n and out.filter("blocked").count() == n


def test_operators_with_their_own_columns(spark, odd):
    n = odd.count()
    assert fingerprint.fingerprints(odd, **NAMES).count() == n
    assert katz.score(odd, train=F.lit(True), **NAMES).count() == n
    assert packing.pack(odd, with_ids=False, **NAMES).select("doc_id").distinct().count() == n
    assert shards.materialise(odd, key=5, text_column="the.text").count() > 0
    kept = recompress.remove_repeats(odd, **NAMES)
    assert kept.columns[0] == "doc.id" and kept.count() == n
    found = lexical.search(lexical.build(odd, **NAMES), odd.limit(3), id_column="doc.id", text_column="the.text")
    assert found.columns[0] == "doc.id" and found.count() == 30
    events = spark.createDataFrame([(1, "v", datetime.datetime(2024, 1, 1)), (1, "c", datetime.datetime(2024, 1, 1, 0, 1))], "`c.id` long, `the.kind` string, `the.ts` timestamp")
    out = funnel.funnels(events, [funnel.Funnel("f", ("v", "c"))], client_column="c.id", kind_column="the.kind", time_column="the.ts")
    assert tuple(out.first()) == ("f", 1, 1, 1, 2, 60_000_000, 1) and out.columns[1] == "c.id"
