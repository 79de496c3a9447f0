"""Distinct values and the upper median against plain Python."""

import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.operators import profile, steps

SCHEMA = "s string, b binary, i int, l long, d double, f float, big decimal(38,10), small decimal(9,2), day date, at timestamp, yes boolean, list array<int>, pair struct<x:int,y:int>, m map<string,int>, `a.b` string, k int, n long, c string"


def some_rows(n, rng):
    few = lambda *v: rng.choice([None, *v])
    for _ in range(n):
        word = few("", "a", "b", "a b", "ä", "x" * rng.randrange(50))
        number = few(0, 1, -1, 2**31 - 1, rng.randrange(40))
        real = few(0.0, -0.0, 1.5, float("nan"), float("inf"), rng.randrange(9) / 7)
        yield (
            word, None if word is None else bytearray(word.encode()), number, number and number * 2**32, real, real, None if number is None else Decimal(number) / 4, few(Decimal("1.10"), Decimal("1.20")),
            few(date(2024, 1, 1), date(2024, 1, 2)), few(datetime(2024, 1, 1), datetime(2024, 1, 1, 1)), few(True, False), few([], [1], [1, None], [None, 1], [2]), few((1, None), (None, 1), (1, 1)), few({"a": 1}), word, number, number, word,
        )


@pytest.mark.parametrize("n", [0, 1, 400])
def test_distinct_counts_equal_plain_python(spark, n):
    rows = [*some_rows(n, random.Random(n))]
    got = {r["column"]: r["unique_count"] for r in profile.column_stats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert list(got) == [f.name for f in spark.createDataFrame([], SCHEMA).schema.fields]
    assert got.pop("m") is None
    for k, name in enumerate(c for c in got):
        k = k + (k >= 13)  # the map has no figure
        assert got[name] == len({repr(r[k] + 0.0 if isinstance(r[k], float) else r[k]) for r in rows if r[k] is not None and r[k] == r[k]}), name


def test_no_rows_are_multiplied_by_whole_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = profile.column_stats(df)._jdf.queryExecution().toString()
    assert "Expand" not in plan and "CartesianProduct" not in plan
    exact, sketched = ({r["column"]: r["unique_count"] for r in profile.column_stats(df, approximate=a).collect()} for a in (False, True))
    assert all(abs(exact[c] - sketched[c]) <= max(2, 0.2 * exact[c]) for c in exact)
    assert exact["l_orderkey"] == df.select("l_orderkey").distinct().count()


@pytest.mark.parametrize("kind", ["rounded", "unrounded", "equal", "close", "one", "nulls", "none", "outside"])
def test_upper_median(spark, kind):
    rng = random.Random(kind)
    values = {
        "rounded": [round(rng.uniform(0, 10), 2) for _ in range(501)],
        "unrounded": [rng.uniform(0, 10) for _ in range(1000)],
        "equal": [5.25] * 40,
        "close": [5 + k * 1e-13 for k in range(300)],
        "one": [3.0],
        "nulls": [None] * 7 + [1.0, 2.0, 3.0],
        "none": [],
        "outside": [rng.uniform(-50, 150) for _ in range(333)],
    }[kind]
    row = steps.quality_summary(spark.createDataFrame([(v,) for v in values], "quality_score double")).first()
    known, nulls = sorted(v for v in values if v is not None), values.count(None)
    assert row["median_quality_score"] == (known[max(len(values) // 2 - nulls, 0)] if known else None)
    assert row["bin_4_6"] == sum(4 <= v < 6 for v in known)


def test_median_of_the_scores_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scored = steps.score_quality(docs, {})
    values = sorted(r[0] for r in scored.df.select(F.col("quality_score")).collect())
    assert scored.metrics.first()["median_quality_score"] == values[len(values) // 2]
