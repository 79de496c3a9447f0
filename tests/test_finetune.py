import json

import pytest
from pyspark.sql import functions as F

from quern.functions import chat
from quern.operators import finetune, profile, sampling
from quern.plans import runner
from quern.sources import sinks


def pairs(spark, n=50):
    long = "This answer has more than ten words in it so that it passes every rule."
    return spark.createDataFrame([(k, f"Tell me about thing {k}", f"{long} {k}.") for k in range(n)], "rid long, prompt string, completion string")


@pytest.mark.parametrize(
    ("columns", "name"),
    [(["Messages"], "sharegpt"), (["conversations", "instruction", "output"], "sharegpt"), (["instruction", "output"], "alpaca"), (["question", "answer"], "qa_pairs"), (["q", "a"], "qa_pairs"), (["prompt", "completion"], "raw_pairs"), (["x"], "raw_pairs")],
)
def test_detect(columns, name):
    assert chat.detect(columns)[0] == name


def test_sharegpt_edges(spark):
    rows = ['[{"role":"user","content":"Q"},{"role":"assistant","content":"A"}]', "[{'from':'human','value':'Q'},{'from':'gpt','value':'A'}]", '[{"role":"user","content":"Q"}]', '[{"role":"user","content":"Q"},{"role":"user","content":"R"}]', "broken", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "rid long, messages string")
    out, name, _ = chat.normalise(df)
    got = [(r[chat.NORMAL[0]], r[chat.NORMAL[2]]) for r in out.orderBy("rid").collect()]
    assert name == "sharegpt"
    assert got == [("Q", "A"), ("Q", "A"), ("", ""), ("Q", ""), ("", ""), ("", "")]


@pytest.mark.parametrize("target", chat.FORMATS)
def test_formats(spark, target):
    one = spark.range(1).select(chat.formatted(target, F.lit("I"), F.lit("X"), F.lit('O"'), "S").alias("t")).first()["t"]
    if target in ("alpaca", "sharegpt", "openai"):
        assert 'O"' in json.dumps(json.loads(one), ensure_ascii=False).replace('\\"', '"')
    else:
        assert "I\nX" in one
        assert "S" in one


def test_token_limit_keeps_normal_columns(spark):
    out = finetune.format_examples(pairs(spark, 3), {"max_tokens_per_example": 10})
    assert out.df.count() == 0
    out = finetune.format_examples(pairs(spark, 3), {"output_format": "llama3"})
    assert out.df.columns[:2] == ["formatted_text", "token_count"]
    assert out.df.filter("token_count > 0").count() == 3


def groups(spark, **sizes):
    rows = [(f"{c}{k}", c) for c, n in sizes.items() for k in range(n)] + [("null", None)]
    return spark.createDataFrame(rows, "rid string, cat string")


@pytest.mark.parametrize(
    ("conf", "counts"),
    [({}, {"A": 10, "B": 10}), ({"method": "oversample"}, {"A": 100, "B": 100}), ({"balance_ratio": 0.5}, {"A": 20, "B": 10}), ({"method": "augment", "max_per_category": 30}, {"A": 30, "B": 30}), ({"max_per_category": 4}, {"A": 4, "B": 4})],
)
def test_balance(spark, conf, counts):
    out = sampling.balance(groups(spark, A=100, B=10), {"id_column": "rid", "target_column": "cat", **conf})
    assert {r["cat"]: r["rows"] for r in out.metrics.collect()} == counts


def test_balance_without_category(spark):
    df = spark.createDataFrame([(f"r{k}", "one") for k in range(60)], "rid string, cat string")
    assert sampling.balance(df, {"id_column": "rid"}).details["status"] == "skipped"
    assert sampling.category_column(groups(spark, A=3, B=2)) == "cat"


@pytest.mark.parametrize(("n", "train", "val"), [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 2, 1), (50, 45, 5)])
def test_split_counts(spark, n, train, val):
    out = sampling.split(spark.range(n), id_column="id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {k: v for k, v in (("train", train), ("val", val)) if v}


def test_split_is_stratified_and_disjoint(spark):
    df = groups(spark, A=40, B=10).filter("cat is not null")
    out = sampling.split(df, id_column="rid", train=0.8, val=0.2, stratify="cat")
    assert {(r["cat"], r["split"]): r["count"] for r in out.groupBy("cat", "split").count().collect()} == {("A", "train"): 32, ("A", "val"): 8, ("B", "train"): 8, ("B", "val"): 2}
    assert out.select("rid").distinct().count() == 50
    assert sampling.split(groups(spark, A=9, B=1).filter("cat is not null"), id_column="rid", stratify="cat").count() == 10


def test_run_finetune(spark, tmp_path):
    config = runner.FinetuneConfig(id_column="rid", output_format="alpaca", train_split=0.8, val_split=0.2)
    out = runner.run_finetune(pairs(spark), config)
    s = out.summary()
    assert (s["train_examples"], s["val_examples"], s["epochs"]) == (40, 10, 10)
    assert sinks.write_array(out.val, str(tmp_path / "val.json")) == 10
    assert len(json.load(open(tmp_path / "val.json"))) == 10
    sinks.write_examples(out.train, str(tmp_path / "train"), "alpaca")
    assert spark.read.json(str(tmp_path / "train")).count() == 40


@pytest.mark.parametrize(("n", "epochs"), [(5001, 3), (5000, 5), (1001, 5), (1000, 10)])
def test_training_config(n, epochs):
    assert finetune.training_config(n, 100.0, "mistral")["epochs"] == epochs
    assert finetune.training_hours(10, 1.0) == "< 6 mins"
    assert finetune.training_hours(1_000_000, 60.0) == "~10.0 hours"


def test_analysis(spark):
    df = spark.createDataFrame([("a@b.co is my address today",)] * 3 + [("x",), (None,)], "text string")
    a = profile.analyze(df)
    assert a.dataset_type == "documents"
    assert [i["type"] for i in a.issues] == ["duplicates", "pii_detected", "missing_values", "low_quality"]
    assert [r["step"] for r in a.recommendations] == ["deduplication", "noise_removal", "pii_scrubbing", "quality_scorer"]
    assert profile.plan(a.recommendations, 100)["estimated_rows_after"] == 90
    assert profile.analyze(df.limit(0)).row_count == 0


def test_stats_and_synthetic(spark):
    df = spark.createDataFrame([(1.0, "a", True), (float("nan"), None, False), (float("inf"), "a", None)], "x double, s string, b boolean")
    s = {r["column"]: r for r in profile.column_stats(df).collect()}
    assert (s["x"]["null_count"], s["x"]["max"], s["s"]["unique_count"], s["b"]["mean"]) == (1, 1.0, 1, 0.5)
    made = profile.synthetic(["q"], 5, lambda n: [{"q": "x"}, {"q": None}, {"q": "y"}][:n], batch=3)
    assert all(r["is_synthetic"] for r in made)
