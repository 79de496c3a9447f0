"""Statistics of a table, and what they suggest: issues, steps, a plan, a verdict."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import language, pii, quality
from quern.functions.names import col, cols, fresh
from quern.operators.steps import longest_text_column, row_order, text_columns


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(k, n): the exact number of distinct values of the k-th of ``columns`` that aren't null or NaN; columns without any have no row. One pass: cells of fixed width, a value's hashes of 128 bits (of 64 where a value has no more), which are made distinct in each task before they are shuffled by value, so neither wide columns nor hot values cost more."""
    cells = []
    for k, name in enumerate(columns):
        kind, c = df.schema[name].dataType, col(name)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c + F.lit(0.0))
        elif isinstance(kind, (T.ArrayType, T.StructType)):
            # hashes skip nulls inside a value; its JSON doesn't
            c = F.when(c.isNotNull(), F.to_json(c, {"ignoreNullFields": "false"}))
        narrow = not isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType, T.ArrayType, T.StructType))
        cells.append(F.when(c.isNotNull(), F.struct(F.lit(k).alias("k"), F.xxhash64(c).alias("a"), (F.lit(0).cast("long") if narrow else F.xxhash64(F.lit(1), c)).alias("b"))))
    if not cells:
        return df.sparkSession.createDataFrame([], "k int, n long")
    found = df.select(F.explode(F.array(*cells)).alias("c")).filter("c is not null").select("c.*").distinct()
    return found.groupBy("k").agg(F.count("*").alias("n"))


def column_stats(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """A row for each column: type, nulls, share of nulls, distinct values; of numbers also least, most, mean and sample deviation. NaN counts as null, infinity has no figure. Distinct values are counted exactly in a second pass (``distinct_counts``), or with ``approximate`` by sketches in the same one; maps have no figure."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    countable = [k for k, f in enumerate(fields) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    aggregates = [F.count("*").alias("rows")]
    for k, f in enumerate(fields):
        c = col(f.name)
        real = isinstance(f.dataType, (T.FloatType, T.DoubleType))
        number = isinstance(f.dataType, (T.NumericType, T.BooleanType))
        value = F.when(~F.isnan(c), c) if real else c
        sketch = F.approx_count_distinct(value) if approximate and k in countable else F.lit(None).cast("long")
        aggregates += [F.count(value).alias(f"n{k}"), sketch.alias(f"d{k}")]
        x = value.cast("int").cast("double") if isinstance(f.dataType, T.BooleanType) else value.cast("double")
        x = F.when(F.abs(x) != float("inf"), x) if real else x
        aggregates += [g(x).alias(f"{p}{k}") if number else F.lit(None).cast("double").alias(f"{p}{k}") for p, g in (("a", F.min), ("b", F.max), ("m", F.avg), ("s", F.stddev_samp))]
    one = df.agg(*aggregates)
    rows = F.array(
        *(
            F.struct(
                F.lit(k).alias("k"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                (F.col("rows") - F.col(f"n{k}")).alias("null_count"),
                F.coalesce(quality.half_up(F.try_divide((F.col("rows") - F.col(f"n{k}")) * 100.0, F.col("rows"))), F.lit(0.0)).alias("null_percentage"),
                F.col(f"d{k}").alias("unique_count"),
                *(F.col(f"{p}{k}").alias(n) for p, n in (("a", "min"), ("b", "max"), ("m", "mean"), ("s", "std"))),
            )
            for k, f in enumerate(fields)
        )
    )
    stats = one.select(F.explode(rows).alias("r")).select("r.*")
    if not approximate:
        named = [fields[k].name for k in countable]
        # a row for each column at most
        places = F.element_at(F.array(*(F.lit(k) for k in countable)), F.col("k") + 1) if countable else F.col("k")
        counts = F.broadcast(distinct_counts(df, named).select(places.alias("at"), F.col("n")))
        stats = stats.join(counts, F.col("k") == F.col("at"), "left")
        if countable:
            stats = stats.withColumn("unique_count", F.when(F.col("k").isin(countable), F.coalesce("n", F.lit(0))))
    return stats.select("column", "type", "null_count", "null_percentage", "unique_count", "min", "max", "mean", "std")


def sample_values(df: DataFrame, column: str, n: int = 5, order_by: str | None = None) -> list:
    """The first values that aren't null, in the order of the rows."""
    return [r[0] for r in df.filter(col(column).isNotNull()).orderBy(*row_order(df, order_by)).select(col(column)).limit(n).collect()]


def token_total(df: DataFrame, counter=None) -> DataFrame:
    """Estimated tokens of all text: by ``counter`` where one is given, else three quarters of a token for each character."""
    names = text_columns(df)
    if counter is None:
        chars = sum((F.coalesce(F.length(col(c)), F.lit(0)) for c in names), F.lit(0))
        return df.agg(F.floor(F.coalesce(F.sum(chars), F.lit(0)) * 0.75).cast("long").alias("token_estimate"))
    return df.agg(F.coalesce(F.sum(sum((counter(F.coalesce(col(c), F.lit(""))) for c in names), F.lit(0))), F.lit(0)).cast("long").alias("token_estimate"))


def table_language(df: DataFrame, order_by: str | None = None) -> str | None:
    """Of the first 20 texts of the first text column."""
    names = text_columns(df)
    if not names:
        return None
    some = df.filter(col(names[0]).isNotNull()).orderBy(*row_order(df, order_by)).limit(20).select(col(names[0]).alias("t"))
    row = some.agg(F.array_join(F.collect_list("t"), " ").alias("t")).select("t", language.guess(F.col("t")).alias("g")).first()
    return row["g"]["language"] if row["t"] and len(row["t"].strip()) >= 20 else None


def table_kind(df: DataFrame) -> str:
    have, strings = {c.lower() for c in df.columns}, text_columns(df)
    sets = (("instruction_pairs", ({"instruction", "input", "output"}, {"prompt", "completion"})), ("qa", ({"question", "answer"}, {"q", "a"})), ("chat", ({"messages"}, {"conversations"}, {"role", "content"})), ("code", ({"code"}, {"repository"})))
    for kind, any_of in sets:
        if any(s <= have for s in any_of):
            return kind
    return "tabular" if len(strings) <= 1 and len(df.columns) > 3 else "documents"


MODES = {"instruction_pairs": "finetune", "chat": "finetune", "documents": "rag", "tabular": "ml"}
_NAMED = {"instruction_pairs": ("instruction", "input", "output", "prompt", "completion"), "qa": ("question", "answer", "q", "a"), "chat": ("messages", "content")}


def primary_text_columns(df: DataFrame, kind: str) -> list[str]:
    if kind in _NAMED:
        return [c for c in df.columns if c.lower() in _NAMED[kind]]
    names = text_columns(df)
    if len(names) <= 1:
        return names
    means = dict(zip(names, df.agg(*(F.avg(F.length(F.coalesce(col(c), F.lit("")))) for c in names)).first(), strict=True))
    return sorted(names, key=lambda c: -(means[c] or 0))[:3]


def ratios(df: DataFrame, texts: list[str]) -> DataFrame:
    """One row over all rows: their number and the shares of duplicate rows, of rows with personal data, with nulls by column, and of short texts."""
    (n,) = fresh(df, "n")
    groups = df.groupBy(*cols(df.columns)).agg(F.count("*").alias(n)) if df.columns else df
    found = F.size(pii.found(cols(texts), list(pii.PATTERNS))) > 0 if texts else F.lit(False)
    short = sum((F.when(F.length(F.coalesce(col(c).cast("string"), F.lit(""))) < 10, 1).otherwise(0) for c in texts), F.lit(0)) / max(1, len(texts))
    w = F.col(n)
    return groups.agg(
        F.coalesce(F.sum(w), F.lit(0)).alias("row_count"),
        F.coalesce(F.try_divide(F.sum(w - 1).cast("double"), F.sum(w)), F.lit(0.0)).alias("duplicate_ratio"),
        F.coalesce(F.try_divide(F.sum(F.when(found, w).otherwise(0)).cast("double"), F.sum(w)), F.lit(0.0)).alias("pii_ratio"),
        F.coalesce(F.try_divide(F.sum(short * w), F.sum(w)), F.lit(0.0)).alias("short_ratio"),
        *(F.coalesce(F.try_divide(F.sum(F.when(col(c).isNull(), w).otherwise(0)).cast("double"), F.sum(w)), F.lit(0.0)).alias(f"null_ratio_{c}") for c in texts),
    )


def issues(found: DataFrame, texts: list[str]) -> DataFrame:
    """severity, type and affected_rows from ``ratios``, in fixed order."""
    r = {c: col(c) for c in found.columns}
    one = lambda ratio, kind, severity: F.struct(severity.alias("severity"), F.lit(kind).alias("type"), F.floor(r["row_count"] * ratio + 1e-9).cast("long").alias("affected_rows"))
    rules = [
        F.when(r["duplicate_ratio"] > 0.01, one(r["duplicate_ratio"], "duplicates", F.when(r["duplicate_ratio"] > 0.1, "high").otherwise("medium"))),
        F.when(r["pii_ratio"] > 0, one(r["pii_ratio"], "pii_detected", F.when(r["pii_ratio"] > 0.05, "high").otherwise("medium"))),
        *(F.when(r[f"null_ratio_{c}"] > 0, one(r[f"null_ratio_{c}"], "missing_values", F.when(r[f"null_ratio_{c}"] > 0.1, "medium").otherwise("low"))) for c in texts),
        F.when(r["short_ratio"] > 0.2, one(r["short_ratio"], "low_quality", F.lit("medium"))),
    ]
    return found.select(F.posexplode(F.array_compact(F.array(*rules))).alias("place", "i")).select("place", "i.*")


@dataclass
class Analysis:
    dataset_type: str
    primary_text_columns: list[str]
    detected_language: str
    estimated_quality: float
    row_count: int
    issues: list[dict]
    recommendations: list[dict]
    recommended_mode: str
    confidence: float
    summary: str


def recommend(kind: str, found: set[str]) -> list[dict]:
    """Steps in their order, with priorities."""
    rules = (
        ("duplicates" in found, "deduplication", {"method": "exact", "columns": "all", "keep": "first"}, 1),
        (True, "noise_removal", {"fix_encoding": True, "strip_html": True, "normalize_whitespace": True}, 2),
        ("pii_detected" in found, "pii_scrubbing", {"action": "redact", "entities": ["ALL"]}, 1),
        ("low_quality" in found or kind in ("instruction_pairs", "qa"), "quality_scorer", {"method": "heuristic", "action": "filter", "threshold": 4.0}, 2),
    )
    return [{"step": s, "config": c, "priority": p} for ok, s, c, p in rules if ok]


def analyze(df: DataFrame, summarise=None) -> Analysis:
    """Reads all rows, not a sample. ``summarise`` may replace the summary text."""
    kind = table_kind(df)
    texts = primary_text_columns(df, kind)
    found = ratios(df, [c for c in texts if c in text_columns(df)])
    # one row, which the issues are told from without reading the table again
    found = df.sparkSession.createDataFrame([found.first()], found.schema)
    row = found.first().asDict()
    listed = [r.asDict() for r in issues(found, [c for c in texts if c in text_columns(df)]).orderBy("place").collect()]
    column = longest_text_column(df)
    top = df.groupBy(language.guess(col(column))["language"].alias("l")).count().orderBy(F.desc("count"), "l").first() if column else None
    tongue = top["l"] if top else "unknown"
    good = max(0.0, 10.0 - row["duplicate_ratio"] * 10 - row["short_ratio"] * 10 - len(listed) * 0.5)
    text = f"{row['row_count']:,} rows of {kind} (language: {tongue}), quality {good:.1f} of 10; " + (f"{len(listed)} issues: " + ", ".join(i["type"].replace("_", " ") for i in listed[:2]) if listed else "no issues") + "."
    if summarise:
        text = summarise(text) or text
    return Analysis(kind, texts, tongue, math.floor(good * 10 + 0.5) / 10, row["row_count"], listed, recommend(kind, {i["type"] for i in listed}), MODES.get(kind, "common"), 0.7, text)


def plan(recommendations: list[dict], rows: int) -> dict:
    """One step for each recommendation, with estimates."""
    steps = [{"id": f"step_{k}", "step": r["step"], "label": r["step"].replace("_", " ").title(), "config": r["config"], "required": r["priority"] == 1} for k, r in enumerate(recommendations, 1)]
    return {"steps": steps, "estimated_duration": max(5, 10 * len(steps)), "estimated_rows_after": rows - rows // 10}


def plan_from(answer: dict) -> dict:
    """A plan that a model has written, with defaults for what it leaves out."""
    steps = [{"id": s.get("id", f"step_{k}"), "step": s.get("step", ""), "label": s.get("label", s.get("step", "").replace("_", " ").title()), "config": s.get("config", {}), "reason": s.get("reason", ""), "required": s.get("required", False)} for k, s in enumerate(answer.get("steps", []), 1)]
    return {"steps": steps, "estimated_duration": answer.get("estimated_duration", max(5, 10 * len(steps))), "estimated_rows_after": answer.get("estimated_rows_after", 0)}


def insight(before, after):
    """Readiness score and label, as columns of the rows before and after."""
    removed = before - after
    score = F.when(removed > before * 0.5, 6.5).otherwise(8.5)
    return removed.alias("rows_removed"), score.alias("readiness_score"), F.when(score > 9, "Excellent").when(score < 7, "Needs Work").otherwise("Good").alias("readiness_label")


def synthetic(schema: list[str], count: int, generate, batch: int = 10) -> list[dict]:
    """Rows from ``generate(n)``, asked ceil(count / batch) times; only complete ones, at most ``count``, tagged."""
    out: list[dict] = []
    for k in range(math.ceil(count / batch)):
        out += [r for r in generate(min(batch, count - k * batch)) if all(r.get(c) is not None for c in schema)]
    return [r | {"is_synthetic": True} for r in out[:count]]


