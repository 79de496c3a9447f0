"""Whole-table steps: each takes rows and options and gives rows, a plan of its metrics and warnings; none runs anything by itself."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import language, pii, quality, spans, text
from quern.functions.names import col, cols, fresh
from quern.operators import semantic


@dataclass
class StepOutput:
    """Rows after a step; a one-row frame of its metrics, counted only when asked for; warnings."""

    df: DataFrame
    metrics: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    details: dict = field(default_factory=dict)


Step = Callable[[DataFrame, dict], StepOutput]
STEPS: dict[str, Step] = {}
#: Other names by which a step may be asked for.
ALIASES = {"pii_scrubber": "pii_scrubbing"}


def step(name: str) -> Callable[[Step], Step]:
    """Registers a step, also for users' own."""

    def put(f: Step) -> Step:
        STEPS[name] = f
        return f

    return put


def find(name: str) -> Step | None:
    return STEPS.get(ALIASES.get(name, name))


def fenced(df: DataFrame) -> DataFrame:
    """The same rows behind a generator. Spark pushes filters through projections by repeating their expressions; through this it doesn't, so costly columns are computed once."""
    return df.select(F.inline(F.array(F.struct(*cols(df.columns)))))


def text_columns(df: DataFrame) -> list[str]:
    """String columns but internal ones, whose names begin with an underscore."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")]


def _columns(df: DataFrame, wanted, every: str) -> list[str]:
    return text_columns(df) if wanted in (None, every, "auto") else [c for c in wanted if c in df.columns]


def _choice(conf: dict, key: str, default: str, allowed: tuple[str, ...]) -> str:
    value = conf.get(key, default)
    if value not in allowed:
        raise ValueError(f"{key} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def row_order(df: DataFrame, order_by: str | list[str] | None) -> list[Column]:
    """Sort keys for first and last: the named columns, or the rows' order in the input, which is fixed for files."""
    names = [order_by] if isinstance(order_by, str) else order_by
    return cols(names) if names else [F.monotonically_increasing_id()]


@step("deduplication")
def deduplicate(df: DataFrame, conf: dict) -> StepOutput:
    """Exact, semantic, or both. Exact rows are equal in all ``columns``, null equal to null; ``compat`` compares one joined text instead, where null is the text None. ``keep`` and ``order_by`` say which row stays. Partial top-1 per task keeps hot groups small before the shuffle."""
    method = _choice(conf, "method", "exact", ("exact", "semantic", "both"))
    keep = _choice(conf, "keep", "first", ("first", "last"))
    warnings, columns = [], conf.get("columns", "all")
    named = df.columns if columns == "all" else [c for c in columns if c in df.columns]
    if not named:
        warnings.append(f"None of the columns {columns} exists; all are compared.")
        named = df.columns
    vector = conf.get("vector_column")
    if method != "exact" and vector not in df.columns:
        warnings.append("No vector column; exact de-duplication instead.")
        method = "exact"
    out = df
    if method in ("exact", "both"):
        if conf.get("compat"):
            keys = [F.sha2(F.concat_ws("|", *(F.coalesce(col(c).cast("string"), F.lit("None")) for c in named)), 256)]
        else:
            keys = cols(named)
        order = row_order(df, conf.get("order_by"))
        order = order if keep == "first" else [c.desc() for c in order]
        (place,) = fresh(out, "place")
        out = out.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) == 1).drop(place)
    if method in ("semantic", "both"):
        out = semantic.deduplicate(out, id_column=conf["order_by"], vector_column=vector, threshold=conf.get("semantic_threshold", 0.95), keep=keep, neighbours=conf.get("neighbours"))
    return StepOutput(out, None, warnings, {"method_used": method, "columns_checked": list(named)})


def cleaned(c: Column, conf: dict) -> tuple[Column, list[str]]:
    """A cell after all sub-steps, in their fixed order, and warnings of patterns that can't be used."""
    on, warnings = (lambda key, default=True: conf.get(key, default)), []
    if on("fix_encoding"):
        c = text.encoding_fixed(c)
    if on("strip_html"):
        c = (text.without_tags if on("html_parser") else text.without_tags_jvm)(c)
    if on("normalize_unicode"):
        c = text.without_zero_width(text.nfc(c))
    if on("remove_control_chars"):
        c = text.without_controls(c)
    if on("normalize_whitespace"):
        c = text.normal_spaces(c)
    if on("strip_urls", False):
        c = text.without_urls(c)
    for pattern in conf.get("custom_patterns", []):
        try:
            re.compile(pattern)
            c = F.regexp_replace(c, pattern, "")
        except re.error as e:
            warnings.append(f"Pattern {pattern!r} can't be used: {e}")
    return c, warnings


@step("noise_removal")
def remove_noise(df: DataFrame, conf: dict) -> StepOutput:
    """Cleans all text columns, then keeps rows whose first one has a length within the bounds that are above 0; a null counts as its name's length."""
    names, warnings = _columns(df, conf.get("columns", "all_text"), "all_text"), []
    if not names:
        return StepOutput(df, None, ["No text columns to clean."])
    new = {}
    for name in names:
        new[name], bad = cleaned(col(name), conf)
        warnings += [w for w in bad if w not in warnings]
    was = dict(zip(names, fresh(df, *(f"was{k}" for k in range(len(names)))), strict=True))
    both = df.withColumns({was[n]: col(n) for n in names}).withColumns(new)
    least, most = conf.get("min_text_length", 0), conf.get("max_text_length", 0)
    size = F.length(F.coalesce(col(names[0]), F.lit("None")))
    fits = F.lit(True)
    if least > 0:
        fits &= size >= least
    if most > 0:
        fits &= size <= most
    change = sum((F.coalesce(F.abs(F.length(was[n]) - F.length(col(n))), F.lit(0)) for n in names), F.lit(0))
    repair = text.encoding_fixed if conf.get("fix_encoding", True) else lambda c: c
    strip = text.without_tags if conf.get("html_parser", True) else text.without_tags_jvm
    differs = lambda f, c: F.coalesce((f(c) != c).cast("int"), F.lit(0))
    fixed = sum((differs(repair, F.col(was[n])) for n in names), F.lit(0))
    # cells that the parser changed; those without both signs aren't parsed
    tagged = sum((differs(strip, repair(F.col(was[n]))) for n in names), F.lit(0)) if conf.get("strip_html", True) else F.lit(0)
    metrics = both.agg(
        F.sum(F.coalesce(fixed, F.lit(0))).cast("long").alias("encoding_fixes"),
        F.sum(F.coalesce(tagged, F.lit(0))).cast("long").alias("html_stripped"),
        F.count_if(~fits).alias("rows_removed_by_length"),
        F.coalesce(quality.half_up(F.avg(change)), F.lit(0.0)).alias("chars_cleaned_per_row_avg"),
    )
    limited = both.select(*cols(df.columns))
    limited = fenced(limited).filter(fits) if least > 0 or most > 0 else limited
    return StepOutput(limited, metrics, warnings)


@step("pii_scrubbing")
def scrub_pii(df: DataFrame, conf: dict) -> StepOutput:
    """redact, remove_row or flag. Redaction goes entity by entity on what is left; flags are from the original text. With a ``recogniser`` its finds and the patterns' are merged as spans, see there."""
    action = _choice(conf, "action", "redact", ("redact", "remove_row", "flag"))
    names, entities = _columns(df, conf.get("columns", "all_text"), "all_text"), pii.selected(conf.get("entities", ["ALL"]))
    if not names:
        return StepOutput(df, None, ["No text columns to scrub."])
    if conf.get("recogniser"):
        return _scrub_spans(df, names, action, conf)
    if action == "redact":
        done = {n: pii.redacted(col(n), entities, conf.get("redact_with", "[REDACTED]")) for n in names}
        per = [n for _, n in done.values()]
        out = df.withColumns({n: c for n, (c, _) in done.items()})
    else:
        per = [pii.counts(col(n), entities) for n in names]
        flagged = df.withColumn("pii_entities", F.array_join(pii.found(cols(names), entities), ",")).withColumn("pii_detected", F.col("pii_entities") != "")
        out = flagged if action == "flag" else fenced(flagged).filter(~F.col("pii_detected")).drop("pii_detected", "pii_entities")
    # fenced: each count is used several times
    counted = fenced(df.select(*(n.alias(f"n{k}") for k, n in enumerate(per))))
    per = {e: sum((F.get(f"n{j}", F.lit(k)) for j in range(len(names))), F.lit(0)) for k, e in enumerate(entities)}
    total = sum(per.values(), F.lit(0))
    metrics = counted.agg(F.count_if(total > 0).alias("rows_with_pii"), F.coalesce(F.sum(total), F.lit(0)).alias("total_pii_instances"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"{e.lower()}_count") for e, c in per.items()))
    return StepOutput(out, metrics)


def _scrub_spans(df: DataFrame, names: list[str], action: str, conf: dict) -> StepOutput:
    held = dict(zip(names, fresh(df, *(f"spans{k}" for k in range(len(names)))), strict=True))
    # fenced: the recogniser is asked once for a cell
    found = fenced(df.withColumns({h: spans.spans(col(n), conf["recogniser"], conf.get("entities", ["ALL"]), conf.get("min_score", 0.0)) for n, h in held.items()}))
    every = F.concat(*(F.transform(h, lambda s: s["entity"]) for h in held.values()))
    if action == "redact":
        out = found.withColumns({n: spans.cut_out(col(n), F.col(h), conf.get("redact_with", "[REDACTED]")) for n, h in held.items()})
    else:
        out = found.withColumns({"pii_detected": F.size(every) > 0, "pii_entities": F.array_join(F.array_distinct(every), ",")})
        out = fenced(out).filter(~F.col("pii_detected")).drop("pii_detected", "pii_entities") if action == "remove_row" else out
    metrics = found.select(every.alias("e")).agg(F.count_if(F.size("e") > 0).alias("rows_with_pii"), F.coalesce(F.sum(F.size("e").cast("long")), F.lit(0)).alias("total_pii_instances"))
    kinds = found.select(F.explode(every).alias("entity")).groupBy("entity").agg(F.count("*").alias("instances"))
    return StepOutput(out.drop(*held.values()), metrics, details={"entities_found": kinds})


def longest_text_column(df: DataFrame) -> str | None:
    """The text column with the greatest mean length; reads the table once if there are several."""
    names = text_columns(df)
    if len(names) < 2:
        return names[0] if names else None
    means = df.agg(*(F.avg(F.length(F.coalesce(col(n), F.lit("None")))) for n in names)).first()
    return names[max(range(len(names)), key=lambda k: means[k] or 0)]


@step("language_filter")
def filter_language(df: DataFrame, conf: dict) -> StepOutput:
    """Tags each row and keeps or removes languages. ``min_confidence`` above 0 makes less certain guesses unknown. ``method``: letters (statistics of over thirty languages) or words (function words of four)."""
    method = _choice(conf, "method", "letters", ("letters", "words"))
    action = _choice(conf, "action", "tag_only", ("tag_only", "filter_keep", "filter_remove"))
    wanted, tag = conf.get("languages", ["en"]), conf.get("tag_column_name", "language")
    column = conf.get("text_column", "auto")
    column = longest_text_column(df) if column == "auto" else column
    if column not in df.columns:
        return StepOutput(df, None, ["No text column to guess the language of."])
    guess = language.guess(col(column), method)
    least = conf.get("min_confidence", 0.0)
    (g,) = fresh(df, "guess")
    out = df.withColumn(g, guess).withColumn(tag, F.when(F.col(g)["confidence"] >= least, F.col(g)["language"]).otherwise("unknown")).withColumn(f"{tag}_confidence", F.col(g)["confidence"]).drop(g)
    metrics = out.groupBy(col(tag)).agg(F.count("*").alias("rows"))
    if action != "tag_only":
        ok = col(tag).isin(*wanted)
        out = fenced(out).filter(ok if action == "filter_keep" else ~ok)
    return StepOutput(out, metrics)


@step("quality_scorer")
def score_quality(df: DataFrame, conf: dict) -> StepOutput:
    """Heuristic score and reasons of the text columns joined by a space. ``scorer``, a function from texts to (score, reason) pairs, serves the methods ai and both; without it they are heuristic."""
    method = _choice(conf, "method", "heuristic", ("heuristic", "ai", "both"))
    action = _choice(conf, "action", "score_only", ("score_only", "filter", "flag"))
    score, why = conf.get("score_column_name", "quality_score"), conf.get("reason_column_name", "quality_reason")
    names, threshold, warnings = _columns(df, conf.get("text_columns", "auto"), "auto"), conf.get("threshold", 0.0), []
    if not names:
        out = df.withColumns({score: F.lit(5.0), why: F.lit("No text columns")})
    else:
        joined = F.concat_ws(" ", *cols(names))
        (m,) = fresh(df, "measures")
        value, reason = quality.score(F.col(m))
        out = df.withColumn(m, quality.measures(joined)).withColumns({score: value, why: reason}).drop(m)
        scorer = conf.get("scorer")
        if method != "heuristic" and scorer is None:
            warnings.append("No scorer given; heuristic scores.")
        elif method != "heuristic":
            out = _with_scorer(out, joined, score, why, scorer, method, conf)
    metrics = quality_summary(out, score)
    if threshold > 0 and action == "filter":
        out = fenced(out).filter(col(score) >= threshold)
    elif threshold > 0 and action == "flag":
        out = out.withColumn("quality_flag", col(score) < threshold)
    return StepOutput(out, metrics, warnings)


def _with_scorer(df: DataFrame, joined: Column, score: str, why: str, scorer, method: str, conf: dict) -> DataFrame:
    """Asked in batches; a batch that fails is asked again after a pause that doubles, and keeps its heuristic scores if it fails each time."""
    size, pause, tries = conf.get("ai_batch_size", 20), conf.get("ai_batch_delay", 0.5), conf.get("ai_max_retries", 3)

    @F.pandas_udf("struct<s:double,r:string>")
    def asked(texts: pd.Series) -> pd.DataFrame:
        out = []
        for k in range(0, len(texts), size):
            part = [t[:2000] for t in texts.iloc[k : k + size]]
            got = [(None, "(fallback)")] * len(part)
            for attempt in range(tries):
                try:
                    got = [*scorer(part)][: len(part)]
                    break
                except Exception:  # noqa: BLE001
                    if attempt + 1 < tries:
                        time.sleep(pause * 2**attempt)
            out += got + [(5.0, "")] * (len(part) - len(got))
        return pd.DataFrame(out, columns=["s", "r"])

    (name,) = fresh(df, "answer")
    df, a = df.withColumn(name, asked(joined)), F.col(name)
    if method == "ai":
        new = F.coalesce(a["s"], col(score)), F.when(a["s"].isNull(), F.concat(col(why), F.lit(" (fallback)"))).otherwise(a["r"])
    else:
        new = quality.half_up((col(score) + F.coalesce(a["s"], col(score))) / 2), F.concat(F.lit("H: "), col(why), F.lit(" | AI: "), a["r"])
    return df.withColumns({score: new[0], why: new[1]}).drop(name)


def _kth(counts: DataFrame, skipped: Column) -> DataFrame:
    """(value): of values s that stand n times each, the one with ``skipped`` (a column of ``counts``, equal in all rows) smaller ones before it; no row if there are none. Bins of 1e-3, 1e-7 and 1e-11 are counted in turn, each within the one that was found before, so however many values there are, no task orders more than some ten thousand rows for each unit of their range."""
    b3 = F.floor(F.col("s") * 1e11)
    binned = counts.select("s", "n", skipped.alias("skip"), b3.alias("b3"), F.floor(b3 / 10_000).alias("b2"), F.floor(b3 / 100_000_000).alias("b1"))
    left, found = binned, None
    for name in ("b1", "b2", "b3", "s"):
        if found is not None:
            # from the counts again, not from the rows left before, so the plan grows by one copy of them a level
            left = binned.drop("skip").join(F.broadcast(found.withColumnRenamed("value", "bin")), F.col(before) == F.col("bin"))
        sums = left.groupBy(F.col(name).alias("value")).agg(F.sum("n").alias("n"), F.max("skip").alias("skip"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.orderBy("value")))
        found = sums.filter((F.col("upto") > F.col("skip")) & (F.col("upto") - F.col("n") <= F.col("skip"))).select("value", (F.col("skip") - F.col("upto") + F.col("n")).alias("skip"))
        before = name
    return found.select("value")


def quality_summary(scored: DataFrame, score: str = "quality_score") -> DataFrame:
    """One row: histogram in steps of 2, mean, and the upper median of the scores. Equal scores are counted, and the median is looked for in ever finer bins (``_kth``), so unrounded scores are never ordered in one task. Nulls count as the smallest, but are never the median."""
    s = F.col("s")
    bins = {"bin_0_2": s < 2, "bin_2_4": (s >= 2) & (s < 4), "bin_4_6": (s >= 4) & (s < 6), "bin_6_8": (s >= 6) & (s < 8), "bin_8_10": s >= 8}
    # fenced: filters on s would be pushed below the counting, and each copy of it would then score anew
    counts = fenced(scored.groupBy(col(score).cast("double").alias("s")).agg(F.count("*").alias("n")))
    total = counts.agg(
        *(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in bins.items()),
        F.coalesce(quality.half_up(F.try_divide(F.sum(F.col("s") * F.col("n")), F.sum("n"))), F.lit(0.0)).alias("mean_quality_score"),
        F.greatest(F.floor(F.sum("n") / 2) - F.coalesce(F.sum(F.when(s.isNull(), F.col("n"))), F.lit(0)), F.lit(0)).alias("skip"),
        F.lit(1).alias("one"),
    )
    known = counts.filter("s is not null").withColumn("one", F.lit(1)).join(F.broadcast(total.select("one", "skip")), "one")
    median = _kth(known, F.col("skip")).select(F.lit(1).alias("one"), F.col("value").alias("median_quality_score"))
    return total.join(F.broadcast(median), "one", "left").drop("one", "skip")
