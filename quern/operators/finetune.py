"""Instruction-tuning steps: format, response quality, export figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import chat, quality
from quern.functions.names import col, cols
from quern.operators.steps import StepOutput, fenced


def format_examples(df: DataFrame, conf: dict) -> StepOutput:
    """formatted_text and token_count before the input's columns; longer examples go. The normal columns stay for the steps that follow. ``token_counter``, a function from a text column to a count, replaces the estimate."""
    normal, name, note = chat.normalise(df, conf.get("input_format", "auto"), conf.get("instruction_column"), conf.get("input_column"), conf.get("output_column"))
    target = conf.get("output_format", "openai")
    example = chat.formatted(target if target in chat.FORMATS else "openai", *map(F.col, chat.NORMAL), conf.get("system_prompt", ""))
    counter = conf.get("token_counter", chat.token_estimate)
    others = [c for c in df.columns if c not in ("formatted_text", "token_count")]
    out = normal.withColumn("formatted_text", example).withColumn("token_count", counter(F.col("formatted_text")))
    out = out.select("formatted_text", "token_count", *cols(others), *chat.NORMAL)
    most = conf.get("max_tokens_per_example", 4096)
    kept = fenced(out).filter(F.col("token_count") <= most) if most > 0 else out
    return StepOutput(kept, token_summary(kept), [note] if note else [], {"input_format": name, "output_format": target})


def token_summary(df: DataFrame) -> DataFrame:
    t = F.col("token_count")
    bins = {"le_512": t <= 512, "le_1024": (t > 512) & (t <= 1024), "le_2048": (t > 1024) & (t <= 2048), "le_4096": (t > 2048) & (t <= 4096), "gt_4096": t > 4096}
    return df.agg(F.coalesce(F.avg(t), F.lit(0.0)).alias("avg_token_count"), F.coalesce(F.max(t), F.lit(0)).alias("max_token_count"), F.coalesce(F.min(t), F.lit(0)).alias("min_token_count"), *(F.count_if(c).alias(k) for k, c in bins.items()))


def response_quality(df: DataFrame, conf: dict) -> StepOutput:
    """Scores of the normal columns (or the first and last); ``filter`` keeps 6 and more and drops the scores."""
    first, last = (chat.NORMAL[0], chat.NORMAL[2]) if chat.NORMAL[0] in df.columns else (df.columns[0], df.columns[-1])
    score, why = quality.response(
        F.coalesce(col(first).cast("string"), F.lit("")),
        F.coalesce(col(last).cast("string"), F.lit("")),
        min_instruction=conf.get("min_instruction_length", 3),
        min_words=conf.get("min_response_length", 10),
        max_words=conf.get("max_response_length", 2000),
        refusals=tuple(conf.get("refusal_phrases", quality.REFUSALS)) if conf.get("filter_refusals", True) else None,
        completeness=conf.get("check_response_completeness", True),
    )
    out = df.withColumns({"_response_quality_score": score, "_response_quality_reasons": why})
    metrics = out.agg(F.coalesce(F.avg("_response_quality_score"), F.lit(0.0)).alias("avg_quality_score"), F.count_if(F.col("_response_quality_score") < 6).alias("total_filtered"))
    if conf.get("action", "filter") == "filter":
        out = fenced(out).filter("_response_quality_score >= 6").drop("_response_quality_score", "_response_quality_reasons")
    return StepOutput(out, metrics)


def augment(df: DataFrame, conf: dict) -> StepOutput:
    """A hook: ``generator``, from rows to more rows of the same columns, tagged is_synthetic; without it nothing changes."""
    generator = conf.get("generator")
    if generator is None:
        return StepOutput(df, None, ["No generator given; no examples are added."], {"synthetic_examples_added": 0})
    new = generator(df).withColumn("is_synthetic", F.lit(True))
    for c in df.columns:
        new = new.filter(col(c).isNotNull())
    return StepOutput(df.withColumn("is_synthetic", F.lit(False)).unionByName(new))


def training_hours(total: int, average_tokens: float) -> str:
    hours = total * average_tokens * 3 / 5000 / 3600
    return f"~{hours:.1f} hours" if hours >= 0.1 else "< 6 mins"


def training_config(total: int, average_tokens: float, output_format: str) -> dict:
    """Base models, and epochs by the number of examples."""
    model = {"mistral": "mistralai/Mistral-7B-Instruct-v0.2", "gemma": "google/gemma-7b-it"}.get(output_format, "meta-llama/Meta-Llama-3-8B")
    epochs = 3 if total > 5000 else 5 if total > 1000 else 10
    return {"base_model": model, "format": output_format, "examples": total, "avg_tokens": average_tokens, "epochs": epochs, "batch_size": 4, "learning_rate": 2e-4, "estimated_training_time": training_hours(total, average_tokens)}
