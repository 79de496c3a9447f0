"""Runs of step lists: the common pipeline and the instruction-tuning pipeline. A list folds into one lazy plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import chat
from quern.operators import finetune, sampling
from quern.operators.steps import ALIASES, STEPS, StepOutput, find

Progress = Callable[[int, str, str], Any]


@dataclass
class RunResult:
    """The final rows, still lazy, and what each step said. ``counts`` and ``metrics`` run jobs when asked."""

    df: DataFrame
    first: DataFrame
    steps: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def stats(self) -> dict:
        return {"steps_executed": len(self.steps), "steps_skipped": sum(s["skipped"] for s in self.steps)}

    def counts(self) -> dict:
        before, after = self.first.count(), self.df.count()
        return {"rows_before": before, "rows_after": after, "rows_removed": before - after}

    def metrics(self) -> list[list[dict]]:
        return [[r.asDict() for r in s["metrics"].collect()] if s["metrics"] is not None else [] for s in self.steps]


def run(df: DataFrame, steps: list[dict], progress: Progress | None = None) -> RunResult:
    """Steps in the order given. An unknown step, or one whose options or columns don't fit, is skipped with a warning, and the next goes on with the rows as they were. Errors in cells come up when the rows are read."""
    result = RunResult(df, df)
    say = progress or (lambda *_: None)
    for k, one in enumerate(steps):
        name, conf = one.get("step", ""), one.get("config") or {}
        say(int(k / len(steps) * 100), name, "started")
        f, warnings, out = find(name), [], None
        if f is None:
            warnings.append(f"Unknown step {name!r}; skipped.")
        else:
            try:
                out = f(result.df, conf)
                out.df.schema  # noqa: B018  resolves the plan now, so a step that doesn't fit is found here
            except Exception as e:  # noqa: BLE001
                out = None
                warnings.append(f"Step {name!r} failed and is skipped: {e}")
        if out is not None:
            result.df, warnings = out.df, warnings + out.warnings
        result.steps.append({"step": ALIASES.get(name, name), "skipped": out is None, "warnings": warnings, "metrics": out.metrics if out else None, "details": out.details if out else {}})
        result.warnings += warnings
        if f is not None:
            say(int((k + 1) / len(steps) * 100), name, "done" if out else "skipped")
    return result


@dataclass
class FinetuneConfig:
    """The defaults of a run."""

    id_column: str
    input_format: str = "auto"
    output_format: str = "openai"
    system_prompt: str = ""
    max_tokens_per_example: int = 4096
    run_deduplication: bool = True
    run_noise_removal: bool = True
    run_pii_scrubbing: bool = True
    run_quality_scoring: bool = True
    run_response_quality: bool = True
    run_balancer: bool = False
    run_augmentation: bool = False
    train_split: float = 0.9
    val_split: float = 0.1
    seed: int = 42
    deduplication_config: dict = field(default_factory=dict)
    noise_config: dict = field(default_factory=dict)
    pii_config: dict = field(default_factory=dict)
    quality_config: dict = field(default_factory=dict)
    response_quality_config: dict = field(default_factory=dict)
    balancer_config: dict = field(default_factory=dict)
    augmentation_config: dict = field(default_factory=dict)
    formatter_config: dict = field(default_factory=dict)


@dataclass
class FinetuneResult:
    rows: DataFrame
    config: FinetuneConfig
    steps: list[dict]

    @property
    def train(self) -> DataFrame:
        return self.rows.filter("split = 'train'").drop("split")

    @property
    def val(self) -> DataFrame:
        return self.rows.filter("split = 'val'").drop("split")

    def summary(self) -> dict:
        r = self.rows.agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("tokens")).first()
        return {"train_examples": r["train"], "val_examples": r["val"]} | finetune.training_config(r["train"] + r["val"], r["tokens"], self.config.output_format)


def run_finetune(df: DataFrame, config: FinetuneConfig, progress: Progress | None = None) -> FinetuneResult:
    """Common steps, format, response quality, balance, augment, split."""
    say = progress or (lambda *_: None)
    common = (("deduplication", config.run_deduplication, {"order_by": config.id_column} | config.deduplication_config), ("noise_removal", config.run_noise_removal, config.noise_config), ("pii_scrubbing", config.run_pii_scrubbing, config.pii_config), ("quality_scorer", config.run_quality_scoring, config.quality_config))
    say(10, "common", "started")
    first = run(df, [{"step": n, "config": c} for n, on, c in common if on])
    steps, now = list(first.steps), first.df
    say(40, "format", "started")
    balanced = None

    def then(name: str, out: StepOutput) -> StepOutput:
        nonlocal now
        now = out.df
        steps.append({"step": name, "skipped": False, "warnings": out.warnings, "metrics": out.metrics, "details": out.details})
        return out

    then("finetune_formatter", finetune.format_examples(now, {"input_format": config.input_format, "output_format": config.output_format, "system_prompt": config.system_prompt, "max_tokens_per_example": config.max_tokens_per_example} | config.formatter_config))
    if config.run_response_quality:
        then("response_quality", finetune.response_quality(now, config.response_quality_config))
    now = now.drop(*chat.NORMAL)
    if config.run_balancer:
        balanced = then("category_balancer", sampling.balance(now, {"id_column": config.id_column, "seed": config.seed} | config.balancer_config)).details.get("category_column")
    if config.run_augmentation:
        then("data_augmentor", finetune.augment(now, config.augmentation_config))
    say(85, "split", "started")
    rows = sampling.split(now, id_column=config.id_column, train=config.train_split, val=config.val_split, seed=config.seed, stratify=balanced)
    say(90, "export", "started")
    return FinetuneResult(rows, config, steps)


def parse_steps(text: str) -> list[dict]:
    """A step list from JSON."""
    found = json.loads(text)
    if not isinstance(found, list) or not all(isinstance(s, dict) and "step" in s for s in found):
        raise ValueError("a list of objects with a step name is needed")
    return found


__all__ = ["STEPS", "FinetuneConfig", "FinetuneResult", "RunResult", "parse_steps", "run", "run_finetune"]
