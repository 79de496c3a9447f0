"""Heuristic quality scores of texts and of responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, words

#: Weights of the five parts.
WEIGHTS = {"length": 1.5, "vocabulary": 2.0, "repetition": 2.0, "letters": 1.0, "capitals": 0.5}
#: Phrases of a refusal, case ignored.
REFUSALS = (
    "I cannot", "I can not", "I'm unable", "I am unable", "As an AI", "As a language model",
    "I don't have the ability", "I am an AI", "I'm sorry, but", "I apologize, but", "is not appropriate",
)
#: Characters that end a complete response.
CLOSERS = ".!?\"'”’]}>"


def half_up(c: Column, digits: int = 2) -> Column:
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def _most_equal(sorted_items: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(sorted_items, start, step, lambda s: s["best"])


def measures(text: Column) -> Column:
    """struct of what the score is made of; every list is built once."""
    parts = F.filter(F.transform(F.split(F.lower(text), r"[.!?]+"), strip), lambda s: s != "")
    items = words(F.lower(text))
    return F.struct(
        F.length(text).alias("chars"),
        (F.length(strip(text)) == 0).alias("blank"),
        F.aggregate(F.array(items), F.struct(F.lit(0).alias("n"), F.lit(0).alias("d")), lambda s, w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))).alias("words"),
        F.aggregate(F.array(parts), F.struct(F.lit(0).alias("n"), F.lit(0).alias("m")), lambda s, p: F.struct(F.size(p).alias("n"), _most_equal(F.sort_array(p)).alias("m"))).alias("sentences"),
        # what is left is measured, as a count of matches would make a string of each letter
        F.length(F.regexp_replace(text, r"\P{L}+", "")).alias("letters"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("capitals"),
    )


def score(m: Column) -> tuple[Column, Column]:
    """Score, 0 to 10 with two digits, and reasons, from ``measures``."""
    chars, n, d = m["chars"], m["words"]["n"], m["words"]["d"]
    length = F.when(chars < 10, 1.0).when(chars < 50, 4.0).when(chars <= 5000, 10.0).when(chars <= 20000, 7.0).otherwise(4.0)
    length_why = F.when(chars < 10, "Very short").when(chars < 50, "Short").when(chars <= 5000, F.lit(None)).when(chars <= 20000, "Long").otherwise("Very long")
    ratio = F.try_divide(d.cast("double"), n.cast("double"))
    vocabulary = F.when(n == 0, 1.0).otherwise(F.least(F.lit(10.0), ratio * 12))
    vocabulary_why = F.when((n > 0) & (ratio < 0.3), "Low vocabulary diversity")
    k, most = m["sentences"]["n"], m["sentences"]["m"]
    repetition = F.when(k <= 1, 7.0).when(most > 2, F.greatest(F.lit(1.0), 10.0 - 2.0 * (most - 1))).otherwise(10.0)
    repetition_why = F.when((k > 1) & (most > 2), F.concat(F.lit("Repeated sentences ("), most.cast("string"), F.lit("x)")))
    share = F.try_divide(m["letters"].cast("double"), chars.cast("double"))
    letters = F.when(share > 0.6, 10.0).when(share > 0.4, 7.0).otherwise(3.0)
    letters_why = F.when(share <= 0.4, "High special char ratio")
    caps = F.try_divide(m["capitals"].cast("double"), m["letters"].cast("double"))
    capitals = F.when(m["letters"] == 0, 5.0).when(caps.between(0.02, 0.15), 10.0).when(caps > 0.5, 3.0).otherwise(7.0)
    capitals_why = F.when((m["letters"] > 0) & (caps > 0.5), "Excessive caps")
    parts = dict(zip(WEIGHTS, (length, vocabulary, repetition, letters, capitals), strict=True))
    total = sum((WEIGHTS[k] * c for k, c in parts.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    why = F.concat_ws("; ", length_why, vocabulary_why, repetition_why, letters_why, capitals_why)
    value = F.when(m["blank"], 0.0).otherwise(half_up(F.greatest(F.lit(0.0), F.least(F.lit(10.0), total))))
    return value, F.when(m["blank"], "Empty text").when(why == "", "Good quality").otherwise(why)


def response(instruction: Column, output: Column, *, min_instruction: int = 3, min_words: int = 10, max_words: int = 2000, refusals: tuple[str, ...] | None = REFUSALS, completeness: bool = True) -> tuple[Column, Column]:
    """Score of a response, 10 less penalties, 0 at least, and the penalties' names. A response of white space alone counts as incomplete."""
    asked, said = F.size(words(instruction)), F.size(words(output))
    rules = [(asked < min_instruction, 5.0, "instruction_too_short"), (said < min_words, 5.0, "response_too_short"), (said > max_words, 2.0, "response_too_long")]
    if refusals:
        rules.append((output.rlike("(?iu)" + "|".join(rf"\Q{p}\E" for p in refusals)), 8.0, "refusal_detected"))
    if completeness:
        last = F.right(strip(output), F.lit(1))
        rules.append(((output != "") & ~F.coalesce(last.isin(*CLOSERS), F.lit(False)), 3.0, "incomplete_response"))
    lost = sum((F.when(c, p).otherwise(0.0) for c, p, _ in rules), F.lit(0.0))
    return F.greatest(F.lit(0.0), 10.0 - lost), F.concat_ws(",", *(F.when(c, F.lit(n)) for c, _, n in rules))
