"""From raw documents to packed training windows: five stages, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of their input, whatever their names; empty tables stay
empty. Texts of any length are used whole. Rows that share an id are kept or dropped together by the
stages that drop ids, and each by its own text by the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.names import col
from quern.llm import decontam, langid, linededup, minhash, packing
from quern.llm.common import cut, fresh, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no known language: null, empty and letterless texts go. A document without a label is judged like any other; if no document has one, all stay. Ties of code lengths: the first language by name. Equal texts are kept or go together."""
    return langid.language_filter(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later repeats of runs of lines; of equal runs the first stays, in the order of ids (null first) and lines. A document that consists of repeats goes, and ``n_chars`` follows the text. Null texts stay; a text without words that loses nothing stays."""
    lines, words = fresh(docs, "removed_lines", "removed_words")
    left = linededup.remove_repeats(docs, names=(lines, words))
    left = left.filter((F.col(lines) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.when(F.col(lines) > 0, F.length("text").cast("long"))
    return left.select(*(F.coalesce(changed, col(c)).alias(c) if c == "n_chars" else col(c) for c in docs.columns))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the smallest id. Null ids and texts without words have no component and stay."""
    return minhash.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that share a passage with a benchmark item. Null ids and null or empty texts stay; an empty benchmark drops nothing."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its window. A null or empty text is its end id alone; a null id stays null; repeated rows are packed each."""
    return packing.pack(docs, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("op4 language id", identify_language),
    ("op9 line dedup", remove_repeated_lines),
    ("op5 near-duplicates", remove_near_duplicates),
    ("op3 decontamination", remove_benchmark),
    ("op2 packing", pack_windows),
]

#: A learned byte model, MinHash components and BPE ids aren't SQL's; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage{k}")
    return docs
