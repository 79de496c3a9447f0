"""Outputs: tables, JSON lines, JSON arrays and a training configuration."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """parquet, csv or jsonl (json lines), a folder of files."""
    if fmt not in ("parquet", "csv", "jsonl", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode("overwrite")
    writer.parquet(path) if fmt == "parquet" else writer.csv(path, header=True, escape='"') if fmt == "csv" else writer.json(path)


def example_line(formatted: Column, output_format: str) -> Column:
    """One JSON object: structures as they are, template text under the key text."""
    return formatted if output_format in ("alpaca", "sharegpt", "openai") else F.to_json(F.struct(formatted.alias("text")))


def write_examples(df: DataFrame, path: str, output_format: str) -> None:
    """JSON lines of the examples, in the order of the rows."""
    df.select(example_line(F.col("formatted_text"), output_format).alias("value")).write.mode("overwrite").text(path)


def write_array(df: DataFrame, file: str) -> int:
    """One local file with a JSON array, streamed partition by partition. Also the number of examples."""
    n = 0
    with open(file, "w", encoding="utf-8") as out:
        out.write("[")
        for row in df.select("formatted_text").toLocalIterator(prefetchPartitions=True):
            out.write(("," if n else "") + "\n" + json.dumps(json.loads(row[0]), ensure_ascii=False, indent=2))
            n += 1
        out.write("\n]" if n else "]")
    return n


def as_array(objects: DataFrame) -> DataFrame:
    """Lines that make each task's file one JSON array: of ``objects`` (value), each with a comma behind it, and an empty object at the end."""

    def put(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["["])], names=["value"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array(["{}]"])], names=["value"])

    return objects.select("value").mapInArrow(put, "value string")


def write_config(config: dict, file: str) -> None:
    with open(file, "w", encoding="utf-8") as out:
        json.dump(config, out, ensure_ascii=False, indent=2)
