"""One call from a file to a registered table with its profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import profile
from quern.sources import readers

@dataclass
class Ingested:
    """A table that was read, and plans of its figures, which run only when they are asked for."""

    name: str
    format: str
    path: str
    df: DataFrame

    @property
    def columns(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    def row_count(self) -> int:
        return self.df.count()

    def statistics(self, approximate: bool = False) -> DataFrame:
        """``unique_count_is`` says which it is: exact, or an estimate by sketches, as the caller chose, at every size."""
        return profile.column_stats(self.df, approximate=approximate).withColumn("unique_count_is", F.lit("an estimate" if approximate else "exact"))

    def tokens(self, counter=None) -> DataFrame:
        return profile.token_total(self.df, counter)

    def preview(self, n: int = 50) -> DataFrame:
        return readers.preview(self.df, n)


def ingest(spark: SparkSession, source: str, target: str, *, name: str, fmt: str | None = None, **options) -> Ingested:
    """Detects and validates, reads, writes Parquet to ``target``, and registers the view ``name``. Raises IngestionError for a file that is missing, empty, of an unknown format or that has no columns to read."""
    found = readers.validate(spark, source) if fmt is None else {"format": fmt, "is_valid": True}
    if not found["is_valid"]:
        code = {"file not found": "NOT_FOUND", "file is empty": "EMPTY_FILE"}.get(found["error_message"], "UNSUPPORTED_FORMAT")
        raise readers.IngestionError(code, found["error_message"], 404 if code == "NOT_FOUND" else 400)
    df = readers.read(spark, source, found["format"], **options)
    if not df.columns:
        raise readers.IngestionError("PARSE_ERROR", f"nothing could be read from {source}")
    df.write.mode("overwrite").parquet(target)
    table = spark.read.parquet(target)
    table.createOrReplaceTempView(name)
    return Ingested(name, found["format"], target, table)
