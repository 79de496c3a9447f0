"""Names of columns: of any form, dots and backticks included, and free ones for columns that steps make on the way."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """The name as one part, not a path into a struct."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def cols(names: list[str]) -> list[Column]:
    return [col(n) for n in names]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever its case."""
    taken, k = {c.lower() for c in df.columns}, 0
    while any(f"_{n}_{k}".lower() in taken for n in names):
        k += 1
    return [f"_{n}_{k}" for n in names]
