"""Detection and redaction of personal data by pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import literal

#: Entities in the order in which they are applied, case ignored.
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"(?:\+?1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "SSN": r"\b\d{3}[-]?\d{2}[-]?\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "URL": r"https?://[^\s<>\"']+|www\.[^\s<>\"']+",
}


def java(entity: str) -> str:
    """Unicode classes and digits, as in the patterns' own dialect."""
    return "(?iU)" + PATTERNS[entity]


def selected(entities: list[str] | None) -> list[str]:
    """In the fixed order; unknown names select nothing."""
    if entities is None or "ALL" in entities:
        return list(PATTERNS)
    return [e for e in PATTERNS if e in entities]


#: What every text in which an entity stands has, told without trying the entity's pattern at each place.
_NEEDED = {
    "EMAIL": lambda t: t.contains("@"),
    "PHONE": lambda t: t.rlike(r"(?U)\d{4}"),
    "SSN": lambda t: t.rlike(r"(?U)\d{4}"),
    "CREDIT_CARD": lambda t: t.rlike(r"(?U)\d{4}"),
    "IP_ADDRESS": lambda t: t.rlike(r"(?U)\d\.\d"),
    "URL": lambda t: t.contains("://") | t.rlike(r"[wW]{3}\."),
}


def _once(c: Column, f) -> Column:
    """f(c), with c computed once however often f has it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _stands(t: Column, e: str) -> Column:
    return _NEEDED[e](t) & t.rlike(java(e))


def _replaced(t: Column, e: str, redact_with: str) -> Column:
    return F.when(_NEEDED[e](t), F.regexp_replace(t, java(e), literal(f"<{e}>" if redact_with == "<ENTITY_TYPE>" else redact_with))).otherwise(t)


def _counted(t: Column, e: str) -> Column:
    return F.when(_NEEDED[e](t), F.regexp_count(t, F.lit(java(e)))).otherwise(0).cast("long")


def redacted(c: Column, entities: list[str], redact_with: str = "[REDACTED]") -> tuple[Column, Column]:
    """The text after all entities in turn, and an array of each one's count, on the text that those before it have left."""
    text, both = c, F.struct(c.alias("t"), F.array().cast("array<long>").alias("n"))
    for e in entities:
        text = _once(text, lambda t: _replaced(t, e, redact_with))  # noqa: B023
        put = lambda b, t, n: F.struct(t.alias("t"), F.concat(b["n"], F.array(n.cast("long"))).alias("n"))
        both = _once(both, lambda b: F.when(_stands(b["t"], e), put(b, _replaced(b["t"], e, redact_with), F.regexp_count(b["t"], F.lit(java(e))))).otherwise(put(b, b["t"], F.lit(0))))  # noqa: B023
    return text, both["n"]


def found(columns: list[Column], entities: list[str]) -> Column:
    """Names of the entities in any column, in order of first detection."""
    hits = [F.when(_stands(c, e), F.lit(e)) for c in columns for e in entities]
    return F.array_distinct(F.array_compact(F.array(*hits))) if hits else F.array().cast("array<string>")


def counts(column: Column, entities: list[str]) -> Column:
    """An array of each entity's count."""
    return F.array(*(_counted(column, e) for e in entities)).cast("array<long>")
