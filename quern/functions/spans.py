"""Personal data as spans: patterns' and a recogniser's finds merged, without overlaps, and cut out by their places.

A recogniser is a function from a list of texts to a list, for each text, of (entity, start, end,
score), places in characters. It is asked in Arrow batches, inside tasks; all else is columns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pii import PATTERNS

Span = tuple[str, int, int, float]
Recogniser = Callable[[list[str]], Sequence[Sequence[Span]]]
#: What a pattern's find is worth beside a recogniser's scores, from 0 to 1.
PATTERN_SCORE = 0.6
#: Texts that a recogniser is asked for at once.
BATCH = 64
SPANS = "array<struct<entity:string,start:int,end:int,score:double>>"


def best(spans: Sequence[Span]) -> list[Span]:
    """Spans without overlaps whose scores times lengths add up to the most; of equal sums the one that ends first. Weighted interval scheduling: by the spans' ends, each is taken or left."""
    found = sorted({s for s in spans if s[1] < s[2] and s[3] > 0}, key=lambda s: (s[2], s[1], s[0], -s[3]))
    ends, worth, taken = [s[2] for s in found], [0.0], []
    for k, (_, start, end, score) in enumerate(found):
        before = bisect_right(ends, start, 0, k)
        with_it = worth[before] + score * (end - start)
        taken.append(before if with_it > worth[k] + 1e-12 else None)
        worth.append(max(with_it, worth[k]) if taken[k] is not None else worth[k])
    out, k = [], len(found)
    while k:
        if taken[k - 1] is None:
            k -= 1
        else:
            out.append(found[k - 1])
            k = taken[k - 1]
    return out[::-1]


def by_patterns(text: str, entities: list[str]) -> list[Span]:
    return [(e, m.start(), m.end(), PATTERN_SCORE) for e in entities if e in PATTERNS for m in re.finditer(PATTERNS[e], text, re.IGNORECASE)]


def spans(text: Column, recogniser: Recogniser, entities: list[str] | None = None, least: float = 0.0) -> Column:
    """array(entity, start, end, score) in order, without overlaps; empty for null and empty texts. ``entities`` other than ALL limits both kinds; finds of the recogniser below the score ``least``, and such that lie outside their text, don't count."""
    every = entities is None or "ALL" in entities

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        said = texts.to_pylist()
        out: list[list[dict]] = [[] for _ in said]
        asked = [k for k, t in enumerate(said) if t]
        for a in range(0, len(asked), BATCH):
            some = asked[a : a + BATCH]
            for k, more in zip(some, recogniser([said[k] for k in some]), strict=True):
                named = [(e, int(s), int(t), float(p)) for e, s, t, p in more if p >= least and 0 <= s < t <= len(said[k]) and (every or e in entities)]
                picked = best([*by_patterns(said[k], list(PATTERNS) if every else entities), *named])
                out[k] = [dict(zip(("entity", "start", "end", "score"), s, strict=True)) for s in picked]
        return pa.array(out, pa.list_(pa.struct([("entity", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))

    return found(text)


def cut_out(text: Column, found: Column, redact_with: str = "[REDACTED]") -> Column:
    """The text with each span replaced; ``<ENTITY_TYPE>`` names the entity."""
    put = (lambda s: F.concat(F.lit("<"), s["entity"], F.lit(">"))) if redact_with == "<ENTITY_TYPE>" else (lambda s: F.lit(redact_with))
    part = lambda a, b: F.substring(text, a + 1, b - a)
    pieces = F.transform(found, lambda s, i: F.concat(part(F.coalesce(F.get(found, i - 1)["end"], F.lit(0)), s["start"]), put(s)))
    last = F.coalesce(F.get(found, F.size(found) - 1)["end"], F.lit(0))
    return F.when(F.size(found) > 0, F.concat(F.array_join(pieces, ""), part(last, F.length(text)))).otherwise(text)
