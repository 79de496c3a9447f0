"""Records that may span lines and file blocks, read by many tasks: quoted fields of CSV, objects of one JSON array.

A file is read as pieces, split at a byte that ends every record but may stand inside one too. What
a piece does to the scanner's state (inside quotes or not, and how many brackets are open) is a
function of the state before it, small enough to be written down for both cases. A first pass
composes the functions of each block; blocks' functions are composed in their order, which gives
each block the state it begins with; a second pass puts records together. Only the ends of records
that span blocks leave their task. So no file is read by one task, whatever its quotes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.tables import written


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, start, at, value) in the order of each block, which begins at byte ``start`` of its file; ``at`` grows with it."""
    return spark.read.text(path, lineSep=separator).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def quoted_after(line: Column, separator: str) -> tuple[Column, Column]:
    """Whether a line of CSV ends inside quotes if it began outside, and if it began inside. A quote opens a field only at the field's start; two inside quotes are one; what follows a closing quote belongs to the field."""
    s = "\\t" if separator == "\t" else f"\\x{ord(separator):02x}"
    inside = r'[^"]*+(?:""[^"]*+)*+'
    field = rf'(?:"{inside}"[^{s}]*+|[^"{s}][^{s}]*+)?+'
    opened = rf'(?:{field}{s})*+"{inside}\z'
    return line.rlike(rf"\A{opened}"), line.rlike(rf'\A{inside}(?:\z|"[^{s}]*+{s}{opened})')


def brackets_after(piece: Column) -> tuple[Column, Column, Column, Column]:
    """Of a piece of JSON that a closing brace ends: whether it ends in a string, and how many brackets it opens more than it closes, if it began outside a string; and both if it began inside."""
    plain = F.regexp_replace(piece, r"(?s)\\.", "")
    odd = F.pmod(F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit(""))), F.lit(2)) == 1
    strings = r'"[^"]*+(?:"|\z)'
    out = F.regexp_replace(plain, strings, ""), F.regexp_replace(F.regexp_replace(plain, r'\A[^"]*+(?:"|\z)', ""), strings, "")
    count = lambda c, which: F.length(c) - F.length(F.translate(c, which, ""))
    more = [count(c, "[{") - count(c, "]}") for c in out]
    return odd, (more[0] - (~odd).cast("int")).cast("int"), ~odd, (more[1] - odd.cast("int")).cast("int")


def _after(t0: np.ndarray, t1: np.ndarray, first: int) -> np.ndarray:
    """The state after each piece: that of the last piece that sets it, turned over by each since that turns it."""
    turns = np.cumsum((t0 & ~t1).astype(np.int64))
    sets = np.maximum.accumulate(np.where(t0 == t1, np.arange(len(t0)), -1))
    return np.where(sets >= 0, t0[sets] + turns - turns[sets], first + turns) % 2


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int, tuple]]:
    """Stretches of a batch that are of one block."""
    file, start = batch.column("file").to_pylist(), batch.column("start").to_pylist()
    cuts = [0, *(k for k in range(1, len(file)) if (file[k], start[k]) != (file[k - 1], start[k - 1])), len(file)]
    return [(a, b, (file[a], start[a])) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _columns(batch: pa.RecordBatch, a: int, b: int) -> list[np.ndarray]:
    flags = [batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("t0", "t1", "d0", "d1")]
    return [flags[0].astype(bool), flags[1].astype(bool), flags[2].astype(np.int64), flags[3].astype(np.int64)]


def blocks(marked: DataFrame) -> DataFrame:
    """(file, start, state, depth): what each block of pieces (file, start, t0, t1, d0, d1) begins with."""

    def compose(batches):
        held: dict = {}
        for batch in batches:
            for a, b, key in _runs(batch):
                t0, t1, d0, d1 = _columns(batch, a, b)
                state, depth = held.get(key, ([0, 1], [0, 0]))
                for s in (0, 1):
                    after = _after(t0, t1, state[s])
                    before = np.concatenate([[state[s]], after[:-1]])
                    depth[s] += int(np.where(before, d1, d0).sum())
                    state[s] = int(after[-1])
                held[key] = (state, depth)
        rows = [(*key, bool(s[0]), bool(s[1]), d[0], d[1]) for key, (s, d) in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()))], names=["file", "start", "t0", "t1", "d0", "d1"])

    each = marked.select("file", "start", "t0", "t1", "d0", "d1").mapInArrow(compose, "file string, start long, t0 boolean, t1 boolean, d0 long, d1 long")
    # one short row for each block; the blocks of a file in their order
    each = written(each, "blocks")
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("t0") & ~F.col("t1")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    each = each.withColumn("turns", turns)
    last = F.last(F.when(F.col("t0") == F.col("t1"), F.struct(F.col("t0").cast("int").alias("t"), "turns")), ignorenulls=True).over(order)
    before = F.coalesce(F.lag("turns").over(Window.partitionBy("file").orderBy("start")), F.lit(0))
    each = each.withColumn("state", F.pmod(F.coalesce(last["t"] - last["turns"], F.lit(0)) + before, F.lit(2)) == 1)
    return each.select("file", "start", "state", F.coalesce(F.sum(F.when(F.col("state"), F.col("d1")).otherwise(F.col("d0"))).over(order), F.lit(0)).alias("depth"))


_PARTS = "file string, start long, kind string, value string"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["file", "start", "kind", "value"])


def records(marked: DataFrame, level: int, between: str, end: str = "") -> DataFrame:
    """(file, first, value) of every record of pieces (file, start, at, value, t0, t1, d0, d1): ``first`` tells a file's first. A record ends with a piece after which the state is outside quotes and ``level`` brackets are open. Pieces are joined by ``between``, and ``end`` follows the last. What a file has after its last end is no record."""
    known = written(blocks(marked), "states")

    def put(batches):
        key, state, depth, text, ended = None, 0, 0, [], False

        def rest():
            # what is left of a block: the start of a record, or, where none has ended, the middle of one
            return (*key, "tail" if ended else "middle", between.join(text) if text else None)

        for batch in batches:
            rows = []
            for a, b, now in _runs(batch):
                if now != key:
                    rows += [rest()] if key is not None else []
                    key, text, ended = now, [], False
                    state, depth = int(batch.column("state")[a].as_py()), batch.column("depth")[a].as_py()
                t0, t1, d0, d1 = _columns(batch, a, b)
                after = _after(t0, t1, state)
                open_ = depth + np.cumsum(np.where(np.concatenate([[state], after[:-1]]), d1, d0))
                values, begin = batch.column("value").slice(a, b - a).to_pylist(), 0
                for k in np.flatnonzero((after == 0) & (open_ == level)).tolist():
                    rows.append((*key, "record" if ended else "head", between.join([*text, *values[begin : k + 1]]) + end))
                    text, begin, ended = [], k + 1, True
                text += values[begin:]
                state, depth = int(after[-1]), int(open_[-1])
            yield _table(rows)
        if key is not None:
            yield _table([rest()])

    # small enough states are broadcast, and others sorted in; the order of pieces is made sure of for both
    lines = marked.join(known, ["file", "start"]).sortWithinPartitions("file", "start", "at")
    found = written(lines.select("file", "start", "value", "t0", "t1", "d0", "d1", "state", "depth").mapInArrow(put, _PARTS), "records")
    # an open record belongs to the last block before in which one has ended, or to the file's start
    open_ = found.filter("kind <> 'record'")
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == "tail").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(F.when(F.col("kind") == "tail", F.col("start")), ignorenulls=True).over(order), F.lit(-1))
    owners = open_.select("file", "start", "kind").withColumn("before", before)
    owners = owners.select("file", "start", "kind", F.when(F.col("kind") == "tail", F.col("start")).otherwise(F.col("before")).alias("owner"))
    parts = open_.join(owners, ["file", "start", "kind"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("v"), F.bool_or(F.col("kind") == "head").alias("done"))
    joined = F.array_join(F.filter(F.transform("v", lambda x: x["value"]), lambda x: x.isNotNull()), between)
    whole = parts.filter("done").select("file", (F.col("owner") == -1).alias("first"), joined.alias("value"))
    return found.filter("kind = 'record'").select("file", F.lit(False).alias("first"), "value").union(whole)
