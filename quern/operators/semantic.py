"""Search and de-duplication by vectors: an inverted file over centroids, exact by the triangle inequality.

Equal vectors are one class first, which its smallest id stands for, so copies cost a row each and
never a pair. Centroids come from a bounded sample; every vector is in the list of its nearest
centroid, and a list knows how near and how far from the centroid its vectors are, as angles. A
vector can have a cosine of t with one of a list only if its own angle to the centroid is within
arccos(t) of that ring. So links of at least a threshold, and the k nearest once k have been found in the nearest
lists, are whole, whatever the centroids are: these decide only how many lists are asked. With
``probes`` that many lists are asked and no more; then the result is approximate.

Lists that lie near each other are compared as one group, so a vector is sent to a group once, however
many of its lists it asks, and a group of any size is cut into blocks. A task holds one block of a
group and one of those that ask it, multiplies pieces of them, and gives only links or the k best of
each vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import col, fresh
from quern.operators.tables import discard, written

#: Lists at most, and vectors that centroids are fitted on for each list: bounds of what the driver and a broadcast hold (32,768 and 1,024 vectors).
MOST_LISTS, SAMPLE = 1024, 32
#: Vectors of a group of lists, and vectors that ask it, that one task holds, and their elements at most; so many groups are aimed at, of LEAST vectors or more.
BLOCK, ELEMENTS, GROUPS, LEAST = 1 << 16, 1 << 22, 16, 2048
#: Vectors whose angles are told at once, and those of a list's that they are multiplied with at once.
ROWS, PIECE = 512, 4096
#: Angles may be off by rounding.
SLACK = 1e-6


def vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v); without null ids, null or empty vectors, and vectors that have no direction (all zero, or with a null, NaN or infinity)."""
    v = col(vector_column).cast("array<double>")
    rows = df.select(col(id_column).cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def _matrix(column: pa.Array) -> np.ndarray:
    """A row of length 1 for each vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, v) of each distinct vector's smallest id, and (rep, id) of all rows; both tables."""
    keyed = rows.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit("again"), "v").alias("g"))
    # any of a class's vectors is the one; copies are combined before the shuffle
    reps = written(keyed.groupBy("h", "g").agg(F.min("id").alias("id"), F.any_value("v").alias("v")), "reps")
    members = keyed.select("id", "h", "g").join(reps.select("h", "g", F.col("id").alias("rep")), ["h", "g"])
    return reps, written(members.select("rep", "id"), "members")


def centroids(rows: DataFrame, lists: int) -> np.ndarray:
    """Unit centroids by spherical k-means on the vectors with the smallest hashes of ids."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * lists).select("v").toArrow().column(0)
    if not len(some):
        return np.zeros((0, 0))
    v = _matrix(some)
    at = np.random.default_rng(20240101).permutation(len(v))[:lists]
    c = v[at]
    for _ in range(8):
        nearest = (v @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


@dataclass
class Lists:
    """Of each list its centroid, the least and greatest angle to it and its group, and of each group its blocks: what every task gets, MOST_LISTS rows at most."""

    centroids: np.ndarray
    near: np.ndarray
    far: np.ndarray
    group: np.ndarray
    blocks: np.ndarray
    block: int


@dataclass
class Index:
    """``table`` (list, angle, id, v) and its lists."""

    table: DataFrame
    lists: Lists

    def discard(self) -> None:
        discard(self.table)


def _angles(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ c.T, -1, 1))


def _chain(c: np.ndarray) -> list[int]:
    """All lists, each followed by the nearest that is left."""
    left, order = np.ones(len(c), bool), []
    at = 0
    for _ in range(len(c)):
        order.append(at)
        left[at] = False
        at = int(np.where(left, c @ c[at], -2).argmax())
    return order


def _grouped(c: np.ndarray, sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each list, and of each group its blocks: lists of up to ``block`` vectors together, or one with more."""
    group, held = np.zeros(len(c), np.int32), []
    for k in _chain(c):
        if not held or held[-1] + sizes[k] > block:
            held.append(0)
        held[-1] += int(sizes[k])
        group[k] = len(held) - 1
    return group, np.maximum(1, -(-np.array(held, np.int64) // block))


def build(rows: DataFrame, lists: int | None = None) -> Index:
    """An index of all vectors; about the square root of their number of lists, MOST_LISTS at most. Vectors of different lengths can't be compared and raise ValueError."""
    n, least, most = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise ValueError(f"vectors have {least} to {most} elements")
    c = centroids(rows, max(1, min(MOST_LISTS, lists or int(np.ceil(n**0.5)))))

    def run(batches):
        for batch in batches:
            for some in _slices(batch):
                a = _angles(_matrix(some.column(1)), c)
                at = a.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(a[np.arange(len(at)), at]), some.column(0), some.column(1)], names=["list", "angle", "id", "v"])

    table = written(rows.select("id", "v").mapInArrow(run, "list int, angle double, id long, v array<double>"), "lists")
    near, far, sizes = np.full(len(c), np.inf), np.full(len(c), -np.inf), np.zeros(len(c), np.int64)
    for r in table.groupBy("list").agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count("*").alias("n")).collect():  # a row for each list
        near[r["list"]], far[r["list"]], sizes[r["list"]] = r["near"], r["far"], r["n"]
    block = max(1, min(BLOCK, ELEMENTS // max(1, most or 1), max(LEAST, -(-n // GROUPS))))
    return Index(table, Lists(c, near, far, *_grouped(c, sizes, block), block))


def reach(a: np.ndarray, lists: Lists) -> np.ndarray:
    """Of each vector (its angles to all centroids), the greatest cosine that one of each list can have with it."""
    gap = np.maximum(np.maximum(a - lists.far, lists.near - a) - SLACK, 0)
    return np.where(np.isfinite(gap), np.cos(np.minimum(gap, np.pi)), -2.0)


def _slices(batch: pa.RecordBatch):
    return (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS))


def _compared(index: Index, asking: DataFrame, wanted, keep, schema: str) -> DataFrame:
    """``keep`` of every block: an iterator of (number of a stretch, places of those in it that ask, places of the lists' vectors), and both sides' (ids, unit vectors). ``asking`` (id, v, x) are compared with the lists that ``wanted`` picks, given their angles to all centroids and x."""
    lists = index.lists
    many = len(lists.blocks)

    def asks(v: np.ndarray, x: np.ndarray) -> np.ndarray:
        return wanted(_angles(v, lists.centroids), x) & np.isfinite(lists.near)

    def groups(some: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        row, at = np.nonzero(asks(_matrix(some.column(1)), some.column(2).to_numpy(zero_copy_only=False)))
        return np.divmod(np.unique(row * many + lists.group[at]), many)

    def count(batches):
        n = np.zeros(many, np.int64)
        for batch in batches:
            for some in _slices(batch):
                n += np.bincount(groups(some)[1], minlength=many)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(many, dtype=np.int32)), pa.array(n)], names=["g", "n"])

    def send(batches):
        for batch in batches:
            for some in _slices(batch):
                row, g = (pa.array(x) for x in groups(some))
                yield pa.RecordBatch.from_arrays([g.cast(pa.int32()), *(c.take(row) for c in some.columns)], names=["g", "id", "v", "x"])

    asking = asking.select("id", "v", F.col("x").cast("double").alias("x"))
    q = np.ones(many, np.int64)
    for r in asking.mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():  # a row for each group
        q[r["g"]] = max(1, -(-r["n"] // lists.block))
    of = lambda values, at: F.get(F.array(*(F.lit(int(x)) for x in values)), at)
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    m_, q_ = of(lists.blocks, F.col("g")), of(q, F.col("g"))
    own = index.table.select(of(lists.group, F.col("list")).alias("g"), "id", "v", F.col("list").cast("double").alias("x"))
    sent = asking.mapInArrow(send, "g int, id long, v array<double>, x double")
    sides = own.select("g", part(m_).alias("i"), every(q_).alias("j"), "id", "v", "x", F.lit(False).alias("asks"))
    sides = sides.union(sent.select("g", every(m_).alias("i"), part(q_).alias("j"), "id", "v", "x", F.lit(True).alias("asks")))

    def run(table: pa.Table) -> pa.Table:
        side = table.column("asks").to_numpy()
        ids, v, x = table.column("id").to_numpy(), _matrix(table.column("v")), table.column("x").to_numpy()
        del table
        mine = np.flatnonzero(~side)
        mine = mine[np.argsort(x[mine], kind="stable")]
        them = np.flatnonzero(side)
        a, b, of_list = v[them], v[mine], x[mine].astype(np.int64)
        del v
        cuts = np.flatnonzero(np.diff(of_list, prepend=-1, append=-1)) if len(of_list) else np.zeros(1, np.int64)
        here = of_list[cuts[:-1]]

        def pieces():
            for k in range(0, len(a), ROWS):
                w = asks(a[k : k + ROWS], x[them[k : k + ROWS]])[:, here]
                # lists that all ask are multiplied together
                full, run_from = w.mean(0) > 0.5, None
                for n in range(len(here) + 1):
                    if n < len(here) and full[n]:
                        run_from = n if run_from is None else run_from
                        continue
                    if run_from is not None:
                        for c in range(cuts[run_from], cuts[n], PIECE):
                            yield k, slice(k, min(k + ROWS, len(a))), slice(c, min(c + PIECE, cuts[n]))
                        run_from = None
                    if n < len(here) and w[:, n].any():
                        rows = k + np.flatnonzero(w[:, n])
                        for c in range(cuts[n], cuts[n + 1], PIECE):
                            yield k, rows, slice(c, min(c + PIECE, cuts[n + 1]))

        return keep(pieces(), ids[them], a, ids[mine], b)

    return sides.groupBy("g", "i", "j").applyInArrow(run, schema)


def _first(a: np.ndarray, lists: Lists, probes: int) -> np.ndarray:
    """The nearest lists of each vector, those without vectors left out."""
    out = np.zeros(a.shape, bool)
    np.put_along_axis(out, np.argsort(np.where(np.isfinite(lists.near), a, np.inf), axis=1, kind="stable")[:, :probes], True, 1)
    return out


def _links(rows: DataFrame, threshold: float, probes: int | None) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) between distinct vectors' smallest ids, and (rep, id) of all rows; both tables."""
    reps, members = classes(rows)
    index = build(reps)
    known = index.lists
    place = known.group.astype(np.int64) * len(known.group) + np.arange(len(known.group))

    def wanted(a: np.ndarray, x: np.ndarray) -> np.ndarray:
        if probes is not None:
            return _first(a, known, probes)
        # a pair is found from the list that comes first
        return (reach(a, known) >= threshold) & (place >= place[x.astype(np.int64)][:, None])

    def keep(pieces, ids, v, others, w):
        # floats tell which few pairs are worth a product in doubles
        near, far = v.astype(np.float32), w.astype(np.float32)
        least = np.float32(threshold - 4e-7 * max(64, v.shape[1] if v.ndim > 1 else 1))
        x, y, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for _, a, b in pieces:
            r, c = np.nonzero(near[a] @ far[b].T >= least)
            r, c = (a.start + r if isinstance(a, slice) else a[r]), b.start + c
            for k in range(0, len(r), 1 << 16):
                i, j = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
                exact = np.einsum("ij,ij->i", v[i], w[j])
                found = (exact >= threshold) & (ids[i] != others[j])
                x, y, s = [*x, ids[i[found]]], [*y, others[j[found]]], [*s, exact[found]]
        return pa.table({"x": pa.array(np.concatenate(x)), "y": pa.array(np.concatenate(y)), "similarity": pa.array(np.concatenate(s))})

    found = _compared(index, index.table.select("id", "v", F.col("list").alias("x")), wanted, keep, "x long, y long, similarity double")
    links = written(found.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("similarity").alias("similarity")), "links")
    discard(reps)
    index.discard()
    return links, members


def edges(df: DataFrame, *, id_column: str, vector_column: str, threshold: float = 0.95, probes: int | None = None) -> DataFrame:
    """(a, b, similarity) with a < b: all pairs of different vectors' smallest ids with a cosine of at least ``threshold``, and the smallest id of equal vectors with each of the others (similarity 1). With ``probes`` only that many nearest lists are asked, and pairs may be missing. Rows without a vector that has a direction have none."""
    links, members = _links(vectors(df, id_column, vector_column), threshold, probes)
    return links.union(members.filter("id <> rep").select("rep", "id", F.lit(1.0)))


def nearest(df: DataFrame, queries: DataFrame | None = None, *, id_column: str, vector_column: str, k: int = 10, probes: int = 8, exact: bool = True) -> DataFrame:
    """(id, rank, neighbour, similarity): of each row of ``queries`` (of all rows, where none are given) the ``k`` other rows with the greatest cosine (to 12 digits), equal ones by ascending id.

    First the ``probes`` nearest lists are asked; with ``exact`` then all others that may hold a
    vector as near as the last one needed. Rows without a vector that has a direction are neither found nor ask;
    rows that share the asking row's id aren't its neighbours. Equal vectors ask and are found once.
    """
    reps, members = classes(vectors(df, id_column, vector_column))
    asking, askers = (reps, members) if queries is None else classes(vectors(queries, id_column, vector_column))
    index = build(reps)
    known = index.lists
    # a row may itself be among what its vector finds
    most = k + 1

    def keep(pieces, ids, v, others, w):
        done, held = [], None
        least = np.full(len(ids), -np.inf)
        for k, a, b in pieces:
            if held is None or held[0] != k:
                done += [held[1:]] if held else []
                held = (k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            product = v[a] @ w[b].T
            enough = least[a]
            if product.shape[1] > most:
                enough = np.maximum(enough, np.partition(product, -most, axis=1)[:, -most])
            # those that rounding makes equal stay
            x, y = np.nonzero(product >= enough[:, None] - 2e-12)
            s = np.concatenate([held[3], np.round(product[x, y], 12)])
            x = np.concatenate([held[1], a.start + x if isinstance(a, slice) else a[x]])
            y = np.concatenate([held[2], b.start + y])
            order = np.lexsort((others[y], -s, x))
            x, y, s = x[order], y[order], s[order]
            rank = np.arange(len(x)) - np.searchsorted(x, x)
            least[x[rank == most - 1]] = s[rank == most - 1]
            held = (k, *(c[rank < most] for c in (x, y, s)))
        x, y, s = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *done, *([held[1:]] if held else []), strict=True))
        return pa.table({"id": pa.array(ids[x]), "rep": pa.array(others[y]), "similarity": pa.array(s)})

    names = "id long, rep long, similarity double"
    best = lambda found, other: found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.col("similarity").desc(), other))).filter(F.col("rank") <= most)
    first = _compared(index, asking.select("id", "v", F.lit(0).alias("x")), lambda a, _: _first(a, known, probes), keep, names)
    found = written(best(first, "rep"), "nearest")
    tables = [found]
    if exact:
        # a list may be asked again if it can hold a vector as near as the last one found
        least = found.filter(F.col("rank") == most).select("id", F.col("similarity").alias("least"))
        open_ = written(asking.select("id", "v").join(least, "id", "left").select("id", "v", F.coalesce("least", F.lit(-2.0)).alias("x")), "asked")
        wanted = lambda a, x: ~_first(a, known, probes) & (reach(a, known) >= x[:, None] - SLACK)
        both = found.drop("rank").union(_compared(index, open_, wanted, keep, names)).groupBy("id", "rep").agg(F.max("similarity").alias("similarity"))
        found = written(best(both, "rep"), "nearest")
        tables += [open_, found]
    # of each class the smallest ids, as many as may be needed
    ids = members.distinct().withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= most)
    lists = best(found.drop("rank").join(ids.select("rep", F.col("id").alias("neighbour")), "rep"), "neighbour")
    lists = lists.groupBy(F.col("id").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "similarity"))).alias("near"))
    each = askers.distinct().join(lists, "rep").select("id", F.posexplode(F.slice(F.filter("near", lambda n: n["neighbour"] != F.col("id")), 1, k)).alias("p", "n"))
    out = written(each.select("id", (F.col("p") + 1).alias("rank"), "n.neighbour", "n.similarity"), "neighbours")
    discard(reps, members, *tables, *([] if queries is None else [asking, askers]))
    index.discard()
    return out


def removed(links: DataFrame, keep: str = "first") -> DataFrame:
    """(id) of rows that the greedy pass in ascending order removes. ``first``: a row goes if an earlier kept row is linked with it; decided in rounds, each of which settles all rows whose earlier neighbours are settled. ``last``: a row goes if a later row is linked with it."""
    if keep == "last":
        return links.select(F.col("a").alias("id")).distinct()
    links = written(links.select("a", "b"), "links")
    gone = []
    while not links.isEmpty():
        # kept: ids that no open link leads to
        kept = written(links.select(F.col("a").alias("id")).distinct().join(links.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "kept")
        out = written(links.join(kept, links.a == kept.id, "left_semi").select(F.col("b").alias("id")).distinct(), "gone")
        gone.append(out)
        rest = written(links.join(kept, links.a == kept.id, "left_anti").join(out, F.col("b") == out.id, "left_anti").join(out, F.col("a") == out.id, "left_anti"), "links")
        discard(links, kept)
        links = rest
    found = links.select(F.col("b").alias("id"))
    for out in gone:
        found = found.union(out)
    done = written(found.distinct(), "removed")
    discard(links, *gone)
    return done


def deduplicate(df: DataFrame, *, id_column: str, vector_column: str, threshold: float = 0.95, keep: str = "first", neighbours: int | None = None) -> DataFrame:
    """Rows that stay, all columns: those that the greedy pass leaves, and those without a vector that has a direction. With ``neighbours`` a row is linked only with that many nearest ones, itself among them, so links are at most that many for each row in dense groups, of which more rows then stay.

    Of equal vectors only the first (with ``keep`` last, the last) may stay: what is linked with it is linked with all of them.
    """
    sign = 1 if keep == "first" else -1  # the largest id stands for a class if it is to stay
    rows = vectors(df, id_column, vector_column).select((F.col("id") * sign).alias("id"), "v")
    if neighbours is None:
        links, members = _links(rows, threshold, None)
    else:
        reps, members = classes(rows)
        near = nearest(reps, id_column="id", vector_column="v", k=max(1, neighbours - 1)).filter(F.col("similarity") >= threshold)
        links = near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
    chosen = removed(links) if keep == "first" else links.select(F.col("b").alias("id"))
    (name,) = fresh(df, "gone")
    gone = chosen.union(members.filter("id <> rep").select("id")).distinct().select((F.col("id") * sign).alias(name))
    return df.join(gone, col(id_column) == F.col(name), "left_anti")
