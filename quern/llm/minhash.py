"""Near-duplicate components: circulant MinHash, banding, exact Jaccard on full shingle sets.

Every signature coordinate comes from two permutations of 32-bit values: the first scatters a
document's shingles, the second is shifted circularly by one more step for each coordinate.

Equal sets are one class first (128-bit digest), so copies cost one row each. Classes that share a
band are candidates. Each is compared with the smallest class of the band; then, in bands that still
hold several components, all pairs of classes of different components whose signatures agree often
enough are compared as well. Nothing is capped, and pairs inside a component are never made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.names import quoted

from .common import blocks, cut, discard, drop_ids, mix64, residue, residues_of, shingle_hashes, text_buffers, word_hashes

#: Rows that go through one vectorised step of the signatures.
_STEP = 1 << 16
#: Classes of a band that one task compares with as many others.
_GROUP = 2048
#: And how many shingles these may have: 8 bytes each, and about as much text.
_GROUP_SHINGLES = 1 << 22


def _permute(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of the 32-bit values."""
    a, b = (np.uint32(int(v) & 0xFFFFFFFF | 1) for v in mix64(np.array([2 * seed + 1, 2 * seed + 2], np.uint64)))
    x = x * a
    x ^= x >> np.uint32(16)
    x *= b
    x ^= x >> np.uint32(15)
    return x


def signatures(shingles: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """A row of uint32 minima for each document; every document has a shingle."""
    scattered = _permute((shingles >> np.uint64(20)).astype(np.uint32), 1)
    out = np.empty((coordinates, len(starts)), np.uint32)
    d = 0
    while d < len(starts):
        e = max(d + 1, int(np.searchsorted(starts, starts[d] + _STEP, "right")) - 1) if d + 1 < len(starts) else len(starts)
        part = scattered[starts[d] : starts[e] if e < len(starts) else len(scattered)]
        at = starts[d:e] - starts[d]
        for k in range(coordinates):
            out[k, d:e] = np.minimum.reduceat(_permute(part + np.uint32(k), 2), at)
        d = e
    return out.T


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """(document, sorted distinct shingle hashes) of the documents that have words."""
    words, starts = word_hashes(data, offsets)
    hashes, docs = shingle_hashes(words, starts, width)
    edges = np.searchsorted(docs, np.arange(len(offsets)))
    for d in np.flatnonzero(np.diff(edges)):
        s = np.sort(hashes[edges[d] : edges[d + 1]])
        yield int(d), s if len(s) < 2 else s[np.concatenate([[True], s[1:] != s[:-1]])]


def sketch(docs: DataFrame, *, width: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, a digest of the set, the bands' keys and one byte of every coordinate."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            n = batch.num_rows
            size, digest = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
            keys, low = np.zeros((n, bands), np.uint64), np.zeros((n, bands * rows), np.uint8)
            for d, e in blocks(offsets):
                found = list(shingle_sets(data[offsets[d] : offsets[e]], offsets[d : e + 1], width))
                if not found:
                    continue
                at = np.array([d + i for i, _ in found])
                lengths = np.array([len(s) for _, s in found])
                flat, starts = np.concatenate([s for _, s in found]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
                size[at] = lengths
                digest[0, at] = np.add.reduceat(mix64(flat), starts)
                digest[1, at] = np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
                sig = signatures(flat, starts, bands * rows)
                low[at] = (sig & np.uint32(255)).astype(np.uint8)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40), (len(at), bands))
                for r in range(rows):
                    key = mix64(key ^ sig[:, r::rows].astype(np.uint64))
                keys[at] = key
            many = np.where(size > 0, bands, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size),
                    *(pa.array(x.view(np.int64)) for x in digest),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(keys[size > 0].ravel().view(np.int64))),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest_a", "digest_b", "bands", "low"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>, low binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root being the smallest node reachable. Large and small stars in turn, each written to the shared folder, until nothing changes."""
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        # minima are tables, so that a join by a star's centre reads plain exchanges, which Spark can split
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        lower = cut(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b")))
        last, edges = edges, cut(small.filter("a <> b").distinct(), "edges")
        for table in (last, least, large, lower):
            discard(table)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of some ids; of rows that share an id the smallest text. Only these texts are shuffled: those of other ids are dropped before, by a broadcast of their residues. A table, so that joins with it read plain exchanges, whose hot partitions Spark can split."""
    texts = docs.withColumn("_r", residue(F.col("doc_id"))).join(residues_of(ids, "doc_id", "_r"), "_r", "left_semi").join(ids, "doc_id", "left_semi")
    return cut(texts.groupBy("doc_id").agg(F.min("text").alias("text")), "texts")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets have den * intersection >= num * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = _texts(ids, docs)
    rows = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")

    def run(batches):
        for batch in batches:
            keep, last, held = np.zeros(batch.num_rows, bool), None, None
            a, columns = batch.column("a").to_pylist(), [text_buffers(batch.column(c)) for c in ("text_a", "text_b")]
            one = lambda k, i: next((s for _, s in shingle_sets(columns[k][0][columns[k][1][i] : columns[k][1][i + 1]], columns[k][1][i : i + 2], width)), np.zeros(0, np.uint64))  # noqa: E731, B023
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, held = a[i], one(0, i)
                other = one(1, i)
                shared = len(np.intersect1d(held, other, assume_unique=True))
                keep[i] = shared > 0 and den * shared >= num * (len(held) + len(other) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _rest(members: DataFrame, comp: DataFrame, classes: DataFrame, docs: DataFrame, least: float, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) not found yet: in bands that hold several components, classes of different ones whose signature bytes agree in a share of at least ``least`` are compared by their full sets. A pair is looked at in the first band that it shares, and no more once a task has found its components linked; so only links come out, not pairs."""
    now = members.join(comp, members.rep == comp.node, "left").select("key", "rep", "lead", "n_shingles", F.coalesce("root", "rep").alias("root"))
    mixed = now.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("n"), F.sum("n_shingles").alias("size")).filter("r <> s and n > 2")
    many = F.greatest(F.ceil(F.col("n") / _GROUP), F.ceil(F.col("size") / _GROUP_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("rep"), many).cast("int")
    # the band's smallest class has been compared with all others
    dealt = cut(now.filter("rep <> lead").join(mixed.select("key", "n", "size"), "key").withColumn("own", own), "mixed")
    texts = _texts(dealt.select(F.col("rep").alias("doc_id")).distinct(), docs)
    dealt = dealt.join(classes.select("rep", "low", "bands"), "rep").join(texts.toDF("rep", "text"), "rep")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "root", "low", "bands", "text")

    def run(table: pa.Table) -> pa.Table:
        rep, root, own = (table.column(c).to_numpy() for c in ("rep", "root", "own"))
        i, j, key = (table.column(c)[0].as_py() for c in ("i", "j", "key"))
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(rep), -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        band = int(np.flatnonzero(bands[0] == key)[0])
        data, offsets = text_buffers(table.column("text"))
        sets: dict[int, np.ndarray] = {}

        def words_of(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = next(v for _, v in shingle_sets(data[offsets[x] : offsets[x + 1]], offsets[x : x + 2], width))
            return sets[x]

        root, links = root.copy(), []
        roots, counts = np.unique(root, return_counts=True)
        most = roots[np.argmax(counts)]
        for x in np.flatnonzero(root != most):
            other = root != root[x]
            if i != j:
                other &= own != own[x]
            at = np.flatnonzero(other)
            at = at[(low[at] == low[x]).mean(1) >= least]
            at = at[(bands[at] == bands[x]).argmax(1) == band]
            for y in at:
                if root[x] != root[y]:
                    a, b = words_of(x), words_of(y)
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    if den * shared >= num * (len(a) + len(b) - shared):
                        links.append((rep[x], rep[y]))
                        root[root == root[x]] = root[y]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 5, num: int = 75, den: int = 100, bands: int = 32, rows: int = 4, least: float = 0.58, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links: den * intersection >= num * union of the sets of ``width``-word shingles.

    At 0.75 a pair shares none of 32 bands of 4 coordinates with probability 5e-6; signatures of
    linked texts agree in fewer than ``least`` of 128 coordinates with about the same.

    A text with fewer words is one shingle; null, empty or blank texts have none, are linked with
    nothing and kept. Rows with the same id are one node; where their texts differ, the smallest text
    is the one compared. A null id is never linked. Texts of any length are compared whole. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(docs[quoted(id_column)].cast("long").alias("doc_id"), docs[quoted(text_column)].cast("string").alias("text"))
    sketches = cut(sketch(docs, width=width, bands=bands, rows=rows), "sketches")
    known = sketches.filter("n_shingles > 0 and doc_id is not null")
    digest = ["n_shingles", "digest_a", "digest_b"]
    # small sides are cut off where they are counted by the join's own key: joins then read plain exchanges, whose hot partitions Spark can split
    reps = cut(known.groupBy(*digest).agg(F.min("doc_id").alias("rep")), "reps")
    # only classes need bands; the digest tells a class from another row with the same id
    classes = cut(known.join(reps, digest).filter("doc_id = rep").dropDuplicates(["rep", *digest]).select("rep", *digest, "bands", "low"), "classes")
    keys = classes.select(F.explode("bands").alias("key"), "rep", "n_shingles")
    shared = cut(keys.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n"), "shared")
    members = cut(keys.join(shared, "key"), "members")
    first = members.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut(_verified(cut(first, "pairs"), docs, width, num, den), "links")
    comp = components(links)
    more = cut(_rest(members, comp, classes, docs, least, width, num, den), "links")
    if not more.isEmpty():
        comp = components(links.union(more))
    named = classes.join(comp, classes.rep == comp.node, "left").select(*digest, F.coalesce("root", "rep").alias("component_id"))
    named = cut(named.groupBy(*digest).agg(F.min("component_id").alias("component_id")), "named")
    out = sketches.select("doc_id", *digest).join(named, digest, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is its component's smallest id. Rows that repeat such a row stay."""
    gone = near_duplicates(docs, **options).filter("not kept").select("doc_id")
    return drop_ids(docs, options.get("id_column", "doc_id"), gone)
