"""Language-model scoring: Katz backoff with Good-Turing discounts and exactly normalised backoff weights.

Runs of one to ``order`` tokens are counted in all learning texts. Texts are coded once, in batches
of many documents: the batch's distinct words, and each token as a place among them. A batch asks for
the counts of its distinct runs of each length; keys are dealt to buckets by their hash, and each
bucket adds up its keys' counts, keeps them as its part of the count tables, and answers every batch
in the order of its question. A key that stands in a third of all texts so costs one entry for each
batch, and no text is shuffled.

P(w) = d(c) c / N for a word seen c times, and what is left goes to the unknown word. After a context
h of up to ``order`` - 1 tokens, P(w | h) = d(c) c(hw) / (c(h) + 1/2) for a run hw seen (the half leaves
something to contexts all of whose runs are frequent), and a(h) P(w | h') for another, h' being h without
its first token, and so on down to the word alone. a(h) = (1 - sum of the seen P(w | h)) / (1 - sum of
P(w | h') of the same words), 1 for a context never seen. A run that is seen has all its shorter ends
seen, so the sums need no other weight; each batch gives what the runs that it is the
first to hold add to them, and buckets of contexts add these up and answer as they do for counts. Before a text's first token stand as many starts as the context is long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.names import quoted

from .common import _BASE, _mixed, blocks, cut, discard, learn_mod, mix64, text_buffers, word_hashes

#: Counts up to this are discounted.
K = 5
#: Fixed hashes of the end of a text, which is a token, and of its start, which is only a context.
END, START = (np.uint64(int(v)) for v in _mixed(2, 4242))
#: Added to every context's count; it is what backoff gets at least.
HELD_BACK = 0.5
_CODEC = "zstd"


def _narrow(values: np.ndarray) -> bytes:
    """Counts, in as many bytes as the largest takes: 1, 2, 4 or 8."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + _packed(values.astype(f"<u{width}"))


def _wide(data: bytes) -> np.ndarray:
    return _unpacked(data[1:], f"<u{data[0]}").astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec=_CODEC, asbytes=True) if raw else b"")


def _unpacked(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n, codec=_CODEC, asbytes=True), kind) if n else np.zeros(0, kind)


def _bits(flags: np.ndarray) -> bytes:
    return _packed(np.packbits(flags))


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(_unpacked(data, np.uint8))[:n].astype(bool)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as their differences, in as many bytes as the largest takes."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width, first = data[0], np.frombuffer(data, np.uint64, 1, 1)
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    return np.concatenate([first, first + np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)])


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(h * np.uint64(_BASE) + (w ^ np.uint64(0x2545F4914F6CDD1D)))


def starts_of(order: int) -> list:
    """By k, the hash of k starts, the context of a text's first token."""
    out = [None, START]
    while len(out) < order:
        out.append(pair_hash(np.array(out[-1:]), np.array([START]))[0])
    return out


def coded(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """One row for each batch of about ``batch_bytes`` of text, in the order of the rows: ids, which are learned from, tokens of each document, distinct word hashes, and every token's place among them. A longer text is a batch of its own."""

    def run(batches):
        held, size, done = [], 0, 0

        def row():
            ids, learn, words, named = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2, 4))
            counts = np.concatenate([np.diff(h[3]) for h in held]) + 1
            ends = np.cumsum(counts)
            last = np.zeros(ends[-1], bool)
            last[ends - 1] = True
            tokens = np.empty(len(last), np.uint64)
            tokens[last], tokens[~last] = END, words
            vocabulary, place, times = np.unique(tokens, return_inverse=True, return_counts=True)
            # the commonest words have the smallest places
            common = np.argsort(-times, kind="stable")
            rank = np.empty(len(common), np.uint32)
            rank[common] = np.arange(len(common), dtype=np.uint32)
            values = [[TaskContext.get().partitionId() << 40 | done], [pa.array(ids, mask=~named).to_pylist()], [learn], [counts], [vocabulary[common].tobytes()], [_packed(rank[place].view(np.uint8).reshape(-1, 4).T)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], names=names)

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids, learn = pc.fill_null(batch.column(0), 0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for d, e in blocks(offsets):
                words, starts = word_hashes(data[offsets[d] : offsets[e]], offsets[d : e + 1])
                held.append((ids[d:e], learn[d:e], words, starts, named[d:e]))
                size += int(offsets[e] - offsets[d])
                if size >= batch_bytes:
                    yield row()
                    held, size, done = [], 0, done + 1
        if held:
            yield row()

    names = ["batch", "ids", "learn", "counts", "vocabulary", "tokens"]
    return docs.mapInArrow(run, "batch long, ids array<long>, learn array<boolean>, counts array<long>, vocabulary binary, tokens binary")


class Batch:
    """A coded row: tokens as places in the vocabulary, and its distinct runs of 1 to ``order`` tokens. Of run length k, ``keys[k]`` are their hashes and ``at[k]`` the run that ends at each token; ``left[k]`` is the context, a run of k - 1 tokens or, one past them, the start alone; ``suffix[k]`` is the run without its first token."""

    def __init__(self, row: dict, order: int):
        self.ids, self.learn = pa.array(row["ids"], pa.int64()), np.array(row["learn"], bool)
        self.counts = np.array(row["counts"], np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.tokens = np.ascontiguousarray(_unpacked(row["tokens"], np.uint8).reshape(4, -1).T).view(np.int32).ravel()
        self.doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        self.learned = self.learn[self.doc]
        self.starts = starts_of(order)
        self.keys, self.at = [None, self.vocabulary], [None, self.tokens]
        self.left, self.suffix = [None, None], [None, None]
        first, v = np.cumsum(self.counts) - self.counts, len(self.vocabulary)
        for k in range(2, order + 1):
            shorter = self.at[k - 1]
            both = np.empty(len(shorter), np.int64)
            both[1:] = shorter[:-1]
            both[first] = len(self.keys[k - 1])
            both *= v
            both += self.tokens
            local, where, place = np.unique(both, return_index=True, return_inverse=True)
            del both
            self.at.append(place.astype(np.int32))
            self.suffix.append(shorter[where])
            self.left.append((local // v).astype(np.int32))
            self.keys.append(pair_hash(self.contexts(k)[self.left[k]], self.vocabulary[local % v]))

    def contexts(self, k: int) -> np.ndarray:
        """Hashes of what may stand before the last of k tokens."""
        return np.append(self.keys[k - 1], self.starts[k - 1])

    def question(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, not sorted, how often each stands in learning texts, and whether in others."""
        other = np.zeros(len(self.keys[k]), bool)
        other[self.at[k][~self.learned]] = True
        return self.keys[k], np.bincount(self.at[k][self.learned], minlength=len(self.keys[k])), other


def _parts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys' ascending order, and where each bucket, a range of keys, starts in it."""
    order = np.argsort(keys, kind="stable")
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    first = np.arange(buckets, dtype=np.uint64) << shift if buckets > 1 else np.zeros(1, np.uint64)
    return order, np.append(np.searchsorted(keys[order], first), len(keys))


def count(batches: DataFrame, k: int, buckets: int) -> DataFrame:
    """The count tables of runs of k tokens, by bucket: rows of the answers to each batch (totals in the order of its question, and of each key whether a text that isn't learned from has it, and whether the batch is the first learning one that holds it), and one row of each bucket's figures: distinct keys, all, and how many keys were seen 1 to K + 1 times."""

    def ask(rows):
        for batch in rows:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, n, other = Batch(row, k).question(k)
                order, edge = _parts(keys, buckets)
                keys, n, other = keys[order], n[order], other[order]
                full = np.flatnonzero(np.diff(edge))
                part = lambda x: [x[edge[f] : edge[f + 1]] for f in full]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array([row["batch"]] * len(full), pa.int64()), pa.array([_pack_keys(x) for x in part(keys)], pa.binary()), pa.array([_narrow(x) for x in part(n)], pa.binary()), pa.array([_bits(x) for x in part(other)], pa.binary())], names=["bucket", "batch", "keys", "n", "other"])

    asked = batches.mapInArrow(ask, "bucket long, batch long, keys binary, n binary, other binary")

    def answer(table: pa.Table) -> pa.Table:
        bucket, batch = table.column("bucket")[0].as_py(), table.column("batch").to_pylist()
        order = np.argsort(batch, kind="stable")
        keys = [_unpack_keys(table.column("keys")[int(i)].as_py()) for i in order]
        n = np.concatenate([_wide(table.column("n")[int(i)].as_py()) for i in order])
        edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, n)
        other = np.concatenate([_flags(table.column("other")[int(i)].as_py(), len(k)) for i, k in zip(order, keys, strict=True)])
        other = (np.bincount(place, weights=other, minlength=len(distinct)) > 0)[place]
        first, seen = np.zeros(len(n), bool), np.flatnonzero(n)
        first[seen[np.unique(place[seen], return_index=True)[1]]] = True
        known = total[total > 0]
        figures = [len(known), int(known.sum()), *np.bincount(known[known <= K + 1], minlength=K + 2)[1:].tolist()]
        parts = list(zip(edge[:-1], edge[1:], strict=True))
        column = lambda pack, x: pa.array([*(pack(x[a:b]) for a, b in parts), None], pa.binary())
        return pa.table({"bucket": pa.array([bucket] * (len(keys) + 1), pa.int64()), "batch": pa.array([*(batch[int(i)] for i in order), None], pa.int64()), "totals": column(_narrow, total[place]), "other": column(_bits, other), "first": column(_bits, first), "figures": pa.array([*([None] * len(keys)), figures], pa.list_(pa.int64()))})

    return asked.groupBy("bucket").applyInArrow(answer, "bucket long, batch long, totals binary, other binary, first binary, figures array<long>")


def figures(counted: DataFrame) -> list[int]:
    """distinct, all, n1 to n(K + 1) over all buckets."""
    found = counted.filter("figures is not null").select(F.posexplode("figures").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    by = {r["k"]: r["v"] for r in found}
    return [by.get(k, 0) for k in range(K + 3)]


def discounts(seen: list[int]) -> np.ndarray:
    """d(c) for c from 0 to K + 1, 1 above K: Katz's, from n1 to n(K + 1) as counted; where these don't give values between 0 and 1, from their log-linear fit; and where that doesn't either (hardly any text), each count loses half an occurrence."""
    n, c = np.array(seen[2:], float), np.arange(1, K + 1)
    out = np.ones(K + 2)
    fits = [n]
    if (n > 0).all():
        slope, start = np.polyfit(np.log(np.arange(1, K + 2)), np.log(n), 1)
        fits.append(np.exp(start + slope * np.log(np.arange(1, K + 2))))
    for m in fits:
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = (K + 1) * m[K] / m[0]
            d = ((c + 1) * m[1:] / (c * m[:-1]) - rest) / (1 - rest)
        if np.isfinite(d).all() and (d > 0).all() and (d < 1).all():
            out[1 : K + 1] = d
            return out
    out[1 : K + 1] = (c - 0.5) / c
    return out


def _discounted(total: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c"""
    return d[np.minimum(total, K + 1)] * total


class Answers:
    """A batch's totals and flags, put back into the order of its keys."""

    def __init__(self, keys: np.ndarray, buckets: int, rows: list[dict]):
        order, edge = _parts(keys, buckets)
        totals, other, first = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for r in rows:
            a, b = edge[r["bucket"]], edge[r["bucket"] + 1]
            totals[a:b] = _wide(r["totals"])
            other[a:b], first[a:b] = _flags(r["other"], b - a), _flags(r["first"], b - a)
        self.totals, self.other, self.first = (np.empty_like(x) for x in (totals, other, first))
        self.totals[order], self.other[order], self.first[order] = totals, other, first


#: A row for each batch (its documents, and how often each needs which of the weights it asks for) and one for each bucket that it asks or adds to.
FOUND = {"batch": pa.int64(), "ids": pa.list_(pa.int64()), "n": pa.list_(pa.int64()), "known": pa.list_(pa.int64()), "base": pa.list_(pa.float64()), "score": pa.list_(pa.float64()), "place": pa.binary(), "weight": pa.binary(), "times": pa.binary(), "bucket": pa.int64(), "keys": pa.binary(), "c": pa.binary(), "kept": pa.binary(), "lower": pa.binary(), "wanted": pa.binary()}
FOUND_DDL = "batch long, ids array<long>, n array<long>, known array<long>, base array<double>, score array<double>, place binary, weight binary, times binary, bucket long, keys binary, c binary, kept binary, lower binary, wanted binary"


def _rows(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in FOUND.items()], names=list(FOUND))


def _evaluated(b: Batch, batch: int, buckets: int, known: list, d: list, n: int, v: int, scale: float, unknown: float):
    """Of a batch: each document's tokens, known tokens and sums of logarithms, backoff weights left out, and how often it needs which weight; and by bucket the contexts whose weights are wanted or to whose sums the runs that the batch is the first to hold add. ``known`` and ``d`` are answers and discounts by the length of runs."""
    size, w = len(b.counts), known[1]
    sums = lambda x: np.bincount(b.doc, weights=x, minlength=size)
    # of each run, its last token's probability after the others, backoff weights left out
    p = [None, np.where(w.totals > 0, scale * _discounted(w.totals, d[1]) / max(n, 1), unknown)]
    # a run is a context as often as it stands, and the start as often as the end
    ends = w.totals[b.vocabulary == END]
    context, asked = [None, None], []
    for k in range(2, len(known)):
        context.append(np.append(known[k - 1].totals, ends))
        seen = known[k].totals > 0
        p.append(np.where(seen, np.where(seen, _discounted(known[k].totals, d[k]), 1.0) / (context[k][b.left[k]] + HELD_BACK), p[k - 1][b.suffix[k]]))
        first = np.flatnonzero(known[k].first & np.append(known[k - 1].other, True)[b.left[k]])
        add = lambda x: np.bincount(b.left[k][first], weights=x, minlength=len(context[k]))  # noqa: E731, B023
        asked.append([b.contexts(k), context[k], add(_discounted(known[k].totals[first], d[k])), add(p[k - 1][b.suffix[k][first]])])
    # from the longest context down, as far as the run stays unseen; contexts are numbered through all lengths
    before = np.cumsum([0, *(len(a[0]) for a in asked)])
    keys, c, kept, lower = (np.concatenate(x) for x in zip(*asked, strict=True))
    open_, need = np.arange(len(b.tokens)), []
    for k in range(len(known) - 1, 1, -1):
        open_ = open_[known[k].totals[b.at[k][open_]] == 0]
        left = b.left[k][b.at[k][open_]]
        far = context[k][left] > 0
        need.append(b.doc[open_[far]] * before[-1] + before[k - 2] + left[far])
    need, times = np.unique(np.concatenate(need), return_counts=True)
    place, weight = need // before[-1], need % before[-1]
    wanted = np.zeros(len(keys), bool)
    wanted[weight] = True
    used = np.flatnonzero(wanted | (kept > 0))
    order, edge = _parts(keys[used], buckets)
    order = used[order]
    rank = np.cumsum(wanted[order]) - 1
    number = np.zeros(len(keys), np.int32)
    number[order] = rank
    base, gain = np.log10((w.totals[b.tokens] + 1) / (n + v + 1)), np.log10(p[-1])[b.at[len(p) - 1]]
    yield _rows(1, batch=[batch], ids=[b.ids.to_pylist()], n=[b.counts], known=[sums(w.totals[b.tokens] > 0).astype(np.int64)], base=[sums(base)], score=[sums(gain)], place=[_packed(place.astype(np.int32))], weight=[_packed(number[weight])], times=[_narrow(times)])
    full = np.flatnonzero(np.diff(edge))
    part = lambda pack, x: [pack(x[order[edge[f] : edge[f + 1]]]) for f in full]
    yield _rows(len(full), batch=[batch] * len(full), bucket=full, keys=part(_pack_keys, keys), c=part(_narrow, c), kept=part(_packed, kept), lower=part(_packed, lower), wanted=part(_bits, wanted))


def weights(found: DataFrame) -> DataFrame:
    """(batch, bucket, a) the logarithms of the backoff weights that each batch wants of a bucket, in the order of their keys."""

    def answer(table: pa.Table) -> pa.Table:
        batch = table.column("batch").to_pylist()
        order = np.argsort(batch, kind="stable")
        column = lambda name, read: [read(table.column(name)[int(i)].as_py()) for i in order]
        doubles = lambda x: _unpacked(x, np.float64)
        keys = column("keys", _unpack_keys)
        edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = lambda name: np.bincount(place, weights=np.concatenate(column(name, doubles)), minlength=len(distinct))
        c = np.zeros(len(distinct), np.int64)
        c[place] = np.concatenate(column("c", _wide))
        with np.errstate(divide="ignore", invalid="ignore"):  # of contexts that nobody wants
            a = np.log10((1 - total("kept") / (c + HELD_BACK)) / (1 - total("lower")))[place]
        wanted = [_flags(table.column("wanted")[int(i)].as_py(), len(k)) for i, k in zip(order, keys, strict=True)]
        return pa.table({"batch": pa.array([batch[int(i)] for i in order], pa.int64()), "bucket": table.column("bucket"), "a": pa.array([_packed(a[s:e][f]) for s, e, f in zip(edge[:-1], edge[1:], wanted, strict=True)], pa.binary())})

    asked = found.filter("bucket is not null").select("batch", "bucket", "keys", "c", "kept", "lower", "wanted")
    return asked.groupBy("bucket").applyInArrow(answer, "batch long, bucket long, a binary")


def score(docs: DataFrame, *, train: Column, order: int = 3, batch_bytes: int = 8 << 20, bucket_bytes: int = 12 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row: log10 probabilities of the whole text and its end, under the add-one unigram model and the Katz model of runs of up to ``order`` tokens (2 at least) of the rows that ``train`` admits.

    Null and empty texts are their end alone. Rows with the same id are scored each; a null id
    stays null. Without learning texts all words are unknown, and both models give the
    unknown word all probability. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(docs[quoted(id_column)].cast("long").alias("doc_id"), docs[quoted(text_column)].cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("learn"))
    total_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = 1 << max(0, (total_bytes // bucket_bytes).bit_length())
    batches = cut(coded(rows, batch_bytes), "batches")
    counted = [cut(count(batches, k, buckets), f"runs{k}") for k in range(1, order + 1)]
    seen = [figures(c) for c in counted]
    d = [None, *(discounts(s) for s in seen)]
    v, n = seen[0][:2]
    # what the words seen 1 to K times lose goes to the unknown word
    lost = sum(seen[0][1 + c] * c * (1 - d[1][c]) for c in range(1, K + 1))
    unknown = lost / n if n and lost > 0 else 1 / (n + 1)
    scale = (1 - unknown) / (1 - lost / n) if n else 1.0

    # one answer from each bucket for a batch
    met = batches
    for k, table in enumerate(counted, 1):
        met = met.join(table.filter("batch is not null").groupBy("batch").agg(F.collect_list(F.struct("bucket", "totals", "other", "first")).alias(f"runs{k}")), "batch")

    def evaluate(found):
        for rows in found:
            for k in range(rows.num_rows):
                row = rows.slice(k, 1).to_pylist()[0]
                b = Batch(row, order)
                yield from _evaluated(b, row["batch"], buckets, [None, *(Answers(b.keys[k], buckets, row[f"runs{k}"]) for k in range(1, order + 1))], d, n, v, scale, unknown)

    found = cut(met.mapInArrow(evaluate, FOUND_DDL), "evaluated")
    for table in (batches, *counted):
        discard(table)
    given = cut(weights(found), "weights").groupBy("batch").agg(F.collect_list(F.struct("bucket", "a")).alias("given"))
    scored = found.filter("bucket is null").select("batch", "ids", "n", "known", "base", "score", "place", "weight", "times")

    def finish(rows):
        for batch in rows:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                a = [_unpacked(g["a"], np.float64) for g in sorted(row["given"] or [], key=lambda g: g["bucket"])]
                a, total = np.concatenate([np.zeros(0), *a]), np.array(row["score"], np.float64)
                place, weight = _unpacked(row["place"], np.int32), _unpacked(row["weight"], np.int32)
                total += np.bincount(place, weights=a[weight] * _wide(row["times"]), minlength=len(total))
                values = [pa.array(row[c], pa.int64()) for c in ("ids", "n", "known")] + [pa.array(np.full(len(total), n, np.int64)), pa.array(row["base"], pa.float64()), pa.array(total)]
                yield pa.RecordBatch.from_arrays(values, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return scored.join(given, "batch", "left").mapInArrow(finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return learn_mod(doc_id, 7) == 2
