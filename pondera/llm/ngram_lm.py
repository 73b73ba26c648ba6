"""Language-model scoring by deleted interpolation.

A token's probability is a mixture of its maximum-likelihood estimates given the
token before, given nothing, and uniform.  The weights depend on how often the
context was seen (buckets by powers of two) and are learned by
expectation-maximisation on held-out training documents, against counts from
which these documents are deleted.

Counts cover every training text: each chunk of texts asks for the corpus
counts of its distinct unigrams and bigrams (see ``exchange``).  For the weights,
held-out tokens are summed to a histogram of their estimates, whose size has a
fixed bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondera.llm import exchange, textkit
from pondera.plans.scratch import Scratch

SCORED, TRAIN, HELD = 0, 1, 2
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
BUCKETS = 48
#: Histogram steps per octave, and the mark of an estimate of zero.
STEP, NONE = 8, -(1 << 20)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token names (words, then one end for each text), the names before them, and the texts' borders."""
    w, borders = textkit.words(column)
    n = np.diff(borders) + 1
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.full(at[-1], END, np.uint64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    out[inner] = w
    before = np.concatenate([[START], out[:-1]])[: len(out)]
    before[at[:-1]] = START
    return out, before, at


def pair_names(before: np.ndarray, names: np.ndarray) -> np.ndarray:
    return textkit.mix(before * _A + names * _B)


def _chunk(batch, i: int) -> tuple[pa.Array, int, int]:
    offsets = batch.column("offsets")[i].values.to_numpy(zero_copy_only=False)
    data = batch.column("data")[i].as_buffer()
    column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data])
    return column, batch.column("chunk")[i].as_py(), batch.column("role")[i].as_py()


def _requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                column, chunk, role = _chunk(batch, i)
                t, before, _ = tokens(column)
                for order, names in ((1, t), (2, pair_names(before, t))):
                    found, times = np.unique(names, return_counts=True)
                    if role == SCORED:
                        times = np.zeros_like(times)
                    at = exchange.bucket_borders(found, buckets)
                    rows = [(b, chunk, role, order, found[at[b] : at[b + 1]].tobytes(), exchange.pack_counts(times[at[b] : at[b + 1]])) for b in range(buckets) if at[b] < at[b + 1]]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "chunk", "role", "order", "names", "times"])

    return run


_REQUEST = "bucket bigint, chunk bigint, role int, order int, names binary, times binary"
#: total, kinds: sums of all and of the not deleted counts, and numbers of names with any, on the rows with chunk -1.
_REPLY = "chunk bigint, role int, order int, bucket bigint, counts binary, deleted binary, total bigint, kinds bigint, total_left bigint, kinds_left bigint"


def _answer(table: pa.Table) -> pa.Table:
    """Corpus counts of each block's names, in the block's order."""
    out: list[tuple] = []
    order_of = table.column("order").to_numpy()
    bucket = table.column("bucket")[0].as_py()
    for order in np.unique(order_of):
        t = table.filter(pa.array(order_of == order))
        blocks = [np.frombuffer(x, np.uint64) for x in t.column("names").to_pylist()]
        role = np.repeat(t.column("role").to_numpy(), [len(x) for x in blocks])
        times = np.concatenate([exchange.unpack_counts(x) for x in t.column("times").to_pylist()])
        found, where = np.unique(np.concatenate(blocks), return_inverse=True)
        every = np.bincount(where, weights=times, minlength=len(found)).astype(np.int64)
        held = np.bincount(where, weights=np.where(role == HELD, times, 0), minlength=len(found)).astype(np.int64)
        left, at = every - held, 0
        for chunk, kind, block in zip(t.column("chunk").to_pylist(), t.column("role").to_pylist(), blocks, strict=True):
            own = where[at : at + len(block)]
            at += len(block)
            out.append((chunk, kind, int(order), bucket, exchange.pack_counts(every[own]), exchange.pack_counts(left[own]) if kind == HELD else None, None, None, None, None))
        if order == 1:
            out.append((-1, -1, 1, bucket, None, None, int(every.sum()), int((every > 0).sum()), int(left.sum()), int((left > 0).sum())))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    names = [x.split()[0] for x in _REPLY.split(", ")]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


class _Counted:
    """A chunk's tokens with their corpus counts."""

    def __init__(self, packed: pa.Table, replies: pa.Table, which: str):
        column, _, _ = _chunk(packed.combine_chunks().to_batches()[0], 0)
        t, before, self.borders = tokens(column)
        replies = replies.sort_by("bucket")
        order = replies.column("order").to_numpy()
        got = {k: np.concatenate([exchange.unpack_counts(x) for x in replies.filter(pa.array(order == k)).column(which).to_pylist()]) for k in (1, 2)}
        found, where = np.unique(t, return_inverse=True)
        self.token = got[1][where]
        at = np.searchsorted(found, before)
        starts = before == START
        at[starts] = np.searchsorted(found, END)
        self.context = got[1][np.minimum(at, len(found) - 1)]  # the start is seen as often as the end
        _, where = np.unique(pair_names(before, t), return_inverse=True)
        self.pair = got[2][where]

    def estimates(self, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of the context's count, and the bigram and unigram estimates."""
        bucket = np.where(self.context > 0, np.log2(np.maximum(self.context, 1)).astype(np.int64) + 1, 0)
        return np.minimum(bucket, BUCKETS - 1), self.pair / np.maximum(self.context, 1), self.token / max(total, 1)


def _steps(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.rint(np.log2(np.where(p > 0, p, 1)) * STEP).astype(np.int64), NONE)


def _histogram(total: int):
    def run(packed: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["bucket", "bigram", "unigram", "n"]
        if not packed.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 4, names)
        b, p2, p1 = _Counted(packed, replies, "deleted").estimates(total)
        keys, n = np.unique(np.stack([b, _steps(p2), _steps(p1)]), axis=1, return_counts=True)
        return pa.Table.from_arrays([*(pa.array(k) for k in keys), pa.array(n)], names)

    return run


def learn_weights(histogram: np.ndarray, kinds: int, *, rounds: int = 200, least: float = 1e-4) -> np.ndarray:
    """Weights (bigram, unigram, uniform) for each bucket by EM on rows ``bucket, bigram, unigram, n``.

    A bucket without held-out tokens has the weights of the nearest bucket below
    it that has some; with none at all, the three are equal.  No weight of the unigram or the
    uniform part is under ``least``.
    """
    weights = np.full((BUCKETS, 3), np.nan)
    for b in np.unique(histogram[:, 0]) if len(histogram) else []:
        rows = histogram[histogram[:, 0] == b]
        p = np.stack([np.where(rows[:, k] == NONE, 0, 2.0 ** (rows[:, k] / STEP)) for k in (1, 2)] + [np.full(len(rows), 1 / (kinds + 1))], 1)
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            new = rows[:, 3] @ share / rows[:, 3].sum()
            done = np.abs(new - w).max() < 1e-9
            w = new
            if done:
                break
        w[1:] = np.maximum(w[1:], least)
        weights[int(b)] = w / w.sum()
    last = np.full(3, 1 / 3)
    seen = np.flatnonzero(~np.isnan(weights[:, 0]))
    if len(seen):
        last = weights[seen[0]]
    for b in range(BUCKETS):
        if np.isnan(weights[b, 0]):
            weights[b] = last
        last = weights[b]
    return weights


def _scores(total: int, kinds: int, weights: np.ndarray):
    def run(packed: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = [pa.int64()] * 4 + [pa.float64()] * 2
        if not packed.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        c = _Counted(packed, replies, "counts")
        b, p2, p1 = c.estimates(total)
        w = weights[b]
        score = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (kinds + 1))
        base = np.log10((c.token + 0.5) / (total + 0.5 * (kinds + 1)))
        at = c.borders[:-1]
        ids = packed.column("doc_ids")[0].values
        columns = [ids, np.diff(c.borders), np.add.reduceat((c.token > 0).astype(np.int64), at), np.full(len(at), total), np.add.reduceat(base, at), np.add.reduceat(score, at)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    return run


def split_role(doc_id: int | None, folds: int, fold: int, held_part: int = 10) -> int:
    """Whether a document is only scored, counted, or counted and held out for the weights."""
    text = b"" if doc_id is None else str(doc_id).encode()
    if folds and zlib.crc32(text) % folds == fold:
        return SCORED
    return HELD if zlib.crc32(text + b":held") % held_part == 0 else TRAIN


def score_texts(docs: DataFrame, *, folds: int = 0, fold: int = 0, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    All documents train, except those whose id's crc32 is ``fold`` modulo ``folds``.
    A null or empty text is its end token alone.  A null id counts as an empty one
    for the split.  Repeated rows are counted and returned each.  Without training
    texts every estimate but the uniform one is zero.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    packed = scratch.keep(exchange.pack(docs, chunk_bytes, lambda d: split_role(d, folds, fold)), "packed", compression="zstd")
    size = packed.agg(F.sum("n_bytes")).first()[0] or 0
    asked = packed.mapInArrow(_requests(exchange.bucket_count(size)), _REQUEST)
    replies = scratch.keep(asked.groupBy("bucket").applyInArrow(_answer, _REPLY), "replies")
    total, kinds, total_left, kinds_left = (x or 0 for x in replies.where("chunk = -1").agg(*(F.sum(c) for c in ("total", "kinds", "total_left", "kinds_left"))).first())
    held = packed.where(F.col("role") == HELD).groupBy("chunk").cogroup(replies.where(F.col("role") == HELD).groupBy("chunk"))
    counted = held.applyInArrow(_histogram(total_left), "bucket bigint, bigram bigint, unigram bigint, n bigint")
    rows = counted.groupBy("bucket", "bigram", "unigram").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4), kinds_left)
    answered = packed.groupBy("chunk").cogroup(replies.where("chunk >= 0").groupBy("chunk"))
    return answered.applyInArrow(_scores(total, kinds, weights), "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
