"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

Sorting every byte position at every doubling would shuffle over a hundred times
the input, so positions are sampled by content: of every ``length``-byte string,
the smallest (by a mixing order, the first of equals) of its ``BASE``-byte
substrings is its anchor.  Equal strings have equal anchors at the same place, and
one position in about seventeen is one.  Then, with ``n`` anchors to a chain:

1. Spark sorts anchors by their own bytes and ranks them.  An anchor whose bytes are
   in one document only is settled: none of its strings repeats.
2. Chains double.  At offsets of 1, 2, 4 ... anchors Spark sorts the pairs (rank of
   a chain, rank of the chain that follows it, the bytes in between) and ranks them
   anew.  A pair in one document only is settled as unique; a chain that is at
   least ``length`` bytes long is settled as past the threshold, and if it is in an
   earlier document, all its bytes go.
3. What is left are strings at the edges of repeats, which no such chain holds.  For
   each anchor that is in several documents, the bytes around it that these
   strings reach are grouped by the anchor's rank, and the strings themselves are
   sorted and compared.  A rank with very many surroundings is dealt out by string.

Ranks number distinct keys in the order of a sorted partition, one partition after
the other; a key is compared as whole bytes, so no hash decides anything.  A chunk
of texts sends each distinct key once, so a passage that is in a third of all
documents costs a row for each chunk, and rows grow with the input, not faster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondera.llm import exchange, textkit
from pondera.plans.scratch import Scratch

BASE = 16
_BLOCK = 1 << 19
_PLACES = np.uint64((1 << 20) - 1)
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_HEAD = 4
#: Rows of an Arrow batch of keys.
_ROWS = 1 << 16
_PACKED = "chunk bigint, doc_ids array<bigint>, offsets array<bigint>, data binary, anchors binary"
_STATE = "chunk bigint, body binary, cover binary"
_NOTES = "chunk bigint, kind int, x binary"
ALIVE, COVER, HITS, LATER = 0, 1, 2, 3


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(raw: bytes | pa.Buffer, kind: np.dtype | type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _slide(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w entries, by doubling."""
    h = 1
    while 2 * h <= w:
        x = np.minimum(x[: len(x) - h], x[h:])
        h *= 2
    return np.minimum(x[: len(x) - (w - h)], x[w - h :]) if w > h else x


def find_anchors(data: np.ndarray, offsets: np.ndarray, live: np.ndarray, length: int) -> np.ndarray:
    """``first, count, at``: runs of strings with one anchor, by the first string's begin, their number and the anchor's place."""
    n, w = len(data), length - BASE + 1
    whole = np.flatnonzero(live & (np.diff(offsets) >= length))
    valid = np.zeros(n + 1, np.int8)
    valid[offsets[whole]] += 1
    valid[offsets[whole + 1] - length + 1] -= 1
    valid = np.cumsum(valid, dtype=np.int8)[:n] > 0
    found = [np.zeros((3, 0), np.int64)]
    for s in range(0, n, _BLOCK):
        e = min(n, s + _BLOCK)
        here = np.flatnonzero(valid[s:e])
        if not len(here):
            continue
        m = e - s + w - 1
        x = np.zeros(m + BASE, np.uint64)
        part = data[s : s + m + BASE]
        x[: len(part)] = part
        for h in (1, 2, 4):
            x = (x[: len(x) - h] << np.uint64(8 * h)) | x[h:]
        order = textkit.mix(x[:m] * _A + x[8 : 8 + m] * _B)
        order = (order & ~_PLACES) | np.arange(m, dtype=np.uint64)
        at = (_slide(order, w) & _PLACES).astype(np.int64)[here]
        new = np.ones(len(here), bool)
        new[1:] = (at[1:] != at[:-1]) | (here[1:] != here[:-1] + 1)
        first = np.flatnonzero(new)
        found.append(np.stack([here[first] + s, np.diff(np.append(first, len(here))), at[first] + s]))
    runs = np.concatenate(found, axis=1)
    if not runs.shape[1]:
        return runs
    same = (runs[2, 1:] == runs[2, :-1]) & (runs[0, 1:] == runs[0, :-1] + runs[1, :-1])  # a run that a block's end cut
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    return np.stack([runs[0, starts], np.add.reduceat(runs[1], starts), runs[2, starts]])


def _name(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row; with the other columns it tells the first, so it can take its place."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in reversed(columns):
        out = textkit.mix(out ^ c.view(np.uint64))
    return out.view(np.int64)


def _borders(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class _Groups:
    """Rows grouped by equal values in all columns.

    They are sorted by one number; should different rows share one, by all columns.
    """

    def __init__(self, columns: list[np.ndarray]):
        name = _name(columns)
        self.order = np.argsort(name, kind="stable")
        name, ordered = name[self.order], [c[self.order] for c in columns]
        new = _borders(ordered)
        if (new[1:] & (name[1:] == name[:-1])).any():
            self.order = np.lexsort(columns[::-1])
            new = _borders([c[self.order] for c in columns])
        self.starts = np.flatnonzero(new)
        self.group = np.empty(len(new), np.int64)
        self.group[self.order] = np.cumsum(new) - 1

    def low(self, values: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(values[self.order], self.starts) if len(self.starts) else values

    def high(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values[self.order], self.starts) if len(self.starts) else values


class _Chunk:
    """Texts with their anchors."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.chunk = batch.column("chunk")[i].as_py()
        ids = batch.column("doc_ids")[i].values
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.offsets = batch.column("offsets")[i].values.to_numpy(zero_copy_only=False)
        self.data = _unpack(batch.column("data")[i].as_buffer(), np.uint8)
        runs = _unpack(batch.column("anchors")[i].as_buffer(), np.int32).reshape(3, -1).astype(np.int64)
        self.first, self.count, self.at = np.cumsum(runs[0]), runs[1], np.cumsum(runs[0]) + runs[2]
        self.row = np.searchsorted(self.offsets, self.at, side="right") - 1
        self.doc = self.ids[self.row] if len(self.row) else np.zeros(0, np.int64)

    def own_bytes(self) -> list[np.ndarray]:
        words = np.lib.stride_tricks.sliding_window_view(self.data, BASE)[self.at].view(np.int64) if len(self.at) else np.zeros((0, 2), np.int64)
        return [np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])]

    def bridges(self, words: int, which: np.ndarray) -> np.ndarray:
        """How far the next anchor of the text is (0: there is none), and the bytes in between that neither has."""
        gap = np.zeros(len(self.at), np.int64)
        gap[:-1] = np.where(self.row[1:] == self.row[:-1], np.diff(self.at), 0)
        gap = gap[which]
        out = np.zeros((len(which), 8 * words), np.uint8)
        out[:, :2] = gap.astype("<u2").view(np.uint8).reshape(-1, 2)
        far = np.flatnonzero(gap > BASE)
        k = np.arange(8 * words - 2)
        where = np.minimum(self.at[which[far], None] + BASE + k, max(len(self.data) - 1, 0))
        out[far, 2:] = np.where(k < gap[far, None] - BASE, self.data[where], 0)
        return out.view(np.int64)


def _words(length: int) -> int:
    return -(-(2 + max(0, length - 2 * BASE + 1)) // 8)


#: What stays of the anchors that several documents have.
_ALIVE_TYPE = np.dtype([("index", "i4"), ("rank", "i8"), ("lower", "i1")])


_REPLY = np.dtype([("id", "i4"), ("rank", "i8"), ("lower", "i1")])
_HIT = np.dtype([("cid", ">i4"), ("place", ">u2")])


def _by_chunk(chunk: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Distinct chunks and each one's rows as bytes."""
    order = np.argsort(chunk, kind="stable")
    chunk, rows = chunk[order], np.ascontiguousarray(rows[order])
    cuts = np.flatnonzero(np.concatenate([np.ones(min(len(chunk), 1), bool), chunk[1:] != chunk[:-1]]))
    offsets = (np.append(cuts, len(chunk)) * rows.itemsize).astype(np.int32)
    return pa.array(chunk[cuts]), pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _joined(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _state_type(length: int) -> np.dtype:
    return np.dtype([("index", "i4"), ("at", "i4"), ("row", "i4"), ("span", "i4"), ("doc", "i8"), ("rank", "i8"), ("lower", "i1"), ("bridge", "i8", (_words(length),))])


# ---- sorting and ranking

def _requests(keys: int) -> str:
    return ", ".join(f"k{i} bigint" for i in range(keys)) + ", chunk bigint, id int, low bigint"


def _ask(chunk: int, columns: list[np.ndarray], doc: np.ndarray) -> pa.RecordBatch:
    """Each distinct key of a chunk with its smallest document; ``id`` is twice its number, and one more if several documents have it.

    The first column is replaced by the key's name, by which Spark sorts.
    """
    g = _Groups(columns)
    rep, low = g.order[g.starts], g.low(doc)
    number = 2 * np.arange(len(rep)) + (g.high(doc) > low)
    arrays = [*(pa.array(c[rep]) for c in (_name(columns), *columns[1:])), pa.array(np.full(len(rep), chunk)), pa.array(number.astype(np.int32)), pa.array(low)]
    return pa.RecordBatch.from_arrays(arrays, [*(f"k{i}" for i in range(len(columns))), "chunk", "id", "low"])


def _rank(keys: list[str], level: int):
    """Rank keys sorted by name; those of one document are settled and dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = level << 58 | TaskContext.get().partitionId() << 36
        for t in textkit.whole_groups(batches, keys[:1]):
            columns = [t.column(k).to_numpy() for k in keys]
            new = _borders(columns)
            if (new[1:] & (columns[0][1:] == columns[0][:-1])).any():  # different keys of one name may be mixed up
                order = np.lexsort(columns[::-1])
                t, new = t.take(pa.array(order)), _borders([c[order] for c in columns])
            starts, group = np.flatnonzero(new), np.cumsum(new) - 1
            number, low = t.column("id").to_numpy(), t.column("low").to_numpy()
            first = np.minimum.reduceat(low, starts)
            shared = (first < np.maximum.reduceat(low, starts)) | (np.maximum.reduceat(number & 1, starts) > 0)
            keep = np.flatnonzero(shared[group])
            own, out = group[keep], np.empty(len(keep), _REPLY)
            out["id"], out["rank"], out["lower"] = number[keep] >> 1, base + own, low[keep] > first[own]
            yield pa.RecordBatch.from_arrays([*_by_chunk(t.column("chunk").to_numpy()[keep], out)], ["chunk", "body"])
            base += len(starts)

    return run


def _ranked(asked: DataFrame, keys: list[str], level: int) -> DataFrame:
    return asked.repartition(keys[0]).sortWithinPartitions(keys[0]).mapInArrow(textkit.lean(_rank(keys, level)), "chunk bigint, body binary")


def _replies(replies: pa.Table, g: _Groups, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's rank, or -1, and whether its key is in a smaller document."""
    rank, lower = np.full(len(g.starts), -1), np.zeros(len(g.starts), bool)
    got = _joined(replies.column("body").to_pylist(), _REPLY)
    rank[got["id"]], lower[got["id"]] = got["rank"], got["lower"] > 0
    return rank[g.group], lower[g.group] | (doc > g.low(doc)[g.group])


# ---- chunks

def _prepare(length: int):
    """A packed chunk, compressed and with its anchors."""

    def finish(b: pa.RecordBatch) -> pa.RecordBatch:
        data = np.frombuffer(b.column("data")[0].as_buffer(), np.uint8)
        ids, offsets = b.column("doc_ids")[0].values, b.column("offsets")[0].values.to_numpy(zero_copy_only=False)
        runs = find_anchors(data, offsets, np.asarray(ids.is_valid()), length)
        runs = np.stack([np.diff(runs[0], prepend=0), runs[1], runs[2] - runs[0]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.column("chunk"), b.column("doc_ids"), b.column("offsets"), pa.array([_pack(data)]), pa.array([_pack(runs)])], ["chunk", "doc_ids", "offsets", "data", "anchors"])

    return finish


def _ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            c = _Chunk(batch, i)
            yield _ask(c.chunk, c.own_bytes(), c.doc)


def _states(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    columns = [[r[0] for r in rows], [_pack(r[1]) for r in rows], [_pack(r[2]) for r in rows]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["chunk", "body", "cover"])


def _begin(length: int):
    """The anchors that several documents have, as chains of one; ``cover`` has them without what only chains need."""

    def run(packed: pa.Table, replies: pa.Table) -> pa.Table:
        if not packed.num_rows or not replies.num_rows:
            return _states([])
        c = _Chunk(packed.combine_chunks().to_batches()[0], 0)
        rank, lower = _replies(replies, _Groups(c.own_bytes()), c.doc)
        alive = np.flatnonzero(rank >= 0)
        out = np.zeros(len(alive), _state_type(length))
        for name, values in (("index", alive), ("at", c.at[alive]), ("row", c.row[alive]), ("span", BASE), ("doc", c.doc[alive]), ("rank", rank[alive]), ("lower", lower[alive]), ("bridge", c.bridges(_words(length), alive))):
            out[name] = values
        slim = np.zeros(len(alive), _ALIVE_TYPE)
        for name in _ALIVE_TYPE.names:
            slim[name] = out[name]
        return _states([(c.chunk, out, slim)])

    return run


def _pairs(s: np.ndarray, step: int, length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Chains below the threshold, the chains that follow them, and the columns of their pairs."""
    j = np.searchsorted(s["index"], s["index"] + step)
    near = np.minimum(j, len(s) - 1)
    ok = (s["index"][near] == s["index"] + step) & (s["row"][near] == s["row"]) & (s["span"] < length) & (s["bridge"][:, 0] != 0) if len(s) else np.zeros(0, bool)
    i = np.flatnonzero(ok)
    j = near[i]
    return i, j, [s["rank"][i], s["rank"][j], *(np.ascontiguousarray(s["bridge"][i, k]) for k in range(s["bridge"].shape[1]))]


def _ask_pairs(step: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                s = _unpack(body.as_buffer(), _state_type(length))
                i, _, columns = _pairs(s, step, length)
                yield _ask(chunk, columns, s["doc"][i])

    return run


def _extend(step: int, length: int):
    """Chains that are still shared, doubled; those past the threshold stay as they are and cover their bytes."""

    def run(states: pa.Table, replies: pa.Table) -> pa.Table:
        if not states.num_rows:
            return _states([])
        s = _unpack(states.column("body")[0].as_buffer(), _state_type(length))
        i, j, columns = _pairs(s, step, length)
        rank, lower = _replies(replies, _Groups(columns), s["doc"][i])
        i, j, rank, lower = (x[rank >= 0] for x in (i, j, rank, lower))
        grown = s[i].copy()
        grown["span"] = s["at"][j] + s["span"][j] - s["at"][i]
        grown["rank"], grown["lower"], grown["bridge"] = rank, lower, s["bridge"][j]
        done = grown[(grown["span"] >= length) & (grown["lower"] > 0)]
        out = np.concatenate([s[s["span"] >= length], grown])
        return _states([(states.column("chunk")[0].as_py(), out[np.argsort(out["index"], kind="stable")], np.stack([done["at"], done["at"] + done["span"]]))])

    return run


# ---- strings at edges

class _Edges:
    """The surroundings of a chunk's shared anchors that have strings which no covering chain holds; equal ones are one."""

    def __init__(self, c: _Chunk, notes: pa.Table, length: int):
        kinds = notes.column("kind").to_numpy()
        blobs = notes.column("x").to_pylist()
        s = np.concatenate([np.zeros(0, _ALIVE_TYPE), *(_unpack(b, _ALIVE_TYPE) for b, k in zip(blobs, kinds, strict=True) if k == ALIVE)])
        self.depth, reach = np.zeros(len(c.data) + 1, np.int32), np.zeros(len(c.data) + 1, np.int32)
        for b, k in zip(blobs, kinds, strict=True):
            if k == COVER:
                lo, hi = _unpack(b, np.int32).reshape(2, -1)
                np.add.at(self.depth, lo, 1)
                np.add.at(self.depth, hi, -1)
                np.maximum.at(reach, lo, hi)
        reach = np.maximum.accumulate(reach)
        first, count = c.first[s["index"]], c.count[s["index"]]
        starts = np.concatenate([[0], np.cumsum(count)])
        begin = np.arange(starts[-1]) - np.repeat(starts[:-1] - first, count)
        open_ = reach[begin] < begin + length  # a string that chains only cover in parts may be new itself
        big = np.int64(1) << 60
        lo = np.minimum.reduceat(np.where(open_, begin, big), starts[:-1]) if len(s) else first
        hi = np.maximum.reduceat(np.where(open_, begin, -1), starts[:-1]) if len(s) else first
        some = np.flatnonzero(hi >= 0)
        self.lo, self.hi, self.doc, self.lower, rank = lo[some], hi[some], c.doc[s["index"]][some], s["lower"][some] > 0, s["rank"][some]
        self.rank, self.head = rank, np.stack([c.at[s["index"]][some] - self.lo, self.hi - self.lo + 1], 1).astype("<u2")
        self.data, self.end = c.data.tobytes(), self.hi + length
        self.cid, self.reps = self._same(c.data)
        self.low = np.full(len(self.reps), big)
        np.minimum.at(self.low, self.cid, self.doc)
        self.asked = np.zeros(len(self.reps), bool)  # whether the smallest document here has the anchor from a smaller one
        np.logical_or.at(self.asked, self.cid, self.lower & (self.doc == self.low[self.cid]))

    def _same(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each one's number, and for each number one that has it; equal rank, head and sampled bytes are compared in full."""
        if not len(self.lo):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = np.lib.stride_tricks.sliding_window_view(data, 8)
        sample = [np.ascontiguousarray(words[at]).view(np.int64).ravel() for at in (self.lo, (self.lo + self.end - 8) // 2, self.end - 8)]
        g = _Groups([self.rank, self.head.astype(np.int64) @ np.array([1, 1 << 16]), *sample])
        rep = g.order[g.starts]
        cid, reps = g.group.copy(), rep.tolist()
        for k in np.flatnonzero(rep[g.group] != np.arange(len(cid))).tolist():
            r = reps[cid[k]]
            if self.data[self.lo[k] : self.end[k]] != self.data[self.lo[r] : self.end[r]]:
                cid[k] = len(reps)
                reps.append(k)
        return cid, np.array(reps, np.int64)

    def around(self) -> pa.Array:
        """Head and bytes of each number."""
        lo, end = self.lo[self.reps], self.end[self.reps]
        offsets = np.concatenate([[0], np.cumsum(end - lo + _HEAD)]).astype(np.int32)
        joined = b"".join([x for h, a, b in zip(self.head[self.reps], lo.tolist(), end.tolist(), strict=True) for x in (h.tobytes(), self.data[a:b])])
        return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])

    def covered(self, notes: pa.Table, length: int) -> np.ndarray:
        """Marks of all bytes that go."""
        later = self.doc > self.low[self.cid]  # the smaller document is in this chunk: all strings repeat
        hits = _joined([x for x, k in zip(notes.column("x").to_pylist(), notes.column("kind").to_pylist(), strict=True) if k == HITS], _HIT)
        of, places = hits["cid"].astype(np.int64), hits["place"].astype(np.int64)
        order = np.argsort(of, kind="stable")
        of, places = of[order], places[order]
        own = np.flatnonzero(~later)
        first = np.searchsorted(of, self.cid[own])
        n = np.searchsorted(of, self.cid[own], side="right") - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(own) else np.zeros(0, np.int64)
        begin = np.repeat(self.lo[own], n) + places[at]
        for lo, hi in ((begin, begin + length), (self.lo[later], self.hi[later] + length)):
            np.add.at(self.depth, lo, 1)
            np.add.at(self.depth, hi, -1)
        return np.cumsum(self.depth[:-1], dtype=np.int32) > 0


_EDGES = "rank bigint, around binary, low bigint, chunk bigint, cid int, asked boolean"


def _ask_edges(length: int):
    def run(packed: pa.Table, notes: pa.Table) -> pa.Table:
        columns: list = [[]] * 6
        if packed.num_rows and notes.num_rows:
            c = _Chunk(packed.combine_chunks().to_batches()[0], 0)
            e = _Edges(c, notes, length)
            n = len(e.reps)
            columns = [e.rank[e.reps], e.around(), e.low, np.full(n, c.chunk), np.arange(n, dtype=np.int32), e.asked]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _EDGES.split(", ")])

    return run


def _compare(t: pa.Table, length: int) -> pa.RecordBatch:
    """Which strings of each asked row are in a smaller document, by the places of their begins."""
    data, at = textkit.utf8(t.column("around"))
    n = data[at[:-1] + 2].astype(np.int64) | data[at[:-1] + 3].astype(np.int64) << 8
    starts = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(starts[-1]) - starts[row]
    words = np.zeros((len(row), -(-length // 8) * 8), np.uint8)
    words[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[at[row] + _HEAD + place]
    words = words.view(np.int64)
    low = t.column("low").to_numpy()[row]
    g = _Groups([t.column("rank").to_numpy()[row], *(np.ascontiguousarray(words[:, k]) for k in range(words.shape[1]))])
    hit = (low > g.low(low)[g.group]) & t.column("asked").to_numpy()[row]
    found = np.empty(np.count_nonzero(hit), _HIT)
    found["cid"], found["place"] = t.column("cid").to_numpy()[row[hit]], place[hit]
    chunks, x = _by_chunk(t.column("chunk").to_numpy()[row[hit]], found)
    n = len(chunks)
    nothing = [pa.nulls(n, k) for k in (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_())]
    return pa.RecordBatch.from_arrays([chunks, pa.array(np.full(n, HITS, np.int32)), x, *nothing], _COMPARED_NAMES)


_COMPARED = f"{_NOTES}, rank bigint, around binary, low bigint, cid int, asked boolean"
_COMPARED_NAMES = [x.split()[0] for x in _COMPARED.split(", ")]


def _left(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that are to be dealt out by string."""
    n = rows.num_rows
    own = [rows.column(c) for c in ("rank", "around", "low", "cid", "asked")]
    return pa.RecordBatch.from_arrays([rows.column("chunk"), pa.array(np.full(n, LATER, np.int32)), pa.nulls(n, pa.binary()), *own], _COMPARED_NAMES)


def _compare_edges(length: int, group: int, max_bytes: int = 16 << 20):
    """Strings of ranks with at most ``group`` rows (or those of one batch), compared; the rows of other ranks as they are."""

    def small(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        new = np.concatenate([[True], textkit.changes(t, ["rank"])])
        starts, of = np.flatnonzero(new), np.cumsum(new) - 1
        some = np.maximum.reduceat(t.column("asked").to_numpy(), starts) & (np.diff(np.append(starts, t.num_rows)) > 1)
        t = t.take(pa.array(np.flatnonzero(some[of]))).combine_chunks()
        if not t.num_rows:
            return
        borders = np.concatenate([[0], np.flatnonzero(textkit.changes(t, ["rank"])) + 1, [t.num_rows]])
        sizes = textkit.utf8(t.column("around"))[1][borders] * length
        i = 0
        while i < len(borders) - 1:
            j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + max_bytes, side="right")) - 1)
            yield _compare(t.slice(borders[i], borders[j] - borders[i]), length)
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # rows of the last rank so far
        last, large = None, False
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column("rank").to_numpy()
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            begin = 0
            if rank[0] == last:
                begin = cuts[1]
                if large:
                    yield _left(b.slice(0, begin))
                else:
                    rest.append(b.slice(0, begin))
                    if sum(r.num_rows for r in rest) > group:
                        yield from map(_left, rest)
                        rest, large = [], True
            if begin < len(rank):
                if rest:
                    yield from small(rest)
                if begin < cuts[-2]:
                    yield from small([b.slice(begin, cuts[-2] - begin)])
                rest, last, large = [b.slice(cuts[-2])], rank[-1], False
        if rest:
            yield from small(rest)

    return run


def _edge_hits(edges: DataFrame, length: int, group: int, scratch: Scratch) -> DataFrame:
    """``_NOTES`` of the edges' strings that are in a smaller document."""
    compared = edges.repartition("rank").sortWithinPartitions("rank").mapInArrow(textkit.lean(_compare_edges(length, group)), _COMPARED)
    compared = scratch.keep(compared, "compared", batch_rows=_ROWS, compression="zstd")
    byte = lambda i: F.conv(F.hex(F.substring("around", i, 1)), 16, 10).cast("int")
    strings = compared.where(F.col("kind") == LATER).withColumn("place", F.explode(F.sequence(F.lit(0), byte(3) + 256 * byte(4) - 1)))
    strings = strings.select("rank", F.expr(f"substring(around, place + {_HEAD + 1}, {length})").alias("string"), "low", "chunk", "cid", "asked", "place")
    first = strings.groupBy("rank", "string").agg(F.min("low").alias("first"), F.max("low").alias("last")).where("first < last").drop("last")
    hit = strings.where("asked").join(first, ["rank", "string"]).where("low > first")
    hits = compared.where(F.col("kind") == HITS).select("chunk", "kind", "x")
    return hits.unionByName(hit.select("chunk", F.lit(HITS).alias("kind"), F.unhex(F.concat(F.lpad(F.hex("cid"), 8, "0"), F.lpad(F.hex("place"), 4, "0"))).alias("x")))


def _results(length: int, with_text: bool):
    def run(packed: pa.Table, notes: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
        if not packed.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        batch = packed.combine_chunks().to_batches()[0]
        c = _Chunk(batch, 0)
        gone = _Edges(c, notes, length).covered(notes, length)
        rows = []
        for doc, a, b in zip(batch.column("doc_ids")[0].as_py(), c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True):
            cut = gone[a:b]
            kept = c.data[a:b][~cut].tobytes()
            spans = int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(b > a and cut[0])
            rows.append((doc, b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def remove_repeats(docs: DataFrame, *, length: int = 50, chunk_bytes: int = 4 << 20, group: int = 4096, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes left) for every row.

    A byte of a document is removed if a ``length``-byte string that covers it also
    starts in a document with a smaller id; strings are judged on the whole input
    and never cross documents.  A null text is empty.  Rows with a null id neither
    lose bytes nor count as smaller; rows with equal ids, repeated rows among them,
    don't affect each other.  The kept bytes of a text can end within a character.
    Ids are integers.  Other columns are ignored; an empty table gives an empty one.

    A text is handled whole: a worker holds about 30 bytes for each byte of a chunk,
    which is ``chunk_bytes`` or one longer text.
    """
    if not BASE < length <= 256:
        raise ValueError(f"length must be from {BASE + 1} to 256")
    scratch = Scratch(docs.sparkSession, "repeats")
    packed = exchange.pack(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), chunk_bytes, finish=_prepare(length), schema=_PACKED)
    packed = scratch.keep(packed, "packed", compression="none")
    ranks = scratch.keep(_ranked(packed.mapInArrow(textkit.lean(_ask_anchors), _requests(2)), ["k0", "k1"], 0), "ranks0", batch_rows=_ROWS)
    chains = scratch.keep(packed.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(_begin(length), _STATE), "chains0", batch_rows=64, compression="none")
    scratch.drop("ranks0")
    note = lambda level: scratch.keep(chains.select("chunk", F.lit(COVER if level else ALIVE).alias("kind"), F.col("cover").alias("x")), f"note{level}", compression="none")
    keys, level, notes = [f"k{i}" for i in range(2 + _words(length))], 0, note(0)
    while True:
        step = 1 << level
        asked = chains.mapInArrow(textkit.lean(_ask_pairs(step, length)), _requests(len(keys)))
        ranks = scratch.keep(_ranked(asked, keys, level + 1), f"ranks{level + 1}", batch_rows=_ROWS)
        if ranks.isEmpty():
            break
        chains = scratch.keep(chains.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(_extend(step, length), _STATE), f"chains{level + 1}", batch_rows=64, compression="none")
        scratch.drop(f"ranks{level + 1}", f"chains{level}")
        level += 1
        notes = notes.unionByName(note(level))
    scratch.drop(f"ranks{level + 1}", f"chains{level}")
    edges = packed.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(_ask_edges(length), _EDGES)
    edges = scratch.keep(edges, "edges", compression="zstd")
    hits = scratch.keep(_edge_hits(edges, length, group, scratch), "hits")
    scratch.drop("edges", "compared")
    out = packed.groupBy("chunk").cogroup(notes.unionByName(hits).groupBy("chunk"))
    kept = ", kept binary" if with_text else ""
    out = scratch.keep(out.applyInArrow(_results(length, with_text), f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{kept}"), "result")
    scratch.drop("packed", "hits", *(f"note{i}" for i in range(level + 1)))
    return out
