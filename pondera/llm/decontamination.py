"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds all sub-sequences of the normalised test items' words.
Documents are streamed through it: at every word the state is the longest run
of words ending there that occurs in some item, up to a window's length: where it
gets longer, it goes on from the state of its last window, so that a word costs a
bounded number of steps on the most repetitive text too.  Where the run has a
window's length, the window's words are hit.  Before streaming, words and neighbouring
pairs of words that occur in no item are ruled out by array lookups, which
leaves short stretches to the automaton.

Items' distinct texts are dealt to groups of about ``group_bytes`` or one text, and a
task builds the automaton of each.  Automata are broadcast one after another, so
one is held at a time.  Texts of documents are not shuffled, unless there are several
groups, whose marks are then joined to the documents.
"""

from __future__ import annotations

import functools
import pickle
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pondera.llm import textkit
from pondera.plans.scratch import Scratch


class SuffixAutomaton:
    """All runs of symbols of several sequences, as states with suffix links.

    Flat arrays: most states have one way out, held in ``symbol`` and ``to``; only
    further ones are in ``more``.  About 50 bytes for each symbol added.
    """

    def __init__(self) -> None:
        self.symbol, self.to, self.link, self.size = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}

    def step(self, state: int, c: int) -> int:
        """Where a symbol leads, or -1."""
        if self.symbol[state] == c:
            return self.to[state]
        more = self.more.get(state)
        return more.get(c, -1) if more else -1

    def _lead(self, state: int, c: int, target: int) -> None:
        if self.symbol[state] in (c, -1):
            self.symbol[state], self.to[state] = c, target
        else:
            self.more.setdefault(state, {})[c] = target

    def _state(self, size: int, link: int) -> int:
        self.symbol.append(-1)
        self.to.append(-1)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """Give the shorter runs of q, those that follow p, a state of their own."""
        if self.size[q] == self.size[p] + 1:
            return q
        new = self._state(self.size[p] + 1, self.link[q])
        self.symbol[new], self.to[new] = self.symbol[q], self.to[q]
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p >= 0 and self.step(p, c) == q:
            self._lead(p, c, new)
            p = self.link[p]
        return new

    def add(self, sequence: Iterable[int]) -> None:
        """Add a sequence."""
        last = 0
        for c in sequence:
            q = self.step(last, c)
            if q >= 0:
                last = self._split(last, c, q)
                continue
            new, p = self._state(self.size[last] + 1, 0), last
            while p >= 0 and (q := self.step(p, c)) < 0:
                self._lead(p, c, new)
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, q)
            last = new


def _nearest(link: np.ndarray, good: np.ndarray) -> np.ndarray:
    """For each state itself or the nearest state on its way along the links that is good, or 0: by pointer jumping."""
    to = np.where(good, np.arange(len(link)), np.maximum(link, 0))
    while True:
        on = to[to]
        if (on == to).all():
            return to
        to = on


@dataclass
class Items:
    """An automaton of items and what its states say about windows.

    ``top`` has, for the states of at least a window's words, the state of their last window.
    ``owners`` are the items (places in ``ids``) of the window states, ``owned`` the
    sorted states, each repeated for each of its items.  ``short`` has states of
    whole items below the window's length, ``below`` the nearest of those from every state.
    """

    window: int
    vocabulary: np.ndarray
    pairs: np.ndarray
    shortest: int
    automaton: SuffixAutomaton
    ids: list[list[str]]
    top: array
    owned: np.ndarray
    owners: np.ndarray
    short: dict[int, list[tuple[int, int]]]
    below: array


def build(items: dict[str, list[str]], window: int) -> Items | None:
    """Automaton of texts with their items' ids; None if no text has a word.  Linear in the texts."""
    names, borders = textkit.words(pa.array(list(items), pa.large_string()), textkit.ALNUM)
    if not len(names):
        return None
    vocabulary, codes = np.unique(names, return_inverse=True)
    lens = np.diff(borders)
    joined = np.ones(max(len(codes) - 1, 0), bool)
    cuts = borders[1:-1]
    joined[cuts[(cuts > 0) & (cuts < len(codes))] - 1] = False
    pairs = np.unique(codes[:-1][joined] * np.int64(len(vocabulary)) + codes[1:][joined])
    auto = SuffixAutomaton()
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        auto.add(codes[a:b].tolist())
    link, size = np.frombuffer(auto.link, np.int32), np.frombuffer(auto.size, np.int32)
    top = _nearest(link, (size < window) | (size[link] < window))
    owned, owners, short = array("i"), array("i"), {}
    for k, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):  # states are final now
        state = 0
        for n, c in enumerate(codes[a:b].tolist(), 1):
            state = auto.step(state, c)
            if n >= window:
                owned.append(int(top[state]))
                owners.append(k)
        if 0 < b - a < window:
            short.setdefault(state, []).append((b - a, k))
    whole = np.zeros(len(link), bool)
    whole[list(short)] = True
    below = _nearest(link, whole)
    both = np.unique(np.frombuffer(owned, np.int32).astype(np.int64) << 32 | np.frombuffer(owners, np.int32))
    return Items(window, vocabulary, pairs, min(window, int(lens[lens > 0].min())), auto, list(items.values()), array("i", top.astype(np.int32).tobytes()), (both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32), short, array("i", below.astype(np.int32).tobytes()))


def scan(items: Items, names: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
    """Marks of hit words, and the items (places) with an occurring window by row."""
    hit, found = np.zeros(len(names), bool), {}
    if not len(names):
        return hit, found
    at = np.minimum(np.searchsorted(items.vocabulary, names), len(items.vocabulary) - 1)
    known = items.vocabulary[at] == names
    joined = known[1:] & known[:-1]
    cuts = borders[1:-1]
    joined[cuts[(cuts > 0) & (cuts < len(names))] - 1] = False
    where = np.flatnonzero(joined)
    key = at[where] * np.int64(len(items.vocabulary)) + at[where + 1]
    place = np.minimum(np.searchsorted(items.pairs, key), max(len(items.pairs) - 1, 0))
    joined[where] = items.pairs[place] == key if len(items.pairs) else False
    first = known.copy()
    first[1:] &= ~joined
    last = known.copy()
    last[:-1] &= ~joined
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    enough = ends - begins >= items.shortest
    begins, ends = begins[enough], ends[enough]
    rows = np.searchsorted(borders, begins, side="right") - 1
    auto, window, short = items.automaton, items.window, items.short
    symbol, to, more, link, size, top, below = auto.symbol, auto.to, auto.more, auto.link, auto.size, items.top, items.below
    none: dict[int, int] = {}
    ends_: list[int] = []
    for b, e, row in zip(begins.tolist(), ends.tolist(), rows.tolist(), strict=True):
        state = run = 0
        windows = set()
        for i, c in enumerate(at[b:e].tolist(), b):
            while True:
                q = to[state] if symbol[state] == c else more.get(state, none).get(c, -1)
                if q >= 0:
                    state, run = q, run + 1
                    break
                if not state:
                    break
                state = link[state]
                run = size[state]
            if run >= window:
                state, run = top[state], window
                windows.add(state)
                ends_.append(i)
            if short:
                p = below[state]
                while p:
                    for n, item in short[p]:
                        if n <= run:
                            hit[i - n + 1 : i + 1] = True
                            found.setdefault(row, set()).add(item)
                    p = below[link[p]]
        for p in windows:
            a, z = np.searchsorted(items.owned, [p, p + 1])
            found.setdefault(row, set()).update(items.owners[a:z].tolist())
    if ends_:
        covers = np.zeros(len(hit) + 1, np.int64)
        np.add.at(covers, np.array(ends_) - window + 1, 1)
        np.add.at(covers, np.array(ends_) + 1, -1)
        hit |= np.cumsum(covers[:-1]) > 0
    return hit, found


def _spans(hit: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _automata(items: DataFrame, window: int, group_bytes: int) -> DataFrame:
    """``items, automaton``: pickled automata of groups of the distinct item texts, dealt by hash, each built in a task."""
    texts = items.where("text is not null").groupBy("text").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def one(group: pa.Table) -> pa.Table:
        held = dict(zip(group.column("text").to_pylist(), group.column("ids").to_pylist(), strict=True))
        return pa.table([pa.array([len(held)], pa.int64()), pa.array([pickle.dumps(build(held, window))], pa.binary())], ["items", "automaton"])

    dealt = texts.withColumn("group", F.pmod(F.xxhash64("text"), F.lit(max(1, -(-size // group_bytes)))))
    return dealt.groupBy("group").applyInArrow(one, "items bigint, automaton binary")


def matches(docs: DataFrame, items: DataFrame, *, window: int = 10, group_bytes: int = 8 << 20) -> DataFrame:
    """All columns of ``docs`` and ``n_words``, ``n_hit``, ``hit_items`` (distinct item ids as text, sorted), ``hit_spans``.

    ``hit_spans`` are ``start, end`` byte ranges of the maximal hit runs of words in
    the UTF-8 text.  Null and empty texts have no words.  An item without words
    has no window; one with fewer than ``window`` words is a window itself.  Items
    with a null id hit words but are not listed; equal item texts are held once.
    Own columns of ``docs`` with these four names are replaced, all others are kept;
    repeated rows stay; empty tables give empty results.

    The driver and each Python worker hold one automaton, about ten bytes for
    each byte of a group's text.  With several groups the documents are written once and
    read once for each group.  A document is held whole, about 60 bytes for each byte.
    """
    textkit.bound_batches(docs.sparkSession)
    spark, docs, scratch = docs.sparkSession, docs.drop("n_words", "n_hit", "hit_items", "hit_spans"), Scratch(docs.sparkSession, "decontaminate")
    groups = scratch.keep(_automata(items, window, group_bytes), "automata", **{"parquet.block.size": str(16 << 20)})
    found = "n_words bigint, n_hit bigint, hit_items array<string>, hit_spans array<bigint>"
    n = groups.select("items").count()
    if n < 2:
        one = groups.first() if n else None
        return textkit.beside(docs, _find(spark.sparkContext.broadcast(pickle.loads(one["automaton"]) if one else None)), found)
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "rows", compression="zstd")
    texts, marked = rows.select("uid", F.col("row.text").alias("text")), []
    for k, group in enumerate(groups.toLocalIterator()):
        shared = spark.sparkContext.broadcast(pickle.loads(group["automaton"]))
        marked.append(scratch.keep(texts.mapInArrow(textkit.lean(_mark(shared)), "uid bigint, marks binary, items array<string>"), f"marks{k}"))
        shared.destroy()
    marked = functools.reduce(DataFrame.unionByName, marked)
    marked = marked.groupBy("uid").agg(F.collect_list("marks").alias("marks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    kind = StructType([StructField("row", docs.schema), *StructType.fromDDL(found)])
    rows = rows.join(marked, "uid", "left").select("row", "marks", "items").mapInArrow(textkit.lean(_merge), kind)
    return rows.select("row.*", "n_words", "n_hit", "hit_items", "hit_spans")


def _hits(items: Items | None, text: pa.Array) -> tuple[list[np.ndarray | None], list[list[str]]]:
    """Each row's marks of hit words, if it has any, and its items' ids."""
    n = len(text)
    marks: list[np.ndarray | None] = [None] * n
    ids: list[list[str]] = [[]] * n
    if items is not None:
        names, borders = textkit.words(text, textkit.ALNUM)
        hit, found = scan(items, names, borders)
        for row in np.unique(np.searchsorted(borders, np.flatnonzero(hit), side="right") - 1).tolist():
            marks[row] = hit[borders[row] : borders[row + 1]]
            ids[row] = sorted({i for k in found[row] for i in items.ids[k]})
    return marks, ids


def _summary(batch: pa.RecordBatch, marks: list[np.ndarray | None], ids: list[list[str]]) -> pa.RecordBatch:
    data, offsets = textkit.utf8(textkit.field(batch, "text"))
    starts, ends = textkit.word_bounds(data, offsets, textkit.ALNUM)
    borders = np.searchsorted(starts, offsets)
    n_hit, spans = [0] * len(marks), [[]] * len(marks)
    for k, hit in enumerate(marks):
        if hit is not None:
            runs = _spans(hit)
            n_hit[k] = int(hit.sum())
            spans[k] = (np.stack([starts[borders[k] + runs[:, 0]], ends[borders[k] + runs[:, 1] - 1]], 1) - offsets[k]).ravel().tolist()
    found = [pa.array(np.diff(borders), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([batch.column("row"), *found], ["row", "n_words", "n_hit", "hit_items", "hit_spans"])


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _summary(batch, *_hits(shared.value, textkit.field(batch, "text")))

    return run


def _mark(shared):
    """The rows that one group of items hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, ids = _hits(shared.value, batch.column("text"))
            rows = [k for k, hit in enumerate(marks) if hit is not None]
            columns = [batch.column("uid").take(pa.array(rows, pa.int64())), pa.array([np.packbits(marks[k]).tobytes() for k in rows], pa.binary()), pa.array([ids[k] for k in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "marks", "items"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, borders = textkit.words(textkit.field(batch, "text"), textkit.ALNUM)
        marks = [None if not m else np.bitwise_or.reduce([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x in m]).astype(bool) for m, n in zip(batch.column("marks").to_pylist(), np.diff(borders).tolist(), strict=True)]
        yield _summary(batch, marks, [x or [] for x in batch.column("items").to_pylist()])


def items_digest(ids):
    """Hex SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(ids), ","), 256)


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, max_words: int = 0, max_coverage: float = 0.0) -> DataFrame:
    """Documents without benchmark passages, with their own columns.

    A document goes when over ``max_words`` of its words are hit or over
    ``max_coverage`` of them (with the defaults, at any hit).  Null and empty texts stay,
    as do repeated rows.  ``remove_spans`` takes the passages out instead.
    """
    found = matches(docs, items, window=window)
    kept = found.where((F.col("n_hit") <= max_words) & (F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words")))
    return kept.select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def remove_spans(docs: DataFrame, items: DataFrame, *, window: int = 10, max_words: int = 0, max_coverage: float = 0.0) -> DataFrame:
    """All documents, without the matching spans that exceed a limit.

    A span, a maximal run of hit words, is cut out when it has over ``max_words`` words, and
    every span of a document is when over ``max_coverage`` of its words are hit.  What stands
    between words stays on both sides of a cut; a text may become empty.  Null and
    empty texts and rows without a hit stay as they are, as do repeated rows and other columns.
    """
    names = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    found = matches(docs, items, window=window)
    rows = found.select(F.struct(*names).alias("row"), F.when(F.col("n_hit") > 0, F.col("hit_spans")).alias("hit_spans"), (F.col("n_hit") > F.lit(max_coverage) * F.col("n_words")).alias("dense"))
    return rows.mapInArrow(textkit.lean(_cut(max_words)), StructType([rows.schema["row"]])).select("row.*")


def _cut(max_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans, dense in zip(textkit.field(batch, "text").to_pylist(), batch.column("hit_spans").to_pylist(), batch.column("dense").to_pylist(), strict=True):
                if spans:
                    raw = text.encode()
                    long = [(a, b) for a, b in zip(spans[::2], spans[1::2], strict=True) if dense or _words(raw[a:b]) > max_words]
                    at = [0, *(x for span in long for x in span), len(raw)]
                    text = b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True)).decode()
                texts.append(text)
            row = batch.column("row")
            columns, names = row.flatten(), [f.name for f in row.type]
            columns[names.index("text")] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, names)], ["row"])

    return run


def _words(raw: bytes) -> int:
    data = np.frombuffer(raw, np.uint8)
    return len(textkit.word_bounds(data, np.array([0, len(data)]), textkit.ALNUM)[0])
