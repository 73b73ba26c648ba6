"""MinHash near-deduplication with odd sketches.

1. One pass over the texts gives each shingle set's size, a 128-bit name, 128
   MinHash samples folded to 32 band keys of 4, and an odd sketch: 512 parity
   bits, one flip per sample, so that the XOR of two sketches counts samples
   that differ.
2. Equal sets become one class, whatever their number or ids.  Classes are the
   nodes from here on, named by the number of one of their rows.
3. Every band key has a pivot, the class that has most classes in its keys, as
   the text has from which others were made.  Each class is compared by sketch
   with the pivots of its keys and exactly with the closest: this links most of a
   dense group by one comparison for each member.
4. A key whose classes are all connected by now is done.  The classes of other
   keys may share no more than a template.  Their shingles are put in one order, the rare
   ones first; two sets that are linked have a shingle in common among the first of
   both that are too many to miss, so only classes that share one of these meet.
   Those outside a shingle's largest part are compared by sketch with all that are in
   other parts.  Shingles are dealt out as cells, pairs of blocks of bounded size, so
   every pair meets in some task; a cell returns a spanning forest of its close
   pairs, not the pairs.
5. The forests' components are dealt out alike with their full sets, and links
   between parts are confirmed exactly, against a forest that grows in the cell.
6. Components of all confirmed links are the result.

The work of 4 and 5 is a rare shingle's classes times those outside its largest part, not
their square, unless it falls into many unconnected parts that are all close.
How rare a shingle is, is counted by a part of its name in a table of bounded size: any
order gives all links, a better one fewer meetings.

A pair of similarity 0.85 misses all 32 bands with probability 6e-11, one of 0.8
with 5e-8; the sketch distance that is let through lies over five standard
deviations above its mean at the threshold.  Thresholds under 0.8 are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondera.llm import textkit
from pondera.operators.components import connected_components, stars
from pondera.plans.scratch import Scratch, spread

SAMPLES, ROWS, BITS = 128, 4, 512
BANDS = SAMPLES // ROWS
#: Binary logarithm of the largest bitmap of nodes, 16 MB.
MAX_FILTER_BITS = 27
#: Binary logarithms of the least and largest table of counts of shingles, 4 million entries.
COUNT_BITS = (16, 22)
_FACTOR = textkit.mix(np.arange(1001, 1001 + SAMPLES, dtype=np.uint64)) | np.uint64(1)
_SHIFT = textkit.mix(np.arange(5001, 5001 + SAMPLES, dtype=np.uint64))
_PLACE = textkit.mix(np.arange(9001, 9001 + SAMPLES, dtype=np.uint64)) | np.uint64(1)


def max_distance(percent: int) -> int:
    """Differing sketch bits that a pair at the threshold exceeds about once in 10^8."""
    miss = 1 - percent / 100
    flips = 2 * (SAMPLES * miss + 5.5 * (SAMPLES * miss * (1 - miss)) ** 0.5)
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** flips)
    return int(mean + 2.5 * mean**0.5)


def minhash(names: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """SAMPLES minima for each set; sets must not be empty."""
    out = np.empty((len(borders) - 1, SAMPLES), np.uint64)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + 32768, side="right")) - 1)
        part, at = names[borders[i] : borders[j]], borders[i:j] - borders[i]
        for k in range(SAMPLES):
            out[i:j, k] = np.minimum.reduceat(part * _FACTOR[k] + _SHIFT[k], at)
        i = j
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    mixed = (samples * _PLACE).reshape(len(samples), BANDS, ROWS).sum(2, dtype=np.uint64)
    return textkit.mix(mixed + np.arange(1, BANDS + 1, dtype=np.uint64))


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """BITS / 64 words for each set: bit parities of the hashed samples."""
    bit = (textkit.mix(samples ^ _PLACE) >> np.uint64(55)).astype(np.int64)
    flips = np.bincount((np.arange(len(samples))[:, None] * BITS + bit).ravel(), minlength=len(samples) * BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(len(samples), BITS), axis=1).view(np.uint64)


def _sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    return textkit.shingle_sets(*textkit.words(column), shingle)


def _blobs(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def signatures(texts: DataFrame, shingle: int) -> DataFrame:
    """``uid, doc_id, n, h1, h2, bands, sketch`` of each text; an empty set has n = 0 and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textkit.slices(batch, "text"):
                part = batch.slice(i, j - i)
                names, borders = _sets(part.column("text"), shingle)
                n = np.diff(borders)
                full = np.flatnonzero(n > 0)
                starts = np.concatenate([borders[:-1][full], borders[-1:]])
                hashes, bands, sketch = np.zeros((len(n), 2), np.int64), np.zeros((0, BANDS), np.int64), np.zeros((len(n), BITS // 64), np.uint64)
                if len(full):
                    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)):
                        hashes[full, k] = np.add.reduceat(textkit.mix(names * np.uint64(salt)), starts[:-1]).view(np.int64)
                    samples = minhash(names, starts)
                    bands, sketch[full] = band_keys(samples).view(np.int64), odd_sketch(samples)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * BANDS)]), pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), lists, _blobs(sketch)], ["uid", "doc_id", "n", "h1", "h2", "bands", "sketch"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(textkit.lean(run), f"uid bigint, doc_id {kind}, n bigint, h1 bigint, h2 bigint, bands array<bigint>, sketch binary")


def _fixed(column: pa.Array | pa.ChunkedArray, words: int) -> np.ndarray:
    data, _ = textkit.utf8(column.cast(pa.binary()).combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return data.view(np.uint64).reshape(-1, words) if len(data) % 8 == 0 and data.ctypes.data % 8 == 0 else np.frombuffer(data.tobytes(), np.uint64).reshape(-1, words)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def _sizes_fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _shared(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as asked."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _near(limit: int, percent: int):
    """Pairs of a class and a pivot that may be linked, with their sketch distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = np.bitwise_count(_fixed(b.column("sketch"), BITS // 64) ^ _fixed(b.column("pivot_sketch"), BITS // 64)).sum(1)
            ok = (far <= limit) & _sizes_fit(b.column("n").to_numpy(), b.column("pivot_n").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([b.column("node").filter(pa.array(ok)), b.column("pivot").filter(pa.array(ok)), pa.array(far[ok], pa.int32())], ["node", "pivot", "far"])

    return run


def _pivot_links(percent: int):
    """Links of classes to their pivot, which is the first row of its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, whole = -1, np.zeros(0, np.uint64)
        for b in batches:
            found = []
            for node, own, member, raw in zip(b.column("node").to_pylist(), b.column("pivot").to_pylist(), b.column("member").to_pylist(), b.column("names"), strict=True):
                names = np.frombuffer(raw.as_buffer(), np.uint64)
                if not member:
                    pivot, whole = own, names.copy()
                elif own == pivot and _shared(names, whole, percent):
                    found.append((node, own))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


_CELL = ["group", "kind", "lo", "hi"]


def _cells(t: pa.Table) -> Iterator[tuple[int, int]]:
    at = np.concatenate([[0], np.flatnonzero(textkit.changes(t, _CELL)) + 1, [t.num_rows]])
    yield from ((i, j) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if j - i > 1)


def _candidates(n: np.ndarray, comp: np.ndarray, side: np.ndarray, far: np.ndarray, limit: int, percent: int) -> np.ndarray:
    """Pairs of a cell that are in different parts, on different sides if it has two, and may be linked."""
    ok = (far <= limit) & _sizes_fit(n[:, None], n, percent) & (comp[:, None] != comp)
    return ok & (side[:, None] != side) if side.min() != side.max() else ok


def _close_pairs(limit: int, percent: int):
    """Forests of the candidate pairs of the cells."""

    def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = np.arange(len(near))
        while True:
            new = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        off = np.flatnonzero(label != np.arange(len(near)))
        return off, label[off]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in textkit.whole_groups(batches, _CELL):
            node, comp, side, n = (t.column(c).to_numpy() for c in ("node", "comp", "side", "n"))
            s = _fixed(t.column("sketch"), BITS // 64)
            for i, j in _cells(t):
                a, b = forest(_candidates(n[i:j], comp[i:j], side[i:j], _distances(s[i:j], s[i:j]), limit, percent))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[i:j][a]), pa.array(node[i:j][b])], ["a", "b"])

    # one text's pairs are in many cells: a partition returns them merged to stars
    return lambda batches: stars(run(batches))


def _full_sets(shingle: int, columns: list[str]):
    """The sorted shingle names of each text, beside its other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textkit.slices(batch, "text"):
                part = batch.slice(i, j - i)
                names, borders = _sets(part.column("text"), shingle)
                blobs = pa.array([names[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), blobs], [*columns, "names"])

    return run


def _cell_links(percent: int, limit: int):
    """Confirmed links between the parts of every cell."""

    def confirmed(node: np.ndarray, comp: np.ndarray, side: np.ndarray, s: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        far = _distances(s, s)
        i, j = np.nonzero(np.triu(_candidates(np.array([len(x) for x in sets]), comp, side, far, limit, percent), 1))
        order = np.argsort(far[i, j], kind="stable")
        part = np.unique(comp, return_inverse=True)[1].tolist()
        root, out = list(range(len(node))), []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            p, q = top(part[x]), top(part[y])
            if p != q and _shared(sets[x], sets[y], percent):
                root[q] = p
                out.append((int(node[x]), int(node[y])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in textkit.whole_groups(batches, _CELL):
            node, comp, side = (t.column(c).to_numpy() for c in ("node", "comp", "side"))
            s = _fixed(t.column("sketch"), BITS // 64)
            sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in t.column("names")]
            out = [e for i, j in _cells(t) for e in confirmed(node[i:j], comp[i:j], side[i:j], s[i:j], sets[i:j])]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _to_cells(rows: DataFrame, block: int) -> DataFrame:
    """``group, node, comp`` rows as cells: blocks of the rows outside a group's largest part against each other and the rest.

    A group that is one part has no cell.
    """
    parts = rows.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("big")).where("all > big.n")
    parts = parts.select("group", F.col("big.comp").alias("big"), F.ceil((F.col("all") - F.col("big.n")) / block).cast("int").alias("rest"), F.ceil(F.col("big.n") / block).cast("int").alias("base"))
    rows = rows.join(parts, "group").withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("comp") == F.col("big"), F.col("base")).otherwise(F.col("rest"))).cast("int"))
    cells = """if(comp = big,
        transform(sequence(0, rest - 1), o -> named_struct('kind', 1, 'lo', o, 'hi', mine, 'side', 1)),
        concat(transform(sequence(0, rest - 1), o -> named_struct('kind', 0, 'lo', least(o, mine), 'hi', greatest(o, mine), 'side', int(mine >= o))),
               transform(sequence(0, base - 1), o -> named_struct('kind', 1, 'lo', mine, 'hi', o, 'side', 0))))"""
    return rows.select("group", "node", "comp", F.explode(F.expr(cells)).alias("cell")).select("group", "cell.kind", "cell.lo", "cell.hi", "cell.side", "node", "comp")


def _gather(cells: DataFrame) -> DataFrame:
    return cells.repartition(*_CELL).sortWithinPartitions(*_CELL)


def _maybe_in(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts whose number may be among the nodes, so that a join needn't shuffle all texts.

    The nodes' hashes are a bitmap, whose size has a bound; with very many nodes it
    lets more texts through, never fewer than it must.
    """
    bits = 1 << min(MAX_FILTER_BITS, max(20, (16 * nodes.count()).bit_length()))
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    word = nodes.select(F.shiftright(slot("node"), 3).alias("i"), F.expr(f"shiftleft(1, cast(xxhash64(node) & {bits - 1} & 7 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    bitmap = np.zeros(bits // 8, np.uint8)
    found = word.toPandas()
    bitmap[found["i"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield batch.filter(pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0)).select(["uid", "text"])

    return texts.select("uid", "text", slot("uid").alias("slot")).mapInArrow(textkit.lean(run), "uid bigint, text string").withColumnRenamed("uid", "node")


def _with_sets(texts: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The rows with the full set of their ``node``, as ``names``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return _maybe_in(texts, rows.select("node").distinct()).join(rows, "node").mapInArrow(textkit.lean(_full_sets(shingle, rows.columns)), f"{kinds}, names binary")


def _slots(bits: int):
    """``slot, n``: how many shingles have a name that begins with these bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            names = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in b.column("names")), np.uint64)
            slot, n = np.unique(names >> np.uint64(64 - bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(n, pa.int64())], ["slot", "n"])

    return run


def _rarest(shared, bits: int, percent: int):
    """``group, node, own``: each set's first shingles in the common order.

    Two linked sets share one that is among the larger set's first, one more than
    any linked set can lack, and among the smaller set's ``own`` ones, one more than
    a linked set of at least its size can lack.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            nodes, found, own = [], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for node, raw in zip(b.column("node").to_pylist(), b.column("names"), strict=True):
                names = np.frombuffer(raw.as_buffer(), np.uint64)
                n = len(names)
                size, inner = n + percent * n // -100 + 1, n + 2 * percent * n // -(100 + percent) + 1
                found.append(names[np.lexsort((names, counts[names >> np.uint64(64 - bits)]))[:size]])
                own.append(np.arange(size) < inner)
                nodes.append(np.full(size, node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *nodes])), pa.array(np.concatenate(own))], ["group", "node", "own"])

    return run


def _by_rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """``group, node, own``: the ``node, names`` sets under each of their rarest shingles; linked sets share one that is an ``own`` of the smaller."""
    total = sets.agg(F.sum(F.octet_length("names"))).first()[0] or 0
    bits = min(COUNT_BITS[1], max(COUNT_BITS[0], (total // 8).bit_length() + 1))
    found = sets.select("names").mapInArrow(textkit.lean(_slots(bits)), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << bits, np.uint32)
    counts[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), (1 << 32) - 1)
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    return sets.select("node", "names").mapInArrow(textkit.lean(_rarest(shared, bits, percent)), "group bigint, node bigint, own boolean")


def near_duplicates(docs: DataFrame, *, percent: int = 80, shingle: int = 5, block: int = 128, fan: int = 1024) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked when the sets of their ``shingle``-word runs have
    ``100 * shared >= percent * all``; a component is all that links reach, named by
    its smallest id, and ``kept`` is true for that document.  A text of fewer words
    is one shingle; a null text, or one without words, has no shingle and is linked
    with nothing.  Rows are linked by their texts alone: rows that repeat an id are
    returned each, each in the component of its own text.  A row with a null id is
    linked like any other but doesn't name a component; a component without any id
    has a null name and all its rows are kept.  Ids are of any type that has an
    order.  Other columns are ignored; an empty table gives an empty one.  One text
    and its set are held whole, about 30 bytes for each byte of text.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    textkit.bound_batches(docs.sparkSession)
    limit, scratch = max_distance(percent), Scratch(docs.sparkSession, "neardup")
    texts = scratch.keep(spread(docs.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), "texts", compression="zstd")
    signed = scratch.keep(signatures(texts, shingle), "signed")
    classes = signed.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("named"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = scratch.keep(classes, "classes")
    sketches = classes.select("node", "n", "sketch")

    keys = classes.select("node", F.explode("bands").alias("group"))
    members = keys.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    keys = scratch.keep(keys.join(members, "group"), "keys")
    central = keys.groupBy("node").agg(F.sum("members").alias("near"))
    pivots = keys.join(central, "node").groupBy("group").agg(F.max(F.struct("near", -F.col("node"))).alias("top")).select("group", (-F.col("top.col2")).alias("pivot"))
    pairs = keys.join(pivots, "group").where("node <> pivot").select("node", "pivot").distinct().join(sketches, "node").join(sketches.toDF("pivot", "pivot_n", "pivot_sketch"), "pivot")
    near = pairs.mapInArrow(textkit.lean(_near(limit, percent)), "node bigint, pivot bigint, far int")
    closest = scratch.keep(near.groupBy("node").agg(F.min(F.struct("far", "pivot")).alias("best")).select("node", F.col("best.pivot").alias("pivot")), "closest")
    shares = closest.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / fan).cast("int").alias("cells"))
    rows = closest.join(shares, "pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), "cells").cast("int").alias("cell"), F.lit(1).alias("member"))
    rows = rows.unionByName(shares.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("member")))
    sets = _with_sets(texts, rows, shingle).repartition("pivot", "cell").sortWithinPartitions("pivot", "cell", "member")
    first = scratch.keep(sets.mapInArrow(textkit.lean(_pivot_links(percent)), "a bigint, b bigint"), "links1")

    parts = scratch.keep(connected_components(first).toDF("node", "comp"), "parts")
    within = lambda rows: rows.join(parts, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = within(keys.select("group", "node"))
    mixed = rows.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("group")
    sets = scratch.keep(_with_sets(texts, rows.join(mixed, "group").select("node").distinct(), shingle), "sets", **{"parquet.block.size": str(16 << 20)})
    rare = scratch.keep(_by_rare_shingles(sets, percent), "rare")
    shared = rare.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).where("n > 1 and any").select("group")
    rows = within(rare.join(shared, "group").select("group", "node"))
    close = _gather(_to_cells(rows, block).join(sketches, "node")).mapInArrow(textkit.lean(_close_pairs(limit, percent)), "a bigint, b bigint")
    groups = scratch.keep(connected_components(close).toDF("node", "group"), "groups")
    cells = scratch.keep(_to_cells(within(groups), block).join(sketches.drop("n"), "node"), "cells")
    second = _gather(_with_sets(texts, cells, shingle)).mapInArrow(textkit.lean(_cell_links(percent, limit)), "a bigint, b bigint")
    second = scratch.keep(second, "links2")
    scratch.drop("texts", "keys", "closest", "sets", "rare", "groups", "cells")
    linked = classes.select("node", "named").join(connected_components(first.union(second)).toDF("node", "comp"), "node")
    linked = linked.join(linked.groupBy("comp").agg(F.min("named").alias("component_id")), "comp").select("node", "component_id")
    named = classes.join(linked, "node", "left").select("n", "h1", "h2", F.coalesce("component_id", "named").alias("component_id"))
    out = signed.select("doc_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
    out = scratch.keep(out, "result")
    scratch.drop("signed", "classes", "links1", "links2", "parts")
    return out
