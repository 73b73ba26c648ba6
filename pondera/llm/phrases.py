"""Phrase collocations from position bitmaps.

Texts are dealt to shards of one language, some megabytes each, where they were
read.  In a shard every word of a piece has a position, with an empty one between
pieces, and a word's bitmap has its positions.  Compressed, a bitmap is a list of
positions, unless more than one position in 64 is set: then it is plain bits.  The
bitmap of a phrase marks its last word; shifted by one and ANDed with a word's
bitmap it is that of the phrase with the word behind it, and its popcount is how
often the shard has that phrase.  Phrases are extended depth-first up to the
longest length, and popcounts are summed over shards.

No shard can tell what is frequent in all.  So a first pass sums the shards' counts
of single words and of pairs, under 64-bit names, and a second one those of the triples
whose words and pairs are frequent.  Bloom filters of the frequent names, whose size has
a bound, tell the last pass which steps to take.  By pairs alone it would make nearly
every long phrase of a large corpus, as most pairs of it are frequent.  Where names
collide, or where very many are frequent, a shard extends more phrases than it
must, never fewer; the counts that are returned are those of the phrases' texts.
Names and popcounts travel in packed blocks: a task merges those of its shards and sends
one block to each part of the sum, so the engine handles blocks, not phrases.

What follows the counts is joins and sums by (language, phrase).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondera.llm import textkit
from pondera.plans.scratch import Scratch, spread

#: Bytes between pieces, and bytes of words.
BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?"]] = True
BREAK[0x0A:0x0E] = True
INSIDE = ~BREAK
INSIDE[[0x20, 0x09]] = False
#: Bytes of a shard, positions of a range of roots, phrases and names that a task holds, and binary logarithms of the least and largest filter.
SHARD_BYTES, RANGE, HELD, NAMES, BITS = 4 << 20, 1 << 18, 1 << 20, 1 << 22, (20, 30)
#: Where in a name the filter's probes begin.
PROBES = (0, 17, 34)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def blocks_of(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A text cut behind breaks into parts of at most ``most`` bytes, or one piece."""
    if len(raw) <= most:
        yield raw
        return
    cuts, at = np.flatnonzero(BREAK[raw]) + 1, 0
    while at < len(raw):
        k = int(np.searchsorted(cuts, at + most, side="right"))
        end = int(cuts[k - 1]) if k and cuts[k - 1] > at else int(cuts[k]) if k < len(cuts) else len(raw)
        yield raw[at:end]
        at = end


def shards(batches: Iterator[pa.RecordBatch], most: int = SHARD_BYTES) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """``language, bytes, borders`` of the texts of ``lang, text`` rows, of one language each."""
    open_: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}
    held = 0

    def close(lang: str) -> tuple[str, np.ndarray, np.ndarray]:
        nonlocal held
        parts = open_.pop(lang)
        held -= size.pop(lang)
        return lang, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    for batch in batches:
        data, offsets = textkit.utf8(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            for part in blocks_of(data[offsets[i] : offsets[i + 1]], most):
                if lang in open_ and size[lang] + len(part) > most:
                    yield close(lang)
                if held > 2 * most:
                    yield close(max(size, key=size.get))
                open_.setdefault(lang, []).append(part.copy())
                size[lang] = size.get(lang, 0) + len(part)
                held += len(part)
    for lang in list(open_):
        yield close(lang)


class Shard:
    """Words of a shard: their bytes' bounds, names, and positions with one free between pieces."""

    def __init__(self, lang: str, data: np.ndarray, borders: np.ndarray):
        self.data = data
        self.starts, self.ends = textkit.word_bounds(data, borders, INSIDE)
        piece = np.searchsorted(np.flatnonzero(BREAK[data]), self.starts) + np.searchsorted(borders, self.starts, side="right")
        new = np.ones(len(piece), bool)
        new[1:] = piece[1:] != piece[:-1]
        self.position = np.arange(len(piece)) + np.cumsum(new) - 1
        salt = textkit.word_hashes(np.frombuffer(b"=" + lang.encode(), np.uint8), np.array([0]), np.array([1 + len(lang.encode())]))[0]
        self.names = textkit.mix(textkit.word_hashes(data, self.starts, self.ends) + salt)
        self.next = np.flatnonzero(~new[1:])  # words that have one behind them in their piece

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Names of the pairs that begin at these words."""
        return textkit.mix(self.names[at] * _A + self.names[at + 1] * _B)

    def triples(self, at: np.ndarray) -> np.ndarray:
        """Names of the triples that begin at these words."""
        return textkit.mix(self.names[at] * _A + self.names[at + 1] * _B + self.names[at + 2] * _C)

    def steps(self, bloom: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that the filter has, and where the pairs begin that it has with their words, and the triples of two such pairs."""
        known = _has(bloom, self.names)
        pair = self.next[known[self.next] & known[self.next + 1]]
        pair = pair[_has(bloom, self.pairs(pair))]
        begins = np.zeros(len(known) + 1, bool)
        begins[pair] = True
        return np.flatnonzero(known), pair, pair[begins[pair + 1]]

    def texts(self, word: np.ndarray, length: np.ndarray) -> pa.Array:
        """The phrases of so many words from these words on, A-Z folded, joined by spaces."""
        flat = np.repeat(word - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        size = self.ends[flat] - self.starts[flat] + 1
        last = np.cumsum(length) - 1
        size[last] -= 1
        at = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.starts[flat] - at[:-1], size) + np.arange(at[-1])
        out = textkit.FOLD[self.data[np.minimum(source, len(self.data) - 1)]]
        inner = np.ones(len(flat), bool)
        inner[last] = False
        out[at[1:][inner] - 1] = 0x20
        borders = np.concatenate([[0], at[1:][last]]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(word), [None, pa.py_buffer(borders), pa.py_buffer(out)])


def _has(bloom: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether the filter has each name."""
    mask, out = np.uint64(len(bloom) * 64 - 1), np.ones(len(name), bool)
    for shift in PROBES:
        slot = name >> np.uint64(shift) & mask
        out &= bloom[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) > 0
    return out


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])


def _names(of: Callable[[Shard], list[np.ndarray]], parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``part, names, counts``: of the names that a task's shards have, as one block for each part of the range of names."""

    def blocks(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held)
        held.clear()
        every.sort()
        first = _runs(every)
        name, n = every[first], np.diff(np.append(first, len(every))).astype(np.uint32)
        cuts = [*np.searchsorted(name, np.array([(k << 64) // parts for k in range(parts)], np.uint64)).tolist(), len(name)]
        for k in range(parts):
            if cuts[k] < cuts[k + 1]:
                part = slice(cuts[k], cuts[k + 1])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([name[part].tobytes()], pa.binary()), pa.array([n[part].tobytes()], pa.binary())], ["part", "names", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for lang, data, borders in shards(batches):
            held += of(Shard(lang, data, borders))
            if sum(map(len, held)) > NAMES:
                yield from blocks(held)
        if held:
            yield from blocks(held)

    return run


def _frequent(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``name``: of all blocks of a part, those that occur often enough."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        name, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(name)
        name, n = name[order], n[order]
        first = _runs(name)
        return name[first], np.add.reduceat(n, first) if len(first) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, NAMES
        for batch in batches:
            for name, n in zip(batch.column("names"), batch.column("counts"), strict=True):
                held.append((np.frombuffer(name.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64)))
                size += len(held[-1][0])
                if size > most:
                    held = [merged(held)]
                    size = len(held[0][0])
                    most = max(NAMES, 2 * size)  # it may have grown for good
        if held:
            name, n = merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(name[n >= least].view(np.int64))], ["name"])

    return run


def _bits(positions: np.ndarray, size: int) -> np.ndarray:
    marks = np.zeros(size * 64, np.uint8)
    marks[positions] = 1
    return np.packbits(marks, bitorder="little").view(np.uint64)


def _positions(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def _shifted(bits: np.ndarray) -> np.ndarray:
    out = bits << np.uint64(1)
    out[1:] |= bits[:-1] >> np.uint64(63)
    return out


def extend(word: np.ndarray, go: np.ndarray, longest: int, dense: int = 64, further: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Depth-first phrases of at least two words: ``last positions, words, popcounts``.

    ``word`` has the word at each position, or -1; ``go`` marks the positions from which
    a phrase of one word may go on to the next, ``further`` those from which a longer one
    may (as ``go``, unless given).  A bitmap of over ``1 / dense`` of all positions is held
    as bits: there are at most ``dense`` words of them, so a phrase meets them all at
    once.  Lists of positions are extended for a range of first words together: the
    words behind a phrase's positions split its shifted list into the ANDs with the
    words' lists.
    """
    kinds, count = np.unique(word[word >= 0], return_counts=True)
    if not len(kinds) or longest < 2:
        return
    further = go if further is None else further
    size = len(word) // 64 + 1
    often = kinds[count * dense > len(word)]
    by = np.argsort(word, kind="stable")[np.count_nonzero(word < 0) :]
    cuts = np.concatenate([[0], np.cumsum(count)])

    def follow(last: np.ndarray, phrase: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Extend phrases of ``n`` words given as lists."""
        while n < longest and len(last):
            on = (go if n == 1 else further)[last]
            last = last[on] + 1
            key = phrase[on].astype(np.int64) << 32 | word[last]
            order = np.argsort(key, kind="stable")
            last, key = last[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            times = np.diff(np.concatenate([first, [len(key)]]))
            phrase, n = np.repeat(np.arange(len(first)), times), n + 1
            if len(first):
                yield last[first], n, times

    def split(last: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Phrases of ``n`` words that differ in their last one, given as one list, and all that follows."""
        order = np.argsort(word[last], kind="stable")
        last = last[order]
        first = np.flatnonzero(np.concatenate([[True], word[last][1:] != word[last][:-1]])[: len(last)])
        times = np.diff(np.concatenate([first, [len(last)]]))
        if len(first):
            yield last[first], n, times
            yield from follow(last, np.repeat(np.arange(len(first)), times), n)

    if len(often):
        gate, gates = _bits(np.flatnonzero(go), size), _bits(np.flatnonzero(further), size)
        plain = np.stack([_bits(by[cuts[k] : cuts[k + 1]], size) for k in np.searchsorted(kinds, often)])
        rare = ~np.bitwise_or.reduce(plain)
        stack = [(bits, 1) for bits in plain]
        while stack:
            bits, n = stack.pop()
            ahead = _shifted(bits & (gate if n == 1 else gates))
            hits = plain & ahead
            times = np.bitwise_count(hits).sum(1, dtype=np.int64)
            for k in np.flatnonzero(times).tolist():
                where = _positions(hits[k])
                yield where[:1], n + 1, times[k : k + 1]
                if n + 1 == longest:
                    continue
                if times[k] * dense > len(word):
                    stack.append((hits[k], n + 1))
                else:
                    yield from follow(where, np.zeros(len(where), np.int64), n + 1)
            yield from split(_positions(ahead & rare), n + 1)
    seldom = np.flatnonzero(~np.isin(kinds, often))
    ranges = np.cumsum(count[seldom]) // RANGE
    for r in np.unique(ranges).tolist():
        roots = seldom[ranges == r]
        last = np.concatenate([by[cuts[k] : cuts[k + 1]] for k in roots])
        yield from follow(last, np.repeat(np.arange(len(roots)), count[roots]), 1)


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Counts of the same phrases summed."""
    return pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])


def _blocks(counts: pa.Table, parts: int) -> Iterator[pa.RecordBatch]:
    """``part, block``: the counts as one compressed block for each part, by a hash of the phrase."""
    data, offsets = textkit.utf8(counts.column("phrase"))
    part = (textkit.word_hashes(data, offsets[:-1], offsets[1:], fold=False) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    counts, cuts = counts.take(pa.array(order)), np.searchsorted(part[order], np.arange(parts + 1))
    for k in range(parts):
        if cuts[k] < cuts[k + 1]:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, counts.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(counts.slice(cuts[k], cuts[k + 1] - cuts[k]).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "block"])


def _mine(blooms, longest: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the shards' popcounts of phrases that may be frequent, with the number of all words as that of ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for lang, data, borders in shards(batches):
            for phrase, n in popcounts(Shard(lang, data, borders), [b.value for b in blooms], longest):
                held.append(pa.table([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"]))
                size += len(n)
            if size > HELD:
                held = [_merged(held)]
                size = held[0].num_rows
                if 2 * size > HELD:
                    yield from _blocks(held[0], parts)
                    held, size = [], 0
        if held:
            yield from _blocks(_merged(held), parts)

    return run


def popcounts(shard: Shard, blooms: list[np.ndarray], longest: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """A shard's phrases of words, pairs and triples that the filters have, with how often they occur.

    The first filter is of words and pairs, the second, if phrases get that long, of triples.
    """
    yield pa.array([""], pa.large_string()), np.array([len(shard.names)])
    if not len(shard.names):
        return
    at, pair, triple = shard.steps(blooms[0])
    _, first, code, n = np.unique(shard.names[at], return_index=True, return_inverse=True, return_counts=True)
    if not len(first):
        return
    yield shard.texts(at[first], np.ones(len(first), np.int64)), n
    free = int(shard.position[-1]) + 2
    word, go, further, back = np.full(free, -1, np.int64), np.zeros(free, bool), np.zeros(free, bool), np.zeros(free, np.int64)
    word[shard.position[at]] = code
    back[shard.position] = np.arange(len(shard.position))
    go[shard.position[pair]] = True
    if longest > 2:
        further[shard.position[triple[_has(blooms[1], shard.triples(triple))] + 1]] = True
    found = list(extend(word, go, longest, further=further))
    for i in range(0, len(found), 4096):
        part = found[i : i + 4096]
        length = np.repeat([m for _, m, _ in part], [len(p) for p, _, _ in part])
        last = back[np.concatenate([p for p, _, _ in part])]
        yield shard.texts(last - length + 1, length), np.concatenate([c for _, _, c in part])


def _sum(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``lang, phrase, n`` of the phrases that occur often enough in all blocks of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for block in batch.column("block"):
                held.append(pa.ipc.open_stream(block.as_buffer()).read_all())
                size += held[-1].num_rows
                if size > HELD:
                    held = [_merged(held)]
                    size = held[0].num_rows // 2  # it may have grown for good
        if held:
            counts = _merged(held)
            keep = (counts.column("n").to_numpy() >= least) | (counts.column("phrase").to_numpy(zero_copy_only=False) == "")
            counts = counts.filter(pa.array(keep))
            yield from counts.set_column(1, "phrase", counts.column("phrase").cast(pa.string())).combine_chunks().to_batches()

    return run


def frequent_names(texts: DataFrame, of: Callable[[Shard], list[np.ndarray]], least: int, scratch: Scratch, label: str) -> np.ndarray:
    """A Bloom filter of the names that shards have with at least so many occurrences in all; its size has a bound."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = texts.mapInArrow(textkit.lean(_names(of, parts)), "part int, names binary, counts binary").repartition(parts, "part")
    found = scratch.keep(blocks.mapInArrow(textkit.lean(_frequent(least)), "name bigint"), label)
    bits = 1 << min(BITS[1], max(BITS[0], (32 * found.count()).bit_length()))
    slots = found.select(F.explode(F.array(*[F.expr(f"shiftrightunsigned(name, {k}) & {bits - 1}L") for k in PROBES])).alias("slot"))
    words = slots.select(F.expr("shiftright(slot, 6)").alias("at"), F.expr("shiftleft(1L, cast(slot & 63L as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    scratch.drop(label)
    return out


def phrase_counts(docs: DataFrame, *, longest: int = 5, least: int = 100) -> DataFrame:
    """``lang, phrase, n``: all words and phrases of up to ``longest`` words that occur ``least`` times, and the number of all words as that of ''.

    Single words are there if they are frequent.  See ``collocations`` for nulls.
    A part of the sum, of which there are as many as shuffle partitions, is held by a task.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "phrases")
    textkit.bound_batches(spark)
    texts = spread(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"))
    blooms = [spark.sparkContext.broadcast(frequent_names(texts, lambda shard: [shard.names, shard.pairs(shard.next)], least, scratch, "names"))]
    if longest > 2:
        pairs = blooms[0]
        blooms.append(spark.sparkContext.broadcast(frequent_names(texts, lambda shard: [shard.triples(shard.steps(pairs.value)[2])], least, scratch, "triples")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = texts.mapInArrow(textkit.lean(_mine(blooms, longest, parts)), "part int, block binary").repartition(parts, "part")
    return scratch.keep(blocks.mapInArrow(textkit.lean(_sum(least)), "lang string, phrase string, n bigint"), "counts")


def collocations(docs: DataFrame, *, longest: int = 5, least: int = 100, percent: int = 100, limit: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``limit`` phrases of each language.

    A-Z are folded.  Texts fall into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
    ``[^\\x20\\x09]+``.  A phrase of 2 to ``longest`` words that occurs ``a >= least`` times has the score
    ``1000 a n / (l r)``, rounded down, of its worst cut into two parts that occur ``l`` and ``r``
    times (ties: the shortest first part), ``n`` being the language's words.  It goes if a
    longer phrase that holds it occurs at least ``percent`` percent as often; as counts fall
    from phrase to longer phrase, those with one word more decide.  Ties in rank go by ``a``,
    then by the phrase's bytes.

    A null language is ``und``, a null text is empty, ids are not looked at and rows that
    repeat count again.  Other columns are ignored; an empty table gives an empty one.
    A long text is cut between pieces; a shard, or one longer piece, is held whole,
    about 40 bytes for each byte.  Numbers are exact while ``1000 a n`` has at most 38 digits.
    """
    counts = phrase_counts(docs, longest=longest, least=least)
    of = lambda c, n: counts.where("phrase <> ''").select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    all_words = counts.where("phrase = ''").select("lang", F.col("n").alias("all"))
    split = F.split("phrase", " ")
    found = counts.select("lang", "phrase", F.col("n").alias("a"), split.alias("w")).where(F.size("w") > 1)
    joined = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    cuts = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"]).join(all_words, "lang")
    score = F.expr("(cast(1000 as decimal(38, 0)) * a * `all`) div (cast(l as decimal(38, 0)) * r)")
    worst = cuts.groupBy("lang", "phrase", "a", "all").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = found.where(F.size("w") > 2).select("lang", "a", F.explode(F.array(joined(F.lit(1), F.size("w") - 1), joined(F.lit(2), F.size("w") - 1))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = worst.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(percent).cast("decimal(20,0)") * F.col("a")))
    best = own.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("all").alias("n"), "cut.score")
    # the first of every share of a language, then the first of those
    order = "order by score desc, a desc, phrase"
    best = best.selectExpr("*", f"row_number() over (partition by lang, pmod(xxhash64(phrase), 64) {order}) as place").where(F.col("place") <= limit)
    best = best.selectExpr("*", f"row_number() over (partition by lang {order}) as rank").where(F.col("rank") <= limit)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
