"""Vectorised text kernels shared by the training-data operators.

Everything works on UTF-8 bytes as numpy arrays taken from Arrow buffers, so no
Python object exists per word.  Texts are handled in blocks cut between words:
the temporaries stay near ``BLOCK`` bytes times a small factor, however long a
text is.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pondera.plans.scratch import spread

BLOCK = 1 << 20
_U = np.uint64

#: Bytes that are part of a word: everything but space and \\t..\\r.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes that are part of a word: digits, a-z (after folding) and non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: A-Z to a-z, all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, xor-shift)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_FOLDED_CODE = _BYTE_CODE[FOLD]
_STEP = 0xD1342543DE82EF95
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)])) for b in (_STEP, _STEP_INVERSE)]
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Array, column: str | None = None, max_bytes: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges with at most so many bytes of text each, or one row."""
    _, offsets = utf8(batch.column(column) if column else batch)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        yield i, min(j, n, i + 4096)
        i = min(j, n, i + 4096)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same batch function, which gives freed memory back to the system when its partition ends.

    Workers are kept for later stages, so what one holds on to counts against all of them.
    """
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # no glibc
            pass

    return wrapped


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str) -> DataFrame:
    """All columns of ``docs``, whatever their names, and those that ``run`` adds.

    ``run`` takes batches with one column ``row``, a struct, and returns it with the
    columns ``added`` (their names and types).
    """
    new = StructType.fromDDL(added)
    rows = spread(docs).select(F.struct("*").alias("row")).mapInArrow(lean(run), StructType([StructField("row", docs.schema, False), *new]))
    return rows.select("row.*", *new.names)


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of the batch's ``row``."""
    row = batch.column("row")
    return row.field(row.type.get_field_index(name))


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by the columns."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.flatnonzero(changes(batch, columns))
        cut = int(new[-1]) + 1 if len(new) else 0
        if rest and any(rest[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in columns):
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = []
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks()
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def changes(rows: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    """Whether a row's group differs from that of the row before, from the second row on."""
    out = np.zeros(max(rows.num_rows - 1, 0), bool)
    for c in columns:
        key = rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy()
        out |= key[1:] != key[:-1]
    return out


def bound_batches(spark: SparkSession, n_bytes: int = 8 << 20) -> None:
    """Have Arrow batches bounded by bytes, as texts differ much in size; a session's own smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", str(spark.conf.get(key, None))) or 0)
    if not 0 < now <= n_bytes:
        spark.conf.set(key, str(n_bytes))


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; a word never crosses a text's border."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    w = inside[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = w[0], w[-1]
    np.not_equal(w[1:], w[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[w[cuts] & w[cuts - 1]]
    if len(cuts):
        cuts = np.unique(cuts)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit name of each word's bytes (A-Z folded when ``fold``)."""
    out = np.empty(len(starts), _U)
    code = _FOLDED_CODE if fold else _BYTE_CODE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(hi - lo + 1)
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(code[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0xA0761D6478BD642F))
        i = j
    return out


def words(column: pa.Array, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Word names of a string column and, for each row, the n+1 borders in them."""
    data, offsets = utf8(column)
    starts, ends = word_bounds(data, offsets, inside)
    return word_hashes(data, starts, ends), np.searchsorted(starts, offsets, side="left")


#: Odd factors for the places of a word sequence.
_PLACE = mix(np.arange(101, 165, dtype=_U)) | _U(1)


def sequences(w: np.ndarray, borders: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all n-word sequences that stay within a row, and each row's n+1 borders in them."""
    lens = np.diff(borders)
    counts = np.maximum(lens - n + 1, 0)
    out_borders = np.concatenate([[0], np.cumsum(counts)])
    if len(w) < n:
        return np.empty(0, _U), out_borders
    m = len(w) - n + 1
    total = np.zeros(m, _U)
    for j in range(n):
        total += w[j : j + m] * _PLACE[j]
    ok = np.ones(m, dtype=bool)
    for b in range(1, n):  # starts too near a border
        bad = borders[1:] - b
        bad = bad[(bad >= 0) & (bad < m)]
        ok[bad] = False
    # rows shorter than n put marks into the row before: mark by row instead
    if (lens < n).any():
        ok = np.zeros(m + 1, dtype=np.int32)
        has = counts > 0
        np.add.at(ok, borders[:-1][has], 1)
        np.add.at(ok, borders[:-1][has] + counts[has], -1)
        ok = np.cumsum(ok)[:m] > 0
    return mix(total[ok] + _U(n)), out_borders


def shingle_sets(w: np.ndarray, borders: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct n-word shingles; a shorter row has its whole sequence as one."""
    names, at = sequences(w, borders, n)
    rows = np.repeat(np.arange(len(borders) - 1), np.diff(at))
    lens = np.diff(borders)
    few = np.flatnonzero((lens > 0) & (lens < n))
    if len(few):
        extra = np.zeros(len(few), _U)
        for j in range(n - 1):
            there = lens[few] > j
            extra[there] += w[borders[:-1][few[there]] + j] * _PLACE[j]
        names = np.concatenate([names, mix(extra + lens[few].astype(_U))])
        rows = np.concatenate([rows, few])
    order = np.argsort(rows, kind="stable") if len(few) else slice(None)
    names, rows = names[order], rows[order]
    at = np.searchsorted(rows, np.arange(len(borders)))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        names[a:b].sort()
    keep = np.ones(len(names), dtype=bool)
    keep[1:] = (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])
    return names[keep], np.concatenate([[0], np.cumsum(keep)])[at]
