"""Language identification with bit-sliced Bloom filters of n-grams.

Each language has a Bloom filter of the byte n-grams that are frequent in it.
The filters are stored bit-sliced: a slot of the table is a bitmask with one bit
per language, so the AND of an n-gram's slots is the mask of all languages whose
filter contains it.  A text's n-grams are summed to a popcount per language,
each popcount is corrected for that filter's false-positive rate, and the
largest decides.

The n-gram counts cover all training texts.  A language keeps the n-grams that
are at least ``min_share`` of its own, so it keeps at most ``1 / min_share``,
whatever the corpus; only those reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondera.llm import textkit
from pondera.plans.scratch import Scratch, spread

UNKNOWN = "und"
#: A task's counts of a language are passed on beyond so many different n-grams.
MERGE_GRAMS = 1 << 18
#: ASCII letters folded; other ASCII bytes are blanks; the rest as it is.
_LETTERS = textkit.FOLD.copy()
_LETTERS[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def grams(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (n to 8 bytes) of each text between blanks, and the row of each.

    Grams with two blanks in a row are left out, so symbols, digits and spacing
    between words don't matter.
    """
    data, offsets = textkit.utf8(column)
    lens = np.diff(offsets)
    padded = np.full(len(data) + 2 * len(lens), 32, np.uint8)
    at = np.repeat(2 * np.arange(len(lens)) + 1, lens)
    padded[np.arange(len(data)) + at] = _LETTERS[data]
    m = len(padded) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    blank = padded == 32
    double = np.concatenate([[0], np.cumsum(blank[1:] & blank[:-1])])
    ok = double[n - 1 : n - 1 + m] == double[:m]
    packed = np.zeros(m, np.uint32 if n <= 4 else np.uint64)
    for j in range(n):
        packed = packed << packed.dtype.type(8) | padded[j : j + m]
    where = np.flatnonzero(ok)
    return packed[where].astype(np.uint64), np.searchsorted(offsets[1:] + 2 * np.arange(1, len(lens) + 1), where, side="right")


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    return np.array([t is not None and (any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t))) for t in column.to_pylist()], bool)


@dataclass
class Filters:
    """The bit-sliced table and what is known of each language."""

    n: int
    languages: list[str]
    table: np.ndarray  # slots x words of 64 languages
    hashes: int
    false_rate: np.ndarray
    fallback: int

    def masks(self, packed: np.ndarray) -> np.ndarray:
        h = textkit.mix(packed + np.uint64(0x9E3779B97F4A7C15))
        step = (h >> np.uint64(32)) | np.uint64(1)
        last = np.uint64(len(self.table) - 1)
        out = self.table[h & last]
        for j in range(1, self.hashes):
            out &= self.table[(h + np.uint64(j) * step) & last]
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score (the winner's share of all corrected popcounts) of each text."""
        rows, lang = len(column), len(self.languages)
        hits, total = np.zeros((rows, lang)), np.zeros(rows)
        for i, end in textkit.slices(column):
            k = end - i
            packed, row = grams(column.slice(i, k), self.n)
            total[i : i + k] = np.bincount(row, minlength=k)
            masks = self.masks(packed)
            for j in range(lang):
                bit = (masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
                hits[i : i + k, j] = np.bincount(row, weights=bit.astype(np.float64), minlength=k)
        fixed = np.maximum(0, (hits - total[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))
        best = fixed.argmax(1)
        top, everything = fixed.max(1, initial=0), fixed.sum(1)
        best[everything == 0] = self.fallback
        score = np.where(everything > 0, top / np.where(everything > 0, everything, 1), 1 / lang)
        letters = has_letter(column)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def count_grams(texts: DataFrame, n: int) -> DataFrame:
    """``lang, gram, n`` over all texts with a language; each task sums before the shuffle."""
    textkit.bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            parts = open_.pop(lang)
            found, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return found, np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(found)).astype(np.int64)

        def flush(lang: str) -> pa.RecordBatch:
            found, times = merged(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(times)], ["lang", "gram", "n"])

        for batch in batches:
            for i, j in textkit.slices(batch, "text"):
                part = batch.slice(i, j - i)
                code = part.column("lang").dictionary_encode()
                which = np.asarray(code.indices)
                packed, row = grams(part.column("text"), n)
                own = which[row] if len(row) else row
                for k, lang in enumerate(code.dictionary.to_pylist()):
                    found, times = np.unique(packed[own == k], return_counts=True)
                    if len(found):
                        parts = open_.setdefault(lang, [])
                        parts.append((found, times))
                        if len(parts) >= 16:
                            open_[lang] = [merged(lang)]
                            if len(open_[lang][0][0]) > MERGE_GRAMS:
                                yield flush(lang)
        for lang in list(open_):
            yield flush(lang)

    counted = spread(texts.where("lang is not null and text is not null").select("lang", "text")).mapInArrow(textkit.lean(run), "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, *, n: int = 5, min_share: float = 1e-5, hashes: int = 3, slots: int = 1 << 20) -> Filters | None:
    """Filters from all rows of ``lang, text``; None if there is no text with a language."""
    scratch = Scratch(texts.sparkSession, "langid")
    counts = scratch.keep(count_grams(texts, n), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        scratch.drop("grams")
        return None
    share = counts.join(counts.groupBy("lang").agg(F.sum("n").alias("all")), "lang").where(F.col("n") >= F.lit(min_share) * F.col("all"))
    kept = share.select("lang", "gram").toPandas()
    scratch.drop("grams")
    languages = sorted(totals)
    f = Filters(n, languages, np.zeros((slots, -(-len(languages) // 64)), np.uint64), hashes, np.zeros(len(languages)), max(range(len(languages)), key=lambda j: totals[languages[j]]))
    for j, lang in enumerate(languages):
        packed = kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        h = textkit.mix(packed + np.uint64(0x9E3779B97F4A7C15))
        step = (h >> np.uint64(32)) | np.uint64(1)
        bit = np.uint64(1 << (j % 64))
        for i in range(hashes):
            f.table[(h + np.uint64(i) * step) & np.uint64(slots - 1), j // 64] |= bit
        f.false_rate[j] = np.mean((f.table[:, j // 64] & bit) != 0) ** hashes
    return f


def identify(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``.

    A text that is null or has no letter is ``und`` with score 0, and so is every
    text without filters.  A text with letters but no known n-gram takes the
    language with the most training text.  Own columns of these names are replaced.
    """
    textkit.bound_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = shared.value
            lang, score = f.predict(textkit.field(batch, "text")) if f else ([UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    return textkit.beside(docs, run, "lang_pred string, score double")
