"""Bigram counts as sorted keys and flat arrays, looked up by bisection.

A model whose counts fit a stated bound is one immutable value: broadcast to tasks, which
score a row's options where the row is, and used on the driver for single requests.
Keys are the engine's 64-bit hashes of the words, so tokens never leave the JVM: a task
gets numbers and gives numbers back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS = "<s>"
#: Most pairs of a store: 16 bytes each, 64 MB in all.
MAX_PAIRS = 1 << 22
#: Fixed value: the seed of the engine's hash.
SEED = 42


def words_of(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def characters_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), ""), lambda c: c != "")


UNITS = {"word": words_of, "char": characters_of}


def tokens(text: str, unit: str) -> list[str]:
    """The tokens of one text, as ``UNITS`` cuts it."""
    return list(text.lower()) if unit == "char" else [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]


def key(*tokens: str) -> int:
    """The engine's ``xxhash64`` of strings."""
    h = SEED
    for t in tokens:
        h = xxhash.xxh64_intdigest(t.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


@dataclass(frozen=True)
class Store:
    """Counts of pairs and of first tokens by sorted key."""

    pairs: np.ndarray
    pair_counts: np.ndarray
    firsts: np.ndarray
    first_counts: np.ndarray
    vocabulary: int
    unit: str
    k: float

    def log_probabilities(self, pairs: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Of the second token of each pair after its first."""
        def count(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.zeros(len(keys))
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            return np.where(known[at] == keys, counts[at], 0)

        return np.log((count(pairs, self.pairs, self.pair_counts) + self.k) / (count(firsts, self.firsts, self.first_counts) + self.k * self.vocabulary))

    def score(self, context: str, options: list[str]) -> list[tuple[int, float, float]]:
        """Tokens, log-probability after the context, and alone, of each option."""
        last, out = (tokens(context, self.unit) or [BOS])[-1], []
        for option in options:
            t = tokens(option, self.unit)
            if not t:
                raise ValueError("an option has no token")
            before = [last, BOS, *t[:-1]]
            lp = self.log_probabilities(np.array([key(a, b) for a, b in zip(before, [t[0], *t], strict=True)]), np.array([key(a) for a in before]))
            rest = float(lp[2:].sum())
            out.append((len(t), float(lp[0]) + rest, float(lp[1]) + rest))
        return out


def collect(pairs: DataFrame, firsts: DataFrame, vocabulary: int, unit: str, k: float) -> Store | None:
    """The store of ``a, b, n`` and ``a, n`` counts, or None if there are too many to hold."""
    if pairs.count() > MAX_PAIRS:
        return None

    def arrays(rows: DataFrame, *columns: str) -> tuple[np.ndarray, np.ndarray]:
        t = rows.select(F.xxhash64(*columns).alias("key"), "n").toArrow()
        keys, n = t.column("key").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(keys)
        return keys[order], n[order]

    return Store(*arrays(pairs, "a", "b"), *arrays(firsts, "a"), vocabulary, unit, k)


def row_scores(rows: DataFrame, store: Store, *, context: str = "context", options: str = "options") -> DataFrame:
    """Add ``scored``, an array of ``n_tokens, logprob_sum, logprob_uncond`` in the order of the options.

    Row-local: no join and no shuffle.  An option without a token fails the query.
    """
    cut, shared = UNITS[store.unit], rows.sparkSession.sparkContext.broadcast(store)
    last = F.coalesce(F.try_element_at(cut(F.col(context)), F.lit(-1)), F.lit(BOS))

    def keys(t: Column) -> Column:
        head, n = F.element_at(t, 1), F.size(t) - 1
        pairs = F.concat(F.array(F.xxhash64(last, head), F.xxhash64(F.lit(BOS), head)), F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.xxhash64(a, b)))
        firsts = F.concat(F.array(F.xxhash64(last), F.xxhash64(F.lit(BOS))), F.transform(F.slice(t, 1, n), lambda a: F.xxhash64(a)))
        return F.struct(pairs.alias("pairs"), firsts.alias("firsts"))

    cuts = F.transform(options, cut)
    cuts = F.when(F.exists(cuts, lambda t: F.size(t) == 0), F.raise_error(F.lit("an option has no token"))).otherwise(cuts)

    @F.arrow_udf("array<struct<n_tokens:int,logprob_sum:double,logprob_uncond:double>>")
    def look_up(asked: pa.Array) -> pa.Array:
        parts = asked.flatten()
        pairs, firsts = parts.field("pairs"), parts.field("firsts")
        sizes = np.diff(pairs.offsets.to_numpy())
        lp = shared.value.log_probabilities(pairs.flatten().to_numpy(zero_copy_only=False), firsts.flatten().to_numpy(zero_copy_only=False))
        at = np.cumsum(sizes) - sizes
        inner = np.ones(len(lp), bool)
        inner[at], inner[at + 1] = False, False
        rest = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[inner], weights=lp[inner], minlength=len(sizes))
        values = pa.StructArray.from_arrays([pa.array(sizes - 1, pa.int32()), pa.array(lp[at] + rest), pa.array(lp[at + 1] + rest)], ["n_tokens", "logprob_sum", "logprob_uncond"])
        counts = np.where(asked.is_null().to_numpy(zero_copy_only=False), 0, np.nan_to_num(asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)

    return rows.withColumn("scored", look_up(F.transform(cuts, keys)))
