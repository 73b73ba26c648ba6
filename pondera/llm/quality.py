"""A quality classifier that is a sparse ensemble of rules.

Statistics of each text are taken in one pass.  Small trees are grown on
bootstrap samples of labelled rows; every path from a root is a rule, a
conjunction of threshold tests.  A lasso-penalised logistic regression keeps few
rules, and these are compiled into one Spark column expression over the
statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondera.llm import textkit

#: Statistics of a text, in order.
STATISTICS = ["n_bytes", "n_words", "n_lines", "mean_word", "upper", "digit", "symbol", "blank", "wide", "pipe", "shout", "comma", "period", "distinct", "repeat", "top_share", "same_lines", "odd_ends"]

_CLASS = np.zeros(256, np.int64)
for _i, _set in enumerate([range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", range(128, 256), b"|", b"!?", b",;:", b"."]):
    _CLASS[list(_set)] = _i + 1
_UPPER, _LOWER, _DIGIT, _BLANK, _LINE, _WIDE, _PIPE, _SHOUT, _COMMA, _PERIOD = range(1, 11)


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; zeros for null and empty ones."""
    out = np.zeros((len(column), len(STATISTICS)))
    for i, j in textkit.slices(column):
        _statistics(column.slice(i, j - i), out[i:j])
    return out


def _statistics(column: pa.Array, out: np.ndarray) -> None:
    data, offsets = textkit.utf8(column)
    rows, lens = len(column), np.diff(offsets)
    kind = _CLASS[data]
    row = np.repeat(np.arange(rows), lens)
    by = np.bincount(row * 11 + kind, minlength=rows * 11).reshape(rows, 11)
    starts, ends = textkit.word_bounds(data, offsets)
    names = textkit.word_hashes(data, starts, ends, fold=True)
    borders = np.searchsorted(starts, offsets)
    n = np.maximum(1, np.diff(borders))
    size, letters = np.maximum(1, lens), np.maximum(1, by[:, _UPPER] + by[:, _LOWER] + by[:, _WIDE])
    word_row = np.repeat(np.arange(rows), np.diff(borders))
    out[:, 0], out[:, 1], out[:, 2] = lens, np.diff(borders), by[:, _LINE] + (lens > 0)
    out[:, 3] = np.bincount(word_row, weights=ends - starts, minlength=rows) / n
    out[:, 4] = by[:, _UPPER] / letters
    for j, k in ((5, _DIGIT), (6, 0), (7, _BLANK), (8, _WIDE), (9, _PIPE), (10, _SHOUT), (11, _COMMA), (12, _PERIOD)):
        out[:, j] = by[:, k] / size
    same = np.zeros(len(names))
    same[1:] = (names[1:] == names[:-1]) & (word_row[1:] == word_row[:-1])
    out[:, 14] = np.bincount(word_row, weights=same, minlength=rows) / n
    last = kind[ends - 1] if len(ends) else kind[:0]
    out[:, 17] = np.bincount(word_row, weights=(last == 0) | (last == _SHOUT), minlength=rows) / n
    lines, line_ends = textkit.word_bounds(data, offsets, _NOT_LINE)
    line_names, line_at = textkit.word_hashes(data, lines, line_ends, fold=False), np.searchsorted(lines, offsets)
    for k in range(rows):
        own = np.sort(names[borders[k] : borders[k + 1]])
        if len(own):
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            out[k, 13], out[k, 15] = (len(at) - 1) / len(own), np.diff(at).max() / len(own)
        m = line_at[k + 1] - line_at[k]
        if m > 1:
            out[k, 16] = 1 - len(np.unique(line_names[line_at[k] : line_at[k + 1]])) / m


_NOT_LINE = np.ones(256, bool)
_NOT_LINE[10] = False


def with_statistics(docs: DataFrame, name: str = "stats") -> DataFrame:
    """All columns of ``docs`` and the array of ``STATISTICS``, as ``name``; null and empty texts have zeros."""
    textkit.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_statistics(textkit.field(batch, "text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), flat], ["row", name])

    return textkit.beside(docs, run, f"{name} array<double>")


@dataclass(frozen=True)
class Rule:
    """Tests ``(statistic, above, threshold)`` that must all hold."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for j, above, t in self.tests:
            ok &= (x[:, j] > t) == above
        return ok

    def column(self, stats: Column) -> Column:
        ok = F.lit(True)
        for j, above, t in self.tests:
            value = F.element_at(stats, j + 1)
            ok = ok & ((value > t) if above else (value <= t))
        return ok


def _grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, tests: tuple, features: np.ndarray, rules: set[Rule]) -> None:
    """Split on the largest Gini gain among quantile thresholds; each node on the way is a rule."""
    if tests:
        rules.add(Rule(tests))
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return
    best = (1e-6, None)
    base = y.mean() * (1 - y.mean())
    for j in features:
        for t in np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25), method="lower")):
            up = x[:, j] > t
            m = int(up.sum())
            if least <= m <= len(y) - least:
                a, b = y[up].mean(), y[~up].mean()
                gain = base - (m * a * (1 - a) + (len(y) - m) * b * (1 - b)) / len(y)
                if gain > best[0]:
                    best = (gain, (int(j), float(t), up))
    if best[1]:
        j, t, up = best[1]
        for above in (True, False):
            _grow(x[up == above], y[up == above], depth - 1, least, (*tests, (j, above, t)), features, rules)


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        """The score as a Spark expression."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, penalty: float = 0.002, rounds: int = 600, seed: int = 7, tree_rows: int = 4000) -> RuleEnsemble:
    """Rules from trees, then lasso logistic weights by accelerated proximal gradient.

    Each tree grows on ``tree_rows`` rows at most, drawn with repetition; the weights
    are fitted on all rows.  With no rows the score is 0.5; with one class it is near
    that class.
    """
    y = y.astype(float)
    base = (y.sum() + 0.5) / (len(y) + 1)
    rules: set[Rule] = set()
    rng = np.random.default_rng(seed)
    if len(y) and y.min() != y.max():
        for _ in range(trees):
            pick = rng.integers(0, len(y), min(len(y), tree_rows))
            _grow(x[pick], y[pick], depth, max(5, len(pick) // 200), (), rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False), rules)
    ordered = sorted(rules, key=lambda r: r.tests)
    held = {}
    for r in ordered:  # rules that hold on the same rows count once
        ok = r.holds(x)
        if ok.any() and not ok.all():
            held.setdefault(np.packbits(ok).tobytes(), (r, ok))
    ordered, a = [r for r, _ in held.values()], np.array([ok for _, ok in held.values()], float).T
    b, w = float(np.log(base / (1 - base))), np.zeros(len(ordered))
    if ordered:
        centre, scale = a.mean(0), a.std(0)
        a = (a - centre) / scale
        step = 4 * len(y) / (np.linalg.norm(a, 2) ** 2 + len(y))
        u, c, t = w.copy(), b, 1.0
        for _ in range(rounds):
            r = 1 / (1 + np.exp(-(a @ u + c))) - y
            v, d = u - step * (a.T @ r) / len(y), c - step * r.mean()
            v = np.sign(v) * np.maximum(0, np.abs(v) - step * penalty)
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            u, c, w, b = v + (before - 1) / t * (v - w), d + (before - 1) / t * (d - b), v, d
        w = w / scale
        b -= float(w @ centre)
    keep = np.flatnonzero(w)
    return RuleEnsemble(float(b), [ordered[i] for i in keep], [float(w[i]) for i in keep])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = 20_000) -> RuleEnsemble:
    """Fit on at most ``max_rows`` labelled documents, those with the smallest id hashes.

    Rows with a null id or label don't count; an id with several labels has the largest,
    one with several texts counts once, with the text of the smallest hash.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    sample = labels.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "_label").agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = with_statistics(rows.select("doc_id", "_label", "t.text")).select("doc_id", "_label", "stats").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["stats"].tolist(), float).reshape(len(rows), len(STATISTICS))
    return fit(x, rows["_label"].to_numpy())


def classify(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted``.

    Null and empty texts have all statistics 0 and a score like any other.  Own
    columns of these two names are replaced, all others are kept.  Repeated rows
    stay; an empty table gives an empty one.  Texts are handled whole, in blocks.
    """
    docs = docs.drop("score", "predicted")
    stats = textkit.free_name(docs, "stats")
    scored = with_statistics(docs, stats).withColumn("score", model.column(F.col(stats))).drop(stats)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
