"""Column functions over one task's ``scores`` array.

A task is one row with ragged arrays, so distributions, choices and losses are
row-local expressions: no explode, no window, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def valid_scores(scores: Column) -> Column:
    """Not empty, and no null, NaN or infinity."""
    finite = F.forall(scores, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(scores) > 0) & finite, F.lit(False))


def softmax(scores: Column, temperature: Column | float = 1.0) -> Column:
    t = F.lit(temperature) if not isinstance(temperature, Column) else temperature
    return let(F.array_max(scores), lambda m: let(F.transform(scores, lambda x: F.exp((x - m) / t)), lambda e: let(total(e), lambda z: F.transform(e, lambda v: v / z))))


def log_softmax(scores: Column, temperature: Column | float = 1.0) -> Column:
    t = F.lit(temperature) if not isinstance(temperature, Column) else temperature
    shifted = lambda m: F.transform(scores, lambda x: (x - m) / t)
    return let(F.array_max(scores), lambda m: let(shifted(m), lambda s: let(F.ln(total(F.transform(s, F.exp))), lambda z: F.transform(s, lambda v: v - z))))


def nll(scores: Column, label: Column, temperature: Column | float = 1.0) -> Column:
    """Negative log-likelihood of the label's score; stays exact where its probability underflows."""
    t = F.lit(temperature) if not isinstance(temperature, Column) else temperature
    return let(F.array_max(scores), lambda m: F.ln(total(F.transform(scores, lambda x: F.exp((x - m) / t)))) + (m - at(scores, label)) / t)


def brier(probabilities: Column, label: Column) -> Column:
    """Sum over candidates of the squared error, from 0 to 2."""
    return total(F.transform(probabilities, lambda p: p * p)) - 2 * at(probabilities, label) + 1


def at(values: Column, position: Column) -> Column:
    """Entry at a 0-based position; null out of range."""
    return F.get(values, position)


def first_best(scores: Column) -> Column:
    """0-based position of the largest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def best_by_id(scores: Column, ids: Column) -> Column:
    """Id of the largest score, the smallest id of equals."""
    pairs = F.arrays_zip(scores.alias("s"), ids.alias("i"))
    return F.array_min(F.transform(F.filter(pairs, lambda p: p["s"] == F.array_max(scores)), lambda p: p["i"]))


def gold_rank(scores: Column, label: Column, ids: Column | None = None) -> Column:
    """0-based place of the label by descending score; ties by id, or by position without ids."""
    def ahead(g: Column, key: Column) -> Column:
        other = ids if ids is not None else F.transform(scores, lambda x, i: i)
        pairs = F.arrays_zip(scores.alias("s"), other.alias("k"))
        return F.size(F.filter(pairs, lambda p: (p["s"] > g) | ((p["s"] == g) & (p["k"] < key))))

    key = at(ids, label) if ids is not None else label
    return ahead(at(scores, label), key)


def competition_rank(values: Column, value: Column) -> Column:
    """1 + the number of strictly larger values."""
    return F.size(F.filter(values, lambda x: x > value)) + 1


def top_positions(scores: Column, k: int) -> Column:
    """0-based positions of the k largest scores, the first of equals first."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def certainty(probabilities: Column) -> Column:
    """1 - entropy / ln n, within 0 and 1; 1 for fewer than two."""
    n = F.size(probabilities)
    h = total(F.transform(probabilities, lambda p: F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))))
    return F.when(n < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + h / F.ln(n.cast("double")))))


def expected_level(probabilities: Column) -> Column:
    return total(F.transform(probabilities, lambda p, i: p * i))


def yes_probability(probabilities: Column) -> Column:
    return at(probabilities, F.lit(0))


def confidence_bin(confidence: Column) -> Column:
    """0 to 9; bins are closed on the left, and 1.0 is in the last."""
    return F.least(F.lit(9), F.floor(confidence * 10).cast("int"))


def normalised(norm: str, log_sum: Column, n_tokens: Column, unconditional: Column | None = None) -> Column:
    """A candidate's score by norm: mean, sum, or pmi (sum less the unconditional sum)."""
    if norm == "mean":
        return log_sum / n_tokens
    if norm == "sum":
        return log_sum
    if norm == "pmi" and unconditional is not None:
        return log_sum - unconditional
    raise ValueError(f"unknown norm {norm!r}, or pmi without unconditional scores")


def sharpened(probabilities: Column, temperature: float) -> Column:
    """Weights ``max(p, 1e-9) ** (1 / T)`` for a draw; at T <= 0 all weight is on the first best."""
    if temperature <= 0:
        return let(first_best(probabilities), lambda b: F.transform(probabilities, lambda p, i: F.when(i == b, F.lit(1.0)).otherwise(F.lit(0.0))))
    return F.transform(probabilities, lambda p: F.pow(F.greatest(p, F.lit(1e-9)), F.lit(1 / temperature)))


def draw(weights: Column, uniform: Column) -> Column:
    """0-based position where the running sum of weights passes ``uniform`` (in [0, 1)) of their total."""
    sums = F.aggregate(weights, F.array().cast("array<double>"), lambda a, w: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + w)))
    return let(sums, lambda s: F.least(F.size(F.filter(s, lambda x: x <= uniform * F.element_at(s, -1))), F.size(s) - 1))


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from an MD5 of the parts joined by colons: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def norm2(vector: Column) -> Column:
    return F.sqrt(total(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def one_score(norm: str, n_tokens: int, log_sum: float, unconditional: float) -> float:
    """``normalised`` of plain numbers."""
    return {"mean": log_sum / n_tokens, "sum": log_sum, "pmi": log_sum - unconditional}[norm]


def one_softmax(scores: list[float]) -> list[float]:
    """``softmax`` of plain numbers."""
    top = max(scores)
    e = [math.exp(s - top) for s in scores]
    return [v / sum(e) for v in e]
