"""Cluster bootstrap, paired differences and baselines.

A draw of a Poisson bootstrap gives every cluster a weight, how often it is taken, from
a hash of seed, draw and cluster: the same in every run, partitioning and engine.  A
weight needs nothing but its own row, so draws are sums over the clusters' rows:
no picks are made, numbered or joined, and what is shuffled is a row for each draw and
bin of a task.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondera.functions import scores as S

METRICS = ("accuracy", "nll", "brier")
#: A prime; hashes of clusters and draws are numbers below it, so that a product of two has 62 bits.
PRIME = (1 << 31) - 1
#: Hashes from the k-th threshold on are weights of over k: the Poisson distribution of mean 1 (fixed values).
THRESHOLDS = [int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(11)]


def draw_factors(seed: int, draw: int) -> tuple[int, int, int]:
    """``a, b, c`` of a draw's hash ``a x + b y + c`` modulo ``PRIME``; a and b aren't 0."""
    h = hashlib.md5(f"{seed}:{draw}".encode()).hexdigest()
    a, b, c = (int(h[k : k + 8], 16) for k in (0, 8, 16))
    return a % (PRIME - 1) + 1, b % (PRIME - 1) + 1, c % PRIME


def cluster_numbers(cluster: Column) -> tuple[Column, Column]:
    """Two numbers below ``PRIME`` of a cluster's name; a null one counts as ''."""
    h = F.md5(F.coalesce(cluster.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(h, at, 8), 16, 10).cast("long") % PRIME for at in (1, 9))


def poisson(hashed: Column) -> Column:
    """The weight of a hash."""
    out = F.lit(len(THRESHOLDS))
    for k, t in reversed(list(enumerate(THRESHOLDS))):
        out = F.when(hashed < t, k).otherwise(out)
    return out


def draws(rows: DataFrame, *, samples: int, seed: int, ece: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """``draw`` and the metrics of each resample of ``cluster, hit, nll, brier, confidence`` rows, in all or by keys; none with fewer than two clusters.

    Groups by keys are resampled in one pass, each draw with the same clusters in all of them.
    Weights of any two clusters are independent, and a draw's metrics are weighted
    means, so their mean and spread are those of picking clusters with
    replacement up to terms of one over the number of clusters: the sum of weights
    varies (by its root, relatively) where picks are a fixed number, and a draw in
    which no cluster has weight, of probability ``exp(-clusters)``, isn't there.
    """
    sums = ("n", "hit", "nll", "brier", "confidence")
    x, y = cluster_numbers(F.col("cluster"))
    per = rows.groupBy(*by, x.alias("x"), y.alias("y"), S.confidence_bin(F.col("confidence")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums[1:]])
    factors = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("abc", draw_factors(seed, d), strict=True)]) for d in range(max(samples, 0))]).cast("array<struct<a:bigint,b:bigint,c:bigint>>")
    hashed = lambda f: (f["a"] * F.col("x") + f["b"] * F.col("y") + f["c"]) % PRIME
    taken = per.select(*by, "x", "y", "bin", *sums, F.posexplode(F.transform(factors, lambda f: poisson(hashed(f)))).alias("draw", "w"))
    drawn = taken.groupBy(*by, "draw", "bin").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in sums], *[f(F.col(c)).alias(f"{k}{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max))])
    mean = lambda c: F.sum(c) / F.sum("n")
    out = [mean("hit").alias("accuracy"), mean("nll").alias("nll"), mean("brier").alias("brier")] + [(F.sum(F.abs(F.col("confidence") - F.col("hit"))) / F.sum("n")).alias("ece")] * ece
    several = (F.min("lox") < F.max("hix")) | (F.min("loy") < F.max("hiy"))
    found = drawn.groupBy(*by, "draw").agg(*out, (several & (F.sum("n") > 0)).alias("_several"))
    return found.where("_several").drop("_several")


def intervals(drawn: DataFrame, *by: str) -> DataFrame:
    """``metric, lower, upper``: 2.5 and 97.5 percentiles, in all or by keys; empty with fewer than two clusters or no draws."""
    names = [c for c in drawn.columns if c != "draw" and c not in by]
    one = drawn.groupBy(*by).agg(*[F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(c) for c in names])
    rows = one.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("q")) for c in names])).alias("m"))
    return rows.where("m.q is not null").select(*by, "m.metric", F.col("m.q")[0].alias("lower"), F.col("m.q")[1].alias("upper"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metric differences b - a of the same examples: ``id, cluster, hit, nll, brier, confidence`` (confidence 0).

    Both tables must hold the same ids with the same label, number of scores and, as
    far as both have them, ``ids``, ``candidates``, ``texts`` and ``fen``: an id that one
    lacks, or that differs, fails the query.
    """
    x, y = a.alias("x"), b.alias("y")
    same = F.col("x.label").eqNullSafe(F.col("y.label")) & (F.size("x.scores") == F.size("y.scores"))
    for c in ("ids", "candidates", "texts", "fen"):
        if c in a.columns and c in b.columns:
            same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    joined = x.join(y, F.col("x.id") == F.col("y.id"), "full")
    checked = joined.where(F.when(F.coalesce(same & F.col("x.id").isNotNull() & F.col("y.id").isNotNull(), F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("examples do not match"))))
    return checked.select("x.id", "x.cluster", *[(F.col(f"y.{c}") - F.col(f"x.{c}")).alias(c) for c in ("hit", "nll", "brier")], F.lit(0.0).alias("confidence"))


def uniform_predictions(tasks: DataFrame) -> DataFrame:
    """All scores 0."""
    return tasks.withColumn("scores", F.transform("ids", lambda i: F.lit(0.0)))


def text_prior(train: DataFrame, tasks: DataFrame) -> DataFrame:
    """Scores ln(1 + how often the candidate's text was chosen in training).

    ``train``: ``texts, label``; ``tasks``: ``id, texts`` and others.  Counts and
    candidates meet in an equi-join on the text.
    """
    counts = train.where("label is not null").groupBy(F.get("texts", F.col("label")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    flat = tasks.select("id", F.posexplode("texts").alias("pos", "text"))
    scored = flat.join(counts, "text", "left").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.ln(F.coalesce("n", F.lit(0)) + F.lit(1.0)).alias("s")))), lambda e: e["s"]).alias("scores"))
    return tasks.drop("scores").join(scored, "id")


def sampled_choice(rows: DataFrame, seed: str, temperature: float) -> DataFrame:
    """Add ``drawn``, a candidate position drawn by sharpened probabilities and a hash of the row's id."""
    weights = S.sharpened(F.col("probabilities"), temperature)
    return rows.withColumn("drawn", S.draw(weights, S.hashed_uniform(F.lit(seed), F.col("id").cast("string"))))
