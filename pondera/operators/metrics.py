"""Choices, losses and evaluation tables over predictions.

A prediction is a row ``id, scores array<double>, label int`` (0-based; null when
unlabelled), with ``ids array<string>`` where ties go by candidate id.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondera.functions import scores as S
from pondera.operators.prefix import running_sums

COVERAGES = (0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
CHESS_COVERAGES = (0.25, 0.5, 0.75, 1.0)


def require_valid(predictions: DataFrame) -> DataFrame:
    """Fail the query at the first row with scores that are empty or not finite, or a label out of range."""
    bad = ~S.valid_scores(F.col("scores")) | F.coalesce((F.col("label") < 0) | (F.col("label") >= F.size("scores")), F.lit(False))
    return predictions.where(F.when(bad, F.raise_error(F.concat(F.lit("invalid scores or label: "), F.col("id").cast("string")))).otherwise(F.lit(True)))


def decide(predictions: DataFrame, *, temperature: Column | float = 1.0, tie: str = "id") -> DataFrame:
    """Add ``probabilities``, ``best`` (0-based), ``choice`` (with ids) and ``confidence``.

    ``tie`` is "id" (smallest candidate id) or "position" (first).  Confidence is
    the probability of the chosen candidate.
    """
    if tie not in ("id", "position"):
        raise ValueError("tie must be id or position")
    out = predictions.withColumn("probabilities", S.softmax(F.col("scores"), temperature))
    if tie == "id":
        out = out.withColumn("choice", S.best_by_id(F.col("scores"), F.col("ids")))
        out = out.withColumn("best", (F.array_position("ids", F.col("choice")) - 1).cast("int"))
    else:
        out = out.withColumn("best", S.first_best(F.col("scores")))
        if "ids" in predictions.columns:
            out = out.withColumn("choice", F.get("ids", F.col("best")))
    return out.withColumn("confidence", F.get("probabilities", F.col("best")))


def metric_rows(predictions: DataFrame, *, temperature: Column | float = 1.0, tie: str = "id") -> DataFrame:
    """Each labelled row with ``n_candidates, hit, top3, gold_rank, nll, brier, confidence``."""
    decided = decide(predictions.where("label is not null"), temperature=temperature, tie=tie)
    ids = F.col("ids") if tie == "id" else None
    return decided.withColumns({
        "n_candidates": F.size("scores"),
        "hit": (F.col("best") == F.col("label")).cast("double"),
        "gold_rank": S.gold_rank(F.col("scores"), F.col("label"), ids),
        "nll": S.nll(F.col("scores"), F.col("label"), temperature),
        "brier": S.brier(F.col("probabilities"), F.col("label")),
    }).withColumn("top3", (F.col("gold_rank") < 3).cast("double"))


def summarize(rows: DataFrame, *keys: str) -> DataFrame:
    """``n, accuracy, top3, nll, brier, ece, chance_accuracy`` of metric rows, in all or by keys.

    One pass: rows are summed by keys and confidence bin, and the ten bins by keys.
    No rows give no result row by keys, and nulls with n = 0 in all.
    """
    bins = rows.groupBy(*keys, S.confidence_bin(F.col("confidence")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("hit", "top3", "nll", "brier", "confidence")], F.sum(1 / F.col("n_candidates")).alias("chance")
    )
    mean = lambda c: F.sum(c) / F.sum("n")
    return bins.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), mean("hit").alias("accuracy"), mean("top3").alias("top3"), mean("nll").alias("nll"), mean("brier").alias("brier"),
        (F.sum(F.abs(F.col("confidence") - F.col("hit"))) / F.sum("n")).alias("ece"), mean("chance").alias("chance_accuracy"),
    )


def reliability(rows: DataFrame) -> DataFrame:
    """All ten confidence bins: ``bin, lower, upper, n, confidence, accuracy`` (means null in empty ones)."""
    seen = rows.groupBy(S.confidence_bin(F.col("confidence")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg("hit").alias("accuracy"))
    every = rows.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return every.join(seen, "bin", "left").select("bin", (F.col("bin") / 10).alias("lower"), ((F.col("bin") + 1) / 10).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy")


def selective(rows: DataFrame, coverages: tuple[float, ...] = COVERAGES) -> DataFrame:
    """Risk at each requested coverage: ``requested_coverage, threshold, coverage, n, error``.

    The threshold is the confidence at rank ceil(coverage * n), and all its ties are
    accepted.  Equal confidences are summed first; running sums of the distinct ones go
    over ranges cut at sampled confidences, so they spread over all tasks however
    close to 1 they crowd.
    """
    steps = rows.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hit"))
    run = running_sums(steps, "confidence", sums={"n": "upto", "hit": "hits"}, descending=True)
    run = run.crossJoin(F.broadcast(run.agg(F.max("upto").alias("all"))))  # one row
    asked = F.explode(F.array(*[F.lit(float(c)) for c in coverages])).alias("requested_coverage")
    need = run.select("*", asked).where((F.col("upto") >= F.ceil(F.col("requested_coverage") * F.col("all"))) & (F.col("upto") - F.col("n") < F.ceil(F.col("requested_coverage") * F.col("all"))))
    return need.select("requested_coverage", F.col("confidence").alias("threshold"), (F.col("upto") / F.col("all")).alias("coverage"), F.col("upto").alias("n"), (1 - F.col("hits") / F.col("upto")).alias("error"))


def strata(rows: DataFrame, *keys: str) -> DataFrame:
    """``summarize`` by each key alone, in one pass over the rows: ``stratum, value`` and the metrics."""
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("stratum"), F.col(k).cast("string").alias("value")) for k in keys]))
    split = rows.select("*", parts.alias("_s")).where("_s.value is not null").select("*", "_s.stratum", "_s.value")
    return summarize(split, "stratum", "value")


def uniform_baseline(rows: DataFrame) -> DataFrame:
    """Expected accuracy, loss and Brier score of an even guess."""
    n = F.size("scores").cast("double")
    return rows.agg(F.avg(1 / n).alias("expected_accuracy"), F.avg(F.ln(n)).alias("nll"), F.avg(1 - 1 / n).alias("brier"))


def legacy_evaluation(predictions: DataFrame) -> DataFrame:
    """``examples, labelled, top1, top3`` over labelled rows (null if none), ``median_seconds, mean_seconds``; ties by position."""
    rank = S.gold_rank(F.col("scores"), F.col("label"))
    ok = F.col("label").isNotNull()
    return predictions.agg(
        F.count(F.lit(1)).alias("examples"), F.count("label").alias("labelled"), F.avg(F.when(ok, (rank < 1).cast("double"))).alias("top1"),
        F.avg(F.when(ok, (rank < 3).cast("double"))).alias("top3"), F.median("seconds").alias("median_seconds"), F.avg("seconds").alias("mean_seconds"),
    )


def rank_evaluation(predictions: DataFrame) -> DataFrame:
    """``n, top1, top3, mean_rank`` (0-based; a single candidate has rank 0) and ``chance``."""
    rank = S.gold_rank(F.col("scores"), F.col("label"))
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.avg((rank < 1).cast("double")).alias("top1"), F.avg((rank < 3).cast("double")).alias("top3"), F.avg(rank).alias("mean_rank"), F.avg(1 / F.size("scores")).alias("chance"))


def generation_evaluation(answers: DataFrame) -> DataFrame:
    """``n, legal_rate, correct_rate`` of generated texts against candidates and gold."""
    text = F.trim("generated")
    return answers.agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_contains("candidates", text).cast("double")).alias("legal_rate"), F.avg((text == F.col("gold")).cast("double")).alias("correct_rate"))


def move_quality(predictions: DataFrame, references: DataFrame, tolerance: float) -> DataFrame:
    """Engine agreement of the chosen moves.

    ``predictions``: ``fen, candidates, scores``; ``references``: ``fen, move, cp`` (null for a
    mate) and ``rank``.  The loss counts only where every move of the position has a cp.
    """
    judged = references.groupBy("fen").agg(F.max("cp").alias("best_cp"), F.bool_and(F.col("cp").isNotNull()).alias("all_cp"))
    chosen = predictions.withColumn("move", F.get("candidates", S.first_best(F.col("scores"))))
    rows = chosen.join(references, ["fen", "move"]).join(judged, "fen")
    loss = F.when(F.col("all_cp"), F.col("best_cp") - F.col("cp"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count(loss).alias("cp_n"), F.count(F.when(~F.col("all_cp"), 1)).alias("mate_positions"), F.avg(loss).alias("mean_cp_loss"),
        F.avg((loss <= tolerance).cast("double")).alias("within_tolerance_rate"), F.avg((F.col("rank") == 1).cast("double")).alias("engine_best_match_rate"), F.avg("rank").alias("mean_rank"),
    )


def missing_references(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Candidate moves that the references lack; must be empty before ``move_quality``."""
    return predictions.select("fen", F.explode("candidates").alias("move")).distinct().join(references, ["fen", "move"], "left_anti")


def latency(runs: DataFrame) -> DataFrame:
    """``name, runs, median_seconds, min_seconds`` of timed runs ``name, seconds``, and each median's ratio to the fastest."""
    per = runs.groupBy("name").agg(F.count(F.lit(1)).alias("runs"), F.median("seconds").alias("median_seconds"), F.min("seconds").alias("min_seconds"))
    best = per.agg(F.min("median_seconds").alias("_best"))
    return per.crossJoin(F.broadcast(best)).withColumn("ratio", F.col("median_seconds") / F.col("_best")).drop("_best")


def timed(name: str, run: Callable[[], object], repeat: int) -> list[tuple[str, float]]:
    """``name, seconds`` of a few runs after a warm one, for ``latency``."""
    run()
    out = []
    for _ in range(repeat):
        began = time.perf_counter()
        run()
        out.append((name, time.perf_counter() - began))
    return out
