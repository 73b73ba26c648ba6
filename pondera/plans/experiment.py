"""The batch experiment: train heads, choose one on validation, calibrate, and report on test.

Splits are DataFrames ``id, context, options, label, ids, texts, fingerprint, group_id``.
Leakage is checked before anything is trained, and the choice is on disk before
calibration or test data is read.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondera.functions import text as X
from pondera.operators import metrics, resample, scorers, tasks
from pondera.operators.calibration import Calibrator
from pondera.sources import sinks
from pondera.sources.readers import SPLITS, Experiment


def report_tables(rows: DataFrame, *, samples: int, seed: int) -> dict[str, DataFrame]:
    """Summary, reliability, selective risk, strata and intervals of metric rows with a ``cluster``."""
    return {
        "summary": metrics.summarize(rows), "reliability": metrics.reliability(rows), "selective": metrics.selective(rows), "strata": metrics.strata(rows, "n_candidates"),
        "intervals": resample.intervals(resample.draws(rows, samples=samples, seed=seed)),
    }


def with_cluster(rows: DataFrame) -> DataFrame:
    """A row's group, or the row itself without one; the kinds can't collide."""
    return rows.withColumn("cluster", F.when(F.col("group_id").isNotNull(), F.concat(F.lit("group:"), F.col("group_id"))).otherwise(F.concat(F.lit("example:"), F.col("id").cast("string"))))


def refuse_existing(path: str | Path) -> None:
    if os.path.exists(path):
        raise FileExistsError(f"output already exists: {path}")


def run(settings: Experiment, splits: dict[str, DataFrame]) -> dict:
    """Run all trials and write ``selection.json``, ``metrics.json``, ``report.md``, heads, calibrators and predictions."""
    if set(splits) != set(SPLITS):
        raise ValueError("four splits are required")
    refuse_existing(settings.out)
    tasks.require_disjoint(tasks.provenance(splits))
    out = Path(settings.out)
    out.mkdir(parents=True)
    heads, trials = [], []
    for i, weight in enumerate(settings.brier_weights):
        head, history = scorers.train_attention(splits["train"], splits["validation"], rank=settings.rank, epochs=settings.epochs, batch_size=settings.batch_size, lr=settings.lr, seed=settings.seed, brier_weight=weight, selection=settings.selection)
        sinks.write_artifact(out / f"trial{i}", head, {"brier_weight": weight, "history": history}, {"rank": settings.rank, "trial": i})
        found = metrics.summarize(metrics.metric_rows(scorers.score_attention(splits["validation"], head))).first().asDict()
        heads.append(head)
        trials.append({"trial": i, "brier_weight": weight, "validation": found})
    chosen = min(trials, key=lambda t: (t["validation"][settings.selection], t["trial"]))["trial"]
    sinks.write_document({"selected": chosen, "metric": settings.selection, "trials": trials}, out / "selection.json")

    keys = tasks.provenance({"calibration": splits["calibration"]})
    sections: dict[str, DataFrame | str] = {"selection": f"trial {chosen} by {settings.selection}"}
    result: dict = {"selected": chosen, "trials": trials}
    for t in trials:
        i, artifact = t["trial"], f"trial{t['trial']}"
        score = lambda df, h=heads[i], a=artifact: scorers.score_attention(df, h).withColumn("artifact_id", F.lit(a))
        test = with_cluster(score(splits["test"]))
        test.select("id", "ids", "scores", "label", "artifact_id").write.mode("errorifexists").json(str(out / f"{artifact}-test-predictions"))
        temperatures = {"raw": 1.0}
        for kind in ("nll", "brier"):
            c = Calibrator.fit(score(splits["calibration"]), artifact, kind=kind, bounds=settings.temperature_bounds, provenance={"keys_sha256": tasks.table_digest(keys, "kind", "key")})
            c.save(str(out / f"{artifact}-{kind}.json"), keys)
            temperatures[kind] = c.temperature
        t["test"] = {}
        for mode, temperature in temperatures.items():
            tables = report_tables(metrics.metric_rows(test, temperature=temperature), samples=settings.bootstrap_samples, seed=settings.bootstrap_seed)
            t["test"][mode] = {"temperature": temperature, **tables["summary"].first().asDict(), "intervals": [r.asDict() for r in tables["intervals"].collect()]}
            sections |= {f"{artifact} {mode}: {k}": v for k, v in tables.items()}
    for name, scored in (("uniform", resample.uniform_predictions(splits["test"])), ("train_text_prior", resample.text_prior(splits["train"], splits["test"]))):
        result[name] = metrics.summarize(metrics.metric_rows(scored)).first().asDict()
    sinks.write_document(result, out / "metrics.json")
    sinks.write_report(out / "report.md", "Experiment", sections)
    return result


def variant_rows(predictions: DataFrame, temperatures: dict[str, float]) -> DataFrame:
    """Metric rows of all variants, raw and calibrated: ``variant, mode, temperature`` beside the metrics.

    A variant's temperature is a value in the row, so one scan serves all of them.  A
    variant without a temperature fails the query.
    """
    known = F.map_from_arrays(F.array(*[F.lit(n) for n in temperatures]), F.array(*[F.lit(float(t)) for t in temperatures.values()]))
    own = F.try_element_at(known, F.col("variant"))
    own = F.when(own.isNull(), F.raise_error(F.concat(F.lit("no calibrator of variant "), F.col("variant")))).otherwise(own)
    modes = F.array(F.struct(F.lit("raw").alias("mode"), F.lit(1.0).alias("t")), F.struct(F.lit("calibrated").alias("mode"), own.alias("t")))
    rows = predictions.select("*", F.explode(modes).alias("_m")).select("*", F.col("_m.mode").alias("mode"), F.col("_m.t").alias("temperature")).drop("_m")
    return metrics.metric_rows(rows, temperature=F.col("temperature"), tie="position")


def variant_strata(rows: DataFrame) -> DataFrame:
    """Summaries by ``variant, mode, stratum, value``: of all rows, by number of candidates, and by rating where there is one.  One pass."""
    parts = [("all", F.lit("all")), ("candidates", X.candidate_bucket(F.col("n_candidates")))]
    if "rating" in rows.columns:
        parts.append(("rating", F.when(F.col("rating").isNotNull(), X.rating_bucket(F.col("rating")))))
    split = rows.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("stratum"), v.cast("string").alias("value")) for k, v in parts])).alias("_s"))
    return metrics.summarize(split.where("_s.value is not null").select("*", "_s.stratum", "_s.value"), "variant", "mode", "stratum", "value")


def variant_differences(rows: DataFrame) -> DataFrame:
    """Rows ``comparison, id, cluster, hit, nll, brier, confidence``: calibrated minus raw of each variant, and each variant minus ``base`` in both modes.

    All variants must have the same ids with the same label, number of scores and, as far as they
    have them, candidates and positions: the versions of an id meet once, in one shuffle,
    and differences are taken in the row.
    """
    same = [c for c in ("label", "n_candidates", "candidates", "ids", "texts", "fen") if c in rows.columns]
    version = F.struct("variant", "mode", "hit", "nll", "brier")
    per = rows.groupBy("id").agg(F.min("cluster").alias("cluster"), F.collect_list(version).alias("v"), F.min(F.struct(*same)).alias("low"), F.max(F.struct(*same)).alias("high"))
    names = rows.agg(F.array_sort(F.collect_set("variant")).alias("names"))
    per = per.crossJoin(F.broadcast(names))  # one row, of the variants' names
    ok = F.col("low").eqNullSafe(F.col("high")) & (F.size("v") == 2 * F.size("names"))
    per = per.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("variants differ in example "), F.col("id").cast("string")))))
    key = lambda n, mode: F.concat(n, F.lit(f"/{mode}"))
    within = F.transform("names", lambda n: F.struct(key(n, "raw").alias("a"), key(n, "calibrated").alias("b")))
    others = F.when(F.array_contains("names", "base"), F.filter("names", lambda n: n != "base")).otherwise(F.array().cast("array<string>"))
    against = F.flatten(F.transform(others, lambda n: F.array(*[F.struct(F.lit(f"base/{m}").alias("a"), key(n, m).alias("b")) for m in ("raw", "calibrated")])))
    found = F.map_from_entries(F.transform("v", lambda v: F.struct(F.concat(v["variant"], F.lit("/"), v["mode"]), v)))
    pairs = per.select("id", "cluster", found.alias("v"), F.explode(F.concat(within, against)).alias("c"))
    difference = [(F.element_at("v", F.col("c.b"))[m] - F.element_at("v", F.col("c.a"))[m]).alias(m) for m in ("hit", "nll", "brier")]
    return pairs.select(F.concat("c.b", F.lit(" minus "), "c.a").alias("comparison"), "id", "cluster", *difference, F.lit(0.0).alias("confidence"))


def analyze_variants(predictions: DataFrame, clusters: DataFrame, temperatures: dict[str, float], *, samples: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
    """Tables of saved predictions with ``variant``, raw and by each one's own temperature: ``summary``, ``strata``, ``intervals``, ``differences`` and ``baseline``.

    ``differences`` are intervals of paired differences, calibrated against raw within a variant and
    ``base`` against the others.  Every table is one pass over all variants and modes.
    """
    if not temperatures or samples < 0:
        raise ValueError("variants and a number of draws are needed")
    rows = variant_rows(predictions.join(clusters, "id"), temperatures)
    found = variant_strata(rows)
    first = predictions.where(F.col("variant") == min(temperatures))
    return {
        "summary": found.where("stratum = 'all'").drop("stratum", "value"), "strata": found.where("stratum <> 'all'"),
        "intervals": resample.intervals(resample.draws(rows, samples=samples, seed=seed, ece=False, by=("variant", "mode")), "variant", "mode"),
        "differences": resample.intervals(resample.draws(variant_differences(rows), samples=samples, seed=seed, ece=False, by=("comparison",)), "comparison"),
        "baseline": metrics.uniform_baseline(first),
    }
