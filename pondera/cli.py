"""Commands over files: score, eval, bench, convert, check-tasks, split, calibrate, report, benchmark, systemone, experiment,
features, train, fit-calibrator, predict, eval-head, check and serve."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondera.functions import scores as S
from pondera.functions import text as X
from pondera.operators import calibration, decision, metrics, scorers, splits, systemone, tasks
from pondera.plans.experiment import analyze_variants, refuse_existing, run
from pondera.plans.scratch import Scratch
from pondera.serve import make_server
from pondera.sources import readers, sinks

LEGACY = "context string, options array<string>, label int"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pondera")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **options: dict) -> None:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        for o, kw in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", **kw)

    norm = {"choices": ["mean", "sum", "pmi"], "default": "mean"}
    number = lambda default: {"type": type(default), "default": default}
    files, model = {"nargs": "+", "help": "one or more files"}, {"required": True, "help": "module:function that loads the model"}
    add("score", "texts", "options", context={"required": True}, norm=norm)
    add("eval", "texts", rows={"required": True, **files}, options={}, norm=norm, limit=number(0))
    add("bench", "texts", "tasks", repeat=number(5))
    add("convert", "rows", "out", prefix={"default": "row"}, question={"default": "Which option?"}, options={})
    add("check-tasks", "first", "second", labelled={"action": "store_true"})
    add("calibrate", "predictions", objective={"choices": ["nll", "brier"], "default": "nll"})
    add("report", "predictions", "out", temperature=number(1.0))
    add("benchmark", "folder", "out", data={"help": "the test examples, to add their ratings and games"}, samples=number(1000), seed=number(42))
    add("split", "out", examples={"required": True, **files}, seed=number(42), require_game_metadata={"action": "store_true"})
    add("systemone", "texts", "requests")
    add("experiment", "settings", model={"help": "module:function that loads the model, where features must be extracted"})
    add("features", "out", tasks={"required": True, **files}, model=model, role={"default": "train"}, labelled={"action": "store_true"})
    add("train", "train", "validation", "out", model=model, rank=number(16), epochs=number(8), batch_size=number(64), seed=number(7), brier_weight=number(0.0), selection={"choices": ["top1", "nll", "brier"], "default": "top1"})
    add("fit-calibrator", "artifact", "out", tasks={"required": True, **files}, model=model, objective={"choices": ["nll", "brier"], "default": "nll"})
    add("predict", "artifact", "out", tasks={"required": True, **files}, model=model, calibrator={})
    add("eval-head", "artifact", tasks={"required": True, **files}, model=model, calibrator={})
    add("check", "texts", tasks={"required": True, **files}, tolerance=number(1e-9))
    add("serve", "texts", port=number(8000), api_key={})
    return p


def load_model(name: str) -> tuple[decision.Load, dict]:
    """A model's loader and signature by ``module:function``."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function), {"model": name}


def scoring_tasks(parsed: DataFrame) -> DataFrame:
    """Parsed tasks as scorers take them."""
    return parsed.select("id", X.render_context(F.col("state"), F.col("question")).alias("context"), F.transform("candidates", lambda c: c["text"]).alias("options"))


def benchmark(spark: SparkSession, folder: str, data: str | None, samples: int, seed: int) -> dict[str, DataFrame]:
    """Tables of a folder's saved variants, each by its own calibrator, enriched from the test examples if they are given."""
    saved, temperatures = readers.prediction_variants(spark, folder), readers.variant_temperatures(spark, folder)
    if data:
        saved = tasks.enrich(saved, readers.chess_examples(spark, data), ["rating", "game_id", "game_url", "puzzle_id"])
    saved = Scratch(spark, "variants").keep(saved, "saved")
    first = saved.where(F.col("variant") == min(temperatures)).select(F.col("id").alias("row"), "puzzle_id", "game_id", "game_url", "position")
    found = splits.clusters(first, splits.identity_keys(first)).select(F.col("row").alias("id"), "cluster")
    complete = first.agg(F.bool_and(X.game_identity(F.col("game_id"), F.col("game_url")).isNotNull()).alias("game_metadata_complete"))
    return analyze_variants(saved, found, temperatures, samples=samples, seed=seed) | {"metadata": complete}


def split_examples(rows: DataFrame, seed: int, require_metadata: bool) -> DataFrame:
    """Chess examples, the first of each position, with ``split``; a position with two golds fails, as does a row without a game if it must have one."""
    rows = rows.withColumn("row", F.col("id"))
    if require_metadata:
        known = X.game_identity(F.col("game_id"), F.col("game_url")).isNotNull()
        rows = rows.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no game is known of "), F.col("id")))))
    kept = tasks.require_no_conflict(tasks.keep_first(rows.withColumn("gold", S.at(F.col("candidates"), F.col("label"))), "position", "row", "gold"), "position")
    found = splits.clusters(rows, splits.identity_keys(rows))
    members = kept.select("row").join(found, "row")
    return kept.join(members.join(splits.group_split(members, seed=seed), "cluster").select("row", "split"), "row").drop("row", "gold", "removed", "conflict")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pondera").getOrCreate()
    show = lambda df: [print(json.dumps(r.asDict(True), ensure_ascii=False)) for r in df.collect()]
    given = lambda labelled=False: readers.tasks(spark, *a.tasks, labelled=labelled)
    if a.command in ("convert", "benchmark", "split", "features", "train", "fit-calibrator", "predict"):
        refuse_existing(a.out)
    model = scorers.train_bigrams(spark.read.text(a.texts).toDF("text")) if "texts" in a else None
    if a.command == "score":
        options = [r.option for r in readers.option_lines(spark, a.options).collect()]
        task = spark.createDataFrame([("0", a.context, options)], "id string, context string, options array<string>")
        spread = scorers.distributions(scorers.score_bigrams(task, model), norm=a.norm)
        show(spread.select(F.explode(F.arrays_zip("options", "scores", "probabilities")).alias("o")).select("o.*").orderBy(F.desc("scores")))
    elif a.command == "eval":
        rows = readers.json_lines(spark, a.rows, LEGACY).withColumn("n", F.monotonically_increasing_id())
        rows = tasks.first_rows(rows, "n", a.limit)
        if a.options:
            rows = tasks.or_fixed_options(rows, [r.option for r in readers.option_lines(spark, a.options).collect()])
        rows = rows.withColumn("id", F.col("n").cast("string"))
        spread = scorers.distributions(scorers.score_bigrams(rows, model), norm=a.norm).join(rows.select("id", "label"), "id")
        show(metrics.legacy_evaluation(spread.withColumn("seconds", F.lit(None).cast("double"))))
    elif a.command == "bench":
        rows = scoring_tasks(readers.tasks(spark, a.tasks)).persist()
        scoring = lambda f: lambda: f(rows, model).write.format("noop").mode("overwrite").save()
        times = [t for name, f in (("shared", scorers.score_bigrams), ("naive", scorers.score_naive)) for t in metrics.timed(name, scoring(f), a.repeat)]
        show(metrics.latency(spark.createDataFrame(times, "name string, seconds double")))
        rows.unpersist()
    elif a.command == "convert":
        rows = readers.numbered_lines(spark, a.rows).select("line", F.from_json("value", LEGACY).alias("r")).select("line", "r.*")
        if a.options:
            rows = tasks.or_fixed_options(rows, [r.option for r in readers.option_lines(spark, a.options).collect()])
        tasks.to_json(tasks.convert_legacy(rows, a.prefix, a.question)).write.text(a.out)
    elif a.command == "check-tasks":
        both = {n: readers.tasks(spark, p, labelled=a.labelled) for n, p in (("first", a.first), ("second", a.second))}
        tasks.require_disjoint(tasks.provenance(both))
        print(json.dumps({n: t.count() for n, t in both.items()}))
    elif a.command == "calibrate":
        print(json.dumps(calibration.fit_temperature(readers.saved_predictions(spark, a.predictions), kind=a.objective)))
    elif a.command == "report":
        rows = metrics.metric_rows(readers.saved_predictions(spark, a.predictions), temperature=a.temperature, tie="position")
        sinks.write_report(a.out, "Predictions", {"summary": metrics.summarize(rows), "reliability": metrics.reliability(rows), "selective": metrics.selective(rows, metrics.CHESS_COVERAGES)})
    elif a.command == "benchmark":
        sinks.write_report(a.out, "Variants", benchmark(spark, a.folder, a.data, a.samples, a.seed))
    elif a.command == "split":
        sinks.write_splits(split_examples(readers.chess_examples(spark, *a.examples), a.seed, a.require_game_metadata), a.out, ())
    elif a.command == "experiment":
        settings = readers.Experiment.load(a.settings)
        refuse_existing(settings.out)
        print(json.dumps(run(settings, decision.prepare(settings, spark, *(load_model(a.model) if a.model else ())))))
    elif a.command == "features":
        decision.write_cache(given(a.labelled), a.out, a.role, *load_model(a.model))
    elif a.command == "train":
        both = []
        for path in (a.train, a.validation):
            rows, meta = readers.features(spark, path)
            if meta.get("model") != a.model:
                raise ValueError(f"features of another model: {path}")
            both.append(rows)
        print(json.dumps(decision.train_artifact(*both, a.out, load_model(a.model)[1], rank=a.rank, epochs=a.epochs, batch_size=a.batch_size, seed=a.seed, brier_weight=a.brier_weight, selection=a.selection)))
    elif a.command == "fit-calibrator":
        found = decision.DecisionScorer(a.artifact, *load_model(a.model)).fit_calibrator(given(True), a.out, kind=a.objective)
        print(json.dumps({"temperature": found.temperature, "examples": found.examples, "calibrator_id": found.id}))
    elif a.command == "predict":
        scorer = decision.DecisionScorer(a.artifact, *load_model(a.model), calibrator=a.calibrator)
        sinks.write_lines(scorer.score_table(given()), a.out)
    elif a.command == "eval-head":
        scorer, parsed = decision.DecisionScorer(a.artifact, *load_model(a.model), calibrator=a.calibrator), given(True)
        scorer.require_unseen(parsed)
        features = Scratch(spark, "evaluate").keep(decision.extract(parsed, scorer.load), "features")
        show(decision.evaluate(features, scorer.head))
    elif a.command == "check":
        show(scorers.invariance(scoring_tasks(given()), lambda df: scorers.score_bigrams(df, model), tolerance=a.tolerance))
    elif a.command == "serve":
        make_server(model, a.port, a.api_key).serve_forever()
    elif a.command == "systemone":
        requests = spark.read.text(a.requests).select(F.get_json_object("value", "$.id").alias("request_id"), F.get_json_object("value", "$.state").alias("state"), F.get_json_object("value", "$.questions").alias("questions"))
        requests = requests.withColumn("state", F.when(F.try_parse_json("state").isNotNull() & ~F.col("state").rlike(r"^-?\d"), F.col("state")).otherwise(F.regexp_replace(F.to_json(F.struct("state")), r'(?s)^\{"state":(.*)\}$', "$1")))
        show(systemone.responses(systemone.system_one(systemone.explode_requests(requests), model)))
    if model:
        model.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
