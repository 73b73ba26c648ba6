"""Analytic values of the metrics, calibration and resampling."""

import math

import pytest
from pondera.operators import calibration, metrics, resample
from pyspark.sql import functions as F

SCHEMA = "id string, ids array<string>, scores array<double>, label int"


def preds(spark, rows):
    return spark.createDataFrame([(f"t{i:03}", ids, [float(s) for s in scores], label) for i, (ids, scores, label) in enumerate(rows)], SCHEMA)


def summary(df, **kw):
    return metrics.summarize(metrics.metric_rows(df, **kw)).first()


def test_extreme_scores_keep_an_exact_loss(spark):
    r = summary(preds(spark, [(["a", "b"], [-1000, 1000], 0)]))
    assert (r.n, r.accuracy, r.nll, r.brier, r.ece) == (1, 0, 2000, 2, 1)


def test_known_distribution(spark):
    s = [math.log(0.8), math.log(0.2)]
    r = summary(preds(spark, [(["a", "b"], s, 0)] * 8 + [(["a", "b"], s, 1)] * 2))
    assert r.accuracy == pytest.approx(0.8) and r.brier == pytest.approx(0.32) and r.ece == pytest.approx(0, abs=1e-12) and r.chance_accuracy == 0.5


def test_ties_go_by_id_or_position(spark):
    df = preds(spark, [(["z", "a", "m"], [1, 1, 0], 0)])
    assert metrics.decide(df).first().choice == "a"
    assert metrics.decide(df, tie="position").first().best == 0
    assert metrics.metric_rows(df).first().gold_rank == 1
    assert metrics.metric_rows(df, tie="position").first().gold_rank == 0


def test_candidate_order_does_not_matter(spark):
    a = summary(preds(spark, [(["a", "b", "c"], [1, 2, 0.5], 1), (["a", "b", "c"], [0, 0, 0], 2)]))
    b = summary(preds(spark, [(["c", "b", "a"], [0.5, 2, 1], 1), (["b", "c", "a"], [0, 0, 0], 1)]).repartition(3))
    assert a.asDict() == pytest.approx(b.asDict())


def test_invalid_scores_fail(spark):
    for scores, label in (([1, float("nan")], 0), ([], None), ([1, 2], 2)):
        with pytest.raises(Exception, match="invalid scores"):
            metrics.require_valid(preds(spark, [(["a", "b"], scores, label)])).collect()


def test_empty_table(spark):
    df = preds(spark, [])
    assert summary(df).n == 0 and metrics.selective(metrics.metric_rows(df)).count() == 0
    assert [r.n for r in metrics.reliability(metrics.metric_rows(df)).collect()] == [0] * 10


def test_selective_keeps_all_ties(spark):
    rows = metrics.metric_rows(preds(spark, [(["a", "b"], [1, 0], 0)] * 4 + [(["a", "b"], [1, 0], 1)] * 4))
    got = metrics.selective(rows).collect()
    assert len(got) == 6 and all(r.coverage == 1 and r.n == 8 and r.error == 0.5 for r in got)


def test_temperature_optimum(spark):
    rows = [(["a", "b"], [math.log(4), 0], 1 if i % 4 == 0 else 0) for i in range(100)]
    df = preds(spark, rows)
    t = calibration.fit_temperature(df)
    assert t["temperature"] == pytest.approx(math.log(4) / math.log(3), abs=1e-5) and not t["at_bound"]
    r = summary(df, temperature=t["temperature"])
    assert r.brier == pytest.approx(0.375, abs=1e-6) and r.ece == pytest.approx(0, abs=1e-5)
    assert calibration.fit_temperature(df, kind="brier")["temperature"] == pytest.approx(math.log(4) / math.log(3), abs=1e-4)


def test_flat_scores_and_bounds(spark):
    assert calibration.fit_temperature(preds(spark, [(["a", "b"], [1, 1], 0)]))["temperature"] == 1
    t = calibration.fit_temperature(preds(spark, [(["a", "b"], [4, 0], 0)]), bounds=(0.5, 2.0))
    assert t["temperature"] == 0.5 and t["at_bound"]
    for bad in ((0.0, 2.0), (2.0, 3.0), (1.0, 1.0)):
        with pytest.raises(ValueError):
            calibration.fit_temperature(preds(spark, []), bounds=bad)


def test_calibrator_is_bound_and_applies_once(spark, tmp_path):
    df = preds(spark, [(["a", "b"], [2, 0], i % 3 and 1 or 0) for i in range(30)]).withColumn("artifact_id", F.lit("x"))
    c = calibration.Calibrator.fit(df, "x")
    c.save(str(tmp_path / "c.json"))
    assert calibration.Calibrator.load(str(tmp_path / "c.json"), "x") == c
    with pytest.raises(ValueError):
        calibration.Calibrator.load(str(tmp_path / "c.json"), "y")
    c.require_predictions(df.repartition(3))
    for other in (df.limit(29), df.union(df.limit(1)), df.withColumn("scores", F.reverse("scores"))):
        with pytest.raises(ValueError, match="other predictions"):
            c.require_predictions(other)
    assert c.examples == 30 and c.split == "calibration"
    text = (tmp_path / "c.json").read_text()
    (tmp_path / "d.json").write_text(text.replace('"examples": 30', '"examples": 31'))
    with pytest.raises(ValueError, match="damaged"):
        calibration.Calibrator.load(str(tmp_path / "d.json"), "x")
    out = c.apply(df)
    assert out.first().raw_probabilities != out.first().probabilities
    for again in (lambda: c.apply(out), lambda: calibration.Calibrator.fit(out, "x"), lambda: calibration.Calibrator.fit(df, "y")):
        with pytest.raises(ValueError):
            again()


def clustered(spark):
    df = preds(spark, [(["a", "b"], [9, 0], 0)] * 4 + [(["a", "b"], [9, 0], 1)] * 4)
    return metrics.metric_rows(df).withColumn("cluster", F.substring("id", 2, 3).cast("int") < 4)


def test_bootstrap_of_two_groups(spark):
    rows = clustered(spark)
    a = resample.intervals(resample.draws(rows, samples=200, seed=7)).collect()
    b = resample.intervals(resample.draws(rows.repartition(5), samples=200, seed=7)).collect()
    assert sorted(a) == sorted(b)
    acc = next(r for r in a if r.metric == "accuracy")
    assert (acc.lower, acc.upper) == (0, 1)


def test_bootstrap_weights_are_poisson(spark):
    """Mean, spread and independence of the weights, and the interval against picking with replacement."""
    import numpy as np

    n, samples = 2000, 400
    x = spark.range(n).select(*[c.alias(k) for k, c in zip("xy", resample.cluster_numbers(F.col("id")), strict=True)])
    weights = []
    for d in range(60):
        a, b, c = resample.draw_factors(7, d)
        weights.append([r[0] for r in x.select(resample.poisson((a * F.col("x") + b * F.col("y") + c) % resample.PRIME)).collect()] if d < 12 else None)
    w = np.array([v for v in weights if v])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06 and abs(np.corrcoef(w)[np.triu_indices(len(w), 1)]).max() < 0.12
    rng = np.random.default_rng(1)
    hits = (rng.random(n) < 0.3).astype(float)
    rows = spark.createDataFrame([(i, float(h)) for i, h in enumerate(hits)], "cluster int, hit double").select("cluster", "hit", F.lit(0.0).alias("nll"), F.lit(0.0).alias("brier"), F.lit(0.5).alias("confidence"))
    got = {r.metric: r for r in resample.intervals(resample.draws(rows, samples=samples, seed=3)).collect()}["accuracy"]
    picked = np.quantile([hits[rng.integers(0, n, n)].mean() for _ in range(2000)], [0.025, 0.975])
    assert abs(got.lower - picked[0]) < 0.006 and abs(got.upper - picked[1]) < 0.006


def test_bootstrap_by_keys_draws_the_same_clusters(spark):
    rows = clustered(spark)
    both = rows.withColumn("k", F.lit("a")).unionByName(rows.withColumn("k", F.lit("b")))
    got = {(r.k, r.draw): r.accuracy for r in resample.draws(both, samples=30, seed=7, by=("k",)).collect()}
    one = {r.draw: r.accuracy for r in resample.draws(rows, samples=30, seed=7).collect()}
    assert one and got == {(k, d): v for k in "ab" for d, v in one.items()}
    assert resample.draws(rows, samples=0, seed=7).count() == 0


def test_one_cluster_has_no_interval(spark):
    rows = clustered(spark).withColumn("cluster", F.lit(1))
    assert resample.intervals(resample.draws(rows, samples=50, seed=7)).count() == 0


def test_paired_difference_is_certain(spark):
    wrong = metrics.metric_rows(preds(spark, [(["a", "b"], [0, 1], 0)] * 6)).withColumn("cluster", F.col("id"))
    right = metrics.metric_rows(preds(spark, [(["a", "b"], [1, 0], 0)] * 6)).withColumn("cluster", F.col("id"))
    acc = resample.intervals(resample.draws(resample.paired(wrong, right), samples=50, seed=42, ece=False)).where("metric = 'accuracy'").first()
    assert (acc.lower, acc.upper) == (1, 1)
    with pytest.raises(Exception, match="examples do not match"):
        resample.paired(wrong, right.limit(5)).collect()


def test_baselines(spark):
    tasks = spark.createDataFrame([("x", ["a", "b"], ["A", "B"], 0)], "id string, ids array<string>, texts array<string>, label int")
    train = spark.createDataFrame([(["A", "B"], 0)] * 3, "texts array<string>, label int")
    assert metrics.decide(resample.text_prior(train, tasks)).first().confidence == pytest.approx(0.8)
    assert metrics.decide(resample.uniform_predictions(tasks)).first().confidence == 0.5
    u = metrics.uniform_baseline(tasks.withColumn("scores", F.array(F.lit(0.0), F.lit(0.0)))).first()
    assert (u.expected_accuracy, u.brier) == (0.5, 0.5) and u.nll == pytest.approx(math.log(2))


def test_move_quality_leaves_mates_out(spark):
    p = spark.createDataFrame([("f1", ["a", "b"], [1.0, 0.0]), ("f2", ["a", "b"], [1.0, 0.0])], "fen string, candidates array<string>, scores array<double>")
    r = spark.createDataFrame([("f1", "a", 10.0, 2), ("f1", "b", 100.0, 1), ("f2", "a", None, 1), ("f2", "b", 5.0, 2)], "fen string, move string, cp double, rank int")
    q = metrics.move_quality(p, r, 50).first()
    assert (q.n, q.cp_n, q.mate_positions, q.mean_cp_loss, q.within_tolerance_rate, q.engine_best_match_rate, q.mean_rank) == (2, 1, 1, 90, 0, 0.5, 1.5)
    assert metrics.missing_references(p, r.where("move = 'a'")).count() == 2


def test_generation(spark):
    g = spark.createDataFrame([(" e4 ", ["e4", "d4"], "e4"), ("x", ["e4"], "e4")], "generated string, candidates array<string>, gold string")
    r = metrics.generation_evaluation(g).first()
    assert (r.legal_rate, r.correct_rate) == (0.5, 0.5)
