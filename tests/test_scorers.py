"""Scorers, typed questions, the attention head, the experiment, the commands and streams."""

import json
import math

import numpy as np
import pytest
from pondera import cli
from pondera.functions import scores as S
from pondera.operators import metrics, scorers, systemone
from pondera.plans import experiment
from pondera.sources import readers, sinks
from pondera.streaming import decisions
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def model(spark):
    return scorers.train_bigrams(spark.createDataFrame([("the cat sat on the mat",), ("the dog sat",), (None,), ("",)], "text string"))


def tasks(spark, options=("cat", "the dog", "xyz"), context="on the"):
    return spark.createDataFrame([("t", context, list(options)), ("u", "", list(options))], "id string, context string, options array<string>")


def test_shared_scoring_equals_naive(spark, model):
    for unit in ("word", "char"):
        m = scorers.train_bigrams(spark.createDataFrame([("abc abd",)], "text string"), unit=unit)
        a = {(r.id, r.pos): r.logprob_sum for r in scorers.score_bigrams(tasks(spark), m).collect()}
        b = {(r.id, r.pos): r.logprob_sum for r in scorers.score_naive(tasks(spark), m).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_bigram_value_and_norms(spark, model):
    r = {x.pos: x for x in scorers.score_bigrams(tasks(spark), model).where("id = 't'").collect()}
    assert r[0].logprob_sum == pytest.approx(math.log((1 + 0.5) / (3 + 0.5 * model.vocabulary))) and r[1].n_tokens == 2
    s = scorers.score_bigrams(tasks(spark), model)
    mean, total, pmi = (scorers.distributions(s, norm=n).where("id = 't'").first().scores for n in ("mean", "sum", "pmi"))
    assert mean[1] == pytest.approx(total[1] / 2) and pmi[0] == pytest.approx(total[0] - r[0].logprob_uncond)
    with pytest.raises(ValueError):
        scorers.distributions(s, norm="other")


def test_bad_options(spark, model):
    with pytest.raises(Exception, match="no token"):
        scorers.score_bigrams(tasks(spark, ("a", " ")), model).collect()
    with pytest.raises(Exception, match="two options"):
        scorers.distributions(scorers.score_bigrams(tasks(spark, ("a",)), model)).collect()


def test_forced_option_skips_the_model(spark, model):
    df = tasks(spark).union(spark.createDataFrame([("f", "c", ["only"])], "id string, context string, options array<string>"))
    got = scorers.score_with_forced(df, lambda d: scorers.distributions(scorers.score_bigrams(d, model))).where("id = 'f'").first()
    assert got.scores == [0] and got.probabilities == [1]


def test_outside_model(spark):
    got = scorers.score_with_model(tasks(spark), lambda: lambda context, options: [(1, -float(len(o)), 0.0) for o in options])
    assert scorers.distributions(got, norm="sum").first().scores == [-3, -7, -3]


QUESTIONS = {"pick": {"type": "choice", "instructions": "Which?", "criteria": {"dog": "a dog", "cat": None}}, "rate": {"type": "score", "criteria": ["low", None, {"x": 1}]}, "ok": {"type": "noul", "instructions": "Fine?", "criteria": {"true": "it is"}}}


def test_prompts_and_answers(spark, model):
    req = spark.createDataFrame([("r", '"hello"', json.dumps(QUESTIONS))], "request_id string, state string, questions string")
    q = systemone.explode_requests(req)
    p = {r.qid: r for r in systemone.render(q).collect()}
    assert p["pick"].prompt == "State:\nhello\n\nQuestion:\nWhich?\n\nChoose exactly one option.\nOptions:\n- dog: a dog\n- cat\n\nAnswer:\n" and p["pick"].labels == ["dog", "cat"]
    assert p["rate"].prompt.endswith('Levels:\n0: low\n1\n2: {\n  "x": 1\n}\n\nAnswer:\n') and p["rate"].labels == ["0", "1", "2"]
    assert p["ok"].prompt.endswith("Answer yes when:\nit is\n\nAnswer yes or no.\n\nAnswer:\n")
    got = systemone.responses(systemone.system_one(q, lambda d: scorers.score_bigrams(d, model))).first()
    assert got.answers["pick"].choice in ("dog", "cat") and 0 <= got.answers["rate"].score <= 2 and got.answers["ok"].noul == pytest.approx(0.5) and got.output_tokens == 7
    bad = spark.createDataFrame([("r", '"s"', json.dumps({"a": {"type": "choice", "criteria": {"x": None}}}))], "request_id string, state string, questions string")
    with pytest.raises(Exception, match="2..255"):
        systemone.render(systemone.explode_requests(bad)).collect()


def test_null_and_repeated_question_ids_stay(spark, model):
    q = systemone.explode_requests(spark.createDataFrame([("r", '"hello"', json.dumps(QUESTIONS))], "request_id string, state string, questions string"))
    odd = q.where("qid = 'ok'").withColumn("qid", F.lit(None).cast("string")).unionByName(q).unionByName(q.where("qid = 'pick'"))
    assert systemone.render(odd).count() == 5
    got = systemone.system_one(odd, lambda d: scorers.score_bigrams(d, model)).collect()
    assert sorted(str(r.qid) for r in got) == ["None", "ok", "pick", "pick", "rate"]


def test_certainty_and_draws(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([1.0, 0.0],), ([1.0],)], "p array<double>").coalesce(1)
    assert [r[0] for r in df.select(S.certainty(F.col("p"))).collect()] == [0, 1, 1]
    one = df.limit(1)
    assert [one.select(S.draw(S.sharpened(F.col("p"), t), F.lit(u))).first()[0] for t, u in ((1.0, 0.2), (1.0, 0.7), (0.0, 0.9), (1.0, 0.9999))] == [0, 1, 0, 1]


def head_rows(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        options = rng.normal(size=(3, 4))
        y = int(rng.integers(3))
        context = np.stack([options[y] + 0.1 * rng.normal(size=4), options[y]])
        rows.append((f"{seed}-{i}", context.tolist(), options.tolist(), y, ["a", "b", "c"], [f"t{seed}-{i}-{k}" for k in range(3)], f"f{seed}-{i}", None))
    return spark.createDataFrame(rows, "id string, context array<array<double>>, options array<array<double>>, label int, ids array<string>, texts array<string>, fingerprint string, group_id string")


def test_head_gradient_and_permutation():
    h = scorers.AttentionHead.random(4, 3)
    rng = np.random.default_rng(1)
    c, o = rng.normal(size=(5, 4)), rng.normal(size=(3, 4))
    z, tape = h.forward(c, o)
    order = [2, 0, 1]
    assert np.allclose(h.forward(c[::-1], o[order])[0], z[order])
    _, g = scorers.choice_loss(z, 1, 0.7)
    grads = h.backward(tape, g)
    for k, w in enumerate(h.weights):
        at = tuple(0 for _ in w.shape)
        moved = [x.copy() for x in h.weights]
        moved[k][at] += 1e-6
        loss = lambda head: scorers.choice_loss(head.forward(c, o)[0], 1, 0.7)[0]
        assert (loss(scorers.AttentionHead.of(moved)) - loss(h)) / 1e-6 == pytest.approx(grads[k][at], abs=1e-4)


def test_gradient_is_the_sum_over_partitions(spark):
    rows, head = head_rows(spark, 70), scorers.AttentionHead.random(4, 3)
    want, loss = [np.zeros_like(w) for w in head.weights], 0.0
    for r in rows.collect():
        logits, tape = head.forward(np.array(r.context), np.array(r.options))
        x, g = scorers.choice_loss(logits, r.label, 0.7)
        loss += x
        want = [a + d for a, d in zip(want, head.backward(tape, g), strict=True)]
    packed = scorers._packed(rows.repartition(9))
    for parts, fan in ((1, 16), (9, 2)):
        n, got_loss, got = scorers.gradient(packed, head, 0.7, parts=parts, fan=fan)
        assert n == 70 and got_loss == pytest.approx(loss, abs=1e-9) and all(np.abs(a - b).max() < 1e-9 for a, b in zip(want, got, strict=True))
    assert scorers.gradient(packed.limit(0), head)[0] == 0


def test_store_equals_joins(spark, model):
    import dataclasses

    from pondera.operators import ngrams

    df = spark.createDataFrame([("t", "on the", ["cat", "the dog", "xyz", "The CAT sat"]), ("u", None, ["cat", "mat"]), ("v", "É Ⅷ", ["É", "ß x"]), ("w", "the", [])], "id string, context string, options array<string>")
    joins = dataclasses.replace(model, store=None)
    a, b = ({(r.id, r.pos): r for r in scorers.score_bigrams(df, m).collect()} for m in (model, joins))
    assert a.keys() == b.keys() and len(a) == 8
    for k in a:
        assert (a[k].option, a[k].n_tokens) == (b[k].option, b[k].n_tokens) and a[k].logprob_sum == pytest.approx(b[k].logprob_sum) and a[k].logprob_uncond == pytest.approx(b[k].logprob_uncond)
    for i, context, options in (("t", "on the", ["cat", "the dog", "xyz", "The CAT sat"]), ("v", "É Ⅷ", ["É", "ß x"])):
        for pos, (n, s, u) in enumerate(model.store.score(context, options)):
            assert n == a[i, pos].n_tokens and s == pytest.approx(a[i, pos].logprob_sum) and u == pytest.approx(a[i, pos].logprob_uncond)
    texts = ["", "a", "the cat", "É Ⅷ", "x" * 100]
    rows = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string").select("x", "y", F.xxhash64("x", "y").alias("h")).collect()
    assert all(r.h == ngrams.key(r.x, r.y) for r in rows)
    two = df.where("size(options) > 1")
    c = {r.id: r for r in scorers.row_distributions(two, model, norm="pmi").collect()}
    d = {r.id: r for r in scorers.distributions(scorers.score_bigrams(two, joins), norm="pmi").collect()}
    assert all(c[i].scores == pytest.approx(d[i].scores) and c[i].n_tokens == d[i].n_tokens for i in d) and c.keys() == d.keys()
    assert "Exchange" not in scorers.row_distributions(two, model)._jdf.queryExecution().executedPlan().toString()


def test_loss_value():
    a, b = scorers.choice_loss(np.zeros(2), 0, 0.7)[0], scorers.choice_loss(np.zeros(3), 0, 0.7)[0]
    assert (a + b) / 2 == pytest.approx((math.log(2) + math.log(3)) / 2 + 0.7 * (0.5 + 2 / 3) / 2)


def test_training_and_artifact(spark, tmp_path):
    head, history = scorers.train_attention(head_rows(spark), head_rows(spark, seed=1), rank=8, epochs=6, lr=0.05, selection="nll")
    assert history[-1]["train_loss"] < history[0]["train_loss"]
    sinks.write_artifact(tmp_path / "a", head, {}, {"hidden": 4})
    readers.read_artifact(tmp_path / "a")
    again = scorers.AttentionHead.load(str(tmp_path / "a/head.npz"))
    x = scorers.score_attention(head_rows(spark, 5), head).collect()
    assert [r.scores for r in x] == [r.scores for r in scorers.score_attention(head_rows(spark, 5), again).collect()]
    (tmp_path / "a/head.json").write_text("{} ")
    with pytest.raises(ValueError, match="files changed"):
        readers.read_artifact(tmp_path / "a")


def test_experiment(spark, tmp_path):
    s = readers.Experiment("m", str(tmp_path / "out"), {k: k for k in readers.SPLITS}, brier_weights=(0.0, 0.5), rank=4, epochs=2, bootstrap_samples=20)
    data = {k: head_rows(spark, 20, i) for i, k in enumerate(readers.SPLITS)}
    with pytest.raises(ValueError, match="overlap"):
        experiment.run(s, data | {"test": data["train"]})
    got = experiment.run(s, data)
    assert got["selected"] in (0, 1) and got["uniform"]["nll"] == pytest.approx(math.log(3)) and set(got["trials"][0]["test"]) == {"raw", "nll", "brier"}
    assert "## selection" in (tmp_path / "out/report.md").read_text()
    with pytest.raises(FileExistsError):
        experiment.run(s, data)


def test_variants(spark):
    rows = [(v, f"e{i}", ["a", "b"], [1.0, 0.0] if v == "x" else [0.0, 1.0], 0, 900.0 if i else None) for v in ("base", "x") for i in range(6)]
    p = spark.createDataFrame(rows, "variant string, id string, candidates array<string>, scores array<double>, label int, rating double")
    c = spark.createDataFrame([(f"e{i}", i) for i in range(6)], "id string, cluster int")
    t = experiment.analyze_variants(p, c, {"base": 1.0, "x": 2.0}, samples=20)
    acc = t["differences"].where("metric = 'accuracy' and comparison = 'x/raw minus base/raw'").first()
    assert (acc.lower, acc.upper) == (1, 1) and t["differences"].select("comparison").distinct().count() == 4
    s = {(r.variant, r["mode"], r.stratum, r.value): r for r in t["strata"].collect()}
    assert len(s) == 8 and s["x", "raw", "rating", "<1000"].n == 5 and s["base", "calibrated", "candidates", "2-10"].accuracy == 0
    assert t["summary"].count() == 4 and t["baseline"].first().expected_accuracy == 0.5
    rows = experiment.variant_rows(p, {"base": 1.0, "x": 2.0})
    plan = experiment.variant_strata(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1
    with pytest.raises(Exception, match="no calibrator of variant x"):
        experiment.variant_rows(p, {"base": 1.0}).collect()
    torn = experiment.variant_rows(p.where("not (variant = 'x' and id = 'e3')").join(c, "id"), {"base": 1.0, "x": 2.0})
    with pytest.raises(Exception, match="variants differ in example e3"):
        experiment.variant_differences(torn).collect()


def test_benchmark_command(spark, tmp_path):
    line = lambda i, s, rating: json.dumps({"id": f"test:{i}", "fen": "f", "position": f"p{i}", "candidates": ["a", "b"], "label": 0, "scores": s, "rating": rating})
    for name, t in (("base", 1.5), ("tuned", 0.5)):
        (tmp_path / f"{name}-test-predictions.jsonl").write_text("\n".join(line(i, [1.0, 0.0] if i % 3 else [0.0, 1.0], 1200 + i) for i in range(8)))
        (tmp_path / f"{name}-calibrator.json").write_text(json.dumps({"temperature": t}))
    cli.main(["benchmark", str(tmp_path), str(tmp_path / "report.md"), "--samples", "10"], spark)
    text = (tmp_path / "report.md").read_text()
    assert "tuned/raw minus base/raw" in text and "1000-1399" in text and "## metadata" in text
    (tmp_path / "tuned-calibrator.json").unlink()
    with pytest.raises(Exception, match="no calibrator of variant tuned"):
        cli.main(["benchmark", str(tmp_path), str(tmp_path / "r2.md"), "--samples", "10"], spark)
    (tmp_path / "tuned-test-predictions.jsonl").write_text(line(1, [1.0], 5))
    with pytest.raises(Exception, match="invalid prediction"):
        readers.prediction_variants(spark, str(tmp_path)).collect()


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "t.txt").write_text("the cat sat\nthe dog sat\n")
    (tmp_path / "o.txt").write_text("cat\ndog ran\n")
    assert cli.main(["score", str(tmp_path / "t.txt"), str(tmp_path / "o.txt"), "--context", "the"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["options"] == "cat"
    (tmp_path / "r.jsonl").write_text(json.dumps({"context": "the", "options": ["cat", "ran"], "label": 0}) + "\n")
    cli.main(["eval", str(tmp_path / "t.txt"), "--rows", str(tmp_path / "r.jsonl")], spark)
    assert json.loads(capsys.readouterr().out)["top1"] == 1
    cli.main(["convert", str(tmp_path / "r.jsonl"), str(tmp_path / "tasks")], spark)
    assert readers.tasks(spark, str(tmp_path / "tasks"), labelled=True).first().choice_id == "option-0"
    with pytest.raises(FileExistsError):
        cli.main(["convert", str(tmp_path / "r.jsonl"), str(tmp_path / "tasks")], spark)
    cli.main(["bench", str(tmp_path / "t.txt"), str(tmp_path / "tasks"), "--repeat", "2"], spark)
    assert {json.loads(x)["name"] for x in capsys.readouterr().out.splitlines()} == {"shared", "naive"}
    with pytest.raises(ValueError, match="overlap"):
        cli.main(["check-tasks", str(tmp_path / "tasks"), str(tmp_path / "tasks")], spark)
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "r", "state": "hi", "questions": QUESTIONS}) + "\n")
    cli.main(["systemone", str(tmp_path / "t.txt"), str(tmp_path / "q.jsonl")], spark)
    assert set(json.loads(capsys.readouterr().out)["answers"]) == set(QUESTIONS)


def test_server(spark, model):
    import threading
    import urllib.error
    import urllib.request

    from pondera.serve import make_server

    server = make_server(model, 0, "key")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def post(path, body, key="key"):
        r = urllib.request.Request(base + path, json.dumps(body).encode(), {"Authorization": f"Bearer {key}"})
        try:
            with urllib.request.urlopen(r) as f:
                return f.status, json.load(f)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert json.load(urllib.request.urlopen(base + "/health")) == {"status": "ok"}
        assert post("/score", {"context": "the", "options": ["cat", "zzz"]})[1]["best"] == "cat"
        assert [post("/score", b)[0] for b in ({"context": "x", "options": ["a"]}, {"context": "x", "options": ["a", ""]}, [1])] == [400, 400, 400]
        assert post("/score", {}, "no")[0] == 401 and post("/other", {})[0] == 404
        from pathlib import Path
        from time import perf_counter

        from pondera.plans.scratch import shared_folder

        kept = lambda: sorted(p.name for p in Path(shared_folder(spark).removeprefix("file://")).iterdir())
        before, began = kept(), perf_counter()
        for _ in range(5):
            assert set(post("/score", {"context": "the", "options": ["cat", "zzz"]})[1]) == {"best", "options"}
        assert (perf_counter() - began) / 5 < 0.18
        assert set(post("/v1/systemone", {"state": "s", "questions": QUESTIONS})[1]["answers"]) == set(QUESTIONS)
        assert post("/v1/systemone", {"state": "s", "questions": {"a": 3}})[0] == 400
        assert kept() == before  # requests leave no table
    finally:
        server.shutdown()


def test_limits_invariance_latency_actions(spark, model):
    from pondera.serve import choose_actions

    assert scorers.require_token_limits(tasks(spark)).count() == 2
    with pytest.raises(Exception, match="too many tokens"):
        scorers.require_token_limits(tasks(spark), candidate_tokens=1).collect()
    fine = scorers.invariance(tasks(spark), lambda d: scorers.score_bigrams(d, model)).first()
    assert fine.ok and (fine.n, fine.compared, fine.changed) == (2, 6, 0)
    late = scorers.invariance(tasks(spark), lambda d: scorers.score_bigrams(d, model).withColumn("logprob_sum", F.col("logprob_sum") + 9 * F.col("pos"))).first()
    assert not late.ok and late.changed == 2 and late.worst == pytest.approx(18)

    def remembers():
        seen = []  # a scorer that is worse at what it has seen
        return lambda context, options: [(1, -float(len(o)) - 0.1 * seen.count(context), 0.0) for o in (seen.append(context), options)[1]]

    assert not scorers.invariance(tasks(spark), lambda d: scorers.score_with_model(d, remembers)).first().ok
    assert not scorers.invariance(tasks(spark), lambda d: scorers.score_bigrams(d, model).withColumn("logprob_sum", F.col("logprob_sum") - F.length("id"))).first().ok
    t = {r.name: r for r in metrics.latency(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0)], "name string, seconds double")).collect()}
    assert (t["a"].median_seconds, t["a"].min_seconds, t["b"].ratio) == (2, 1, 2)
    s = spark.createDataFrame([(1, [("DoomImp", "monster", 0.5, 0.6)], 5.0, 5.0, 50.0, 90, 3, 0, None)], "id long, things array<struct<name:string,kind:string,cx:double,size:double>>, depth_center double, depth_left double, depth_right double, health int, ammo int, kills int, last_action string")
    got = choose_actions(s, model, "win", ["shoot"], [("a", "b")], ["attack", "the mat"]).first()
    assert got.action in ("attack", "the mat") and sum(got.probabilities) == pytest.approx(1)


def test_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([("2024-01-01 00:00:00", 1, 1, "go", 1.0), ("2024-01-01 00:20:00", 1, 2, "go", 2.0), ("2024-01-01 05:00:00", 1, 3, "stop", 3.0)], "ts string, episode long, step long, action string, reward double").withColumn("ts", F.col("ts").cast("timestamp"))
    sinks.append_log(log.coalesce(1), str(tmp_path / "log"))
    stream = decisions.rewards_by_window(decisions.read_log(spark, str(tmp_path / "log")), "1 hour")
    q = stream.writeStream.format("memory").queryName("rewards").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rewards").collect())) == sorted(map(tuple, decisions.rewards_by_window(log, "1 hour").collect()))
    assert decisions.sessions(log, "1 hour").count() == 2
    q = decisions.score_stream(decisions.read_log(spark, str(tmp_path / "log")), lambda df: df.withColumn("score", F.col("reward") * 2), str(tmp_path / "scored"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "scored")).agg(F.sum("score")).first()[0] == 12
    assert metrics.summarize(metrics.metric_rows(spark.createDataFrame([], "id string, ids array<string>, scores array<double>, label int"))).first().n == 0


# ---- features, artifacts and the decision scorer

def decision_lines(n, start=0):
    rows = []
    for i in range(start, start + n):
        options = [{"id": "x", "text": "a aa"}, {"id": "y", "text": "bbbb b"}]
        rows.append(json.dumps({"schema_version": 1, "id": f"t{i}", "state": {"n": i}, "question": f"which {i}?", "candidates": options, "target": {"choice_id": "x" if i % 2 else "y"}}))
    return rows


def test_decision_scorer(spark, tmp_path):
    from pondera.operators import decision, tasks
    from pondera.operators.calibration import Calibrator

    def letters():
        """A small deterministic model: four numbers for each word."""
        import numpy as np

        return lambda text: np.array([[len(w), w.count("a"), ord(w[0]) % 7, 1.0] for w in text.split()])

    parsed = [tasks.parse_tasks(spark.createDataFrame([(x,) for x in decision_lines(12, k)], "value string")) for k in (0, 100)]
    train, valid = (decision.extract(p, letters) for p in parsed)
    assert train.first().label in (0, 1) and len(train.first().options) == 2
    decision.check_cache(train, parsed[0])
    with pytest.raises(ValueError, match="differ"):
        decision.check_cache(train, parsed[1])
    about = decision.describe_tasks(parsed[0], "train")
    decision.check_cache(train.repartition(3), parsed[0], about, "train")
    for rows, meta, role, what in ((train.union(train.limit(1)), about, "train", "rows"), (train.withColumn("label", 1 - F.col("label")), about, "train", "rows"), (train, about, "test", "role"), (train, about | {"source_sha256": "0"}, "train", "source"), (train, {}, "train", "provenance")):
        with pytest.raises(ValueError, match=what):
            decision.check_cache(rows, parsed[0], meta, role)
    with pytest.raises(ValueError, match="overlap"):
        decision.train_artifact(train, train, str(tmp_path / "no"), {})
    decision.train_artifact(train, valid, str(tmp_path / "head"), {"model": "letters"}, rank=2, epochs=1)
    with pytest.raises(ValueError, match="model differs"):
        decision.DecisionScorer(tmp_path / "head", letters, {"model": "other"})
    scorer = decision.DecisionScorer(tmp_path / "head", letters, {"model": "letters"})
    table = {r.id: r for r in scorer.score_table(parsed[0]).collect()}
    one = scorer.score(json.loads(decision_lines(1)[0]))
    assert one["choice_id"] == table["t0"].choice and [c["probability"] for c in one["candidates"]] == pytest.approx(table["t0"].probabilities)
    assert scorer.predict(state="s", question="q?", candidates={"a": "one", "b": "two"})["choice_id"] in ("a", "b")
    for bad in ([("a", "one")], {"a": "one"}, {"a": "one", "b": " "}):
        with pytest.raises(ValueError):
            scorer.predict(state="s", question="q?", candidates=bad)
    with pytest.raises(ValueError, match="the head's training"):
        scorer.require_unseen(parsed[0])
    fresh, later = (tasks.parse_tasks(spark.createDataFrame([(x,) for x in decision_lines(8, k)], "value string")) for k in (200, 300))
    scorer.require_unseen(fresh)
    bound = scorer.fit_calibrator(fresh, str(tmp_path / "own.json"))
    own = decision.DecisionScorer(tmp_path / "head", letters, {"model": "letters"}, str(tmp_path / "own.json"))
    assert own.calibrator == bound and bound.examples == 8
    own.require_unseen(later)
    with pytest.raises(ValueError, match="the calibrator's tasks"):
        own.require_unseen(fresh)
    runs = {r["run"]: r.n for r in decision.evaluate(train, scorer.head).collect()}
    assert runs == {"given": 12, "shuffled": 12}
    Calibrator(2.0, "nll", (0.05, 20.0), scorer.artifact_id).save(str(tmp_path / "c.json"))
    warm = decision.DecisionScorer(tmp_path / "head", letters, {"model": "letters"}, str(tmp_path / "c.json"))
    got = warm.score(json.loads(decision_lines(1)[0]))
    assert got["choice_id"] == one["choice_id"] and got["raw_probabilities"] == pytest.approx([c["probability"] for c in one["candidates"]])
    assert warm.score_table(parsed[0]).where("id = 't0'").first().probabilities == pytest.approx([c["probability"] for c in got["candidates"]])
    with pytest.raises(Exception, match="no features"):
        decision.extract(parsed[0], letters, candidate_tokens=1).collect()


def test_head_commands(spark, tmp_path, capsys):
    model = ["--model", "pondera.operators.decision:hashed_words"]
    for name, k in (("train", 0), ("valid", 100), ("test", 200), ("cal", 300)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(decision_lines(10, k)))
    for name in ("train", "valid"):
        cli.main(["features", str(tmp_path / name), "--tasks", str(tmp_path / f"{name}.jsonl"), "--labelled", *model], spark)
    cli.main(["train", str(tmp_path / "train"), str(tmp_path / "valid"), str(tmp_path / "head"), "--rank", "2", "--epochs", "1", *model], spark)
    cli.main(["predict", str(tmp_path / "head"), str(tmp_path / "out"), "--tasks", str(tmp_path / "valid.jsonl"), str(tmp_path / "test.jsonl"), *model], spark)
    assert spark.read.json(str(tmp_path / "out")).count() == 20
    cli.main(["fit-calibrator", str(tmp_path / "head"), str(tmp_path / "c.json"), "--tasks", str(tmp_path / "cal.jsonl"), *model], spark)
    capsys.readouterr()
    cli.main(["eval-head", str(tmp_path / "head"), "--tasks", str(tmp_path / "test.jsonl"), "--calibrator", str(tmp_path / "c.json"), *model], spark)
    assert {x["run"]: x["n"] for x in map(json.loads, capsys.readouterr().out.splitlines())} == {"given": 10, "shuffled": 10}
    for seen in ("valid", "cal"):
        with pytest.raises(ValueError, match="overlap"):
            cli.main(["eval-head", str(tmp_path / "head"), "--tasks", str(tmp_path / f"{seen}.jsonl"), "--calibrator", str(tmp_path / "c.json"), *model], spark)
    (tmp_path / "texts.txt").write_text("a aa bbbb b\nb a")
    cli.main(["check", str(tmp_path / "texts.txt"), "--tasks", str(tmp_path / "valid.jsonl")], spark)
    assert json.loads(capsys.readouterr().out)["ok"] is True
    with pytest.raises(ValueError, match="another model"):
        cli.main(["train", str(tmp_path / "train"), str(tmp_path / "valid"), str(tmp_path / "h2"), "--model", "other:model"], spark)


def test_experiment_of_datasets(spark, tmp_path):
    """Features are extracted, named by their tasks and checked; a changed dataset is refused with the old caches."""
    from pondera.operators import decision

    for k, name in enumerate(readers.SPLITS):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(decision_lines(8, 100 * k)))
    body = 'schema_version = 1\nmodel = "m"\nout = "out"\n[datasets]\n' + "".join(f'{n} = "{n}.jsonl"\n' for n in readers.SPLITS)
    (tmp_path / "e.toml").write_text(body)
    made = decision.prepare(readers.Experiment.load(tmp_path / "e.toml"), spark, *cli.load_model("pondera.operators.decision:hashed_words"))
    assert {k: v.count() for k, v in made.items()} == dict.fromkeys(readers.SPLITS, 8)
    cached = body + "[caches]\n" + "".join(f'{n} = "out-features/{n}"\n' for n in readers.SPLITS)
    (tmp_path / "e.toml").write_text(cached)
    assert decision.prepare(readers.Experiment.load(tmp_path / "e.toml"), spark).keys() == made.keys()
    (tmp_path / "e.toml").write_text(cached.replace('test = "out-features/test"', 'test = "out-features/train"'))
    (tmp_path / "f.toml").write_text(cached)
    with pytest.raises(ValueError, match="differ from their tasks: role, source_sha256, provenance_sha256, tasks_sha256, rows"):
        cli.main(["experiment", str(tmp_path / "e.toml")], spark)
    (tmp_path / "test.jsonl").write_text("\n".join(decision_lines(9, 300)))
    with pytest.raises(ValueError, match="differ from their tasks"):
        cli.main(["experiment", str(tmp_path / "f.toml")], spark)
