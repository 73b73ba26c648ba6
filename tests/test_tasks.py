"""Contracts, text forms, leakage, clusters, splits, sources and sinks."""

import json

import pytest
from pondera.functions import text as X
from pondera.operators import splits, tasks
from pondera.operators.components import connected_components
from pondera.sources import readers, sinks
from pyspark.sql import functions as F


def task(**over):
    base = {"schema_version": 1, "id": "t", "state": {"b": 1.0, "a": "é"}, "question": "q?", "candidates": [{"id": "x", "text": "X"}, {"id": "y", "text": "Y"}]}
    return {k: v for k, v in (base | over).items() if v is not ...}


BAD = [
    ({"extra": 1}, "not one of a task's"), ({"schema_version": True}, "schema_version"), ({"schema_version": 2}, "schema_version"), ({"id": " "}, "id is missing"), ({"question": ...}, "question is missing"), ({"state": 3}, "state is neither"),
    ({"candidates": [{"id": "x", "text": "X"}]}, "2 to 255"), ({"candidates": [{"id": "x"}, {"id": "y", "text": "Y"}]}, "other fields than id and text"), ({"candidates": [{"id": "x", "text": ""}, {"id": "y", "text": "Y"}]}, "text is blank"),
    ({"candidates": [{"id": "x", "text": "X"}, {"id": "x", "text": "Y"}]}, "have one id"), ({"candidates": [{"id": "x", "text": "X"}, {"id": "y", "text": "X"}]}, "have one text"),
    ({"target": {"choice_id": "z"}}, "none of the candidates"), ({"target": {"a": 1}}, "other fields than choice_id"), ({"target": {"choice_id": ["x"]}}, "none of the candidates"), ({"group_id": ""}, "group_id is blank"),
]


@pytest.mark.parametrize("over,message", BAD)
def test_each_rule(spark, over, message):
    df = spark.createDataFrame([(json.dumps(task(**over)),)], "value string")
    assert message in tasks.parse_tasks(df).first().error


def test_bad_json_and_missing_target(spark):
    df = spark.createDataFrame([("[1",), ('{"state": NaN}',), ("3",), (None,)], "value string")
    assert all(r.error for r in tasks.parse_tasks(df).collect())
    assert "has a target" in tasks.parse_tasks(spark.createDataFrame([(json.dumps(task()),)], "value string"), labelled=True).first().error


def test_round_trip_and_fingerprint(spark):
    lines = [task(target={"choice_id": "y"}, group_id="g"), task(id="u", candidates=[{"id": "1", "text": "Y"}, {"id": "2", "text": "X"}])]
    t = tasks.parse_tasks(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string"))
    a, b = t.orderBy("id").collect()
    assert a.fingerprint == b.fingerprint and a.state == '{"a":"é","b":1.0}'
    assert json.loads(tasks.to_json(t.where("id = 't'")).first().value) == lines[0]
    assert tasks.with_label(t).orderBy("id").first().label == 1
    text = spark.createDataFrame([("say \"hi\"\n",)], "s string")
    native = text.select(X.input_fingerprint(X.json_string(F.col("s")), F.lit("q"), F.array(F.lit("b"), F.lit("a")))).first()[0]
    assert native == X.digest({"state": 'say "hi"\n', "question": "q", "candidates": ["a", "b"]})


def test_strict_load_names_the_line(spark, tmp_path):
    p = tmp_path / "data.jsonl"
    p.write_text(json.dumps(task()) + "\n\n" + json.dumps(task(id="")) + "\n")
    with pytest.raises(ValueError, match="data.jsonl:3: id is missing"):
        readers.tasks(spark, str(p))
    p.write_text((json.dumps(task()) + "\n") * 2)
    with pytest.raises(ValueError, match="more than once"):
        readers.tasks(spark, str(p))
    p.write_text("\n")
    with pytest.raises(ValueError, match="no task in"):
        readers.tasks(spark, str(p))


def test_legacy_conversion(spark):
    df = spark.createDataFrame([(1, "c", ["a", "b"], 1), (2, "c", ["a", "b"], None), (3, "c", None, None)], "line int, context string, options array<string>, label int")
    got = tasks.convert_legacy(tasks.or_fixed_options(df, ["p", "q"]), "f", "q?").orderBy("id").collect()
    assert [r.choice_id for r in got] == ["option-1", None, None] and got[2].candidates[1].text == "q"
    with pytest.raises(Exception, match="out of range"):
        tasks.convert_legacy(df.withColumn("label", F.lit(2)), "f", "q?").collect()


def test_leakage_ignores_ids_and_order(spark):
    mk = lambda i, g: tasks.parse_tasks(spark.createDataFrame([(json.dumps(task(id=i, group_id=g)),)], "value string"))
    keys = tasks.provenance({"train": mk("a", "g1"), "test": mk("b", "g2")})
    assert [(r.kind, r.splits) for r in tasks.overlaps(keys).collect()] == [("input", ["test", "train"])]
    with pytest.raises(ValueError, match="inputs"):
        tasks.require_disjoint(keys)
    audit = tasks.audit_overlaps(keys, ["train", "test"]).first()
    assert (audit.first_split, audit.split) == ("train", "test")


def test_alignment(spark):
    t = spark.createDataFrame([("a", ["x", "y"])], "id string, ids array<string>")
    r = spark.createDataFrame([("a", [("y", 2.0), ("x", 1.0)])], "id string, candidates array<struct<id:string,utility:double>>")
    assert tasks.aligned(t, r).first().scores == [1, 2]
    with pytest.raises(Exception, match="align"):
        tasks.aligned(t, r.withColumn("id", F.lit("b"))).collect()


def test_enrichment_mismatch(spark):
    rows = spark.createDataFrame([("a", ["x"], 0, "old")], "id string, candidates array<string>, label int, rating string")
    source = rows.withColumn("rating", F.lit(None).cast("string"))
    assert tasks.enrich(rows, source, ["rating"]).first().rating == "old"  # the source has none
    assert tasks.enrich(rows, source.withColumn("rating", F.lit("new")), ["rating"]).first().rating == "new"
    with pytest.raises(Exception, match="does not match"):
        tasks.enrich(rows, source.withColumn("label", F.lit(1)), ["rating"]).collect()


def test_shuffled_contexts(spark):
    df = spark.range(5).select(F.col("id").alias("n"), F.col("id").alias("c"))
    assert [r.c for r in tasks.shuffled_contexts(df, ordinal="n", context="c", batch=2).orderBy("n").collect()] == [1, 0, 3, 2, 4]


def test_components_chain_star_and_empty(spark):
    n = 40
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(60).select(F.lit(1000).cast("long").alias("a"), (F.col("id") + 1001).alias("b"))
    extra = spark.createDataFrame([(5, 5), (None, 7), (1, 0)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain.union(star).union(extra)).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {i: 1000 for i in range(1000, 1061)}
    assert connected_components(chain.limit(0)).count() == 0


def chess(spark):
    rows = [(0, "", "https://lichess.org/abcdefgh/black#3", "", "p0"), (1, "abcdefgh", "", "z1", "p1"), (2, "", "", "z1", "p2"), (3, "", "", "", "")]
    return spark.createDataFrame(rows, "row long, game_id string, game_url string, puzzle_id string, position string")


def test_chain_of_identities_is_one_cluster(spark):
    got = splits.clusters(chess(spark), splits.identity_keys(chess(spark))).orderBy("row").collect()
    assert [r.cluster for r in got] == [0, 0, 0, 3]


def test_group_split_keeps_clusters(spark):
    m = spark.range(60).select(F.col("id").alias("row"), (F.col("id") / 3).cast("int").alias("cluster"))
    a = splits.group_split(m).orderBy("cluster").collect()
    assert a == splits.group_split(m.repartition(7)).orderBy("cluster").collect()
    assert len(a) == 20 and {r.split for r in a} == set(splits.SPLITS) and sum(r.split == "train" for r in a) == 14
    with pytest.raises(ValueError):
        splits.group_split(m.limit(3))
    with pytest.raises(ValueError):
        splits.group_split(m, fractions=(0.5, 0.5, 0.1, 0.1))


def test_dedup_conflict(spark):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 0, "a"), ("q", 2, "a"), ("q", 3, "b")], "k string, n int, g string")
    got = {r.k: r for r in tasks.keep_first(df, "k", "n", "g").collect()}
    assert got["p"].n == 0 and not got["p"].conflict and got["q"].conflict
    with pytest.raises(Exception, match="conflicting"):
        tasks.require_no_conflict(tasks.keep_first(df, "k", "n", "g"), "k").collect()


FEN = "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq - 2 3"


def test_chess_lines(spark, tmp_path):
    df = spark.createDataFrame([(FEN, ["f1b5", "d2d4"])], "fen string, moves array<string>").select(X.chess_prompt(F.col("fen"), F.col("moves")).alias("p"))
    prompt = df.first().p
    assert "8 r . b q k b n r\n" in prompt and prompt.endswith("Legal moves: f1b5 d2d4\nBest move:") and "as white" in prompt
    p = tmp_path / "valid.jsonl"
    p.write_text(json.dumps({"prompt": prompt, "completion": " d2d4", "GameUrl": "https://lichess.org/abcdefgh", "rating": 1200}) + "\n")
    r = readers.chess_examples(spark, str(p)).first()
    assert (r.id, r.label, r.candidates, r.position, r.rating) == ("valid:1", 1, ["f1b5", "d2d4"], " ".join(FEN.split()[:4]), 1200)
    p.write_text(json.dumps({"prompt": prompt, "completion": "a1a1"}) + "\n")
    with pytest.raises(Exception, match="valid.jsonl:1"):
        readers.chess_examples(spark, str(p)).collect()


def test_game_identity(spark):
    df = spark.createDataFrame([("", "https://lichess.org/abcdefghijkl/white"), ("", "https://x.org/a/?q=1#z"), (" g ", "u"), ("", "plain"), (None, None)], "i string, u string")
    assert [r[0] for r in df.select(X.game_identity(F.col("i"), F.col("u"))).collect()] == ["abcdefgh", "https://x.org/a", "g", "plain", None]


def test_sinks_are_exclusive(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "id string, p double")
    sinks.write_lines(df, str(tmp_path / "out"), ("p",))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_lines(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="not finite"):
        sinks.write_lines(df.withColumn("p", F.lit(float("nan"))), str(tmp_path / "nan"), ("p",))
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_document({"a": 1}, tmp_path / "d.json")
    with pytest.raises(FileExistsError):
        sinks.write_document({}, tmp_path / "d.json")
    sinks.write_report(tmp_path / "r.md", "T", {"one": df, "two": "words"})
    assert "| a | 1 |" in (tmp_path / "r.md").read_text()


def test_feature_table(spark, tmp_path):
    df = spark.createDataFrame([("a", [[1.0, 2.0]], [[0.0, 1.0], [1.0, 0.0]], 1)], "id string, context array<array<double>>, options array<array<double>>, label int")
    sinks.write_features(df, str(tmp_path / "f"), {"hidden": 2})
    rows, meta = readers.features(spark, str(tmp_path / "f"))
    assert rows.count() == 1 and meta == {"hidden": 2, "rows": 1}
    sinks.write_features(df, str(tmp_path / "h"), {})
    assert readers.features(spark, str(tmp_path / "h"))[1]["hidden"] == 2
    sinks.write_features(df, str(tmp_path / "g"), {"hidden": 3})
    with pytest.raises(ValueError, match="damaged"):
        readers.features(spark, str(tmp_path / "g"))


def test_experiment_settings(tmp_path):
    p = tmp_path / "e.toml"
    body = 'schema_version = 1\nmodel = "m"\nout = "o"\n[datasets]\ntrain = "a"\nvalidation = "b"\ncalibration = "c"\ntest = "d"\n'
    p.write_text(body)
    e = readers.Experiment.load(p)
    assert e.datasets["test"] == str(tmp_path / "d") and e.rank == 256
    for extra in ("[training]\nrank = 0\n", "[training]\nunknown = 1\n", "[calibration]\ntemperature_bounds = [2.0, 3.0]\n", "[training]\nbrier_weights = [0.1]\n", "[caches]\ntrain = 'x'\n"):
        p.write_text(body + extra)
        with pytest.raises(ValueError):
            readers.Experiment.load(p)


def test_options_and_synthetic_texts(spark, tmp_path):
    (tmp_path / "o.txt").write_text(" a\n\n b c\n")
    assert sorted(r.option for r in readers.option_lines(spark, str(tmp_path / "o.txt")).collect()) == [" a", " b c"]
    a = readers.synthetic_texts(spark, 3, ["x", "y"], 4).orderBy("id").collect()
    assert a == readers.synthetic_texts(spark, 3, ["x", "y"], 4).orderBy("id").collect() and len(a[0].text.split()) == 4


def test_indented_entries(spark):
    df = spark.createDataFrame([(None,), ('"x"',), ("null",), ('{"b": [1]}',)], "s string").coalesce(1)
    assert [r[0] for r in df.select(X.indented("s")).collect()] == ["", "x", "", '{\n  "b": [\n    1\n  ]\n}']


def test_game_words(spark):
    got = spark.range(1).select(X.status(F.lit(90), F.lit(5), F.lit(1), F.lit(None).cast("string")), X.game_prompt("win", ["r"], [("s", "a")], F.lit("scene"), F.lit("state"))).first()
    assert got[0] == "Health 90, ammo 5, kills 1."
    assert got[1] == "You are playing Doom. Goal: win\n\nRules:\n- r\n\nExamples:\nSituation: s -> a\n\nSituation: scene\nstate\n->"


def test_values_without_a_canonical_form_are_faults(spark):
    head = '{"schema_version":1,"id":"t","question":"q","candidates":[{"id":"x","text":"X"},{"id":"y","text":"Y"}],"state":'
    lines = [head + '{"x":1e999}}', head + '"\\ud800"}', head + '"ok"}', head.replace('"X"', '"\\udfff"') + '"s"}']
    got = [r.error for r in tasks.parse_tasks(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()]
    assert got[0] and got[1] and got[2] is None and got[3]


def test_first_row_of_null_and_tied_keys(spark):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 0, "b"), ("k", 3, "x"), ("k", 3, "y")], "k string, n int, g string").withColumn("removed_", F.lit(1))
    got = {r.k: r for r in tasks.keep_first(rows, "k", "n", "g").collect()}
    assert len(got) == 2 and got[None].n == 0 and got[None].conflict and got["k"].removed == 1
    assert {str(r) for r in tasks.keep_first(rows.repartition(3), "k", "n", "g").collect()} == {str(r) for r in got.values()}


def test_limit_counts_rows_of_all_partitions(spark):
    rows = spark.range(8).repartition(4).select(F.monotonically_increasing_id().alias("n"))
    assert tasks.first_rows(rows, "n", 5).count() == 5 and tasks.first_rows(rows, "n", 0).count() == 8


def test_pairs_must_have_the_same_candidates(spark):
    from pondera.operators import resample

    shape = "id string, cluster string, label int, scores array<double>, ids array<string>, hit double, nll double, brier double"
    a, b = (spark.createDataFrame([("1", "c", 0, [1.0, 0.0], ids, 1.0, 0.1, 0.1)], shape) for ids in (["x", "y"], ["x", "z"]))
    assert resample.paired(a, a).first().hit == 0
    with pytest.raises(Exception, match="do not match"):
        resample.paired(a, b).collect()


def test_lines_are_numbered_across_ranges(spark, tmp_path):
    """A file cut to many byte ranges, with blank and long lines, gives every line its place."""
    import random

    r = random.Random(1)
    files = {}
    for name in ("a.txt", "b.txt"):
        lines = ["" if r.random() < 0.2 else f"{name}{i} " + "x" * r.choice([1, 5, 3000, 40]) for i in range(1500)]
        (tmp_path / name).write_bytes("".join(x + r.choice(["\n", "\r\n"]) for x in lines).encode())
        files[name] = lines
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "20000")
        df = readers.numbered_lines(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))
        assert df.rdd.getNumPartitions() > 20
        got = {(x.file.rsplit("/")[-1], x.line): x.value for x in df.collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {(n, i): x for n, lines in files.items() for i, x in enumerate(lines, 1) if x}


def test_tasks_of_several_files_are_parsed_once(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(task(id=f"{name}{i}")) + "\n" for i in range(5)))
    paths = [str(tmp_path / f"{n}.jsonl") for n in "ab"]
    got = readers.tasks(spark, *paths)
    assert sorted(r.id for r in got.collect()) == [f"{n}{i}" for n in "ab" for i in range(5)]
    assert "ArrowEvalPython" not in got._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="given twice|more than once"):
        readers.tasks(spark, paths[0], paths[0].replace("a.jsonl", "[a]*.jsonl"))
    (tmp_path / "c.jsonl").write_text((tmp_path / "a.jsonl").read_text())
    with pytest.raises(ValueError, match="a0 occurs more than once"):
        readers.tasks(spark, paths[0], str(tmp_path / "c.jsonl"))
    (tmp_path / "b.jsonl").write_text("\n\n{}\n{}\n")
    with pytest.raises(ValueError, match="b.jsonl:3: schema_version"):
        readers.tasks(spark, *paths)


def test_digest_of_a_table(spark):
    rows = [("a", 1, [1.0, 2.0]), ("b", None, None), ("a", 1, [1.0, 2.0])]
    mk = lambda x: spark.createDataFrame(x, "id string, n int, v array<double>")
    known = tasks.table_digest(mk(rows), "id", "n", "v")
    assert known == tasks.table_digest(mk(rows[::-1]).repartition(3), "id", "n", "v")
    for other in (rows[:2], [*rows, rows[0]], [rows[0], rows[1], ("a", 1, [1.0, 2.5])], [rows[0], ("b", 0, None), rows[2]], []):
        assert tasks.table_digest(mk(other), "id", "n", "v") != known


def test_split_plan_equals_the_loop():
    import random

    def loop(sizes, fractions):
        total = sum(s * n for s, n in sizes)
        goal, have, left, out = [total * f for f in fractions], [0] * 4, sum(n for _, n in sizes), {}
        for size, count in sorted(sizes, reverse=True):
            row = out.setdefault(size, [0] * 4)
            for _ in range(count):
                empty = [i for i in range(4) if not have[i]]
                i = max(empty if left == len(empty) else range(4), key=lambda j: goal[j] - have[j])
                row[i], have[i], left = row[i] + 1, have[i] + size, left - 1
        return out

    r = random.Random(2)
    for _ in range(1000):
        sizes = [(s, r.choice([1, 2, 5, 40, 400])) for s in r.sample(range(1, 60), r.randrange(1, 7))]
        w = [r.choice([1, 1, 2, 7, 30]) for _ in range(4)]
        fractions = tuple(x / sum(w) for x in w)
        if sum(n for _, n in sizes) >= 4:
            assert splits.plan_sizes(sizes, fractions) == loop(sizes, fractions)
    plan = splits.plan_sizes([(1, 10**9), (7, 10**6)], (0.7, 0.1, 0.1, 0.1))
    assert sum(plan[1]) == 10**9 and abs(plan[1][0] + 7 * plan[7][0] - 0.7 * (10**9 + 7 * 10**6)) <= 7


def test_running_sums_of_crowded_keys(spark):
    from pondera.operators.prefix import PART, number, ranges, running_sums

    rows = spark.range(200_000).select((1 - F.col("id") / 2e9).alias("c"), F.lit(1).alias("n"))  # all in [0.9999, 1]
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # so few rows would be one task
    try:
        spark.conf.set(key, "false")
        sizes = [x["count"] for x in ranges(rows.repartition(8), "c", descending=True).groupBy(PART).count().collect()]
    finally:
        spark.conf.unset(key)
    assert len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    got = running_sums(rows.repartition(8), "c", sums={"n": "upto"}, descending=True)
    assert got.where(F.col("upto") != F.round((1 - F.col("c")) * 2e9) + 1).count() == 0
    assert sorted(map(tuple, number(spark.createDataFrame([("b",), ("a",), ("b",)], "k string"), "k").collect())) == [("a", 0), ("b", 1)]
    assert running_sums(rows.limit(0), "c", sums={"n": "upto"}).count() == 0


def test_band_medians(spark):
    frame = [float(v) for v in range(100)]  # ten by ten
    d = spark.createDataFrame([(frame,)], "f array<double>").select(X.depth_bands(F.col("f"), 10, 10).alias("d"), X.median(F.lit([3.0, 1.0, 2.0])).alias("m"), X.median(F.array().cast("array<double>")).alias("none")).first()
    assert (d.d.left, d.d.center, d.d.right) == (40.5, 44.5, 48.5) and d.m == 2 and d.none is None


def test_package_names():
    import pondera
    from pondera.operators import scorers

    assert pondera.AttentionHead is scorers.AttentionHead and all(getattr(pondera, n) for n in pondera.__all__)
    with pytest.raises(AttributeError):
        pondera.nothing  # noqa: B018
