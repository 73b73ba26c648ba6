"""Registered queries of the decision operators over the test tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pondera.functions import scores as S
from pondera.functions import text as X
from pondera.operators import calibration, metrics, resample, scorers, splits, systemone, tasks
from pondera.plans import experiment
from pondera.sources import readers
from pondera.streaming import decisions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- embeddings as tasks: candidates are the labels, scored by their centroids

def vector_tasks(spark: SparkSession, sf_dir: str, scale: float = 10.0) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("gold"), "embedding")
    scored = scorers.score_vectors(v, scorers.centroids(v, label="gold"), scale=scale)
    return scored.select("id", "gold", "ids", "scores", (F.array_position("ids", F.col("gold")) - 1).cast("int").alias("label"))


def vector_rows(spark: SparkSession, sf_dir: str, temperature: float = 1.0, scale: float = 10.0) -> DataFrame:
    return metrics.metric_rows(vector_tasks(spark, sf_dir, scale), temperature=temperature)


def vector_sql(temperature: float = 1.0, scale: float = 10.0, name: str = "r") -> str:
    """CTEs up to the metric rows ``r`` of the embedding tasks."""
    x = "" if name == "r" else name
    return f"""
cm{x} AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS a FROM embeddings, range(1, 65) t(i) GROUP BY label, i),
cent{x} AS (SELECT label AS cand, list(a ORDER BY i) AS c FROM cm{x} GROUP BY label),
u{x} AS (SELECT vec_id AS id, label AS gold, cand, {scale}::DOUBLE * list_dot_product(embedding::DOUBLE[], c) AS u FROM embeddings, cent{x}),
m{x} AS (SELECT *, max(u) OVER (PARTITION BY id) AS mx FROM u{x}),
p{x} AS (SELECT *, exp((u - mx) / {temperature}::DOUBLE) / sum(exp((u - mx) / {temperature}::DOUBLE)) OVER (PARTITION BY id) AS p, row_number() OVER (PARTITION BY id ORDER BY u DESC, cand) AS rk FROM m{x}),
{name} AS (SELECT id, any_value(gold) AS gold, count(*) AS n_candidates, max(CASE WHEN cand = gold THEN (rk = 1)::INT END)::DOUBLE AS hit, max(CASE WHEN cand = gold THEN rk END) - 1 AS gold_rank,
  max(CASE WHEN cand = gold THEN (rk <= 3)::INT END)::DOUBLE AS top3, ln(sum(exp((u - mx) / {temperature}::DOUBLE))) + (max(mx) - max(CASE WHEN cand = gold THEN u END)) / {temperature}::DOUBLE AS nll,
  sum(p * p) - 2 * max(CASE WHEN cand = gold THEN p END) + 1 AS brier, max(CASE WHEN rk = 1 THEN p END) AS confidence FROM p{x} GROUP BY id)"""


def summary_sql(rows: str = "r", keys: str = "") -> str:
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {k}sum(n)::BIGINT AS n, round(sum(hit) / sum(n), 6) AS accuracy, round(sum(top3) / sum(n), 6) AS top3, round(sum(nll) / sum(n), 6) AS nll, round(sum(brier) / sum(n), 6) AS brier,
round(sum(abs(conf - hit)) / sum(n), 6) AS ece, round(sum(chance) / sum(n), 6) AS chance_accuracy
FROM (SELECT {k}least(9, floor(confidence * 10)) AS bin, count(*) AS n, sum(hit) AS hit, sum(top3) AS top3, sum(nll) AS nll, sum(brier) AS brier, sum(confidence) AS conf, sum(1.0::DOUBLE / n_candidates) AS chance FROM {rows} GROUP BY {k}bin) {g}"""


@query(f"WITH {vector_sql()} {summary_sql()}")
def choice_metrics(spark, sf_dir):
    return rounded(metrics.summarize(vector_rows(spark, sf_dir)))


@query(f"WITH {vector_sql()} SELECT id, gold_rank::INTEGER AS gold_rank, hit, round(nll, 6) AS nll, round(brier, 6) AS brier, round(confidence, 6) AS confidence FROM r")
def choice_rows(spark, sf_dir):
    return rounded(vector_rows(spark, sf_dir).select("id", "gold_rank", "hit", "nll", "brier", "confidence"))


@query(f"WITH {vector_sql()} SELECT id, cand AS choice, round(p, 6) AS probability FROM p WHERE rk = 1")
def choices(spark, sf_dir):
    d = metrics.decide(metrics.require_valid(vector_tasks(spark, sf_dir)))
    return rounded(d.select("id", "choice", F.col("confidence").alias("probability")))


@query(f"""WITH {vector_sql()}, b AS (SELECT least(9, floor(confidence * 10))::INTEGER AS bin, count(*) AS n, avg(confidence) AS c, avg(hit) AS a FROM r GROUP BY 1)
SELECT i::INTEGER AS bin, i / 10.0::DOUBLE AS lower, (i + 1) / 10.0::DOUBLE AS upper, coalesce(n, 0)::BIGINT AS n, round(c, 6) AS confidence, round(a, 6) AS accuracy FROM range(10) t(i) LEFT JOIN b ON b.bin = i""")
def reliability10(spark, sf_dir):
    return rounded(metrics.reliability(vector_rows(spark, sf_dir)))


@query(f"""WITH {vector_sql()}, o AS (SELECT confidence, row_number() OVER (ORDER BY confidence DESC) AS k, count(*) OVER () AS n FROM r),
t AS (SELECT c, confidence AS th FROM o, (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) v(c) WHERE k = ceil(c * n))
SELECT c AS requested_coverage, round(th, 6) AS threshold, round(count(*)::DOUBLE / (SELECT count(*) FROM r), 6) AS coverage, count(*)::BIGINT AS n, round(1 - avg(hit), 6) AS error FROM t JOIN r ON r.confidence >= th GROUP BY c, th""")
def selective_coverage(spark, sf_dir):
    return rounded(metrics.selective(vector_rows(spark, sf_dir)))


TEMPERATURES = [0.25, 0.5, 1.0, 2.0, 4.0]
_GRID = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in TEMPERATURES) + ") g(t)"


@query(f"""WITH {vector_sql()}, q AS (SELECT t, id, cand = gold AS y, (u - mx) / t AS s FROM m, {_GRID}), z AS (SELECT t, id, ln(sum(exp(s))) AS lz FROM q GROUP BY t, id)
SELECT t AS temperature, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier FROM (SELECT t, id, sum(CASE WHEN y THEN lz - s END) AS nll, sum((exp(s - lz) - y::INT) ^ 2) AS brier FROM q JOIN z USING (t, id) GROUP BY t, id) GROUP BY t""")
def temperature_grid(spark, sf_dir):
    rows = vector_tasks(spark, sf_dir)
    nll = calibration.on_grid(rows, TEMPERATURES, "nll").withColumnRenamed("loss", "nll")
    return rounded(nll.join(calibration.on_grid(rows, TEMPERATURES, "brier").withColumnRenamed("loss", "brier"), "temperature"))


@query(f"WITH {vector_sql(2.5)} {summary_sql()}")
def calibrated_metrics(spark, sf_dir):
    return rounded(metrics.summarize(vector_rows(spark, sf_dir, 2.5)))


def _loss_sql(log_t: str) -> str:
    return f"avg(ln(list_sum(list_transform(s, lambda x: exp(x / exp({log_t}))))) - g / exp({log_t}))"


@query(f"""WITH RECURSIVE {vector_sql()}, es AS MATERIALIZED (SELECT id, list(u - mx) AS s, max(CASE WHEN cand = gold THEN u - mx END) AS g FROM m GROUP BY id),
ts(i, lo, hi) AS (SELECT 0, ln(0.05::DOUBLE), ln(20.0::DOUBLE) UNION ALL SELECT any_value(i) + 1, CASE WHEN {_loss_sql("a")} < {_loss_sql("b")} THEN any_value(lo) ELSE any_value(a) END, CASE WHEN {_loss_sql("a")} < {_loss_sql("b")} THEN any_value(b) ELSE any_value(hi) END
  FROM (SELECT *, lo + (hi - lo) * 0.382 AS a, lo + (hi - lo) * 0.618 AS b FROM ts WHERE i < 60), es GROUP BY i),
bs AS (SELECT (lo + hi) / 2 AS t FROM ts WHERE i = 60)
SELECT round(exp(any_value(t)), 4) AS temperature, round({_loss_sql("0")}, 6) AS raw_nll, round({_loss_sql("t")}, 6) AS fitted_nll, false AS at_bound FROM es, bs""")
def temperature_fit(spark, sf_dir):
    found = calibration.fit_temperature(vector_tasks(spark, sf_dir))
    row = (round(found["temperature"], 4), round(found["raw_objective"], 6), round(found["fitted_objective"], 6), found["at_bound"])
    return spark.createDataFrame([row], "temperature double, raw_nll double, fitted_nll double, at_bound boolean")


def weights_sql(rows: str, samples: int, seed: int) -> str:
    """CTEs up to ``wt``: each draw's weight of every cluster of the rows, from the same hashes."""
    steps = " ".join(f"WHEN u < {t} THEN {k}" for k, t in enumerate(resample.THRESHOLDS))
    number = lambda h, at: f"('0x' || substr({h}, {at}, 8))::BIGINT"
    return f"""
fa AS (SELECT draw, 1 + {number("h", 1)} % {resample.PRIME - 1} AS a, 1 + {number("h", 9)} % {resample.PRIME - 1} AS b, {number("h", 17)} % {resample.PRIME} AS c FROM (SELECT draw, md5('{seed}:' || draw) AS h FROM range({samples}) x(draw))),
ki AS (SELECT cluster, {number("h", 1)} % {resample.PRIME} AS x, {number("h", 9)} % {resample.PRIME} AS y FROM (SELECT DISTINCT cluster, md5(cluster::VARCHAR) AS h FROM {rows})),
wt AS (SELECT draw, cluster, CASE {steps} ELSE {len(resample.THRESHOLDS)} END AS w FROM (SELECT draw, cluster, (a * x + b * y + c) % {resample.PRIME} AS u FROM fa, ki))"""


@query(f"""WITH {vector_sql()}, c AS (SELECT id, id % 40 AS cluster, hit, nll, brier, confidence FROM r), {weights_sql("c", 100, 7)},
s AS (SELECT draw, least(9, floor(confidence * 10)) AS bin, sum(w) AS n, sum(w * hit) AS hit, sum(w * nll) AS nll, sum(w * brier) AS brier, sum(w * confidence) AS conf FROM wt JOIN c USING (cluster) GROUP BY 1, 2),
e AS (SELECT draw, sum(hit) / sum(n) AS accuracy, sum(nll) / sum(n) AS nll, sum(brier) / sum(n) AS brier, sum(abs(conf - hit)) / sum(n) AS ece FROM s GROUP BY draw HAVING sum(n) > 0),
l AS (SELECT 'accuracy' AS metric, accuracy AS v FROM e UNION ALL SELECT 'nll', nll FROM e UNION ALL SELECT 'brier', brier FROM e UNION ALL SELECT 'ece', ece FROM e)
SELECT metric, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM l GROUP BY metric""")
def bootstrap_ci(spark, sf_dir):
    rows = vector_rows(spark, sf_dir).withColumn("cluster", F.col("id") % 40)
    return rounded(resample.intervals(resample.draws(rows, samples=100, seed=7)))


@query(f"""WITH {vector_sql()}, {vector_sql(1.0, 5.0, "r2")}, c AS (SELECT r.id % 40 AS cluster, r2.hit - r.hit AS hit, r2.nll - r.nll AS nll, r2.brier - r.brier AS brier FROM r JOIN r2 USING (id)), {weights_sql("c", 100, 42)},
e AS (SELECT draw, sum(w * hit) / sum(w) AS accuracy, sum(w * nll) / sum(w) AS nll, sum(w * brier) / sum(w) AS brier FROM wt JOIN c USING (cluster) GROUP BY draw HAVING sum(w) > 0),
l AS (SELECT 'accuracy' AS metric, accuracy AS v FROM e UNION ALL SELECT 'nll', nll FROM e UNION ALL SELECT 'brier', brier FROM e)
SELECT metric, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM l GROUP BY metric""")
def paired_difference(spark, sf_dir):
    a, b = (vector_rows(spark, sf_dir, scale=s).withColumn("cluster", F.col("id") % 40) for s in (10.0, 5.0))
    return rounded(resample.intervals(resample.draws(resample.paired(a, b), samples=100, seed=42, ece=False)))


@query(f"""WITH {vector_sql()} SELECT id, (CASE WHEN nx IS NOT NULL THEN nx ELSE fi END)::BIGINT AS context FROM
(SELECT id, lead(id) OVER w AS nx, first_value(id) OVER w AS fi FROM (SELECT vec_id AS id FROM embeddings) WINDOW w AS (PARTITION BY id // 64 ORDER BY id))""".replace(f"WITH {vector_sql()} ", ""))
def shuffled_control(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("context"))
    return tasks.shuffled_contexts(rows, ordinal="id", context="context", batch=64)


@query("SELECT round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 2) AS mean_norm FROM embeddings")
def mean_norms(spark, sf_dir):
    return scorers.mean_norm(table(spark, sf_dir, "embeddings"), vector="embedding")


@query("""SELECT vec_id, round(list_aggregate([embedding[17], embedding[25], embedding[33]]::DOUBLE[], 'median'), 6) AS left, round(list_aggregate([embedding[20], embedding[28], embedding[36]]::DOUBLE[], 'median'), 6) AS center,
round(list_aggregate([embedding[23], embedding[24], embedding[31], embedding[32], embedding[39], embedding[40]]::DOUBLE[], 'median'), 6) AS right FROM embeddings""")
def depth_bands(spark, sf_dir):
    # a vector stands for a depth frame of eight by eight
    frame = F.transform("embedding", lambda x: x.cast("double"))
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", X.depth_bands(frame, 8, 8).alias("d")).select("vec_id", "d.left", "d.center", "d.right"))


@query("SELECT label, i::INTEGER AS dim, round(avg(embedding[i]::DOUBLE), 6) AS pooled FROM embeddings, range(1, 65) t(i) WHERE vec_id % 7 <> 0 GROUP BY label, i")
def pooled_mean(spark, sf_dir):
    # padding and sentinels are masked out; here every seventh vector stands for them
    tokens = table(spark, sf_dir, "embeddings").withColumn("is_real", F.col("vec_id") % 7 != 0)
    out = scorers.pooled(tokens, keys=["label"], vector="embedding")
    return rounded(out.select("label", F.posexplode("pooled").alias("dim", "pooled")).withColumn("dim", F.col("dim") + 1))


HEAD = scorers.AttentionHead.random(64, 16)


def _unit_sql(key: str, vector: str, source: str) -> str:
    """Rows with a vector of mean 0 and variance 1."""
    mean = f"SELECT {key}, {vector}::DOUBLE[] AS w, list_avg({vector}::DOUBLE[]) AS mu FROM {source}"
    return f"SELECT {key}, list_transform(w, lambda x: (x - mu) / sd) AS x FROM (SELECT *, sqrt(list_avg(list_transform(w, lambda y: (y - mu) * (y - mu))) + 1e-5) AS sd FROM ({mean}))"


def _project_sql(vector: str, weights) -> str:
    return "[" + ", ".join(f"list_dot_product({vector}, {[float(x) for x in column]}::DOUBLE[])" for column in weights.T) + "]"


@query(f"""WITH cm AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS a FROM embeddings, range(1, 65) t(i) GROUP BY label, i), ct AS (SELECT label, list(a ORDER BY i) AS c FROM cm GROUP BY label),
os AS ({_unit_sql("label", "c", "ct")}), cs AS ({_unit_sql("vec_id", "embedding", "embeddings")}),
qs AS (SELECT row_number() OVER (ORDER BY label) - 1 AS pos, {_project_sql("x", HEAD.query)} AS q FROM os), vs AS (SELECT vec_id AS id, {_project_sql("x", HEAD.value)} AS v FROM cs),
ls AS (SELECT id, pos, list_dot_product(q, v) / 4 AS s FROM qs, vs), ps AS (SELECT id, pos, s, exp(s - max(s) OVER (PARTITION BY id)) AS e, row_number() OVER (PARTITION BY id ORDER BY s DESC, pos) AS rk FROM ls)
SELECT id, max(CASE WHEN rk = 1 THEN pos END)::INTEGER AS best, round(1 / sum(e), 6) AS confidence FROM ps GROUP BY id""")
def attention_head(spark, sf_dir):
    # a context of one token has all the attention, so the weights of keys don't count here
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("gold"), F.array("embedding").alias("context"), "embedding")
    one = scorers.centroids(v, label="gold").agg(F.transform(F.array_sort(F.collect_list(F.struct("gold", "centroid"))), lambda e: e["centroid"]).alias("options"))
    scored = scorers.score_attention(v.select("id", "gold", "context").crossJoin(F.broadcast(one)), HEAD)
    return rounded(metrics.decide(scored.select("id", "scores"), tie="position").select("id", "best", "confidence"))


# ---- order lines as ragged tasks: 1 to 13 candidates, scored by quantity; the dearest line is gold

def line_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("c"))
    price = F.transform("c", lambda c: c["l_extendedprice"])
    return rows.select("id", F.transform("c", lambda c: c["l_quantity"] / 10).alias("scores"), S.first_best(price).alias("label"), F.transform("c", lambda c: c["l_partkey"]).alias("parts"), price.alias("prices"))


LINES = """
lp AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos, l_partkey, l_extendedprice, l_quantity / 10 AS s FROM lineitem),
lg AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_extendedprice DESC, pos) = 1 AS gold, row_number() OVER (PARTITION BY id ORDER BY s DESC, pos) AS rk, max(s) OVER (PARTITION BY id) AS mx, count(*) OVER (PARTITION BY id) AS n FROM lp),
lq AS (SELECT *, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY id) AS p FROM lg),
lr AS (SELECT id, count(*) AS n_candidates, max(CASE WHEN gold THEN (rk = 1)::INT END)::DOUBLE AS hit, max(CASE WHEN gold THEN (rk <= 3)::INT END)::DOUBLE AS top3, max(CASE WHEN gold THEN rk END) - 1 AS gold_rank,
  ln(sum(exp(s - mx))) + max(mx) - max(CASE WHEN gold THEN s END) AS nll, sum(p * p) - 2 * max(CASE WHEN gold THEN p END) + 1 AS brier, max(CASE WHEN rk = 1 THEN p END) AS confidence FROM lq GROUP BY id)"""


@query(f"""WITH {LINES}, st AS (SELECT 'candidates' AS stratum, CASE WHEN n_candidates = 1 THEN '1' WHEN n_candidates <= 10 THEN '2-10' WHEN n_candidates <= 25 THEN '11-25' ELSE '26+' END AS value, * FROM lr
UNION ALL SELECT 'gold_rank', gold_rank::VARCHAR, * FROM lr) {summary_sql("st", "stratum, value")}""")
def strata_metrics(spark, sf_dir):
    rows = metrics.metric_rows(line_tasks(spark, sf_dir), tie="position").withColumn("candidates", X.candidate_bucket(F.col("n_candidates")))
    return rounded(metrics.strata(rows, "candidates", "gold_rank"))


@query(f"WITH {LINES}, fo AS (SELECT *, n_candidates = 1 AS forced FROM lr) {summary_sql('fo', 'forced')}")
def forced_vs_open(spark, sf_dir):
    rows = metrics.metric_rows(line_tasks(spark, sf_dir), tie="position").withColumn("forced", F.col("n_candidates") == 1)
    return rounded(metrics.summarize(rows, "forced"))


# two variants of the line scores, raw and by a temperature of each

VARIANTS = {"base": 2.0, "other": 0.5}
VARIANT_ROWS = f"""{LINES},
vp AS (SELECT variant, mode, id, pos, l_extendedprice, (lp.s + CASE WHEN variant = 'other' THEN l_extendedprice / 20000 ELSE 0 END)::DOUBLE / CASE WHEN mode = 'raw' THEN 1.0 WHEN variant = 'base' THEN {VARIANTS["base"]} ELSE {VARIANTS["other"]} END::DOUBLE AS s
  FROM lp, (VALUES ('base'), ('other')) v(variant), (VALUES ('raw'), ('calibrated')) m(mode)),
vg AS (SELECT *, row_number() OVER (PARTITION BY variant, mode, id ORDER BY l_extendedprice DESC, pos) = 1 AS gold, row_number() OVER (PARTITION BY variant, mode, id ORDER BY s DESC, pos) AS rk, max(s) OVER (PARTITION BY variant, mode, id) AS mx FROM vp),
vq AS (SELECT *, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY variant, mode, id) AS p FROM vg),
vr AS (SELECT variant, mode, id, count(*) AS n_candidates, max(CASE WHEN gold THEN (rk = 1)::INT END)::DOUBLE AS hit, max(CASE WHEN gold THEN (rk <= 3)::INT END)::DOUBLE AS top3,
  ln(sum(exp(s - mx))) + max(mx) - max(CASE WHEN gold THEN s END) AS nll, sum(p * p) - 2 * max(CASE WHEN gold THEN p END) + 1 AS brier, max(CASE WHEN rk = 1 THEN p END) AS confidence FROM vq GROUP BY variant, mode, id)"""


def line_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows of both variants, with a rating and a cluster."""
    versions = F.explode(F.array(F.struct(F.lit("base").alias("variant"), F.col("scores").alias("s")), F.struct(F.lit("other").alias("variant"), F.zip_with("scores", "prices", lambda s, p: s + p / 20000).alias("s"))))
    rows = line_tasks(spark, sf_dir).select("id", "label", (F.col("id") % 40).alias("cluster"), (F.col("id") % 2000).cast("double").alias("rating"), versions.alias("v"))
    return rows.select("id", "label", "cluster", F.when(F.col("rating") < 1900, F.col("rating")).alias("rating"), "v.variant", F.col("v.s").cast("array<double>").alias("scores"))


@query(f"""WITH {VARIANT_ROWS}, sv AS (SELECT 'all' AS stratum, 'all' AS value, * FROM vr UNION ALL SELECT 'candidates', CASE WHEN n_candidates = 1 THEN '1' WHEN n_candidates <= 10 THEN '2-10' WHEN n_candidates <= 25 THEN '11-25' ELSE '26+' END, * FROM vr
UNION ALL SELECT 'rating', CASE WHEN id % 2000 < 1000 THEN '<1000' WHEN id % 2000 < 1400 THEN '1000-1399' WHEN id % 2000 < 1800 THEN '1400-1799' ELSE '1800+' END, * FROM vr WHERE id % 2000 < 1900) {summary_sql("sv", "variant, mode, stratum, value")}""")
def variant_strata(spark, sf_dir):
    return rounded(experiment.variant_strata(experiment.variant_rows(line_variants(spark, sf_dir), VARIANTS)))


@query(f"""WITH {VARIANT_ROWS}, cm(a_variant, a_mode, b_variant, b_mode) AS (VALUES ('base', 'raw', 'base', 'calibrated'), ('other', 'raw', 'other', 'calibrated'), ('base', 'raw', 'other', 'raw'), ('base', 'calibrated', 'other', 'calibrated')),
c AS (SELECT b_variant || '/' || b_mode || ' minus ' || a_variant || '/' || a_mode AS comparison, a.id % 40 AS cluster, b.hit - a.hit AS hit, b.nll - a.nll AS nll, b.brier - a.brier AS brier
  FROM cm JOIN vr a ON a.variant = a_variant AND a.mode = a_mode JOIN vr b ON b.variant = b_variant AND b.mode = b_mode AND b.id = a.id), {weights_sql("c", 100, 42)},
k AS (SELECT comparison, cluster, count(*) AS n, sum(hit) AS hit, sum(nll) AS nll, sum(brier) AS brier FROM c GROUP BY 1, 2),
e AS (SELECT comparison, draw, sum(w * hit) / sum(w * n) AS accuracy, sum(w * nll) / sum(w * n) AS nll, sum(w * brier) / sum(w * n) AS brier FROM wt JOIN k USING (cluster) GROUP BY 1, 2 HAVING sum(w) > 0),
l AS (SELECT comparison, 'accuracy' AS metric, accuracy AS v FROM e UNION ALL SELECT comparison, 'nll', nll FROM e UNION ALL SELECT comparison, 'brier', brier FROM e)
SELECT comparison, metric, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM l GROUP BY 1, 2""")
def variant_differences(spark, sf_dir):
    rows = experiment.variant_differences(experiment.variant_rows(line_variants(spark, sf_dir), VARIANTS))
    return rounded(resample.intervals(resample.draws(rows, samples=100, seed=42, ece=False, by=("comparison",)), "comparison"))


@query(f"WITH {LINES} SELECT id, rk::INTEGER AS place, pos::INTEGER AS pos, l_partkey AS part FROM lg WHERE rk <= 3")
def topk_per_task(spark, sf_dir):
    rows = line_tasks(spark, sf_dir).select("id", "parts", F.posexplode(S.top_positions(F.col("scores"), 3)).alias("place", "pos"))
    return rows.select("id", (F.col("place") + 1).alias("place"), "pos", F.get("parts", F.col("pos")).alias("part"))


@query(f"WITH {LINES} SELECT id, min(k)::INTEGER AS best_rank, max(k)::INTEGER AS worst_rank FROM (SELECT id, rank() OVER (PARTITION BY id ORDER BY s DESC) AS k FROM lp) GROUP BY id")
def rank_ties(spark, sf_dir):
    ranks = F.transform("scores", lambda v: S.competition_rank(F.col("scores"), v))
    return line_tasks(spark, sf_dir).select("id", F.array_min(ranks).alias("best_rank"), F.array_max(ranks).alias("worst_rank"))


@query(f"WITH {LINES} SELECT count(*) AS n, round(avg(hit), 6) AS top1, round(avg(top3), 6) AS top3, round(avg(gold_rank), 6) AS mean_rank, round(avg(1.0::DOUBLE / n_candidates), 6) AS chance FROM lr")
def rank_evaluation(spark, sf_dir):
    return rounded(metrics.rank_evaluation(line_tasks(spark, sf_dir)))


@query(f"WITH {LINES} SELECT round(avg(1.0::DOUBLE / n_candidates), 6) AS expected_accuracy, round(avg(ln(n_candidates::DOUBLE)), 6) AS nll, round(avg(1 - 1.0::DOUBLE / n_candidates), 6) AS brier FROM lr")
def uniform_baseline(spark, sf_dir):
    return rounded(metrics.uniform_baseline(line_tasks(spark, sf_dir)))


@query(f"""WITH {LINES} SELECT count(*) AS examples, count(*) FILTER (id % 3 <> 0) AS labelled, round(avg(hit) FILTER (id % 3 <> 0), 6) AS top1, round(avg(top3) FILTER (id % 3 <> 0), 6) AS top3,
round(median((n_candidates * 10 + id % 7) / 1000.0::DOUBLE), 6) AS median_seconds, round(avg((n_candidates * 10 + id % 7) / 1000.0::DOUBLE), 6) AS mean_seconds FROM lr""")
def legacy_evaluation(spark, sf_dir):
    # every third row has no label; the time is made up from the row
    rows = line_tasks(spark, sf_dir).withColumns({"label": F.when(F.col("id") % 3 != 0, F.col("label")), "seconds": (F.size("scores") * 10 + F.col("id") % 7) / 1000})
    return rounded(metrics.legacy_evaluation(rows))


@query(f"""WITH {LINES}, mv AS (SELECT id, l_partkey AS mv, max(l_extendedprice) AS price FROM lp GROUP BY 1, 2), rf AS (SELECT id, mv, CASE WHEN id % 11 = 0 AND mv % 5 = 0 THEN NULL ELSE floor(price / 100) END AS cp, rank() OVER (PARTITION BY id ORDER BY price DESC) AS rank FROM mv),
jd AS (SELECT id, max(cp) AS best, bool_and(cp IS NOT NULL) AS ok FROM rf GROUP BY id), ch AS (SELECT id, l_partkey AS mv FROM lg WHERE rk = 1), x AS (SELECT ok, CASE WHEN ok THEN best - cp END AS loss, rank FROM ch JOIN rf USING (id, mv) JOIN jd USING (id))
SELECT count(*) AS n, count(loss) AS cp_n, count(*) FILTER (NOT ok) AS mate_positions, round(avg(loss), 6) AS mean_cp_loss, round(avg((loss <= 50)::INT), 6) AS within_tolerance_rate, round(avg((rank = 1)::INT), 6) AS engine_best_match_rate, round(avg(rank), 6) AS mean_rank FROM x""")
def move_quality(spark, sf_dir):
    rows = line_tasks(spark, sf_dir).select(F.col("id").alias("fen"), F.col("parts").alias("candidates"), "scores")
    moves = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fen"), F.col("l_partkey").alias("move")).agg(F.max("l_extendedprice").alias("price"))
    hidden = (F.col("fen") % 11 == 0) & (F.col("move") % 5 == 0)
    refs = moves.select("fen", "move", F.when(~hidden, F.floor(F.col("price") / 100).cast("double")).alias("cp"), F.rank().over(Window.partitionBy("fen").orderBy(F.desc("price"))).alias("rank"))
    return rounded(metrics.move_quality(rows, refs, 50))


@query("SELECT l_orderkey AS fen, l_partkey AS move FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey % 13 = 0")
def missing_references(spark, sf_dir):
    rows = line_tasks(spark, sf_dir).select(F.col("id").alias("fen"), F.col("parts").alias("candidates"))
    refs = table(spark, sf_dir, "lineitem").where(F.col("l_partkey") % 13 != 0).select(F.col("l_orderkey").alias("fen"), F.col("l_partkey").alias("move")).distinct()
    return metrics.missing_references(rows, refs)


@query(f"""WITH {LINES}, c AS (SELECT id, pos, sum(pow(greatest(p, 1e-9::DOUBLE), 1 / 0.7::DOUBLE)) OVER (PARTITION BY id ORDER BY pos) AS s, sum(pow(greatest(p, 1e-9::DOUBLE), 1 / 0.7::DOUBLE)) OVER (PARTITION BY id) AS t, n,
('0x' || substr(md5('play:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS r FROM lq) SELECT id, least(count(*) FILTER (s <= r * t), max(n) - 1)::INTEGER AS drawn FROM c GROUP BY id""")
def weighted_choice(spark, sf_dir):
    rows = line_tasks(spark, sf_dir).withColumn("probabilities", S.softmax(F.col("scores")))
    return resample.sampled_choice(rows, "play", 0.7).select("id", "drawn")


@query(f"WITH {LINES} SELECT id, bool_and(n > 1) AS open, count(*)::INTEGER AS n, round(ln(sum(exp(s - mx))), 6) AS log_sum FROM lg GROUP BY id")
def log_softmax_sums(spark, sf_dir):
    top = F.array_max(S.log_softmax(F.col("scores")))
    return rounded(line_tasks(spark, sf_dir).select("id", (F.size("scores") > 1).alias("open"), F.size("scores").alias("n"), (-top).alias("log_sum")))


# ---- customers' order priorities as ordered levels

LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""WITH c AS (SELECT o_custkey, l.lv, count(o_orderkey) FILTER (o_orderpriority = l.name)::DOUBLE AS n FROM orders, (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(LEVELS))}) l(lv, name) GROUP BY 1, 2),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY o_custkey) AS p FROM c)
SELECT o_custkey, round(sum(lv * p), 6) AS expected_level, round(greatest(0, least(1, 1 + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(5.0::DOUBLE))), 6) AS certainty, round(max(CASE WHEN lv = 0 THEN p END), 6) AS yes FROM p GROUP BY o_custkey""")
def confidence_and_level(spark, sf_dir):
    n = [F.count(F.when(F.col("o_orderpriority") == x, 1)).cast("double") for x in LEVELS]
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array(*n).alias("n"))
    rows = rows.withColumn("p", F.transform("n", lambda x: x / S.total(F.col("n"))))
    return rounded(rows.select("o_custkey", S.expected_level(F.col("p")).alias("expected_level"), S.certainty(F.col("p")).alias("certainty"), S.yes_probability(F.col("p")).alias("yes")))


# ---- documents and labels as yes-or-no questions

@query(f"""WITH d AS (SELECT doc_id AS id, quality, ln(1 + coalesce(n_chars, 0)) - 7 AS s FROM documents JOIN labels USING (doc_id)), p AS (SELECT *, 1 / (1 + exp(-s)) AS yes FROM d),
nr AS (SELECT id, 2 AS n_candidates, ((s >= 0) = (quality = 1))::INT::DOUBLE AS hit, 1.0::DOUBLE AS top3, CASE WHEN quality = 1 THEN ln(1 + exp(-abs(s))) + greatest(-s, 0) ELSE ln(1 + exp(-abs(s))) + greatest(s, 0) END AS nll,
CASE WHEN quality = 1 THEN 2 * (1 - yes) ^ 2 ELSE 2 * yes ^ 2 END AS brier, greatest(yes, 1 - yes) AS confidence FROM p) {summary_sql("nr")}""")
def noul_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    score = F.ln(1 + F.coalesce("n_chars", F.lit(0))) - 7
    rows = rows.select(F.col("doc_id").alias("id"), F.array(score, F.lit(0.0)).alias("scores"), F.when(F.col("quality") == 1, 0).otherwise(1).alias("label"))
    return rounded(metrics.summarize(metrics.metric_rows(rows, tie="position")))


@query("""WITH t AS (SELECT source, lang AS text, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), c AS (SELECT text, sum(n) AS n FROM t GROUP BY text), l AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL),
s AS (SELECT doc_id AS id, d.lang AS gold, l.lang AS cand, ln(coalesce(n, 0) + 1.0::DOUBLE) AS s FROM documents d, l LEFT JOIN c ON c.text = l.lang WHERE doc_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, cand) AS rk, max(s) OVER (PARTITION BY id) AS mx FROM s)
SELECT count(DISTINCT id) AS n, round(avg(CASE WHEN cand = gold THEN (rk = 1)::INT END), 6) AS accuracy, round(avg(CASE WHEN cand = gold THEN z + mx - s END), 6) AS nll FROM r JOIN (SELECT id, ln(sum(exp(s - mx))) AS z FROM r GROUP BY id) USING (id)""")
def text_prior_baseline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    langs = docs.where("lang is not null").agg(F.array_sort(F.collect_set("lang")).alias("texts"))
    rows = docs.crossJoin(F.broadcast(langs)).withColumn("label", (F.array_position("texts", F.col("lang")) - 1).cast("int")).withColumn("ids", F.col("texts"))
    scored = resample.text_prior(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))
    s = metrics.summarize(metrics.metric_rows(scored))
    return rounded(s.select("n", "accuracy", "nll"))


# ---- the bigram scorer: trained on documents, it scores fixed replies to every turn

REPLIES = ["the reply", "and of the", "la de", "unheard words"]
_TOKENS = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> '')"
BIGRAMS = rf"""
bt AS (SELECT list_prepend('<s>', {_TOKENS.format("text")}) AS t FROM documents WHERE text IS NOT NULL),
bg AS (SELECT a, b, count(*) AS n FROM (SELECT t[i] AS a, t[i + 1] AS b FROM (SELECT t, unnest(range(1, len(t))) AS i FROM bt)) GROUP BY a, b),
un AS (SELECT a, sum(n) AS n FROM bg GROUP BY a),
vo AS (SELECT count(DISTINCT b) AS v FROM bg),
ct AS (SELECT conv_id || ':' || turn AS id, coalesce({_TOKENS.format("text")}[-1], '<s>') AS last FROM conversations),
op AS (SELECT pos, option, {_TOKENS.format("option")} AS t FROM (VALUES {", ".join(f"({i}, '{r}')" for i, r in enumerate(REPLIES))}) o(pos, option)),
st AS (SELECT id, pos, len(t) AS nt, unnest(list_zip(list_prepend(last, t[:-2]), list_prepend('<s>', t[:-2]), t)) AS z FROM ct, op),
lg AS (SELECT id, pos, nt, ln((coalesce(g.n, 0) + 0.5::DOUBLE) / (coalesce(n1.n, 0) + 0.5::DOUBLE * v)) AS lp, ln((coalesce(h.n, 0) + 0.5::DOUBLE) / (coalesce(n2.n, 0) + 0.5::DOUBLE * v)) AS lu
  FROM (SELECT id, pos, nt, z[1] AS a, z[2] AS u, z[3] AS b FROM st), vo LEFT JOIN bg g ON g.a = st_a AND g.b = st_b LEFT JOIN bg h ON h.a = st_u AND h.b = st_b LEFT JOIN un n1 ON n1.a = st_a LEFT JOIN un n2 ON n2.a = st_u),
sc AS (SELECT id, pos, nt, sum(lp) AS ls, sum(lu) AS lu FROM lg GROUP BY id, pos, nt)""".replace("z[1] AS a, z[2] AS u, z[3] AS b FROM st), vo", "z[1] AS st_a, z[2] AS st_u, z[3] AS st_b FROM st) CROSS JOIN vo")


def reply_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("context"), F.array(*[F.lit(r) for r in REPLIES]).alias("options"))


def document_bigrams(spark: SparkSession, sf_dir: str) -> scorers.Bigrams:
    return scorers.train_bigrams(table(spark, sf_dir, "documents").where("text is not null"))


@query(f"WITH {BIGRAMS} SELECT id, pos, nt::INTEGER AS n_tokens, round(ls, 6) AS logprob_sum, round(lu, 6) AS logprob_uncond, round(ls / nt, 6) AS mean, round(ls - lu, 6) AS pmi FROM sc")
def ngram_scores(spark, sf_dir):
    s = scorers.score_bigrams(reply_tasks(spark, sf_dir), document_bigrams(spark, sf_dir))
    norm = lambda n: S.normalised(n, F.col("logprob_sum"), F.col("n_tokens"), F.col("logprob_uncond")).alias(n)
    return rounded(s.select("id", "pos", "n_tokens", "logprob_sum", "logprob_uncond", norm("mean"), norm("pmi")))


@query(f"WITH {BIGRAMS}, e AS (SELECT *, exp(ls / nt) AS e FROM sc) SELECT id, arg_max(pos, (e, -pos))::INTEGER AS best, round(max(e) / sum(e), 6) AS confidence FROM e GROUP BY id")
def ngram_choice(spark, sf_dir):
    spread = scorers.distributions(scorers.score_bigrams(reply_tasks(spark, sf_dir), document_bigrams(spark, sf_dir)), norm="mean")
    return rounded(metrics.decide(spread, tie="position").select("id", "best", "confidence"))


@query(f"WITH {BIGRAMS} SELECT pos, count(*) AS n, round(avg(ls), 6) AS shared, round(avg(ls), 6) AS naive FROM sc GROUP BY pos")
def ngram_shared_vs_naive(spark, sf_dir):
    rows, model = reply_tasks(spark, sf_dir), document_bigrams(spark, sf_dir)
    a, b = scorers.score_bigrams(rows, model), scorers.score_naive(rows, model)
    both = a.select("id", "pos", F.col("logprob_sum").alias("shared")).join(b.select("id", "pos", F.col("logprob_sum").alias("naive")), ["id", "pos"])
    return rounded(both.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.avg("shared").alias("shared"), F.avg("naive").alias("naive")))


@query(rf"SELECT sum(len({_TOKENS.format('text')}))::BIGINT AS input_tokens, count(*)::BIGINT * {sum(len(r.split()) for r in REPLIES)} AS output_tokens FROM conversations")
def token_usage(spark, sf_dir):
    rows, model = reply_tasks(spark, sf_dir), document_bigrams(spark, sf_dir)
    return scorers.token_usage(scorers.score_bigrams(rows, model), rows, model)


# ---- typed questions about each turn

def turn_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda name, desc: F.struct(F.lit(name).alias("name"), F.lit(desc).cast("string").alias("desc"))
    kinds = [
        ("topic", "choice", '"Which topic?"', [entry("the", '"a first one"'), entry("la", None), entry("und", '"a third"')]),
        ("heat", "score", None, [entry("0", '"calm"'), entry("1", None), entry("2", '"angry"')]),
        ("asks", "noul", '"Is it a question?"', [entry("true", '"it asks"')]),
    ]
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("qid"), F.lit(i).alias("ordinal"), F.lit(t).alias("type"), F.lit(s).cast("string").alias("instructions"), F.array(*c).alias("criteria")) for i, (q, t, s, c) in enumerate(kinds)]))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), X.json_string(F.col("text")).alias("state"))
    return turns.select("request_id", "state", asked.alias("q")).select("request_id", "state", "q.*")


ANSWERS = rf"""{BIGRAMS}, lb AS (SELECT * FROM (VALUES ('topic', 0, 'the'), ('topic', 1, 'la'), ('topic', 2, 'und'), ('heat', 0, '0'), ('heat', 1, '1'), ('heat', 2, '2'), ('asks', 0, 'yes'), ('asks', 1, 'no')) x(qid, pos, label)),
ls AS (SELECT qid, pos, label, (coalesce(g.n, 0) + 0.5::DOUBLE) / (coalesce(u.n, 0) + 0.5::DOUBLE * v) AS e FROM lb CROSS JOIN vo LEFT JOIN bg g ON g.a = 'answer:' AND g.b = label LEFT JOIN un u ON u.a = 'answer:'),
pr AS (SELECT *, e / sum(e) OVER (PARTITION BY qid) AS p FROM ls),
an AS (SELECT qid, arg_max(label, (p, -pos)) AS best, sum(pos * p) AS lv, max(CASE WHEN pos = 0 THEN p END) AS first, greatest(0, least(1, 1 + sum(p * ln(p)) / ln(count(*)::DOUBLE))) AS cf, count(*) AS n FROM pr GROUP BY qid),
tk AS (SELECT conv_id || ':' || turn AS request_id, len({_TOKENS.format("text")}) + CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 END AS k FROM conversations)"""
_ASKED = "CASE qid WHEN 'topic' THEN 3 + 4 + 1 + 5 + 2 + 4 + 1 WHEN 'heat' THEN 12 + 1 + 2 + 1 + 2 + 1 + 1 ELSE 5 + 5 + 4 + 1 END"


@query(rf"""WITH {ANSWERS}
SELECT request_id, qid, CASE WHEN qid = 'topic' THEN best END AS choice, CASE WHEN qid = 'heat' THEN round(lv, 6) END AS score, CASE WHEN qid = 'asks' THEN round(first, 6) END AS noul, CASE WHEN qid <> 'asks' THEN round(cf, 6) END AS confidence,
(k + {_ASKED})::BIGINT AS input_tokens, n::BIGINT AS output_tokens FROM tk, an""")
def systemone_answers(spark, sf_dir):
    model = document_bigrams(spark, sf_dir)
    a = systemone.system_one(turn_questions(spark, sf_dir), model)
    return rounded(a.select("request_id", "qid", "choice", "score", "noul", "confidence", "input_tokens", "output_tokens"))


@query(rf"""WITH {ANSWERS}
SELECT request_id, max(CASE WHEN qid = 'topic' THEN best END) AS topic, round(max(CASE WHEN qid = 'heat' THEN lv END), 6) AS heat, round(max(CASE WHEN qid = 'asks' THEN first END), 6) AS asks, sum(k + {_ASKED})::BIGINT AS input_tokens, sum(n)::BIGINT AS output_tokens FROM tk, an GROUP BY request_id""")
def systemone_responses(spark, sf_dir):
    found = systemone.responses(systemone.system_one(turn_questions(spark, sf_dir), document_bigrams(spark, sf_dir)))
    of = lambda q, f, name: F.element_at("answers", F.lit(q))[f].alias(name)
    return rounded(found.select("request_id", of("topic", "choice", "topic"), of("heat", "score", "heat"), of("asks", "noul", "asks"), "input_tokens", "output_tokens"))


# ---- contracts: fingerprints, leakage, audits, clusters, splits

def document_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row"), F.col("doc_id").cast("string").alias("id"), X.input_fingerprint(X.json_string(F.coalesce("text", F.lit(""))), F.lit("Which language?"), F.array(F.lit("en"), F.lit("de"), F.coalesce("lang", F.lit("?")))).alias("fingerprint"), F.col("source").alias("group_id"), F.coalesce(F.element_at(F.array(*[F.lit(s) for s in splits.SPLITS]), (F.col("doc_id") % 4 + 1).cast("int")), F.lit("?")).alias("split"), "text", "lang")


PRINTS = """fp AS (SELECT doc_id, source, ['train', 'valid', 'calibration', 'test'][doc_id % 4 + 1] AS split, sha256('{"candidates":[' || array_to_string(list_transform(list_sort(['en', 'de', coalesce(lang, '?')]), lambda x: '"' || x || '"'), ',') || '],"question":"Which language?","state":' || to_json(coalesce(text, ''))::VARCHAR || '}') AS fingerprint FROM documents)"""


@query(f"WITH {PRINTS} SELECT doc_id::VARCHAR AS id, fingerprint FROM fp")
def input_fingerprints(spark, sf_dir):
    return document_tasks(spark, sf_dir).select("id", "fingerprint")


@query(f"WITH {PRINTS} SELECT fingerprint, count(*) AS n, min(doc_id) AS first FROM fp GROUP BY fingerprint HAVING count(*) > 1")
def duplicate_inputs(spark, sf_dir):
    return document_tasks(spark, sf_dir).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1")


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.provenance_by(document_tasks(spark, sf_dir).where(F.col("split").isin(*splits.SPLITS)), "split")


KEYS = f"{PRINTS}, ky AS (SELECT DISTINCT split, kind, key FROM (SELECT split, 'id' AS kind, doc_id::VARCHAR AS key FROM fp UNION ALL SELECT split, 'input', fingerprint FROM fp UNION ALL SELECT split, 'group', source FROM fp) WHERE key IS NOT NULL)"


@query(f"WITH {KEYS} SELECT kind, key, array_to_string(list_sort(list(split)), ',') AS splits FROM ky GROUP BY kind, key HAVING count(*) > 1")
def split_overlap(spark, sf_dir):
    return tasks.overlaps(_provenance(spark, sf_dir)).withColumn("splits", F.array_join("splits", ","))


@query(f"""WITH {KEYS}, o AS (SELECT *, list_position(['train', 'valid', 'calibration', 'test'], split) AS k FROM ky), f AS (SELECT *, min(k) OVER (PARTITION BY kind, key) AS first FROM o)
SELECT kind, key, ['train', 'valid', 'calibration', 'test'][first] AS first_split, split FROM f WHERE k > first""")
def split_audit(spark, sf_dir):
    return tasks.audit_overlaps(_provenance(spark, sf_dir), list(splits.SPLITS))


@query(f"WITH {PRINTS} SELECT split, sum(n)::BIGINT AS n, sum(n - 1)::BIGINT AS duplicates FROM (SELECT split, fingerprint, count(*) AS n FROM fp GROUP BY ALL) GROUP BY split")
def duplicate_counts(spark, sf_dir):
    return tasks.split_counts(document_tasks(spark, sf_dir), position="fingerprint")


@query("WITH g AS (SELECT md5(text) AS key, min(doc_id) AS row, count(*) - 1 AS removed, min(quality) <> max(quality) AS conflict FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT key, row, removed, conflict FROM g")
def dedup_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.md5("text").alias("key"), F.col("doc_id").alias("row"), "quality")
    return tasks.keep_first(rows, "key", "row", "quality").select("key", "row", "removed", "conflict")


def event_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events linked by user within blocks of 50 ids, and by type and rounded value within blocks of 400."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("row"), "user_id", "event_type", "value")
    keys = F.array(F.struct(F.lit("user").alias("kind"), F.concat_ws(":", F.floor(F.col("row") / 50), "user_id").alias("value")), F.struct(F.lit("value").alias("kind"), F.concat_ws(":", F.floor(F.col("row") / 400), "event_type", F.floor("value")).alias("value")))
    return e, e.select("row", F.explode(keys).alias("k")).select("row", "k.kind", "k.value")


CLUSTERS = """ek AS (SELECT event_id AS r, 'user' AS kind, (event_id // 50) || ':' || user_id AS v FROM events UNION ALL SELECT event_id, 'value', (event_id // 400) || ':' || event_type || ':' || floor(value)::BIGINT FROM events),
ee AS (SELECT DISTINCT r AS a, m AS b FROM (SELECT r, min(r) OVER (PARTITION BY kind, v) AS m FROM ek) UNION SELECT DISTINCT m, r FROM (SELECT r, min(r) OVER (PARTITION BY kind, v) AS m FROM ek)),
cc AS (SELECT event_id AS r, event_id AS c FROM events UNION SELECT ee.b, cc.c FROM cc JOIN ee ON ee.a = cc.r WHERE cc.c < ee.b)"""


@query(f"WITH RECURSIVE {CLUSTERS} SELECT r AS row, min(c) AS cluster FROM cc GROUP BY r")
def clusters(spark, sf_dir):
    return splits.clusters(*event_keys(spark, sf_dir))


@query(f"""WITH RECURSIVE {CLUSTERS}, ks AS (SELECT r, min(c) AS c FROM cc GROUP BY r), zs AS (SELECT count(*) AS size FROM ks GROUP BY c), os AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS i, count(*) OVER () AS n, (sum(size) OVER ())::DOUBLE AS total FROM zs),
ls AS (SELECT any_value(n) AS n, any_value(total) AS total, list(struct_pack(size := size::BIGINT, seen := 0::BIGINT, held := [0, 0, 0, 0]::BIGINT[], k := [0, 0, 0, 0]::BIGINT[]) ORDER BY i) AS every FROM os),
fs AS (SELECT list_reduce(list_prepend(struct_pack(size := 0::BIGINT, seen := 0::BIGINT, held := [0, 0, 0, 0]::BIGINT[], k := [0, 0, 0, 0]::BIGINT[]), every),
  lambda a, x: list_transform([list_transform([0.7, 0.1, 0.1, 0.1]::DOUBLE[], lambda f, j: CASE WHEN n - a.seen = len(list_filter(a.held, lambda h: h = 0)) AND a.held[j] > 0 THEN -1e300::DOUBLE ELSE total * f - a.held[j] END)],
    lambda room: list_transform([list_position(room, list_max(room))], lambda p: struct_pack(size := x.size, seen := a.seen + 1, held := list_transform(a.held, lambda v, j: v + CASE WHEN j = p THEN x.size ELSE 0 END), k := list_transform(a.k, lambda v, j: v + CASE WHEN j = p THEN 1 ELSE 0 END)))[1])[1]) AS f FROM ls)
SELECT unnest(['train', 'valid', 'calibration', 'test']) AS split, unnest(f.held) AS rows, unnest(f.k) AS clusters FROM fs""")
def group_split(spark, sf_dir):
    members = splits.clusters(*event_keys(spark, sf_dir))
    return members.join(splits.group_split(members), "cluster").groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("cluster").alias("clusters"))


@query("""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) - 1 AS k, count(*) OVER () AS n FROM part)
SELECT p_partkey, CASE WHEN k < floor(n * 0.1) THEN 'valid' WHEN k < 2 * floor(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM p""")
def puzzle_split(spark, sf_dir):
    return splits.puzzle_split(table(spark, sf_dir, "part").select("p_partkey"), key="p_partkey")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_retailprice <= 1500 AND p_size >= 25")
def rating_filter(spark, sf_dir):
    part = readers.parquet_columns(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_size", "p_retailprice"])
    named = part.withColumnsRenamed({"p_retailprice": "Rating", "p_size": "Popularity"})
    return splits.filter_puzzles(named, 1500, 25).withColumnsRenamed({"Rating": "p_retailprice", "Popularity": "p_size"})


@query("SELECT p_partkey, ((i - 2) // 2)::INTEGER AS ply, w[i] AS move FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, unnest([2, 4]) AS i FROM part) WHERE i <= len(w)")
def solver_moves(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("Moves"))
    return splits.solver_moves(part, 2).select("p_partkey", "ply", "move")


@query("SELECT o_orderkey AS id, c_mktsegment AS segment, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey")
def enrichment(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.array(F.lit("a"), F.lit("b")).alias("candidates"), F.lit(0).alias("label"), F.lit("").alias("segment"))
    source = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.array(F.lit("a"), F.lit("b")).alias("candidates"), F.lit(0).alias("label")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("id", "candidates", "label", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return tasks.enrich(orders, source, ["segment", "nation"]).select("id", "segment", "nation")


@query("""SELECT 'conv:' || conv_id || '-' || turn AS id, to_json(coalesce(text, ''))::VARCHAR AS state, CASE WHEN role = 'user' THEN 'option-0' WHEN role = 'assistant' THEN 'option-1' END AS choice_id,
'State:' || chr(10) || to_json(coalesce(text, ''))::VARCHAR || chr(10) || chr(10) || 'Question:' || chr(10) || 'Who speaks?' AS context FROM conversations""")
def legacy_conversion(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("line"), F.coalesce("text", F.lit("")).alias("context"), F.array().cast("array<string>").alias("options"), F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).alias("label"))
    got = tasks.convert_legacy(tasks.or_fixed_options(rows, ["user", "assistant"]), "conv", "Who speaks?")
    return got.select("id", "state", "choice_id", X.render_context(F.col("state"), F.col("question")).alias("context"))


@query("""WITH t AS (SELECT conv_id || '-' || turn AS id, role FROM conversations), v AS (SELECT id, CASE WHEN role = 'system' THEN 'candidates are not a list of 2 to 255' WHEN right(id, 1) = '0' THEN 'two candidates have one id' END AS error FROM t) SELECT id, error FROM v""")
def task_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "role", X.json_string(F.coalesce("text", F.lit(""))).alias("s"))
    second = F.when(F.col("key").endswith("0"), F.lit("a")).otherwise(F.lit("b"))
    pair = F.concat(F.lit('[{"id":"a","text":"one"}'), F.when(F.col("role") == "system", F.lit("")).otherwise(F.concat(F.lit(',{"id":"'), second, F.lit('","text":"two"}'))), F.lit("]"))
    line = F.concat(F.lit('{"schema_version":1,"id":"'), F.col("key"), F.lit('","state":'), F.col("s"), F.lit(',"question":"q?","candidates":'), pair, F.lit("}"))
    return tasks.parse_tasks(rows.select("key", line.alias("value"))).select(F.col("key").alias("id"), "error")


@query(f"WITH RECURSIVE {CLUSTERS}, k AS (SELECT r, min(c) AS c FROM cc GROUP BY r) SELECT count(*) AS rows, count(DISTINCT c) AS clusters, 4::BIGINT AS splits, 0::BIGINT AS torn_clusters, true AS near_fractions FROM k")
def group_split_totals(spark, sf_dir):
    members = splits.clusters(*event_keys(spark, sf_dir))
    rows = members.join(splits.group_split(members), "cluster")
    torn = rows.groupBy("cluster").agg(F.countDistinct("split").alias("s")).agg(F.count(F.lit(1)).alias("clusters"), F.sum((F.col("s") - 1).cast("long")).alias("torn_clusters"))
    per = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    near = F.bool_and(F.abs(F.col("n") / F.col("all") - F.when(F.col("split") == "train", 0.7).otherwise(0.1)) < 0.05)
    sums = per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("all")))).agg(F.first("all").alias("rows"), F.count(F.lit(1)).alias("splits"), near.alias("near_fractions"))
    return sums.crossJoin(torn).select("rows", "clusters", "splits", "torn_clusters", "near_fractions")


@query("""WITH k AS (SELECT o_orderkey AS row, unnest(['game', 'puzzle', 'position']) AS kind, unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'https://games.example/' || o_custkey END, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END, nullif(CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_clerk END, '')]) AS value FROM (SELECT *, 'c' || (o_custkey % 9) AS o_clerk FROM orders))
SELECT row, kind, value FROM k WHERE value IS NOT NULL""")
def identity_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    url = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://games.example/"), F.col("o_custkey"), F.lit("/?ply=3#top")))
    rows = o.select(F.col("o_orderkey").alias("row"), F.lit("").alias("game_id"), url.alias("game_url"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("puzzle_id"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("c"), F.col("o_custkey") % 9)).alias("position"))
    return splits.identity_keys(rows)


@query("SELECT o_orderkey AS row, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4)::INTEGER AS batch FROM orders")
def batch_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), "o_custkey")
    return splits.batches(rows, order="row", size=4, partition="o_custkey").select("row", "batch")


@query("SELECT event_id, ts FROM events ORDER BY event_id LIMIT 100")
def first_hundred(spark, sf_dir):
    return tasks.first_rows(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")), "event_id", 100)


@query("SELECT p_partkey, array_to_string(string_split_regex(trim(p_name || '   w - ' || p_size || ' 1'), '\\s+')[1:4], ' ') AS position, CASE WHEN p_retailprice < 1000 THEN '<1000' WHEN p_retailprice < 1400 THEN '1000-1399' WHEN p_retailprice < 1800 THEN '1400-1799' ELSE '1800+' END AS bucket FROM part")
def positions(spark, sf_dir):
    fen = F.concat("p_name", F.lit("   w - "), F.col("p_size").cast("string"), F.lit(" 1"))
    return table(spark, sf_dir, "part").select("p_partkey", X.position_of(fen).alias("position"), X.rating_bucket(F.col("p_retailprice")).alias("bucket"))


#: Positions that stand for a game's: the first one, an open game, an ending.
FENS = ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "r1bqkb1r/pppp1ppp/2n2n2/4p3/2B1P3/5N2/PPPP1PPP/RNBQK2R b KQkq - 4 4", "8/5k2/8/3P4/8/1K6/8/8 w - - 0 60"]
_CELLS = "r"
for _n in range(8, 0, -1):
    _CELLS = f"replace({_CELLS}, '{_n}', '{'.' * _n}')"


@query(f"""WITH f AS (SELECT p_partkey, ['{"', '".join(FENS)}'][p_partkey % 3 + 1] AS fen FROM part)
SELECT p_partkey, 'You are playing chess as ' || CASE WHEN split_part(fen, ' ', 2) = 'w' THEN 'white' ELSE 'black' END || '. Pick the best move.' || chr(10) || chr(10) || 'Board (uppercase = white, lowercase = black):' || chr(10)
|| array_to_string(list_transform(string_split(split_part(fen, ' ', 1), '/'), lambda r, i: (9 - i)::VARCHAR || ' ' || array_to_string(string_split({_CELLS}, ''), ' ')), chr(10)) || chr(10) || '  a b c d e f g h' || chr(10) || chr(10) || 'FEN: ' || fen || chr(10) || 'Legal moves: e2e4 d2d4' || chr(10) || 'Best move:' AS prompt FROM f""")
def chess_prompts(spark, sf_dir):
    fen = F.element_at(F.array(*[F.lit(f) for f in FENS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.chess_prompt(fen, F.array(F.lit("e2e4"), F.lit("d2d4"))).alias("prompt"))


@query(f"""SELECT count(*) AS n, round(avg((o_orderpriority <> '{LEVELS[4]}')::INT), 6) AS legal_rate, round(avg((o_orderpriority = '{LEVELS[0]}')::INT), 6) AS correct_rate FROM orders""")
def generation_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("generated"), F.array(*[F.lit(x) for x in LEVELS[:4]]).alias("candidates"), F.lit(LEVELS[0]).alias("gold"))
    return rounded(metrics.generation_evaluation(rows))


@query("""WITH p AS (SELECT event_type AS name, count(*) AS runs, median(value) AS m, min(value) AS least FROM events GROUP BY 1)
SELECT name, runs, round(m, 6) AS median_seconds, round(least, 6) AS min_seconds, round(m / min(m) OVER (), 6) AS ratio FROM p""")
def latency_ratios(spark, sf_dir):
    return rounded(metrics.latency(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("seconds"))))


@query("SELECT count(*) AS n, round(max(d), 6) AS worst, max(d) <= 0.001 AS ok FROM (SELECT event_id % 5 / 1000.0::DOUBLE AS d FROM events)")
def worst_differences(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("cand_id"), (F.col("event_id") % 101 / 1000).alias("probability"))
    return rounded(tasks.worst_difference(a, a.withColumn("probability", F.col("probability") + F.col("id") % 5 / 1000), 0.001))


@query(f"WITH {LINES} SELECT id, pos::INTEGER AS pos, s AS score FROM lp")
def aligned_scores(spark, sf_dir):
    rows = line_tasks(spark, sf_dir).withColumn("ids", F.transform("scores", lambda s, i: F.concat(F.lit("c"), i.cast("string"))))
    results = rows.select("id", F.reverse(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("utility"))).alias("candidates"))
    return tasks.aligned(rows.select("id", "ids"), results).select("id", F.posexplode("scores").alias("pos", "score"))


@query("SELECT count(*) AS n, sum(len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')))::BIGINT AS tokens FROM conversations")
def within_token_limits(spark, sf_dir):
    ok = scorers.require_token_limits(reply_tasks(spark, sf_dir), context_tokens=100_000, candidate_tokens=4)
    return ok.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(scorers.words_of(F.col("context")))).cast("long").alias("tokens"))


@query(rf"SELECT conv_id || ':' || turn AS id, len({_TOKENS.format('text')})::INTEGER AS context_tokens, 3 AS candidate_tokens FROM conversations WHERE len({_TOKENS.format('text')}) > 100")
def over_token_limits(spark, sf_dir):
    return scorers.over_token_limits(reply_tasks(spark, sf_dir), context_tokens=100, candidate_tokens=3)


@query("SELECT count(*) AS n, count(*) * 4 AS compared, 0.0::DOUBLE AS worst, 0::BIGINT AS changed, true AS ok FROM conversations")
def order_invariance(spark, sf_dir):
    model = document_bigrams(spark, sf_dir)
    return rounded(scorers.invariance(reply_tasks(spark, sf_dir), lambda df: scorers.score_bigrams(df, model)))


#: What a scorer that looks at places adds to an option's score for each place.
LEANING = 1.5


@query(f"""WITH {BIGRAMS}, o AS (SELECT id, pos, option, ls + {LEANING}::DOUBLE * pos AS a, ls + {LEANING}::DOUBLE * ({len(REPLIES) - 1} - pos) AS b FROM sc JOIN op USING (pos)),
p AS (SELECT *, exp(a - max(a) OVER w) / sum(exp(a)) OVER w * exp(max(a) OVER w) AS pa, exp(b - max(b) OVER w) / sum(exp(b)) OVER w * exp(max(b) OVER w) AS pb FROM o WINDOW w AS (PARTITION BY id)),
t AS (SELECT id, count(*) AS k, max(greatest(abs(a - b), abs(pa - pb))) AS far, arg_max(option, a) <> arg_max(option, b) AS changed FROM p GROUP BY id)
SELECT count(*) AS n, sum(k)::BIGINT AS compared, round(max(far), 6) AS worst, count(*) FILTER (changed) AS changed, max(far) <= 1e-9 AND count(*) FILTER (changed) = 0 AS ok FROM t""")
def order_dependence(spark, sf_dir):
    # a scorer that leans to later options, which the check must find
    model = document_bigrams(spark, sf_dir)
    leaning = lambda df: scorers.score_bigrams(df, model).withColumn("logprob_sum", F.col("logprob_sum") + LEANING * F.col("pos"))
    return rounded(scorers.invariance(reply_tasks(spark, sf_dir), leaning))


@query(f"""WITH {BIGRAMS}, e AS (SELECT *, exp(ls / nt) AS e FROM sc) SELECT id, 4 AS n_options, round(max(e) / sum(e), 6) AS confidence FROM e WHERE right(id, 1) <> '1' GROUP BY id
UNION ALL SELECT conv_id || ':' || turn, 1, 1.0 FROM conversations WHERE right(turn::VARCHAR, 1) = '1'""")
def forced_options(spark, sf_dir):
    model = document_bigrams(spark, sf_dir)
    rows = reply_tasks(spark, sf_dir).withColumn("options", F.when(F.col("id").endswith("1"), F.slice("options", 1, 1)).otherwise(F.col("options")))
    spread = scorers.score_with_forced(rows, lambda df: scorers.distributions(scorers.score_bigrams(df, model), norm="mean"))
    return rounded(spread.select("id", F.size("options").alias("n_options"), F.array_max("probabilities").alias("confidence")))


# ---- event streams: episodes, words, JSON

@query("""SELECT event_id, lag(event_type) OVER w AS last_action, round(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total_reward FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def last_actions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("episode"), F.struct("ts", "event_id").alias("step"), F.col("event_type").alias("action"), F.col("value").alias("reward"))
    return rounded(tasks.last_action(e).select("event_id", "last_action", "total_reward"), 4)


_CX, _SZ, _DP = "(event_id % 101) / 100.0::DOUBLE", "(event_id % 61) / 100.0::DOUBLE", "(event_id % 53)::DOUBLE"


def _case(x: str, rungs: list, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} {op} {b} THEN '{w}'" for op, b, w in rungs) + f" ELSE '{rest}' END"


_W = _case(_CX, [("<=" if c else "<", b, w) for b, c, w in X.WHERE], X.WHERE_ELSE)
_R = _case(_SZ, [(">", b, w) for b, w in X.RANGE], X.RANGE_ELSE)
_D = _case(_DP, [("<", b, w) for b, w in X.DEPTH], X.DEPTH_ELSE)


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'A imp ' || {_W} || ', ' || {_R} || '. No items in view.' WHEN event_id % 3 = 1 THEN 'No monsters in view. A medkit pickup ' || replace({_W}, ', in the crosshair', '') || ', ' || {_R} || '.' ELSE 'No monsters in view. No items in view.' END
|| ' Straight ahead: ' || {_D} || '. Left: ' || {_D} || '. Right: ' || {_D} || '.' AS scene FROM events""")
def situations(spark, sf_dir):
    name = F.when(F.col("event_id") % 3 == 0, "DoomImp").when(F.col("event_id") % 3 == 1, "Medikit").otherwise("Lamp")
    thing = F.struct(name.alias("name"), X.actor_kind(name, ["DoomImp"], ["Medikit"]).alias("kind"), ((F.col("event_id") % 101) / 100.0).alias("cx"), ((F.col("event_id") % 61) / 100.0).alias("size"))
    depth = (F.col("event_id") % 53).cast("double")
    return table(spark, sf_dir, "events").select("event_id", X.situation(F.array(thing), depth, depth, depth).alias("scene"))


@query("""SELECT event_id, CASE WHEN event_id % 61 > 0 THEN CASE event_id % 4 WHEN 0 THEN 'monster' WHEN 1 THEN 'monster' WHEN 2 THEN 'item' END END AS kind, repeat('█', round((event_id % 101) / 100.0::DOUBLE * 20)::INTEGER) || ' ' || (event_id % 101) || '%' AS bar FROM events""")
def actors(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n in ("DoomImp", "SomeVzd", "Medikit", "Lamp")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.actor_kind(name, ["DoomImp"], ["Medikit"], F.col("event_id") % 61).alias("kind"), X.bar(F.col("event_id") % 101 / 100).alias("bar"))


@query("""SELECT event_id, 'You are playing Doom. Goal: survive' || chr(10) || chr(10) || 'Rules:' || chr(10) || '- shoot' || chr(10) || chr(10) || 'Examples:' || chr(10) || 'Situation: a -> b' || chr(10) || chr(10) || 'Situation: here' || chr(10)
|| 'Health ' || (event_id % 100) || ', ammo ' || (event_id % 50) || ', kills ' || (event_id % 7) || '.' || CASE WHEN event_id % 2 = 0 THEN ' Last action: ' || event_type || '.' ELSE '' END || chr(10) || '->' AS prompt FROM events""")
def game_prompts(spark, sf_dir):
    i = F.col("event_id")
    state = X.status(i % 100, i % 50, i % 7, F.when(i % 2 == 0, F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", X.game_prompt("survive", ["shoot"], [("a", "b")], F.lit("here"), state).alias("prompt"))


@query("SELECT event_id, sha256(props) AS digest, coalesce(json_valid(props), false) AS valid FROM events")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", X.sha256(F.col("props")).alias("digest"), X.canonical("props").isNotNull().alias("valid"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS game FROM pages")
def game_identities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.game_identity(F.lit(""), F.col("url")).alias("game"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS action, count(*) AS n, round(sum(value), 4) AS reward FROM events GROUP BY 1, 2")
def daily_rewards(spark, sf_dir):
    return rounded(decisions.rewards_by_window(decisions.log_of(table(spark, sf_dir, "events")), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "action", "n", "reward"), 4)
