"""Scorers: they give every candidate of a task a log-probability.

The contract: tasks ``id, context string, options array<string>`` in, rows ``id, pos,
option, n_tokens, logprob_sum, logprob_uncond`` out.  The built-in scorer is a
smoothed bigram model in joins; vectors and an attention head score features; any
other model plugs in through Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondera.functions import scores as S
from pondera.operators import ngrams
from pondera.operators.ngrams import BOS, UNITS, Store, words_of
from pondera.plans.scratch import Scratch, spread

SCORED = "id string, pos int, option string, n_tokens int, logprob_sum double, logprob_uncond double"


@dataclass(frozen=True)
class Bigrams:
    """Counts ``a, b, n`` of neighbours and ``a, n`` of predecessors, and the vocabulary's size.

    ``store`` has them as flat arrays if they are few enough to be sent to tasks.
    """

    pairs: DataFrame
    singles: DataFrame
    vocabulary: int
    unit: str = "word"
    k: float = 0.5
    store: Store | None = None
    scratch: Scratch | None = None

    def log_probability(self, n_pair: Column, n_single: Column) -> Column:
        return F.ln((F.coalesce(n_pair, F.lit(0)) + F.lit(self.k)) / (F.coalesce(n_single, F.lit(0)) + F.lit(self.k * self.vocabulary)))

    def close(self) -> None:
        """Delete the counts' table; scoring with the store goes on."""
        if self.scratch:
            self.scratch.drop("counts")


def train_bigrams(texts: DataFrame, *, column: str = "text", unit: str = "word", k: float = 0.5) -> Bigrams:
    """Count neighbours over all texts, each started by a sentinel.

    Partial sums come before the shuffle.  The counts are written once, so that
    scoring doesn't count again.
    """
    t = UNITS[unit](F.col(column))
    n = F.greatest(F.size("t") - 1, F.lit(0))
    joined = F.arrays_zip(F.slice("t", 1, n).alias("a"), F.slice("t", 2, n).alias("b"))
    pairs = spread(texts.select(column)).select(F.concat(F.array(F.lit(BOS)), t).alias("t")).select(F.explode(joined).alias("p")).select("p.a", "p.b")
    scratch = Scratch(texts.sparkSession, "bigrams")
    counts = scratch.keep(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "counts")
    singles = counts.groupBy("a").agg(F.sum("n").alias("n"))
    vocabulary = counts.agg(F.countDistinct("b")).first()[0] or 0
    return Bigrams(counts, singles, vocabulary, unit, k, ngrams.collect(counts, singles, vocabulary, unit, k), scratch)


def over_token_limits(tasks: DataFrame, *, context_tokens: int = 4096, candidate_tokens: int = 256, unit: str = "word") -> DataFrame:
    """``id, context_tokens, candidate_tokens`` (of the longest option) of tasks with a context or option over its limit."""
    tokens = UNITS[unit]
    longest = F.array_max(F.transform("options", lambda o: F.size(tokens(o))))
    sizes = tasks.select("id", F.size(tokens(F.col("context"))).alias("context_tokens"), longest.alias("candidate_tokens"))
    return sizes.where((F.col("context_tokens") > context_tokens) | (F.col("candidate_tokens") > candidate_tokens))


def require_token_limits(tasks: DataFrame, *, context_tokens: int = 4096, candidate_tokens: int = 256, unit: str = "word") -> DataFrame:
    """Fail the query at a context or option over its limit; nothing is truncated."""
    tokens = UNITS[unit]
    over = (F.size(tokens(F.col("context"))) > context_tokens) | F.exists("options", lambda o: F.size(tokens(o)) > candidate_tokens)
    return tasks.where(F.when(F.coalesce(over, F.lit(False)), F.raise_error(F.concat(F.lit("too many tokens: "), F.col("id").cast("string")))).otherwise(F.lit(True)))


#: Copies of a task in a check of a scorer, in the order in which they stand side by side.
COPIES = ("original", "control", "repeated", "reversed", "renamed")


def invariance(tasks: DataFrame, score: Callable[[DataFrame], DataFrame], *, tolerance: float = 1e-9, norm: str = "sum") -> DataFrame:
    """``n, compared, worst, changed, ok`` of a scorer that must not depend on order, names or what it scored before.

    Each task is scored with an unrelated one after it, again, with its options reversed,
    and under another id: one table of tagged copies, those of a task side by side in
    one partition, scored once.  ``worst`` is the largest distance of an option's scores or
    probabilities among a task's copies (infinite if one lacks it), ``changed`` the tasks whose best option differs
    (of equals the smallest text).  ``ok``: none changed, and the distance is within ``tolerance``.
    """
    kinds = F.explode(F.array(*[F.lit(k) for k in COPIES]))
    copies = tasks.select(F.col("id").alias("_task"), "context", "options", kinds.alias("_copy"))
    copies = copies.select(
        F.concat(F.when(F.col("_copy") == "renamed", "other name of ").otherwise(F.col("_copy")), F.lit(":"), F.col("_task").cast("string")).alias("id"),
        F.when(F.col("_copy") == "control", F.concat(F.lit("something else: "), F.col("_task").cast("string"))).otherwise(F.col("context")).alias("context"),
        F.when(F.col("_copy") == "reversed", F.reverse("options")).otherwise(F.col("options")).alias("options"), "_task", F.array_position(F.array(*[F.lit(k) for k in COPIES]), F.col("_copy")).alias("_step"),
    )
    placed = copies.repartition(F.col("_task")).sortWithinPartitions("_task", "_step")
    found = distributions(score(placed.drop("_task", "_step")), norm=norm).where(~F.col("id").startswith("control:")).withColumn("_task", F.regexp_replace("id", "^[^:]*:", ""))
    options = F.array_sort(F.arrays_zip(F.col("options").alias("text"), F.col("scores").alias("s"), F.col("probabilities").alias("p")))
    top = F.array_min(F.transform(F.filter(options, lambda o: o["p"] == F.array_max("probabilities")), lambda o: o["text"]))
    flat = found.select("_task", top.alias("top"), F.posexplode(options).alias("place", "o")).select("_task", "top", "o.*", "place")
    # equal texts of a task stand in the order of their scores
    each = flat.groupBy("_task", "text", F.col("place")).agg(F.count(F.lit(1)).alias("copies"), F.greatest(F.max("s") - F.min("s"), F.max("p") - F.min("p")).alias("far"), F.min("top").alias("low"), F.max("top").alias("high"))
    far = F.when(F.col("copies") == len(COPIES) - 1, F.col("far")).otherwise(F.lit(float("inf")))
    per = each.groupBy("_task").agg(F.count(F.lit(1)).alias("compared"), F.max(far).alias("far"), (F.min("low") != F.max("high")).alias("changed"))
    out = per.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"), F.max("far").alias("worst"), F.count(F.when(F.col("changed"), 1)).alias("changed"))
    return out.withColumn("ok", F.coalesce(F.col("worst") <= tolerance, F.lit(True)) & (F.col("changed") == 0))


def _with_log_probability(steps: DataFrame, model: Bigrams) -> DataFrame:
    """Add ``lp`` to rows with a token ``b`` and the one before it, ``a``."""
    joined = steps.join(model.pairs.withColumnRenamed("n", "np"), ["a", "b"], "left").join(model.singles.withColumnRenamed("n", "ns"), "a", "left")
    return joined.withColumn("lp", model.log_probability(F.col("np"), F.col("ns"))).drop("np", "ns")


def score_bigrams(tasks: DataFrame, model: Bigrams) -> DataFrame:
    """Score options with all that they share: a bigram sees only the context's last token, and only at an option's first.

    With a model that has a store this is row by row.  Else tokens after the first are scored once for each distinct option, and first tokens
    once for each distinct pair with a context's last.  ``logprob_uncond`` has the
    sentinel in the context's place.
    """
    if model.store:
        scored = ngrams.row_scores(spread(tasks.select("id", "context", "options")), model.store)
        flat = scored.select("id", "options", F.posexplode("scored").alias("pos", "s"))
        return flat.select("id", "pos", F.get("options", F.col("pos")).alias("option"), "s.*")
    tokens, scratch = UNITS[model.unit], Scratch(tasks.sparkSession, "scored")
    last = F.coalesce(F.try_element_at(tokens(F.col("context")), F.lit(-1)), F.lit(BOS))
    flat = scratch.keep(tasks.select("id", last.alias("a"), F.posexplode("options").alias("pos", "option")), "flat")
    t = tokens(F.col("option"))
    distinct = flat.select("option").distinct().withColumn("t", F.when(F.size(t) > 0, t).otherwise(F.raise_error(F.lit("an option has no token"))))
    steps = distinct.select("option", F.posexplode(F.arrays_zip(F.slice(F.concat(F.array(F.lit(BOS)), F.col("t")), 1, F.size("t")).alias("a"), F.col("t").alias("b"))).alias("i", "s")).select("option", "i", "s.a", "s.b")
    rest = F.coalesce(F.sum(F.when(F.col("i") > 0, F.col("lp"))), F.lit(0.0))
    options = _with_log_probability(steps, model).groupBy("option").agg(F.count(F.lit(1)).cast("int").alias("n_tokens"), F.max(F.when(F.col("i") == 0, F.col("b"))).alias("b"), F.sum("lp").alias("logprob_uncond"), rest.alias("rest"))
    options = scratch.keep(options, "options")
    rows = flat.join(options, "option")
    firsts = _with_log_probability(rows.select("a", "b").distinct(), model)
    return rows.join(firsts, ["a", "b"]).select("id", "pos", "option", "n_tokens", (F.col("lp") + F.col("rest")).alias("logprob_sum"), "logprob_uncond")


def score_naive(tasks: DataFrame, model: Bigrams) -> DataFrame:
    """The same by scoring context and option as one sequence and taking the context's part off: ``id, pos, logprob_sum``.

    It shares nothing between options and is there to check ``score_bigrams``.
    """
    tokens = UNITS[model.unit]
    flat = tasks.select("id", F.posexplode("options").alias("pos", "option"), tokens(F.col("context")).alias("c"))
    def sums(t: Column, name: str) -> DataFrame:
        s = flat.select("id", "pos", F.concat(F.array(F.lit(BOS)), t).alias("t")).select("id", "pos", F.explode_outer(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("a"), F.slice("t", 2, F.size("t")).alias("b"))).alias("p")).select("id", "pos", "p.*")
        j = s.join(model.pairs.withColumnRenamed("n", "np"), ["a", "b"], "left").join(model.singles.withColumnRenamed("n", "ns"), "a", "left")
        return j.groupBy("id", "pos").agg(F.coalesce(F.sum(F.when(F.col("b").isNotNull(), model.log_probability(F.col("np"), F.col("ns")))), F.lit(0.0)).alias(name))
    whole = sums(F.concat(F.col("c"), tokens(F.col("option"))), "whole")
    return whole.join(sums(F.col("c"), "prefix"), ["id", "pos"]).select("id", "pos", (F.col("whole") - F.col("prefix")).alias("logprob_sum"))


def distributions(scored: DataFrame, *, norm: str = "mean") -> DataFrame:
    """``id, options, scores, probabilities, n_tokens`` by norm, candidates in their own order; ``n_tokens`` is of all options."""
    s = scored.withColumn("score", S.normalised(norm, F.col("logprob_sum"), F.col("n_tokens"), F.col("logprob_uncond")))
    rows = s.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "option", "score"))).alias("c"), F.sum("n_tokens").cast("long").alias("n_tokens"))
    out = rows.select("id", "n_tokens", F.transform("c", lambda c: c["option"]).alias("options"), F.transform("c", lambda c: c["score"]).alias("scores"))
    few = F.when(F.size("scores") < 2, F.raise_error(F.lit("need at least two options"))).otherwise(F.lit(True))
    return out.where(few).withColumn("probabilities", S.softmax(F.col("scores")))


def row_distributions(rows: DataFrame, model: Bigrams, *, context: str = "context", options: str = "options", norm: str = "mean") -> DataFrame:
    """All columns of ``rows`` with ``scores``, ``probabilities`` and ``n_tokens`` (of all options), computed where the row is.

    For a model with a store; equal to ``distributions`` of ``score_bigrams`` without ids.
    """
    few = F.when(F.size(options) < 2, F.raise_error(F.lit("need at least two options"))).otherwise(F.lit(True))
    scored = ngrams.row_scores(rows.where(few), model.store, context=context, options=options)
    scores = F.transform("scored", lambda s: S.normalised(norm, s["logprob_sum"], s["n_tokens"], s["logprob_uncond"]))
    total = F.aggregate("scored", F.lit(0).cast("long"), lambda a, s: a + s["n_tokens"])
    return scored.withColumns({"scores": scores, "n_tokens": total}).drop("scored").withColumn("probabilities", S.softmax(F.col("scores")))


def score_with_forced(tasks: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score tasks of several options; a single option gets score 0 without the model."""
    many = score(tasks.where(F.size("options") > 1))
    forced = tasks.where(F.size("options") == 1).select("id", "options", F.array(F.lit(0.0)).alias("scores"), F.array(F.lit(1.0)).alias("probabilities"), F.lit(0).cast("long").alias("n_tokens"))
    return many.unionByName(forced)


def score_with_model(tasks: DataFrame, load: Callable[[], Callable[[str, list[str]], list[tuple[int, float, float]]]]) -> DataFrame:
    """Adapter for an outside model: ``load`` runs once in a task and returns a function from context and options to ``(n_tokens, sum, unconditional)`` of each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = [(r.id, i, o, *got) for r in batch.itertuples() for i, (o, got) in enumerate(zip(r.options, model(r.context, list(r.options)), strict=True))]
            yield pd.DataFrame(rows, columns=["id", "pos", "option", "n_tokens", "logprob_sum", "logprob_uncond"])

    return tasks.select("id", "context", "options").mapInPandas(run, SCORED)


def centroids(vectors: DataFrame, *, vector: str = "embedding", label: str = "label") -> DataFrame:
    """``label, centroid``: the mean vector of each label; one sum per label and dimension is shuffled."""
    flat = vectors.select(label, F.posexplode(vector).alias("i", "x"))
    means = flat.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))


def score_vectors(vectors: DataFrame, centres: DataFrame, *, vector: str = "embedding", scale: float = 10.0, max_centres: int = 4096) -> DataFrame:
    """Add ``ids`` (labels in order), ``scores`` (scaled dot products) to each vector.

    The centres become one row of arrays that is broadcast; more than ``max_centres``
    are refused, as that row must stay small.
    """
    one = centres.select(F.col(centres.columns[0]).alias("l"), F.col("centroid").alias("c")).agg(F.array_sort(F.collect_list(F.struct("l", "c"))).alias("_c"))
    one = one.where(F.when(F.size("_c") > max_centres, F.raise_error(F.lit("too many centres"))).otherwise(F.lit(True)))
    joined = vectors.crossJoin(F.broadcast(one))
    return joined.withColumns({"ids": F.transform("_c", lambda e: e["l"]), "scores": F.transform("_c", lambda e: F.lit(scale) * S.dot(F.col(vector), e["c"]))}).drop("_c")


def pooled(tokens: DataFrame, *, keys: list[str], vector: str = "state", keep: str = "is_real") -> DataFrame:
    """Mean vector of each key's real tokens (not padding or the sentinel): ``keys, pooled``."""
    flat = tokens.where(F.col(keep)).select(*keys, F.posexplode(vector).alias("i", "x"))
    means = flat.groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("pooled"))


def mean_norm(vectors: DataFrame, *, vector: str) -> DataFrame:
    return vectors.agg(F.round(F.avg(S.norm2(F.col(vector))), 2).alias("mean_norm"))


def token_usage(scored: DataFrame, tasks: DataFrame, model: Bigrams) -> DataFrame:
    """``input_tokens, output_tokens``: context tokens of all tasks and tokens of all their options."""
    out = scored.agg(F.sum("n_tokens").cast("long").alias("output_tokens"))
    return tasks.agg(F.sum(F.size(UNITS[model.unit](F.col("context")))).cast("long").alias("input_tokens")).crossJoin(out)


@dataclass
class AttentionHead:
    """Cross-attention from options to context tokens; weights are ``hidden x rank`` matrices and two layer norms."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    context_norm: tuple[np.ndarray, np.ndarray]
    option_norm: tuple[np.ndarray, np.ndarray]

    NAMES = ("query", "key", "value", "cg", "cb", "og", "ob")

    @classmethod
    def random(cls, hidden: int, rank: int, seed: int = 7) -> AttentionHead:
        rng = np.random.default_rng(seed)
        m = lambda: rng.uniform(-1, 1, (hidden, rank)) / hidden**0.5
        one = lambda: (np.ones(hidden), np.zeros(hidden))
        return cls(m(), m(), m(), one(), one())

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.query, self.key, self.value, *self.context_norm, *self.option_norm]

    @classmethod
    def of(cls, w: list[np.ndarray]) -> AttentionHead:
        return cls(*w[:3], (w[3], w[4]), (w[5], w[6]))

    def save(self, path: str) -> None:
        np.savez(path, **dict(zip(self.NAMES, self.weights, strict=True)))

    @classmethod
    def load(cls, path: str) -> AttentionHead:
        with np.load(path) as f:
            return cls.of([f[n] for n in cls.NAMES])

    def forward(self, context: np.ndarray, options: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of one task's options; ragged tasks need no padding."""
        def norm(x, g, b):
            c = x - x.mean(-1, keepdims=True)
            s = 1 / np.sqrt((c * c).mean(-1, keepdims=True) + 1e-5)
            return c * s * g + b, c * s, s

        cn, ch, cs = norm(context.astype(float), *self.context_norm)
        on, oh, os_ = norm(options.astype(float), *self.option_norm)
        root = self.query.shape[1] ** 0.5
        q, k, v = on @ self.query, cn @ self.key, cn @ self.value
        a = q @ k.T / root
        a = np.exp(a - a.max(-1, keepdims=True))
        a /= a.sum(-1, keepdims=True)
        mixed = a @ v
        return (q * mixed).sum(-1) / root, {"cn": cn, "ch": ch, "cs": cs, "on": on, "oh": oh, "os": os_, "q": q, "k": k, "v": v, "a": a, "mixed": mixed, "root": root}

    def backward(self, t: dict, g: np.ndarray) -> list[np.ndarray]:
        """Gradients of all weights for the logits' gradient."""
        root = t["root"]
        dq, dm = g[:, None] * t["mixed"] / root, g[:, None] * t["q"] / root
        da, dv = dm @ t["v"].T, t["a"].T @ dm
        ds = t["a"] * (da - (da * t["a"]).sum(-1, keepdims=True))
        dq, dk = dq + ds @ t["k"] / root, ds.T @ t["q"] / root
        dcn, don = dk @ self.key.T + dv @ self.value.T, dq @ self.query.T
        return [t["on"].T @ dq, t["cn"].T @ dk, t["cn"].T @ dv, (dcn * t["ch"]).sum(0), dcn.sum(0), (don * t["oh"]).sum(0), don.sum(0)]


def choice_loss(logits: np.ndarray, label: int, brier_weight: float = 0.0) -> tuple[float, np.ndarray]:
    """Cross entropy plus weighted Brier score of one task, and the gradient by logits."""
    p = np.exp(logits - logits.max())
    z = p.sum()
    p /= z
    y = np.arange(len(p)) == label
    d = 2 * (p - y)
    loss = np.log(z) + logits.max() - logits[label] + brier_weight * ((p - y) ** 2).sum()
    return float(loss), p - y + brier_weight * p * (d - (d * p).sum())


def score_attention(tasks: DataFrame, head: AttentionHead) -> DataFrame:
    """Add ``scores`` to rows with ``context`` and ``options``, arrays of vectors."""
    shared = tasks.sparkSession.sparkContext.broadcast(head)

    @F.pandas_udf("array<double>")
    def logits(context: pd.Series, options: pd.Series) -> pd.Series:
        h = shared.value
        return pd.Series([h.forward(np.stack(c), np.stack(o))[0] for c, o in zip(context, options, strict=True)])

    return tasks.withColumn("scores", logits("context", "options"))


_PACKED = "key bigint, label int, tokens int, candidates int, context binary, options binary"


def _packed(rows: DataFrame) -> DataFrame:
    """Labelled features as bytes, so that a step needs no conversion of nested lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = {c: [np.array(v, float) for v in b.column(c).to_pylist()] for c in ("context", "options")}
            columns = [b.column("key"), b.column("label"), *(pa.array([len(v) for v in made[c]], pa.int32()) for c in made), *(pa.array([v.tobytes() for v in made[c]], pa.binary()) for c in made)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PACKED.split(", ")])

    rows = rows.where("label is not null").select(F.xxhash64(F.col("id").cast("string")).alias("key"), F.col("label").cast("int").alias("label"), "context", "options")
    return spread(rows).mapInArrow(run, _PACKED)


_GRADIENT = "n bigint, loss double, gradient binary"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the sum of a partition's partial gradients."""
    n, loss, total = 0, 0.0, None
    for b in batches:
        for k, x, g in zip(*(b.column(c).to_pylist() for c in ("n", "loss", "gradient")), strict=True):
            n, loss, total = n + k, loss + x, np.frombuffer(g) if total is None else total + np.frombuffer(g)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["n", "loss", "gradient"])


def gradient(packed: DataFrame, head: AttentionHead, brier_weight: float = 0.0, *, parts: int = 1, fan: int = 16) -> tuple[int, float, list[np.ndarray]]:
    """``rows, summed loss, summed gradients`` of packed features.

    Every partition sums its rows; beyond ``fan`` partitions their sums are added up
    in groups by other tasks, so the driver gets at most ``fan`` rows of the weights' size.
    """
    sc = packed.sparkSession.sparkContext
    shared = sc.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, loss = shared.value, 0, 0.0
        total = [np.zeros_like(w) for w in h.weights]
        width = h.query.shape[0]
        for b in batches:
            for label, context, options in zip(b.column("label").to_pylist(), b.column("context"), b.column("options"), strict=True):
                logits, tape = h.forward(np.frombuffer(context.as_buffer()).reshape(-1, width), np.frombuffer(options.as_buffer()).reshape(-1, width))
                x, g = choice_loss(logits, label, brier_weight)
                n, loss = n + 1, loss + x
                total = [a + d for a, d in zip(total, h.backward(tape, g), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([np.concatenate([t.ravel() for t in total]).tobytes()], pa.binary())], ["n", "loss", "gradient"])

    partial = packed.mapInArrow(run, _GRADIENT)
    while parts > fan:
        parts = -(-parts // fan)
        partial = partial.repartition(parts).mapInArrow(_sums, _GRADIENT)
    found = partial.collect()
    shared.destroy()
    if not found:
        return 0, 0.0, [np.zeros_like(w) for w in head.weights]
    flat, out, at = np.sum([np.frombuffer(r["gradient"]) for r in found], 0), [], 0
    for w in head.weights:
        out.append(flat[at : at + w.size].reshape(w.shape))
        at += w.size
    return sum(r["n"] for r in found), float(sum(r["loss"] for r in found)), out


def train_attention(train: DataFrame, validation: DataFrame, *, rank: int = 16, epochs: int = 8, batch_size: int = 64, lr: float = 5e-4, weight_decay: float = 1e-4, seed: int = 7, brier_weight: float = 0.0, selection: str = "top1") -> tuple[AttentionHead, list[dict]]:
    """AdamW with clipped gradients over all labelled rows, data-parallel: features stay in the cluster, weights on the driver.

    An epoch deals the rows to batches of about ``batch_size`` by a hash of seed, epoch and
    id; a step is one job over a batch's rows, so on many rows large batches pay.
    The best epoch by the validation metric (top1, nll or brier; the first of
    equals) over all labelled validation rows is returned with the history.
    """
    if brier_weight < 0 or not np.isfinite(brier_weight) or selection not in ("top1", "nll", "brier"):
        raise ValueError("invalid Brier weight or selection metric")
    va, packed = validation.where("label is not null"), _packed(train).persist()
    try:
        n, first = packed.agg(F.count(F.lit(1)), F.first(F.struct(F.octet_length("context").alias("size"), "tokens"))).first()
        if not n or va.isEmpty():
            raise ValueError("no labelled rows")
        parts, batches = packed.rdd.getNumPartitions(), max(1, round(n / batch_size))
        head = AttentionHead.random(first["size"] // 8 // first["tokens"], rank, seed)
        m, v, step, best, history = [np.zeros_like(w) for w in head.weights], [np.zeros_like(w) for w in head.weights], 0, (-np.inf, head), []
        for epoch in range(1, epochs + 1):
            dealt, total = packed.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "key"), F.lit(batches))), 0.0
            for k in range(batches):
                size, loss, grads = gradient(dealt.where(F.col("batch") == k), head, brier_weight, parts=parts)
                if not size:
                    continue
                total += loss
                grads = [g / size for g in grads]
                norm = np.sqrt(sum((g * g).sum() for g in grads))
                grads = [g * min(1.0, 1 / (norm + 1e-6)) for g in grads]
                step += 1
                m = [0.9 * a + 0.1 * g for a, g in zip(m, grads, strict=True)]
                v = [0.999 * a + 0.001 * g * g for a, g in zip(v, grads, strict=True)]
                head = AttentionHead.of([w * (1 - lr * weight_decay) - lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8) for w, a, b in zip(head.weights, m, v, strict=True)])
            found = score_attention(va, head)
            hit = (S.first_best(F.col("scores")) == F.col("label")).cast("double")
            top1, nll, brier = found.agg(F.avg(hit), F.avg(S.nll(F.col("scores"), F.col("label"))), F.avg(S.brier(S.softmax(F.col("scores")), F.col("label")))).first()
            history.append({"epoch": epoch, "train_loss": total / n, "val_top1": top1, "val_nll": nll, "val_brier": brier})
            metric = top1 if selection == "top1" else -(nll if selection == "nll" else brier)
            if metric > best[0]:
                best = (metric, head)
    finally:
        packed.unpersist()
    return best[1], history
