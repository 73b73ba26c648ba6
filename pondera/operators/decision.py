"""Features of choice tasks by an outside model, heads trained on them, and a scorer of single requests and tables.

A model is a function ``load`` that runs once in a task (or on the driver) and returns
a function from text to the vectors of its tokens.  Its ``signature``, a dictionary
that names the model and its settings, binds features, heads and scorers together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondera.functions import text as X
from pondera.operators import metrics, scorers, tasks
from pondera.operators.calibration import Calibrator
from pondera.operators.prefix import number
from pondera.plans.scratch import Scratch
from pondera.sources import readers, sinks

Load = Callable[[], Callable[[str], np.ndarray]]
HIDDEN = 16
FEATURES = "id string, ids array<string>, texts array<string>, label int, group_id string, fingerprint string, context array<array<double>>, options array<array<double>>"


def hashed_words() -> Callable[[str], np.ndarray]:
    """A stand-in for a model: a word's vector is made from its MD5, so equal words have equal vectors."""
    def vectors(text: str) -> np.ndarray:
        raw = b"".join(hashlib.md5(w.encode()).digest() for w in text.lower().split())
        return np.frombuffer(raw, np.uint8).reshape(-1, HIDDEN) / 127.5 - 1

    return vectors


def extract(parsed: DataFrame, load: Load, *, context_tokens: int = 4096, candidate_tokens: int = 256) -> DataFrame:
    """``FEATURES`` of parsed tasks: the context's token vectors and each candidate's mean vector.

    A missing choice gives a null label.  A context or candidate with no token or over
    its limit fails the query; nothing is truncated.  Rows are handled one by one.
    """
    rows = tasks.with_label(parsed).select("id", "ids", "texts", "label", "group_id", "fingerprint", X.render_context(F.col("state"), F.col("question")).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def vectors(text: str, limit: int, row: str) -> np.ndarray:
            v = np.asarray(model(text), float)
            if v.ndim != 2 or not 0 < len(v) <= limit or not np.isfinite(v).all():
                raise ValueError(f"no features, or too many, of task {row}")
            return v

        for batch in batches:
            context = [vectors(p, context_tokens, i).tolist() for i, p in zip(batch["id"], batch["prompt"], strict=True)]
            options = [[vectors(t, candidate_tokens, i).mean(0).tolist() for t in texts] for i, texts in zip(batch["id"], batch["texts"], strict=True)]
            yield batch.drop(columns="prompt").assign(context=context, options=options)

    return rows.mapInPandas(run, FEATURES)


def _keys_digest(rows: DataFrame) -> str:
    return tasks.table_digest(rows, "id", "fingerprint", "ids", "label")


def describe_tasks(parsed: DataFrame, role: str) -> dict:
    """What a cache of these tasks must say of them: their role, and digests of their contents, keys and provenance."""
    whole = tasks.table_digest(parsed, "id", "state", "question", "candidates", "choice_id", "group_id")
    keys = tasks.table_digest(tasks.provenance({role: parsed}), "kind", "key")
    return {"role": role, "source_sha256": whole, "provenance_sha256": keys, "tasks_sha256": _keys_digest(tasks.with_label(parsed))}


def write_cache(parsed: DataFrame, path: str, role: str, load: Load, signature: dict, **limits: int) -> None:
    """Extract the tasks' features to a table that names its tasks, model and limits."""
    sinks.write_features(extract(parsed, load, **limits), path, describe_tasks(parsed, role) | {"signature": signature | limits, "signature_sha256": X.digest(signature | limits)} | signature)


def check_cache(features: DataFrame, parsed: DataFrame, meta: dict | None = None, role: str = "") -> None:
    """Raise unless cached features have exactly the tasks' ids, inputs, candidates and labels, in any order.

    With a cache's metadata its role, contents and provenance must be these tasks' too.
    """
    if meta is None:
        want, got = {"tasks_sha256": _keys_digest(tasks.with_label(parsed))}, {}
    else:
        want, got = describe_tasks(parsed, role), meta
    found = {"rows": _keys_digest(features)}
    wrong = [k for k, v in want.items() if k in got and got[k] != v or meta is not None and k not in got] + ["rows"] * (found["rows"] != want["tasks_sha256"])
    if wrong:
        raise ValueError(f"cached features differ from their tasks: {', '.join(wrong)}")


def prepare(settings: readers.Experiment, spark: SparkSession, load: Load | None = None, signature: dict | None = None) -> dict[str, DataFrame]:
    """The checked features of an experiment's splits, from its caches or else extracted beside its output."""
    parsed = {s: readers.tasks(spark, settings.datasets[s], labelled=True) for s in readers.SPLITS}
    tasks.require_disjoint(tasks.provenance(parsed))
    found, signed = {}, set()
    for split, rows in parsed.items():
        path = settings.caches.get(split) or f"{settings.out}-features/{split}"
        if not settings.caches:
            if load is None:
                raise ValueError("a model is needed to extract features")
            write_cache(rows, path, split, load, signature or {}, context_tokens=settings.context_tokens, candidate_tokens=settings.candidate_tokens)
        found[split], meta = readers.features(spark, path)
        check_cache(found[split], rows, meta, split)
        signed.add(meta.get("signature_sha256"))
    if len(signed) != 1:
        raise ValueError("the splits' features are of different models or limits")
    return found


def train_artifact(train: DataFrame, validation: DataFrame, folder: str, signature: dict, **settings: object) -> dict:
    """Train a head on features and write it as an artifact; the roles must not overlap.  The manifest is returned.

    The tasks' keys are a table in the artifact, whose digest the manifest has, so that
    tasks to be evaluated later can be checked against them.
    """
    keys = tasks.provenance({"train": train, "validation": validation})
    tasks.require_disjoint(keys)
    head, history = scorers.train_attention(train, validation, **settings)
    out = sinks.write_artifact(folder, head, {"history": history, "settings": settings, "hidden": int(head.query.shape[0])}, signature, training={"keys_sha256": tasks.table_digest(keys, "split", "kind", "key")})
    keys.write.mode("errorifexists").parquet(f"{folder}/keys")
    return out


def evaluate(features: DataFrame, head: scorers.AttentionHead) -> DataFrame:
    """``summarize`` of the head's choices by ``run``: "given", and "shuffled", where each task has the context of the next of its batch.

    A head that uses the context is much worse in the second run.  Features are numbered by
    id without a task that sees them all.
    """
    rows = features.where("label is not null").select("id", "context", "options", "label", "ids")
    rows = rows.join(number(rows.select("id"), "id"), "id")
    both = rows.withColumn("run", F.lit("given")).unionByName(tasks.shuffled_contexts(rows, ordinal="ordinal", context="context").withColumn("run", F.lit("shuffled")))
    return metrics.summarize(metrics.metric_rows(scorers.score_attention(both, head)), "run")


class DecisionScorer:
    """A written head with its model, for requests one by one (on the driver) and for tables.

    The model's signature must be the artifact's; a calibrator must belong to it.
    """

    def __init__(self, artifact: str | Path, load: Load, signature: dict, calibrator: str | None = None):
        self.manifest = readers.read_artifact(artifact)
        if self.manifest["feature_signature"] != signature:
            raise ValueError("the model differs from the artifact's")
        self.folder, self.calibrator_path = Path(artifact), calibrator
        self.artifact_id = readers.file_digest(Path(artifact) / "manifest.json")
        self.calibrator = Calibrator.load(calibrator, self.artifact_id) if calibrator else None
        self.head, self.load = scorers.AttentionHead.load(str(Path(artifact) / "head.npz")), load
        self._model: Callable[[str], np.ndarray] | None = None

    def require_unseen(self, parsed: DataFrame) -> None:
        """Raise if the head or the calibrator was fitted on any of these tasks' ids, inputs or groups."""
        keys = tasks.provenance({"asked": parsed})
        if known := self.manifest.get("training", {}).get("keys_sha256"):
            own = parsed.sparkSession.read.parquet(str(self.folder / "keys"))
            if tasks.table_digest(own, "split", "kind", "key") != known:
                raise ValueError("the artifact's table of keys was changed")
            tasks.require_unseen(keys, own, "the head's training")
        if self.calibrator:
            self.calibrator.require_unseen(keys, self.calibrator_path)

    def fit_calibrator(self, parsed: DataFrame, path: str, *, kind: str = "nll", bounds: tuple[float, float] = (0.05, 20.0), **limits: int) -> Calibrator:
        """Fit a temperature on tasks that the head hasn't seen, and write it with their keys."""
        self.require_unseen(parsed)
        keys = tasks.provenance({"calibration": parsed})
        scored = Scratch(parsed.sparkSession, "calibration").keep(self.score_table(parsed, **limits).select("id", "scores", "label", "artifact_id"), "scored")
        out = Calibrator.fit(scored, self.artifact_id, kind=kind, bounds=bounds, provenance={"keys_sha256": tasks.table_digest(keys, "kind", "key")})
        out.save(path, keys)
        return out

    def score_table(self, parsed: DataFrame, **limits: int) -> DataFrame:
        """Predictions of parsed tasks: ``id, ids, label, scores, probabilities, choice, confidence, artifact_id``, calibrated where there is a calibrator."""
        scored = scorers.score_attention(extract(parsed, self.load, **limits), self.head).withColumn("artifact_id", F.lit(self.artifact_id))
        out = metrics.decide(metrics.require_valid(scored)).drop("context", "options", "texts")
        return self.calibrator.apply(out.drop("probabilities")) if self.calibrator else out

    def predict(self, *, state: str | dict | list, question: str, candidates: Mapping[str, str], request_id: str = "request") -> dict:
        """Choose among candidate ids and texts; one small computation on the driver, checked like a task of a file."""
        if not isinstance(candidates, Mapping):
            raise ValueError("candidates: a mapping from id to text is needed")
        listed = [{"id": k, "text": v} for k, v in candidates.items()]
        request = {"schema_version": 1, "id": request_id, "state": state, "question": question, "candidates": listed}
        return self.score(request)

    def score(self, request: dict) -> dict:
        """The same for a task given as a dictionary."""
        error, *found = tasks.check_task(request)
        if error:
            raise ValueError(error)
        self._model = self._model or self.load()
        _, state, question, options = found[:4]
        context = np.asarray(self._model(f"State:\n{state}\n\nQuestion:\n{question}"), float)
        vectors = np.stack([np.asarray(self._model(o["text"]), float).mean(0) for o in options])
        logits = self.head.forward(context, vectors)[0]
        if not np.isfinite(logits).all():
            raise ValueError("scores must be finite")

        def spread(temperature: float) -> list[float]:
            p = np.exp((logits - logits.max()) / temperature)
            return (p / p.sum()).tolist()

        raw, calibrated = spread(1.0), spread(self.calibrator.temperature) if self.calibrator else None
        best = min(range(len(options)), key=lambda i: (-logits[i], options[i]["id"]))
        out = {"id": request["id"], "choice_id": options[best]["id"], "candidates": [{"id": o["id"], "utility": float(u), "probability": p} for o, u, p in zip(options, logits, calibrated or raw, strict=True)], "artifact_id": self.artifact_id}
        if self.calibrator:
            out |= {"raw_probabilities": raw, "temperature": self.calibrator.temperature, "calibrator_id": self.calibrator.id}
        return out
