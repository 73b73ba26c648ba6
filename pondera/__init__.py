"""Pondera: decision analytics on PySpark DataFrames.

The names below are loaded when they are used, so the package itself imports nothing.
"""

from importlib import import_module

_NAMES = {
    "Bigrams": "operators.scorers", "train_bigrams": "operators.scorers", "score_bigrams": "operators.scorers", "score_with_model": "operators.scorers", "distributions": "operators.scorers",
    "AttentionHead": "operators.scorers", "train_attention": "operators.scorers", "DecisionScorer": "operators.decision", "extract": "operators.decision", "train_artifact": "operators.decision",
    "Calibrator": "operators.calibration", "fit_temperature": "operators.calibration", "metric_rows": "operators.metrics", "summarize": "operators.metrics", "system_one": "operators.systemone",
    "parse_tasks": "operators.tasks", "Experiment": "sources.readers", "run_experiment": "plans.experiment",
}
__all__ = sorted(_NAMES)


def __getattr__(name: str) -> object:
    if name not in _NAMES:
        raise AttributeError(f"pondera has no {name}")
    return getattr(import_module(f"pondera.{_NAMES[name]}"), {"run_experiment": "run"}.get(name, name))
