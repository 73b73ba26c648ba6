"""Sinks: exclusive and appending writes, feature tables, artifacts and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondera.functions.text import digest
from pondera.operators.scorers import AttentionHead
from pondera.sources.readers import ARTIFACT, file_digest


def write_lines(rows: DataFrame, path: str, number_columns: tuple[str, ...] = ()) -> None:
    """JSON lines to a new folder; a NaN or infinite number in the given columns fails the write."""
    for c in number_columns:
        rows = rows.where(F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{c} is not finite"))).otherwise(F.lit(True)))
    rows.write.mode("errorifexists").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Decision records, added to a log folder."""
    rows.write.mode("append").json(path)


def write_document(value: object, path: str | Path, *, overwrite: bool = False) -> None:
    """A JSON document; a new file unless ``overwrite``."""
    with open(path, "w" if overwrite else "x") as f:
        f.write(json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False) + "\n")


def write_features(rows: DataFrame, path: str, meta: dict) -> None:
    """``id, context, options, label`` and metadata, the latter last, so that a failed write can't be read.

    The number of tokens' dimensions is that of the rows, where the metadata doesn't say it.
    """
    rows.write.mode("errorifexists").parquet(f"{path}/features")
    n, hidden = rows.sparkSession.read.parquet(f"{path}/features").agg(F.count(F.lit(1)), F.max(F.size(F.get("context", F.lit(0))))).first()
    text = json.dumps({"hidden": hidden} | meta | {"rows": n}, allow_nan=False)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/meta.json")


def write_artifact(folder: str | Path, head: AttentionHead, config: dict, signature: dict, **more: object) -> dict:
    """Weights and settings, then the manifest with their digests and what else it is to say."""
    root = Path(folder)
    root.mkdir(parents=True)
    head.save(str(root / "head.npz"))
    write_document(config | {"signature_sha256": digest(signature)}, root / "head.json")
    manifest = ARTIFACT | {"feature_signature": signature, "signature_sha256": digest(signature), "files": {n: file_digest(root / n) for n in ("head.npz", "head.json")}} | more
    write_document(manifest, root / "manifest.json")
    return manifest


def write_splits(rows: DataFrame, folder: str, derived: tuple[str, ...] = ("id", "fen", "position", "candidates", "label")) -> None:
    """One new folder of JSON lines per split; derived columns are dropped, as reading makes them anew."""
    rows.drop(*derived).write.mode("errorifexists").partitionBy("split").json(folder)


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; more than ``limit`` rows are refused."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"a report table has at most {limit} rows")
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = [rows.columns, ["---"] * len(rows.columns), *[[show(v) for v in r] for r in got]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def write_report(path: str | Path, title: str, sections: dict[str, DataFrame | str]) -> None:
    """A new Markdown file of titled tables and texts."""
    parts = [f"# {title}"] + [f"## {name}\n\n{body if isinstance(body, str) else markdown_table(body)}" for name, body in sections.items()]
    with open(path, "x") as f:
        f.write("\n\n".join(parts) + "\n")
