"""Typed questions about a state: rendered, scored as options, and answered.

A request is ``request_id, state`` (JSON text) and questions, one row each:
``request_id, qid, ordinal, type, instructions, criteria``.  ``criteria`` is an ordered
``array<struct<name, desc>>`` (names for choice, levels for score, true and false for
noul); entries are JSON text or null.  Question ids never enter a prompt.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondera.functions import scores as S
from pondera.functions import text as X
from pondera.operators import scorers
from pondera.plans.scratch import Scratch

# The prompts' sentences.
CHOICE_HEAD, SCORE_HEAD = "Choose exactly one option.\nOptions:\n", "Rate on the following ordered levels and answer with the level number only.\nLevels:\n"
YES_HEAD, NO_HEAD, NOUL_TAIL, TAIL = "Answer yes when:\n", "Answer no when:\n", "Answer yes or no.\n\nAnswer:\n", "\n\nAnswer:\n"

QUESTION = "request_id string, qid string, ordinal int, type string, instructions string, criteria array<struct<name:string,desc:string>>"


def fault(kind: Column, criteria: Column) -> Column:
    """The first rule that a question breaks, or null."""
    n = F.size(F.coalesce(criteria, F.array().cast("array<struct<name:string,desc:string>>")))
    names = F.transform(criteria, lambda c: c["name"])
    return (
        F.when(~F.coalesce(kind.isin("choice", "score", "noul"), F.lit(False)), "unknown question type")
        .when((kind == "choice") & ((n < 2) | (n > 255)), "choice needs 2..255 criteria")
        .when((kind == "score") & (n < 2), "score needs at least two levels")
        .when((kind == "noul") & (n > 0) & ~F.forall(names, lambda x: x.isin("true", "false")), "noul criteria are true and false")
    )


def explode_requests(requests: DataFrame) -> DataFrame:
    """Question rows of ``request_id, state, questions`` (JSON text of an object), in order.

    Order of questions and of a choice's criteria matters, which a variant would
    lose, so the objects are read in Python.  Questions that can't be read fail the
    query with their request's id.
    """
    shape = "struct<error:string,items:array<struct<qid:string,ordinal:int,type:string,instructions:string,criteria:array<struct<name:string,desc:string>>>>>"

    @F.pandas_udf(shape)
    def listed(raw: pd.Series) -> pd.DataFrame:
        def entry(v):
            return None if v is None else json.dumps(v, ensure_ascii=False)

        def one(text):
            out = []
            for i, (qid, q) in enumerate(json.loads(text).items()):
                c = q.get("criteria")
                pairs = c.items() if isinstance(c, dict) else enumerate(c or [])
                out.append({"qid": qid, "ordinal": i, "type": q.get("type"), "instructions": entry(q.get("instructions")), "criteria": [{"name": str(k), "desc": entry(v)} for k, v in pairs]})
            return out

        rows = []
        for text in raw:
            try:
                rows.append((None, one(text)))
            except (ValueError, TypeError, AttributeError, RecursionError):
                rows.append(("questions are not an object of questions", []))
        return pd.DataFrame(rows, columns=["error", "items"])

    read = requests.select("request_id", "state", listed("questions").alias("l"))
    fault = F.raise_error(F.concat(F.lit("request "), F.coalesce(F.col("request_id").cast("string"), F.lit("?")), F.lit(": "), "l.error"))
    read = read.where(F.when(F.col("l.error").isNotNull(), fault).otherwise(F.lit(True)))
    return read.select("request_id", "state", F.explode("l.items").alias("q")).select("request_id", "state", "q.*")


def render(questions: DataFrame) -> DataFrame:
    """Add ``prompt`` and ``labels``, row by row; an invalid question fails the query."""
    broken = fault(F.col("type"), F.col("criteria"))
    rows = questions.where(F.when(broken.isNotNull(), F.raise_error(broken)).otherwise(F.lit(True)))
    empty = F.array().cast("array<struct<name:string,desc:string>>")
    joined = rows.withColumns({"_d": X.all_indented(F.transform(F.coalesce("criteria", empty), lambda c: c["desc"])), "_s": X.indented("state"), "_i": X.indented("instructions")})
    joined = joined.withColumn("entries", F.transform(F.coalesce("criteria", empty), lambda c, i: F.struct(i.alias("pos"), c["name"].alias("name"), F.get("_d", i).alias("desc"))))
    titled = lambda head, e: F.when(e["desc"] != "", F.concat(head, F.lit(": "), e["desc"])).otherwise(head)
    choice = F.concat(F.lit(CHOICE_HEAD), F.array_join(F.transform("entries", lambda e: titled(F.concat(F.lit("- "), e["name"]), e)), "\n"), F.lit(TAIL))
    score = F.concat(F.lit(SCORE_HEAD), F.array_join(F.transform("entries", lambda e: titled(e["pos"].cast("string"), e)), "\n"), F.lit(TAIL))
    said = lambda name: F.coalesce(F.get(F.filter("entries", lambda e: e["name"] == name), F.lit(0))["desc"], F.lit(""))
    when = lambda head, name: F.when(said(name) != "", F.concat(F.lit(head), said(name), F.lit("\n\n"))).otherwise(F.lit(""))
    noul = F.concat(when(YES_HEAD, "true"), when(NO_HEAD, "false"), F.lit(NOUL_TAIL))
    body = F.when(F.col("type") == "choice", choice).when(F.col("type") == "score", score).otherwise(noul)
    labels = F.when(F.col("type") == "choice", F.transform("entries", lambda e: e["name"])).when(F.col("type") == "score", F.transform("entries", lambda e: e["pos"].cast("string"))).otherwise(F.array(F.lit("yes"), F.lit("no")))
    return joined.withColumns({"prompt": F.concat(X.block("State", F.col("_s")), X.block("Question", F.col("_i")), body), "labels": labels}).drop("_s", "_i", "_d", "entries")


def answer(scored: DataFrame) -> DataFrame:
    """Typed answers of rows ``type, labels, probabilities``: ``choice, score, noul, confidence, answer_probabilities, legend``.

    Confidence is given for choice and score; the first of equal choices wins.
    """
    p = F.col("probabilities")
    kind = lambda k: F.col("type") == k
    return scored.withColumns({
        "choice": F.when(kind("choice"), F.get("labels", S.first_best(p))),
        "score": F.when(kind("score"), S.expected_level(p)),
        "noul": F.when(kind("noul"), S.yes_probability(p)),
        "confidence": F.when(~kind("noul"), S.certainty(p)),
        "answer_probabilities": F.when(~kind("noul"), F.map_from_arrays("labels", p)),
        "legend": F.when(kind("score"), F.map_from_arrays(F.transform("criteria", lambda c, i: i.cast("string")), F.transform("criteria", lambda c: c["desc"]))),
    })


def system_one(questions: DataFrame, score: Callable[[DataFrame], DataFrame] | scorers.Bigrams, *, norm: str = "sum") -> DataFrame:
    """Answer every question with a scorer (see ``scorers``): question rows with answers and ``input_tokens, output_tokens``.

    Rows have ``state`` beside the question's columns, so a question never meets
    its request in a join.  A bigram model with a store answers in the row: nothing is
    shuffled or written.  For other scorers rendered questions are numbered and written
    once.  Null and repeated ids stay, each row with its own answer.
    """
    rendered = render(questions).withColumn("input_tokens", F.size(scorers.words_of(F.col("prompt"))).cast("long"))
    if isinstance(score, scorers.Bigrams):
        if score.store:
            spread = scorers.row_distributions(rendered, score, context="prompt", options="labels", norm=norm)
            return answer(spread.withColumnRenamed("n_tokens", "output_tokens").drop("scores"))
        model, score = score, lambda df: scorers.score_bigrams(df, model)
    scratch = Scratch(questions.sparkSession, "systemone")
    rendered = scratch.keep(rendered.withColumn("id", F.monotonically_increasing_id().cast("string")), "rendered")
    scored = score(rendered.select("id", F.col("prompt").alias("context"), F.col("labels").alias("options")))
    spread = scorers.distributions(scored, norm=norm).select("id", "probabilities", F.col("n_tokens").alias("output_tokens"))
    return answer(rendered.join(spread, "id")).drop("id")


def responses(answers: DataFrame) -> DataFrame:
    """One row per request: its answers by question id, and summed usage."""
    a = F.struct("type", "choice", "score", "noul", "confidence", F.col("answer_probabilities").alias("probabilities"))
    return answers.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("qid", a.alias("a")))).alias("answers"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
