"""Conversation structure repair by weighted finite-state composition.

Three machines are composed: the acceptor of a conversation's rows in order, an edit
transducer (keep, rerole, delete, insert), and an acceptor of well-formed sequences
of roles.  The composition is lazy: a state is a row's place and a state of the role
grammar, and only the arcs that leave it are made.  Weights are pairs of a cost and the
string of edit labels, compared in this order, so that the shortest path is unique.

States are met in reverse topological order.  An insertion reads no row, so a run
of them belongs to the row in front of which it stands; a path through some rows is
then a sequence of units ``I...I`` and one of K, R, D, no two of them alike in their
first part, and two paths over the same rows compare by their first different unit.
So label strings need not be built to be compared: the rank of a state's best string
among all follows from its first unit and the rank of the rest.

That also makes paths composable.  A conversation is cut into segments of bounded
size; each gives the weight of its best path from every grammar state to every other
one.  A pass over these small tables, segment by segment from the end, chooses the
states at the cuts, and every segment then writes out its own part of the path.  A
conversation of any length is so dealt out to many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pondera.llm import textkit
from pondera.plans.scratch import Scratch, spread

#: Rows of a segment, distinct by turn, role and text.
SEGMENT = 1024
#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 40


@dataclass(frozen=True)
class Grammar:
    """A deterministic acceptor of role initials: ``steps`` has ``(state, initial, next)``; state 0 is the first.

    ``roles`` are those that edits can write, by initial; a state reads at most one of them.
    """

    size: int
    steps: tuple[tuple[int, str, int], ...]
    final: tuple[int, ...]
    roles: tuple[tuple[str, str], ...]

    @cached_property
    def after(self) -> dict[tuple[int, str], int]:
        return {(g, c): h for g, c, h in self.steps}


#: ``(s?(ua)+)?``: nothing yet, after the system's row, after a user's, after an assistant's.
CHAT = Grammar(4, ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)), (0, 3), (("u", "user"), ("a", "assistant")))


def edits(grammar: Grammar, state: int, initial: str, truncated: bool, stays: bool) -> Iterator[tuple[str, int, int]]:
    """Arcs of the edit transducer and the grammar for one row: ``label, cost, next state``."""
    yield "D", DELETE, state
    if stays:
        if (state, initial) in grammar.after:
            yield "K", KEEP + truncated * TRUNCATED, grammar.after[state, initial]
        for c, _ in grammar.roles:
            if (state, c) in grammar.after:
                yield "R", REROLE + truncated * TRUNCATED, grammar.after[state, c]


@lru_cache(maxsize=4096)
def inserted(grammar: Grammar, state: int) -> dict[int, int]:
    """The grammar states that insertions lead to, and how few of them do."""
    found, edge = {state: 0}, [state]
    for g in edge:  # grows as it is read
        for c, _ in grammar.roles:
            h = grammar.after.get((g, c))
            if h is not None and h not in found:
                found[h] = found[g] + 1
                edge.append(h)
    return found


@lru_cache(maxsize=4096)
def units(grammar: Grammar, state: int, initial: str, truncated: bool, stays: bool) -> tuple[tuple[int, str, int], ...]:
    """Lazily composed arcs from a state over one row, insertions in front included: the best ``cost, unit, next state`` for each next state."""
    best: dict[int, tuple[int, str]] = {}
    for g, n in inserted(grammar, state).items():
        for label, cost, h in edits(grammar, g, initial, truncated, stays):
            w = (cost + n * INSERT, "I" * n + label)
            best[h] = min(best.get(h, (NEVER, "")), w)
    return tuple((c, u, h) for h, (c, u) in best.items())


#: A row as the machines see it: initial, truncated, stays, and how many deleted copies follow.
Row = tuple[str, bool, bool, int]


def _again(row: Row) -> list[tuple[str, bool, bool]]:
    """The row itself, unless it must go, and one deleted copy for all that follow."""
    initial, truncated, stays, copies = row
    return [(initial, truncated, True)] * stays + [(initial, False, False)] * (copies > 0)


def paths(grammar: Grammar, rows: list[Row]) -> tuple[list[list[int]], list[list[int]], list[list[tuple[str, int] | None]]]:
    """``solve``; short conversations, of which many look alike to the machines, are solved once in a task."""
    return _solved(grammar, tuple(rows)) if len(rows) <= 12 else solve(grammar, rows)


@lru_cache(maxsize=1 << 14)
def _solved(grammar: Grammar, rows: tuple[Row, ...]) -> tuple[list, list, list]:
    return solve(grammar, list(rows))


def solve(grammar: Grammar, rows: list[Row]) -> tuple[list[list[int]], list[list[int]], list[list[tuple[str, int] | None]]]:
    """Costs and ranks of the best paths from state to state, and each step's first unit and next state, from the last row back.

    Many deleted copies in a row are one step here: each of them is a ``D``, whatever
    the state, and no insertion between them is cheaper or smaller than one before
    or behind.  ``steps[i][g * size + m]`` belongs to the i-th step.
    """
    n = grammar.size
    cost = [[0 if g == m else NEVER for m in range(n)] for g in range(n)]
    rank = [[0] * n for _ in range(n)]
    steps: list[list] = []
    flat = [(part, row[3]) for row in rows for part in _again(row)]
    for (initial, truncated, stays), copies in reversed(flat):
        extra = 0 if stays else (copies - 1) * DELETE
        new, keys, step = [[NEVER] * n for _ in range(n)], {}, [None] * (n * n)
        for g in range(n):
            arcs = units(grammar, g, initial, truncated, stays)
            for m in range(n):
                found = min(((c + cost[h][m], u, rank[h][m], h) for c, u, h in arcs if cost[h][m] < NEVER), default=None)
                if found:
                    new[g][m] = found[0] + extra
                    keys[g, m] = found[1:3]
                    step[g * n + m] = (found[1], found[3])
        order = {k: i for i, k in enumerate(sorted(set(keys.values())))}
        cost, rank = new, [[order.get(keys.get((g, m)), 0) for m in range(n)] for g in range(n)]
        steps.append(step)
    return cost, rank, steps[::-1]


def closing(grammar: Grammar) -> list[int]:
    """How many insertions end a sequence from each state."""
    return [min((n for h, n in inserted(grammar, g).items() if h in grammar.final), default=NEVER) for g in range(grammar.size)]


_SEGMENT = "part bigint, no bigint, conv {kind}, rows array<struct<turn:bigint,role:string,h:binary,truncated:boolean,stays:boolean,blank:boolean,copies:bigint>>, costs array<bigint>, ranks array<int>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, low bigint, high bigint, turns bigint"


def _legal(pair: str, grammar: Grammar) -> bool:
    """Whether a grammar state reads one initial and then the other."""
    return any((g, pair[0]) in grammar.after and (grammar.after[g, pair[0]], pair[1]) in grammar.after for g in range(grammar.size)) if len(pair) == 2 else False


def _segments(grammar: Grammar, schema: pa.Schema, limit: int):
    """Sorted rows as segments of one conversation each, with what must be known of them."""

    def close(conv: object, rows: list[dict], part: int, no: int) -> dict:
        own: list[Row] = [(r["role"][:1], r["truncated"], r["stays"], r["copies"] - r["stays"]) for r in rows]
        cost, rank, _ = paths(grammar, own)
        heads = [r["role"][:1] for r in rows]
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        illegal = sum(not _legal(a + b, grammar) for a, b in zip(heads, heads[1:], strict=False)) + sum((r["copies"] - 1) * (not _legal(h * 2, grammar)) for h, r in zip(heads, rows, strict=True))
        return {
            "part": part, "no": no, "conv": conv, "rows": [{k: r[k] for k in ("turn", "role", "h", "truncated", "stays", "blank", "copies")} for r in rows], "costs": [c for line in cost for c in line], "ranks": [x for line in rank for x in line],
            "blank": sum(r["copies"] for r in rows if r["blank"]), "duplicate": sum(r["copies"] - r["stays"] for r in rows if not r["blank"]), "truncated": sum(r["stays"] and r["truncated"] for r in rows), "illegal": illegal,
            "head": heads[0], "tail": heads[-1], "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, open_, conv = TaskContext.get().partitionId(), 0, [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if open_ and (row["conv"] != conv or len(open_) == limit):
                    out.append(close(conv, open_, part, no))
                    no, open_ = no + 1, []
                conv = row["conv"]
                open_.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist([close(conv, open_, part, no)] if open_ else [], schema)

    return run


def _choose(grammar: Grammar, schema: pa.Schema):
    """The states at every segment's ends on the conversation's best path, and the conversation's sums on its last segment."""
    n, ends = grammar.size, closing(grammar)

    def close(line: list[dict]) -> Iterator[dict]:
        rest, choice = [INSERT * e if e < NEVER else NEVER for e in ends], []
        for s in reversed(line):
            best = [min(((s["costs"][g * n + m] + rest[m], s["ranks"][g * n + m], m) for m in range(n))) for g in range(n)]
            choice.append([m for _, _, m in best])
            rest = [c for c, _, _ in best]
        g, tail, high = 0, None, None
        sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        lows = [s["low"] for s in line if s["low"] is not None]
        for i, (s, m) in enumerate(zip(line, reversed(choice), strict=True)):
            for k in sums:
                sums[k] += s[k]
            sums["illegal"] += tail is not None and not _legal(tail + s["head"], grammar)
            sums["turns"] -= s["low"] is not None and s["low"] == high
            tail, high = s["tail"], high if s["high"] is None else s["high"]
            last = i == len(line) - 1
            gaps = high - lows[0] + 1 - sums["turns"] if last and lows else 0
            yield {"part": s["part"], "no": s["no"], "begin": g, "end": m[g], "close": ends[m[g]] if last else 0, "sums": {"conv": s["conv"], "gaps": gaps, "cost": rest[0]} | {k: v for k, v in sums.items() if k != "turns"} if last else None}
            g = m[g]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if line and row["conv"] != line[-1]["conv"]:
                    out += close(line)
                    line = []
                line.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist(list(close(line)) if line else [], schema)

    return run


def _write(grammar: Grammar, schema: pa.Schema):
    """Each segment's part of the best path as edits in order."""
    n, roles = grammar.size, dict(grammar.roles)

    def put(g: int) -> tuple[str, int]:
        """The only role that can be written in a state on a best path, and the state after it."""
        return next((c, h) for c, _ in grammar.roles if (h := grammar.after.get((g, c))) is not None)

    def labels(row: dict) -> Iterator[dict]:
        own: list[Row] = [(r["role"][:1], r["truncated"], r["stays"], r["copies"] - r["stays"]) for r in row["rows"]]
        _, _, steps = paths(grammar, own)
        at, g, end = 0, row["begin"], row["end"]
        for r in row["rows"]:
            for initial, _, stays in _again((r["role"][:1], r["truncated"], r["stays"], r["copies"] - r["stays"])):
                unit, after = steps[at][g * n + end]
                for label in unit:
                    old = {k: r[k] for k in ("turn", "h")} | {"was": r["role"]} if label != "I" else {}
                    if label == "D":
                        yield old | {"edit": "D", "times": 1 if stays else r["copies"] - r["stays"]}
                        continue
                    c, h = put(g) if label in "IR" else (initial, grammar.after[g, initial])
                    yield old | {"edit": label, "times": 1, "role": r["role"] if label == "K" else roles[c]}
                    g = h
                at, g = at + 1, after
        for _ in range(row["close"]):
            c, g = put(g)
            yield {"edit": "I", "times": 1, "role": roles[c]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"conv": row["conv"], "part": row["part"], "no": row["no"], "i": i} | found for row in batch.to_pylist() for i, found in enumerate(labels(row))]
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _ddl(text: str) -> tuple[str, pa.Schema]:
    return text, to_arrow_schema(StructType.fromDDL(text))


#: Fixed value: the characters that a blank text has.
_SPACE = " \t\n\x0b\f\r"


def repair(rows: DataFrame, *, grammar: Grammar = CHAT, limit: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits that bring every conversation of ``conv_id, turn, role, text`` into the grammar, and its faults.

    First table, ``conv_id, place, edit, times, turn, was, role, text``: the edits (K, R, D, I) in the
    order of ``place``; ``role`` and ``text`` are those after the edit (null for D), ``was`` the role
    before; ``times`` counts deleted copies.  Without the D rows it is the repaired
    conversation.  Second table, ``conv_id, gaps, blank, duplicate, truncated, illegal, cost``: turns
    that lack between the first and last, rows by their first fault, neighbours whose
    initials don't follow each other in the grammar, and the cost of the edits.

    Rows go by turn (nulls first), then role and the text's digest, so repeated rows stand together and
    are faults.  A null role or text is empty; a null ``conv_id`` is a conversation.  A
    text without anything but space is blank, one whose last other character isn't
    ``.``, ``!`` or ``?`` truncated.  A conversation without rows isn't there; other columns are
    ignored; an empty table gives empty ones.  Conversations and texts are of any length.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "repair")
    textkit.bound_batches(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = spread(rows).withColumn("h", F.unhex(F.sha2("text", 256)))
    key = ["conv", "turn", "role", "h"]
    trimmed = F.rtrim("text", F.lit(_SPACE))
    seen = rows.select(*key, (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"))
    seen = scratch.keep(seen.groupBy(*key, "blank", "open").agg(F.count(F.lit(1)).alias("copies")), "seen")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = seen.where("not blank").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h").alias("x")).agg(F.min(place).alias("first"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("x")) & ~F.col("blank")
    judged = seen.join(firsts, same, "left").select(*key, "blank", "copies", (F.col("open") & ~F.col("blank")).alias("truncated"), F.coalesce(place == F.col("first"), F.lit(False)).alias("stays"))
    judged = scratch.keep(judged, "judged")

    ddl, schema = _ddl(_SEGMENT.format(kind=kind))
    segments = scratch.keep(judged.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(textkit.lean(_segments(grammar, schema, limit)), ddl), "segments", **{"parquet.block.size": str(16 << 20)})
    slim = segments.drop("rows").repartition("conv").sortWithinPartitions("conv", "part", "no")
    ddl, schema = _ddl(f"part bigint, no bigint, begin int, end int, close int, sums struct<conv:{kind},gaps:bigint,cost:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint>")
    chosen = scratch.keep(slim.mapInArrow(_choose(grammar, schema), ddl), "chosen")
    faults = chosen.where("sums is not null").select(F.col("sums.conv").alias("conv_id"), "sums.gaps", "sums.blank", "sums.duplicate", "sums.truncated", "sums.illegal", "sums.cost")

    ddl, schema = _ddl(f"conv {kind}, part bigint, no bigint, i bigint, edit string, times bigint, turn bigint, was string, h binary, role string")
    written = segments.select("part", "no", "conv", "rows").join(chosen.select("part", "no", "begin", "end", "close"), ["part", "no"]).mapInArrow(textkit.lean(_write(grammar, schema)), ddl)
    texts = rows.dropDuplicates(key).select(*[F.col(c).alias(f"t_{c}") for c in key], "text")
    own = F.col("edit").isin("K", "R") & F.col("conv").eqNullSafe(F.col("t_conv")) & F.col("turn").eqNullSafe(F.col("t_turn")) & (F.col("was") == F.col("t_role")) & (F.col("h") == F.col("t_h"))
    text = F.when(F.col("edit") == "I", F.lit("")).otherwise(F.col("text"))
    out = written.join(texts, own, "left").select(F.col("conv").alias("conv_id"), F.struct("part", "no", "i").alias("place"), "edit", "times", "turn", "was", "role", text.alias("text"))
    return out, faults


def digests(edited: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256``: each conversation's labels in order, and the digest of its ``role:text`` lines.

    A digest of a whole conversation is sequential by nature: its rows are streamed,
    in order, through one task, which holds its labels and no texts.
    """
    kind = edited.schema["conv_id"].dataType.simpleString()
    ddl, schema = _ddl(f"conv_id {kind}, audit string, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, begun, lines = None, [], hashlib.sha256(), False, 0
        for batch in batches:
            out = []
            for c, label, times, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "edit", "times", "role", "text")), strict=True):
                if begun and c != conv:
                    out.append({"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                    audit, sha, lines = [], hashlib.sha256(), 0
                conv, begun = c, True
                audit.append(label * times)
                if label != "D":
                    sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1
            yield pa.RecordBatch.from_pylist(out, schema)
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema)

    return edited.select("conv_id", "place", "edit", "times", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(textkit.lean(run), ddl)
