"""Clusters of linked rows, and splits that keep clusters whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pondera.functions import text as X
from pondera.operators.components import connected_components
from pondera.operators.prefix import number

SPLITS = ("train", "valid", "calibration", "test")


def identity_keys(rows: DataFrame) -> DataFrame:
    """``row, kind, value``: a chess row's game, puzzle and position, those that it has."""
    game = X.game_identity(F.col("game_id"), F.col("game_url"))
    keys = F.array(F.struct(F.lit("game").alias("kind"), game.alias("value")), F.struct(F.lit("puzzle").alias("kind"), F.nullif(F.col("puzzle_id"), F.lit("")).alias("value")), F.struct(F.lit("position").alias("kind"), F.nullif(F.col("position"), F.lit("")).alias("value")))
    return rows.select("row", F.explode(F.filter(keys, lambda k: k["value"].isNotNull())).alias("k")).select("row", "k.kind", "k.value")


def clusters(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``row, cluster`` for every row: rows that share a key, directly or through others.

    Each row is linked to the smallest row of each of its keys, so a key of m rows
    makes m edges and not m * m.  A cluster is its smallest row; a row without
    keys is one.
    """
    low = keys.groupBy("kind", "value").agg(F.min("row").alias("low"))
    edges = keys.join(low, ["kind", "value"]).select(F.col("row").alias("a"), F.col("low").alias("b"))
    found = connected_components(edges)
    return rows.select("row").distinct().join(found, F.col("row") == F.col("node"), "left").select("row", F.coalesce("component", "row").alias("cluster"))


def _taken(deficits: list[float], size: int, count: int) -> list[int]:
    """How many of ``count`` equal clusters each split takes surely, if they go to the largest deficit one by one.

    A split's deficit falls by ``size`` with every cluster, so the greedy rule takes the
    ``count`` largest of the levels ``deficit - k * size``.  The sum of how many levels lie above a
    height is piecewise linear; it is solved for ``count``, and two sizes above the
    solution all levels are among those taken.  A few clusters for each split are left over.
    """
    order = sorted(deficits, reverse=True)
    for m in range(1, len(order) + 1):
        height = (sum(order[:m]) - count * size) / m
        if m == len(order) or height >= order[m]:
            break
    return [max(0, int((d - height - 2 * size) // size) + 1) if d >= height + 2 * size else 0 for d in deficits]


def plan_sizes(sizes: list[tuple[int, int]], fractions: tuple[float, ...], names: tuple[str, ...] = SPLITS) -> dict[int, list[int]]:
    """How many clusters of each size go to each split.

    Sizes fall; each cluster goes to the split with the largest deficit, and the
    last ones to splits that are still empty.  Only ``(size, count)`` pairs are needed,
    since clusters of one size can stand for each other, and all but a few of a
    size's clusters are counted at once: the work is sizes times splits.
    """
    total = sum(s * n for s, n in sizes)
    goal, have, left = [total * f for f in fractions], [0] * len(names), sum(n for _, n in sizes)
    if left < len(names):
        raise ValueError(f"need at least {len(names)} independent groups")
    out: dict[int, list[int]] = {}
    for size, count in sorted(sizes, reverse=True):
        row = out.setdefault(size, [0] * len(names))
        while count:
            sure = _taken([g - h for g, h in zip(goal, have, strict=True)], size, min(count, left - len(names))) if min(count, left - len(names)) > 4 * len(names) else []
            if not any(sure):  # one by one
                empty = [i for i in range(len(names)) if not have[i]]
                pool = empty if left == len(empty) else range(len(names))
                best = max(pool, key=lambda j: goal[j] - have[j])
                sure = [int(i == best) for i in range(len(names))]
            row[:] = [a + b for a, b in zip(row, sure, strict=True)]
            have = [h + size * b for h, b in zip(have, sure, strict=True)]
            left, count = left - sum(sure), count - sum(sure)
    return out


def group_split(members: DataFrame, *, seed: int = 42, fractions: tuple[float, float, float, float] = (0.7, 0.1, 0.1, 0.1)) -> DataFrame:
    """``cluster, split`` from ``row, cluster``.

    The histogram of cluster sizes goes to the driver (distinct sizes are at most the
    root of twice the rows); clusters are numbered within their size by a seeded hash,
    and consecutive numbers take a size's splits in turn: an equi-join by size and a choice in the row.
    """
    if len(fractions) != 4 or min(fractions) <= 0 or abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("four positive fractions must sum to one")
    sized = members.groupBy("cluster").agg(F.count(F.lit(1)).cast("int").alias("size"))
    keyed = sized.withColumn("key", F.struct("size", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cluster").cast("string"))).alias("h"), "cluster"))
    histogram = sorted((r["size"], r["n"]) for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect())
    plan, before, rows = plan_sizes(histogram, fractions), 0, []
    for size, count in histogram:
        rows.append((size, [before + sum(plan[size][: i + 1]) for i in range(len(SPLITS))]))
        before += count
    ends = members.sparkSession.createDataFrame(rows, "planned int, ends array<bigint>")
    numbered = number(keyed.select("key"), "key").join(ends, F.col("key.size") == F.col("planned"))
    place = F.size(F.filter("ends", lambda e: e <= F.col("ordinal")))
    return numbered.select("key.cluster", F.get(F.array(*[F.lit(s) for s in SPLITS]), place).alias("split"))


def puzzle_split(puzzles: DataFrame, *, key: str, seed: int = 42, sample: int = 0, shares: tuple[float, float] = (0.1, 0.1)) -> DataFrame:
    """``key, split``: a seeded order of distinct keys, cut to ``sample`` (0: all), then valid, test and the rest train."""
    keyed = puzzles.select(F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))).alias("h"), F.col(key).alias("k")).alias("key")).distinct()
    numbered = number(keyed, "key")
    n = numbered.count()
    n = min(n, sample) if sample else n
    a, b = int(n * shares[0]), int(n * shares[0]) + int(n * shares[1])
    split = F.when(F.col("ordinal") < a, "valid").when(F.col("ordinal") < b, "test").otherwise("train")
    return numbered.where(F.col("ordinal") < n).select(F.col("key.k").alias(key), split.alias("split"))


def filter_puzzles(puzzles: DataFrame, max_rating: int, min_popularity: int) -> DataFrame:
    """A plain filter, so that it reaches the Parquet scan."""
    return puzzles.where((F.col("Rating") <= max_rating) & (F.col("Popularity") >= min_popularity))


def solver_moves(puzzles: DataFrame, max_per_puzzle: int) -> DataFrame:
    """One row per solving move, ``ply`` from 0: every second move from the second, at most ``max_per_puzzle``."""
    flat = puzzles.select("*", F.posexplode(F.split("Moves", " ")).alias("i", "move"))
    return flat.where((F.col("i") % 2 == 1) & (F.col("i") < 2 * max_per_puzzle)).withColumn("ply", ((F.col("i") - 1) / 2).cast("int")).drop("i")


def batches(rows: DataFrame, *, order: str, size: int, partition: str) -> DataFrame:
    """Add ``batch``, the number of each row's chunk of ``size`` within its partition key."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(partition).orderBy(order)) - 1) / size).cast("int"))
