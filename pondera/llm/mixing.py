"""Mixing sources to target weights.

Words are summed per source, a target per source follows from the weights, and
``target / size`` is the source's repetition rate.  Each document is emitted
``floor(rate)`` times, plus once more if a number hashed from the seed and its
id is below the rate's fraction.  DataFrame expressions only; documents are
never grouped by source beyond a partial sum, so a hot source costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pondera.llm import textkit
from pondera.plans.scratch import Scratch

#: A word: a run of anything but space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the seed and a key, the same in every run (52 bits of an MD5)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows without an id, with ``mark``: the text's digest and a number among the rows with this text and source.

    They are counted by the part of the table that they were read from, so a text that
    very many rows have is numbered by as many tasks; the parts' sums follow.
    """
    key = ["source", "digest", "part"]
    rows = scratch.keep(rows.withColumn("row", F.struct("*")).select("row", F.col("source"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.spark_partition_id().alias("part")), "unnamed")
    ahead = Window.partitionBy("source", "digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("before", *[F.col(c).alias(f"{c}_") for c in key])
    same = F.col("source").eqNullSafe(F.col("source_")) & (F.col("digest") == F.col("digest_")) & (F.col("part") == F.col("part_"))
    n = F.row_number().over(Window.partitionBy(*key).orderBy("digest")) - 1
    return rows.withColumn("n", n).join(before, same).select("row.*", F.concat("digest", F.lit(":"), (F.col("before") + F.col("n")).cast("string")).alias("mark"))


def cycle_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Give the distinct sources, by code point with null last, the weights in turn.

    The numbering needs one ordered pass over the distinct sources, not over the
    documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, len(weights)) + 1))


def water_fill(sources: DataFrame, total: int | None = None, max_repeats: float = 3.0) -> DataFrame:
    """Targets that share ``total`` (default: all sizes) by weight, none above ``max_repeats`` times its size.

    ``target = min(max_repeats * size, level * weight)``: each round reshares what
    capped sources leave over, and raises the level, until no source is above its
    cap.  A round brings three sums to the driver.  Without any size, targets are 0.
    """
    total = total if total is not None else sources.agg(F.sum("size")).first()[0] or 0
    capped, rest, over = 0.0, sources.agg(F.sum("weight")).first()[0] or 0.0, 0
    cap = F.lit(max_repeats) * F.col("size")
    while rest:
        level = F.lit(total - capped) * F.col("weight") / F.lit(rest)
        c, r, n = sources.agg(F.sum(F.when(level > cap, cap)), F.sum(F.when(level > cap, F.lit(0.0)).otherwise(F.col("weight"))), F.count(F.when(level > cap, 1))).first()
        if n == over:
            break
        capped, rest, over = c or 0.0, r or 0.0, n
    share = F.lit(total - capped) * F.col("weight") / F.lit(rest) if rest else cap
    return sources.withColumn("target", F.least(cap, share).cast("double"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeats: float = 3.0, seed: str = "mix", total: int | None = None) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target`` and ``copies``.

    ``copies`` is how often the mix takes the document; ``emit`` repeats rows.  No
    document is taken more than ``max_repeats`` times (rounded up).  A null text
    has size 0, null is a source of its own, and rows with one id are taken alike.
    A row with a null id is hashed by its text and its number among the rows with
    that text and source, so copies without an id are taken apart.  Columns with
    one of the four names are replaced, others are kept, whatever their names.
    An empty table gives an empty one, and texts are of any length: they are only counted.
    """
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", word_count(F.col("text")))
    scratch, names = Scratch(docs.sparkSession, "mix"), [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    sizes = scratch.keep(docs.groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    rates = water_fill(cycle_weights(sizes, weights), total, max_repeats)
    of, mark = textkit.free_name(docs, "mixed_source"), textkit.free_name(docs, "mixed_mark")
    named = docs.where("doc_id is not null").withColumn(mark, F.col("doc_id").cast("string"))
    marked = named.union(_numbered(docs.where("doc_id is null"), scratch))
    rates = scratch.keep(rates.select(F.col("source").alias(of), F.col("size").alias("source_size"), "target"), "rates")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(max_repeats))).otherwise(F.lit(0.0))
    extra = (uniform(seed, F.col(mark)) < rate - F.floor(rate)).cast("long")
    out = marked.join(rates, F.col("source").eqNullSafe(F.col(of)), "left")
    return out.select(*names, "source_size", "target", (F.floor(rate) + extra).alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as many times as the mix takes it; all columns stay, and an empty table stays empty."""
    copy = textkit.free_name(mixed, "copy")
    return mixed.where("copies > 0").withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop(copy)
