"""URL filters: a sort-merge range join of reversed-host keys with nested rules.

A rule ``(host, path, verdict)`` fits its host and all subdomains when the URL's
path starts with the rule's path.  With host labels reversed (``org.example.``)
the hosts under a rule are one interval of sorted keys, and so are the paths under
its path.  Two sweeps join URLs with intervals:

1. distinct (host, path) pairs, sorted by reversed host and path, with the rule
   hosts' intervals: each pair learns the rule hosts that enclose it;
2. the distinct (rule host, path) pairs that follow, sorted, with the intervals of
   the host's paths.  A path that all hosts under a rule host have, as ``/``, is one
   pair; its rules return to the hosts by an equi-join.

A sweep range-partitions keys, interval starts and interval ends together; a start
is also carried into the later partitions that its interval reaches.  Inside a
partition, the latest start that a key has passed names the stack of intervals
open there (itself and those around it); the key keeps those it is still in.

Everything is DataFrame expressions.  Copies of one URL are judged once, and the keys
of a sweep are distinct, so no host, path or pair of them is more than one row of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pondera.plans.scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded; '' without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """``www.example.org`` as ``org.example.www.``: subdomains share a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def parent_keys(key: Column) -> Column:
    """All reversed keys that enclose this one, itself included."""
    labels = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules as ``at`` (reversed host), ``begin`` (path), ``rule`` and ``verdict``.

    Equal (host, path) rules count once: block wins over allow.  A rule with a null
    in it is dropped.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    host = F.translate("host", _UPPER, _LOWER)
    rules = rules.groupBy(host.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    return rules.select(reversed_host(F.col("host")).alias("at"), F.col("path").alias("begin"), F.concat("host", "path").alias("rule"), "verdict")


def _host_intervals(rules: DataFrame) -> DataFrame:
    """``prefix, stack``: each rule host's keys and the rule hosts around it, outermost first."""
    hosts = rules.select("at").distinct()
    around = hosts.select("at", F.explode(parent_keys(F.col("at"))).alias("outer")).join(hosts.select(F.col("at").alias("outer")), "outer")
    return around.groupBy(F.col("at").alias("prefix")).agg(F.sort_array(F.collect_list(F.struct(F.length("outer").alias("size"), F.col("outer").alias("prefix")))).alias("stack"))


def _path_intervals(rules: DataFrame) -> DataFrame:
    """``prefix, stack``: the paths of each rule and the rules around it at the same host, outermost first."""
    entry = F.struct(F.length("begin").alias("size"), _under("at", "begin").alias("prefix"), "rule", "verdict")
    outer = rules.select("at", F.col("begin").alias("outer"), entry.alias("entry"))
    inner = rules.select("at", "begin", F.explode(F.transform(F.sequence(F.lit(0), F.length("begin")), lambda n: F.col("begin").substr(F.lit(1), n))).alias("outer"))
    return inner.join(outer, ["at", "outer"]).groupBy(_under("at", "begin").alias("prefix")).agg(F.sort_array(F.collect_list("entry")).alias("stack"))


def _under(outer: str, inner: str) -> Column:
    return F.concat(F.col(outer), F.lit("\0"), F.col(inner))


def _sweep(points: DataFrame, intervals: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Points with ``open``: the entries of nested prefix intervals that hold their ``key``, outermost first."""
    places = points.columns
    key = lambda c: F.col(c).cast("binary")
    blank = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    events = points.select(key("key").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast(intervals.schema["stack"].dataType).alias("stack"), *places)
    bare = [blank(f) for f in points.schema]
    events = events.unionByName(intervals.select(key("prefix").alias("place"), F.lit(0).alias("kind"), "prefix", "stack", *bare))
    # no UTF-8 text has the byte FF, so this is after all keys with the prefix
    events = events.unionByName(intervals.select(F.concat(key("prefix"), F.lit(b"\xff")).alias("place"), F.lit(2).alias("kind"), "prefix", F.lit(None).alias("stack"), *bare))
    events = scratch.keep(events.repartitionByRange("place").withColumn("part", F.spark_partition_id()), name)
    starts = events.where("kind = 0").drop("part").join(events.where("kind <> 1").groupBy("prefix").agg(F.min("part").alias("from"), F.max("part").alias("to")), "prefix")
    starts = starts.withColumn("part", F.explode(F.expr("sequence(from, to)"))).select(*events.columns)
    order = Window.partitionBy("part").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.where("kind = 1").unionByName(starts).withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    return swept.select(*places, F.filter("open", lambda e: F.col("key").startswith(e["prefix"])).alias("open"))


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    Of all fitting rules the longest (host and path together) decides, of equally
    long ones that of the longest host; with none, ``rule`` is null and ``verdict`` is
    ``default``.  A null or schemeless
    URL has empty host and path and fits no rule.  Columns of ``pages`` with one
    of the four names are replaced, all others are kept.  Repeated rows stay
    repeated; empty tables give empty results.  URLs are of any length.
    """
    source = F.col(f"`{url.replace('`', '``')}`")
    pages = pages.withColumns({"host": host_of(source), "path": path_of(source)}).drop("rule", "verdict")
    rules, scratch = compile_rules(rules), Scratch(pages.sparkSession, "urls")
    targets = pages.select("host", "path").where("host != ''").distinct().withColumn("at", reversed_host(F.col("host")))
    enclosed = _sweep(targets.select("host", "path", _under("at", "path").alias("key")), _host_intervals(rules), scratch, "hosts")
    under = scratch.keep(enclosed.select("host", "path", F.explode("open").alias("outer")).select("host", "path", F.col("outer.prefix").alias("at"), F.col("outer.size").alias("depth")), "under")
    pairs = under.select("at", "path").distinct().select("at", "path", _under("at", "path").alias("key"))
    fits = _sweep(pairs, _path_intervals(rules), scratch, "paths").where(F.size("open") > 0).select("at", "path", F.element_at("open", -1).alias("top"))
    best = under.join(fits, ["at", "path"]).groupBy("host", "path").agg(F.max(F.struct(F.length("top.rule").alias("size"), "depth", "top")).alias("best"))
    best = scratch.keep(best.select("host", "path", F.col("best.top.rule").alias("rule"), F.col("best.top.verdict").alias("verdict")), "best")
    scratch.drop("hosts", "under", "paths")
    return pages.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
