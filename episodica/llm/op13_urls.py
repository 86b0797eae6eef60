"""URL filters by a path-template tree.

Explicit rules decide first and at the same time label the urls they fit. For the rest every host has a tree over the
segments of its paths. Level by level a segment that is rare among its siblings becomes a wildcard; of the named branches
and the wildcard that are left, those whose urls do not differ significantly (in their shares of blocked, allowed and ending
urls) are merged and go on as one branch. A template is a way down that tree. It is rejected where blocked urls prevail
among its labelled ones, after smoothing towards one half.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import broadcast_if_small
from episodica.session import materialize

#: Levels of a tree; the last one holds the rest of a longer path as one segment.
LEVELS = 5
#: Distinct urls that a named branch has at least, and the part of its siblings' urls: one in ``PART``.
LEAST, PART = 3, 50
#: Squared normal quantile beyond which two shares differ (5 percent).
DIFFERS = 3.84
#: Smoothing: neutral urls added to the labelled ones, and the part of an unlabelled url that counts as one more.
NEUTRAL, UNLABELLED = 2.0, 0.25
#: Smoothed share of blocked urls from which a template is rejected.
REJECT = 0.8
#: Copies of a node's names when they cannot be broadcast, so that a host with a third of all urls is many tasks.
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#`` with A-Z lower-cased, and then up to ``?`` or ``#``."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits ``host`` or one of its parents and starts ``path``; null without one."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        found = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}"), F.lit(rule)).otherwise(found)
    return found


def template_tree(urls: DataFrame) -> DataFrame:
    """``host, path, label, template, urls, blocked, allowed, purity`` for distinct ``urls(host, path, label)``.

    ``label`` is ``block``, ``allow`` or null. ``purity`` is the smoothed share of blocked urls of the template.
    """
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(path, 2)"), "/", LEVELS))
    label = F.coalesce(F.col("label"), F.lit(""))
    at = materialize(urls.select("host", "path", "label", segments.alias("segs"), (label == "block").cast("long").alias("block"), (label == "allow").cast("long").alias("allow"),
                                 F.lit("").alias("prefix")), "urls")
    deepest = at.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(deepest):
        names = materialize(_names(at.filter(F.size("segs") > level), level), "branches")
        at = materialize(_descend(at, names, level), "urls")
    stats = at.groupBy("host", "prefix").agg(F.count("*").alias("urls"), F.sum("block").alias("blocked"), F.sum("allow").alias("allowed"))
    labelled = F.col("blocked") + F.col("allowed")
    neutral = F.lit(NEUTRAL) + F.lit(UNLABELLED) * (F.col("urls") - labelled)
    stats = stats.withColumn("purity", (F.col("blocked") + F.lit(0.5) * neutral) / (labelled + neutral))
    return _attach(at.select("host", "path", "label", "prefix"), materialize(stats, "templates")).select(
        "host", "path", "label", F.concat("host", "prefix").alias("template"), "urls", "blocked", "allowed", "purity")


def _names(at: DataFrame, level: int) -> DataFrame:
    """``host, prefix, names``: of every node the map from branch to the name of the class it is merged into."""
    node, sums = ["host", "prefix"], ["n", "block", "allow", "ends"]
    ends = (F.size("segs") == level + 1).cast("long")
    segments = at.groupBy(*node, F.element_at("segs", level + 1).alias("branch")).agg(
        F.count("*").alias("n"), F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.sum(ends).alias("ends"))

    def collapse(rows: DataFrame, named: Column) -> DataFrame:
        return rows.withColumn("branch", F.when(named, F.col("branch")).otherwise(F.lit("*"))).groupBy(*node, "branch").agg(*[F.sum(c).alias(c) for c in sums])

    some = collapse(segments, F.col("n") >= LEAST)  # the long tail of a host goes before its rows meet
    total = some.groupBy(*node).agg(F.sum("n").alias("total"))
    branches = collapse(some.join(broadcast_if_small(total), node), F.col("n") * PART >= F.col("total"))
    # at most PART + 1 branches a node from here on
    shares = [F.col(c) / F.col("n") for c in ("block", "allow", "ends")]
    order = Window.partitionBy(*node).orderBy(*shares, "branch")
    with_last = branches.select("*", *[F.lag(c).over(order).alias(f"last_{c}") for c in sums])
    n, last_n = F.col("n"), F.col("last_n")

    def alike(c: str) -> Column:
        both = (F.col(c) + F.col(f"last_{c}")) / (n + last_n)
        apart = F.col(c) / n - F.col(f"last_{c}") / last_n
        return apart * apart * n * last_n <= F.lit(DIFFERS) * (n + last_n) * both * (1 - both)

    new = F.when(last_n.isNull() | ~(alike("block") & alike("allow") & alike("ends")), 1).otherwise(0)
    classes = with_last.withColumn("_new", new).withColumn("class", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = classes.groupBy(*node, "class").agg(F.sort_array(F.collect_list("branch")).alias("branches"))
    name = F.when(F.array_contains("branches", "*"), F.lit("*")).when(F.size("branches") == 1, F.element_at("branches", 1)).otherwise(
        F.concat(F.lit("("), F.array_join("branches", "|"), F.lit(")")))
    entries = F.transform("branches", lambda b: F.struct(b.alias("key"), F.col("name").alias("value")))
    return merged.withColumn("name", name).withColumn("e", entries).groupBy(*node).agg(F.map_from_entries(F.flatten(F.collect_list("e"))).alias("names"))


def _attach(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows with their node's columns: by broadcast behind a count, else by a join whose key is spread over ``SALTS``."""
    small = broadcast_if_small(nodes)
    if small is not nodes:
        return rows.join(small, ["host", "prefix"])
    salted = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "prefix", "_salt"]).drop("_salt")


def _descend(at: DataFrame, names: DataFrame, level: int) -> DataFrame:
    own = F.element_at("segs", level + 1)
    below = _attach(at.filter(F.size("segs") > level), names).withColumn("prefix", F.concat("prefix", F.lit("/"), F.coalesce(F.col("names")[own], F.col("names")["*"])))
    return below.select(*at.columns).unionByName(at.filter(F.size("segs") <= level))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; columns of the input with those names are left out.

    ``rules`` is a list of ``(verdict, host/path)`` short enough to be one expression. The longest fitting rule's verdict
    holds; other urls are allowed unless the template of their path is rejected. Null urls and urls without ``://`` have an
    empty host and path and are allowed. Repeated urls count once in the trees and are all judged alike; urls that differ
    only behind ``?`` or ``#`` are one path. Paths of any length are read; from level ``LEVELS`` on the rest is one segment.
    A literal ``*`` segment counts as a wildcard. Equal shares order by the branch's name. An empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    made = ["host", "path", "rule", "verdict"]
    rows = pages.drop(*made).select("*", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    verdicts = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdicts = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdicts)
    distinct = rows.select("host", "path", "rule").distinct().select("host", "path", verdicts.alias("label"))
    rejected = template_tree(distinct).filter(F.col("label").isNull() & (F.col("purity") >= REJECT)).select(F.struct("host", "path").alias("_rejected"))
    place = F.when(F.col("rule").isNull(), F.struct("host", "path"))
    out = rows.alias("p").join(broadcast_if_small(materialize(rejected, "rejected")).alias("r"), place == F.col("r._rejected"), "left")
    kept = [F.col(f"p.{c}") for c in rows.columns]
    return out.select(*kept, F.coalesce(verdicts, F.when(F.col("r._rejected").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
