"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import ranks, series, stats
from episodica.plans import tables as t
from episodica.plans.registry import query, r

TEN = ["min", "max", "mean", "std", "q01", "q10", "q50", "q90", "q99"]


def ten_sql(v: str = "value", digits: int = 6) -> str:
    parts = [f"round(min({v}),{digits}) AS min", f"round(max({v}),{digits}) AS max", f"round(avg({v}),{digits}) AS mean",
             f"round(stddev_pop({v}),{digits}) AS std", "count(*) AS count"]
    parts += [f"round(quantile_cont({v},{q}),{digits}) AS {n}" for n, q in stats.QUANTILES.items()]
    return ", ".join(parts)


@query("a01_feature_stats", f"WITH {t.FRAMES_SQL} SELECT dim, {ten_sql()} FROM vals GROUP BY dim")
def a01(spark, sf):
    s = stats.feature_stats(t.frames(spark, sf), ["action"])
    return s.select("dim", "count", *r(*TEN))


@query("a01_feature_stats_wide", f"WITH {t.VECTORS_SQL} SELECT dim, {ten_sql()} FROM vvals GROUP BY dim")
def a01_wide(spark, sf):
    s = stats.feature_stats(t.vectors(spark, sf), ["embedding"])
    return s.select("dim", "count", *r(*TEN))


@query("a02_stats_by_episode", f"WITH {t.FRAMES_SQL} SELECT episode_index, dim, {ten_sql(digits=8)} FROM vals GROUP BY ALL")
def a02(spark, sf):
    s = stats.feature_stats_by_episode(t.frames(spark, sf), ["action"])
    return s.select("episode_index", "dim", "count", *r(*TEN, digits=8))


@query("a02_stats_by_episode_wide", f"WITH {t.VECTORS_SQL} SELECT episode_index, dim, {ten_sql(digits=8)} FROM vvals GROUP BY ALL")
def a02_wide(spark, sf):
    s = stats.feature_stats_by_episode(t.vectors(spark, sf), ["embedding"])
    return s.select("episode_index", "dim", "count", *r(*TEN, digits=8))


# every kind of numeric feature: scalars, a boolean, a vector and a nested array in C order
KINDS = {"timestamp": [1], "task_index": [1], "high": [1], "action": [2], "pair": [2, 2]}
_KINDS = f"""{t.FRAMES_SQL}, every AS (
  SELECT episode_index, 'timestamp' AS feature, 0 AS dim, tstamp AS value FROM frames UNION ALL SELECT episode_index, 'task_index', 0, CAST(task_index AS DOUBLE) FROM frames
  UNION ALL SELECT episode_index, 'high', 0, CAST(a0 > 50 AS DOUBLE) FROM frames UNION ALL SELECT episode_index, 'action', 0, a0 FROM frames
  UNION ALL SELECT episode_index, 'action', 1, a1 FROM frames UNION ALL SELECT episode_index, 'pair', 0, a0 FROM frames UNION ALL SELECT episode_index, 'pair', 1, a1 FROM frames
  UNION ALL SELECT episode_index, 'pair', 2, s0 FROM frames UNION ALL SELECT episode_index, 'pair', 3, s1 FROM frames)"""


def _kinds(spark, sf):
    fr = t.frames(spark, sf)
    return fr.select(*series.EPISODE, "frame_index", "timestamp", "task_index", "action", (F.get("action", F.lit(0)) > 50).alias("high"), F.array("action", "state").alias("pair"))


@query("a01_every_kind_of_feature", f"WITH {_KINDS} SELECT feature, dim, {ten_sql()} FROM every GROUP BY ALL")
def a01_kinds(spark, sf):
    total = t.table(spark, sf, "events").count()
    s = stats.feature_stats(_kinds(spark, sf), list(KINDS), shapes=KINDS, total=total)
    return s.select("feature", "dim", "count", *r(*TEN))


@query("a02_every_kind_at_both_grains", f"""WITH {_KINDS} SELECT episode_index, feature, dim, {ten_sql(digits=8)} FROM every GROUP BY ALL
  UNION ALL SELECT NULL, feature, dim, {ten_sql(digits=8)} FROM every GROUP BY feature, dim""")
def a02_kinds(spark, sf):
    whole, per = stats.stats_of_both_grains(_kinds(spark, sf), list(KINDS), KINDS)
    both = per.drop("dataset_id").unionByName(whole.withColumn("episode_index", F.lit(None).cast("bigint")))
    return both.select("episode_index", "feature", "dim", "count", *r(*TEN, digits=8))


@query("p06_shape_guard", f"""WITH {t.FRAMES_SQL} SELECT episode_index, frame_index, 'inverse' AS feature FROM frames WHERE a1 = 0
  UNION ALL SELECT episode_index, frame_index, 'wide' FROM frames WHERE a0 > 100""")
def p06(spark, sf):
    """Rows with an infinite number or another width than declared."""
    a0, a1 = F.get("action", F.lit(0)), F.get("action", F.lit(1))
    rows = t.frames(spark, sf).select(*series.EPISODE, "frame_index", F.when(a1 == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), a1)).alias("inverse"),
                                      F.when(a0 > 100, F.array("action")).otherwise(F.array("action", "state")).alias("wide"))
    return stats.shape_violations(rows, {"inverse": [1], "wide": [2, 2]}).drop("dataset_id")


@query("a03_mergeable_moments", f"""WITH {t.FRAMES_SQL} SELECT dim, count(*) AS count, round(avg(value),6) AS mean,
  round(stddev_pop(value),6) AS std, min(value) AS min, max(value) AS max FROM vals GROUP BY dim""")
def a03(spark, sf):
    partial = stats.block_moments(t.frames(spark, sf), ["action"])
    groups = ["feature", "dim"]
    return stats.finish_moments(stats.merge_moments(partial, groups), groups).select("dim", "count", "min", "max", *r("mean", "std"))


@query("a04_exact_quantiles", """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05),6) AS q05,
  round(quantile_cont(l_extendedprice, 0.5),6) AS q50, round(quantile_cont(l_extendedprice, 0.95),6) AS q95
  FROM lineitem GROUP BY 1""")
def a04(spark, sf):
    rows = t.table(spark, sf, "lineitem")
    q = ranks.quantiles(rows, ["l_returnflag"], "l_extendedprice", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    return q.select("l_returnflag", "n", *r("q05", "q50", "q95"))


@query("a04_quantiles_by_narrowing", """SELECT l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.01),6) AS q01,
  round(quantile_cont(l_extendedprice, 0.5),6) AS q50, round(quantile_cont(l_extendedprice, 0.99),6) AS q99
  FROM lineitem GROUP BY 1""")
def a04_large(spark, sf):
    """Other groups and levels; groups of every size go the same way."""
    rows = t.table(spark, sf, "lineitem")
    q = ranks.quantiles(rows, ["l_linestatus"], "l_extendedprice", {"q01": 0.01, "q50": 0.5, "q99": 0.99})
    return q.select("l_linestatus", "n", *r("q01", "q50", "q99"))


@query("a05_diagnostic_stats", f"""WITH {t.FRAMES_SQL}, q AS (SELECT 0 AS dim, l_quantity AS value FROM lineitem
  UNION ALL SELECT 1, l_discount FROM lineitem) SELECT dim, {ten_sql()} FROM q GROUP BY dim""")
def a05(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(
        F.lit("lineitem").alias("dataset_id"), F.col("l_orderkey").alias("episode_index"), F.col("l_linenumber").alias("frame_index"),
        F.array("l_quantity", "l_discount").alias("pair"),
        # one division by zero per zero-discount row makes this column unusable, so it is left out
        F.array(F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(1.0 / F.col("l_discount"))).alias("inverse"))
    return stats.diagnostic_stats(rows, ["pair", "inverse"]).select("dim", "count", *r(*TEN))


@query("a06_combined_stats", f"""WITH {t.FRAMES_SQL}, e AS (SELECT episode_index, dim, count(*) AS n, avg(value) AS mean, var_pop(value) AS var,
  min(value) AS lo, max(value) AS hi, quantile_cont(value,0.01) AS q01, quantile_cont(value,0.1) AS q10, quantile_cont(value,0.5) AS q50,
  quantile_cont(value,0.9) AS q90, quantile_cont(value,0.99) AS q99 FROM vals GROUP BY ALL),
  m AS (SELECT dim, sum(n*mean)/sum(n) AS mu FROM e GROUP BY dim)
  SELECT e.dim, min(lo) AS min, max(hi) AS max, round(any_value(mu),6) AS mean,
  round(sqrt(sum(n*(var + (mean-mu)*(mean-mu)))/sum(n)),6) AS std, CAST(sum(n) AS BIGINT) AS count,
  round(sum(n*q01)/sum(n),6) AS q01, round(sum(n*q10)/sum(n),6) AS q10, round(sum(n*q50)/sum(n),6) AS q50,
  round(sum(n*q90)/sum(n),6) AS q90, round(sum(n*q99)/sum(n),6) AS q99 FROM e JOIN m USING (dim) GROUP BY e.dim""")
def a06(spark, sf):
    per = stats.feature_stats_by_episode(t.frames(spark, sf), ["action"])
    return stats.combine(per).select("dim", "min", "max", "count", *r("mean", "std", "q01", "q10", "q50", "q90", "q99"))


_LEVELS = """l AS (SELECT l_returnflag, CAST(l_quantity AS INTEGER) AS level FROM lineitem)"""


@query("a07_histogram_stats", f"""WITH {_LEVELS} SELECT l_returnflag, round(min(level)/255.0,8) AS min, round(max(level)/255.0,8) AS max,
  round(avg(level)/255.0,8) AS mean, round(stddev_pop(level)/255.0,8) AS std, count(*) AS count,
  {', '.join(f"round(quantile_cont(level::DOUBLE,{q})/255.0,8) AS {n}" for n, q in stats.QUANTILES.items())} FROM l GROUP BY 1""")
def a07(spark, sf):
    rows = t.table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_quantity").cast("int").alias("level")).agg(F.count("*").alias("n"))
    return stats.histogram_stats(rows, ["l_returnflag"]).select("l_returnflag", "count", *r(*TEN, digits=8))


@query("a07b_histogram_nearest_rank", f"""WITH {_LEVELS}, o AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY level) AS rn,
  count(*) OVER (PARTITION BY l_returnflag) AS c FROM l) SELECT l_returnflag, round(min(level)/255.0,8) AS min, round(max(level)/255.0,8) AS max,
  round(avg(level)/255.0,8) AS mean, round(stddev_pop(level)/255.0,8) AS std, count(*) AS count,
  {', '.join(f"round(max(CASE WHEN rn = greatest(0, CAST(ceil({q}*c) AS BIGINT) - 1) + 1 THEN level END)/255.0,8) AS {n}" for n, q in stats.QUANTILES.items())}
  FROM o GROUP BY 1""")
def a07b(spark, sf):
    rows = t.table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_quantity").cast("int").alias("level")).agg(F.count("*").alias("n"))
    return stats.histogram_stats(rows, ["l_returnflag"], rule="nearest").select("l_returnflag", "count", *r(*TEN, digits=8))


# a part stands for a physical video frame, an order for an episode that selects it
_SAMPLED = """s AS (SELECT l_orderkey AS episode_index, l_partkey, l_returnflag AS channel, CAST(l_quantity AS INTEGER) AS level
  FROM lineitem GROUP BY ALL)"""


def _sampled(spark, sf):
    return t.table(spark, sf, "lineitem").select(
        F.lit("lineitem").alias("dataset_id"), F.col("l_orderkey").alias("episode_index"), "l_partkey",
        F.col("l_returnflag").alias("channel"), F.col("l_quantity").cast("int").alias("level"), F.lit(1).alias("n")).distinct()


@query("a08_dual_grain_global", f"""WITH {_SAMPLED}, d AS (SELECT DISTINCT l_partkey, channel, level FROM s)
  SELECT channel, count(*) AS count, round(avg(level)/255.0,8) AS mean, round(stddev_pop(level)/255.0,8) AS std,
  round(quantile_cont(level::DOUBLE,0.5)/255.0,8) AS q50 FROM d GROUP BY 1""")
def a08_global(spark, sf):
    glob, _ = stats.dual_grain_histograms(_sampled(spark, sf), ["l_partkey"], ["channel"])
    return stats.histogram_stats(glob, ["channel"]).select("channel", "count", *r("mean", "std", "q50", digits=8))


@query("a08_dual_grain_episode", f"""WITH {_SAMPLED} SELECT episode_index, channel, count(*) AS count, round(avg(level)/255.0,8) AS mean,
  round(quantile_cont(level::DOUBLE,0.5)/255.0,8) AS q50 FROM s GROUP BY ALL""")
def a08_episode(spark, sf):
    _, episode = stats.dual_grain_histograms(_sampled(spark, sf), ["l_partkey"], ["channel"])
    return stats.histogram_stats(episode, ["episode_index", "channel"]).select("episode_index", "channel", "count", *r("mean", "q50", digits=8))


@query("a09_column_min_max", """SELECT event_type AS series, floor(min(value)*1000+0.5)/1000 AS min, floor(max(value)*1000+0.5)/1000 AS max
  FROM events GROUP BY 1""")
def a09(spark, sf):
    return stats.column_min_max(t.table(spark, sf, "events").select(F.col("event_type").alias("series"), "value"))


@query("a23_episode_tasks", """SELECT user_id AS episode_index, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tasks
  FROM events GROUP BY 1""")
def a23(spark, sf):
    from episodica.operators.curate import episode_tasks
    rows = episode_tasks(t.frames(spark, sf), t.tasks(spark, sf))
    return rows.select("episode_index", F.array_join("tasks", ",").alias("tasks"))


@query("a25_contiguity", """SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber) AS distinct_ids, min(l_linenumber)-1 AS first_id,
  max(l_linenumber)-1 AS last_id, count(*) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS contiguous
  FROM lineitem GROUP BY 1""")
def a25(spark, sf):
    rows = t.table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("id"))
    return stats.contiguity(rows, "id", ["l_orderkey"])


@query("w13_rank_picks", """WITH o AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS rn,
  count(*) OVER (PARTITION BY p_brand) AS n FROM part)
  SELECT DISTINCT p_brand, n, rn AS rank, v AS kth FROM o
  WHERE rn IN (CAST(floor(n*0.01) AS BIGINT), CAST(floor(n*0.95) AS BIGINT), CAST(ceil(n*0.99) AS BIGINT) - 1, n // 2)""")
def w13(spark, sf):
    rows = t.table(spark, sf, "part")
    return ranks.kth_values(rows, ["p_brand"], "p_retailprice", lambda n: F.array(
        F.floor(n * 0.01), F.floor(n * 0.95), F.ceil(n * 0.99) - 1, F.floor(n / 2)))
