"""Sequence, trim, relative-action and mask queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import masks, relative, series, stats, trim
from episodica.plans import tables as t
from episodica.plans.registry import query, r

EP = series.EPISODE


@query("w01_delta", f"WITH {t.FRAMES_SQL} SELECT episode_index, frame_index, dim, round(delta,6) AS delta FROM deltas")
def w01(spark, sf):
    return series.deltas(t.frames(spark, sf)).select("episode_index", "frame_index", "dim", *r("delta"))


_ISLANDS = """act AS (SELECT episode_index, frame_index, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS g
  FROM frames WHERE a0 >= 20), isl AS (SELECT episode_index, min(frame_index) AS start, max(frame_index) AS "end", count(*) AS length FROM act GROUP BY episode_index, g)"""


@query("w02_true_runs", f"""WITH {t.FRAMES_SQL}, {_ISLANDS} SELECT episode_index, start, "end", length FROM isl WHERE length >= 3""")
def w02(spark, sf):
    active = t.frames(spark, sf).filter(F.get("action", F.lit(0)) >= 20)
    return series.runs(active, EP, min_length=3).drop("dataset_id")


@query("w09_frame_ranges", """WITH d AS (SELECT DISTINCT o_custkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders),
  g AS (SELECT *, day - row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS k FROM d)
  SELECT o_custkey, min(day) AS start, max(day) AS "end", count(*) AS length FROM g GROUP BY o_custkey, k""")
def w09(spark, sf):
    days = t.table(spark, sf, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1992-01-01")).cast("bigint").alias("day")).distinct()
    return series.runs(days, ["o_custkey"], "day")


_STATIC = f"""st AS (SELECT episode_index, frame_index, n, abs(s0 - first_value(s0) OVER w) AS h, abs(s0 - last_value(s0) OVER w) AS e FROM frames
  WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
cut AS (SELECT episode_index, any_value(n) AS length, coalesce(min(CASE WHEN h > 20 THEN frame_index END), any_value(n)) AS lead,
  any_value(n) - 1 - coalesce(max(CASE WHEN e > 20 THEN frame_index END), -1) AS trail FROM st GROUP BY 1)"""


def _first_state(spark, sf):
    return t.frames(spark, sf).withColumn("state", F.slice("state", 1, 1))


@query("w03_stationary_edges", f"""WITH {t.FRAMES_SQL}, {_STATIC} SELECT episode_index, length, lead, trail FROM cut""")
def w03(spark, sf):
    b = trim.stationary(_first_state(spark, sf), t.FPS, epsilon=20.0, start_margin_s=0.0, end_margin_s=0.0, strict=False)
    return b.select("episode_index", "length", F.col("start").alias("lead"), (F.col("length") - F.col("end")).alias("trail"))


@query("c02_trim_stationary", f"""WITH {t.FRAMES_SQL}, {_STATIC}, b AS (SELECT episode_index, length, greatest(0, lead - 1) AS start,
  length - greatest(0, trail - 2) AS "end" FROM cut)
  SELECT *, CASE WHEN start >= "end" THEN 'removes_all' ELSE 'stationary' END AS method FROM b""")
def c02(spark, sf):
    b = trim.stationary(_first_state(spark, sf), t.FPS, epsilon=20.0, start_margin_s=0.1, end_margin_s=0.2, strict=False)
    return b.select("episode_index", "length", "start", "end", "method")


def motion_sql(threshold: float, hold: int, margin: int) -> str:
    return f"""sig AS (SELECT episode_index, frame_index, n, 0 AS i, a0 AS x FROM frames UNION ALL SELECT episode_index, frame_index, n, 1, s0 FROM frames
  UNION ALL SELECT episode_index, frame_index, n, 2, a1 FROM frames UNION ALL SELECT episode_index, frame_index, n, 3, s1 FROM frames),
scl AS (SELECT episode_index, i, quantile_cont(x,0.95) - quantile_cont(x,0.05) + 1e-8 AS scale FROM sig GROUP BY ALL),
sc AS (SELECT episode_index, frame_index, any_value(n) AS n, max(abs(d)/scale) AS score FROM (SELECT *, x - lag(x) OVER (PARTITION BY episode_index, i ORDER BY frame_index) AS d FROM sig)
  JOIN scl USING (episode_index, i) WHERE d IS NOT NULL GROUP BY episode_index, frame_index),
ac AS (SELECT *, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS g FROM sc WHERE score >= {threshold}),
rn AS (SELECT episode_index, min(frame_index) AS f, max(frame_index) AS l, count(*) AS c FROM ac GROUP BY episode_index, g),
su AS (SELECT episode_index, min(f) AS f, max(l) AS l FROM rn WHERE c >= {hold} GROUP BY 1),
bounds AS (SELECT e.episode_index, e.length, CASE WHEN f IS NULL THEN 0 ELSE greatest(0, f - {margin}) END AS start,
  CASE WHEN l IS NULL THEN e.length ELSE least(e.length, l + 1 + {margin}) END AS "end",
  CASE WHEN f IS NULL THEN 'no_sustained_motion' ELSE 'motion' END AS method
  FROM (SELECT episode_index, any_value(n) AS length FROM frames GROUP BY 1) e LEFT JOIN su USING (episode_index))"""


MOTION = trim.MotionTrim(threshold=0.6, hold_time_s=0.55, margin_s=0.25)  # 6 frames held, margin 2.5 rounds to 2


def motion_bounds(spark, sf):
    pairs = trim.shared_dimensions(["value", "k"], ["value", "k"])
    return trim.motion(t.frames(spark, sf), t.FPS, pairs, MOTION)


@query("c01_trim_motion", f"""WITH {t.FRAMES_SQL}, {motion_sql(0.6, 6, 2)} SELECT episode_index, length, start, "end", method FROM bounds""")
def c01(spark, sf):
    return motion_bounds(spark, sf).select("episode_index", "length", "start", "end", "method")


@query("p11_reindex", f"""WITH {t.FRAMES_SQL}, {motion_sql(0.6, 6, 2)}, o AS (SELECT *, row_number() OVER (ORDER BY episode_index) - 1 AS out_index,
  coalesce(sum("end"-start) OVER (ORDER BY episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS base FROM bounds)
  SELECT out_index AS episode_index, CASE WHEN start > 0 OR "end" < length THEN frame_index - start ELSE frame_index END AS frame_index,
  CAST(base + frame_index - start AS BIGINT) AS "index", round(CASE WHEN start > 0 OR "end" < length THEN (frame_index-start)/10.0::DOUBLE ELSE tstamp END,6) AS timestamp, round(a0,6) AS a0
  FROM frames JOIN o USING (episode_index) WHERE frame_index >= start AND frame_index < "end" """)
def p11(spark, sf):
    bounds = motion_bounds(spark, sf).withColumn("output_index", F.col("episode_index"))
    return series.reindex(t.frames(spark, sf), bounds, t.FPS).select(
        "episode_index", "frame_index", "index", *r("timestamp"), F.round(F.get("action", F.lit(0)), 6).alias("a0"))


@query("w04_renumber", """WITH e AS (SELECT o_custkey AS episode_index, count(*) AS length FROM orders GROUP BY 1)
  SELECT episode_index, length, CAST(sum(length) OVER (ORDER BY episode_index) - length AS BIGINT) AS dataset_from_index,
  CAST(sum(length) OVER (ORDER BY episode_index) AS BIGINT) AS dataset_to_index FROM e""")
def w04(spark, sf):
    e = t.table(spark, sf, "orders").groupBy(F.lit("orders").alias("dataset_id"), F.col("o_custkey").alias("episode_index")).agg(F.count("*").alias("length"))
    return series.with_offsets(e).select("episode_index", "length", "dataset_from_index", "dataset_to_index")


@query("p10_chart_time", f"""WITH {t.FRAMES_SQL} SELECT episode_index, frame_index, round(frame_index/greatest(n-1,1)*(n/10.0::DOUBLE),6) AS chart_time FROM frames""")
def p10(spark, sf):
    lengths = series.episode_lengths(t.frames(spark, sf))
    return series.chart_time(t.frames(spark, sf), lengths, F.col("length") / t.FPS).select("episode_index", "frame_index", *r("chart_time"))


@query("p12_even_sample", f"""WITH {t.FRAMES_SQL}, e AS (SELECT DISTINCT episode_index, n FROM frames),
  w AS (SELECT episode_index, CAST(floor(i*(n-1)/19.0+0.5) AS BIGINT) AS frame_index FROM e, (SELECT unnest(range(20)) AS i) g WHERE n > 20
    UNION SELECT episode_index, frame_index FROM frames WHERE n <= 20)
  SELECT f.episode_index, f.frame_index, round(a0,6) AS a0 FROM frames f JOIN w USING (episode_index, frame_index)""")
def p12(spark, sf):
    fr = t.frames(spark, sf)
    s = series.even_sample(fr, EP, "frame_index", 20, series.episode_lengths(fr))
    return s.select("episode_index", "frame_index", F.round(F.get("action", F.lit(0)), 6).alias("a0"))


@query("p13_visual_sample", """WITH e AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
  k AS (SELECT *, greatest(least(n,100), least(CAST(floor(pow(n,0.75)) AS BIGINT), 10000)) AS k FROM e)
  SELECT DISTINCT o_orderpriority AS episode, CAST(round_even(i*((n-1)/(k-1)), 0) AS BIGINT) AS frame_index FROM k, LATERAL (SELECT unnest(range(k.k)) AS i) g""")
def p13(spark, sf):
    e = t.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("episode")).agg(F.count("*").alias("length"))
    return series.visual_sample(e, ["episode"])


@query("p04_flatten_series", f"""WITH {t.FRAMES_SQL} SELECT episode_index, frame_index, 'action | ' || CASE dim WHEN 0 THEN 'value' ELSE 'k' END AS series, round(value,6) AS value FROM vals
  UNION ALL SELECT episode_index, frame_index, 'state | ' || CAST(dim AS VARCHAR), round(state,6) FROM vals""")
def p04(spark, sf):
    features = spark.createDataFrame([("action", ["value", "k"]), ("state", None)], "feature string, names array<string>")
    return series.named_series(t.frames(spark, sf), features, ["action", "state"]).select("episode_index", "frame_index", "series", *r("value"))


@query("p06_finite_shape_guard", """WITH l AS (SELECT l_orderkey, l_linenumber, l_discount FROM lineitem)
  SELECT l_orderkey AS episode_index, l_linenumber AS frame_index, 'inverse' AS feature FROM l WHERE l_discount = 0""")
def p06(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(
        F.lit("lineitem").alias("dataset_id"), F.col("l_orderkey").alias("episode_index"), F.col("l_linenumber").alias("frame_index"),
        F.array("l_quantity", "l_tax").alias("pair"),
        F.array(F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(1.0 / F.col("l_discount"))).alias("inverse"))
    return stats.shape_violations(rows, {"pair": 2, "inverse": 1}).drop("dataset_id")


@query("w05_timestamp_order", """WITH o AS (SELECT o_custkey AS episode_index, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
  SELECT episode_index, count(*) FILTER (o_orderdate <= p) AS regressions FROM o GROUP BY 1""")
def w05(spark, sf):
    from episodica.operators.validate import timestamp_steps
    o = t.table(spark, sf, "orders").select(
        F.lit("orders").alias("dataset_id"), F.col("o_custkey").alias("episode_index"), "o_orderkey",
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("timestamp"))
    rows = series.with_position(o, EP, ["o_orderkey"], "frame_index")
    return timestamp_steps(rows).select("episode_index", "regressions")


@query("a21_relative_profile", f"""WITH {t.FRAMES_SQL}, st AS (SELECT episode_index, frame_index, CAST(s0 AS FLOAT) AS s FROM frames WHERE frame_index + 20 <= n),
  rel AS (SELECT 0 AS dim, CAST(CAST(f.a0 AS FLOAT) - st.s AS DOUBLE) AS value FROM st, (SELECT unnest(range(20)) AS k) g, frames f
    WHERE f.episode_index = st.episode_index AND f.frame_index = st.frame_index + g.k
    UNION ALL SELECT 1, CAST(CAST(f.a1 AS FLOAT) AS DOUBLE) FROM st, (SELECT unnest(range(20)) AS k) g, frames f
    WHERE f.episode_index = st.episode_index AND f.frame_index = st.frame_index + g.k)
  SELECT dim, dim = 0 AS relative, round(min(value),5) AS min, round(max(value),5) AS max, round(avg(value),5) AS mean, round(stddev_pop(value),5) AS std, count(*) AS count,
  {', '.join(f"round(quantile_cont(value,{q}),5) AS {n}" for n, q in stats.QUANTILES.items())} FROM rel GROUP BY 1""")
def a21(spark, sf):
    p = relative.profile(t.frames(spark, sf), [0], 2, chunk=20)
    return p.select("dim", "relative", "count", *r("min", "max", "mean", "std", *stats.QUANTILES, digits=5))


@query("a21_relative_profile_wide", f"""WITH {t.VECTORS_SQL}, n AS (SELECT episode_index, max(frame_index) + 1 AS n FROM vecs GROUP BY 1),
  rel AS (SELECT CAST(d AS INTEGER) AS dim, CAST(CASE WHEN d IN (0, 2, 3) THEN y.embedding[d + 1] - x.embedding[d + 6] ELSE y.embedding[d + 1] END AS DOUBLE) AS value
    FROM vecs x JOIN n USING (episode_index), (SELECT unnest(range(8)) AS k) g, vecs y, (SELECT unnest(range(5)) AS d) e
    WHERE y.episode_index = x.episode_index AND y.frame_index = x.frame_index + g.k AND x.frame_index + 8 <= n.n)
  SELECT dim, dim IN (0, 2, 3) AS relative, round(min(value),5) AS min, round(max(value),5) AS max, round(avg(value),5) AS mean, round(stddev_pop(value),5) AS std,
  count(*) AS count, {', '.join(f"round(quantile_cont(value,{q}),5) AS {n}" for n, q in stats.QUANTILES.items())} FROM rel GROUP BY 1""")
def a21_wide(spark, sf):
    """Five action and five state elements, three of them relative."""
    rows = t.vectors(spark, sf).select(*EP, "frame_index", F.slice("embedding", 1, 5).alias("action"), F.slice("embedding", 6, 5).alias("state"))
    p = relative.profile(rows, [0, 2, 3], 5, chunk=8)
    return p.select("dim", "relative", "count", *r("min", "max", "mean", "std", *stats.QUANTILES, digits=5))


@query("a21_relative_coverage", f"""WITH {t.FRAMES_SQL}, e AS (SELECT DISTINCT episode_index, n FROM frames)
  SELECT count(*) AS episodes_total, count(*) FILTER (n >= 60) AS episodes_used, count(*) FILTER (n < 60) AS episodes_skipped_short,
  CAST(sum(greatest(n-60+1,0)) AS BIGINT) AS valid_chunks FROM e""")
def a21_coverage(spark, sf):
    return relative.coverage(t.frames(spark, sf), 60)


@query("j09_frame_horizon", f"""WITH {t.FRAMES_SQL} SELECT x.episode_index, x.frame_index, count(*) AS pairs, round(sum(y.a0 - x.s0),6) AS moved FROM frames x, frames y
  WHERE y.episode_index = x.episode_index AND y.frame_index BETWEEN x.frame_index AND x.frame_index + 4 AND x.frame_index + 5 <= x.n GROUP BY ALL""")
def j09(spark, sf):
    from pyspark.sql import Window
    rows = series.halo(t.frames(spark, sf).select(*EP, "frame_index", "action", "state"), "frame_index", after=4)
    w = Window.partitionBy(*EP, "_blk").orderBy("frame_index").rowsBetween(0, 4)
    ahead = rows.withColumn("_ahead", F.collect_list(F.get("action", F.lit(0))).over(w)).filter(F.col("_own") & (F.size("_ahead") == 5))
    pairs = ahead.select("episode_index", "frame_index", F.get("state", F.lit(0)).alias("s"), F.explode("_ahead").alias("a"))
    return pairs.groupBy("episode_index", "frame_index").agg(F.count("*").alias("pairs"), F.round(F.sum(F.col("a") - F.col("s")), 6).alias("moved"))


# --- masks: customers stand for objects, their orders for candidates visible some days from the order date ------------

_CAND = """cand AS (SELECT o_orderkey AS candidate_id, o_custkey AS object_id, CASE WHEN o_orderstatus = 'F' THEN 'protect' ELSE 'replace' END AS target,
  o_orderpriority LIKE '1%' AS requires_selection, o_orderstatus = 'P' AS auto_selected, o_totalprice >= 1000 AS tracked,
  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS start,
  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + CAST(floor(o_totalprice/10000) AS BIGINT) AS "end" FROM orders),
used AS (SELECT * FROM cand WHERE NOT requires_selection OR auto_selected),
objs AS (SELECT object_id, arg_min(target, candidate_id) AS target FROM used GROUP BY 1 HAVING bool_and(tracked)),
days AS (SELECT DISTINCT u.object_id, g.d FROM used u JOIN objs USING (object_id), LATERAL (SELECT unnest(range(u.start, u."end"+1)) AS d) g),
miss AS (SELECT object_id, d FROM (SELECT object_id, unnest(range(3000)) AS d FROM objs) EXCEPT SELECT object_id, d FROM days),
gaps AS (SELECT object_id, min(d) AS start, max(d) AS "end" FROM (SELECT *, d - row_number() OVER (PARTITION BY object_id ORDER BY d) AS g FROM miss) GROUP BY object_id, g)"""


def _candidates(spark, sf):
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("bigint")
    rows = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("object_id"),
        F.when(F.col("o_orderstatus") == "F", "protect").otherwise("replace").alias("target"),
        F.col("o_orderpriority").startswith("1").alias("requires_selection"), (F.col("o_orderstatus") == "P").alias("auto_selected"),
        (F.col("o_totalprice") >= 1000).alias("tracked"), day.alias("start"), (day + F.floor(F.col("o_totalprice") / 10000)).alias("end"))
    return rows.drop("start", "end"), rows.select("candidate_id", "start", "end")


@query("a26_object_coverage", f"""WITH {_CAND}, v AS (SELECT object_id, count(*) AS visible_frames FROM days GROUP BY 1),
  g AS (SELECT object_id, count(*) AS gaps, min(start) AS first_missing FROM gaps GROUP BY 1)
  SELECT o.object_id, target, coalesce(visible_frames,0) AS visible_frames, coalesce(gaps,0) AS gaps, first_missing, CAST(3000 AS BIGINT) AS frame_count
  FROM objs o LEFT JOIN v USING (object_id) LEFT JOIN g USING (object_id)""")
def a26(spark, sf):
    return masks.object_coverage(*_candidates(spark, sf), 3000)


@query("a26_missing_ranges", f"""WITH {_CAND} SELECT object_id, start, "end" FROM gaps""")
def a26_missing(spark, sf):
    return masks.missing_ranges(*_candidates(spark, sf), 3000)


@query("a26_coverage_signals", f"""WITH {_CAND}, v AS (SELECT object_id, count(*) AS c FROM days GROUP BY 1)
  SELECT g.f AS frame_index, 'object_gap' AS reason, g.object_id, 3000 - coalesce(c,0) AS missing_frames FROM (SELECT object_id, min(start) AS f FROM gaps GROUP BY 1) g LEFT JOIN v USING (object_id)""")
def a26_signals(spark, sf):
    return masks.coverage_signals(masks.object_coverage(*_candidates(spark, sf), 3000))


@query("c15_auto_select", f"""WITH {_CAND}, p AS (SELECT * FROM cand WHERE requires_selection), ch AS (SELECT candidate_id FROM cand WHERE "end" - start > 45),
  d AS (SELECT object_id, count(*) AS s, count(DISTINCT d) AS u FROM p, LATERAL (SELECT unnest(range(p.start, p."end"+1)) AS d) g GROUP BY 1)
  SELECT object_id, count(*) AS proposals, CASE WHEN bool_or(candidate_id IN (SELECT candidate_id FROM ch)) THEN 'explicit'
   WHEN count(*) = 1 OR (bool_and(tracked) AND any_value(s) = any_value(u)) THEN 'auto' ELSE 'unresolved' END AS decision
  FROM p JOIN d USING (object_id) GROUP BY 1""")
def c15(spark, sf):
    cand, ranges = _candidates(spark, sf)
    chosen = ranges.filter(F.col("end") - F.col("start") > 45).select("candidate_id")
    return masks.auto_select(cand, ranges, chosen)


@query("c15_selection_signals", """SELECT CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_totalprice > 200000) THEN CAST(o_custkey AS BIGINT) ELSE CAST(0 AS BIGINT) END AS frame_index,
  CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_totalprice > 200000) THEN 'reentry' ELSE 'auto_selected' END AS reason, o_orderkey AS candidate_id
  FROM orders WHERE o_orderstatus IN ('F','P')""")
def c15_signals(spark, sf):
    rows = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("candidate_id"), (F.col("o_orderstatus") == "P").alias("auto_selected"), (F.col("o_orderstatus") == "F").alias("reentry"),
        (F.col("o_totalprice") > 200000).alias("late_track"), F.col("o_custkey").alias("first_visible_frame"), F.lit(0).cast("bigint").alias("frame_index"))
    return masks.selection_signals(rows)


@query("c17_unmatched_prompts", """SELECT l_orderkey AS object_id, l_linestatus AS target, l_linenumber AS prompt FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = l.l_linestatus AND o_totalprice > 150000)""")
def c17(spark, sf):
    prompts = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.col("l_linestatus").alias("target"), F.col("l_linenumber").alias("prompt"))
    cand = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_orderstatus").alias("target"),
                                               F.when(F.col("o_totalprice") > 150000, 1).otherwise(0).alias("area_pixels"))
    return masks.unmatched_prompts(prompts, cand)


@query("w07_review_signals", f"""WITH {t.FRAMES_SQL}, a AS (SELECT episode_index, frame_index, a1 AS area, lag(a1) OVER (PARTITION BY episode_index ORDER BY frame_index) AS p FROM frames)
  SELECT episode_index, frame_index, CASE WHEN area = 0 THEN 'empty_mask' WHEN area = 99 THEN 'full_frame_mask' ELSE 'abrupt_area_change' END AS reason
  FROM a WHERE area = 0 OR area = 99 OR abs(area - p) > greatest(area, p)*0.5""")
def w07(spark, sf):
    areas = t.frames(spark, sf).select(*EP, "frame_index", F.get("action", F.lit(1)).alias("area"))
    return masks.review_signals(areas, EP, 99.0).drop("dataset_id")


# the greedy rule as a recursion: the tracks of a nation in order, with the ends of those accepted so far
_LATE = f"""{_CAND.replace("cand AS", "RECURSIVE cand AS", 1)}, g AS (SELECT c_nationkey AS group_id, candidate_id AS track_id, start, "end", target = 'protect' AS initial FROM cand JOIN customer ON c_custkey = object_id),
  ini AS (SELECT group_id, start, "end" FROM g WHERE initial),
  seq AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY start, track_id) AS k FROM g WHERE NOT initial),
  pos AS (SELECT group_id, k, start AS p FROM seq UNION SELECT s.group_id, s.k, i.start FROM seq s JOIN ini i ON i.group_id = s.group_id AND i.start > s.start AND i.start <= s."end"),
  cov AS (SELECT pos.group_id, pos.k, pos.p, (SELECT count(*) FROM ini i WHERE i.group_id = pos.group_id AND i.start <= pos.p AND i."end" >= pos.p) AS c FROM pos),
  lst AS (SELECT group_id, k, list({{'p': p, 'c': c}}) AS pts FROM cov GROUP BY ALL),
  ord AS (SELECT s.*, pts FROM seq s JOIN lst USING (group_id, k)),
  step AS (SELECT group_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS track_id, CAST(NULL AS BIGINT) AS first, true AS ok, CAST([] AS BIGINT[]) AS ends FROM (SELECT DISTINCT group_id FROM seq)
   UNION ALL SELECT group_id, k, track_id, start, ok, CASE WHEN ok THEN list_append(open, e) ELSE open END FROM (
     SELECT o.group_id, o.k, o.track_id, o.start, CAST(o."end" AS BIGINT) AS e, list_filter(s.ends, lambda q: q >= o.start) AS open,
      len(list_filter(o.pts, lambda x: x.c + len(list_filter(s.ends, lambda q: q >= x.p)) >= 12)) = 0 AS ok
     FROM step s JOIN ord o ON o.group_id = s.group_id AND o.k = s.k + 1))"""


@query("a27_late_tracks", f"""WITH {_LATE} SELECT CAST(group_id AS BIGINT) AS group_id, track_id, first AS first_visible_frame, ok AS accepted, ok AS reentry FROM step WHERE track_id IS NOT NULL""")
def a27(spark, sf):
    """Customers of a nation compete for slots while their orders are open."""
    cand, ranges = _candidates(spark, sf)
    nation = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("object_id"), F.col("c_nationkey").cast("bigint").alias("group_id"))
    rows = ranges.join(cand, "candidate_id").join(nation, "object_id")
    # an order is one track of its nation
    return masks.late_tracks(rows.select("group_id", F.col("candidate_id").alias("track_id"), "start", "end",
                                         (F.col("target") == "protect").alias("initial"), F.lit(12).alias("capacity")))
