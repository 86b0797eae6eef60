"""Insight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import insights as ins
from episodica.operators import series
from episodica.plans import tables as t
from episodica.plans.registry import query, r

# Orders per customer as episodes: their count is the length.
_LEN = """secs AS (SELECT o_custkey AS episode_index, count(*) AS length, floor(count(*)/10.0*100+0.5)/100 AS seconds FROM orders GROUP BY 1)"""
_LAYOUT = f"""{_LEN}, srt AS (SELECT seconds, row_number() OVER (ORDER BY seconds) - 1 AS rn, count(*) OVER () AS n FROM secs),
mu AS (SELECT floor(sum(seconds)/count(*)*100+0.5)/100 AS mean FROM secs),
facts AS (SELECT any_value(n) AS episodes, any_value(mean) AS mean,
  CASE WHEN any_value(n) % 2 = 0 THEN floor((max(CASE WHEN rn = n//2 - 1 THEN seconds END) + max(CASE WHEN rn = n//2 THEN seconds END))/2*100+0.5)/100
    ELSE max(CASE WHEN rn = n//2 THEN seconds END) END AS median,
  floor(sqrt(sum((seconds-mean)*(seconds-mean))/count(*))*100+0.5)/100 AS std, min(seconds) AS shortest, max(seconds) AS longest,
  max(CASE WHEN rn = CAST(floor(n*0.01) AS BIGINT) THEN seconds END) AS p1,
  max(CASE WHEN rn = CAST(ceil(n*0.99) AS BIGINT) - 1 THEN seconds END) AS p99 FROM srt, mu),
raw AS (SELECT *, (CASE WHEN p99 = p1 THEN 1.0 ELSE p99 - p1 END) / greatest(10, least(50, ceil(log2(episodes) + 1))) AS rw FROM facts),
nice AS (SELECT *, coalesce((SELECT min(s * pow(10.0, floor(log10(rw)))) FROM (VALUES (1.0),(2.0),(2.5),(5.0),(10.0)) v(s)
  WHERE s * pow(10.0, floor(log10(rw))) >= rw), rw) AS bin_width FROM raw),
layout AS (SELECT *, floor(p1/bin_width)*bin_width AS bin_start,
  CAST(greatest(1, floor((ceil(p99/bin_width)*bin_width - floor(p1/bin_width)*bin_width)/bin_width + 0.5)) AS BIGINT) AS bins FROM nice)"""


def _customers(spark, sf):
    return t.table(spark, sf, "orders").groupBy(
        F.lit("orders").alias("dataset_id"), F.col("o_custkey").alias("episode_index")).agg(F.count("*").alias("length"))


@query("a10_length_summary", f"""WITH {_LAYOUT} SELECT episodes, mean, median, std, shortest, longest, p1, p99, round(bin_start,6) AS bin_start,
  round(bin_width,6) AS bin_width, bins FROM layout""")
def a10_summary(spark, sf):
    s = ins.length_summary(_customers(spark, sf), 10.0)
    return s.select("episodes", "mean", "median", "std", "shortest", "longest", "p1", "p99", *r("bin_start", "bin_width"), "bins")


@query("a10_length_histogram", f"""WITH {_LAYOUT}, b AS (SELECT unnest(range(bins)) AS bin, bin_start, bin_width, bins FROM layout),
  c AS (SELECT least(greatest(CAST(floor((seconds-bin_start)/bin_width) AS BIGINT),0),bins-1) AS bin, count(*) AS episodes FROM secs, layout GROUP BY 1)
  SELECT b.bin, round(bin_start + b.bin*bin_width,6) AS low, round(bin_start + b.bin*bin_width + bin_width,6) AS high, coalesce(episodes,0) AS episodes
  FROM b LEFT JOIN c USING (bin)""")
def a10_histogram(spark, sf):
    return ins.length_histogram(_customers(spark, sf), 10.0).select("bin", *r("low", "high"), "episodes")


@query("t02_shortest_episodes", f"WITH {_LEN} SELECT episode_index, length, seconds FROM secs ORDER BY seconds, episode_index LIMIT 5")
def t02_short(spark, sf):
    return ins.shortest(_customers(spark, sf), 10.0).select("episode_index", "length", "seconds")


@query("t02_longest_episodes", f"WITH {_LEN} SELECT episode_index, length, seconds FROM secs ORDER BY seconds DESC, episode_index DESC LIMIT 5")
def t02_long(spark, sf):
    return ins.longest(_customers(spark, sf), 10.0).select("episode_index", "length", "seconds")


@query("p08_length_filter", f"WITH {_LEN} SELECT episode_index, seconds FROM secs WHERE seconds < 0.5 OR seconds > 1.5")
def p08(spark, sf):
    return ins.length_outliers(_customers(spark, sf), 10.0, 0.5, 1.5).select("episode_index", "seconds")


@query("a11_cross_episode_variance", f"""WITH {t.FRAMES_SQL}, p AS (SELECT DISTINCT episode_index, n, b.bin,
  least(CAST(floor(b.bin/49.0*(n-1)+0.5) AS BIGINT), n-1) AS frame_index FROM frames, (SELECT unnest(range(50)) AS bin) b)
  SELECT CAST(bin AS INTEGER) AS bin, dim, round(var_pop(value),6) AS variance FROM p JOIN vals USING (episode_index, frame_index) GROUP BY ALL""")
def a11(spark, sf):
    return ins.cross_variance(t.frames(spark, sf)).select("bin", "dim", *r("variance"))


_MOVE = """steps AS (SELECT episode_index, frame_index, sqrt(sum(delta*delta)) AS step FROM deltas GROUP BY ALL),
movement AS (SELECT f.episode_index, coalesce(floor(avg(step)*10000+0.5)/10000, 0) AS movement
  FROM (SELECT DISTINCT episode_index FROM frames) f LEFT JOIN steps USING (episode_index) GROUP BY 1)"""


@query("a12_movement", f"WITH {t.FRAMES_SQL}, {_MOVE} SELECT episode_index, round(movement,4) AS movement FROM movement")
def a12(spark, sf):
    return ins.movement(t.frames(spark, sf)).select("episode_index", *r("movement", digits=4))


@query("t03_lowest_movement", f"WITH {t.FRAMES_SQL}, {_MOVE} SELECT episode_index, round(movement,4) AS movement FROM movement ORDER BY movement.movement, episode_index LIMIT 10")
def t03(spark, sf):
    return ins.lowest_movement(ins.movement(t.frames(spark, sf))).select("episode_index", *r("movement", digits=4))


_RANGES = """ranges AS (SELECT dim, CASE WHEN max(value) = min(value) THEN 1.0 ELSE max(value)-min(value) END AS motor_range,
  count(DISTINCT value) <= 4 AS discrete FROM vals GROUP BY 1)"""
_ACTIVE = f"""{_RANGES}, act AS (SELECT episode_index, dim, any_value(motor_range) AS motor_range, any_value(discrete) AS discrete, count(*) AS m,
  sum(abs(delta)) AS sum_abs, list_sort(list(abs(delta)))[CAST(floor(count(*)*0.95) AS BIGINT) + 1] >= any_value(motor_range)*0.001 AS active
  FROM deltas JOIN ranges USING (dim) GROUP BY ALL)"""
_VELO = f"""{_ACTIVE}, flags AS (SELECT dim, bool_or(active) AS any_active FROM act GROUP BY 1),
used AS (SELECT d.*, a.motor_range, a.discrete, f.any_active FROM deltas d JOIN act a USING (episode_index, dim) JOIN flags f USING (dim)
  WHERE a.active OR NOT f.any_active),
velo AS (SELECT dim, stddev_pop(delta)/any_value(motor_range) AS std, max(abs(delta))/any_value(motor_range) AS max_abs,
  min(delta)/any_value(motor_range) AS lo, max(delta)/any_value(motor_range) AS hi, any_value(motor_range) AS motor_range,
  NOT any_value(any_active) AS inactive, any_value(discrete) AS discrete FROM used GROUP BY 1)"""


@query("a13_motor_ranges", f"WITH {t.FRAMES_SQL}, {_RANGES} SELECT dim, round(motor_range,6) AS motor_range, discrete FROM ranges")
def a13(spark, sf):
    return ins.motor_ranges(t.frames(spark, sf)).select("dim", *r("motor_range"), "discrete")


@query("a13_motor_ranges_discrete", """WITH p AS (SELECT 0 AS dim, l_tax AS v FROM lineitem UNION ALL SELECT 1, CAST(ascii(l_returnflag) AS DOUBLE) FROM lineitem
  UNION ALL SELECT 2, CAST(ascii(l_linestatus) AS DOUBLE) FROM lineitem UNION ALL SELECT 3, l_quantity FROM lineitem)
  SELECT dim, round(CASE WHEN max(v)=min(v) THEN 1.0 ELSE max(v)-min(v) END,6) AS motor_range, count(DISTINCT v) <= 4 AS discrete FROM p GROUP BY 1""")
def a13_discrete(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(
        F.lit("lineitem").alias("dataset_id"), F.col("l_orderkey").alias("episode_index"), F.col("l_linenumber").alias("frame_index"),
        F.array("l_tax", F.ascii("l_returnflag").cast("double"), F.ascii("l_linestatus").cast("double"), "l_quantity").alias("action"))
    return ins.motor_ranges(rows).select("dim", *r("motor_range"), "discrete")


@query("a14_activity", f"WITH {t.FRAMES_SQL}, {_ACTIVE} SELECT episode_index, dim, m, active FROM act")
def a14(spark, sf):
    return ins.episode_deltas(t.frames(spark, sf)).select("episode_index", "dim", "m", "active")


@query("a15_velocity", f"""WITH {t.FRAMES_SQL}, {_VELO} SELECT dim, round(std,6) AS std, round(max_abs,6) AS max_abs, round(lo,6) AS lo, round(hi,6) AS hi,
  round(motor_range,6) AS motor_range, inactive, discrete FROM velo""")
def a15(spark, sf):
    return ins.velocity(t.frames(spark, sf)).select("dim", *r("std", "max_abs", "lo", "hi", "motor_range"), "inactive", "discrete")


@query("a15_velocity_histogram", f"""WITH {t.FRAMES_SQL}, {_VELO} SELECT u.dim,
  least(CAST(floor((u.delta/v.motor_range - v.lo)/((CASE WHEN v.hi=v.lo THEN 1.0 ELSE v.hi-v.lo END)/30)) AS BIGINT), 29) AS bin, count(*) AS deltas
  FROM used u JOIN velo v USING (dim) GROUP BY ALL""")
def a15_hist(spark, sf):
    return ins.velocity_histogram(t.frames(spark, sf))


@query("a16_velocity_verdict", f"""WITH {t.FRAMES_SQL}, {_VELO}, named AS (SELECT *, CASE dim WHEN 0 THEN 'value' ELSE 'gripper_k' END AS name FROM velo),
  top AS (SELECT max(CASE WHEN NOT inactive AND NOT discrete THEN std END) AS top FROM named),
  c AS (SELECT *, NOT inactive AND NOT discrete AS ok, std/top AS share, regexp_matches(lower(name),'grip') AS grip FROM named, top),
  f AS (SELECT count(*) FILTER (ok) AS active, count(*) FILTER (ok AND share < 0.4) AS smooth, count(*) FILTER (ok AND share >= 0.4 AND share < 0.7) AS moderate,
   count(*) FILTER (ok AND share >= 0.7 AND NOT grip) AS jerky, count(*) FILTER (ok AND share >= 0.7 AND grip) AS jerky_grippers,
   count(*) FILTER (NOT ok) AS excluded FROM c)
  SELECT *, CASE WHEN active = 0 THEN 'N/A' WHEN smooth/active >= 0.6 AND jerky = 0 THEN 'Smooth' WHEN jerky <= 2 AND smooth/active >= 0.3 THEN 'Moderate'
   ELSE 'Jerky' END AS verdict FROM f""")
def a16(spark, sf):
    names = spark.createDataFrame([(0, "value"), (1, "gripper_k")], "dim int, name string")
    return ins.velocity_verdict(ins.velocity(t.frames(spark, sf)), names)


_ACF = f"""lags AS (SELECT least(100, min(n)//2) AS top FROM frames),
cen AS (SELECT episode_index, dim, frame_index, value - avg(value) OVER (PARTITION BY episode_index, dim) AS c FROM vals),
en AS (SELECT episode_index, dim, sum(c*c) AS e FROM cen GROUP BY ALL),
prod AS (SELECT x.episode_index, x.dim, l.lag, sum(x.c*y.c) AS s FROM cen x, (SELECT unnest(range(1, top+1)) AS lag FROM lags) l, cen y
  WHERE y.episode_index = x.episode_index AND y.dim = x.dim AND y.frame_index = x.frame_index + l.lag GROUP BY ALL),
acf AS (SELECT dim, CAST(lag AS INTEGER) AS lag, avg(CASE WHEN e = 0 THEN 0 ELSE s/e END) AS acf FROM prod JOIN en USING (episode_index, dim) GROUP BY ALL)"""


@query("a17_autocorrelation", f"WITH {t.FRAMES_SQL}, {_ACF} SELECT dim, lag, round(acf,6) AS acf FROM acf")
def a17(spark, sf):
    return ins.autocorrelation(t.frames(spark, sf)).select("dim", "lag", *r("acf"))


@query("a17_suggested_chunk", f"""WITH {t.FRAMES_SQL}, {_ACF}, f AS (SELECT dim, min(lag) AS lag FROM acf WHERE acf < 0.5 GROUP BY 1)
  SELECT list_sort(list(lag))[count(*)//2 + 1] AS suggested_chunk FROM f""")
def a17_chunk(spark, sf):
    return ins.suggested_chunk(ins.autocorrelation(t.frames(spark, sf)))


_JERK = f"""{_ACTIVE}, jerk AS (SELECT episode_index, coalesce(sum(sum_abs/motor_range) FILTER (active) / sum(m) FILTER (active), 0) AS jerkiness FROM act GROUP BY 1)"""


@query("a18_jerkiness", f"WITH {t.FRAMES_SQL}, {_JERK} SELECT episode_index, round(jerkiness,8) AS jerkiness FROM jerk")
def a18(spark, sf):
    return ins.jerkiness(t.frames(spark, sf)).select("episode_index", *r("jerkiness", digits=8))


@query("t04_most_jerky", f"WITH {t.FRAMES_SQL}, {_JERK} SELECT episode_index, round(jerkiness,8) AS jerkiness FROM jerk ORDER BY jerk.jerkiness DESC, episode_index LIMIT 15")
def t04(spark, sf):
    return ins.most_jerky(ins.jerkiness(t.frames(spark, sf))).select("episode_index", *r("jerkiness", digits=8))


_SPEED = f"""{_MOVE}, sp AS (SELECT count(*) AS episodes, avg(movement) AS mean, stddev_pop(movement) AS std, min(movement) AS lo, max(movement) AS hi,
  list_sort(list(movement))[count(*)//2 + 1] AS median, CAST(least(30, ceil(sqrt(count(*)))) AS BIGINT) AS bins FROM movement),
speed AS (SELECT *, CASE WHEN mean > 0 THEN std/mean ELSE 0 END AS cv, (CASE WHEN hi = lo THEN 1.0 ELSE hi-lo END)/bins AS bin_width FROM sp WHERE episodes >= 3)"""


@query("a19_speed_summary", f"""WITH {t.FRAMES_SQL}, {_SPEED} SELECT episodes, round(mean,6) AS mean, round(std,6) AS std, round(median,4) AS median, round(cv,6) AS cv,
  bins, round(bin_width,6) AS bin_width, CASE WHEN cv < 0.2 THEN 'Consistent' WHEN cv < 0.4 THEN 'Moderate variance' ELSE 'High variance' END AS verdict FROM speed""")
def a19(spark, sf):
    s = ins.speed_summary(ins.movement(t.frames(spark, sf)))
    return s.select("episodes", *r("mean", "std"), *r("median", digits=4), *r("cv"), "bins", *r("bin_width"), "verdict")


@query("a19_speed_histogram", f"""WITH {t.FRAMES_SQL}, {_SPEED} SELECT least(CAST(floor((movement.movement - lo)/bin_width) AS BIGINT), bins-1) AS bin, count(*) AS episodes
  FROM movement, speed GROUP BY 1""")
def a19_hist(spark, sf):
    return ins.speed_histogram(ins.movement(t.frames(spark, sf)))


_ALIGN = """dm AS (SELECT episode_index, dim, frame_index, delta - avg(delta) OVER w AS a, sdelta - avg(sdelta) OVER w AS s
  FROM deltas WHERE n >= 10 WINDOW w AS (PARTITION BY episode_index, dim)),
px AS (SELECT x.episode_index, x.dim, l.lag, sum(x.a*y.s) AS xy, sum(x.a*x.a) AS xx, sum(y.s*y.s) AS yy
  FROM dm x, (SELECT unnest(range(-30, 31)) AS lag) l, dm y
  WHERE y.episode_index = x.episode_index AND y.dim = x.dim AND y.frame_index = x.frame_index + l.lag GROUP BY ALL),
corr AS (SELECT dim AS pair, CAST(lag AS INTEGER) AS lag, coalesce(avg(CASE WHEN xx*yy > 0 THEN xy/sqrt(xx*yy) END),0) AS c FROM px GROUP BY ALL),
prof AS (SELECT lag, max(c) AS mx, avg(c) AS me, min(c) AS mi FROM corr GROUP BY 1)"""


@query("a20_alignment", f"WITH {t.FRAMES_SQL}, {_ALIGN} SELECT pair, lag, round(c,6) AS corr FROM corr")
def a20(spark, sf):
    return ins.alignment(t.frames(spark, sf)).select("pair", "lag", *r("corr"))


@query("a20_alignment_peaks", f"""WITH {t.FRAMES_SQL}, {_ALIGN}, own AS (SELECT pair, arg_max(lag, c) AS l FROM corr GROUP BY 1)
  SELECT (SELECT arg_max(lag, mx) FROM prof) AS max_peak_lag, (SELECT arg_max(lag, me) FROM prof) AS mean_peak_lag,
  (SELECT arg_max(lag, mi) FROM prof) AS min_peak_lag, round((SELECT max(mx) FROM prof),6) AS max_peak_corr,
  round((SELECT max(me) FROM prof),6) AS mean_peak_corr, round((SELECT max(mi) FROM prof),6) AS min_peak_corr,
  (SELECT min(l) FROM own) AS lag_range_min, (SELECT max(l) FROM own) AS lag_range_max, (SELECT count(*) FROM own) AS pairs""")
def a20_peaks(spark, sf):
    p = ins.alignment_peaks(ins.alignment(t.frames(spark, sf)))
    return p.select("max_peak_lag", "mean_peak_lag", "min_peak_lag", *r("max_peak_corr", "mean_peak_corr", "min_peak_corr"),
                    "lag_range_min", "lag_range_max", "pairs")


@query("j11_alignment_by_name", f"""WITH {t.FRAMES_SQL}, dm AS (SELECT episode_index, dim, frame_index, delta - avg(delta) OVER w AS a, sdelta - avg(sdelta) OVER w AS s FROM deltas WHERE n >= 10 WINDOW w AS (PARTITION BY episode_index, dim)),
  px AS (SELECT x.episode_index, x.dim, l.lag, sum(x.a*y.s) AS xy, sum(x.a*x.a) AS xx, sum(y.s*y.s) AS yy FROM dm x, (SELECT unnest(range(-10, 11)) AS lag) l, dm y
  WHERE y.episode_index = x.episode_index AND y.dim = 1 - x.dim AND y.frame_index = x.frame_index + l.lag GROUP BY ALL)
  SELECT dim AS pair, CAST(lag AS INTEGER) AS lag, round(coalesce(avg(CASE WHEN xx*yy > 0 THEN xy/sqrt(xx*yy) END),0),6) AS corr FROM px GROUP BY ALL""")
def j11(spark, sf):
    """State names in the other order, so elements are paired crosswise."""
    pairs = ins.pair_by_name(["value", "k"], ["k", "value"])
    return ins.alignment(t.frames(spark, sf), max_lag=10, pairs=pairs).select("pair", "lag", *r("corr"))


@query("j10_lag_products", f"""WITH {t.FRAMES_SQL}, c AS (SELECT episode_index, n, dim, frame_index, value - avg(value) OVER (PARTITION BY episode_index, dim) AS c FROM vals), e AS (SELECT episode_index, dim, sum(c*c) AS e FROM c GROUP BY ALL)
  SELECT x.episode_index, x.dim, CAST(l.lag AS INTEGER) AS lag, round(sum(x.c*y.c)/any_value(e),6) AS acf FROM c x, (SELECT unnest(range(1, 101)) AS lag) l, c y, e
  WHERE l.lag <= x.n//2 AND y.episode_index = x.episode_index AND y.dim = x.dim AND y.frame_index = x.frame_index + l.lag AND e.episode_index = x.episode_index AND e.dim = x.dim GROUP BY x.episode_index, x.dim, l.lag""")
def j10(spark, sf):
    return ins.episode_autocorrelation(t.frames(spark, sf)).select("episode_index", "dim", "lag", *r("acf"))


@query("a20_episode_alignment", f"""WITH {t.FRAMES_SQL}, {_ALIGN} SELECT px.episode_index, dim AS pair, CAST(lag AS INTEGER) AS lag, round(CASE WHEN xx*yy > 0 THEN xy/sqrt(xx*yy) ELSE 0 END,6) AS corr
  FROM px JOIN (SELECT DISTINCT episode_index, n FROM frames) USING (episode_index) WHERE abs(lag) <= least(30, n//4)""")
def a20_episode(spark, sf):
    return ins.episode_alignment(t.frames(spark, sf)).select("episode_index", "pair", "lag", *r("corr"))


@query("a22_scale_groups")
def a22(spark, sf):
    """Charts of part prices and sizes per type; the greedy grouping is checked by brute force in the tests."""
    part = t.table(spark, sf, "part")
    size = part.select(F.concat(F.lit("size | "), "p_type").alias("series"), F.col("p_size").cast("double").alias("value"))
    price = part.select(F.concat(F.lit("price | "), "p_brand").alias("series"), F.col("p_retailprice").alias("value"))
    both = size.unionByName(price)
    return ins.scale_groups(both.withColumn("ord", F.xxhash64("series")))


@query("a29_joint_radians", f"""WITH {t.FRAMES_SQL}, u AS (SELECT episode_index, frame_index, s0, s1, greatest(abs(s0),abs(s1)) AS top FROM frames),
  k AS (SELECT *, CASE WHEN top > 360 THEN 'ticks' WHEN top > 6.3 THEN 'degrees' ELSE 'radians' END AS unit FROM u)
  SELECT episode_index, frame_index, unit,
  round(CASE unit WHEN 'ticks' THEN (s0-2048)/2048*pi() WHEN 'degrees' THEN radians(s0) ELSE s0 END,8) AS joint0,
  round(CASE unit WHEN 'ticks' THEN (s1-2048)/2048*pi() WHEN 'degrees' THEN radians(s1) ELSE s1 END,8) AS joint1 FROM k""")
def a29(spark, sf):
    x = ins.joint_radians(t.frames(spark, sf))
    return x.select("episode_index", "frame_index", "unit", F.round(F.get("radians", F.lit(0)), 8).alias("joint0"),
                    F.round(F.get("radians", F.lit(1)), 8).alias("joint1"))


@query("a29_gripper_opening", f"""WITH {t.FRAMES_SQL}, g AS (SELECT episode_index, min(s1) AS lo, max(s1) AS hi FROM frames GROUP BY 1)
  SELECT episode_index, frame_index, round(CASE WHEN hi > lo THEN (s1-lo)/(hi-lo)*0.044 ELSE s1/100*0.044 END, 8) AS opening FROM frames JOIN g USING (episode_index)""")
def a29_gripper(spark, sf):
    return ins.gripper_opening(t.frames(spark, sf), "state", 1).select("episode_index", "frame_index", *r("opening", digits=8))


@query("c16_insight_report", f"""WITH {t.FRAMES_SQL}, {_MOVE}, {_JERK}, l AS (SELECT episode_index, count(*) AS length FROM frames GROUP BY 1),
  c AS (SELECT episode_index, count(*) FILTER (active) AS active_dims FROM act GROUP BY 1)
  SELECT l.episode_index, length, round(movement.movement,4) AS movement, round(jerk.jerkiness,8) AS jerkiness, coalesce(active_dims,0) AS active_dims
  FROM l JOIN movement USING (episode_index) LEFT JOIN jerk USING (episode_index) LEFT JOIN c USING (episode_index)""")
def c16(spark, sf):
    x = ins.insight_report(t.frames(spark, sf))
    return x.select("episode_index", "length", *r("movement", digits=4), *r("jerkiness", digits=8), "active_dims")
