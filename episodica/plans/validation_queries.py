"""Validation queries. Natural defects of the tables stand for damaged recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import series, stats
from episodica.operators import validate as v
from episodica.plans import tables as t
from episodica.plans.registry import query

EP = series.EPISODE

# A customer is an episode, its orders are frames numbered by date, but stored by order key.
_ORD = """of AS (SELECT o_custkey AS e, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS fi, row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) - 1 AS idx,
  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 1000.0::DOUBLE AS ts, o_totalprice AS price, CAST(left(o_orderpriority,1) AS DOUBLE) AS prio FROM orders),
le AS (SELECT e, count(*) AS length, min(k) AS k0 FROM of GROUP BY 1)"""


def order_frames(spark, sf):
    def build():
        raw = t.table(spark, sf, "orders")
        rows = raw.select(
            F.lit("orders").alias("dataset_id"), F.col("o_custkey").alias("episode_index"), "o_orderkey", "o_orderdate",
            (F.datediff("o_orderdate", F.lit("1992-01-01")) / 1000.0).alias("timestamp"),
            F.array("o_totalprice", F.left("o_orderpriority", F.lit(1)).cast("double")).alias("action"),
            F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return series.with_position(rows, EP, ["o_orderdate", "o_orderkey"], "frame_index", whole="index").drop("o_orderdate")
    return t.once(spark, sf, "order_frames", build)


def placed(spark, sf):
    return t.once(spark, sf, "order_frames_placed", lambda: v.with_storage_position(order_frames(spark, sf)))


def _codes(found):
    return found.select("severity", "code", "episode_index")


@query("v05_index_issues", f"""WITH {_ORD}, o AS (SELECT *, sum(length) OVER (ORDER BY e) - length AS start FROM le)
  SELECT 'FAIL' AS severity, 'frame_index_mismatch' AS code, e AS episode_index FROM of GROUP BY e HAVING bool_or(fi <> pos)
  UNION ALL SELECT 'FAIL', 'global_index_mismatch', of.e FROM of JOIN o ON o.e = of.e GROUP BY of.e HAVING bool_or(idx <> start + pos)""")
def v05(spark, sf):
    return _codes(v.index_issues(placed(spark, sf)))


@query("v08_timestamp_issues", f"""WITH {_ORD}, s AS (SELECT *, lag(ts) OVER (PARTITION BY e ORDER BY pos) AS p FROM of)
  SELECT 'FAIL' AS severity, 'timestamp_regression' AS code, e AS episode_index FROM s GROUP BY e HAVING bool_or(ts <= p)
  UNION ALL SELECT 'FAIL', 'timestamp_alignment', e FROM s GROUP BY e HAVING max(abs(ts - pos/10.0::DOUBLE)) > 0.001""")
def v08(spark, sf):
    return _codes(v.timestamp_issues(placed(spark, sf), 10.0))


@query("v10_motion_warnings", f"""WITH {_ORD}, s AS (SELECT *, price - lag(price) OVER (PARTITION BY e ORDER BY pos) AS d1, prio - lag(prio) OVER (PARTITION BY e ORDER BY pos) AS d2 FROM of)
  SELECT 'WARN' AS severity, 'constant_sensor' AS code, e AS episode_index FROM s GROUP BY e HAVING count(*) > 2 AND (max(prio) = min(prio) OR max(price) = min(price))
  UNION ALL SELECT 'WARN', 'action_jump', e FROM s GROUP BY e HAVING count(*) > 2 AND max(greatest(abs(d1), abs(d2))) > 300000""")
def v10(spark, sf):
    return _codes(v.motion_issues(placed(spark, sf), ["action"], jump=300_000.0))


@query("v11_total_issues", f"""WITH {_ORD}, m AS (SELECT greatest(2, floor(median(length)*5)) AS lim, max(length) AS top, sum(length) AS n FROM le)
  SELECT 'FAIL' AS severity, 'frame_total_mismatch' AS code, CAST(NULL AS BIGINT) AS episode_index FROM m WHERE n <> (SELECT count(*) FROM lineitem)
  UNION ALL SELECT 'WARN', 'abnormal_episode_length', NULL FROM m WHERE top > lim""")
def v11(spark, sf):
    header = t.table(spark, sf, "lineitem").agg(F.count("*").alias("total_frames")).withColumn("dataset_id", F.lit("orders"))
    return _codes(v.total_issues(order_frames(spark, sf), header))


@query("v07_length_issues", f"""WITH {_ORD}, w AS (SELECT c_custkey AS e, c_nationkey + 1 AS length FROM customer)
  SELECT 'FAIL' AS severity, 'empty_episode' AS code, e AS episode_index FROM w WHERE e NOT IN (SELECT e FROM le)
  UNION ALL SELECT 'FAIL', 'episode_metadata_mismatch', w.e FROM w JOIN le USING (e) WHERE w.length <> le.length""")
def v07(spark, sf):
    declared = t.table(spark, sf, "customer").select(F.lit("orders").alias("dataset_id"), F.col("c_custkey").alias("episode_index"), (F.col("c_nationkey") + 1).cast("bigint").alias("length"))
    return _codes(v.length_issues(order_frames(spark, sf), declared))


@query("v07_offset_issues", f"""WITH {_ORD}, o AS (SELECT *, sum(length) OVER (ORDER BY e) - length AS start FROM le), c AS (SELECT *, sum(length) OVER (ORDER BY e) - length AS a,
  sum(length) OVER (ORDER BY e) AS b FROM (SELECT e, CASE WHEN e >= 700 THEN length + 1 ELSE length END AS length FROM le))
  SELECT 'FAIL' AS severity, 'invalid_episode_offsets' AS code, o.e AS episode_index FROM o JOIN c USING (e) WHERE b - a <> o.length OR a <> start
  UNION ALL SELECT 'FAIL', 'episode_metadata_mismatch', c.e FROM c JOIN le USING (e) WHERE c.length <> le.length""")
def v07_offsets(spark, sf):
    lengths = series.episode_lengths(order_frames(spark, sf)).withColumn("length", F.col("length") + F.when(F.col("episode_index") >= 700, 1).otherwise(0))
    return _codes(v.length_issues(order_frames(spark, sf), series.with_offsets(lengths)))


@query("v06_task_issues", f"""WITH {t.FRAMES_SQL}, u AS (SELECT DISTINCT episode_index, event_type FROM frames), lab AS (SELECT episode_index, max(event_type) AS top, count(*) AS n FROM u GROUP BY 1)
  SELECT 'FAIL' AS severity, 'task_reference_invalid' AS code, episode_index FROM u WHERE event_type = 'view'
  UNION ALL SELECT 'FAIL', 'task_reference_invalid', episode_index FROM lab WHERE n > 0 AND (top = 'view' OR n < 5)""")
def v06(spark, sf):
    """The task 'view' is unknown and every episode claims the four other tasks."""
    known = t.tasks(spark, sf).filter("task <> 'view'")
    declared = t.episodes(spark, sf).select(*EP, F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup")]).alias("tasks"))
    return _codes(v.task_issues(t.frames(spark, sf), declared, known))


@query("v09_feature_issues", """WITH l AS (SELECT l_orderkey AS e, l_discount AS d, l_tax AS x, l_linestatus AS s FROM lineitem)
  SELECT 'FAIL' AS severity, 'feature_non_finite' AS code, e AS episode_index, 'inverse' AS feature, count(*) AS bad FROM l WHERE d = 0 GROUP BY e
  UNION ALL SELECT 'FAIL', 'feature_shape_mismatch', e, 'pair', count(*) FROM l WHERE s = 'F' GROUP BY e
  UNION ALL SELECT 'FAIL', 'feature_dtype_mismatch', e, 'count', count(*) FROM l GROUP BY e""")
def v09(spark, sf):
    raw = t.table(spark, sf, "lineitem")
    rows = raw.select(
        F.lit("lineitem").alias("dataset_id"), F.col("l_orderkey").alias("episode_index"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"),
        F.array(F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(1.0 / F.col("l_discount"))).alias("inverse"),
        F.when(F.col("l_linestatus") == "F", F.array("l_tax")).otherwise(F.array("l_tax", "l_discount")).alias("pair"), F.col("l_quantity").alias("count"))
    declared = spark.createDataFrame([("inverse", "float64", [1]), ("pair", "float64", [2]), ("count", "int64", [1])], "feature string, dtype string, shape array<int>").collect()
    found = v.feature_issues(v.with_storage_position(rows), declared)
    return found.select("severity", "code", "episode_index", "feature", F.regexp_extract("detail", r"^(\d+)", 1).cast("bigint").alias("bad"))


@query("v04_column_issues", """SELECT 'FAIL' AS severity, 'numeric_data_invalid' AS code, user_id AS episode_index, 'task_index' AS feature FROM events GROUP BY user_id
  UNION ALL SELECT 'FAIL', 'missing_required_column', user_id, 'index' FROM events GROUP BY user_id""")
def v04(spark, sf):
    damaged = t.frames(spark, sf).withColumn("task_index", F.col("task_index") + 0.25).drop("index")
    return v.column_issues(damaged, t.episodes(spark, sf)).select("severity", "code", "episode_index", "feature")


# nations as data sets
_NAT = """h AS (SELECT n_nationkey, n_name AS dataset_id, CASE n_regionkey WHEN 0 THEN 'v1.6' WHEN 1 THEN 'v2.1' ELSE 'v3.0' END AS version, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9500) AS total_episodes,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS total_tasks FROM nation)"""


def nation_headers(spark, sf):
    def count(name, key, condition):
        return t.table(spark, sf, name).filter(condition).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias("_c"))
    nation = t.table(spark, sf, "nation")
    rows = nation.join(count("customer", "c_nationkey", "c_acctbal > 9500").withColumnRenamed("_c", "_e"), "n_nationkey", "left").join(
        count("supplier", "s_nationkey", "s_acctbal > 5000").withColumnRenamed("_c", "_t"), "n_nationkey", "left")
    version = F.when(F.col("n_regionkey") == 0, "v1.6").when(F.col("n_regionkey") == 1, "v2.1").otherwise("v3.0")
    return rows.select(F.col("n_name").alias("dataset_id"), version.alias("codebase_version"), F.lit(10.0).alias("fps"), F.coalesce("_e", F.lit(0)).alias("total_episodes"),
                       F.lit(100).cast("bigint").alias("total_frames"), F.coalesce("_t", F.lit(0)).alias("total_tasks"), "n_nationkey")


@query("v01_header_issues", f"""WITH {_NAT} SELECT dataset_id, 'codebase_version' AS detail, CAST(NULL AS VARCHAR) AS feature FROM h WHERE version = 'v1.6'
  UNION ALL SELECT dataset_id, 'total_episodes', NULL FROM h WHERE total_episodes < 1 UNION ALL SELECT dataset_id, 'total_tasks', NULL FROM h WHERE total_tasks < 1
  UNION ALL SELECT dataset_id, CASE WHEN n_nationkey < 5 THEN 'shape' ELSE 'dtype' END, 'action' FROM h WHERE n_nationkey < 10
  UNION ALL SELECT dataset_id, 'missing', unnest(['timestamp','index']) FROM h""")
def v01(spark, sf):
    header = nation_headers(spark, sf)
    names = F.explode(F.array(*[F.lit(n) for n in ("action", "observation.state", "frame_index", "episode_index", "task_index")])).alias("feature")
    key, action = F.col("n_nationkey"), F.col("feature") == "action"
    features = header.select("dataset_id", "n_nationkey", names).select(
        "dataset_id", "feature", F.when(action & key.between(5, 9), "complex64").otherwise("float32").alias("dtype"),
        F.when(action & (key < 5), F.array(F.lit(0))).otherwise(F.array(F.lit(2))).alias("shape"))
    return v.header_issues(header, features).select("dataset_id", "detail", "feature")


@query("v02_split_issues", """WITH s AS (SELECT l_orderkey, l_linenumber - 1 AS a, l_linenumber AS b, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem),
  ok AS (SELECT * FROM s WHERE b <= total), p AS (SELECT l_orderkey, any_value(total) AS total, max(b) AS top, min(a) AS low, count(*) AS c, count(DISTINCT a) AS d FROM ok GROUP BY 1)
  SELECT l_orderkey AS dataset_id, 'range' AS problem FROM s WHERE b > total
  UNION ALL SELECT l_orderkey, 'gap' FROM p WHERE low > 0 OR c <> d OR top - low <> d
  UNION ALL SELECT l_orderkey, 'short' FROM p WHERE top <> total
  UNION ALL SELECT DISTINCT l_orderkey, 'short' FROM s WHERE l_orderkey NOT IN (SELECT l_orderkey FROM ok)""")
def v02(spark, sf):
    rows = t.table(spark, sf, "lineitem")
    totals = rows.groupBy("l_orderkey").agg(F.count("*").alias("total_episodes"))
    splits = rows.join(totals, "l_orderkey").select(
        F.col("l_orderkey").alias("dataset_id"), "total_episodes", F.col("l_partkey").cast("string").alias("name"),
        F.concat(F.col("l_linenumber") - 1, F.lit(":"), F.col("l_linenumber")).alias("range"))
    found = v.split_issues(splits)
    problem = F.when(F.col("detail").startswith("range "), "range").when(F.col("detail").contains("overlap"), "gap").otherwise("short")
    return found.select("dataset_id", problem.alias("problem"))


@query("v03_metadata_ids", """WITH c AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1)
  SELECT o_orderkey AS dataset_id FROM orders LEFT JOIN c ON l_orderkey = o_orderkey WHERE n IS NULL OR NOT (n = d AND lo = 1 AND hi = n) OR n <> 4""")
def v03(spark, sf):
    header = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("dataset_id"), F.lit(4).cast("bigint").alias("total_tasks"))
    ids = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("dataset_id"), (F.col("l_linenumber") - 1).alias("task_index"))
    return v.id_issues(ids, "task_index", header, "total_tasks").select("dataset_id")


@query("v03_task_texts", """SELECT DISTINCT lang AS dataset_id FROM documents WHERE length(trim(CASE WHEN n_chars < 60 THEN '  ' ELSE text END)) = 0""")
def v03_texts(spark, sf):
    tasks = t.table(spark, sf, "documents").select(F.col("lang").alias("dataset_id"), F.when(F.col("n_chars") < 60, "  ").otherwise(F.col("text")).alias("task"))
    return v.task_text_issues(tasks).select("dataset_id")


# stored statistics: the true ones, rounded to two decimals
_STORED = """tr AS (SELECT dim, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std FROM vals GROUP BY 1),
lg AS (SELECT dim, 'min' AS statistic, min AS v FROM tr UNION ALL SELECT dim, 'max', max FROM tr UNION ALL SELECT dim, 'mean', mean FROM tr UNION ALL SELECT dim, 'std', std FROM tr)"""


def stored_stats(spark, sf, digits=2):
    fresh = stats.centred_moments(series.to_values(t.frames(spark, sf), ["action"]), ["feature", "dim"])
    return v.long_stats(fresh, "events", v.COMPARED).withColumn("value", F.round("value", digits)).withColumn("depth", F.lit(1))


@query("v13_stats_mismatch", f"""WITH {t.FRAMES_SQL}, {_STORED} SELECT DISTINCT 'stats_value_mismatch' AS code, 'action' AS feature, statistic AS detail FROM lg
  WHERE abs(round(v,2) - v) > 1e-7 + 1e-5*abs(v)""")
def v13(spark, sf):
    declared = spark.createDataFrame([("events", "action", "float64", [2])], "dataset_id string, feature string, dtype string, shape array<int>")
    state = v.episode_state(t.frames(spark, sf), {"action": ("action", [2])})
    return v.stats_issues(state, stored_stats(spark, sf), declared, "events").select("code", "feature", "detail")


@query("j13_stats_outer_join", f"""WITH {t.FRAMES_SQL}, {_STORED} SELECT DISTINCT 'stats_value_mismatch' AS code, 'action' AS feature, statistic AS detail FROM lg
  WHERE statistic = 'std' OR abs(round(v,0) - v) > 1e-7 + 1e-5*abs(v) UNION SELECT 'stats_value_mismatch', 'action', 'q50'""")
def j13(spark, sf):
    """One statistic is missing on each side: std is not stored, q50 is not recomputed."""
    stored = stored_stats(spark, sf, 0)
    fresh = v.long_stats(stats.centred_moments(series.to_values(t.frames(spark, sf), ["action"]), ["feature", "dim"]), "events", v.COMPARED)
    shifted = stored.withColumn("statistic", F.when(F.col("statistic") == "std", "q50").otherwise(F.col("statistic")))
    return v.compare_stats(shifted, fresh).select("code", "feature", "detail")


@query("v12_stored_stats_schema", """WITH s AS (SELECT n_name AS f, n_nationkey AS k, n_regionkey AS g FROM nation)
  SELECT 'stats_field_missing' AS code, f AS feature FROM s WHERE g = 0 UNION ALL SELECT 'stats_value_invalid', f FROM s WHERE g = 1
  UNION ALL SELECT 'stats_count_invalid', f FROM s WHERE g = 2 UNION ALL SELECT 'stats_shape_mismatch', f FROM s WHERE g = 3
  UNION ALL SELECT 'stats_value_invalid', f FROM s WHERE g = 4""")
def v12(spark, sf):
    """Every nation is a feature; its region decides which rule its statistics break."""
    nation = t.table(spark, sf, "nation")
    balance = t.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.min("c_acctbal").alias("min"), F.max("c_acctbal").alias("max"), F.avg("c_acctbal").alias("mean"), F.stddev_pop("c_acctbal").alias("std"), F.count("*").cast("double").alias("count"))
    wide = nation.join(balance, "n_nationkey").select(F.col("n_name").alias("feature"), F.lit(0).alias("dim"), "n_regionkey", *v.COMPARED)
    rows = wide.select(F.lit("d").alias("dataset_id"), "feature", "dim", "n_regionkey", F.explode(F.array(*[
        F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in v.COMPARED])).alias("e")).select("dataset_id", "feature", "dim", "n_regionkey", "e.*")
    g, s = F.col("n_regionkey"), F.col("statistic")
    kept = rows.filter(~((g == 0) & (s == "mean")))
    value = F.when((g == 1) & (s == "max"), F.lit(float("nan"))).when((g == 2) & (s == "count"), F.col("value") + 0.5).when((g == 4) & (s == "std"), -F.col("value")).otherwise(F.col("value"))
    depth = F.when((g == 3) & (s == "min"), 2).otherwise(1)
    stored = kept.withColumn("value", value).withColumn("depth", depth)
    features = nation.select(F.lit("d").alias("dataset_id"), F.col("n_name").alias("feature"), F.lit("float32").alias("dtype"), F.array(F.lit(1)).alias("shape"))
    return v.stored_stats_issues(stored, features).select("code", "feature").distinct()


@query("v14_relative_mismatch", f"""WITH {t.FRAMES_SQL} SELECT 'relative_stats_mismatch' AS code, s AS detail FROM (SELECT unnest(['count','max']) AS s) WHERE EXISTS (SELECT 1 FROM frames)""")
def v14(spark, sf):
    from episodica.operators import relative
    fr = t.frames(spark, sf)
    true = v.long_stats(relative.profile(fr, [0], 2, 20).withColumn("feature", F.lit("action")), "events", stats.STATISTICS)
    stored = true.withColumn("value", F.when(F.col("statistic") == "max", F.col("value") * 1.001).when(F.col("statistic") == "count", F.col("value") + 1).otherwise(F.col("value")))
    return v.relative_issues(fr, stored, [0], 2, 20, "events").select("code", "detail")


# customers as videos: the order dates are frame times
@query("v17_video_pts", f"""WITH {_ORD}, s AS (SELECT e, pos, ts, ts - lag(ts) OVER (PARTITION BY e ORDER BY pos) AS g FROM of)
  SELECT 'video_pts_mismatch' AS code, CAST(e AS VARCHAR) AS feature FROM s GROUP BY e HAVING bool_or(CASE WHEN pos = 0 THEN abs(ts) > 0.5/2 ELSE g <= 0 OR abs(g - 1.0/2) > 0.001 + 0.10/2 END)""")
def v17(spark, sf):
    pts = placed(spark, sf).select("dataset_id", F.col("episode_index").cast("string").alias("path"), F.col("pos").alias("n"), F.col("timestamp").alias("pts"))
    return v.pts_issues(pts, 2.0).select("code", "feature")


@query("v17_segment_pts", f"""WITH {_ORD}, l AS (SELECT e, max(ts) - min(ts) AS span, count(*) AS n, max(CASE WHEN pos = 0 THEN ts END) AS first, max(ts) AS top FROM of GROUP BY 1),
  lst AS (SELECT of.e, of.ts AS last FROM of JOIN le ON le.e = of.e AND of.pos = le.length - 1)
  SELECT 'video_segment_pts_mismatch' AS code, l.e AS episode_index FROM l JOIN lst USING (e) WHERE abs(first - 0) > 0.25 + 1e-9 OR abs(last - (n/2.0 - 0.5)) > 0.25 + 1e-9""")
def v17_segments(spark, sf):
    pts = placed(spark, sf).select("dataset_id", F.col("episode_index").cast("string").alias("path"), F.col("pos").alias("n"), F.col("timestamp").alias("pts"))
    lengths = series.episode_lengths(order_frames(spark, sf))
    videos = lengths.select(*EP, F.lit("top").alias("camera"), F.col("episode_index").cast("string").alias("path"), F.lit(0.0).alias("from_timestamp"), (F.col("length") / 2.0).alias("to_timestamp"))
    return v.segment_pts_issues(videos, lengths, pts, 2.0).select("code", "episode_index")


@query("v17_video_fps", """SELECT 'video_fps_mismatch' AS code, CAST(p_partkey AS VARCHAR) AS feature FROM part WHERE abs(p_size - 30) > greatest(0.01, 0.01*greatest(p_size, 30))""")
def v17_fps(spark, sf):
    streams = t.table(spark, sf, "part").select(F.lit("part").alias("dataset_id"), F.col("p_partkey").cast("string").alias("path"), F.col("p_size").cast("double").alias("stream_fps"))
    return v.stream_rate_issues(streams, 30.0).select("code", "feature")


@query("v16_segment_metadata", f"""WITH {_ORD} SELECT 'video_segment_metadata_invalid' AS code, e AS episode_index FROM le JOIN customer ON c_custkey = e
  WHERE NOT (c_acctbal/1000 >= 0 AND abs(length/10.0 - (c_nationkey+1)/10.0) <= 0.05 + 1e-9)""")
def v16(spark, sf):
    lengths = series.episode_lengths(order_frames(spark, sf))
    start = F.col("c_acctbal") / 1000
    videos = t.table(spark, sf, "customer").select(F.lit("orders").alias("dataset_id"), F.col("c_custkey").alias("episode_index"), F.lit("top").alias("camera"),
                                                   start.alias("from_timestamp"), (start + (F.col("c_nationkey") + 1) / 10.0).alias("to_timestamp"))
    return v.segment_issues(videos, lengths, 10.0).select("code", "episode_index")


@query("a28_validation_summary", f"""WITH {_ORD}, s AS (SELECT *, lag(ts) OVER (PARTITION BY e ORDER BY pos) AS p FROM of),
  f AS (SELECT e FROM s GROUP BY e HAVING bool_or(ts <= p) UNION ALL SELECT e FROM s GROUP BY e HAVING max(abs(ts - pos/10.0::DOUBLE)) > 0.001),
  w AS (SELECT e FROM of GROUP BY e HAVING count(*) > 2 AND (max(prio) = min(prio) OR max(price) = min(price)))
  SELECT (SELECT count(*) FROM f) AS failures, (SELECT count(*) FROM w) AS warnings, (SELECT count(*) FROM f) = 0 AS passed""")
def a28(spark, sf):
    p = placed(spark, sf)
    return v.summary(v.timestamp_issues(p, 10.0).unionByName(v.motion_issues(p, ["action"], jump=1e12)))


@query("j02_frames_with_episodes", f"""WITH {t.FRAMES_SQL}, e AS (SELECT episode_index, count(*) AS length, min(idx) AS f FROM frames GROUP BY 1)
  SELECT frames.episode_index, frame_index, length, idx - f AS place FROM frames JOIN e USING (episode_index)""")
def j02(spark, sf):
    per = series.with_offsets(t.episodes(spark, sf))
    joined = series.attach(t.frames(spark, sf), per)
    return joined.select("episode_index", "frame_index", "length", (F.col("index") - F.col("dataset_from_index")).alias("place"))



