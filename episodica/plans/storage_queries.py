"""Source and sink queries: the derived frames are written in both layouts, scanned again and compared with SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.operators import curate, series, stats
from episodica.operators import validate as v
from episodica.plans import tables as t
from episodica.plans.language_queries import styled
from episodica.plans.registry import query, r
from episodica.plans.statistics_queries import TEN, ten_sql
from episodica.session import new_path
from episodica.sources import readers, writers

EP = series.EPISODE
_ROOTS: dict[tuple[str, str, str], str] = {}
CAMERAS = ["top", "side"]

# Declaration of the written data set; its totals are filled in from the data.
FEATURES = {
    "action": {"dtype": "float64", "shape": [2], "names": ["value", "k"]},
    "observation.state": {"dtype": "float64", "shape": [2], "names": {"motors": ["value", "k"]}},
    "timestamp": {"dtype": "float64", "shape": [1], "names": None},
    "frame_index": {"dtype": "int64", "shape": [1], "names": None},
    "episode_index": {"dtype": "int64", "shape": [1], "names": None},
    "index": {"dtype": "int64", "shape": [1], "names": None},
    "task_index": {"dtype": "int64", "shape": [1], "names": None},
    "observation.images.top": {"dtype": "video", "shape": [48, 64, 3], "names": None},
}


def _once(spark, sf, name, build):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _ROOTS:
        root = new_path(spark, name)
        build(root)
        _ROOTS[key] = root
    return _ROOTS[key]


def header(spark, sf, version):
    totals = t.episodes(spark, sf).agg(F.count("*").alias("e"), F.sum("length").alias("f")).first()
    return {"codebase_version": version, "robot_type": "events", "fps": t.FPS, "total_episodes": totals.e, "total_frames": totals.f,
            "total_tasks": t.tasks(spark, sf).count(), "chunks_size": 1000, "splits": {"train": f"0:{totals.e}"}, "features": FEATURES}


def episode_table(spark, sf):
    fr = t.frames(spark, sf)
    named = t.episodes(spark, sf).join(curate.episode_tasks(fr, t.tasks(spark, sf)), EP)
    return writers.with_video_segments(writers.plan_shards(named, rows_per_file=4000), CAMERAS, t.FPS)


def v3_root(spark, sf):
    def build(root):
        fr = t.frames(spark, sf).drop("seconds")
        shards = episode_table(spark, sf)
        writers.write_frames(fr, shards, root)
        writers.write_episodes(shards, root)
        writers.write_tasks(t.tasks(spark, sf), root)
        doc = header(spark, sf, "v3.0")
        shapes = {("state" if f == "observation.state" else f): d["shape"] for f, d in FEATURES.items() if d["dtype"] != "video"}
        every = stats.feature_stats(fr, list(shapes), shapes=shapes, total=doc["total_frames"])
        every = every.withColumn("feature", F.when(F.col("feature") == "state", "observation.state").otherwise(F.col("feature")))
        writers.write_stats_json(every, root, {f: d["shape"] for f, d in FEATURES.items()})
        writers.write_header(spark, root, doc)
    return _once(spark, sf, "layout_v3", build)


def v2_root(spark, sf):
    def build(root):
        fr = t.frames(spark, sf).drop("seconds")
        writers.convert_to_v2(fr, t.episodes(spark, sf).join(curate.episode_tasks(fr, t.tasks(spark, sf)), EP), t.tasks(spark, sf), header(spark, sf, "v3.0"), root)
        writers.write_episode_stats_jsonl(stats.feature_stats_by_episode(t.frames(spark, sf), ["action"]), root)
    return _once(spark, sf, "layout_v2", build)


_FRAME_ROWS = """SELECT episode_index, frame_index, idx AS "index", task_index, event_id, round(tstamp,6) AS timestamp, round(a0,6) AS a0, round(s1,6) AS s1 FROM frames"""


def _rows(frames):
    return frames.select("episode_index", "frame_index", "index", "task_index", "event_id", *r("timestamp"), F.round(F.get("action", F.lit(0)), 6).alias("a0"),
                         F.round(F.get("state", F.lit(1)), 6).alias("s1"))


@query("s02_scan_frames_v3", f"WITH {t.FRAMES_SQL} {_FRAME_ROWS}")
def s02(spark, sf):
    return _rows(readers.scan_frames(spark, v3_root(spark, sf), "events"))


@query("k02_write_frames_v2", f"WITH {t.FRAMES_SQL} {_FRAME_ROWS}")
def k02(spark, sf):
    return _rows(readers.scan_frames(spark, v2_root(spark, sf), "events"))


@query("k01_shard_layout", f"""WITH {t.FRAMES_SQL}, e AS (SELECT episode_index, count(*) AS n, min(idx) AS f FROM frames GROUP BY 1)
  SELECT CAST(f // 4000 // 1000 AS INTEGER) AS chunk, CAST(f // 4000 % 1000 AS INTEGER) AS file, count(*) AS episodes, CAST(sum(n) AS BIGINT) AS frames FROM e GROUP BY ALL""")
def k01(spark, sf):
    fr = readers.scan_frames(spark, v3_root(spark, sf), "events", columns=["episode_index"])
    place = fr.select("episode_index", F.regexp_extract("_file", r"chunk-(\d+)", 1).cast("int").alias("chunk"), F.regexp_extract("_file", r"file-(\d+)", 1).cast("int").alias("file"))
    return place.groupBy("chunk", "file").agg(F.count_distinct("episode_index").alias("episodes"), F.count("*").alias("frames"))


@query("k01_read_by_name", f"""WITH {t.FRAMES_SQL}, e AS (SELECT episode_index, min(idx) AS f FROM frames GROUP BY 1)
  SELECT episode_index, frame_index, idx AS "index" FROM frames JOIN e USING (episode_index) WHERE f < 4000""")
def k01_name(spark, sf):
    """The first shard by its exact file name."""
    return spark.read.parquet(f"{v3_root(spark, sf)}/data/chunk-000/file-000.parquet").select("episode_index", "frame_index", "index")


@query("k02_read_by_name", f"""WITH {t.FRAMES_SQL} SELECT frame_index, idx AS "index" FROM frames WHERE episode_index = 3""")
def k02_name(spark, sf):
    return spark.read.parquet(f"{v2_root(spark, sf)}/data/chunk-000/episode_000003.parquet").select("frame_index", "index")


@query("c11_convert_to_v2", f"""WITH {t.FRAMES_SQL} SELECT episode_index, CAST(episode_index // 1000 AS INTEGER) AS chunk, count(*) AS frames FROM frames GROUP BY 1""")
def c11(spark, sf):
    fr = readers.scan_frames(spark, v2_root(spark, sf), "events", columns=["episode_index"])
    return fr.groupBy("episode_index", F.regexp_extract("_file", r"chunk-(\d+)", 1).cast("int").alias("chunk")).agg(F.count("*").alias("frames"))


# every part is a data set with a header document of two features
_PART_DOCS = """pd AS (SELECT p_partkey AS dataset_id, p_size, split_part(p_name, ' ', 1) AS word,
  CASE p_type WHEN 'ECONOMY' THEN 'float32' WHEN 'PROMO' THEN 'video' WHEN 'STANDARD' THEN 'string' ELSE 'int32' END AS dtype FROM part),
fe AS (SELECT dataset_id, 0 AS ord, 'action' AS feature, dtype, CAST(p_size AS INTEGER) AS width, 1 AS dims, word AS names FROM pd
  UNION ALL SELECT dataset_id, 1, 'image', 'float32', CAST(2 * p_size AS INTEGER), 2, word || ',' || word || '2' FROM pd)"""


def part_headers(spark, sf):
    part = t.table(spark, sf, "part")
    kind = F.col("p_type")
    dtype = F.when(kind == "ECONOMY", "float32").when(kind == "PROMO", "video").when(kind == "STANDARD", "string").otherwise("int32")
    word = F.split("p_name", " ")[0]
    text = F.concat(
        F.lit('{"codebase_version":"v3.0","fps":30,"total_episodes":'), "p_size", F.lit(',"features":{"action":{"dtype":"'), dtype, F.lit('","shape":['), "p_size", F.lit('],"names":["'), word,
        F.lit('"]},"image":{"dtype":"float32","shape":[2,'), "p_size", F.lit('],"names":{"motors":["'), word, F.lit('","'), word, F.lit('2"]}}}}'))
    return readers.parse_headers(part.select(F.col("p_partkey").alias("dataset_id"), text.alias("value")))


@query("s01_read_features", f"WITH {_PART_DOCS} SELECT dataset_id, ord, feature, dtype, width, names FROM fe")
def s01(spark, sf):
    f = readers.read_features(part_headers(spark, sf))
    return f.select("dataset_id", "ord", "feature", "dtype", F.aggregate("shape", F.lit(1), lambda a, n: a * n).alias("width"), F.array_join("names", ",").alias("names"))


@query("s01_read_header", "SELECT p_partkey AS dataset_id, 'v3.0' AS codebase_version, 30.0::DOUBLE AS fps, CAST(p_size AS BIGINT) AS total_episodes FROM part")
def s01_header(spark, sf):
    return part_headers(spark, sf).select("dataset_id", "codebase_version", "fps", "total_episodes")


@query("p01_numeric_features", f"WITH {_PART_DOCS} SELECT dataset_id, feature, width FROM fe WHERE dtype NOT IN ('video', 'string')")
def p01(spark, sf):
    return stats.numeric_features(readers.read_features(part_headers(spark, sf))).select("dataset_id", "feature", F.col("width").cast("int").alias("width"))


@query("p02_chart_features", f"""WITH {_PART_DOCS} SELECT dataset_id, feature, CASE WHEN dims >= 2 THEN 'dimensions' WHEN dtype NOT IN ('float32','int32') THEN 'dtype' END AS ignored FROM fe""")
def p02(spark, sf):
    f = readers.read_features(part_headers(spark, sf))
    return readers.chart_features(f, "v2.1", ["timestamp", "frame_index"]).select("dataset_id", "feature", "ignored")


_TASKS = "SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS task_index, event_type AS task FROM (SELECT DISTINCT event_type FROM events)"


@query("s03_scan_tasks_v3", _TASKS)
def s03(spark, sf):
    return readers.scan_tasks(spark, v3_root(spark, sf), "events", "v3.0").select("task_index", "task")


@query("k04_write_tasks_v2", _TASKS)
def k04(spark, sf):
    return readers.scan_tasks(spark, v2_root(spark, sf), "events", "v2.1").select("task_index", "task")


@query("s04_scan_episodes_v3", f"""WITH {t.FRAMES_SQL} SELECT episode_index, count(*) AS length, min(idx) AS dataset_from_index, max(idx)+1 AS dataset_to_index,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tasks FROM frames GROUP BY 1""")
def s04(spark, sf):
    e = readers.scan_episodes(spark, v3_root(spark, sf), "events", "v3.0")
    return e.select("episode_index", "length", "dataset_from_index", "dataset_to_index", F.array_join("tasks", ",").alias("tasks"))


@query("k03_write_episodes_v2", f"""WITH {t.FRAMES_SQL} SELECT episode_index, count(*) AS length, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tasks FROM frames GROUP BY 1""")
def k03(spark, sf):
    e = readers.scan_episodes(spark, v2_root(spark, sf), "events", "v2.1")
    return e.select("episode_index", "length", F.array_join("tasks", ",").alias("tasks"))


@query("s05_episode_slice", f"""WITH {t.FRAMES_SQL} SELECT frame_index, event_id FROM frames WHERE episode_index = 7""")
def s05(spark, sf):
    root = v3_root(spark, sf)
    where = readers.scan_episodes(spark, root, "events", "v3.0").filter("episode_index = 7").select("dataset_from_index", "dataset_to_index").first()
    return readers.episode_slice(readers.scan_frames(spark, root, "events"), where[0], where[1]).select("frame_index", "event_id")


@query("s06_project_at_scan", f"""WITH {t.FRAMES_SQL} SELECT task_index, count(*) AS frames, round(sum(tstamp),6) AS seconds FROM frames GROUP BY 1""")
def s06(spark, sf):
    fr = readers.scan_frames(spark, v3_root(spark, sf), "events", columns=["task_index", "timestamp"])
    return fr.groupBy("task_index").agg(F.count("*").alias("frames"), F.round(F.sum("timestamp"), 6).alias("seconds"))


@query("s10_read_stats", f"""WITH {t.FRAMES_SQL}, s AS (SELECT dim, {ten_sql()} FROM vals GROUP BY dim) SELECT 'action' AS feature, dim, min, max, mean, std, count, q01, q10, q50, q90, q99 FROM s""")
def s10(spark, sf):
    s = readers.read_stats(spark, f"{v3_root(spark, sf)}/meta/stats.json", "events").filter("feature = 'action'")
    at = lambda n: F.round(F.max(F.when(F.col("statistic") == n, F.col("value"))), 6).alias(n)
    wide = s.filter("statistic <> 'count'").groupBy("feature", "dim").agg(*[at(n) for n in TEN])
    return wide.join(s.filter("statistic = 'count'").select("feature", F.col("value").cast("bigint").alias("count")), "feature")


@query("s12_read_episode_stats", f"WITH {t.FRAMES_SQL} SELECT episode_index, 'action' AS feature, dim, {ten_sql(digits=8)} FROM vals GROUP BY episode_index, dim")
def s12(spark, sf):
    s = readers.read_episode_stats(spark, f"{v2_root(spark, sf)}/meta/episodes_stats.jsonl", "events")
    at = lambda n: F.round(F.max(F.when(F.col("statistic") == n, F.col("value"))), 8).alias(n)
    wide = s.filter("statistic <> 'count'").groupBy("episode_index", "feature", "dim").agg(*[at(n) for n in TEN])
    counts = s.filter("statistic = 'count'").select("episode_index", "feature", F.col("value").cast("bigint").alias("count"))
    return wide.join(counts, ["episode_index", "feature"])


@query("k06_episode_stats_columns", f"WITH {t.FRAMES_SQL} SELECT episode_index, count(*) AS length, round(avg(a0),8) AS mean0, round(avg(a1),8) AS mean1, round(quantile_cont(a0,0.5),8) AS median0 FROM frames GROUP BY 1")
def k06(spark, sf):
    wide = writers.with_episode_stats(t.episodes(spark, sf), stats.feature_stats_by_episode(t.frames(spark, sf), ["action"]), ["action"])
    at = lambda s, i, n: F.round(F.get(F.col(f"`stats/action/{s}`"), F.lit(i)), 8).alias(n)
    return wide.select("episode_index", "length", at("mean", 0, "mean0"), at("mean", 1, "mean1"), at("q50", 0, "median0"))


@query("k05_stats_json", f"WITH {t.FRAMES_SQL} SELECT 'action' AS feature, count(*) AS frames, round(min(a0),6) AS min0, round(max(a1),6) AS max1 FROM frames")
def k05(spark, sf):
    nested = writers.nested_stats(stats.feature_stats(t.frames(spark, sf), ["action"]))
    return nested.select("feature", F.get("count", F.lit(0)).alias("frames"), F.round(F.get("min", F.lit(0)), 6).alias("min0"), F.round(F.get("max", F.lit(1)), 6).alias("max1"))


@query("s11_annotation_sidecar", """SELECT conv_id AS episode_index, turn AS ord, role, text AS content, CAST(turn AS DOUBLE) AS ts FROM conversations""")
def s11(spark, sf):
    """Written as version 2 and read back."""
    def build(root):
        none = F.lit(None)
        from episodica.functions import language as rules
        atoms = styled(spark, sf).withColumn("camera", none.cast("string")).withColumn("tool_calls", none.cast(rules.TOOL_CALLS))
        writers.write_annotation_sidecar(atoms, f"{root}/annotations.json")
    root = _once(spark, sf, "sidecar", build)
    atoms = readers.read_annotation_sidecar(spark, f"{root}/annotations.json", "conversations", lines=True)
    # list order equals turn order; the turn number itself is kept as time
    return atoms.select("episode_index", F.col("ts").cast("bigint").alias("ord"), "role", "content", "ts")


@query("s11_sidecar_migration", """SELECT user_id AS episode_index, 'subtask' AS style, 'assistant' AS role, count(*) AS atoms FROM events WHERE event_type = 'click' GROUP BY 1
  UNION ALL SELECT user_id, 'interjection', 'user', count(*) FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT user_id, NULL, 'assistant', count(*) FROM events WHERE event_type = 'error' GROUP BY 1""")
def s11_old(spark, sf):
    """Records of the first format: labelled segments, user prompts and robot utterances."""
    def build(root):
        e = t.table(spark, sf, "events")
        kind = F.col("event_type")
        record = F.struct(F.when(kind == "click", F.array(F.struct(kind.alias("label"), F.col("value").alias("start")))).alias("subtasks"),
                          F.when(kind.isin("view", "error"), F.array(F.struct(F.col("value").alias("start"), F.when(kind == "view", kind).alias("user_prompt"),
                                                                              F.when(kind == "error", kind).alias("robot_utterance")))).alias("high_levels"))
        e.select(F.map_from_arrays(F.array(F.col("user_id").cast("string")), F.array(record)).alias("episodes")).write.json(f"{root}/annotations.json")
    root = _once(spark, sf, "sidecar_v1", build)
    atoms = readers.read_annotation_sidecar(spark, f"{root}/annotations.json", "events", lines=True)
    return atoms.groupBy("episode_index", "style", "role").agg(F.count("*").alias("atoms"))


@query("s09_progress_series", """WITH p AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN value END AS sparse, value AS dense, count(*) FILTER (event_type = 'click' AND value > 0) OVER (PARTITION BY user_id) AS c FROM events),
  v AS (SELECT user_id, event_id, CASE WHEN c > 0 THEN sparse ELSE dense END AS progress, CASE WHEN c > 0 THEN 'progress_sparse' ELSE 'progress_dense' END AS "column" FROM p),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS point, count(*) OVER (PARTITION BY user_id) AS k FROM v WHERE progress IS NOT NULL)
  SELECT user_id AS episode_index, "column", point, round(point / greatest(k - 1, 1) * 30, 6) AS timestamp, round(progress, 6) AS progress FROM n""")
def s09(spark, sf):
    e = t.table(spark, sf, "events").select(F.lit("events").alias("dataset_id"), F.col("user_id").alias("episode_index"), F.col("event_id").alias("index"), F.col("event_id").alias("_row"),
                                            F.when(F.col("event_type") == "click", F.col("value").cast("string")).otherwise("none").alias("progress_sparse"), F.col("value").alias("progress_dense"))
    durations = e.select(*EP).distinct().withColumn("duration", F.lit(30.0))
    return readers.progress_series(e, durations).select("episode_index", "column", "point", *r("timestamp", "progress"))


@query("p17_video_segments", f"""WITH {t.FRAMES_SQL}, e AS (SELECT episode_index, count(*) AS n, min(idx) AS f FROM frames GROUP BY 1)
  SELECT episode_index, c.camera, f // 4000 // 1000 AS chunk_index, f // 4000 % 1000 AS file_index, 0.0::DOUBLE AS first_time, round(greatest(0, n/10.0 - 0.05),6) AS last_time FROM e, (VALUES ('top'),('side')) c(camera)""")
def p17(spark, sf):
    e = readers.scan_episodes(spark, v3_root(spark, sf), "events", "v3.0")
    return readers.episode_videos(e).select("episode_index", "camera", "chunk_index", "file_index", "first_time", *r("last_time"))


@query("k09_typed_sink", f"WITH {t.FRAMES_SQL} SELECT episode_index, frame_index, round(CAST(CAST(a0 AS FLOAT) AS DOUBLE),6) AS a0, CAST(task_index AS INTEGER) AS task_index FROM frames")
def k09(spark, sf):
    schema = T.StructType([T.StructField("episode_index", T.LongType()), T.StructField("frame_index", T.LongType()), T.StructField("action", T.ArrayType(T.FloatType())), T.StructField("task_index", T.IntegerType())])
    typed = writers.typed(t.frames(spark, sf), schema)
    return typed.select("episode_index", "frame_index", F.round(F.get("action", F.lit(0)).cast("double"), 6).alias("a0"), "task_index")


@query("p16_drop_legacy_columns", f"WITH {t.FRAMES_SQL} SELECT episode_index, frame_index, 0 AS annotations FROM frames")
def p16(spark, sf):
    from episodica.operators import language
    legacy = t.frames(spark, sf).select(*EP, "frame_index", F.lit(1).alias("subtask_index"), F.lit("[]").alias("tools"))
    none = styled(spark, sf).limit(0).select(*EP, F.lit("language_persistent").alias("column"), F.lit(0).cast("bigint").alias("frame_index"), F.lit(0.0).cast("float").alias("ts"), "ord", "role", "content", "style")
    out = language.nest(none, legacy)
    if {"subtask_index", "tools"} & set(out.columns):
        raise ValueError("legacy columns were kept")
    return out.select("episode_index", "frame_index", (F.size("language_persistent") + F.size("language_events")).alias("annotations"))


def written_dataset(spark, sf):
    """The written v3 data set with its stored statistics and video segments."""
    root = v3_root(spark, sf)
    head = readers.read_header(spark, root, "events")
    episodes = readers.scan_episodes(spark, root, "events", "v3.0")
    return v.Dataset("events", head, readers.read_features(head), readers.read_splits(head), readers.scan_tasks(spark, root, "events", "v3.0"),
                     episodes, readers.scan_frames(spark, root, "events"), readers.read_stats(spark, f"{root}/meta/stats.json", "events"), readers.video_segments(episodes))


@query("v00_full_run", """SELECT count(*) FILTER (n IS NULL) AS failures, 1 AS warnings, true AS passed FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def v00(spark, sf):
    """All rules over the written v3 data set, which is sound; only its pictures cannot be verified."""
    return v.summary(v.run(written_dataset(spark, sf), "full"))


# Every twelfth episode is damaged in the same way.
_DAMAGED = f"""{t.FRAMES_SQL}, e AS (SELECT episode_index, any_value(n) AS n, episode_index % 12 AS m FROM frames GROUP BY 1),
  x AS (SELECT f.*, f.episode_index % 12 AS m, CASE WHEN f.episode_index % 12 = 5 THEN f.task_index + 999 ELSE f.task_index END AS task FROM frames f),
  st AS (SELECT min(task_index) AS a1, max(task_index) AS b1, avg(task_index) AS c1, stddev_pop(task_index) AS d1, min(task) AS a2, max(task) AS b2, avg(task) AS c2, stddev_pop(task) AS d2 FROM x),
  still AS (SELECT episode_index, 'action' AS feature FROM frames WHERE episode_index % 12 NOT IN (4, 6) GROUP BY 1 HAVING count(*) > 2 AND (max(a0) = min(a0) OR max(a1) = min(a1))
   UNION ALL SELECT episode_index, 'state' FROM frames WHERE episode_index % 12 NOT IN (4, 6) GROUP BY 1 HAVING count(*) > 2 AND (max(s0) = min(s0) OR max(s1) = min(s1))),
  c AS (SELECT 'FAIL' AS severity, 'frame_index_mismatch' AS code FROM e WHERE m = 1 AND n > 1
   UNION ALL SELECT 'FAIL', 'timestamp_alignment' FROM e WHERE m = 2 UNION ALL SELECT 'FAIL', unnest(['timestamp_non_finite', 'feature_non_finite']) FROM e WHERE m = 3
   UNION ALL SELECT 'FAIL', 'feature_shape_mismatch' FROM e WHERE m = 4 UNION ALL SELECT 'FAIL', unnest(['task_reference_invalid', 'task_reference_invalid']) FROM e WHERE m = 5
   UNION ALL SELECT 'FAIL', 'feature_non_finite' FROM e WHERE m = 6 UNION ALL SELECT 'FAIL', 'global_index_mismatch' FROM e WHERE m = 7
   UNION ALL SELECT 'FAIL', 'video_segment_metadata_invalid' FROM e, range(2) WHERE m = 8
   UNION ALL SELECT 'WARN', 'constant_sensor' FROM still UNION ALL SELECT 'WARN', 'visual_stats_not_recomputed'
   UNION ALL SELECT 'FAIL', 'stats_feature_missing' UNION ALL SELECT 'FAIL', 'stats_value_mismatch'
   UNION ALL SELECT 'FAIL', unnest(['stats_source_invalid', 'stats_source_non_finite', 'stats_source_non_finite', 'stats_feature_unavailable', 'stats_feature_unavailable', 'stats_feature_unavailable'])
   UNION ALL SELECT 'FAIL', 'stats_value_mismatch' FROM st, unnest([[a1, a2], [b1, b2], [c1, c2], [d1, d2]]) u(p) WHERE abs(p[1] - p[2]) > 1e-7 + 1e-5 * abs(p[2])
   UNION ALL SELECT 'WARN', 'abnormal_episode_length' FROM (SELECT max(n) AS top, greatest(2, floor(median(n) * 5)) AS lim FROM e) WHERE top > lim)"""


@query("v00_damaged_run", f"WITH {_DAMAGED} SELECT severity, code, count(*) AS issues FROM c GROUP BY ALL")
def v00_damaged(spark, sf):
    """Seven kinds of damaged frames, wrong segments, one statistic lost and one changed, all in one run."""
    data, kind = written_dataset(spark, sf), F.col("episode_index") % 12
    last = F.col("length") - 1
    rows = series.attach(data.frames, t.episodes(spark, sf).withColumn("dataset_id", F.lit("events")))
    change = {"frame_index": (1, last - F.col("frame_index")), "timestamp": (2, F.col("timestamp") + 100), "action": (4, F.concat("action", "action")), "task_index": (5, F.col("task_index") + 999),
              "state": (6, F.concat(F.array(F.lit(float("nan"))), F.slice("state", 2, 1))), "index": (7, F.col("index") + 1)}
    for name, (k, value) in change.items():
        rows = rows.withColumn(name, F.when(kind == k, value).otherwise(F.col(name)))
    rows = rows.withColumn("timestamp", F.when(kind == 3, F.lit(float("nan"))).otherwise(F.col("timestamp"))).drop("length")
    stored = data.stats.filter("feature <> 'index'").withColumn("value", F.when((F.col("feature") == "frame_index") & (F.col("statistic") == "mean"), F.col("value") * 1.01).otherwise(F.col("value")))
    videos = data.videos.withColumn("to_timestamp", F.when(kind == 8, F.col("from_timestamp")).otherwise(F.col("to_timestamp")))
    found = v.run(dataclasses.replace(data, frames=rows, stats=stored, videos=videos), "full")
    return found.groupBy("severity", "code").agg(F.count("*").alias("issues"))


@query("v15_gate_and_rerun", f"""WITH {t.FRAMES_SQL}, e AS (SELECT episode_index, min(idx) // 4000 AS shard FROM frames GROUP BY 1),
  w AS (SELECT DISTINCT shard FROM e WHERE episode_index % 12 = 2)
  SELECT count(*) AS episodes, (SELECT count(*) FROM e WHERE shard IN (SELECT shard FROM w)) AS dirty, count(*) FILTER (episode_index % 12 = 2) AS again,
  0 AS lost, 1 AS blocked FROM e""")
def v15_rerun(spark, sf):
    """An export gate over the sound data set; then one run that starts from it after shards with damaged times were replaced.

    The manifest is that of the shards: their rows' times added up. A rerun reads only episodes of changed shards and must
    find what a run over everything finds.
    """
    data = written_dataset(spark, sf)
    kind = F.col("episode_index") % 12 == 2
    worse = data.frames.withColumn("timestamp", F.when(kind, F.col("timestamp") + 100).otherwise(F.col("timestamp")))

    def manifest(frames):
        total = F.sum(F.col("timestamp").cast("decimal(20,3)")).cast("string")
        return lambda: frames.groupBy(F.concat(F.lit("data/"), F.element_at(F.split("_file", "/data/"), -1)).alias("path")).agg(F.count("*").alias("size"), F.sha2(total, 256).alias("sha256"))

    gate, kept = v.check(dataclasses.replace(data, manifest=manifest(data.frames)), "export_gate")
    damaged = dataclasses.replace(data, frames=worse, manifest=manifest(worse))
    rerun, _ = v.check(damaged, "full", kept)
    whole = v.run(damaged, "full")
    issue = ["severity", "code", "episode_index", "feature", "detail"]
    lost = whole.select(*issue).exceptAll(rerun.select(*issue)).unionByName(rerun.select(*issue).exceptAll(whole.select(*issue)))
    dirty = v.dirty_episodes(damaged, kept.manifest, damaged.manifest())
    one = t.episodes(spark, sf).agg(F.count("*").alias("episodes"))
    counts = {"dirty": dirty.agg(F.count("*")), "again": rerun.filter("code = 'timestamp_alignment'").agg(F.count("*")), "lost": lost.agg(F.count("*")),
              "blocked": gate.filter("severity = 'FAIL'").agg(F.count("*"))}
    return one.select("episodes", *[c.scalar().alias(n) for n, c in counts.items()])
