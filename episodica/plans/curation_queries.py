"""Curation, merge and augmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import augment, curate, merge, series, stats, trim
from episodica.plans import tables as t
from episodica.plans.registry import query, r
from episodica.plans.sequence_queries import MOTION, motion_bounds, motion_sql
from episodica.session import materialize

EP = series.EPISODE
DAY = 86400.0

# Flags: users that caused an error event of more than 250.
_FLAGS = """fl AS (SELECT DISTINCT episode_index FROM frames WHERE event_type = 'error' AND a0 > 130),
ep AS (SELECT episode_index, count(*) AS length FROM frames GROUP BY 1)"""


def flags(spark, sf):
    return t.frames(spark, sf).join(t.tasks(spark, sf).filter("task = 'error'"), ["dataset_id", "task_index"]).filter(
        F.get("action", F.lit(0)) > 130).select(*EP).distinct()


def _mode(spark, sf, mode, **kw):
    return curate.require_selection(curate.select_episodes(t.episodes(spark, sf), flags(spark, sf), mode, **kw)).select("episode_index", "length")


@query("p07_select_flagged", f"WITH {t.FRAMES_SQL}, {_FLAGS} SELECT episode_index, length FROM ep WHERE episode_index IN (SELECT episode_index FROM fl)")
def p07_flagged(spark, sf):
    return _mode(spark, sf, "flagged")


@query("p07_delete_flagged", f"WITH {t.FRAMES_SQL}, {_FLAGS} SELECT episode_index, length FROM ep WHERE episode_index NOT IN (SELECT episode_index FROM fl)")
def p07_delete(spark, sf):
    return _mode(spark, sf, "delete_flagged")


@query("p07_flag_split_takes_all", f"WITH {t.FRAMES_SQL}, {_FLAGS} SELECT episode_index, length FROM ep")
def p07_all(spark, sf):
    return _mode(spark, sf, "flagged", split_by_flag=True)


@query("j03_selection_order", f"""WITH {t.FRAMES_SQL}, {_FLAGS}, s AS (SELECT episode_index, row_number() OVER (ORDER BY episode_index) - 1 AS output_index FROM fl)
  SELECT output_index, frame_index, event_id FROM frames JOIN s USING (episode_index)""")
def j03(spark, sf):
    chosen = curate.with_output_index(curate.select_episodes(t.episodes(spark, sf), flags(spark, sf), "flagged"))
    return curate.select_frames(t.frames(spark, sf), chosen).select("output_index", "frame_index", "event_id")


@query("j04_anti_join", """SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def j04(spark, sf):
    docs = t.table(spark, sf, "documents").select(F.lit("documents").alias("dataset_id"), F.col("doc_id").alias("episode_index"))
    bad = t.table(spark, sf, "labels").filter("toxic = 1").select(F.lit("documents").alias("dataset_id"), F.col("doc_id").alias("episode_index"))
    return curate.select_episodes(docs, bad, "delete_flagged").select(F.col("episode_index").alias("doc_id"))


@query("u08_flag_union", f"""WITH {t.FRAMES_SQL}, {_FLAGS} SELECT episode_index FROM fl UNION SELECT episode_index FROM ep WHERE length > 75 UNION SELECT episode_index FROM frames WHERE a0 > 200""")
def u08(spark, sf):
    high = t.frames(spark, sf).filter(F.get("action", F.lit(0)) > 200)
    return curate.merge_flags(flags(spark, sf), t.episodes(spark, sf).filter("length > 75"), high).select("episode_index")


_DOCS = """fd AS (SELECT doc_id AS episode_index FROM labels WHERE toxic = 1),
ch AS (SELECT page_id AS episode_index, length(html) > 1500 AS flagged FROM pages)"""


@query("u04_flag_changes", f"""WITH {_DOCS} SELECT episode_index FROM fd WHERE episode_index NOT IN (SELECT episode_index FROM ch WHERE NOT flagged)
  UNION SELECT episode_index FROM ch WHERE flagged""")
def u04(spark, sf):
    """Toxic documents are flagged; page sizes decide the requested changes."""
    now = t.table(spark, sf, "labels").filter("toxic = 1").select(F.lit("documents").alias("dataset_id"), F.col("doc_id").alias("episode_index"))
    wanted = t.table(spark, sf, "pages").select(F.lit("documents").alias("dataset_id"), F.col("page_id").alias("episode_index"), (F.length("html") > 1500).alias("flagged"))
    return curate.apply_flags(now, wanted).select("episode_index")


@query("u03_train_eval", f"""WITH {t.FRAMES_SQL}, {_FLAGS} SELECT episode_index, CASE WHEN episode_index IN (SELECT episode_index FROM fl) THEN 'eval' ELSE 'train' END AS side FROM ep""")
def u03(spark, sf):
    sides = curate.split_sides(curate.flag_split(t.episodes(spark, sf), flags(spark, sf)))
    return sides["train"].withColumn("side", F.lit("train")).unionByName(sides["eval"].withColumn("side", F.lit("eval"))).select("episode_index", "side")


@query("c07_random_split_size", f"""WITH {t.FRAMES_SQL}, {_FLAGS} SELECT is_eval, CASE WHEN is_eval THEN CAST(floor(n*30/100.0+0.5) AS BIGINT) ELSE n - CAST(floor(n*30/100.0+0.5) AS BIGINT) END AS episodes
  FROM (SELECT count(*) AS n FROM ep), (VALUES (true),(false)) v(is_eval)""")
def c07(spark, sf):
    return curate.random_split(t.episodes(spark, sf), 30, 7).groupBy("is_eval").agg(F.count("*").alias("episodes"))


@query("c07_hash_split_size", """SELECT is_eval, CASE WHEN is_eval THEN CAST(floor(n*12.5/100.0+0.5) AS BIGINT) ELSE n - CAST(floor(n*12.5/100.0+0.5) AS BIGINT) END AS episodes
  FROM (SELECT count(*) AS n FROM orders), (VALUES (true),(false)) v(is_eval)""")
def c07_hash(spark, sf):
    ids = t.table(spark, sf, "orders").select(F.lit("orders").alias("dataset_id"), F.col("o_orderkey").alias("episode_index"))
    return curate.hash_split(ids, 12.5, 7).groupBy("is_eval").agg(F.count("*").alias("episodes"))


_DRAWN = "row_number() OVER (ORDER BY md5('{seed}/events/' || episode_index), episode_index) AS k, count(*) OVER () AS n FROM ep"


@query("c07_random_split", f"""WITH {t.FRAMES_SQL}, {_FLAGS} SELECT episode_index, k <= floor(n*30/100.0+0.5) AS is_eval FROM (SELECT episode_index, {_DRAWN.format(seed=7)})""")
def c07_ids(spark, sf):
    return curate.random_split(t.episodes(spark, sf), 30, 7).select("episode_index", "is_eval")


@query("c08_sample_episodes", f"""WITH {t.FRAMES_SQL}, {_FLAGS} SELECT episode_index, length FROM (SELECT episode_index, length, {_DRAWN.format(seed=42)})
  WHERE k <= greatest(1, floor(n*20/100.0+0.5))""")
def c08(spark, sf):
    return curate.sample_episodes(t.episodes(spark, sf), 20, 42).select("episode_index", "length")


@query("a24_remap_used_tasks", f"""WITH {t.FRAMES_SQL}, u AS (SELECT DISTINCT task_index FROM frames WHERE event_type >= 'e'), m AS (SELECT task_index, dense_rank() OVER (ORDER BY task_index) - 1 AS k FROM u)
  SELECT k AS task_index, event_type AS task, count(*) AS frames FROM frames JOIN m USING (task_index) GROUP BY ALL""")
def a24(spark, sf):
    used = t.frames(spark, sf).join(t.tasks(spark, sf).filter("task >= 'e'").select("task_index"), "task_index", "left_semi")
    frames, tasks = curate.remap_tasks(used, t.tasks(spark, sf))
    return curate.with_task(frames, tasks).groupBy("task_index", "task").agg(F.count("*").alias("frames"))


@query("a24_task_overrides", f"""WITH {t.FRAMES_SQL}, {_FLAGS}, o AS (SELECT episode_index, CASE WHEN length > 75 THEN 'click' WHEN length > 70 THEN 'new ' || CAST(length AS VARCHAR) END AS task FROM ep),
  f AS (SELECT task, min(episode_index) AS e FROM o WHERE task LIKE 'new%' GROUP BY 1), ids AS (SELECT task, 5 + row_number() OVER (ORDER BY e) - 1 AS task_index FROM f)
  SELECT coalesce(ids.task_index, CASE WHEN o.task = 'click' THEN 0 ELSE fr.task_index END) AS task_index, coalesce(o.task, fr.event_type) AS task, count(*) AS frames
  FROM frames fr JOIN o USING (episode_index) LEFT JOIN ids ON ids.task = o.task GROUP BY ALL""")
def a24_overrides(spark, sf):
    n = F.col("length")
    episodes = t.episodes(spark, sf).withColumn("task_override", F.when(n > 75, "click").when(n > 70, F.concat(F.lit("new "), n)))
    frames, tasks = curate.override_tasks(t.frames(spark, sf), episodes, t.tasks(spark, sf))
    return curate.with_task(frames, tasks).groupBy("task_index", "task").agg(F.count("*").alias("frames"))


@query("u09_annotation_upsert", """WITH c AS (SELECT conv_id AS episode_index, count(*) AS revision, sum(length(text)) AS chars FROM conversations GROUP BY 1),
  s AS (SELECT doc_id AS episode_index, CASE WHEN lang = 'en' THEN 'pick ' || source END AS task_override, n_chars FROM documents)
  SELECT coalesce(s.episode_index, c.episode_index) AS episode_index, CASE WHEN s.episode_index IS NULL THEN c.revision ELSE coalesce(c.revision,0) + 1 END AS revision,
  CASE WHEN s.episode_index IS NOT NULL THEN s.task_override END AS task_override, CASE WHEN s.episode_index IS NULL THEN CAST(chars AS BIGINT) ELSE n_chars END AS atoms
  FROM c FULL JOIN s USING (episode_index)""")
def u09(spark, sf):
    current = t.table(spark, sf, "conversations").groupBy(F.lit("d").alias("dataset_id"), F.col("conv_id").alias("episode_index")).agg(
        F.count("*").alias("revision"), F.lit(None).cast("string").alias("task_override"), F.sum(F.length("text")).alias("atoms"))
    saved = t.table(spark, sf, "documents").select(
        F.lit("d").alias("dataset_id"), F.col("doc_id").alias("episode_index"), F.when(F.col("lang") == "en", F.concat(F.lit(" pick "), "source")).alias("task_override"),
        F.col("n_chars").alias("atoms"))
    return curate.upsert_annotations(current, saved).select("episode_index", "revision", "task_override", "atoms")


_RECIPE = f"""{_FLAGS}, {motion_sql(0.6, 6, 2)}, sel AS (SELECT b.*, row_number() OVER (ORDER BY episode_index) - 1 AS o FROM bounds b WHERE episode_index NOT IN (SELECT episode_index FROM fl)),
off AS (SELECT *, coalesce(sum("end"-start) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS base FROM sel),
cur AS (SELECT o AS episode_index, CASE WHEN start > 0 OR "end" < length THEN frame_index - start ELSE frame_index END AS frame_index,
  CAST(base + frame_index - start AS BIGINT) AS idx, event_id, event_type, a0, a1 FROM frames JOIN off USING (episode_index) WHERE frame_index >= start AND frame_index < "end")"""


def curated(spark, sf):
    recipe = curate.Recipe(fps=t.FPS, mode="delete_flagged", motion=MOTION, pairs=trim.shared_dimensions(["value", "k"], ["value", "k"]))
    return curate.curate(recipe, t.frames(spark, sf), t.episodes(spark, sf), t.tasks(spark, sf), flags(spark, sf))


@query("c06_curate_frames", f"""WITH {t.FRAMES_SQL}, {_RECIPE} SELECT episode_index, frame_index, idx AS "index", event_id, event_type AS task FROM cur""")
def c06(spark, sf):
    c = curated(spark, sf)
    return curate.with_task(c.frames, c.tasks).select("episode_index", "frame_index", "index", "event_id", "task")


@query("c06_curate_episodes", f"""WITH {t.FRAMES_SQL}, {_RECIPE} SELECT episode_index, count(*) AS length, min(idx) AS dataset_from_index, max(idx) + 1 AS dataset_to_index,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tasks FROM cur GROUP BY 1""")
def c06_episodes(spark, sf):
    return curated(spark, sf).episodes.select("episode_index", "length", "dataset_from_index", "dataset_to_index", F.array_join("tasks", ",").alias("tasks"))


@query("k07_lineage", f"""WITH {t.FRAMES_SQL}, {_RECIPE} SELECT o AS output_episode_index, episode_index AS source_episode_index, start AS source_start_frame, "end" AS source_end_frame, method FROM sel""")
def k07(spark, sf):
    return curated(spark, sf).lineage.drop("dataset_id")


SHAPES = {"action": [2], "state": [2], "frame_index": [1], "timestamp": [1], "index": [1], "episode_index": [1], "task_index": [1]}


@query("c06_output_statistics", f"""WITH {t.FRAMES_SQL}, {_RECIPE}, src AS (SELECT f.*, o, base, start, ("end" - start) AS kept, (start > 0 OR "end" < length) AS cut FROM frames f JOIN off USING (episode_index) WHERE frame_index >= start AND frame_index < "end"),
  tk AS (SELECT task_index, dense_rank() OVER (ORDER BY task_index) - 1 AS k FROM (SELECT DISTINCT task_index FROM src)),
  v AS (SELECT o AS e, 'action' AS feature, 0 AS dim, a0 AS value FROM src UNION ALL SELECT o, 'action', 1, a1 FROM src UNION ALL SELECT o, 'state', 0, s0 FROM src UNION ALL SELECT o, 'state', 1, s1 FROM src
   UNION ALL SELECT o, 'frame_index', 0, CASE WHEN cut THEN frame_index - start ELSE frame_index END FROM src UNION ALL SELECT o, 'timestamp', 0, CASE WHEN cut THEN (frame_index - start) / 10.0::DOUBLE ELSE tstamp END FROM src
   UNION ALL SELECT o, 'index', 0, base + frame_index - start FROM src UNION ALL SELECT o, 'episode_index', 0, o FROM src UNION ALL SELECT o, 'task_index', 0, k FROM src JOIN tk USING (task_index))
  SELECT e AS episode_index, feature, dim, round(min(value),6) AS min, round(max(value),6) AS max, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std, count(*) AS count, round(quantile_cont(value, 0.5),6) AS q50
  FROM v GROUP BY ALL""")
def c06_statistics(spark, sf):
    """Statistics of the curated output: those of untouched episodes are carried over, only cut ones are read again."""
    fr = t.frames(spark, sf)
    out = curated(spark, sf)
    cut = materialize(out.frames, "curated")  # read several times, as the written output would be
    names = {f: s for f, s in SHAPES.items() if f not in stats.RENUMBERED}
    kept = stats.feature_stats_by_episode(fr, list(names), names)
    moves = out.lineage.select("dataset_id", F.col("source_episode_index").alias("episode_index"), F.col("output_episode_index").alias("output_index"),
                               F.col("source_start_frame").alias("start"), F.col("source_end_frame").alias("end")).join(t.episodes(spark, sf), EP)
    found = stats.carried_stats(kept, cut, moves, SHAPES)
    return found.select("episode_index", "feature", "dim", "count", *r("min", "max", "mean", "std", "q50"))


@query("c06_curated_annotations", """WITH styled AS (SELECT conv_id AS episode_index, turn AS ord, CASE WHEN role = 'system' THEN 'task_aug' WHEN role = 'user' THEN 'interjection' WHEN length(text) > 200 THEN 'plan'
   WHEN length(text) < 80 THEN 'memory' ELSE 'subtask' END AS style FROM conversations),
  cf AS (SELECT conv_id AS episode_index, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS f, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
  b AS (SELECT episode_index, row_number() OVER (ORDER BY episode_index) - 1 AS o, 1 AS s, max(n) - 1 AS e FROM cf GROUP BY 1 HAVING max(n) >= 4),
  sn AS (SELECT a.*, cf.f, o, s, e FROM styled a JOIN cf ON cf.episode_index = a.episode_index AND cf.turn = a.ord JOIN b ON b.episode_index = a.episode_index)
  SELECT o AS episode_index, 'language_persistent' AS "column", CAST(NULL AS BIGINT) AS frame_index, CAST(f - s AS FLOAT) AS ts, ord, style FROM sn WHERE style <> 'interjection' AND f >= s AND f < e
  UNION ALL SELECT o, 'language_persistent', NULL, 0, ord, style FROM sn WHERE style = 'task_aug' AND f < s
  UNION ALL SELECT o, 'language_persistent', NULL, 0, max(ord), style FROM sn WHERE style IN ('subtask','plan') AND f < s GROUP BY o, style
  UNION ALL SELECT o, 'language_events', f - s, NULL, ord, style FROM sn WHERE style = 'interjection' AND f >= s AND f < e""")
def c06_annotations(spark, sf):
    """The whole recipe with annotations: conversations of four turns or more lose their first and last one."""
    from episodica.plans.language_queries import styled, turns
    value = F.array(F.col("timestamp"))
    rows = turns(spark, sf).select(*EP, "frame_index", F.col("frame_index").alias("index"), "timestamp", F.lit(0).cast("bigint").alias("task_index"), value.alias("action"), value.alias("state"))
    episodes = series.episode_lengths(rows)
    short = episodes.filter("length < 4").select(*EP)
    manual = episodes.filter("length >= 4").select(*EP, F.lit(1).alias("start"), (F.col("length") - 1).alias("end"))
    tasks = rows.select("dataset_id", "task_index").distinct().withColumn("task", F.lit("talk"))
    recipe = curate.Recipe(fps=1.0, mode="unflagged", motion=trim.MotionTrim(), pairs=[(0, 0)])
    out = curate.curate(recipe, rows, episodes, tasks, short, styled(spark, sf), manual)
    return out.annotations.select("episode_index", "column", "frame_index", "ts", "ord", "style")


@query("c13_recipe_snapshot", f"""WITH {t.FRAMES_SQL}, {_FLAGS}, r AS (SELECT unnest(['all','flagged','unflagged']) AS mode)
  SELECT mode AS recipe_id, ep.episode_index, fl.episode_index IS NOT NULL AS flagged, CASE WHEN c.conv_id IS NOT NULL THEN 1 END AS annotation_revision
  FROM r, ep LEFT JOIN fl USING (episode_index) LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = ep.episode_index
  WHERE mode = 'all' OR (mode = 'flagged') = (fl.episode_index IS NOT NULL)""")
def c13(spark, sf):
    modes = spark.createDataFrame([("all",), ("flagged",), ("unflagged",)], "mode string")
    recipes = modes.select(F.col("mode").alias("recipe_id"), F.lit("events").alias("dataset_id"), F.lit("v1").alias("fingerprint"), "mode")
    catalog = t.episodes(spark, sf).groupBy("dataset_id").agg(F.count("*").alias("total_episodes"), F.lit("v1").alias("fingerprint"))
    annotations = t.table(spark, sf, "conversations").select(F.lit("events").alias("dataset_id"), F.col("conv_id").alias("episode_index"), F.lit(1).alias("revision")).distinct()
    return curate.snapshot(recipes, catalog, flags(spark, sf), annotations).select("recipe_id", "episode_index", "flagged", "annotation_revision")


# --- merge: event types and order priorities as two task lists ---------------------------------------------------------

def _parts(spark, sf):
    """Long and short episodes as two data sets with their own episode numbers and task lists."""
    def side(name, condition):
        def build():
            kept = curate.with_output_index(t.episodes(spark, sf).filter(condition))
            return curate.select_frames(t.frames(spark, sf), kept).select(
                F.lit(name).alias("dataset_id"), F.col("output_index").alias("episode_index"), "frame_index", F.lit(0).cast("bigint").alias("index"),
                # the second list is numbered backwards, so equal texts have different ids
                (F.col("task_index") if name == "long" else 4 - F.col("task_index")).alias("task_index"), "timestamp", "action", "state", "event_id")
        return t.once(spark, sf, f"merge_{name}", build)
    tasks = t.tasks(spark, sf)
    both = tasks.select(F.lit(0).alias("source_ord"), F.col("task_index").alias("row_ord"), "task_index", "task").unionByName(
        tasks.select(F.lit(1).alias("source_ord"), (4 - F.col("task_index")).alias("row_ord"), (4 - F.col("task_index")).alias("task_index"), "task"))
    return side("long", "length > 66"), side("short", "length <= 66"), both


_MERGE = """ep AS (SELECT episode_index, any_value(n) AS length, CASE WHEN any_value(n) > 66 THEN 0 ELSE 1 END AS src FROM frames GROUP BY 1),
mg AS (SELECT *, row_number() OVER (ORDER BY src, episode_index) - 1 AS o, row_number() OVER (PARTITION BY src ORDER BY episode_index) - 1 AS local,
  sum(length) OVER (ORDER BY src, episode_index) - length AS base FROM ep)"""


@query("u01_merge_frames", f"""WITH {t.FRAMES_SQL}, {_MERGE} SELECT o AS episode_index, frame_index, CAST(base + frame_index AS BIGINT) AS "index", task_index, event_id, src AS source_ord, local AS source_episode_index
  FROM frames JOIN mg USING (episode_index)""")
def u01(spark, sf):
    long, short, tasks = _parts(spark, sf)
    frames, _ = merge.union_frames([long, short], tasks, "merged")
    return frames.select("episode_index", "frame_index", "index", "task_index", "event_id", "source_ord", "source_episode_index")


@query("u01_merge_lineage", f"""WITH {t.FRAMES_SQL}, {_MERGE} SELECT src AS source_ord, local AS source_episode_index, o AS episode_index, length, CAST(base AS BIGINT) AS dataset_from_index,
  CAST(base + length AS BIGINT) AS dataset_to_index FROM mg""")
def u01_lineage(spark, sf):
    long, short, tasks = _parts(spark, sf)
    return merge.union_frames([long, short], tasks, "merged")[1]


@query("u01_merge_statistics", f"""WITH {t.FRAMES_SQL} SELECT dim, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std FROM vals GROUP BY 1""")
def u01_stats(spark, sf):
    """Summaries of the two sources combined, without reading their frames again."""
    from episodica.operators import stats
    long, short, _ = _parts(spark, sf)
    per = stats.feature_stats_by_episode(long, ["action"]).unionByName(stats.feature_stats_by_episode(short, ["action"]))
    return stats.combine(per).select("dim", "count", "min", "max", *r("mean", "std"))


@query("c09_merge_lossless", f"""WITH {t.FRAMES_SQL} SELECT CASE WHEN n > 66 THEN 0 ELSE 1 END AS source_ord, count(*) AS frames, 0 AS lost FROM frames GROUP BY 1""")
def c09(spark, sf):
    """Hundredths as whole numbers: doubles that a float holds exactly; the merge is compared with them as stored."""
    def whole(frames):
        return frames.withColumns({c: F.transform(c, lambda x: F.round(x * 100)) for c in ("action", "state")})

    long, short, tasks = _parts(spark, sf)
    stored, widths = [whole(long), whole(short)], {"action": 2, "state": 2}
    merged, _ = merge.union_frames([merge.normalize(s, widths) for s in stored], tasks, "merged")
    lost = merge.lost_rows(stored[0].unionByName(stored[1]), merged, ["event_id", "timestamp", "action", "state"]).agg(F.count("*").cast("int").alias("lost")).scalar()
    return merged.groupBy("source_ord").agg(F.count("*").alias("frames")).withColumn("lost", lost)


@query("c09_value_problems", """SELECT l_orderkey AS episode_index, l_linenumber AS frame_index, CASE WHEN l_discount = 0 THEN 'null_vector' WHEN l_tax = 0 THEN 'null_element'
  WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'length' ELSE 'non_finite' END AS problem FROM lineitem
  WHERE l_discount = 0 OR l_tax = 0 OR (l_linestatus = 'O' AND l_returnflag = 'N') OR l_quantity = 50""")
def c09_values(spark, sf):
    q = F.when(F.col("l_quantity") == 50, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    v = F.when(F.col("l_discount") == 0, F.lit(None)).when(F.col("l_tax") == 0, F.array(q, F.lit(None).cast("double"))).when(
        (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), F.array(q)).otherwise(F.array(q, F.col("l_tax")))
    rows = t.table(spark, sf, "lineitem").select(F.lit("l").alias("dataset_id"), F.col("l_orderkey").alias("episode_index"), F.col("l_linenumber").alias("frame_index"), v.alias("action"))
    return merge.value_problems(rows, {"action": 2}).select("episode_index", "frame_index", "problem")


def _nested(frames, wide=None, long=None):
    """Vectors inside a struct, one of them a list of lists; marked rows have another width."""
    wide, long = (F.lit(False) if x is None else x for x in (wide, long))
    points = F.array("action", F.when(wide, F.concat("state", "action")).otherwise(F.col("state")))
    vector = F.when(long, F.concat("action", "state")).otherwise(F.col("action"))
    return frames.select(*EP, "frame_index", F.struct(vector.alias("vector"), F.struct(points.alias("points")).alias("shape")).alias("pose"))


WIDTHS = {"pose.vector": 2, "pose.shape.points": 2, "pose.shape.points[]": 2}


@query("c10_restored_frames", f"""WITH {t.FRAMES_SQL} SELECT episode_index, frame_index, round(a0,6) AS a0, round(s1,6) AS s1 FROM frames""")
def c10(spark, sf):
    rows = _nested(t.frames(spark, sf))
    restored = merge.restore_schema(rows, rows.schema, WIDTHS)
    point = F.get(F.col("pose.shape.points"), F.lit(1))
    return restored.select("episode_index", "frame_index", F.round(F.get("pose.vector", F.lit(0)), 6).alias("a0"), F.round(F.get(point, F.lit(1)), 6).alias("s1"))


@query("c10_width_violations", f"""WITH {t.FRAMES_SQL} SELECT episode_index, frame_index, 'pose.vector' AS path, 4 AS length FROM frames WHERE a1 = 0
  UNION ALL SELECT episode_index, frame_index, 'pose.shape.points[]', 4 FROM frames WHERE a0 > 100""")
def c10_widths(spark, sf):
    rows = _nested(t.frames(spark, sf), F.get("action", F.lit(0)) > 100, F.get("action", F.lit(1)) == 0)
    return merge.width_violations(rows, WIDTHS).select("episode_index", "frame_index", "path", "length")


@query("j12_task_remap", """WITH s AS (SELECT 0 AS source_ord, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS row_ord, o_orderpriority AS task FROM (SELECT DISTINCT o_orderpriority FROM orders)
  UNION ALL SELECT 1, dense_rank() OVER (ORDER BY p_type) - 1, p_type FROM (SELECT DISTINCT p_type FROM part)
  UNION ALL SELECT 2, dense_rank() OVER (ORDER BY task DESC) - 1, task FROM (SELECT DISTINCT c_mktsegment AS task FROM customer UNION SELECT DISTINCT p_type FROM part)),
  f AS (SELECT task, min(source_ord * 1000 + row_ord) AS k FROM s GROUP BY 1), n AS (SELECT task, row_number() OVER (ORDER BY k) - 1 AS merged_index FROM f)
  SELECT source_ord, row_ord AS task_index, task, merged_index FROM s JOIN n USING (task)""")
def j12(spark, sf):
    from episodica.operators.series import with_position
    priorities = t.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("task")).distinct()
    types = t.table(spark, sf, "part").select(F.col("p_type").alias("task")).distinct()
    mixed = t.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("task")).union(types).distinct()
    parts = [with_position(priorities, [], ["task"], "row_ord"), with_position(types, [], ["task"], "row_ord")]
    last = with_position(mixed, [], ["task"], "_up")
    top = last.agg(F.max("_up").alias("top")).scalar()
    parts.append(last.select("task", (top - F.col("_up")).alias("row_ord")))
    tasks = None
    for i, part in enumerate(parts):
        one = part.select(F.lit(i).alias("source_ord"), "row_ord", F.col("row_ord").alias("task_index"), "task")
        tasks = one if tasks is None else tasks.unionByName(one)
    return merge.union_tasks(tasks)


@query("j17_video_shards", """WITH f AS (SELECT l_returnflag AS camera, l_suppkey AS path, min(l_orderkey) AS ord FROM lineitem GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY ord, path) - 1 AS k FROM f)
  SELECT l_orderkey AS ord, l_returnflag AS camera, l_suppkey AS path, l_linenumber, l_partkey, n.k // 1000 AS chunk_index, n.k % 1000 AS file_index FROM lineitem JOIN n ON n.camera = l_returnflag AND n.path = l_suppkey""")
def j17(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ord"), F.col("l_returnflag").alias("camera"), F.col("l_suppkey").alias("path"), "l_linenumber", "l_partkey")
    return merge.dedupe_video_shards(rows, ["camera", "path"])


@query("j17_shifted_segments", f"""WITH {t.FRAMES_SQL}, {motion_sql(0.6, 6, 2)}, o AS (SELECT *, sum(length) OVER (ORDER BY episode_index) - length AS base FROM bounds)
  SELECT episode_index, round(base/10.0 + start/10.0,6) AS from_timestamp, round(base/10.0 + "end"/10.0,6) AS to_timestamp FROM o""")
def j17_shift(spark, sf):
    bounds = motion_bounds(spark, sf)
    segments = series.with_offsets(t.episodes(spark, sf)).select(
        *EP, (F.col("dataset_from_index") / t.FPS).alias("from_timestamp"), (F.col("dataset_to_index") / t.FPS).alias("to_timestamp"))
    return merge.shift_segments(segments, bounds, t.FPS).select("episode_index", *r("from_timestamp", "to_timestamp"))


# --- augmentation: vectors as 16-wide action and state ------------------------------------------------------------------

NAMES = [f"{arm}_arm_{i}" for arm in augment.ARMS for i in range(7)] + ["right_gripper_0", "left_gripper_0"]


def augmented(spark, sf):
    rows = t.vectors(spark, sf).select(*EP, "frame_index", F.lit(0).cast("bigint").alias("index"), "vec_id",
                                       F.slice("embedding", 1, 16).alias("action"), F.slice("embedding", 17, 16).alias("state"))
    episodes = series.episode_lengths(rows)
    chosen = episodes.filter("length >= 45")
    draws = augment.draw_offsets(chosen, [1, 2, 3, 4, 5, 6, 7], 2, 11)
    at = augment.arm_positions(NAMES)
    return augment.augment(rows, episodes, draws, at, at, 16)


_AUG = """ve AS (SELECT CAST(label AS BIGINT) AS e, count(*) AS length FROM embeddings GROUP BY 1), ch AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS p, length FROM ve WHERE length >= 45),
plan AS (SELECT e, e AS o, 0 AS copy, length FROM ve UNION ALL SELECT e, (SELECT count(*) FROM ve) + (c.copy-1)*(SELECT count(*) FROM ch) + p, c.copy, length FROM ch, (SELECT unnest([1,2]) AS copy) c),
po AS (SELECT *, sum(length) OVER (ORDER BY o) - length AS base FROM plan)"""


@query("u07_augment_layout", f"""WITH {t.VECTORS_SQL}, {_AUG} SELECT o AS episode_index, frame_index, CAST(base + frame_index AS BIGINT) AS "index", copy, e AS source_episode_index, vec_id,
  round(CAST(embedding[15] AS DOUBLE),6) AS gripper FROM po JOIN vecs ON vecs.episode_index = e""")
def u07(spark, sf):
    x = augmented(spark, sf)
    return x.select("episode_index", "frame_index", "index", "copy", "source_episode_index", "vec_id", F.round(F.get("action", F.lit(14)).cast("double"), 6).alias("gripper"))


@query("u07_augment_offsets")
def u07_offsets(spark, sf):
    episodes = series.episode_lengths(t.vectors(spark, sf))
    draws = augment.draw_offsets(episodes, [1, 2, 3, 4, 5, 6, 7], 2, 11)
    return draws.select("episode_index", "copy", F.posexplode("offsets_deg").alias("joint", "offset_deg"))


@query("a30_augment_summary", """WITH ve AS (SELECT label, count(*) AS length FROM embeddings GROUP BY 1)
  SELECT count(*) AS episodes, CAST(sum(length) AS BIGINT) AS frames, 3*count(*) FILTER (length >= 45) AS added_episodes, CAST(3*sum(length) FILTER (length >= 45) AS BIGINT) AS added_frames,
  count(*) + 3*count(*) FILTER (length >= 45) AS total_episodes, CAST(sum(length) + 3*sum(length) FILTER (length >= 45) AS BIGINT) AS total_frames,
  round((count(*) + 3*count(*) FILTER (length >= 45))/count(*),6) AS video_factor FROM ve""")
def a30(spark, sf):
    episodes = series.episode_lengths(t.vectors(spark, sf))
    return augment.summary(episodes, episodes.filter("length >= 45"), 3).withColumn("video_factor", F.round("video_factor", 6))


@query("u02_shared_dimensions", """WITH a AS (SELECT c_nationkey AS dataset, c_mktsegment AS name FROM customer GROUP BY ALL), s AS (SELECT dataset, name FROM (SELECT DISTINCT s_nationkey AS dataset FROM supplier), (VALUES ('BUILDING'),('MACHINERY'),('HOUSEHOLD')) v(name))
  SELECT DISTINCT dataset, name FROM a JOIN s USING (dataset, name)""")
def u02(spark, sf):
    action = t.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("dataset")).agg(F.collect_set("c_mktsegment").alias("action_names"))
    state = t.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("dataset"), F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("HOUSEHOLD")).alias("state_names")).distinct()
    return action.join(state, "dataset").select("dataset", F.explode(F.array_intersect("action_names", "state_names")).alias("name"))


@query("c04_invalid_annotation_lists", """WITH c AS (SELECT conv_id AS episode_index, count(*) AS n, count(DISTINCT role) AS d FROM conversations GROUP BY 1) SELECT episode_index FROM c WHERE d < n""")
def c04_invalid(spark, sf):
    atoms = t.atoms(spark, sf)
    return curate.invalid_annotation_lists(atoms, ["role"]).select("episode_index")
