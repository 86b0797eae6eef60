"""Annotation and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.functions import language as rules
from episodica.functions import text
from episodica.operators import language as lang
from episodica.operators import series
from episodica.plans import tables as t
from episodica.plans.registry import query, r

EP = series.EPISODE

# Turns as frames and atoms; the length of a turn decides between the styles of the assistant.
_STYLED = """styled AS (SELECT conv_id AS episode_index, turn AS ord, role, text AS content, CAST(turn AS DOUBLE) AS ts,
  CASE WHEN role = 'system' THEN 'task_aug' WHEN role = 'user' THEN 'interjection' WHEN length(text) > 200 THEN 'plan'
   WHEN length(text) < 80 THEN 'memory' ELSE 'subtask' END AS style FROM conversations),
cf AS (SELECT conv_id AS episode_index, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame_index, CAST(turn AS DOUBLE) AS tstamp,
  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""


def styled(spark, sf):
    size = F.length("content")
    style = F.when(F.col("role") == "system", "task_aug").when(F.col("role") == "user", "interjection").when(size > 200, "plan").when(
        size < 80, "memory").otherwise("subtask")
    return t.atoms(spark, sf).withColumn("style", style)


def turns(spark, sf):
    """Every turn is a frame of its conversation."""
    return t.once(spark, sf, "turns", lambda: series.with_position(
        t.atoms(spark, sf).select(*EP, "ord", "role", "content", F.col("ts").alias("timestamp")), EP, ["ord"], "frame_index"))


_TIMED = f"""{t.FRAMES_SQL}, er AS (SELECT episode_index, event_id, seconds FROM frames WHERE event_type = 'error'),
oth AS (SELECT episode_index, seconds, row_number() OVER (PARTITION BY episode_index ORDER BY seconds) - 1 AS frame_index FROM frames WHERE event_type <> 'error')"""


def _errors(spark, sf):
    return t.frames(spark, sf).join(t.tasks(spark, sf).filter("task = 'error'"), ["dataset_id", "task_index"]).select(*EP, "event_id", F.col("seconds").alias("ts"))


def _others(spark, sf):
    return t.once(spark, sf, "other_frames", lambda: series.with_position(
        t.frames(spark, sf).join(t.tasks(spark, sf).filter("task <> 'error'"), ["dataset_id", "task_index"]).select(*EP, F.col("seconds").alias("timestamp")),
        EP, ["timestamp"], "frame_index"))


@query("j06_nearest_frame", f"""WITH {_TIMED}, x AS (SELECT e.episode_index, e.event_id, o.frame_index, o.seconds AS f,
  row_number() OVER (PARTITION BY e.event_id ORDER BY abs(o.seconds - e.seconds), o.frame_index) AS k FROM er e JOIN oth o USING (episode_index))
  SELECT episode_index, event_id, frame_index, round(f,6) AS frame_time FROM x WHERE k = 1""")
def j06(spark, sf):
    x = lang.nearest_frame(_errors(spark, sf), _others(spark, sf))
    return x.select("episode_index", "event_id", "frame_index", *r("frame_time"))


@query("j06_nearest_turn_ties", f"""WITH {_STYLED}, f AS (SELECT episode_index, frame_index, tstamp FROM cf WHERE role <> 'user'),
  x AS (SELECT a.episode_index, a.ord, f.frame_index, f.tstamp, row_number() OVER (PARTITION BY a.episode_index, a.ord ORDER BY abs(f.tstamp - a.ts), f.frame_index) AS k
   FROM styled a JOIN f USING (episode_index) WHERE a.role = 'user')
  SELECT episode_index, ord, frame_index, tstamp AS frame_time FROM x WHERE k = 1""")
def j06_ties(spark, sf):
    frames = turns(spark, sf).filter("role <> 'user'")
    x = lang.nearest_frame(styled(spark, sf).filter("role = 'user'"), frames)
    # a conversation without other turns has no frame to snap to
    return x.filter("frame_index is not null").select("episode_index", "ord", "frame_index", "frame_time")


@query("j07_active_at", f"""WITH {_STYLED} SELECT f.episode_index, f.frame_index, (SELECT max(a.ord) FROM styled a WHERE a.episode_index = f.episode_index
  AND a.style = 'subtask' AND a.ts <= f.tstamp) AS active_ord FROM cf f""")
def j07(spark, sf):
    probes = turns(spark, sf).select(*EP, "frame_index", "timestamp")
    x = lang.active_at(probes, styled(spark, sf), "subtask")
    return x.select("episode_index", "frame_index", F.col("active.ord").alias("active_ord"))


@query("j08_events_at", f"""WITH {_TIMED} SELECT f.episode_index, f.frame_index, e.event_id AS atom FROM frames f JOIN er e
  ON e.episode_index = f.episode_index AND abs(e.seconds - f.seconds) <= 7200""")
def j08(spark, sf):
    probes = t.frames(spark, sf).select(*EP, "frame_index", F.col("seconds").alias("timestamp"))
    x = lang.within(probes, _errors(spark, sf).withColumnRenamed("event_id", "atom"), 7200.0)
    return x.select("episode_index", "frame_index", "atom")


@query("w06_spans", f"""WITH {_STYLED}, dur AS (SELECT episode_index, max(n) AS d FROM cf GROUP BY 1)
  SELECT a.episode_index, a.ord, a.style, CASE WHEN a.style IN ('subtask','plan','task_aug') THEN 'span' ELSE 'tick' END AS kind,
  CASE WHEN a.style = 'task_aug' THEN 0.0 ELSE ts END AS start,
  CASE WHEN a.style IN ('subtask','plan') THEN coalesce(lead(ts) OVER (PARTITION BY a.episode_index, a.style ORDER BY ts, ord), d)
    WHEN a.style = 'task_aug' THEN d ELSE ts END AS "end" FROM styled a JOIN dur USING (episode_index)""")
def w06(spark, sf):
    durations = turns(spark, sf).groupBy(*EP).agg(F.count("*").cast("double").alias("duration"))
    return lang.spans(styled(spark, sf), durations).drop("dataset_id")


@query("t01_canonical_order", f"""WITH {_STYLED} SELECT episode_index, ord, row_number() OVER (PARTITION BY episode_index
  ORDER BY floor(ts/4), style, role, ord) - 1 AS position FROM styled""")
def t01(spark, sf):
    rows = styled(spark, sf).withColumn("ts", F.floor(F.col("ts") / 4))  # equal times exercise the further keys
    return lang.canonical_order(rows).select("episode_index", "ord", "position")


# every conversation loses its first and last turn
_PROJECT = f"""{_STYLED}, b AS (SELECT episode_index, 1 AS s, max(n) - 1 AS e FROM cf GROUP BY 1 HAVING max(n) > 2),
sn AS (SELECT a.*, cf.frame_index AS f, s, e FROM styled a JOIN cf ON cf.episode_index = a.episode_index AND cf.turn = a.ord JOIN b ON b.episode_index = a.episode_index),
pr AS (SELECT episode_index, 'language_persistent' AS "column", CAST(NULL AS BIGINT) AS frame_index, CAST(f - s AS FLOAT) AS ts, ord, style FROM sn
   WHERE style IN ('task_aug','subtask','plan','memory') AND f >= s AND f < e
 UNION ALL SELECT episode_index, 'language_persistent', NULL, 0, ord, style FROM sn WHERE style = 'task_aug' AND f < s
 UNION ALL SELECT episode_index, 'language_persistent', NULL, 0, max(ord), style FROM sn WHERE style IN ('subtask','plan') AND f < s GROUP BY episode_index, style
 UNION ALL SELECT episode_index, 'language_events', f - s, NULL, ord, style FROM sn WHERE style = 'interjection' AND f >= s AND f < e)"""


def _projected(spark, sf):
    frames = turns(spark, sf)
    bounds = frames.groupBy(*EP).agg(F.count("*").alias("n")).filter("n > 2").select(*EP, F.lit(1).alias("start"), (F.col("n") - 1).alias("end"))
    return lang.project(styled(spark, sf), frames, bounds, 1.0)


@query("c03_project_annotations", f"""WITH {_PROJECT} SELECT episode_index, "column", frame_index, ts, ord, style FROM pr""")
def c03(spark, sf):
    return _projected(spark, sf).select("episode_index", "column", "frame_index", "ts", "ord", "style")


@query("w11_carry_over", f"""WITH {_PROJECT} SELECT episode_index, ord, style FROM pr WHERE ts = 0 AND style <> 'memory'""")
def w11(spark, sf):
    return _projected(spark, sf).filter("ts = 0 and style <> 'memory'").select("episode_index", "ord", "style")


@query("c03_nested_frames", f"""WITH {_PROJECT}, fr AS (SELECT cf.episode_index, cf.frame_index - 1 AS frame_index FROM cf JOIN b USING (episode_index) WHERE cf.frame_index >= s AND cf.frame_index < e),
  p AS (SELECT episode_index, count(*) AS persistent, string_agg(style, ',' ORDER BY ts, style, ord) AS styles FROM pr WHERE frame_index IS NULL GROUP BY 1),
  v AS (SELECT episode_index, frame_index, count(*) AS events FROM pr WHERE frame_index IS NOT NULL GROUP BY ALL)
  SELECT episode_index, frame_index, coalesce(persistent,0) AS persistent, coalesce(styles,'') AS styles, coalesce(events,0) AS events
  FROM fr LEFT JOIN p USING (episode_index) LEFT JOIN v USING (episode_index, frame_index)""")
def c03_nested(spark, sf):
    frames = turns(spark, sf)
    bounds = frames.groupBy(*EP).agg(F.count("*").alias("length")).filter("length > 2").select(
        *EP, F.lit(1).alias("start"), (F.col("length") - 1).alias("end"), "length")
    kept = series.attach(frames.select(*EP, "frame_index"), bounds).filter("frame_index >= start and frame_index < end").select(
        *EP, (F.col("frame_index") - F.col("start")).alias("frame_index"))
    n = lang.nest(_projected(spark, sf), kept)
    return n.select("episode_index", "frame_index", F.size("language_persistent").alias("persistent"),
                    F.array_join("language_persistent.style", ",").alias("styles"), F.size("language_events").alias("events"))


@query("c04_materialize_annotations", f"""WITH {_STYLED}, f AS (SELECT episode_index, frame_index, tstamp FROM cf WHERE role <> 'user'),
  x AS (SELECT a.episode_index, a.ord, a.style, a.ts, f.frame_index, row_number() OVER (PARTITION BY a.episode_index, a.ord ORDER BY abs(f.tstamp - a.ts), f.frame_index) AS k
   FROM styled a LEFT JOIN f USING (episode_index))
  SELECT episode_index, ord, CASE WHEN style = 'interjection' THEN 'language_events' ELSE 'language_persistent' END AS "column",
  CASE WHEN style = 'interjection' THEN frame_index END AS frame_index, CASE WHEN style <> 'interjection' THEN CAST(ts AS FLOAT) END AS ts FROM x WHERE k = 1""")
def c04(spark, sf):
    x = lang.materialize_atoms(styled(spark, sf), turns(spark, sf).filter("role <> 'user'"))
    return x.select("episode_index", "ord", "column", "frame_index", "ts")


def _nested(spark, sf):
    """Frames with list columns: system and assistant turns persist, user turns are events listed twice."""
    none = F.lit(None)
    atom = F.struct("role", "content", F.when(F.col("role") == "system", "task_aug").otherwise("subtask").alias("style"),
                    F.col("timestamp").cast("float").alias("timestamp"), none.cast("string").alias("camera"), none.cast(rules.TOOL_CALLS).alias("tool_calls"))
    event = F.struct("role", "content", F.lit("interjection").alias("style"), none.cast("string").alias("camera"), none.cast(rules.TOOL_CALLS).alias("tool_calls"))
    rows = turns(spark, sf)
    lasting = F.when(F.col("role") == "user", F.array().cast(rules.PERSISTENT_TYPE)).otherwise(F.array(atom, atom).cast(rules.PERSISTENT_TYPE))
    events = F.when(F.col("role") == "user", F.array(event, event).cast(rules.EVENT_TYPE)).otherwise(F.array().cast(rules.EVENT_TYPE))
    return rows.select(*EP, "frame_index", "timestamp", lasting.alias("language_persistent"), events.alias("language_events"))


@query("c05_extract_atoms", f"""WITH {_STYLED}, p AS (SELECT episode_index, min(frame_index) AS frame_index FROM cf WHERE role <> 'user' GROUP BY 1)
  SELECT episode_index, 'language_persistent' AS "column", CAST(NULL AS BIGINT) AS frame_index, cf.tstamp AS ts, cf.role FROM cf JOIN p USING (episode_index, frame_index)
  UNION ALL SELECT episode_index, 'language_events', frame_index, tstamp, role FROM cf, range(2) WHERE role = 'user'""")
def c05(spark, sf):
    return lang.extract_atoms(_nested(spark, sf)).select("episode_index", "column", "frame_index", "ts", "role")


@query("w12_broadcast_consistency", """WITH c AS (SELECT conv_id AS episode_index, count(*) AS n, count(*) FILTER (role <> 'user') AS p FROM conversations GROUP BY 1)
  SELECT episode_index FROM c WHERE p > 0 AND n > 1""")
def w12(spark, sf):
    return lang.inconsistent_broadcast(_nested(spark, sf)).select("episode_index")


@query("j05_annotation_overlay", f"""WITH {_STYLED}, ann AS (SELECT DISTINCT episode_index FROM styled WHERE role = 'system')
  SELECT episode_index, ord, content FROM styled WHERE episode_index NOT IN (SELECT episode_index FROM ann)
  UNION ALL SELECT episode_index, ord, upper(role) FROM styled WHERE role = 'user' AND episode_index IN (SELECT episode_index FROM ann)""")
def j05(spark, sf):
    atoms = styled(spark, sf)
    annotated = atoms.filter("role = 'system'")
    new = atoms.filter("role = 'user'").withColumn("content", F.upper("role"))
    return lang.overlay(atoms, annotated, new).select("episode_index", "ord", "content")


@query("c04_unique_atoms", f"""WITH {_STYLED} SELECT episode_index, role, min(ord) AS ord FROM styled GROUP BY 1, 2""")
def c04_unique(spark, sf):
    atoms = styled(spark, sf).select(*EP, "ord", "role", F.lit("same").alias("content"), F.lit(0.0).alias("ts"))
    return lang.unique_atoms(atoms).select("episode_index", "role", "ord")


@query("f17_style_column", f"""WITH {_STYLED} SELECT style, CASE WHEN style = 'interjection' THEN 'language_events' ELSE 'language_persistent' END AS "column", count(*) AS atoms
  FROM styled GROUP BY ALL""")
def f17(spark, sf):
    return styled(spark, sf).groupBy("style", rules.column_for_style(F.col("style")).alias("column")).agg(F.count("*").alias("atoms"))


@query("f16_atom_problems", f"""WITH {_STYLED}, c AS (SELECT *, CASE WHEN length(content) > 300 THEN 'observation.top' END AS camera FROM styled)
  SELECT episode_index, ord, CASE WHEN length(trim(content, ' ')) = 0 THEN 'empty' WHEN camera IS NOT NULL THEN 'camera' END AS problem FROM c
  WHERE length(trim(content, ' ')) = 0 OR camera IS NOT NULL""")
def f16(spark, sf):
    rows = styled(spark, sf).withColumn("camera", F.when(F.length("content") > 300, "observation.top"))
    problem = rules.atom_problem(F.col("role"), F.col("content"), F.col("style"), F.col("ts"), F.col("camera"), F.lit(None).cast(rules.TOOL_CALLS))
    return rows.select("episode_index", "ord", problem.alias("problem")).filter("problem is not null")


# Answers built from events: the type picks the shape, the value decides whether the coordinates are inside the unit square.
_VQA = """v AS (SELECT event_id, event_type, value, k, CASE event_type
  WHEN 'click' THEN '{"detections":[{"label":"cup","bbox_format":"xyxy","bbox":[0,0,' || CAST(k AS VARCHAR) || ',1]}]}'
  WHEN 'view' THEN '{"label":"cup","point_format":"xy","point":[0.5,' || CAST(k AS VARCHAR) || ']}'
  WHEN 'error' THEN '{"label":"cup","count":' || CAST(k - 50 AS VARCHAR) || '}'
  WHEN 'signup' THEN '{"label":"cup","attribute":"color","value":"' || CASE WHEN k > 50 THEN 'red' ELSE ' ' END || '"}'
  ELSE '{"subject":"cup","relation":"on","object":"table"' || CASE WHEN k > 90 THEN ',"extra":1' ELSE '' END || '}' END AS answer
  FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events))"""


def _answers(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = t.table(spark, sf, "events").withColumn("k", k)
    kind = F.col("event_type")
    answer = (
        F.when(kind == "click", F.concat(F.lit('{"detections":[{"label":"cup","bbox_format":"xyxy","bbox":[0,0,'), "k", F.lit(",1]}]}")))
        .when(kind == "view", F.concat(F.lit('{"label":"cup","point_format":"xy","point":[0.5,'), "k", F.lit("]}")))
        .when(kind == "error", F.concat(F.lit('{"label":"cup","count":'), F.col("k") - 50, F.lit("}")))
        .when(kind == "signup", F.concat(F.lit('{"label":"cup","attribute":"color","value":"'), F.when(F.col("k") > 50, "red").otherwise(" "), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"subject":"cup","relation":"on","object":"table"'), F.when(F.col("k") > 90, ',"extra":1').otherwise(""), F.lit("}"))))
    return rows.select("event_id", "event_type", "value", "k", answer.alias("answer"))


@query("f14_vqa_answers", f"""WITH {_VQA} SELECT event_id, CASE event_type WHEN 'click' THEN 'bbox' WHEN 'view' THEN 'keypoint' WHEN 'error' THEN 'count' WHEN 'signup' THEN 'attribute' ELSE 'spatial' END AS kind,
  CASE event_type WHEN 'click' THEN k BETWEEN 0 AND 1 WHEN 'view' THEN k BETWEEN 0 AND 1 WHEN 'error' THEN k >= 50 WHEN 'signup' THEN k > 50 ELSE k <= 90 END AS valid FROM v""")
def f14(spark, sf):
    a = F.col("answer")
    return _answers(spark, sf).select("event_id", rules.vqa_kind(a).alias("kind"), rules.vqa_valid(a).alias("valid"))


@query("f15_bbox_normalise", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount,6) AS x1, round(l_tax,6) AS y1,
  round(CASE WHEN l_returnflag = 'A' THEN l_discount + l_quantity ELSE l_quantity END,6) AS x2, round(CASE WHEN l_returnflag = 'A' THEN l_tax + l_extendedprice ELSE l_extendedprice END,6) AS y2,
  CASE WHEN greatest(l_quantity, l_extendedprice) <= 1.5 THEN 'unit' WHEN greatest(l_quantity, l_extendedprice) <= 1000 THEN 'grid' ELSE 'pixels' END AS space FROM lineitem""")
def f15(spark, sf):
    box = rules.bbox_corners(F.array("l_discount", "l_tax", "l_quantity", "l_extendedprice"), F.when(F.col("l_returnflag") == "A", "xywh").otherwise("xyxy"))
    c = [F.round(F.get(box, F.lit(i)), 6).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *c,
                                                 rules.coordinate_space(F.col("l_quantity"), F.col("l_extendedprice")).alias("space"))


@query("p14_camera_match", """WITH p AS (SELECT page_id, CASE WHEN length(url) > 45 THEN regexp_extract(url, '^https?://([a-z]+)', 1) END AS camera FROM pages)
  SELECT page_id FROM p WHERE camera IS NULL OR camera = 'www'""")
def p14(spark, sf):
    camera = F.when(F.length("url") > 45, F.regexp_extract("url", "^https?://([a-z]+)", 1))
    return t.table(spark, sf, "pages").withColumn("camera", camera).filter(rules.camera_matches(F.col("camera"), "www")).select("page_id")


@query("j08_answers_on_screen", f"""WITH {t.FRAMES_SQL}, v AS (SELECT * FROM frames WHERE event_type = 'view')
  SELECT f.episode_index, f.frame_index, v.event_id AS atom FROM frames f JOIN v ON v.episode_index = f.episode_index AND abs(v.seconds - f.seconds) < 3600
  AND (v.a0 < 100 OR v.a0 >= 150)""")
def j08_screen(spark, sf):
    fr = t.frames(spark, sf)
    views = fr.join(t.tasks(spark, sf).filter("task = 'view'"), ["dataset_id", "task_index"])
    value = F.get("action", F.lit(0))
    atoms = views.select(*EP, F.col("event_id").alias("atom"), F.col("seconds").alias("ts"), F.lit("vqa").alias("style"), F.lit("assistant").alias("role"),
                         F.when(value >= 150, "observation.top").when(value >= 100, "observation.side").alias("camera"))
    probes = fr.select(*EP, "frame_index", F.col("seconds").alias("timestamp"))
    return lang.vqa_on_screen(atoms, probes, "observation.top", 3600.0).select("episode_index", "frame_index", "atom")


@query("p15_task_text", f"""WITH {t.FRAMES_SQL}, e AS (SELECT DISTINCT episode_index, n FROM frames),
  w AS (SELECT f.episode_index, f.frame_index, CASE WHEN a1 > 60 THEN 'say ' || CAST(CAST(a1 AS INTEGER) AS VARCHAR) END AS i1, CASE WHEN a0 > 50 THEN 'then wait' END AS i2, n FROM frames f),
  s AS (SELECT episode_index, frame_index, concat_ws(chr(10), i1, i2) AS words,
    CASE WHEN frame_index = 0 THEN 0 WHEN frame_index = n//2 THEN 1 WHEN frame_index = n-1 THEN 2 END AS o FROM w),
  said AS (SELECT episode_index, arg_min(words, o) AS said FROM s WHERE o IS NOT NULL AND words <> '' GROUP BY 1)
  SELECT e.episode_index, CASE WHEN n > 75 THEN 'long' || chr(10) || 'episode' ELSE coalesce(said, (SELECT f.event_type FROM frames f WHERE f.episode_index = e.episode_index AND f.frame_index = 0)) END AS task_text
  FROM e LEFT JOIN said USING (episode_index)""")
def p15(spark, sf):
    fr = t.frames(spark, sf)
    k = F.get("action", F.lit(1))
    spoken = fr.select(*EP, "frame_index", "task_index", F.when(k > 60, F.concat(F.lit("say "), k.cast("int"))).alias("language_instruction"),
                       F.when(F.get("action", F.lit(0)) > 50, "then wait").alias("language_instruction_2"))
    episodes = t.episodes(spark, sf).select(*EP, F.when(F.col("length") > 75, F.array(F.lit("long"), F.lit("episode"))).otherwise(F.array().cast("array<string>")).alias("tasks"))
    return lang.task_text(spoken, episodes, t.tasks(spark, sf), ["language_instruction", "language_instruction_2"]).select("episode_index", "task_text")


@query("j01_frames_with_tasks", """SELECT event_id, event_type AS task FROM events""")
def j01(spark, sf):
    from episodica.operators.curate import with_task
    return with_task(t.frames(spark, sf), t.tasks(spark, sf)).select("event_id", "task")


@query("f01_name_key", """SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '   ' || p_brand || ' ', '\\s+', ' ', 'g'))) AS name_key,
  CASE WHEN length(trim(regexp_replace(p_name || ' ' || p_brand, '\\s+', ' ', 'g'))) > 20 THEN 'too_long' END AS problem FROM part""")
def f01(spark, sf):
    raw = F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand", F.lit(" "))
    return t.table(spark, sf, "part").select("p_partkey", text.name_key(raw).alias("name_key"), text.name_problem(text.clean_name(raw), 20).alias("problem"))


@query("f03_split_range", """SELECT o_orderkey, o_orderkey AS start, o_orderkey + o_custkey AS "end" FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderstatus <> 'F'""")
def f03(spark, sf):
    rows = t.table(spark, sf, "orders")
    written = F.concat("o_orderkey", F.when(F.col("o_orderstatus") == "F", ":").otherwise("-"), F.col("o_orderkey") + F.col("o_custkey"))
    part = text.split_range(written)
    return rows.select("o_orderkey", part["start"].alias("start"), part["end"].alias("end"))


@query("f05_suffix_groups", """WITH s AS (SELECT DISTINCT p_brand || ' | ' || p_type AS series, p_type AS suffix FROM part)
  SELECT CASE WHEN count(*) = 1 THEN min(series) ELSE suffix END AS "group", string_agg(series, ';' ORDER BY series) AS members FROM s GROUP BY suffix""")
def f05(spark, sf):
    s = t.table(spark, sf, "part").select(F.concat("p_brand", F.lit(" | "), "p_type").alias("series"))
    return text.group_by_suffix(s).select("group", F.array_join("members", ";").alias("members"))


@query("f06_joint_match", """WITH j AS (SELECT DISTINCT lower(split_part(p_name,' ',2)) AS joint FROM part), c AS (SELECT dense_rank() OVER (ORDER BY p_type) AS ord, 'action | ' || p_type AS "column", lower(p_type) AS low FROM (SELECT DISTINCT p_type FROM part)),
  c2 AS (SELECT ord, 'state | ' || split_part(p_name,' ',2) AS "column", lower(split_part(p_name,' ',2)) AS suffix FROM (SELECT DISTINCT split_part(p_name,' ',2) AS p2, p_name, 100 + dense_rank() OVER (ORDER BY split_part(p_name,' ',2)) AS ord FROM part))
  SELECT j.joint, min(c2."column") AS "column", 1 AS rule FROM j JOIN c2 ON c2.suffix = j.joint GROUP BY 1""")
def f06(spark, sf):
    part = t.table(spark, sf, "part")
    nouns = part.select(F.split("p_name", " ")[1].alias("noun")).distinct()
    columns = nouns.select((F.lit(100)).alias("ord"), F.concat(F.lit("state | "), "noun").alias("column")).unionByName(
        part.select(F.lit(1).alias("ord"), F.concat(F.lit("action | "), "p_type").alias("column")).distinct())
    return text.match_joints(nouns.select(F.lower("noun").alias("joint")), columns)


@query("f18_canonical_json", """SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def f18(spark, sf):
    return t.table(spark, sf, "orders").select(
        "o_orderkey", text.fingerprint({"status": F.col("o_orderstatus"), "key": F.col("o_orderkey"), "customer": F.col("o_custkey")}).alias("fingerprint"))


@query("f07_rounding", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor((25 - l_quantity)/2 + 0.5) AS BIGINT) AS half_up, round_even((25 - l_quantity)/2, 0) AS half_even FROM lineitem""")
def f07(spark, sf):
    from episodica.functions.numeric import round_half_even, round_half_up
    x = (25 - F.col("l_quantity")) / 2
    return t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", round_half_up(x).alias("half_up"), round_half_even(x).alias("half_even"))


@query("f08_hold_frames", """SELECT event_id, greatest(1, CAST(ceil(value * 0.3) AS BIGINT)) AS frames, CAST(floor(value * 30 / 100.0 + 0.5) AS BIGINT) AS share,
  round(least(greatest(radians(value), 0.5), 2.0),8) AS clipped FROM events""")
def f08(spark, sf):
    from episodica.functions.numeric import clip, hold_frames, percent_count
    v = F.col("value")
    return t.table(spark, sf, "events").select("event_id", hold_frames(v, F.lit(0.3)).alias("frames"), percent_count(v, 30).alias("share"),
                                               F.round(clip(F.radians(v), 0.5, 2.0), 8).alias("clipped"))


@query("f13_array_functions", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  SELECT vec_id, list_position([abs(x - 0.1) for x in v], list_min([abs(x - 0.1) for x in v])) - 1 AS nearest,
  round(list_max([abs(p[1] - p[2]) for p in list_zip(v, list_reverse(v))]),6) AS spread, len(v) = 64 AS complete FROM e""")
def f13(spark, sf):
    from episodica.functions.numeric import finite_vector, max_abs_difference
    v = F.col("embedding").cast("array<double>")
    gaps = F.transform(v, lambda x: F.abs(x - 0.1))
    return t.table(spark, sf, "embeddings").select(
        "vec_id", (F.array_position(gaps, F.array_min(gaps)) - 1).alias("nearest"),
        F.round(max_abs_difference(v, F.reverse(v)), 6).alias("spread"), finite_vector(v, 64).alias("complete"))


@query("p05_to_finite", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0 THEN NULL WHEN l_returnflag = 'R' THEN NULL ELSE round(1.0/l_discount,6) END AS number FROM lineitem""")
def p05(spark, sf):
    from episodica.functions.numeric import to_finite
    written = F.when(F.col("l_returnflag") == "R", "n/a").when(F.col("l_discount") == 0, "Infinity").otherwise((1.0 / F.col("l_discount")).cast("string"))
    return t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(to_finite(written), 6).alias("number"))


@query("f20_values_equal", """SELECT count(*) AS rows, count(*) FILTER (a IS NOT DISTINCT FROM b) AS equal FROM (SELECT CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE ELSE l_discount END AS a,
  CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE ELSE l_tax END AS b FROM lineitem)""")
def f20(spark, sf):
    nan = F.lit(float("nan"))
    a = F.array(F.when(F.col("l_discount") == 0, nan).otherwise(F.col("l_discount")))
    b = F.array(F.when(F.col("l_discount") == 0, nan).otherwise(F.col("l_tax")))
    return t.table(spark, sf, "lineitem").agg(F.count("*").alias("rows"), F.count_if(a.eqNullSafe(b)).alias("equal"))
