"""The test tables seen as episode data.

``events`` has no frame numbers, so a frame table is derived and written once per session and input folder,
as a recorded data set would lie on disk; queries then prune columns and push filters into its Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators.series import EPISODE, lagged, with_position
from episodica.session import materialize

FPS = 10.0
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Result of ``build`` written one time per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = materialize(build(), name)
    return _TABLES[key]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as episodes, their events in time order as frames; action = [value, k], state = previous action."""
    return once(spark, sf_dir, "frames", lambda: _build_frames(spark, sf_dir))


def _build_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", "event_type", F.col("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"))
    # a handful of event types: the task list of the data set
    types = with_position(events.select("event_type").distinct(), [], ["event_type"], "task_index")
    users = events.groupBy("user_id").agg(F.min("us").alias("first_us"))
    users = with_position(users, [], ["user_id"], "episode_index")
    placed = with_position(events, ["user_id"], ["ts", "event_id"], "frame_index")
    rows = placed.join(users, "user_id").join(types, "event_type").select(
        F.lit("events").alias("dataset_id"), "episode_index", "frame_index", "event_id", "task_index",
        ((F.col("us") - F.col("first_us")) / 1e6).alias("seconds"), F.array("value", "k").alias("action"))
    with_state = lagged(rows, {"_prev": "action"})
    indexed = with_position(
        with_state.select(
            "dataset_id", "episode_index", "frame_index", "event_id", "task_index", "seconds",
            (F.col("frame_index") / F.lit(FPS)).alias("timestamp"), "action",
            F.coalesce("_prev", "action").alias("state")),
        [], ["dataset_id", "episode_index", "frame_index"], "index")
    return indexed


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return frames(spark, sf_dir).groupBy(*EPISODE).agg(F.count("*").alias("length"))
    return once(spark, sf_dir, "episodes", build)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        types = table(spark, sf_dir, "events").select(F.col("event_type").alias("task")).distinct()
        return with_position(types, [], ["task"], "task_index").select(
            F.lit("events").alias("dataset_id"), "task_index", "task")
    return once(spark, sf_dir, "tasks", build)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as episodes of 64-wide float vectors in vec_id order."""
    def build() -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select(
            F.lit("embeddings").alias("dataset_id"), F.col("label").cast("bigint").alias("episode_index"), "vec_id", "embedding")
        return with_position(rows, ["dataset_id", "episode_index"], ["vec_id"], "frame_index")
    return once(spark, sf_dir, "vectors", build)


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as language annotations; the turn number is the time."""
    style = F.when(F.col("role") == "system", "task_aug").when(F.col("role") == "user", "interjection").otherwise("subtask")
    return table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("dataset_id"), F.col("conv_id").alias("episode_index"), F.col("turn").alias("ord"),
        "role", F.col("text").alias("content"), style.alias("style"), F.col("turn").cast("double").alias("ts"))


# --- the same tables as SQL common table expressions -----------------------------------------------------------

FRAMES_SQL = """
f0 AS (SELECT e.*, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
              epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us FROM events e),
frames AS (SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS episode_index,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
  row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS idx,
  dense_rank() OVER (ORDER BY event_type) - 1 AS task_index, event_type, event_id,
  us / 1e6 AS seconds,
  (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 10.0::DOUBLE AS tstamp,
  value AS a0, k AS a1,
  lag(value, 1, value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s0,
  lag(k, 1, k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s1,
  count(*) OVER (PARTITION BY user_id) AS n FROM f0),
vals AS (SELECT episode_index, frame_index, n, 0 AS dim, a0 AS value, s0 AS state FROM frames
  UNION ALL SELECT episode_index, frame_index, n, 1, a1, s1 FROM frames),
deltas AS (SELECT * FROM (SELECT *, value - lag(value) OVER (PARTITION BY episode_index, dim ORDER BY frame_index) AS delta,
  state - lag(state) OVER (PARTITION BY episode_index, dim ORDER BY frame_index) AS sdelta FROM vals) WHERE delta IS NOT NULL)
"""

VECTORS_SQL = """
vecs AS (SELECT CAST(label AS BIGINT) AS episode_index, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index,
  vec_id, embedding FROM embeddings),
vvals AS (SELECT episode_index, frame_index, CAST(g.i AS INTEGER) AS dim, CAST(embedding[g.i + 1] AS DOUBLE) AS value
  FROM vecs, (SELECT unnest(range(64)) AS i) g)
"""

ATOMS_SQL = """
atoms AS (SELECT conv_id AS episode_index, turn AS ord, role, text AS content, CAST(turn AS DOUBLE) AS ts,
  CASE role WHEN 'system' THEN 'task_aug' WHEN 'user' THEN 'interjection' ELSE 'subtask' END AS style FROM conversations)
"""
