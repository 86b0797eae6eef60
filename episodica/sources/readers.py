"""Scans of recorded data sets on disk (layouts v2.x and v3.0) as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.functions import language as rules
from episodica.functions.numeric import is_finite
from episodica.operators.series import EPISODE, attach, running, with_position
from episodica.session import materialize
from episodica.sources.files import exists

FEATURE_TYPE = "struct<dtype:string,shape:array<int>,names:string>"
HEADER_TYPE = (
    "codebase_version string, robot_type string, fps double, total_episodes bigint, total_frames bigint, total_tasks bigint, "
    f"chunks_size bigint, splits map<string,string>, features map<string,{FEATURE_TYPE}>")
STATE = "observation.state"
PROGRESS_COLUMNS = ["progress_sparse", "progress_dense", "progress"]


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_header(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """The header document of a data set as one row."""
    return parse_headers(_whole(spark, f"{root}/meta/info.json").select(F.lit(dataset_id).alias("dataset_id"), "value"))


def parse_headers(documents: DataFrame) -> DataFrame:
    """Header documents ``(dataset_id, value)`` as rows; a document that is not an object is an error."""
    parsed = documents.select("dataset_id", F.from_json("value", HEADER_TYPE, {"mode": "FAILFAST"}).alias("h"))
    refused = F.raise_error(F.lit("header must be a JSON object")).cast(parsed.schema["dataset_id"].dataType)
    return parsed.select(F.when(F.col("h").isNull(), refused).otherwise(F.col("dataset_id")).alias("dataset_id"), "h.*")


def feature_names(names: Column) -> Column:
    """Element names: a list, or the first value of (nested) objects; NULL when none are declared."""
    inner = F.get(F.map_values(F.from_json(names, "map<string,string>")), F.lit(0))
    deeper = F.get(F.map_values(F.from_json(inner, "map<string,string>")), F.lit(0))
    as_list = lambda c: F.from_json(c, "array<string>")
    return (
        F.when(names.startswith("["), as_list(names))
        .when(inner.startswith("["), as_list(inner))
        .when(deeper.startswith("["), as_list(deeper))
    )


def read_features(header: DataFrame) -> DataFrame:
    """``(dataset_id, ord, feature, dtype, shape, names)`` in declaration order."""
    entries = header.select("dataset_id", F.posexplode(F.map_entries("features")).alias("ord", "e"))
    return entries.select("dataset_id", "ord", F.col("e.key").alias("feature"), "e.value.dtype", "e.value.shape",
                          feature_names(F.col("e.value.names")).alias("names"))


def read_splits(header: DataFrame) -> DataFrame:
    return header.select("dataset_id", "total_episodes", F.explode("splits").alias("name", "range"))


def frame_schema(features: Sequence[T.Row]) -> T.StructType:
    """Spark schema of the declared features: scalars stay scalars, vectors become arrays, N-d shapes are flat."""
    # Fixed mapping of declared types; unsigned types widen, float16 is read as float.
    kinds = {"bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
             "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
             "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "str": T.StringType()}
    fields = []
    for f in features:
        if f.dtype in ("video", "image"):
            continue
        if f.dtype == "language":
            kind = rules.PERSISTENT_TYPE if f.feature == rules.PERSISTENT else rules.EVENT_TYPE
            fields.append(T.StructField(f.feature, T._parse_datatype_string(kind)))
            continue
        base = kinds[f.dtype]
        scalar = list(f.shape) == [1] and f.feature not in ("action", STATE)
        fields.append(T.StructField(f.feature, base if scalar else T.ArrayType(base)))
    return T.StructType(fields)


def scan_frames(spark: SparkSession, root: str, dataset_id: str, columns: Sequence[str] | None = None,
                schema: T.StructType | None = None) -> DataFrame:
    """All frame shards of either layout with their storage place (``_file``, ``_row``).

    Only the wanted columns are read. ``observation.state`` is named ``state``.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if schema is not None:
        reader = reader.schema(schema)
    raw = reader.parquet(f"{root}/data")
    wanted = [c for c in raw.columns if columns is None or c in columns or (c == STATE and "state" in columns)]
    picked = [F.col(f"`{c}`").alias("state" if c == STATE else c) for c in wanted]
    return raw.select(F.lit(dataset_id).alias("dataset_id"), *picked, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def scan_tasks(spark: SparkSession, root: str, dataset_id: str, version: str) -> DataFrame:
    """Task texts from JSON lines or Parquet; the text is in ``task``, ``name`` or an unnamed index column."""
    if version.startswith("v3"):
        raw = spark.read.parquet(f"{root}/meta/tasks.parquet")
    else:
        raw = spark.read.schema("task_index bigint, task string, name string").json(f"{root}/meta/tasks.jsonl")
    texts = [F.col(c) for c in ("task", "name", "__index_level_0__") if c in raw.columns]
    return raw.select(F.lit(dataset_id).alias("dataset_id"), F.col("task_index").cast("bigint").alias("task_index"), F.coalesce(*texts).alias("task"))


def scan_episodes(spark: SparkSession, root: str, dataset_id: str, version: str) -> DataFrame:
    """Episode metadata of all shards. Column names with slashes stay as they are and need back-quotes."""
    if version.startswith("v3"):
        raw = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/meta/episodes")
    else:
        raw = spark.read.schema("episode_index bigint, tasks array<string>, length bigint").json(f"{root}/meta/episodes.jsonl")
    return raw.withColumn("dataset_id", F.lit(dataset_id))


def episode_slice(frames: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows of one episode by global index; an empty range means one row. Prunes Parquet row groups."""
    end = stop if stop > start else start + 1
    return frames.filter((F.col("index") >= start) & (F.col("index") < end))


def cameras_of(columns: Sequence[str]) -> list[str]:
    return sorted({c.split("/")[1] for c in columns if c.startswith("videos/") and c.count("/") == 2})


def episode_videos(episodes: DataFrame, cameras: Sequence[str] | None = None, margin: float = 0.05) -> DataFrame:
    """Camera columns as rows: shard, first time and last time of each episode's video segment.

    Missing times default to 0 and 30 seconds; a layout without segments gets 0 and NULL.
    """
    cams = list(cameras if cameras is not None else cameras_of(episodes.columns))

    def at(cam: str, field: str, default) -> Column:
        name = f"videos/{cam}/{field}"
        return F.coalesce(F.col(f"`{name}`"), F.lit(default)) if name in episodes.columns else F.lit(default)

    if not any(c.startswith("videos/") for c in episodes.columns):
        rows = F.explode(F.array(*[F.lit(c) for c in cams])).alias("camera")
        return episodes.select(*EPISODE, rows).select(
            *EPISODE, "camera", F.lit(None).cast("bigint").alias("chunk_index"), F.lit(None).cast("bigint").alias("file_index"),
            F.lit(0.0).alias("first_time"), F.lit(None).cast("double").alias("last_time"))
    parts = F.array(*[F.struct(
        F.lit(c).alias("camera"), at(c, "chunk_index", 0).cast("bigint").alias("chunk_index"), at(c, "file_index", 0).cast("bigint").alias("file_index"),
        at(c, "from_timestamp", 0.0).cast("double").alias("from_timestamp"),
        # zero counts as missing, as in the viewer
        F.coalesce(F.nullif(at(c, "to_timestamp", 30.0).cast("double"), F.lit(0.0)), F.lit(30.0)).alias("to_timestamp")) for c in cams])
    return episodes.select(*EPISODE, F.explode(parts).alias("v")).select(
        *EPISODE, "v.camera", "v.chunk_index", "v.file_index", F.col("v.from_timestamp").alias("first_time"),
        F.greatest(F.lit(0.0), F.col("v.to_timestamp") - margin).alias("last_time"))


def video_segments(episodes: DataFrame) -> DataFrame:
    """``(episode, camera, from_timestamp, to_timestamp)`` as stored; a time that is missing stays missing."""
    cameras = cameras_of(episodes.columns)
    stored = lambda c, name: F.col(f"`videos/{c}/{name}`").cast("double").alias(name)
    parts = F.array(*[F.struct(F.lit(c).alias("camera"), stored(c, "from_timestamp"), stored(c, "to_timestamp")) for c in cameras])
    return episodes.select(*EPISODE, F.explode(parts).alias("v")).select(*EPISODE, "v.*")


def video_neighbours(videos: DataFrame, episode_index: int, radius: int) -> DataFrame:
    return videos.filter(F.col("episode_index").between(episode_index - radius, episode_index + radius))


def chart_features(features: DataFrame, version: str, excluded: Sequence[str]) -> DataFrame:
    """Features a chart can show, with the reason why the others are left out."""
    limit = 3 if version.startswith("v3") else 2
    reason = (
        F.when(F.col("feature").isin(list(excluded)), "bookkeeping")
        .when(F.size("shape") >= limit, "dimensions")
        .when(~F.col("dtype").isin("float32", "int32"), "dtype")
        .when(F.size("shape") != 1, "shape"))
    return features.withColumn("ignored", reason)


def progress_series(progress: DataFrame, durations: DataFrame) -> DataFrame:
    """Optional progress curve: first progress column with a finite value in the episode, spread over its duration.

    ``durations(episode, duration)``. Rows are ordered by ``index``, else ``frame_index``, else the given ``_row``.
    """
    extra = sorted(c for c in progress.columns if c.startswith("progress_") and c not in PROGRESS_COLUMNS)
    names = [c for c in PROGRESS_COLUMNS if c in progress.columns] + extra
    numbers = {c: F.when(is_finite(F.col(c).try_cast("double")), F.col(c).try_cast("double")) for c in names}
    present = progress.groupBy(*EPISODE).agg(*[F.count(numbers[c]).alias(f"_n{i}") for i, c in enumerate(names)])
    chosen = F.coalesce(*[F.when(F.col(f"_n{i}") > 0, F.lit(c)) for i, c in enumerate(names)])
    points = F.coalesce(*[F.when(F.col(f"_n{i}") > 0, F.col(f"_n{i}")) for i in range(len(names))])
    picked = present.select(*EPISODE, chosen.alias("column"), points.alias("_n"))
    value = F.coalesce(*[F.when(F.col("column") == c, numbers[c]) for c in names])
    place = F.coalesce(*[F.col(c).try_cast("double") for c in ("index", "frame_index") if c in progress.columns], F.col("_row").cast("double"))
    # all rows are numbered first; then what belongs to an episode is joined on (episode, block), so a hot one is spread
    placed = with_position(progress.withColumn("_place", place), EPISODE, ["_place", "_row"], "frame_index")
    counted = progress.groupBy(*EPISODE).agg(F.count("*").alias("length"))
    per = materialize(picked.filter("column is not null").join(durations, EPISODE).join(counted, EPISODE), "progress_columns")
    rows = attach(placed, per).select(*EPISODE, "frame_index", "column", value.alias("progress"), "_n", "duration").filter("progress is not null")
    points = running(rows, EPISODE, "frame_index", F.lit(1), "_i", inclusive=False)
    share = F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1))
    return points.select(*EPISODE, "column", F.col("_i").cast("bigint").alias("point"), (share * F.greatest("duration", F.lit(0.0))).alias("timestamp"), "progress")


def read_stats(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """Stored statistics in long form ``(feature, statistic, dim, value, shape)``; nested arrays are read flat.

    A leaf that is not a number makes its value NULL.
    """
    parsed = _whole(spark, path).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("feature", "s"))
    rows = parsed.select("feature", F.explode("s").alias("statistic", "raw"))
    return rows.select(F.lit(dataset_id).alias("dataset_id"), "feature", "statistic", _depth(F.col("raw")).alias("depth"),
                       F.posexplode_outer(_flat(F.col("raw"))).alias("dim", "value"))


def _flat(raw: Column) -> Column:
    inner = F.concat(F.lit("["), F.regexp_replace(raw, r"[\[\]]", ""), F.lit("]"))
    return F.transform(F.from_json(inner, "array<string>"), lambda v: F.when(~raw.contains('"'), v.try_cast("double")))


def _depth(raw: Column) -> Column:
    return F.length(F.regexp_extract(raw, r"^(\[*)", 1))


def read_episode_stats(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """Per-episode statistics from JSON lines in long form; the raw line is kept for its checks."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", "episode_index bigint, stats map<string,map<string,string>>").alias("r"))
    rows = parsed.select("r.episode_index", F.explode_outer("r.stats").alias("feature", "s")).select(
        "episode_index", "feature", F.explode_outer("s").alias("statistic", "raw"))
    return rows.select(F.lit(dataset_id).alias("dataset_id"), "episode_index", "feature", "statistic", F.posexplode_outer(_flat(F.col("raw"))).alias("dim", "value"))


def episode_stats_problems(spark: SparkSession, path: str) -> DataFrame:
    """Lines without exactly the two keys, repeated episodes, and values that are not finite numbers."""
    lines = spark.read.text(path)
    keys = F.array_sort(F.json_object_keys("value"))
    shape = lines.filter(keys.isNull() | (keys != F.array(F.lit("episode_index"), F.lit("stats")))).select(
        F.lit(None).cast("bigint").alias("episode_index"), F.lit("keys").alias("problem"))
    ids = lines.select(F.get_json_object("value", "$.episode_index").try_cast("bigint").alias("episode_index"))
    repeated = ids.groupBy("episode_index").count().filter("count > 1").select("episode_index", F.lit("duplicate").alias("problem"))
    values = read_episode_stats(spark, path, "").filter("statistic is not null")
    broken = values.filter(~is_finite(F.col("value")) | F.col("value").isNull()).select("episode_index", F.lit("value").alias("problem")).distinct()
    return shape.unionByName(repeated).unionByName(broken)


SIDECAR_ATOM = f"struct<role:string,content:string,style:string,timestamp:double,camera:string,tool_calls:{rules.TOOL_CALLS}>"
SIDECAR_TYPE = (
    f"episodes map<string,struct<atoms:array<{SIDECAR_ATOM}>,subtasks:array<struct<label:string,start:double>>,"
    "high_levels:array<struct<start:double,user_prompt:string,robot_utterance:string>>>>")


def read_annotation_sidecar(spark: SparkSession, path: str, dataset_id: str, lines: bool = False) -> DataFrame:
    """Annotation atoms per episode; records of the first format are migrated to atoms.

    ``lines`` reads documents of one line each, as ``write_annotation_sidecar`` makes them.
    """
    doc = (spark.read.text(path) if lines else _whole(spark, path)).select(F.explode(F.from_json("value", SIDECAR_TYPE)["episodes"]).alias("key", "p"))
    base = doc.select(F.lit(dataset_id).alias("dataset_id"), F.col("key").cast("bigint").alias("episode_index"), "p")
    new = base.filter("p.atoms is not null").select(*EPISODE, F.posexplode("p.atoms").alias("ord", "a")).select(
        *EPISODE, "ord", "a.role", "a.content", "a.style", F.col("a.timestamp").alias("ts"), "a.camera", "a.tool_calls")
    old = base.filter("p.atoms is null")
    none_s, none_t = F.lit(None).cast("string"), F.lit(None).cast(rules.TOOL_CALLS)
    subtasks = old.select(*EPISODE, F.posexplode("p.subtasks").alias("ord", "s")).filter("s.label is not null and s.start is not null").select(
        *EPISODE, "ord", F.lit("assistant").alias("role"), F.col("s.label").alias("content"), F.lit("subtask").alias("style"),
        F.col("s.start").alias("ts"), none_s.alias("camera"), none_t.alias("tool_calls"))
    # list order: all subtasks first, then prompt and utterance of each high-level record
    high = old.select(*EPISODE, F.coalesce(F.size("p.subtasks"), F.lit(0)).alias("_n"), F.posexplode("p.high_levels").alias("i", "h"))
    start = F.coalesce("h.start", F.lit(0.0))
    prompts = high.filter("h.user_prompt <> ''").select(
        *EPISODE, (F.greatest("_n", F.lit(0)) + 2 * F.col("i")).alias("ord"), F.lit("user").alias("role"), F.col("h.user_prompt").alias("content"),
        F.lit("interjection").alias("style"), start.alias("ts"), none_s.alias("camera"), none_t.alias("tool_calls"))
    spoken = high.filter("h.robot_utterance <> ''").select(
        *EPISODE, (F.greatest("_n", F.lit(0)) + 2 * F.col("i") + 1).alias("ord"), F.lit("assistant").alias("role"), none_s.alias("content"),
        none_s.alias("style"), start.alias("ts"), none_s.alias("camera"), rules.say_call(F.col("h.robot_utterance")).alias("tool_calls"))
    return new.unionByName(subtasks).unionByName(prompts).unionByName(spoken)


def has_sidecar(spark: SparkSession, path: str) -> bool:
    return exists(spark, path)
