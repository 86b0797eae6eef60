"""Lossless merge of data sets: compatibility, normalisation, task union, re-indexing, video shard numbers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.functions.numeric import is_finite
from episodica.operators.series import EPISODE, attach, episode_lengths, with_offsets, with_position

MIN_SOURCES, MAX_SOURCES = 2, 50
FILES_PER_CHUNK = 1000


def check_headers(headers: Sequence[dict], same_robot: bool = False) -> None:
    """Version, fps and (for the summary-combining path) robot type must agree. Headers are one small row per source."""
    if not MIN_SOURCES <= len(headers) <= MAX_SOURCES:
        raise ValueError("a merge takes 2 to 50 sources")
    fields = ["codebase_version", "fps"] + (["robot_type"] if same_robot else [])
    for name in fields:
        if len({str(h.get(name)) for h in headers}) > 1:
            raise ValueError(f"merge sources differ in {name}")


def feature_differences(features: DataFrame) -> DataFrame:
    """Declared features that are not identical in all sources; timestamp may be float32 or float64.

    ``features(source_ord, ord, feature, dtype, shape, names)``.
    """
    total = features.agg(F.count_distinct("source_ord").alias("n")).select("n").scalar()
    dtype = F.when((F.col("feature") == "timestamp") & F.col("dtype").isin("float32", "float64"), "float64").otherwise(F.col("dtype"))
    same = F.to_json(F.struct("ord", dtype.alias("dtype"), "shape", "names"), {"ignoreNullFields": "false"})
    per = features.groupBy("feature").agg(F.count_distinct("source_ord").alias("sources"), F.min(same).alias("_a"), F.max(same).alias("_b"))
    return per.filter((F.col("sources") < total) | (F.col("_a") != F.col("_b"))).select(
        "feature", "sources", (F.col("_a") == F.col("_b")).alias("same_declaration"))


def schema_problems(expected: T.StructType, actual: T.StructType, widths: dict[str, int], nullability: bool = True) -> list[str]:
    """Differences of two physical schemas: order, names, nullability, types of columns that are not normalised."""
    if expected.names != actual.names:
        return [f"columns {actual.names} instead of {expected.names}"]
    problems = []
    for want, got in zip(expected, actual):
        if nullability and want.nullable != got.nullable:
            problems.append(f"{got.name}: nullability differs")
        if got.name in widths:
            if not (isinstance(got.dataType, T.ArrayType) and isinstance(got.dataType.elementType, T.FloatType)):
                problems.append(f"{got.name}: expected an array of float")
        elif got.name == "timestamp":
            if not isinstance(got.dataType, (T.FloatType, T.DoubleType)):
                problems.append("timestamp: expected float or double")
        elif want.dataType != got.dataType:
            problems.append(f"{got.name}: {got.dataType.simpleString()} instead of {want.dataType.simpleString()}")
    return problems


def reconcile(expected: T.DataType, actual: T.DataType, value: Column, widths: dict[str, int], path: str = "") -> tuple[Column, list[str]]:
    """``value`` of the type ``actual`` as ``expected``, and what forbids that.

    Walks through structs and arrays of any depth. Names, their order and the types of all leaves must be the same; only a
    list that has lost its fixed size is repaired: lists named in ``widths`` (``action``, ``pose.points[]``) must have that
    many elements in every row, another length stops the job and names the list.
    """
    if isinstance(expected, T.StructType) and isinstance(actual, T.StructType):
        if expected.names != actual.names:
            return value, [f"{path or 'columns'}: {actual.names} instead of {expected.names}"]
        parts, refused = [], []
        for want, got in zip(expected, actual):
            name = f"{path}.{want.name}" if path else want.name
            part, problems = reconcile(want.dataType, got.dataType, value[want.name], widths, name)
            parts.append(part.alias(want.name))
            refused += problems
        touched = any(p == path or p.startswith((f"{path}.", f"{path}[")) for p in widths) if path else bool(widths)
        return (F.when(value.isNotNull(), F.struct(*parts)) if touched else value), refused
    if isinstance(expected, T.ArrayType) and isinstance(actual, T.ArrayType):
        inner: list[str] = []

        def element(x: Column) -> Column:
            part, problems = reconcile(expected.elementType, actual.elementType, x, widths, f"{path}[]")
            inner[:] = problems
            return part

        nested = any(p.startswith(f"{path}[]") for p in widths)
        out = F.transform(value, element)
        out = out if nested else value
        if path in widths:
            wrong = F.raise_error(F.concat(F.lit(f"{path} has another length than {widths[path]}: "), F.size(value).cast("string"))).cast(actual)
            out = F.when(value.isNull() | (F.size(value) == widths[path]), out).otherwise(wrong)
        return out, list(inner)
    if path in widths:
        return value, [f"{path}: {actual.simpleString()} is no list"]
    return value, [] if expected == actual else [f"{path}: {actual.simpleString()} instead of {expected.simpleString()}"]


def restore_schema(frames: DataFrame, expected: T.StructType, widths: dict[str, int], nullability: bool = False) -> DataFrame:
    """``frames`` checked against the schema of their sources, lists of fixed size counted row by row; refusals are one error."""
    if expected.names != frames.schema.names:
        raise ValueError(f"columns {frames.schema.names} instead of {expected.names}")
    columns, refused = [], []
    for want, got in zip(expected, frames.schema):
        if nullability and want.nullable != got.nullable:
            refused.append(f"{want.name}: nullability differs")
        part, problems = reconcile(want.dataType, got.dataType, F.col(f"`{want.name}`"), widths, want.name)
        columns.append(part.alias(want.name))
        refused += problems
    if refused:
        raise ValueError("; ".join(refused))
    return frames.select(*columns)


def width_violations(frames: DataFrame, widths: dict[str, int], keys: Sequence[str] = (*EPISODE, "frame_index")) -> DataFrame:
    """``(keys, path, length)`` of every list at a path of ``widths`` that has another length; a missing list has none."""
    def member(lists: Column, name: str) -> Column:
        return F.transform(lists, lambda x: x[name])

    def wrong(path: str, width: int) -> Column:
        steps = path.split("[]")
        value = F.array(F.col(steps[0]))
        for step in steps[1:]:  # each ``[]`` opens one level of lists
            value = F.flatten(value)
            for name in [n for n in step.split(".") if n]:
                value = member(value, name)
        sizes = F.filter(F.transform(value, lambda x: F.size(x)), lambda n: n.isNotNull() & (n >= 0) & (n != width))
        return F.transform(sizes, lambda n: F.struct(F.lit(path).alias("path"), n.alias("length")))

    found = [wrong(path, width) for path, width in widths.items()]
    # a missing list on the way leaves nothing to count
    found = [F.coalesce(x, F.array().cast("array<struct<path:string,length:int>>")) for x in found]
    return frames.select(*keys, F.explode(F.concat(*found)).alias("x")).select(*keys, "x.*")


def value_problems(frames: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Rows that cannot be merged without loss: NULL vector, wrong length, NULL or non-finite element, bad time."""
    checks = []
    for name, width in widths.items():
        v = F.col(name)
        checks.append(F.when(v.isNull(), F.struct(F.lit(name).alias("column"), F.lit("null_vector").alias("problem"))).when(
            F.size(v) != width, F.struct(F.lit(name).alias("column"), F.lit("length").alias("problem"))).when(
            F.exists(v, lambda x: x.isNull()), F.struct(F.lit(name).alias("column"), F.lit("null_element").alias("problem"))).when(
            F.exists(v, lambda x: ~is_finite(x)), F.struct(F.lit(name).alias("column"), F.lit("non_finite").alias("problem"))))
    if "timestamp" in frames.columns:
        checks.append(F.when(~is_finite(F.col("timestamp")) | F.col("timestamp").isNull(),
                             F.struct(F.lit("timestamp").alias("column"), F.lit("non_finite").alias("problem"))))
    return frames.select(*EPISODE, "frame_index", F.explode(F.array_compact(F.array(*checks))).alias("p")).select(*EPISODE, "frame_index", "p.*")


def normalize(frames: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Vectors as arrays of float, time as double; a value that the cast would change stops the job."""
    def exact(source: T.DataType, kind: str) -> Callable[[Column], Column]:
        def cast(v: Column) -> Column:
            changed = F.raise_error(F.concat(F.lit(f"not exact as {kind}: "), v.cast("string"))).cast(kind)
            return F.when(v.isNull() | (v.cast(kind).cast(source) == v), v.cast(kind)).otherwise(changed)
        return cast

    out = frames
    for name in widths:
        kind = frames.schema[name].dataType.elementType
        if not isinstance(kind, T.FloatType):
            out = out.withColumn(name, F.transform(name, exact(kind, "float")))
    if "timestamp" in frames.columns:
        kind = frames.schema["timestamp"].dataType
        if not isinstance(kind, (T.FloatType, T.DoubleType)):
            return out.withColumn("timestamp", exact(kind, "double")(F.col("timestamp")))
        out = out.withColumn("timestamp", F.col("timestamp").cast("double"))
    return out


def lost_rows(source: DataFrame, output: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Multiset difference in both directions over ``columns``; empty means lossless. One count with a sign per side."""
    both = source.select(*columns, F.lit(1).alias("_sign")).unionByName(output.select(*columns, F.lit(-1).alias("_sign")))
    odd = both.groupBy(*columns).agg(F.sum("_sign").alias("_n")).filter("_n <> 0")
    return odd.select(*columns, F.when(F.col("_n") > 0, "missing").otherwise("extra").alias("side"),
                      F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_n"))).alias("_copy")).drop("_copy")


def union_tasks(tasks: DataFrame) -> DataFrame:
    """``(source_ord, task_index) → merged id``: first-seen text gets the next id; unused tasks are kept.

    ``tasks(source_ord, row_ord, task_index, task)``.
    """
    first = tasks.groupBy("task").agg(F.min(F.struct("source_ord", "row_ord")).alias("_first"))
    numbered = with_position(first.select("task", "_first.source_ord", "_first.row_ord"), [], ["source_ord", "row_ord"], "merged_index")
    return tasks.join(numbered.select("task", "merged_index"), "task").select("source_ord", "task_index", "task", "merged_index")


def union_frames(sources: Sequence[DataFrame], tasks: DataFrame, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """Frames and lineage of the merged data set; sources in order, timestamps kept, numbers renewed.

    Returns ``frames`` and ``lineage(source_ord, source_episode_index, episode_index, length)``.
    """
    if len(sources) < MIN_SOURCES:
        raise ValueError("a merge takes at least two sources")
    tagged = reduce(DataFrame.unionByName, [s.withColumn("source_ord", F.lit(i)) for i, s in enumerate(sources)])
    keys = ["source_ord", "episode_index"]
    lengths = episode_lengths(tagged, keys)
    placed = with_position(lengths, [], keys, "output_index").select(
        F.lit(dataset_id).alias("dataset_id"), "source_ord", F.col("episode_index").alias("source_episode_index"),
        F.col("output_index").alias("episode_index"), "length")
    lineage = with_offsets(placed)
    mapping = union_tasks(tasks).select("source_ord", "task_index", "merged_index")
    moves = lineage.select("source_ord", F.col("source_episode_index").alias("episode_index"), "length",
                           F.col("episode_index").alias("_episode"), "dataset_from_index")
    rows = attach(tagged, moves, keys).join(mapping, ["source_ord", "task_index"], "left")
    unknown = F.raise_error(F.concat(F.lit("task id without a task: "), F.col("task_index").cast("string"))).cast("bigint")
    task = F.when(F.col("merged_index").isNull() & F.col("task_index").isNotNull(), unknown).otherwise(F.col("merged_index"))
    kept = [c for c in sources[0].columns if c not in ("dataset_id", "episode_index", "index", "task_index")]
    frames = rows.select(
        F.lit(dataset_id).alias("dataset_id"), F.col("_episode").alias("episode_index"),
        (F.col("dataset_from_index") + F.col("frame_index")).alias("index"), task.alias("task_index"), *kept,
        "source_ord", F.col("episode_index").alias("source_episode_index"))
    return frames, lineage.select("source_ord", "source_episode_index", "episode_index", "length", "dataset_from_index", "dataset_to_index")


def dedupe_video_shards(segments: DataFrame, keys: Sequence[str] = ("source_ord", "camera", "path")) -> DataFrame:
    """Dense output file number per camera for distinct shards in first-seen order; segment times stay.

    ``segments(source_ord, camera, path, ord, ...)``, ``ord`` being the output episode order.
    """
    keys = list(keys)
    first = segments.groupBy(*keys).agg(F.min("ord").alias("_first"))
    numbered = with_position(first, ["camera"], ["_first", *[k for k in keys if k != "camera"]], "_file")
    return segments.join(numbered.drop("_first"), keys).withColumn(
        "chunk_index", F.floor(F.col("_file") / FILES_PER_CHUNK)).withColumn("file_index", F.col("_file") % FILES_PER_CHUNK).drop("_file")


def shift_segments(segments: DataFrame, bounds: DataFrame, fps: float) -> DataFrame:
    """Segment times after a trim that keeps the video file: moved by start/fps and end/fps."""
    rows = segments.join(bounds.select(*EPISODE, "start", "end"), EPISODE)
    new_to = F.col("from_timestamp") + F.col("end") / F.lit(float(fps))
    checked = F.when(new_to > F.col("to_timestamp") + 0.5 / fps, F.raise_error(F.lit("trim exceeds its video segment")).cast("double")).otherwise(new_to)
    return rows.withColumn("_to", checked).withColumn("from_timestamp", F.col("from_timestamp") + F.col("start") / F.lit(float(fps))).withColumn(
        "to_timestamp", F.col("_to")).drop("_to", "start", "end")
