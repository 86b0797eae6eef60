"""Rule-based validation. Each rule returns issue rows; a data set passes when no row is a FAIL.

Rows of an episode are judged in storage order (``_file``, ``_row``), because frame numbers may be wrong. Positions come
from two-level counting on the dense row numbers of each file, so neither a hot episode nor repeated frame numbers can
gather rows in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.functions.numeric import is_finite
from episodica.functions.text import split_range
from episodica.operators import catalog, relative, stats
from episodica.operators.ranks import quantiles
from episodica.operators.series import EPISODE, lagged, running, with_offsets
from episodica.session import materialize

ISSUE = ["severity", "code", "dataset_id", "episode_index", "feature", "detail"]
POSITION_BLOCK = 65536
# Required feature declarations, index columns and compared statistics.
REQUIRED_FEATURES = ["action", "observation.state", "timestamp", "index", "frame_index", "episode_index", "task_index"]
INDEX_COLUMNS = ["episode_index", "frame_index", "index", "task_index"]
COMPARED = ["min", "max", "mean", "std", "count"]
BOOKKEEPING = ["index", "episode_index", "task_index"]
#: Codes of the rules that judge an episode by its own rows.
EPISODE_CODES = ["frame_index_mismatch", "global_index_mismatch", "episode_index_mismatch", "task_reference_invalid", "timestamp_non_finite", "timestamp_regression",
                 "timestamp_alignment", "feature_shape_mismatch", "feature_type_unsupported", "feature_dtype_mismatch", "feature_non_finite", "constant_sensor", "action_jump"]
NUMERIC_DTYPES = ["bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64"]
PLAIN_DTYPES = ["video", "image", "string", "str", "language"]


def issues(rows: DataFrame, code: str | Column, severity: str = "FAIL", feature: Column | None = None, detail: Column | None = None) -> DataFrame:
    def text(c):
        return (F.lit(None) if c is None else c).cast("string")
    episode = F.col("episode_index").cast("bigint") if "episode_index" in rows.columns else F.lit(None).cast("bigint")
    return rows.select(
        F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"),
        F.col("dataset_id"), episode.alias("episode_index"), text(feature).alias("feature"), text(detail).alias("detail"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count_if(F.col("severity") == "FAIL").alias("failures"), F.count_if(F.col("severity") == "WARN").alias("warnings")
    ).withColumn("passed", F.col("failures") == 0)


# --- header and metadata (V1-V4) ----------------------------------------------------------------------------------------

def header_issues(header: DataFrame, features: DataFrame) -> DataFrame:
    bad = "metadata_schema_invalid"
    total = lambda name, top: F.when(~F.coalesce(F.col(name).between(1, top), F.lit(False)), F.lit(name))
    checks = F.array_compact(F.array(
        total("total_episodes", 1_000_000), total("total_frames", 1_000_000_000_000), total("total_tasks", 1_000_000),
        F.when(~F.coalesce(is_finite(F.col("fps")) & (F.col("fps") > 0), F.lit(False)), F.lit("fps")),
        F.when(~F.coalesce(F.col("codebase_version").isin(catalog.SUPPORTED_VERSIONS), F.lit(False)), F.lit("codebase_version"))))
    of_header = issues(header.select("dataset_id", F.explode(checks).alias("d")), bad, detail=F.col("d"))
    shape_ok = F.coalesce((F.size("shape") > 0) & F.forall("shape", lambda n: n >= 1), F.lit(False))
    dtype_ok = F.coalesce(F.col("dtype").isin(NUMERIC_DTYPES + PLAIN_DTYPES), F.lit(False))
    # as in the format, the dtype of a feature with a bad shape is not looked at
    wrong = features.select("dataset_id", "feature", F.when(~shape_ok, "shape").when(~dtype_ok, "dtype").alias("d")).filter("d is not null")
    needed = header.select("dataset_id", F.explode(F.array(*[F.lit(n) for n in REQUIRED_FEATURES])).alias("feature"))
    absent = needed.join(features.select("dataset_id", "feature"), ["dataset_id", "feature"], "left_anti").withColumn("d", F.lit("missing"))
    return of_header.unionByName(issues(wrong.unionByName(absent), bad, feature=F.col("feature"), detail=F.col("d")))


def split_issues(splits: DataFrame) -> DataFrame:
    """``splits(dataset_id, total_episodes, name, range)`` must tile ``0..total`` without gap or overlap.

    Valid ranges, in the order of their starts, are a chain without overlap exactly when the first starts at 0 and every
    other starts where the one before ends; the chain is complete when it ends at the total.
    """
    bad = "metadata_schema_invalid"
    part = split_range(F.col("range"))
    rows = splits.select("dataset_id", "total_episodes", "name", part["start"].alias("a"), part["end"].alias("b"))
    valid = F.coalesce((F.col("a") < F.col("b")) & (F.col("b") <= F.col("total_episodes")), F.lit(False))
    malformed = issues(rows.filter(~valid), bad, detail=F.concat(F.lit("range "), "name"))
    # a malformed range has no bounds and comes first, so that its data set is still judged
    bounds = rows.select("dataset_id", "total_episodes", *[F.when(valid, F.col(c)).alias(c) for c in ("a", "b")])
    before = F.lag("b").over(Window.partitionBy("dataset_id", "total_episodes").orderBy("a", "b"))
    facts = bounds.withColumn("_gap", F.col("a") != F.coalesce(before, F.lit(0))).groupBy("dataset_id", "total_episodes").agg(
        F.count_if("_gap").alias("_gaps"), F.max("b").alias("_top"))
    tiled = F.col("_gaps") == 0
    found = F.array_compact(F.array(
        F.when(F.col("_top").isNotNull() & ~tiled, F.lit("ranges overlap or leave episodes out")),
        F.when(F.coalesce(F.col("_top") != F.col("total_episodes"), F.lit(True)), F.lit("some episodes are in no range"))))
    return malformed.unionByName(issues(facts.select("dataset_id", F.explode(found).alias("d")), bad, detail=F.col("d")))


def id_issues(ids: DataFrame, key: str, header: DataFrame, total: str) -> DataFrame:
    """Metadata ids must be exactly ``0..total-1``."""
    facts = stats.contiguity(ids.select("dataset_id", key), key, ["dataset_id"])
    rows = header.select("dataset_id", F.col(total).alias("_total")).join(facts, "dataset_id", "left")
    ok = F.coalesce(F.col("contiguous") & (F.col("rows") == F.col("_total")), F.lit(False))
    return issues(rows.filter(~ok).select("dataset_id"), "metadata_schema_invalid", detail=F.lit(key))


def task_text_issues(tasks: DataFrame) -> DataFrame:
    empty = tasks.filter(~F.coalesce(F.length(F.trim("task")) > 0, F.lit(False))).groupBy("dataset_id").agg(F.count("*").alias("n"))
    return issues(empty, "metadata_schema_invalid", detail=F.lit("task texts must not be empty"))


def column_issues(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """Index columns and timestamp must exist; index columns must be stored as integers. One row per episode."""
    integers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    found = [(n, "missing_required_column") for n in [*INDEX_COLUMNS, "timestamp"] if n not in frames.columns]
    found += [(n, "numeric_data_invalid") for n in INDEX_COLUMNS if n in frames.columns and not isinstance(frames.schema[n].dataType, integers)]
    if not found:
        return issues(episodes.limit(0), "missing_required_column")
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in found])).alias("x")
    return issues(episodes.select(*EPISODE, named), F.col("x.c"), feature=F.col("x.n"))


# --- frames (V5-V10) ----------------------------------------------------------------------------------------------------

def with_storage_position(frames: DataFrame, name: str = "pos") -> DataFrame:
    """0-based place of each row among the rows of its episode in storage order."""
    keys = [*EPISODE, "_file"]
    counted = running(frames, keys, "_row", F.lit(1), "_in_file", size=POSITION_BLOCK)
    files = frames.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*EPISODE).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # most episodes lie in one file; only later files of an episode have something to add, and where the join knows that they
    # are few, the rows stay where they are
    later = materialize(files.filter("_before > 0"), "later_files")
    return counted.join(later, keys, "left").select(
        *frames.columns, (F.col("_in_file") - 1 + F.coalesce("_before", F.lit(0))).alias(name))


def index_issues(placed: DataFrame, full: bool = True, lengths: DataFrame | None = None) -> DataFrame:
    """Frame numbers must be 0,1,2,.. in storage order and global numbers must continue across episodes.

    ``lengths`` are those of all episodes where ``placed`` holds only some.
    """
    per = placed.groupBy(*EPISODE).agg(
        F.count("*").alias("length"), F.max(~F.col("frame_index").eqNullSafe(F.col("pos"))).alias("_frame"),
        F.min(F.col("index") - F.col("pos")).alias("_low"), F.max(F.col("index") - F.col("pos")).alias("_high"), F.count("index").alias("_n"))
    found = issues(per.filter("_frame"), "frame_index_mismatch")
    if not full:
        return found
    # ids far outside the range would spread the prefix sum thin, not break it: it sorts by block
    facts = per.select(*EPISODE, "length", "_low", "_high", "_n")
    offsets = with_offsets(facts) if lengths is None else with_offsets(lengths).select(*EPISODE, "dataset_from_index").join(facts, EPISODE)
    start = F.col("dataset_from_index")
    ok = F.coalesce((F.col("_low") == start) & (F.col("_high") == start) & (F.col("_n") == F.col("length")), F.lit(False))
    return found.unionByName(issues(offsets.filter(~ok), "global_index_mismatch"))


def file_episode_issues(frames: DataFrame, pattern: str = r"episode[_=](\d+)") -> DataFrame:
    """Rows whose episode number differs from the one in their file name (one file per episode)."""
    named = F.regexp_extract("_file", pattern, 1).try_cast("bigint")
    wrong = frames.filter(named.isNotNull() & (named != F.col("episode_index")))
    return issues(wrong.select("dataset_id", named.alias("episode_index")).distinct(), "episode_index_mismatch")


def task_issues(frames: DataFrame, episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Unknown task ids, missing task lists and lists that differ from the frames' tasks."""
    used = frames.select(*EPISODE, "task_index").distinct()
    named = used.join(tasks.select("dataset_id", "task_index", "task"), ["dataset_id", "task_index"], "left")
    unknown = issues(named.filter("task is null").select(*EPISODE).distinct(), "task_reference_invalid", detail=F.lit("unknown task"))
    missing = issues(episodes.filter("tasks is null"), "task_reference_invalid", detail=F.lit("no task list"))
    labels = episodes.filter("tasks is not null").join(used.select(*EPISODE).distinct(), EPISODE, "left_semi").select(*EPISODE, F.explode("tasks").alias("task")).distinct()
    real = named.join(episodes.filter("tasks is not null").select(*EPISODE), EPISODE, "left_semi").select(*EPISODE, F.coalesce("task", F.lit("\0unknown")).alias("task")).distinct()
    keys = [*EPISODE, "task"]
    differ = labels.join(real, keys, "left_anti").unionByName(real.join(labels, keys, "left_anti")).select(*EPISODE).distinct()
    return union([unknown, missing, issues(differ, "task_reference_invalid", detail=F.lit("task list differs from frames"))])


def length_issues(frames: DataFrame, episodes: DataFrame, full: bool = True) -> DataFrame:
    """Declared lengths and, where present, declared offsets against the counted frames. Episodes without frames fail."""
    counted = frames.groupBy(*EPISODE).agg(F.count("*").alias("_length"))
    joined = episodes.join(counted, EPISODE, "left")
    found = [issues(joined.filter("_length is null"), "empty_episode"),
             issues(joined.filter(F.col("_length").isNotNull() & ~F.col("length").eqNullSafe(F.col("_length"))), "episode_metadata_mismatch")]
    if "dataset_from_index" in episodes.columns:
        start, end = F.col("dataset_from_index"), F.col("dataset_to_index")
        offsets = with_offsets(counted.withColumnRenamed("_length", "length")).select(*EPISODE, F.col("dataset_from_index").alias("_start"))
        rows = joined.filter("_length is not null").join(offsets, EPISODE)
        ok = (end - start == F.col("_length")) & (F.lit(not full) | (start == F.col("_start")))
        found.append(issues(rows.filter(~F.coalesce(ok, F.lit(False))), "invalid_episode_offsets"))
    return union(found)


def timestamp_steps(frames: DataFrame, position: str = "frame_index") -> DataFrame:
    """Number of steps per episode on which time does not grow."""
    steps = lagged(frames.select(*EPISODE, position, "timestamp"), {"_prev": "timestamp"}, position=position)
    return steps.groupBy(*EPISODE).agg(F.count_if(F.col("timestamp") <= F.col("_prev")).alias("regressions"))


def timestamp_issues(placed: DataFrame, fps: float) -> DataFrame:
    tolerance = max(1e-4, 0.01 / fps)
    steps = lagged(placed.select(*EPISODE, "pos", F.col("timestamp").cast("double").alias("timestamp")), {"_prev": "timestamp"}, position="pos")
    finite = F.coalesce(is_finite(F.col("timestamp")), F.lit(False))
    per = steps.groupBy(*EPISODE).agg(
        F.max(~finite).alias("_bad"), F.max(F.coalesce(F.col("timestamp") <= F.col("_prev"), F.lit(False))).alias("_back"),
        F.max(F.abs(F.col("timestamp") - F.col("pos") / F.lit(float(fps)))).alias("_off"))
    good = per.filter("not _bad")
    return union([issues(per.filter("_bad"), "timestamp_non_finite"), issues(good.filter("_back"), "timestamp_regression"),
                  issues(good.filter(F.col("_off") > tolerance), "timestamp_alignment", detail=F.col("_off"))])


# Fixed ranges of the integer types.
INTEGER_RANGES = {"int8": (-128, 127), "int16": (-32768, 32767), "int32": (-2147483648, 2147483647), "uint8": (0, 255), "uint16": (0, 65535),
                  "uint32": (0, 4294967295)}
PHYSICAL = {**stats.PHYSICAL, "string": "string", "str": "string"}


def feature_issues(placed: DataFrame, features: Sequence, columns: dict[str, str] | None = None) -> DataFrame:
    """Shape, stored type and finiteness of every declared feature: count and first bad row per (episode, feature).

    ``features`` are the declaration rows of one data set; ``columns`` maps feature names to column names.
    """
    columns = {"observation.state": "state", **(columns or {})}
    checks, absent = [], []
    for f in features:
        name = columns.get(f.feature, f.feature)
        if f.dtype == "video":
            continue
        if name not in placed.columns:
            absent.append((f.feature, "feature_shape_mismatch"))
            continue
        if f.dtype == "image":
            absent.append((f.feature, "feature_type_unsupported"))
            continue
        mark = lambda code, bad, feature=f.feature: F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(feature).alias("f"), F.lit(code).alias("c")))
        x, kind = F.col(f"`{name}`"), placed.schema[name].dataType
        if f.dtype == "language":
            checks.append(mark("feature_dtype_mismatch", x.isNull() | F.exists(x, lambda r: r["role"].isNull() | (r["role"] == ""))))
            continue
        is_list = isinstance(kind, T.ArrayType)
        element = kind.elementType if is_list else kind
        width = 1
        for n in f.shape:
            width *= n
        if is_list:
            checks.append(mark("feature_shape_mismatch", F.size(x) != width))
        elif width != 1:
            checks.append(mark("feature_shape_mismatch", F.lit(True)))
        numbers = isinstance(element, (T.NumericType, T.BooleanType))
        wrong = element.simpleString() != PHYSICAL[f.dtype]
        each = (lambda p: F.exists(x, p)) if is_list else (lambda p: p(x))
        if wrong:
            checks.append(mark("feature_dtype_mismatch", F.lit(True)))
        elif f.dtype in INTEGER_RANGES and f.dtype.startswith("u"):
            low, high = INTEGER_RANGES[f.dtype]
            checks.append(mark("feature_dtype_mismatch", each(lambda v: ~v.between(low, high))))
        if numbers and isinstance(element, (T.FloatType, T.DoubleType)) and f.dtype not in ("string", "str"):
            checks.append(mark("feature_non_finite", each(lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))))
        elif f.dtype not in ("string", "str"):
            checks.append(mark("feature_dtype_mismatch", each(lambda v: v.isNull())))
    parts = []
    if checks:
        rows = placed.select(*EPISODE, "pos", F.explode(F.array_compact(F.array(*checks))).alias("x"))
        found = rows.groupBy(*EPISODE, F.col("x.f").alias("f"), F.col("x.c").alias("c")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
        detail = F.concat(F.col("n").cast("string"), F.lit(" rows, first "), F.col("first").cast("string"))
        parts.append(issues(found, F.col("c"), feature=F.col("f"), detail=detail))
    if absent:
        named = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(c).alias("c")) for f, c in absent])).alias("x")
        parts.append(issues(placed.select(*EPISODE).distinct().select(*EPISODE, named), F.col("x.c"), feature=F.col("x.f")))
    return union(parts) if parts else issues(placed.limit(0), "feature_shape_mismatch")


def motion_issues(placed: DataFrame, vectors: Sequence[str] = ("action", "state"), jump: float = 10_000.0) -> DataFrame:
    """Warnings: constant elements of longer episodes, and action steps beyond the general limit.

    Vectors with NULL, NaN or infinite elements are judged by the feature rules and left out here.
    """
    rows = placed.select(*EPISODE, F.col("pos").alias("frame_index"), *vectors)
    groups = [*EPISODE, "feature", "dim"]
    moments = stats.merge_moments(stats.block_moments(rows, list(vectors)), groups)
    constant = moments.filter((F.col("n") > 2) & (F.sqrt("var") < 1e-9)).groupBy(*EPISODE, "feature").agg(
        F.array_sort(F.collect_list("dim")).alias("_dims"))  # one entry per vector element
    found = [issues(constant, "constant_sensor", "WARN", feature=F.col("feature"), detail=F.to_json("_dims"))]
    if "action" in vectors:
        steps = lagged(rows.select(*EPISODE, "frame_index", F.col("action").cast("array<double>").alias("_x")), {"_prev": "_x"})
        leap = F.array_max(F.zip_with("_x", "_prev", lambda a, b: F.abs(a - b)))
        per = steps.groupBy(*EPISODE).agg(F.count("*").alias("_n"), F.max(F.when(is_finite(leap), leap)).alias("_leap"))
        found.append(issues(per.filter((F.col("_n") > 2) & (F.col("_leap") > jump)), "action_jump", "WARN", feature=F.lit("action"), detail=F.col("_leap")))
    return union(found)


def total_issues(frames: DataFrame, header: DataFrame) -> DataFrame:
    """Frame total against the header, and a warning for an episode much longer than the median."""
    lengths = frames.groupBy(*EPISODE).agg(F.count("*").cast("double").alias("length"))
    wrong = issues(stats.check_total_frames(frames, header), "frame_total_mismatch")
    median = quantiles(lengths, ["dataset_id"], "length", {"median": 0.5})
    top = lengths.groupBy("dataset_id").agg(F.max("length").alias("_top")).join(median, "dataset_id")
    limit = F.greatest(F.lit(2), F.floor(F.col("median") * 5))
    return wrong.unionByName(issues(top.filter(F.col("_top") > limit), "abnormal_episode_length", "WARN", detail=F.col("_top")))


# --- statistics (V12-V14) -----------------------------------------------------------------------------------------------

def stored_stats_issues(stored: DataFrame, features: DataFrame) -> DataFrame:
    """Schema of stored statistics ``(dataset_id, feature, statistic, depth, dim, value)`` against the declarations."""
    declared = features.filter(~F.col("dtype").isin("string", "str", "language", "image", "video")).select(
        "dataset_id", "feature", F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, n: a * n).alias("width"), F.size("shape").alias("_depth"))
    groups = ["dataset_id", "feature", "statistic"]
    facts = stored.groupBy(*groups).agg(
        F.count("dim").alias("n"), F.count_if(F.col("value").isNull() | ~is_finite(F.col("value"))).alias("_bad"), F.max("depth").alias("depth"),
        F.min("value").alias("_low"), F.max(F.col("value") != F.floor("value")).alias("_fraction"))
    have = stored.select("dataset_id", "feature").distinct()
    none = declared.join(have, ["dataset_id", "feature"], "left_anti")
    wanted = declared.join(have, ["dataset_id", "feature"], "left_semi").withColumn("statistic", F.explode(F.array(*[F.lit(s) for s in COMPARED])))
    rows = wanted.join(facts, groups, "left")
    present, usable = F.col("n").isNotNull(), (F.col("n") > 0) & (F.col("_bad") == 0)
    is_count = F.col("statistic") == "count"
    code = (
        F.when(~present, "stats_field_missing").when(~usable, "stats_value_invalid")
        .when(is_count & ((F.col("n") != 1) | (F.col("depth") != 1) | (F.col("_low") <= 0) | F.col("_fraction")), "stats_count_invalid")
        .when(~is_count & ((F.col("n") != F.col("width")) | (F.col("depth") != F.col("_depth"))), "stats_shape_mismatch")
        .when((F.col("statistic") == "std") & (F.col("_low") < 0), "stats_value_invalid"))
    found = rows.select("dataset_id", "feature", "statistic", code.alias("c")).filter("c is not null")
    pairs = stored.filter(F.col("statistic").isin("min", "max")).groupBy("dataset_id", "feature", "dim").agg(
        F.max(F.when(F.col("statistic") == "min", F.col("value"))).alias("_min"), F.max(F.when(F.col("statistic") == "max", F.col("value"))).alias("_max"))
    crossed = pairs.filter("_min > _max").select("dataset_id", "feature").distinct()
    return union([issues(none, "stats_feature_missing", feature=F.col("feature")), issues(found, F.col("c"), feature=F.col("feature"), detail=F.col("statistic")),
                  issues(crossed, "stats_value_invalid", feature=F.col("feature"), detail=F.lit("min exceeds max"))])


def long_stats(wide: DataFrame, dataset_id: str, names: Sequence[str]) -> DataFrame:
    """Statistic rows ``(feature, dim)`` as ``(feature, statistic, dim, value)``; count is kept for element 0 only."""
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value")) for n in names])).alias("e")
    rows = wide.select(F.lit(dataset_id).alias("dataset_id"), "feature", "dim", entries).select("dataset_id", "feature", "e.statistic", "dim", "e.value")
    return rows.filter((F.col("statistic") != "count") | (F.col("dim") == 0))


def compare_stats(stored: DataFrame, recomputed: DataFrame, code: str = "stats_value_mismatch", severity: str = "FAIL") -> DataFrame:
    """Full outer comparison on (feature, statistic, dim): |stored - new| within 1e-7 + 1e-5 |new|, counts exact."""
    keys = ["dataset_id", "feature", "statistic", "dim"]
    a = stored.select(*keys, F.col("value").alias("_stored"))
    rows = a.join(recomputed.select(*keys, F.col("value").alias("_new")), keys, "full_outer")
    close = F.abs(F.col("_stored") - F.col("_new")) <= 1e-7 + 1e-5 * F.abs(F.col("_new"))
    ok = F.when(F.col("statistic") == "count", F.col("_stored") == F.col("_new")).otherwise(close)
    wrong = rows.filter(~F.coalesce(ok, F.lit(False))).select("dataset_id", "feature", "statistic").distinct()
    return issues(wrong, code, severity, feature=F.col("feature"), detail=F.col("statistic"))


def _numeric(kind: T.DataType) -> bool:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return isinstance(kind, (T.NumericType, T.BooleanType))


def numeric_shapes(frames: DataFrame, declared: Sequence, columns: dict[str, str] | None = None) -> dict[str, tuple[str, list[int]]]:
    """Column and shape of every declared numeric feature that is stored with its declared type."""
    columns, found = {"observation.state": "state", **(columns or {})}, {}
    for f in declared:
        name = f.feature if f.feature in frames.columns else columns.get(f.feature, f.feature)
        if f.dtype not in NUMERIC_DTYPES or name not in frames.columns or not f.shape or min(f.shape) < 1:
            continue
        kind = frames.schema[name].dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if kind.simpleString() == PHYSICAL[f.dtype]:
            found[f.feature] = (name, list(f.shape))
    return found


def episode_state(frames: DataFrame, shapes: dict[str, tuple[str, list[int]]]) -> DataFrame:
    """Mergeable statistics ``(episode, feature, dim, n, min, max, anchor, shift, var)`` of the episodes, kept with a data set.

    An episode in which a feature has another shape or a number that is not finite has one row of element -1 for it; there
    ``n`` counts those frames and ``var`` is 1 where a shape is wrong.
    """
    checks = []
    for feature, (column, shape) in shapes.items():
        vector = stats.flat_vector(frames, column)
        wide = ~F.coalesce(F.size(vector) == math.prod(shape), F.lit(False))
        whole = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
        checks.append(F.when(wide | ~whole, F.struct(F.lit(feature).alias("feature"), wide.cast("double").alias("wide"))))
    bad = frames.select(*EPISODE, F.explode(F.array_compact(F.array(*checks))).alias("x")).groupBy(*EPISODE, F.col("x.feature").alias("feature")).agg(
        F.count("*").alias("n"), F.max("x.wide").alias("var"))
    bad = materialize(bad, "bad_values")
    groups = [*EPISODE, "feature", "dim"]
    names = F.create_map(*[F.lit(x) for feature, (column, _) in shapes.items() for x in (column, feature)])
    moments = stats.merge_moments(stats.block_moments(frames, [column for column, _ in shapes.values()]), groups).withColumn("feature", names[F.col("feature")])
    none = F.lit(None).cast("double")
    good = moments.join(bad, [*EPISODE, "feature"], "left_anti").select(*groups, "n", "min", "max", "anchor", "shift", "var")
    return good.unionByName(bad.select(*EPISODE, "feature", F.lit(-1).alias("dim"), "n", none.alias("min"), none.alias("max"), none.alias("anchor"), none.alias("shift"), "var"))


def stats_issues(state: DataFrame, stored: DataFrame, features: DataFrame, dataset_id: str, official: bool = False) -> DataFrame:
    """Stored statistics of every declared numeric feature against those that the episodes' states add up to.

    A feature with a bad value cannot be compared; one whose stored statistics break their schema is judged there. In
    ``official`` data sets differences of the bookkeeping features are warnings.
    """
    sources = state.filter("dim = -1").groupBy("feature").agg(F.min("episode_index").alias("episode_index"), F.max("var").alias("_wide"))
    code = F.when(F.col("_wide") == 1, "stats_source_invalid").otherwise("stats_source_non_finite")
    spoilt = issues(sources.withColumn("dataset_id", F.lit(dataset_id)), code, feature=F.col("feature"))
    broken = stored_stats_issues(stored, features)
    comparable = stored.filter(F.col("statistic").isin(COMPARED)).join(broken.select("feature").distinct(), "feature", "left_anti")
    fresh = stats.finish_moments(stats.merge_moments(state.filter("dim >= 0"), ["feature", "dim"]), ["feature", "dim"])
    have = materialize(long_stats(fresh, dataset_id, COMPARED).join(sources.select("feature"), "feature", "left_anti"), "fresh_stats")
    declared = features.filter(F.col("dtype").isin(NUMERIC_DTYPES)).select("dataset_id", "feature")
    away = comparable.select("feature").distinct().join(have.select("feature").distinct(), "feature", "left_anti").join(declared, "feature")
    gone = issues(away, "stats_feature_unavailable", feature=F.col("feature"))
    both = comparable.join(have.select("feature").distinct(), "feature", "left_semi")
    wanted = have.join(both.select("feature").distinct(), "feature", "left_semi")
    wrong = compare_stats(both, wanted)
    if official:
        soft = F.col("feature").isin(BOOKKEEPING) & (F.col("detail") != "count")
        wrong = wrong.withColumn("severity", F.when(soft, "WARN").otherwise(F.col("severity"))).withColumn(
            "code", F.when(soft, "official_bookkeeping_stats_difference").otherwise(F.col("code")))
    return union([broken, spoilt, gone, wrong])


def relative_issues(frames: DataFrame, stored: DataFrame, dims: Sequence[int], width: int, chunk: int, dataset_id: str) -> DataFrame:
    """A stored chunk-relative action profile against a recomputed one, quantiles included."""
    fresh = relative.profile(frames, dims, width, chunk).withColumn("feature", F.lit("action"))
    return compare_stats(stored, long_stats(fresh, dataset_id, stats.STATISTICS), "relative_stats_mismatch")


def content_issues(before: DataFrame, after: DataFrame, dataset_id: str) -> DataFrame:
    moved = catalog.changed(before, after).select(F.lit(dataset_id).alias("dataset_id"), "path", "change")
    return issues(moved, "content_changed", detail=F.concat_ws(" ", "change", "path"))


# --- video metadata (V16, V17) ------------------------------------------------------------------------------------------

def segment_issues(videos: DataFrame, lengths: DataFrame, fps: float) -> DataFrame:
    """Segment times must be finite, increasing and as long as the episode. ``videos(episode, camera, from_timestamp, to_timestamp)``."""
    start, end = F.col("from_timestamp"), F.col("to_timestamp")
    rows = videos.join(lengths, EPISODE)
    ok = is_finite(start) & is_finite(end) & (start >= 0) & (end > start) & (F.abs(end - start - F.col("length") / F.lit(float(fps))) <= 0.5 / fps + 1e-9 * F.abs(end - start))
    return issues(rows.filter(~F.coalesce(ok, F.lit(False))), "video_segment_metadata_invalid", feature=F.col("camera"))


def pts_issues(pts: DataFrame, fps: float, keys: Sequence[str] = ("dataset_id", "path")) -> DataFrame:
    """Frame times of a video: start near 0, grow, and step by about 1/fps. ``pts(path, n, pts)``, ``n`` dense from 0."""
    keys = list(keys)
    steps = lagged(pts.select(*keys, "n", "pts"), {"_prev": "pts"}, keys, "n")
    gap, want = F.col("pts") - F.col("_prev"), 1.0 / fps
    bad = F.when(F.col("n") == 0, F.abs("pts") > 0.5 / fps).otherwise((gap <= 0) | (F.abs(gap - want) > 0.001 + 0.10 * want))
    wrong = steps.groupBy(*keys).agg(F.max(F.coalesce(bad, F.lit(True))).alias("_bad")).filter("_bad")
    return issues(wrong, "video_pts_mismatch", feature=F.col("path"))


def stream_rate_issues(streams: DataFrame, fps: float) -> DataFrame:
    """``streams(dataset_id, path, stream_fps)`` must be within one per cent of the data set rate."""
    near = F.abs(F.col("stream_fps") - fps) <= F.greatest(F.lit(0.01), 0.01 * F.greatest(F.abs("stream_fps"), F.lit(float(fps))))
    return issues(streams.filter(~F.coalesce(near, F.lit(False))), "video_fps_mismatch", feature=F.col("path"))


def segment_pts_issues(videos: DataFrame, lengths: DataFrame, pts: DataFrame, fps: float) -> DataFrame:
    """First and last frame of each segment against the frame times of its video.

    ``videos(episode, camera, path, from_timestamp, to_timestamp)``; the edges are looked up by (path, frame number).
    """
    first = F.bround(F.col("from_timestamp") * F.lit(float(fps))).cast("bigint")
    rows = videos.join(lengths, EPISODE).withColumn("_first", first).withColumn("_last", F.col("_first") + F.col("length") - 1)
    wanted = rows.select(*EPISODE, "camera", "path", F.explode(F.array(
        F.struct(F.col("_first").alias("n"), F.col("from_timestamp").alias("want")),
        F.struct(F.col("_last").alias("n"), (F.col("to_timestamp") - F.lit(1.0 / fps)).alias("want")))).alias("e")).select(*EPISODE, "camera", "path", "e.n", "e.want")
    found = wanted.join(pts.select("dataset_id", "path", "n", "pts"), ["dataset_id", "path", "n"], "left").groupBy(*EPISODE, "camera").agg(
        F.max(F.col("pts").isNull()).alias("_short"), F.max(F.abs(F.col("pts") - F.col("want")) > 0.5 / fps + 1e-9).alias("_off"))
    return issues(found.filter("_short"), "video_frame_mismatch", feature=F.col("camera")).unionByName(
        issues(found.filter("not _short and _off"), "video_segment_pts_mismatch", feature=F.col("camera")))


# --- whole run ----------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Dataset:
    """What a validation reads. ``stats`` are the stored statistics, ``videos`` the segments of the episodes, ``pts`` and
    ``streams`` frame times and rates of the videos, ``relative`` the stored chunk-relative profile with its ``dims``,
    ``width`` and ``chunk``, ``manifest`` makes the content manifest anew on every call."""

    dataset_id: str
    header: DataFrame
    features: DataFrame
    splits: DataFrame
    tasks: DataFrame
    episodes: DataFrame
    frames: DataFrame
    stats: DataFrame | None = None
    videos: DataFrame | None = None
    vectors: dict[str, str] = field(default_factory=lambda: {"action": "action", "observation.state": "state"})
    pts: DataFrame | None = None
    streams: DataFrame | None = None
    relative: dict | None = None
    manifest: Callable[[], DataFrame] | None = None
    stats_deferred: bool = False
    official: bool = False


@dataclass(frozen=True)
class Previous:
    """A finished validation: its issues, the episodes' states and the manifest it read, all written tables."""

    issues: DataFrame
    state: DataFrame
    manifest: DataFrame


def dirty_episodes(data: Dataset, before: DataFrame, after: DataFrame) -> DataFrame:
    """Episodes with a row in a data file that differs between two manifests, and those that have lost all their rows."""
    moved = materialize(catalog.changed(before, after).filter("path like '%.parquet'").select("path"), "changed_files")
    places = data.frames.select(*EPISODE, "_file").distinct()
    # one row per episode and file; manifest paths are relative to the data set
    name = F.element_at(F.split("path", "/data/"), -1)
    ends = moved.select(F.regexp_replace(name, "^data/", "").alias("_end"))
    files = places.withColumn("_end", F.element_at(F.split("_file", "/data/"), -1))
    touched = files.join(ends, "_end", "left_semi").select(*EPISODE)
    empty = data.episodes.select(*EPISODE).join(places.select(*EPISODE), EPISODE, "left_anti")
    return touched.unionByName(empty).distinct()


def episode_issues(data: Dataset, frames: DataFrame, episodes: DataFrame, declared: Sequence, fps: float, full: bool, lengths: DataFrame | None = None) -> list[DataFrame]:
    """The rules that judge an episode by its own rows. ``lengths`` are those of all episodes where only some are read."""
    placed = materialize(with_storage_position(frames), "placed") if full else with_storage_position(frames)
    found = [index_issues(placed, full, lengths), file_episode_issues(frames), task_issues(frames, episodes, data.tasks),
             timestamp_issues(placed, fps), feature_issues(placed, declared)]
    usable = [c for c in data.vectors.values() if c in frames.columns and _numeric(frames.schema[c].dataType)]
    if usable:
        found.append(motion_issues(without_bad_vectors(placed, usable, declared), usable))
    return found


def run(data: Dataset, mode: str = "quick", previous: Previous | None = None) -> DataFrame:
    """All issues of a data set; see ``check`` for the state that a later run can start from."""
    return check(data, mode, previous)[0]


def check(data: Dataset, mode: str = "quick", previous: Previous | None = None) -> tuple[DataFrame, Previous | None]:
    """All issues of a data set, and what a later run needs of this one.

    ``quick`` reads the first and last episode. ``full`` reads all, compares stored statistics and video metadata.
    ``export_gate`` also refuses statistics that nobody could verify, and contents that change while it runs. With a
    ``previous`` run only episodes of changed files are read again: issues and states of the others are kept.
    """
    if mode not in ("quick", "full", "export_gate"):
        raise ValueError(f"unknown validation mode {mode}")
    gate, full = mode == "export_gate", mode != "quick"
    if gate and data.manifest is None:
        raise ValueError("an export gate needs the content manifest")
    head = data.header.select("fps", "total_episodes").first()  # one header row
    declared = data.features.collect()  # the declaration of one data set
    manifest = materialize(data.manifest(), "manifest") if full and data.manifest is not None else None
    found = [header_issues(data.header, data.features), split_issues(data.splits), id_issues(data.tasks, "task_index", data.header, "total_tasks"),
             id_issues(data.episodes, "episode_index", data.header, "total_episodes"), task_text_issues(data.tasks)]
    broken = column_issues(data.frames, data.episodes)
    frames, episodes = data.frames, data.episodes
    if not full and head.total_episodes is not None and head.total_episodes > 2:
        ends = F.col("episode_index").isin(0, head.total_episodes - 1)
        frames, episodes = frames.filter(ends), episodes.filter(ends)
    if not broken.isEmpty() or not head.fps:
        return union([*found, broken]), None
    shapes = numeric_shapes(frames, declared) if full and data.stats is not None else {}
    state = None
    if previous is not None and manifest is not None:
        dirty = materialize(dirty_episodes(data, previous.manifest, manifest), "dirty")
        some, own = frames.join(dirty, EPISODE, "left_semi"), episodes.join(dirty, EPISODE, "left_semi")
        lengths = frames.groupBy(*EPISODE).agg(F.count("*").alias("length"))  # reads the two key columns only
        found += episode_issues(data, some, own, declared, head.fps, full, lengths)
        found.append(previous.issues.filter(F.col("code").isin(EPISODE_CODES)).join(dirty, EPISODE, "left_anti"))
        if shapes:
            state = previous.state.join(dirty, EPISODE, "left_anti").unionByName(episode_state(some, shapes))
    else:
        found += episode_issues(data, frames, episodes, declared, head.fps, full)
        state = episode_state(frames, shapes) if shapes else None
    found.append(length_issues(frames, episodes, full))
    if full:
        found.append(total_issues(frames, data.header))
        found += _video_issues(data, frames, head.fps)
        one = data.header.select("dataset_id").limit(1)
        visual = any(f.dtype in ("video", "image") for f in declared)
        if data.stats_deferred:
            found.append(issues(one, "stats_deferred", "WARN"))
        elif state is not None:
            state = materialize(state, "state")
            found.append(stats_issues(state, data.stats, data.features, data.dataset_id, data.official))
            if visual:
                found.append(issues(one, "visual_stats_not_recomputed", "WARN"))
                if gate:
                    found.append(issues(one, "stats_unverified_visual"))
        if data.relative is not None:
            r = data.relative
            found.append(relative_issues(frames, r["stored"], r["dims"], r["width"], r["chunk"], data.dataset_id))
    result = union(found)
    if manifest is not None:
        result = materialize(result, "issues")
        if gate:  # every rule has read its rows by now
            result = result.unionByName(materialize(content_issues(manifest, data.manifest(), data.dataset_id), "content"))
    kept = Previous(result, state, manifest) if state is not None and manifest is not None else None
    return result, kept


def _video_issues(data: Dataset, frames: DataFrame, fps: float) -> list[DataFrame]:
    lengths = frames.groupBy(*EPISODE).agg(F.count("*").alias("length"))
    found = [segment_issues(data.videos, lengths, fps)] if data.videos is not None else []
    if data.streams is not None:
        found.append(stream_rate_issues(data.streams, fps))
    if data.pts is not None:
        found.append(pts_issues(data.pts, fps))
        if data.videos is not None and "path" in data.videos.columns:
            found.append(segment_pts_issues(data.videos, lengths, data.pts, fps))
    return found


def without_bad_vectors(placed: DataFrame, vectors: Sequence[str], declared: Sequence) -> DataFrame:
    """Frames of episodes whose vectors have the declared width and only finite numbers."""
    widths = {("state" if f.feature == "observation.state" else f.feature): list(f.shape) for f in declared if f.shape}
    bad = stats.shape_violations(placed, {v: widths[v] for v in vectors if v in widths}).select(*EPISODE).distinct()
    return placed.join(bad, EPISODE, "left_anti")
