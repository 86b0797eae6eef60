"""Sequence operators over ordered frames.

One episode may hold a third of all rows, so nothing here opens a window over a whole episode.
Rows are cut into blocks of consecutive positions; windows run inside ``(key, block)`` and a second,
far smaller step works on one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.functions.numeric import round_half_up
from episodica.session import materialize

EPISODE = ["dataset_id", "episode_index"]
BLOCK = 4096
_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def block_size() -> int:
    return BLOCK


def block_of(position: str, size: float | None = None) -> Column:
    return F.floor(F.col(position) / F.lit(size or BLOCK))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, whole: str | None = None) -> DataFrame:
    """0-based position of every row inside its key in the given order, and with ``whole`` its place among all rows in the
    order of keys and ``order``. Rows with a NULL key are left out.

    A range sort spreads even one hot key over many partitions; each row number is its place in the
    partition plus the rows of its key in earlier partitions. The sorted rows are written once, because
    partition numbers must not change when a lost task is run again.
    """
    keys = list(keys)
    rows = materialize(
        (df if whole is None else df.dropna(subset=keys)).orderBy(*keys, *order).withColumn("_gid", F.monotonically_increasing_id()), "sorted"
    )
    rows = rows.withColumn("_pid", F.shiftright("_gid", _LOCAL_BITS)).withColumn(
        "_off", F.col("_gid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    )
    parts = rows.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"), F.min("_off").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys, "_pid", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base")
    )
    places = [(F.col("_off") + F.col("_base")).cast("bigint").alias(name)]
    if whole is not None:
        rows = rows.join(materialize(_starts(rows), "starts"), "_pid")
        places.append((F.col("_off") + F.col("_start")).cast("bigint").alias(whole))
    return rows.join(parts, [*keys, "_pid"]).select(*df.columns, *places)


def _starts(rows: DataFrame) -> DataFrame:
    """``_pid, _start``: rows in earlier partitions of a sorted table, from one row per partition."""
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("_pid").agg(F.count("*").alias("_m")).select("_pid", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))


def halo(df: DataFrame, position: str, before: int = 0, after: int = 0, size: int | None = None) -> DataFrame:
    """Assign each row to its block (``_own`` true) and copy edge rows to the blocks that look at them.

    ``before`` rows preceding and ``after`` rows following a block are visible inside it.
    """
    size = size or BLOCK
    block = block_of(position, size).cast("bigint")
    if not before and not after:
        return df.withColumn("_blk", block).withColumn("_own", F.lit(True))
    pos = F.col(position)
    first = F.greatest(F.floor((pos - after) / F.lit(size)), F.lit(0)).cast("bigint")
    last = F.floor((pos + before) / F.lit(size)).cast("bigint")
    return df.withColumn("_blk", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_blk") == block)


def block_window(keys: Sequence[str], position: str):
    return Window.partitionBy(*keys, "_blk").orderBy(position)


def lagged(
    df: DataFrame,
    columns: dict[str, str],
    keys: Sequence[str] = EPISODE,
    position: str = "frame_index",
    offset: int = 1,
    size: int | None = None,
) -> DataFrame:
    """Add ``new = old`` of the row ``offset`` positions earlier (negative: later); positions are dense."""
    rows = halo(df, position, before=max(offset, 0), after=max(-offset, 0), size=size)
    w = block_window(keys, position)
    shifted = [
        (F.lag(old, offset) if offset > 0 else F.lead(old, -offset)).over(w).alias(new)
        for new, old in columns.items()
    ]
    return rows.select(*df.columns, "_own", *shifted).filter("_own").drop("_own")


def deltas(frames: DataFrame, feature: str = "action", keys: Sequence[str] = EPISODE) -> DataFrame:
    """Long frame-to-frame differences ``(keys, frame_index, dim, delta)`` of a vector feature."""
    pairs = lagged(frames.select(*keys, "frame_index", feature), {"_prev": feature}, keys)
    return (
        pairs.filter(F.col("_prev").isNotNull())
        .select(*keys, "frame_index", F.posexplode(F.arrays_zip(F.col(feature).alias("cur"), F.col("_prev").alias("prev"))))
        .select(*keys, "frame_index", F.col("pos").alias("dim"),
                (F.col("col.cur").cast("double") - F.col("col.prev").cast("double")).alias("delta"))
    )


def flat_vector(frames: DataFrame, feature: str) -> Column:
    """The numbers of a feature in C order as one array: a scalar or boolean has one, nested arrays any number."""
    kind, depth = frames.schema[feature].dataType, 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    if not isinstance(kind, (T.NumericType, T.BooleanType)):
        raise TypeError(f"feature {feature} is not numeric: {kind.simpleString()}")
    vector = F.col(f"`{feature}`") if depth else F.array(F.col(f"`{feature}`"))
    for _ in range(depth - 1):
        vector = F.flatten(vector)
    return vector if isinstance(kind, (T.FloatType, T.DoubleType)) else vector.cast("array<double>")


def to_values(frames: DataFrame, features: Sequence[str], keys: Sequence[str] = EPISODE) -> DataFrame:
    """Long form ``(keys, frame_index, feature, dim, value)`` in one scan: first a row per feature, then per element.

    Both steps are plain generators, so they stay in compiled code and only the used columns are read.
    """
    flat = {f: flat_vector(frames, f) for f in features}
    kinds = {f.dataType.simpleString() for f in frames.select(*flat.values()).schema}
    kind = next(iter(kinds)) if len(kinds) == 1 else "array<double>"
    vectors = F.array(*[F.struct(F.lit(f).alias("feature"), v.cast(kind).alias("v")) for f, v in flat.items()])
    rows = frames.select(*keys, "frame_index", F.explode(vectors).alias("e"))
    return rows.select(*keys, "frame_index", F.col("e.feature").alias("feature"), F.posexplode("e.v").alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double"))


def named_series(frames: DataFrame, features: DataFrame, vectors: Sequence[str]) -> DataFrame:
    """Chart series ``"feature | name"`` in long form; NaN and infinities are left out.

    ``features`` is the declaration table; a missing name list falls back to element numbers.
    """
    names = features.select(F.col("feature"), F.posexplode_outer("names").alias("dim", "name")).filter("name is not null")
    values = to_values(frames, vectors)
    finite = values.filter(~F.isnan("value") & (F.abs("value") != float("inf")) & F.col("value").isNotNull())
    return finite.join(names, ["feature", "dim"], "left").select(
        *EPISODE, "frame_index",
        F.concat_ws(" | ", "feature", F.coalesce("name", F.col("dim").cast("string"))).alias("series"), "value")


def running(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str,
    size: float | None = None, inclusive: bool = True,
) -> DataFrame:
    """Cumulative sum along ``position``: inside blocks first, then block totals carried forward."""
    keys = list(keys)
    rows = df.withColumn("_blk", block_of(position, size)).withColumn("_v", value)
    w = block_window(keys, position).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = rows.withColumn("_sum", F.coalesce(F.sum("_v").over(w), F.lit(0)))
    totals = rows.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_total"))
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_blk", F.coalesce(F.sum("_total").over(wb), F.lit(0)).alias("_base"))
    return local.join(carried, [*keys, "_blk"]).select(
        *df.columns, (F.col("_sum") + F.col("_base")).alias(name))


@dataclass(frozen=True)
class Carry:
    """One value to carry along an order: forwards from the past, or with ``reverse`` backwards from the future."""

    name: str
    value: Column
    order: Sequence[str] = ()
    reverse: bool = False
    inclusive: bool = True


def carry_all(df: DataFrame, keys: Sequence[str], block: str, carries: Sequence[Carry], size: float | None = None) -> DataFrame:
    """Add the nearest non-null value before (or after) each row for every ``Carry``, in one pass over ``df``.

    Windows run inside blocks of ``block / size``; one row per block is carried to the blocks that follow.
    """
    keys = list(keys)
    rows = df.withColumn("_blk", block_of(block, size))
    for i, c in enumerate(carries):
        rows = rows.withColumn(f"_v{i}", c.value)
    local, edges, carried = rows, [], []
    for i, c in enumerate(carries):
        sides = [F.col(o).desc() if c.reverse else F.col(o).asc() for o in c.order]
        w = Window.partitionBy(*keys, "_blk").orderBy(*sides).rowsBetween(Window.unboundedPreceding, 0 if c.inclusive else -1)
        local = local.withColumn(f"_l{i}", F.last(f"_v{i}", True).over(w))
        place = F.when(F.col(f"_v{i}").isNotNull(), F.struct(*c.order))
        edges.append((F.min_by if c.reverse else F.max_by)(f"_v{i}", place).alias(f"_e{i}"))
        wb = Window.partitionBy(*keys).orderBy(F.col("_blk").desc() if c.reverse else F.col("_blk").asc()).rowsBetween(Window.unboundedPreceding, -1)
        carried.append(F.last(f"_e{i}", True).over(wb).alias(f"_c{i}"))
    # per block the edge is the value nearest to the blocks that look at it
    blocks = rows.groupBy(*keys, "_blk").agg(*edges).select(*keys, "_blk", *carried)
    return local.join(blocks, [*keys, "_blk"]).select(
        *df.columns, *[F.coalesce(f"_l{i}", f"_c{i}").alias(c.name) for i, c in enumerate(carries)])


def carry_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], carries: Sequence[Carry]) -> DataFrame:
    """As ``carry_all`` for any distribution of positions: rows are cut by their place in the sorted table.

    A range sort by key, order and all other columns makes partitions of about the same number of rows, also where half of
    them have one time. Windows run inside a partition, and one row per key and partition is carried on. ``order`` holds for
    all carries. The sorted rows are written once, because partition numbers must survive a re-run task.
    """
    keys, rows = list(keys), df
    for i, c in enumerate(carries):
        rows = rows.withColumn(f"_v{i}", c.value)
    spread = F.xxhash64(*[F.col(c) for c in df.columns if c not in (*keys, *order)])
    rows = materialize(rows.orderBy(*keys, *order, spread).withColumn("_gid", F.monotonically_increasing_id()), "sorted").withColumn(
        "_pid", F.shiftright("_gid", _LOCAL_BITS))
    local, edges, carried = rows, [], []
    for i, c in enumerate(carries):
        towards = (lambda x: F.col(x).desc()) if c.reverse else (lambda x: F.col(x).asc())
        w = Window.partitionBy(*keys, "_pid").orderBy(towards("_gid")).rowsBetween(Window.unboundedPreceding, 0 if c.inclusive else -1)
        local = local.withColumn(f"_l{i}", F.last(f"_v{i}", True).over(w))
        edges.append((F.min_by if c.reverse else F.max_by)(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col("_gid"))).alias(f"_e{i}"))
        wb = Window.partitionBy(*keys).orderBy(towards("_pid")).rowsBetween(Window.unboundedPreceding, -1)
        carried.append(F.last(f"_e{i}", True).over(wb).alias(f"_c{i}"))
    parts = rows.groupBy(*keys, "_pid").agg(*edges).select(*keys, "_pid", *carried)
    return local.join(parts, [*keys, "_pid"]).select(
        *df.columns, *[F.coalesce(f"_l{i}", f"_c{i}").alias(c.name) for i, c in enumerate(carries)])


def carry(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str,
    size: float | None = None, reverse: bool = False, inclusive: bool = True,
) -> DataFrame:
    """Last non-null ``value`` up to each row (or the next one with ``reverse``), blocks cut on ``order[0]``."""
    return carry_all(df, keys, order[0], [Carry(name, value, order, reverse, inclusive)], size)


def runs(
    active: DataFrame, keys: Sequence[str], position: str = "frame_index",
    min_length: Column | int = 1, size: float | None = None,
) -> DataFrame:
    """Maximal runs of consecutive positions present in ``active``: inclusive ``start, end, length``."""
    keys = list(keys)
    numbered = running(active.select(*keys, position), keys, position, F.lit(1), "_rank", size)
    islands = numbered.groupBy(*keys, (F.col(position) - F.col("_rank")).alias("_island")).agg(
        F.min(position).alias("start"), F.max(position).alias("end"))
    length = (F.col("end") - F.col("start") + 1).alias("length")
    return islands.select(*keys, "start", "end", length).filter(F.col("length") >= min_length)


def episode_lengths(frames: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    return frames.groupBy(*keys).agg(F.count("*").alias("length"))


def attach(frames: DataFrame, per_episode: DataFrame, keys: Sequence[str] = EPISODE, length: str = "length") -> DataFrame:
    """Add the columns of ``per_episode`` (one row per episode, with its ``length``) to every frame.

    The small side is repeated once per block of the episode, so that the join key is (episode, block) and a hot
    episode is spread like any other data.
    """
    blocks = per_episode.withColumn("_blk", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.greatest(F.col(length), F.lit(1)) - 1) / BLOCK).cast("bigint"))))
    return frames.withColumn("_blk", block_of("frame_index").cast("bigint")).join(blocks, [*keys, "_blk"]).drop("_blk")


def with_offsets(episodes: DataFrame, dataset: Sequence[str] = ("dataset_id",), order: str = "episode_index") -> DataFrame:
    """Running ``dataset_from_index/dataset_to_index`` of episodes laid end to end."""
    done = running(episodes, dataset, order, F.col("length"), "dataset_to_index")
    return done.withColumn("dataset_from_index", F.col("dataset_to_index") - F.col("length"))


def even_positions(target: Column | int, length: Column) -> Column:
    """Array of ``target`` evenly spread positions of ``0..length-1`` (halves up, gaps filled from 0)."""
    t = target if isinstance(target, Column) else F.lit(target)
    steps = F.greatest(t - 1, F.lit(1)).cast("int")
    spread = F.array_distinct(F.transform(
        F.sequence(F.lit(0), steps), lambda i: round_half_up(i * (length - 1) / steps).cast("bigint")))
    missing = F.greatest(t - F.size(spread), F.lit(0))
    # at most ``target`` candidates are ever needed to fill the gaps
    spare = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.least(length - 1, t.cast("bigint") * 2)), spread)
    filled = F.concat(spread, F.slice(spare, F.lit(1), missing))
    return (
        F.when(length <= 0, F.array().cast("array<bigint>"))
        .when(t >= length, F.sequence(F.lit(0).cast("bigint"), length.cast("bigint") - 1))
        .when(t <= 1, F.array(F.lit(0).cast("bigint")))
        .otherwise(F.array_sort(filled))
    )


def even_sample(df: DataFrame, keys: Sequence[str], position: str, target: int, lengths: DataFrame) -> DataFrame:
    """Keep evenly spread rows per key; ``lengths`` carries ``length`` per key. Joined on the row position."""
    wanted = lengths.select(*keys, F.explode(even_positions(target, F.col("length"))).alias(position))
    return df.join(wanted, [*keys, position], "left_semi")


def visual_sample_size(length: Column) -> Column:
    by_power = F.least(F.floor(F.pow(length.cast("double"), 0.75)), F.lit(10000).cast("bigint"))
    return F.greatest(F.least(length, F.lit(100)), by_power)


def visual_sample(lengths: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Frame positions to decode per episode: ``linspace`` rounded half to even, duplicates removed."""
    k = visual_sample_size(F.col("length"))
    step = (F.col("length") - 1) / F.greatest(F.col("_k") - 1, F.lit(1))
    return (
        lengths.withColumn("_k", k)
        .select(*keys, "length", "_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1)).alias("_i"))
        .select(*keys, F.when(F.col("_k") == 1, F.lit(0)).otherwise(F.bround(F.col("_i") * step)).cast("bigint").alias("frame_index"))
        .distinct()
    )


def reindex(frames: DataFrame, bounds: DataFrame, fps: float) -> DataFrame:
    """Cut episodes to ``[start, end)`` and renumber them to ``output_index``.

    ``bounds(dataset_id, episode_index, output_index, start, end, length)`` is one row per kept episode;
    a really trimmed episode restarts ``frame_index`` and ``timestamp`` at zero, others keep theirs.
    """
    cut = bounds.withColumn("_kept", F.col("end") - F.col("start"))
    cut = running(cut, ["dataset_id"], "output_index", F.col("_kept"), "_from", inclusive=False)
    trimmed = (F.col("start") > 0) | (F.col("end") < F.col("length"))
    joined = attach(
        frames, cut.select(*EPISODE, "length", "output_index", "start", "end", "_from", trimmed.alias("_trimmed"))
    ).filter((F.col("frame_index") >= F.col("start")) & (F.col("frame_index") < F.col("end")))
    local = F.col("frame_index") - F.col("start")
    kept = [c for c in frames.columns if c not in ("dataset_id", "episode_index", "frame_index", "index", "timestamp")]
    return joined.select(
        "dataset_id",
        F.col("episode_index").alias("source_episode_index"),
        F.col("frame_index").alias("source_frame_index"),
        F.col("output_index").alias("episode_index"),
        F.when(F.col("_trimmed"), local).otherwise(F.col("frame_index")).alias("frame_index"),
        (local + F.col("_from")).alias("index"),
        F.when(F.col("_trimmed"), (local / F.lit(float(fps))).cast(frames.schema["timestamp"].dataType))
        .otherwise(F.col("timestamp")).alias("timestamp"),
        *kept,
    )


def chart_time(frames: DataFrame, lengths: DataFrame, duration: Column) -> DataFrame:
    """Row position stretched over the video duration: ``row / (n - 1) * duration``."""
    n = F.greatest(F.col("length") - 1, F.lit(1))
    return attach(frames, lengths).withColumn("chart_time", F.col("frame_index") / n * duration)
