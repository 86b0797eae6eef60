"""Normalisation statistics: exact moments and quantiles, globally and per episode."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.functions.numeric import finite_vector, is_finite, round_half_up
from episodica.operators import ranks
from episodica.operators.series import EPISODE, attach, block_of, block_size, episode_lengths, flat_vector, to_values
from episodica.session import materialize

# Fixed quantile levels of the statistics format.
QUANTILES = {"q01": 0.01, "q10": 0.10, "q50": 0.50, "q90": 0.90, "q99": 0.99}
STATISTICS = ["min", "max", "mean", "std", "count", *QUANTILES]
NON_NUMERIC = ["image", "language", "string", "str", "video"]


def numeric_features(features: DataFrame) -> DataFrame:
    """Declared features that carry numbers, with their flattened width."""
    positive = (F.size("shape") > 0) & F.forall("shape", lambda n: n > 0)
    width = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, n: a * n)
    return features.filter(~F.col("dtype").isin(NON_NUMERIC) & positive).withColumn("width", width)


# How Spark reads the declared numeric types.
PHYSICAL = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int",
            "uint32": "bigint", "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double"}


def declared_shapes(features: DataFrame, frames: DataFrame, columns: dict[str, str] | None = None) -> dict[str, list[int]]:
    """Shapes of all declared numeric features by column name; a missing column or another stored type is an error.

    ``columns`` maps features to columns with another name. One row per declared feature comes to the driver.
    """
    columns, shapes = {"observation.state": "state", **(columns or {})}, {}
    for f in features.filter(~F.col("dtype").isin(NON_NUMERIC)).select("feature", "dtype", "shape").collect():
        name = f.feature if f.feature in frames.columns else columns.get(f.feature, f.feature)
        if f.dtype not in PHYSICAL:
            raise ValueError(f"feature {f.feature} has the unsupported type {f.dtype}")
        if not f.shape or min(f.shape) < 1:
            raise ValueError(f"feature {f.feature} has no valid shape")
        if name not in frames.columns:
            raise ValueError(f"feature {f.feature} has no column")
        kind = frames.schema[name].dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if kind.simpleString() != PHYSICAL[f.dtype]:
            raise ValueError(f"feature {f.feature} is stored as {kind.simpleString()} instead of {f.dtype}")
        shapes[name] = list(f.shape)
    return shapes


def _valid(frames: DataFrame, name: str, shape: Sequence[int] | int) -> Column:
    width = shape if isinstance(shape, int) else math.prod(shape)
    return F.coalesce(finite_vector(flat_vector(frames, name), width), F.lit(False))


def shape_violations(frames: DataFrame, shapes: dict[str, Sequence[int] | int]) -> DataFrame:
    """Rows whose feature is NULL, has another width or holds NaN/Inf: ``(episode, frame, feature)``."""
    bad = F.array_compact(F.array(*[F.when(~_valid(frames, name, shape), F.lit(name)) for name, shape in shapes.items()]))
    return frames.select(*EPISODE, "frame_index", F.explode(bad).alias("feature"))


def refuse_bad_values(counted: DataFrame, frames: DataFrame, shapes: dict[str, Sequence[int]], total: int | None = None) -> None:
    """Errors that the bins of ``guarded_values`` carry: rows of another width or with a number that is not finite, and
    features without a row for each of ``total`` frames. One row per declared feature comes to the driver."""
    bad, whole = F.col("dim") == -1, F.col("dim") == 0
    facts = counted.groupBy("feature").agg(
        F.sum(F.when(bad, F.col("_c"))).alias("bad"), F.min(F.when(bad, F.col("lo"))).alias("episode"), F.sum(F.when(whole, F.col("_c"))).alias("frames")).collect()
    for row in sorted(facts, key=lambda r: r.feature):
        if row.bad:
            one = frames.filter(F.col("episode_index") == int(row.episode))
            first = shape_violations(one, {row.feature: shapes[row.feature]}).agg(F.min("frame_index")).first()[0]
            raise ValueError(f"feature {row.feature} is invalid in {row.bad} frames, first in episode {int(row.episode)}, frame {first}")
    if total is not None:
        have = {r.feature: r.frames for r in facts}
        for name in shapes:
            if have.get(name, 0) != total:
                raise ValueError(f"feature {name} has {have.get(name, 0)} frames instead of {total}")


def block_moments(frames: DataFrame, features: Sequence[str], keys: Sequence[str] = EPISODE) -> DataFrame:
    """Moments of every ``(episode, block, feature, dim)``, centred on the first row of the block.

    Centring keeps the variance exact when values are large and their spread is small. The first rows, one in ``BLOCK``, are
    written by themselves and joined; nothing is sorted, and only partial sums are shuffled.
    """
    keys = [*keys, "_blk"]
    flat = [flat_vector(frames, f).cast("array<double>").alias(f"_f{i}") for i, f in enumerate(features)]
    rows = frames.select(*keys[:-1], "frame_index", block_of("frame_index").alias("_blk"), *flat)
    first = rows.filter(F.col("frame_index") == F.col("_blk") * block_size()).groupBy(*keys).agg(
        *[F.first(f"_f{i}").alias(f"_a{i}") for i in range(len(features))])
    joined = rows.join(materialize(first, "anchors"), keys, "left")
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_f{i}").alias("v"), F.col(f"_a{i}").alias("a")) for i, f in enumerate(features)])
    each = joined.select(*keys, F.explode(parts).alias("e"))
    long = each.select(*keys, "e.feature", F.posexplode("e.v").alias("dim", "value"), F.col("e.a").alias("a"))
    # a block whose first row is missing or has another width is centred on 0
    anchor = F.coalesce(F.get("a", F.col("dim")), F.lit(0.0))
    anchor = F.when(F.isnan(anchor) | (F.abs(anchor) == float("inf")), F.lit(0.0)).otherwise(anchor)
    long = long.withColumn("anchor", anchor)
    centred = F.col("value") - F.col("anchor")
    return long.groupBy(*keys, "feature", "dim").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min("anchor").alias("anchor"), F.avg(centred).alias("shift"), F.var_pop(centred).alias("var"))


def merge_moments(partial: DataFrame, by: Sequence[str]) -> DataFrame:
    """Combine centred moments ``(n, min, max, anchor, shift, var)`` of disjoint parts into one row per group.

    The group is re-centred on the anchor of its smallest part, so no large mean is ever squared.
    """
    by = list(by)
    base = partial.groupBy(*by).agg(F.min("anchor").alias("_base"))
    rows = partial.join(base, by)
    rows = rows.withColumn("_d", (F.col("anchor") - F.col("_base")) + F.col("shift"))
    merged = rows.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.first("_base").alias("anchor"),
        (F.sum(F.col("n") * F.col("_d")) / F.sum("n")).alias("shift"),
        F.sum(F.col("n") * F.col("var")).alias("_within"),
        (F.sum(F.col("n") * F.col("_d") * F.col("_d"))).alias("_square"))
    var = F.greatest(
        (F.col("_within") + F.col("_square")) / F.col("n") - F.col("shift") * F.col("shift"), F.lit(0.0))
    return merged.select(*by, "n", "min", "max", "anchor", "shift", var.alias("var"))


def finish_moments(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    return moments.select(
        *by, "min", "max", (F.col("anchor") + F.col("shift")).alias("mean"),
        F.sqrt("var").alias("std"), F.col("n").alias("count"))


def centred_moments(values: DataFrame, by: Sequence[str], value: str = "value", weight: str | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """Moments of few, possibly huge groups (feature x dim), centred on their smallest values ``anchors(by, _anchor)``.

    The smallest values are written, so that their size is known when the join is planned: as long as they are few, no row
    is shuffled.
    """
    by = list(by)
    n = F.col(weight) if weight else F.lit(1)
    anchors = materialize(values.groupBy(*by).agg(F.min(value).alias("_anchor")) if anchors is None else anchors, "anchors")
    d = F.col(value) - F.col("_anchor")
    sums = values.join(anchors, by).groupBy(*by).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.first("_anchor").alias("anchor"),
        F.sum(n).alias("n"), (F.sum(n * d) / F.sum(n)).alias("shift"),
        *([F.var_pop(d).alias("var")] if not weight else
          [(F.sum(n * d * d) / F.sum(n) - F.pow(F.sum(n * d) / F.sum(n), 2)).alias("var")]))
    return finish_moments(sums, by)


def guarded_values(frames: DataFrame, shapes: dict[str, Sequence[int]], keys: Sequence[str] = EPISODE) -> DataFrame:
    """``to_values`` in which a row that breaks its feature's shape stands as element -1 with its episode as value.

    So the first scan finds the errors as well, and its smallest value of element -1 is the first bad episode.
    """
    parts = [F.struct(F.lit(name).alias("feature"), _valid(frames, name, shape).alias("ok"), flat_vector(frames, name).alias("v")) for name, shape in shapes.items()]
    rows = frames.select(*keys, "frame_index", F.col("episode_index").cast("double").alias("_where"), F.explode(F.array(*parts)).alias("e"))
    elements = F.when(F.col("e.ok"), F.col("e.v")).otherwise(F.array("_where"))
    long = rows.select(*keys, "frame_index", "e.feature", "e.ok", F.posexplode(elements).alias("dim", "value"))
    return long.withColumn("dim", F.when(F.col("ok"), F.col("dim")).otherwise(F.lit(-1))).drop("ok")


def _counted(frames: DataFrame, features: Sequence[str], shapes: dict[str, Sequence[int]] | None, total: int | None,
             keys: Sequence[str], groups: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Values and their written first digits, after all guards that were asked for."""
    values = guarded_values(frames, {f: shapes[f] for f in features}, keys) if shapes else to_values(frames, features, keys)
    counted = materialize(ranks.bins(values, groups, "value"), "bins")
    if shapes:
        refuse_bad_values(counted, frames, {f: shapes[f] for f in features}, total)
    return values, counted


def feature_stats(frames: DataFrame, features: Sequence[str], by: Sequence[str] = (), shapes: dict[str, Sequence[int]] | None = None,
                  total: int | None = None) -> DataFrame:
    """Global statistics of every element of the given features: ten statistics per (feature, dim).

    Scalars, booleans, vectors and nested arrays are taken alike, in C order. With the declared ``shapes`` a row of another
    width or with a number that is not finite is an error that names its place, with ``total`` another number of frames.
    The first scan counts digits and finds the ends, the second one sums around them, and only values in the few bins that
    hold a wanted rank are read on.
    """
    groups = [*by, "feature", "dim"]
    values, counted = _counted(frames, features, shapes, total, list(by) or EPISODE, groups)
    moments = centred_moments(values, groups, anchors=counted.groupBy(*groups).agg(F.min("lo").alias("_anchor")))
    quants = ranks.quantiles(values, groups, "value", QUANTILES, counted=counted).drop("n")
    return moments.join(quants, groups).select(*groups, *STATISTICS)


def episode_moments(frames: DataFrame, features: Sequence[str], counted: DataFrame) -> DataFrame:
    """Moments ``(n, min, max, anchor, shift, var)`` of every (episode, feature, dim), centred on its smallest value.

    The smallest values come from ``counted``, the bins by episode, as one array a feature. They are joined on (episode,
    block), and only partial sums are shuffled.
    """
    lows = counted.groupBy(*EPISODE, "feature", "dim").agg(F.min("lo").alias("lo"))
    per = lows.groupBy(*EPISODE, "feature").agg(F.map_from_entries(F.collect_list(F.struct("dim", "lo"))).alias("_m"), F.max("dim").alias("_top"))
    dense = per.select(*EPISODE, "feature", F.transform(F.sequence(F.lit(0), "_top"), lambda d: F.col("_m")[d]).alias("_a"))
    anchors = dense.groupBy(*EPISODE).agg(*[F.first(F.when(F.col("feature") == f, F.col("_a")), True).alias(f"_a{i}") for i, f in enumerate(features)])
    # one row per episode
    anchors = materialize(anchors.join(episode_lengths(frames), EPISODE), "anchors")
    rows = attach(frames.select(*EPISODE, "frame_index", *features), anchors)
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), flat_vector(frames, f).cast("array<double>").alias("v"), F.col(f"_a{i}").alias("a")) for i, f in enumerate(features)])
    each = rows.select(*EPISODE, F.explode(parts).alias("e"))
    long = each.select(*EPISODE, "e.feature", F.posexplode(F.arrays_zip("e.v", "e.a")).alias("dim", "z"))
    d = F.col("z.v") - F.col("z.a")
    return long.groupBy(*EPISODE, "feature", "dim").agg(
        F.count("z.v").alias("n"), F.min("z.v").alias("min"), F.max("z.v").alias("max"), F.min("z.a").alias("anchor"),
        F.avg(d).alias("shift"), F.var_pop(d).alias("var"))


def _with_quantiles(moments: DataFrame, values: DataFrame, groups: list[str], counted: DataFrame) -> DataFrame:
    quants = ranks.quantiles(values, groups, "value", QUANTILES, counted=counted).drop("n")
    return finish_moments(moments, groups).join(quants, groups).select(*groups, *STATISTICS)


def feature_stats_by_episode(frames: DataFrame, features: Sequence[str], shapes: dict[str, Sequence[int]] | None = None, total: int | None = None) -> DataFrame:
    """The same ten statistics restricted to each episode, all episodes in one pass."""
    groups = [*EPISODE, "feature", "dim"]
    values, counted = _counted(frames, features, shapes, total, EPISODE, groups)
    return _with_quantiles(episode_moments(frames, features, counted), values, groups, counted)


def stats_of_both_grains(frames: DataFrame, features: Sequence[str], shapes: dict[str, Sequence[int]] | None = None,
                         total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Statistics of the whole and of each episode from one state: digits and moments by episode, rolled up for the whole."""
    per, whole = [*EPISODE, "feature", "dim"], ["feature", "dim"]
    values, counted = _counted(frames, features, shapes, total, EPISODE, per)
    moments = materialize(episode_moments(frames, features, counted), "moments")
    return (_with_quantiles(merge_moments(moments, whole), values, whole, ranks.roll_up(counted, whole)),
            _with_quantiles(moments, values, per, counted))


# Features that a new numbering changes in every episode.
RENUMBERED = ("index", "episode_index", "task_index")


def carried_stats(kept: DataFrame, frames: DataFrame, bounds: DataFrame, shapes: dict[str, Sequence[int]], renumbered: Sequence[str] = RENUMBERED) -> DataFrame:
    """Statistics of every output episode of a selection or trim: those of whole episodes are taken over from ``kept``.

    ``kept`` are the statistics by source episode, ``frames`` the output, ``bounds(episode, output_index, start, end, length)``
    where each output episode came from. Only cut episodes are read for all features; the numbering is new in every episode,
    so its features, which are scalars, are computed again for all.
    """
    whole = (F.col("start") == 0) & (F.col("end") == F.col("length"))
    moves = materialize(bounds.select(*EPISODE, "output_index", whole.alias("whole")), "moves")
    same = kept.filter(~F.col("feature").isin(list(renumbered))).join(moves.filter("whole").select(*EPISODE, "output_index"), EPISODE)
    taken = same.select("dataset_id", F.col("output_index").alias("episode_index"), "feature", "dim", *STATISTICS)
    cut = moves.filter("not whole").select("dataset_id", F.col("output_index").alias("episode_index"))
    own = {f: s for f, s in shapes.items() if f not in renumbered}
    fresh = feature_stats_by_episode(frames.join(cut, EPISODE, "left_semi"), list(own), own)
    numbers = {f: s for f, s in shapes.items() if f in renumbered}
    again = feature_stats_by_episode(frames, list(numbers), numbers)
    return taken.unionByName(fresh).unionByName(again)


def check_total_frames(frames: DataFrame, header: DataFrame) -> DataFrame:
    """Datasets whose frame count differs from the declared ``total_frames``."""
    counted = frames.groupBy("dataset_id").agg(F.count("*").alias("frames"))
    return header.join(counted, "dataset_id", "left").select(
        "dataset_id", "total_frames", F.coalesce("frames", F.lit(0)).alias("frames")
    ).filter("frames <> total_frames")


def diagnostic_stats(frames: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics of whatever columns are stackable; a column with any bad row is left out instead of failing.

    A column is stackable when every row has the width of the widest row and only finite numbers.
    """
    # width agrees when the widest and the narrowest row do; NULL rows make a column unusable as well
    flat = {c: flat_vector(frames, c) for c in columns}
    finite = lambda v: F.coalesce(finite_vector(v, F.size(v)), F.lit(False))
    facts = frames.select(*[F.struct(
        F.max(F.size(v)).alias("widest"), F.min(F.size(v)).alias("narrowest"), F.min(finite(v).cast("int")).alias("finite")).alias(c) for c, v in flat.items()]).first()
    usable = [c for c in columns if facts[c].finite == 1 and facts[c].widest == facts[c].narrowest]
    if not usable:
        raise ValueError("no stackable numeric column")
    return feature_stats(frames, usable)


def combine(stats: DataFrame, by: Sequence[str] = ("feature", "dim")) -> DataFrame:
    """Aggregate per-episode statistics without re-reading frames.

    min/max/mean/std are exact; the quantiles are count-weighted means, hence approximate by definition.
    """
    by = list(by)
    n = F.col("count")
    mean = stats.groupBy(*by).agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("_mean"))
    rows = stats.join(mean, by)
    weighted = [(F.sum(n * F.col(q)) / F.sum(n)).alias(q) for q in QUANTILES]
    spread = F.col("std") * F.col("std") + F.pow(F.col("mean") - F.col("_mean"), 2)
    return rows.groupBy(*by).agg(
        F.min("min").alias("min"), F.max("max").alias("max"), F.first("_mean").alias("mean"),
        F.sqrt(F.sum(n * spread) / F.sum(n)).alias("std"), F.sum(n).alias("count"), *weighted)


def histogram_stats(
    histogram: DataFrame, by: Sequence[str], level: str = "level", n: str = "n",
    rule: str = "linear", levels: int = 256,
) -> DataFrame:
    """Statistics of integer levels given as a weighted histogram, scaled to 0..1 by the top level.

    ``linear`` interpolates quantiles at ``(N-1)p``; ``nearest`` takes the level whose cumulative count reaches
    ``ceil(pN)``. A group has at most ``levels`` rows after the first aggregation.
    """
    by = list(by)
    top = float(levels - 1)
    bins = histogram.groupBy(*by, F.col(level).alias("_l")).agg(F.sum(n).alias("_n")).filter("_n > 0")
    upto = Window.partitionBy(*by).orderBy("_l").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_cum", F.sum("_n").over(upto)).withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))

    def level_at(rank):
        return F.min(F.when(F.col("_cum") > rank, F.col("_l")))

    quants = []
    for name, q in QUANTILES.items():
        if rule == "linear":
            at = (F.col("_total") - 1) * F.lit(q)
            low, high = level_at(F.floor(at)), level_at(F.ceil(at))
            share = F.first(at - F.floor(at))
            quants.append(((low + (high - low) * share) / top).alias(name))
        else:
            rank = F.greatest(F.ceil(F.lit(q) * F.col("_total")) - 1, F.lit(0))
            quants.append((level_at(rank) / top).alias(name))
    total = F.sum("_n")
    mean = F.sum(F.col("_n") * F.col("_l")) / total
    var = F.sum(F.col("_n") * F.col("_l") * F.col("_l")) / total - mean * mean
    return bins.groupBy(*by).agg(
        (F.min("_l") / top).alias("min"), (F.max("_l") / top).alias("max"), (mean / top).alias("mean"),
        (F.sqrt(F.greatest(var, F.lit(0.0))) / top).alias("std"), total.alias("count"), *quants)


def dual_grain_histograms(sampled: DataFrame, physical: Sequence[str], channel: Sequence[str], level: str = "level", n: str = "n"):
    """Pixel histograms counted once per physical frame globally and once per selecting episode.

    ``sampled`` holds one row per (episode, physical frame, channel, level). Returns (global, per episode).
    """
    once = sampled.dropDuplicates([*physical, *channel, level])
    glob = once.groupBy(*channel, level).agg(F.sum(n).alias(n))
    episode = sampled.groupBy(*EPISODE, *channel, level).agg(F.sum(n).alias(n))
    return glob, episode


def column_min_max(values: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """Finite minimum and maximum per series, three decimals, halves up."""
    finite = values.filter(is_finite(F.col("value")))
    return finite.groupBy(*by).agg(
        round_half_up(F.min("value"), 3).alias("min"), round_half_up(F.max("value"), 3).alias("max"))


def contiguity(ids: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts that show whether ids are exactly ``0..n-1``; duplicates collapse before any shuffle of rows."""
    counted = ids.groupBy(*by, key).agg(F.count("*").alias("_c"))
    facts = counted.groupBy(*by).agg(
        F.sum("_c").alias("rows"), F.count("*").alias("distinct_ids"),
        F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    dense = (F.col("rows") == F.col("distinct_ids")) & (F.col("first_id") == 0) & (F.col("last_id") == F.col("rows") - 1)
    return facts.withColumn("contiguous", dense)
