"""Episode bounds from motion or from stationary ends."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.numeric import hold_frames, is_finite, max_abs_difference
from episodica.operators import ranks
from episodica.operators.series import EPISODE, attach, episode_lengths, lagged, runs
from episodica.session import materialize


@dataclass(frozen=True)
class MotionTrim:
    threshold: float = 0.02
    hold_time_s: float = 0.5
    margin_s: float = 1.0
    start_hold_time_s: float | None = None
    end_hold_time_s: float | None = None
    start_margin_s: float | None = None
    end_margin_s: float | None = None

    def side(self, side: str, field: str) -> float:
        own = getattr(self, f"{side}_{field}")
        return getattr(self, field) if own is None else own


def margin_frames(seconds: float, fps: float) -> Column:
    return F.greatest(F.lit(0), F.bround(F.lit(seconds * fps))).cast("bigint")


def shared_dimensions(action_names: Sequence[str], state_names: Sequence[str], wanted: Sequence[str] | None = None) -> list[tuple[int, int]]:
    """Element pairs (action, state) of the names both features have, in action order."""
    common = [n for n in action_names if n in set(state_names)]
    chosen = list(wanted or common)
    if not chosen:
        raise ValueError("motion trim needs a dimension shared by action and state")
    unknown = [n for n in chosen if n not in common]
    if unknown:
        raise ValueError(f"dimensions not shared by action and state: {unknown}")
    return [(action_names.index(n), state_names.index(n)) for n in chosen]


def motion_score(frames: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Largest scaled step over all signals; it sits on the later of the two frames. NaN makes the score NaN."""
    signals = F.array(*[x for a, s in pairs for x in (
        F.get("action", F.lit(a)).cast("double"), F.get("state", F.lit(s)).cast("double"))])
    # a missing number counts as NaN, so that it spoils the step instead of being skipped
    rows = frames.select(*EPISODE, "frame_index", F.transform(signals, lambda x: F.coalesce(x, F.lit(float("nan")))).alias("_x"))
    values = rows.select(*EPISODE, F.posexplode("_x").alias("dim", "value"))
    spread = ranks.quantiles(values, [*EPISODE, "dim"], "value", {"q05": 0.05, "q95": 0.95})
    # few signals per episode; the array is in signal order
    scales = spread.groupBy(*EPISODE).agg(
        F.map_from_entries(F.collect_list(F.struct("dim", (F.col("q95") - F.col("q05") + 1e-8).alias("scale")))).alias("_scale"))
    per_episode = episode_lengths(frames).join(scales, EPISODE)
    steps = attach(lagged(rows, {"_prev": "_x"}).filter("_prev is not null"), per_episode)
    score = F.array_max(F.transform(
        F.zip_with("_x", "_prev", lambda x, p: F.abs(x - p)),
        lambda d, i: F.coalesce(d / F.element_at("_scale", i), F.lit(float("nan")))))
    return steps.select(*EPISODE, "frame_index", score.alias("score"))


def motion(frames: DataFrame, fps: float, pairs: Sequence[tuple[int, int]], config: MotionTrim = MotionTrim(),
           overrides: DataFrame | None = None) -> DataFrame:
    """``(episode, start, end, length, method)``: first to last sustained motion plus margins.

    A side without a sustained run keeps its edge. ``overrides(episode, start, end)`` win.
    """
    score = motion_score(frames, pairs)
    active = score.filter(is_finite(F.col("score")) & (F.col("score") >= config.threshold))
    hold = {side: hold_frames(config.side(side, "hold_time_s"), fps) for side in ("start", "end")}
    sustained = runs(active, EPISODE).groupBy(*EPISODE).agg(
        F.min(F.when(F.col("length") >= hold["start"], F.col("start"))).alias("_first"),
        F.max(F.when(F.col("length") >= hold["end"], F.col("end"))).alias("_last"))
    rows = episode_lengths(frames).join(sustained, EPISODE, "left")
    start = F.greatest(F.lit(0), F.col("_first") - margin_frames(config.side("start", "margin_s"), fps))
    end = F.least(F.col("length"), F.col("_last") + 1 + margin_frames(config.side("end", "margin_s"), fps))
    bounds = rows.select(
        *EPISODE, F.when(F.col("_first").isNull(), F.lit(0)).otherwise(start).cast("bigint").alias("start"),
        F.when(F.col("_last").isNull(), F.col("length")).otherwise(end).cast("bigint").alias("end"), "length",
        F.when(F.col("_first").isNull() & F.col("_last").isNull(), "no_sustained_motion").otherwise("motion").alias("method"))
    # one row per episode from a scan of all frames, used several times by every consumer
    return materialize(with_overrides(bounds, overrides) if overrides is not None else bounds, "bounds")


def with_overrides(bounds: DataFrame, overrides: DataFrame) -> DataFrame:
    manual = overrides.select(*EPISODE, F.col("start").alias("_s"), F.col("end").alias("_e"))
    rows = bounds.join(manual, EPISODE, "left")
    given = F.col("_s").isNotNull()
    bad = given & ((F.col("_s") < 0) | (F.col("_e") > F.col("length")) | (F.col("_e") <= F.col("_s")))
    checked = F.when(bad, F.raise_error(F.lit("manual trim is outside the episode")).cast("bigint")).otherwise(
        F.coalesce(F.col("_s"), F.col("start")).cast("bigint"))
    return rows.select(*EPISODE, checked.alias("start"), F.coalesce("_e", "end").cast("bigint").alias("end"), "length",
                       F.when(given, "manual").otherwise(F.col("method")).alias("method"))


def stationary(frames: DataFrame, fps: float, epsilon: float = 5e-4, start_margin_s: float = 1.0, end_margin_s: float = 1.0,
               strict: bool = True) -> DataFrame:
    """Cut leading and trailing frames whose state stays within ``epsilon`` of the first or last one.

    No window: the edge states come from ``min_by``/``max_by`` and the cut points from min and max of the moving
    frames. With ``strict`` a non-finite state or a cut that leaves nothing is an error.
    """
    if not epsilon > 0 or epsilon == float("inf"):
        raise ValueError("epsilon must be positive and finite")
    rows = frames.select(*EPISODE, "frame_index", F.col("state").cast("array<double>").alias("_x"))
    edges = rows.groupBy(*EPISODE).agg(
        F.count("*").alias("length"), F.min_by("_x", "frame_index").alias("_head"), F.max_by("_x", "frame_index").alias("_tail"),
        F.count_if(~F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))).alias("_bad"))
    moved = attach(rows, edges)
    frame = F.col("frame_index")
    cuts = moved.groupBy(*EPISODE).agg(
        F.first("length").alias("length"), F.first("_bad").alias("_bad"),
        F.min(F.when(max_abs_difference(F.col("_x"), F.col("_head")) > epsilon, frame)).alias("_move"),
        F.max(F.when(max_abs_difference(F.col("_x"), F.col("_tail")) > epsilon, frame)).alias("_still"))
    lead = F.coalesce("_move", "length")
    trail = F.col("length") - 1 - F.coalesce("_still", F.lit(-1))
    bounds = cuts.select(
        *EPISODE, F.greatest(F.lit(0), lead - margin_frames(start_margin_s, fps)).cast("bigint").alias("start"),
        (F.col("length") - F.greatest(F.lit(0), trail - margin_frames(end_margin_s, fps))).cast("bigint").alias("end"), "length",
        F.when(F.col("_bad") > 0, "non_finite_state").when(F.lit(True), "stationary").alias("method"))
    emptied = F.col("start") >= F.col("end")
    bounds = bounds.withColumn("method", F.when((F.col("method") == "stationary") & emptied, "removes_all").otherwise(F.col("method")))
    if strict:
        text = F.concat(F.lit("stationary trim: "), "method", F.lit(" in episode "), F.col("episode_index").cast("string"))
        bounds = bounds.withColumn("start", F.when(F.col("method") == "stationary", F.col("start")).otherwise(
            F.raise_error(text).cast("bigint")))
    return materialize(bounds, "bounds")
