"""Cross-episode quality insights: lengths, movement, velocity, autocorrelation, alignment.

Every function reads all frames of all episodes. Vector deltas need one shuffle on (episode, block); each
statistic is an aggregate over them, so a long episode never meets in a single task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions.numeric import round_half_up, vector_distance
from episodica.operators.ranks import kth_values
from episodica.operators.series import EPISODE, attach, block_of, deltas, episode_lengths, halo, lagged, to_values
from episodica.session import materialize

DISCRETE_VALUES = 4
RANGE_BLOCK = 65536
ACTIVITY_SHARE = 0.001
VELOCITY_BINS = 30
LAG_BLOCK = 1024


def length_seconds(episodes: DataFrame, fps: float) -> DataFrame:
    return episodes.select(*EPISODE, "length", round_half_up(F.col("length") / F.lit(float(fps)), 2).alias("seconds"))


def length_summary(episodes: DataFrame, fps: float) -> DataFrame:
    """Mean, median, spread and the histogram layout of episode lengths, one row per dataset.

    Works on distinct lengths: N frames can only make about sqrt(2N) different ones, so these windows stay small.
    """
    counts = length_seconds(episodes, fps).groupBy("dataset_id", "seconds").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("dataset_id").orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("dataset_id")
    counts = counts.select(
        "*", F.sum("_c").over(upto).alias("_upto"), F.sum("_c").over(whole).alias("_n"),
        (F.sum(F.col("seconds") * F.col("_c")).over(whole) / F.sum("_c").over(whole)).alias("_mean"))
    mean = round_half_up(F.col("_mean"), 2)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("seconds")))

    half = F.floor(F.col("_n") / 2)
    middle, before = at(half), at(half - 1)
    facts = counts.groupBy("dataset_id").agg(
        F.first("_n").alias("episodes"), F.first(mean).alias("mean"),
        F.when(F.first("_n") % 2 == 0, round_half_up((before + middle) / 2, 2)).otherwise(middle).alias("median"),
        round_half_up(F.sqrt(F.sum(F.col("_c") * F.pow(F.col("seconds") - mean, 2)) / F.first("_n")), 2).alias("std"),
        F.min("seconds").alias("shortest"), F.max("seconds").alias("longest"),
        at(F.floor(F.col("_n") * 0.01)).alias("p1"), at(F.ceil(F.col("_n") * 0.99) - 1).alias("p99"))
    spread = F.col("p99") - F.col("p1")
    target = F.greatest(F.lit(10), F.least(F.lit(50), F.ceil(F.log2("episodes") + 1)))
    facts = facts.withColumn("_raw", F.when(spread == 0, F.lit(1.0)).otherwise(spread) / target)
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10("_raw")))
    # Fixed bin steps of the histogram.
    steps = F.filter(F.transform(F.array(*[F.lit(s) for s in (1.0, 2.0, 2.5, 5.0, 10.0)]), lambda s: s * magnitude),
                     lambda w: w >= F.col("_raw"))
    facts = facts.withColumn("bin_width", F.coalesce(F.get(steps, F.lit(0)), F.col("_raw")))
    facts = facts.withColumn("bin_start", F.floor(F.col("p1") / F.col("bin_width")) * F.col("bin_width"))
    end = F.ceil(F.col("p99") / F.col("bin_width")) * F.col("bin_width")
    bins = F.greatest(F.lit(1), round_half_up((end - F.col("bin_start")) / F.col("bin_width")))
    single = F.col("shortest") == F.col("longest")
    return facts.select(
        "dataset_id", "episodes", "mean", "median", "std", "shortest", "longest", "p1", "p99",
        F.when(single, F.col("shortest")).otherwise(F.col("bin_start")).alias("bin_start"),
        F.when(single, F.lit(0.0)).otherwise(F.col("bin_width")).alias("bin_width"),
        F.when(single, F.lit(1)).otherwise(bins).cast("bigint").alias("bins"))


def length_histogram(episodes: DataFrame, fps: float) -> DataFrame:
    """Episode count per bin (empty bins included); lengths outside the percentile bounds fall into the edge bins."""
    layout = length_summary(episodes, fps).select("dataset_id", "bin_start", "bin_width", "bins")
    counts = length_seconds(episodes, fps).groupBy("dataset_id", "seconds").agg(F.count("*").alias("_c"))
    raw = F.when(F.col("bin_width") == 0, F.lit(0)).otherwise(
        F.floor((F.col("seconds") - F.col("bin_start")) / F.col("bin_width")))
    place = F.least(F.greatest(raw, F.lit(0)), F.col("bins") - 1)
    filled = counts.join(layout, "dataset_id").groupBy("dataset_id", place.alias("bin")).agg(F.sum("_c").alias("episodes"))
    bins = layout.select("dataset_id", "bin_start", "bin_width",
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin"))
    low = F.col("bin_start") + F.col("bin") * F.col("bin_width")
    return bins.join(filled, ["dataset_id", "bin"], "left").select(
        "dataset_id", "bin", low.alias("low"), (low + F.col("bin_width")).alias("high"),
        F.coalesce("episodes", F.lit(0)).alias("episodes"))


def length_outliers(episodes: DataFrame, fps: float, low: float, high: float) -> DataFrame:
    return length_seconds(episodes, fps).filter((F.col("seconds") < low) | (F.col("seconds") > high))


def shortest(episodes: DataFrame, fps: float, count: int = 5) -> DataFrame:
    return length_seconds(episodes, fps).orderBy("seconds", "episode_index").limit(count)


def longest(episodes: DataFrame, fps: float, count: int = 5) -> DataFrame:
    """The last rows of the ascending, stable order, longest first."""
    return length_seconds(episodes, fps).orderBy(F.desc("seconds"), F.desc("episode_index")).limit(count)


def cross_variance(frames: DataFrame, feature: str = "action", bins: int = 50) -> DataFrame:
    """Variance across episodes at ``bins`` points of relative time.

    Each frame finds the bins that pick it, those near its own relative time; bins are never listed for a join.
    """
    last = F.col("length") - 1
    share = F.lit(float(bins - 1))
    rows = attach(frames.select(*EPISODE, "frame_index", feature), episode_lengths(frames)).withColumn("_at", F.col("frame_index") / F.greatest(last, F.lit(1)) * share)
    # half a frame on either side, and one bin more for rounding; an episode of one frame is picked by every bin
    reach = F.ceil(share / F.greatest(last, F.lit(1))) + 1
    low = F.greatest(F.floor("_at") - reach, F.lit(0).cast("bigint")).cast("int")
    high = F.least(F.ceil("_at") + reach, F.lit(bins - 1).cast("bigint")).cast("int")
    near = F.when(low <= high, F.sequence(low, high))
    at = lambda b: F.least(round_half_up(b / share * last), last).cast("bigint")
    picked = rows.select(feature, F.explode(F.filter(near, lambda b: at(b) == F.col("frame_index"))).alias("bin"))
    values = picked.select("bin", F.posexplode(feature).alias("dim", "value"))
    # var_pop of a single value is 0, the value wanted for fewer than two episodes
    return values.groupBy("bin", "dim").agg(F.var_pop(F.col("value").cast("double")).alias("variance"))


def movement(frames: DataFrame, feature: str = "action") -> DataFrame:
    """Mean Euclidean step per frame and episode, four decimals; episodes of one frame get 0."""
    steps = lagged(frames.select(*EPISODE, "frame_index", F.col(feature).cast("array<double>").alias("_x")), {"_prev": "_x"})
    norm = F.when(F.col("_prev").isNotNull(), vector_distance(F.col("_x"), F.col("_prev")))
    return steps.groupBy(*EPISODE).agg(
        F.coalesce(round_half_up(F.avg(norm), 4), F.lit(0.0)).alias("movement"))


def lowest_movement(scores: DataFrame, count: int = 10) -> DataFrame:
    return scores.orderBy("movement", "episode_index").limit(count)


def motor_ranges(frames: DataFrame, feature: str = "action") -> DataFrame:
    """Range per dimension (0 becomes 1) and whether it takes at most four distinct values.

    Blocks are rows that a task reads one after the other, so short episodes share one. Each block hands on at most five
    distinct values of a dimension, enough to tell four from more.
    """
    values = to_values(frames, [feature]).withColumn("_blk", F.floor(F.monotonically_increasing_id() / RANGE_BLOCK))
    some = F.array_distinct(F.collect_set(F.col("value") + F.lit(0.0)))  # 0 and -0 are one value, and so are all NaN
    blocks = values.groupBy("_blk", "dim").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.slice(some, 1, DISCRETE_VALUES + 1).alias("_some"))
    seen = blocks.select("dim", "lo", "hi", F.explode("_some").alias("_x")).groupBy("dim", "_x").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ranges = seen.groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("_k"))
    width = F.col("hi") - F.col("lo")
    return ranges.select(
        "dim", F.when(width == 0, F.lit(1.0)).otherwise(width).alias("motor_range"),
        (F.col("_k") <= DISCRETE_VALUES).alias("discrete"))


def episode_deltas(frames: DataFrame, feature: str = "action", delta: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """Per (episode, dim) sums of deltas and the activity flag.

    "Value at floor(0.95 m) of the sorted magnitudes reaches the threshold" is the same as "at most floor(0.95 m)
    magnitudes are below it", so activity is a count and needs no sorting.
    """
    delta = deltas(frames, feature) if delta is None else delta
    # one row per vector element, written so that the plan knows its size
    ranges = materialize(motor_ranges(frames, feature), "ranges") if ranges is None else ranges
    size = F.abs("delta")
    rows = delta.join(ranges, "dim")
    below = F.count_if(size < F.col("motor_range") * ACTIVITY_SHARE)
    m = F.count("*")
    return rows.groupBy(*EPISODE, "dim").agg(
        m.alias("m"), F.first("motor_range").alias("motor_range"), F.first("discrete").alias("discrete"),
        F.avg("delta").alias("mean"), F.var_pop("delta").alias("var"), F.max(size).alias("max_abs"),
        F.min("delta").alias("lo"), F.max("delta").alias("hi"), F.sum(size).alias("sum_abs"),
        (below <= F.floor(m * 0.95)).alias("active"))


def velocity(frames: DataFrame, feature: str = "action") -> DataFrame:
    """Pooled delta statistics per dimension over its active episodes (over all when none is active)."""
    return velocity_from(materialize(episode_deltas(frames, feature), "episode_deltas"))


def velocity_from(per_episode: DataFrame) -> DataFrame:
    flags = per_episode.groupBy("dim").agg(F.max("active").alias("_any"))
    used = per_episode.join(flags, "dim").filter(F.col("active") | ~F.col("_any"))
    mean = used.groupBy("dim").agg((F.sum(F.col("m") * F.col("mean")) / F.sum("m")).alias("_mean"))
    used = used.join(mean, "dim")
    var = F.sum(F.col("m") * (F.col("var") + F.pow(F.col("mean") - F.col("_mean"), 2))) / F.sum("m")
    r = F.first("motor_range")
    return used.groupBy("dim").agg(
        (F.sqrt(var) / r).alias("std"), (F.max("max_abs") / r).alias("max_abs"), (F.min("lo") / r).alias("lo"),
        (F.max("hi") / r).alias("hi"), r.alias("motor_range"), (~F.first("_any")).alias("inactive"),
        F.first("discrete").alias("discrete"))


def velocity_histogram(frames: DataFrame, feature: str = "action") -> DataFrame:
    """Thirty equal bins of normalised deltas per dimension over the same episodes as ``velocity``."""
    delta = deltas(frames, feature)
    per_episode = materialize(episode_deltas(frames, feature, delta), "episode_deltas")
    stats = materialize(velocity_from(per_episode), "velocity")
    flags = per_episode.groupBy("dim").agg(F.max("active").alias("_any"))
    used = per_episode.join(flags, "dim").filter(F.col("active") | ~F.col("_any")).select(*EPISODE, "dim")
    span = F.col("hi") - F.col("lo")
    width = F.when(span == 0, F.lit(1.0)).otherwise(span) / VELOCITY_BINS
    place = F.least(F.floor((F.col("delta") / F.col("motor_range") - F.col("lo")) / width), F.lit(VELOCITY_BINS - 1))
    counts = delta.join(stats.select("dim", "motor_range", "lo", "hi"), "dim").groupBy(
        *EPISODE, "dim", place.alias("bin")).agg(F.count("*").alias("_c"))
    return counts.join(used, [*EPISODE, "dim"], "left_semi").groupBy("dim", "bin").agg(F.sum("_c").alias("deltas"))


def velocity_verdict(stats: DataFrame, names: DataFrame) -> DataFrame:
    """Smooth / Moderate / Jerky verdict from the spread of the moving dimensions; grippers may be jerky."""
    rows = stats.join(names, "dim")
    considered = ~F.col("inactive") & ~F.col("discrete")
    top = rows.filter(considered).agg(F.max("std").alias("top")).scalar()
    # a spread of zero everywhere has no share, so such dimensions count as neither smooth nor jerky
    rows = rows.withColumn("_share", F.try_divide(F.col("std"), top))
    gripper = F.col("name").rlike("(?i)grip")
    smooth = F.count_if(considered & (F.col("_share") < 0.4))
    jerky = F.count_if(considered & (F.col("_share") >= 0.7) & ~gripper)
    active = F.count_if(considered)
    facts = rows.agg(
        active.alias("active"), smooth.alias("smooth"),
        F.count_if(considered & (F.col("_share") >= 0.4) & (F.col("_share") < 0.7)).alias("moderate"),
        jerky.alias("jerky"), F.count_if(considered & (F.col("_share") >= 0.7) & gripper).alias("jerky_grippers"),
        F.count_if(~considered).alias("excluded"))
    ratio = F.try_divide("smooth", "active")
    return facts.withColumn("verdict", F.when(F.col("active") == 0, "N/A")
                            .when((ratio >= 0.6) & (F.col("jerky") == 0), "Smooth")
                            .when((F.col("jerky") <= 2) & (ratio >= 0.3), "Moderate").otherwise("Jerky"))


def jerkiness(frames: DataFrame, feature: str = "action") -> DataFrame:
    """Mean normalised delta magnitude over the dimensions active in each episode."""
    per = episode_deltas(frames, feature)
    total = F.sum(F.when(F.col("active"), F.col("sum_abs") / F.col("motor_range")))
    count = F.sum(F.when(F.col("active"), F.col("m")))
    moving = per.groupBy(*EPISODE).agg(F.coalesce(total / count, F.lit(0.0)).alias("jerkiness"))
    return episode_lengths(frames).select(*EPISODE).join(moving, EPISODE, "left").select(
        *EPISODE, F.coalesce("jerkiness", F.lit(0.0)).alias("jerkiness"))


def most_jerky(scores: DataFrame, count: int = 15) -> DataFrame:
    return scores.orderBy(F.desc("jerkiness"), "episode_index").limit(count)


def speed_summary(scores: DataFrame) -> DataFrame:
    """Distribution of movement scores: mean, spread, upper median and the consistency verdict (three episodes or more)."""
    median = kth_values(scores, [], "movement", lambda n: F.array(F.floor(n / 2))).select("kth").scalar()
    facts = scores.agg(
        F.count("*").alias("episodes"), F.avg("movement").alias("mean"), F.stddev_pop("movement").alias("std"),
        F.min("movement").alias("lo"), F.max("movement").alias("hi")).withColumn("median", median)
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0)
    span = F.col("hi") - F.col("lo")
    bins = F.least(F.lit(30), F.ceil(F.sqrt("episodes")))
    return facts.filter("episodes >= 3").select(
        "*", cv.alias("cv"), bins.alias("bins"),
        (F.when(span == 0, F.lit(1.0)).otherwise(span) / bins).alias("bin_width"),
        F.when(cv < 0.2, "Consistent").when(cv < 0.4, "Moderate variance").otherwise("High variance").alias("verdict"))


def speed_histogram(scores: DataFrame) -> DataFrame:
    layout = speed_summary(scores).select(F.struct("lo", "bin_width", "bins")).scalar()
    rows = scores.withColumn("_l", layout)
    place = F.least(F.floor((F.col("movement") - F.col("_l.lo")) / F.col("_l.bin_width")), F.col("_l.bins") - 1)
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("episodes"))


def _lag_products(centred: pd.Series, own: pd.Series, lags: pd.Series) -> pd.Series:
    """Sums of ``x[t] * x[t+lag]`` for the block's own rows and lags 1..L; ``centred`` includes the halo."""
    out = []
    for x, n, top in zip(centred, own, lags):
        x = np.asarray(x, dtype=np.float64)
        padded = np.concatenate([x, np.zeros(max(0, int(n) + int(top) - len(x)))])
        windows = np.lib.stride_tricks.sliding_window_view(padded, int(n))
        out.append(windows[1:int(top) + 1] @ x[:int(n)])
    return pd.Series(out)


def autocorrelation(frames: DataFrame, feature: str = "action", max_lag: int = 100) -> DataFrame:
    """Mean autocorrelation over episodes per (dim, lag), lags up to half of the shortest episode."""
    lengths = episode_lengths(frames)
    lags = lengths.agg(F.least(F.lit(max_lag), F.floor(F.min("length") / 2)).cast("int").alias("lags")).scalar()
    per = _autocorrelation(frames, feature, max_lag, lengths.select(*EPISODE, lags.alias("lags")).filter("lags >= 2"))
    # every episode has at least 2 * lags frames, so all of them count
    return per.groupBy("dim", "lag").agg(F.avg("acf").alias("acf"))


def episode_autocorrelation(frames: DataFrame, feature: str = "action", max_lag: int = 100) -> DataFrame:
    """Autocorrelation of each episode by itself, lags up to half of its own length."""
    lags = episode_lengths(frames).select(*EPISODE, F.least(F.lit(max_lag), F.floor(F.col("length") / 2)).cast("int").alias("lags")).filter("lags >= 1")
    return _autocorrelation(frames, feature, max_lag, lags)


def _autocorrelation(frames: DataFrame, feature: str, max_lag: int, lags: DataFrame) -> DataFrame:
    """A block of rows plus ``max_lag`` following ones yields all lag products; one array of sums leaves each block."""
    blocks = vector_blocks(frames, {"x": feature}, after=max_lag)
    means = to_values(frames, [feature]).groupBy(*EPISODE, "dim").agg(
        F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"), F.count("*").alias("_n"))
    rows = blocks.join(means.join(lags, EPISODE), [*EPISODE, "dim"])
    kernel = F.pandas_udf(_lag_products, "array<double>")
    sums = rows.select(
        *EPISODE, "dim", "lags", (F.col("_var") * F.col("_n")).alias("_energy"),
        F.posexplode(kernel(F.transform("x", lambda v: v - F.col("_mean")), "own", "lags")).alias("_p", "_s"))
    per = sums.groupBy(*EPISODE, "dim", (F.col("_p") + 1).alias("lag")).agg(
        F.sum("_s").alias("_s"), F.first("_energy").alias("_energy"))
    # constant series count with 0
    acf = F.when(F.col("_energy") == 0, F.lit(0.0)).otherwise(F.col("_s") / F.col("_energy"))
    return per.select(*EPISODE, "dim", "lag", acf.alias("acf"))


def suggested_chunk(acf: DataFrame) -> DataFrame:
    """Upper median over dimensions of the first lag whose autocorrelation is below one half."""
    first = acf.groupBy("dim").agg(F.min(F.when(F.col("acf") < 0.5, F.col("lag"))).alias("_lag")).filter("_lag is not null")
    lags = first.agg(F.sort_array(F.collect_list("_lag")).alias("_l"))  # one value per vector element
    return lags.select(F.get("_l", F.floor(F.size("_l") / 2).cast("int")).alias("suggested_chunk"))


def vector_blocks(frames: DataFrame, vectors: dict[str, str], before: int = 0, after: int = 0) -> DataFrame:
    """Blocks of at most ``LAG_BLOCK`` own rows as one array per dim: ``(episode, _blk, dim, own, lead, <names>)``.

    ``lead`` counts halo rows in front. Arrays are bounded by the block and halo sizes.
    """
    names = list(vectors)
    rows = halo(frames.select(*EPISODE, "frame_index", *[F.col(c).cast("array<double>").alias(n) for n, c in vectors.items()]),
                "frame_index", before=before, after=after, size=LAG_BLOCK)
    blocks = rows.groupBy(*EPISODE, "_blk").agg(
        F.sort_array(F.collect_list(F.struct("frame_index", "_own", *names))).alias("_rows"))
    start = F.col("_blk") * LAG_BLOCK
    blocks = blocks.select(
        *EPISODE, "_blk", "_rows", F.size(F.filter("_rows", lambda r: r["_own"])).alias("own"),
        F.size(F.filter("_rows", lambda r: r["frame_index"] < start)).alias("lead")).filter("own > 0")
    dims = F.explode(F.sequence(F.lit(0), F.size(F.get("_rows", F.lit(0))[names[0]]) - 1)).alias("dim")
    blocks = blocks.select("*", dims)
    return blocks.select(*EPISODE, "_blk", "dim", "own", "lead",
                         *[F.transform("_rows", _element(n)).alias(n) for n in names])


def _element(name: str):
    return lambda r: F.get(r[name], F.col("dim"))


def _cross_products(a: pd.Series, s: pd.Series, lead: pd.Series, own: pd.Series, reach: pd.Series) -> pd.Series:
    """Per lag -R..R: sums of a*s, a*a and s*s over the overlap; ``s`` has halo rows on both sides."""
    out = []
    for x, y, front, n, r in zip(a, s, lead, own, reach):
        front, n, r = int(front), int(n), int(r)
        x = np.asarray(x, dtype=np.float64)[front:front + n]
        y = np.asarray(y, dtype=np.float64)
        back = len(y) - front - n
        present = np.concatenate([np.zeros(r - front), np.ones(len(y)), np.zeros(r - back)])
        padded = np.concatenate([np.zeros(r - front), y, np.zeros(r - back)])
        shifted = np.lib.stride_tricks.sliding_window_view(padded, n)
        seen = np.lib.stride_tricks.sliding_window_view(present, n)
        out.append(np.concatenate([shifted @ x, seen @ (x * x), (shifted * shifted).sum(axis=1)]))
    return pd.Series(out)


def pair_by_name(action_names: list[str], state_names: list[str]) -> list[tuple[int, int]]:
    """Element pairs with equal names, else equal positions."""
    named = [(i, state_names.index(n)) for i, n in enumerate(action_names) if n in state_names]
    return named or [(i, i) for i in range(min(len(action_names), len(state_names)))]


def alignment(frames: DataFrame, action: str = "action", state: str = "state", max_lag: int = 30,
              pairs: list[tuple[int, int]] | None = None, min_frames: int = 10) -> DataFrame:
    """Mean correlation of action and state deltas per (pair, lag) over episodes of at least ``min_frames``.

    ``pairs`` of (action, state) elements default to equal positions.
    """
    parts = _cross_correlation(frames, action, state, max_lag, pairs, min_frames)
    return parts.groupBy("pair", "lag").agg(F.coalesce(F.avg("corr"), F.lit(0.0)).alias("corr"))


def episode_alignment(frames: DataFrame, action: str = "action", state: str = "state", max_lag: int = 30,
                      pairs: list[tuple[int, int]] | None = None, min_frames: int = 10) -> DataFrame:
    """The same per episode, lags up to a quarter of its length."""
    parts = _cross_correlation(frames, action, state, max_lag, pairs, min_frames)
    reach = F.least(F.lit(max_lag), F.floor((F.col("steps") + 1) / 4))
    return parts.filter((reach >= 2) & (F.abs("lag") <= reach)).select(*EPISODE, "pair", "lag", F.coalesce("corr", F.lit(0.0)).alias("corr"))


def _cross_correlation(frames: DataFrame, action: str, state: str, max_lag: int, pairs: list[tuple[int, int]] | None, min_frames: int) -> DataFrame:
    """``(episode, pair, lag, corr, steps)``: means from the whole delta series, norms from the overlap only."""
    if pairs is not None:
        a = F.array(*[F.get(action, F.lit(i)) for i, _ in pairs])
        s = F.array(*[F.get(state, F.lit(j)) for _, j in pairs])
    else:
        width = F.least(F.size(action), F.size(state))
        a, s = F.slice(action, F.lit(1), width), F.slice(state, F.lit(1), width)
    rows = frames.select(*EPISODE, "frame_index", a.cast("array<double>").alias("_a"), s.cast("array<double>").alias("_s"))
    steps = lagged(rows, {"_pa": "_a", "_ps": "_s"})
    # the first frame has no predecessor; positions shift down so that delta series start at 0
    steps = steps.filter("_pa is not null").select(
        *EPISODE, (F.col("frame_index") - 1).alias("frame_index"),
        F.zip_with("_a", "_pa", lambda x, y: x - y).alias("a"), F.zip_with("_s", "_ps", lambda x, y: x - y).alias("s"))
    means = steps.select(*EPISODE, F.posexplode(F.arrays_zip("a", "s")).alias("dim", "z")).groupBy(*EPISODE, "dim").agg(
        F.avg("z.a").alias("_ma"), F.avg("z.s").alias("_ms"), F.count("*").alias("steps")).filter(F.col("steps") >= min_frames - 1)
    blocks = vector_blocks(steps, {"a": "a", "s": "s"}, before=max_lag, after=max_lag).join(means, [*EPISODE, "dim"])
    kernel = F.pandas_udf(_cross_products, "array<double>")
    sums = blocks.select(*EPISODE, "dim", "steps", kernel(
        F.transform("a", lambda v: v - F.col("_ma")), F.transform("s", lambda v: v - F.col("_ms")),
        "lead", "own", F.lit(max_lag)).alias("_k"))
    width = 2 * max_lag + 1
    at = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_i")
    parts = sums.select(*EPISODE, "dim", "steps", "_k", at).groupBy(*EPISODE, "dim", (F.col("_i") - max_lag).alias("lag")).agg(
        F.sum(F.get("_k", F.col("_i"))).alias("_xy"), F.sum(F.get("_k", F.col("_i") + width)).alias("_xx"),
        F.sum(F.get("_k", F.col("_i") + 2 * width)).alias("_yy"), F.first("steps").alias("steps"))
    norm = F.sqrt(F.col("_xx") * F.col("_yy"))
    return parts.select(*EPISODE, F.col("dim").alias("pair"), "lag", "steps", F.when(norm > 0, F.col("_xy") / norm).alias("corr"))


def alignment_profile(corr: DataFrame) -> DataFrame:
    """Highest, mean and lowest correlation over pairs at each lag."""
    return corr.groupBy("lag").agg(F.max("corr").alias("max"), F.avg("corr").alias("mean"), F.min("corr").alias("min"))


def alignment_peaks(corr: DataFrame) -> DataFrame:
    """Peak lags (the smallest lag wins ties) of the profile and the range of peak lags over pairs."""
    profile = alignment_profile(corr)
    peak = [F.max_by("lag", F.struct(F.col(c), -F.col("lag"))).alias(f"{c}_peak_lag") for c in ("max", "mean", "min")]
    best = [F.max(c).alias(f"{c}_peak_corr") for c in ("max", "mean", "min")]
    own = corr.groupBy("pair").agg(F.max_by("lag", F.struct(F.col("corr"), -F.col("lag"))).alias("_lag"))
    span = own.agg(F.min("_lag").alias("lag_range_min"), F.max("_lag").alias("lag_range_max"), F.count("*").alias("pairs"))
    one = span.select(F.struct("lag_range_min", "lag_range_max", "pairs")).scalar()
    return profile.agg(*peak, *best).withColumn("_s", one).select("*", "_s.*").drop("_s")


SCALE_DISTANCE = 2.0  # orders of magnitude two series may differ to share a chart
SERIES_PER_CHART = 6


def scale_groups(values: DataFrame) -> DataFrame:
    """Charts ``(chart, place, series)``: series with the same suffix stay together, groups of similar scale share a chart.

    ``values(series, ord, value)``; ranges are aggregated in Spark. One row per suffix, as many as the declaration has
    names, comes to the driver, where groups are formed in declaration order.
    """
    suffix = F.coalesce(F.get(F.split("series", r" \| "), F.lit(1)), F.col("series"))
    per = values.groupBy(suffix.alias("suffix"), "series").agg(F.min("ord").alias("ord"), F.min(F.nanvl("value", F.lit(None))).alias("lo"), F.max(F.nanvl("value", F.lit(None))).alias("hi"))
    rows = per.groupBy("suffix").agg(F.min("ord").alias("ord"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                     F.array_sort(F.collect_list(F.struct("ord", "series"))).alias("members")).orderBy("ord").collect()
    usable = [g for g in rows if g.lo is not None and np.isfinite(g.lo) and np.isfinite(g.hi)]
    scale = {g.suffix: np.log10(np.abs([g.lo, g.hi]) + 1e-9) for g in usable}
    charts, taken = [], set()
    for lead in usable:
        if lead.suffix in taken:
            continue
        # a group without any range only ever opens its own chart
        same = [g for g in usable if g.suffix == lead.suffix or (
            g.suffix not in taken and g.lo != g.hi and (np.abs(scale[g.suffix] - scale[lead.suffix]) <= SCALE_DISTANCE).all())]
        same.sort(key=lambda g: g.suffix != lead.suffix)
        taken.update(g.suffix for g in same)
        charts.append((len(same), [m.series for g in same for m in g.members]))
    charts.sort(key=lambda chart: -chart[0])
    cut = [names[i:i + SERIES_PER_CHART] for _, names in charts for i in range(0, len(names), SERIES_PER_CHART)]
    flat = [(number, place, name) for number, names in enumerate(cut) for place, name in enumerate(names)]
    return values.sparkSession.createDataFrame(flat, "chart int, place int, series string")


def insight_report(frames: DataFrame, feature: str = "action") -> DataFrame:
    """Per-episode insight table: length, movement, jerkiness and number of active dimensions."""
    x = frames.select(*EPISODE, "frame_index", F.col(feature).cast("array<double>").alias("_x"))
    steps = lagged(x, {"_prev": "_x"}).withColumn("_step", F.when(F.col("_prev").isNotNull(), vector_distance(F.col("_x"), F.col("_prev"))))
    # the first frame keeps one row per element, with NULL deltas, so that lengths come from the same pass
    long = steps.select(*EPISODE, "_step", F.posexplode(F.arrays_zip(F.col("_x").alias("cur"), F.coalesce(
        "_prev", F.transform("_x", lambda v: F.lit(None).cast("double"))).alias("prev"))).alias("dim", "z"))
    ranges = materialize(motor_ranges(frames, feature), "ranges")  # one row per vector element
    rows = long.join(ranges, "dim").withColumn("_d", F.abs(F.col("z.cur") - F.col("z.prev")))
    m = F.count("_d")
    below = F.count_if(F.col("_d") < F.col("motor_range") * ACTIVITY_SHARE)
    per = rows.groupBy(*EPISODE, "dim").agg(
        F.count("*").alias("length"), F.avg("_step").alias("_move"), m.alias("_m"), (F.sum("_d") / F.first("motor_range")).alias("_sum"),
        ((m > 0) & (below <= F.floor(m * 0.95))).alias("active"))
    total, count = F.sum(F.when(F.col("active"), F.col("_sum"))), F.sum(F.when(F.col("active"), F.col("_m")))
    return per.groupBy(*EPISODE).agg(
        F.max("length").alias("length"), F.coalesce(round_half_up(F.max("_move"), 4), F.lit(0.0)).alias("movement"),
        F.coalesce(total / count, F.lit(0.0)).alias("jerkiness"), F.count_if("active").alias("active_dims"))


# Fixed values of the unit detector and the gripper mapping.
TICKS_ABOVE = 360.0
DEGREES_ABOVE = 6.3
GRIPPER_TRAVEL = 0.044


def joint_radians(frames: DataFrame, feature: str = "state") -> DataFrame:
    """Per-frame unit detection: servo ticks, degrees or radians by the largest magnitude, converted to radians."""
    values = F.col(feature).cast("array<double>")
    top = F.array_max(F.transform(values, lambda x: F.abs(x)))
    unit = F.when(top > TICKS_ABOVE, "ticks").when(top > DEGREES_ABOVE, "degrees").otherwise("radians")
    rows = frames.select(*EPISODE, "frame_index", values.alias("_x"), unit.alias("unit"))
    radians = F.when(F.col("unit") == "ticks", F.transform("_x", lambda x: (x - 2048.0) / 2048.0 * F.pi())).when(
        F.col("unit") == "degrees", F.transform("_x", lambda x: F.radians(x))).otherwise(F.col("_x"))
    return rows.select(*EPISODE, "frame_index", "unit", radians.alias("radians"))


def gripper_opening(frames: DataFrame, feature: str, dim: int) -> DataFrame:
    """Gripper element mapped from its own range in the episode to the physical opening in metres."""
    x = F.get(F.col(feature), F.lit(dim)).cast("double")
    rows = frames.select(*EPISODE, "frame_index", x.alias("_x"))
    span = rows.groupBy(*EPISODE).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), (F.max("frame_index") + 1).alias("length"))
    width = F.col("_hi") - F.col("_lo")
    return attach(rows, span).select(
        *EPISODE, "frame_index",
        F.when(width > 0, (F.col("_x") - F.col("_lo")) / width * GRIPPER_TRAVEL)
        .otherwise(F.col("_x") / 100.0 * GRIPPER_TRAVEL).alias("opening"))
