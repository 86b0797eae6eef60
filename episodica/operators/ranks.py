"""Exact order statistics by radix selection, with the same steps for every group size.

A first digit sorts the values of a group into bins of 1/``OCTAVE`` of a doubling, which needs neither the group's ends nor
a join; one grouped count with partial aggregation fills them. The bin that holds a wanted rank is then split into ``SPLIT``
equal parts between its own smallest and largest value, and so on until a bin holds one value. Both ends of a bin always
fall into different parts, and a double has 52 bits below its first digit, so three splits suffice. After the first count
only values in such a bin are read on. Nothing is sampled, gathered in arrays or broadcast by hand, and a hot group is
spread over its bins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.session import materialize

#: Bins of a doubling in the first digit, parts of a bin in the further ones. A window orders the bins of one group:
#: at most 2 * 2124 * OCTAVE in the first step, usually some thousand, and SPLIT in the others.
OCTAVE = 256
SPLIT = 1 << 16
#: Above all magnitudes that a finite double can have in the first digit.
_BEYOND = 1 << 30
Ranks = Callable[[Column], Column]


def first_digit(v: Column) -> Column:
    """Ascending number of a double's bin: by sign, then by the logarithm of its size."""
    size = F.floor((F.log2(F.abs(v)) + 1100) * OCTAVE) + 1  # the smallest double is 2^-1074
    infinite = float("inf")
    return F.when(v == 0, F.lit(0)).when(v == infinite, F.lit(_BEYOND)).when(v == -infinite, F.lit(-_BEYOND)).when(v < 0, -size).otherwise(size).cast("int")


def _part(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.floor((v - lo) / (hi - lo) * SPLIT), F.lit(SPLIT - 1)).cast("int")


def weighted(values: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """``(by, _v, _w)`` without NULL and NaN."""
    w = F.col(weight) if weight else F.lit(1)
    return values.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *by, F.col(value).cast("double").alias("_v"), w.cast("bigint").alias("_w"))


def _count(rows: DataFrame, place: Sequence[str]) -> DataFrame:
    return rows.groupBy(*place).agg(F.sum("_w").alias("_c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def bins(values: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """``(by, _bin, _c, lo, hi)``: number, smallest and largest of the values of each first digit."""
    return _count(weighted(values, by, value, weight).withColumn("_bin", first_digit(F.col("_v"))), [*by, "_bin"])


def roll_up(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bins of coarser groups out of bins of finer ones."""
    return parts.groupBy(*by, "_bin").agg(F.sum("_c").alias("_c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def kth_values(
    values: DataFrame, by: Sequence[str], value: str, ranks: Ranks, weight: str | None = None, counted: DataFrame | None = None,
) -> DataFrame:
    """``(by, n, rank, kth)`` for the 0-based ``ranks(n)`` array of every group; NULL and NaN are ignored.

    With ``weight`` a row counts that many times. ``counted`` are the ``bins`` where they are known already.
    """
    def inside(places: DataFrame) -> DataFrame:
        rows = weighted(values, by, value, weight).withColumn("_bin", first_digit(F.col("_v")))
        return _within(rows, places, [*by, "_bin"])

    return select_ranks(bins(values, by, value, weight) if counted is None else counted, by, ranks, inside)


def select_ranks(counted: DataFrame, by: Sequence[str], ranks: Ranks, inside: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(by, n, rank, kth)`` from ``bins`` and from ``inside``, which gives ``(by, _lo, _hi, _v, _w)``, the values that lie in
    the bins ``(by, _bin, _lo, _hi)`` that it is handed."""
    by = list(by)
    upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    steps = counted.select(*by, "_bin", "_c", "lo", "hi", F.sum("_c").over(upto).alias("_upto"), F.sum("_c").over(Window.partitionBy(*by)).alias("n"))
    before = F.col("_upto") - F.col("_c")
    hit = F.filter(F.array_distinct(ranks(F.col("n"))).cast("array<bigint>"), lambda r: (r >= before) & (r < F.col("_upto")))
    open_ = steps.select(*by, "n", "_bin", before.alias("below"), "lo", "hi", F.explode(hit).alias("rank"))
    done: list[DataFrame] = []
    interval, rows = by, None
    while True:
        open_ = materialize(open_, "ranks")
        done.append(open_.filter("lo = hi").select(*by, "n", "rank", F.col("lo").alias("kth")))
        pending = open_.filter("lo < hi")
        if pending.isEmpty():
            break
        places = pending.select(*interval, "_bin", F.col("lo").alias("_l"), F.col("hi").alias("_h")).distinct()
        if rows is None:
            rows = inside(places.withColumnsRenamed({"_l": "_lo", "_h": "_hi"}))
        else:
            rows = _same(rows.withColumn("_bin", _part(F.col("_v"), F.col("_lo"), F.col("_hi"))), places, [*interval, "_bin"]).select(
                *[F.col(f"l.{k}") for k in by], F.col("r._l").alias("_lo"), F.col("r._h").alias("_hi"), "l._v", "l._w")
        rows = materialize(rows, "inside")
        interval = [*by, "_lo"]  # disjoint intervals: the lower end names one
        found = _count(rows.withColumn("_bin", _part(F.col("_v"), F.col("_lo"), F.col("_hi"))), [*interval, "_bin"])
        upto = Window.partitionBy(*interval).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("_upto", F.sum("_c").over(upto))
        wanted = pending.select(*by, "n", "rank", "below", F.col("lo").alias("_lo"))
        local, before = F.col("l.rank") - F.col("l.below"), F.col("r._upto") - F.col("r._c")
        open_ = _same(wanted, found, interval).filter((local >= before) & (local < F.col("r._upto"))).select(
            *[F.col(f"l.{k}") for k in interval], "l.n", "l.rank", (F.col("l.below") + before).alias("below"), "r._bin", "r.lo", "r.hi")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` as l and ``right`` as r where all keys are the same, NULL being a value like others."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return left.alias("l").join(right.alias("r"), condition)


def _within(rows: DataFrame, places: DataFrame, keys: Sequence[str]) -> DataFrame:
    by = [k for k in keys if k != "_bin"]
    return _same(rows, places, keys).select(*[F.col(f"l.{k}") for k in by], "r._lo", "r._hi", "l._v", "l._w")


def quantile_ranks(qs: Sequence[float]) -> Ranks:
    return lambda n: F.flatten(F.array(*[
        F.array(F.floor((n - 1) * F.lit(q)), F.ceil((n - 1) * F.lit(q))) for q in qs]))


def interpolated(picked: DataFrame, by: Sequence[str], names: dict[str, float]) -> DataFrame:
    """``(by, n)`` and the linear-interpolated quantiles ``names`` of picked ranks."""
    # the two ranks around each quantile are found by rank, so one small map per group is enough
    lookup = picked.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "kth"))).alias("_m"))
    columns = []
    for name, q in names.items():
        at = (F.col("n") - 1) * F.lit(q)
        low, high = F.col("_m")[F.floor(at)], F.col("_m")[F.ceil(at)]
        # equal neighbours are taken as they are: the difference of two infinite ones is no number
        columns.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name))
    return lookup.select(*by, "n", *columns)


def quantiles(
    values: DataFrame, by: Sequence[str], value: str, names: dict[str, float], weight: str | None = None, counted: DataFrame | None = None,
) -> DataFrame:
    """Linear-interpolated exact quantiles as columns ``names`` per group, with the row count ``n``."""
    return interpolated(kth_values(values, by, value, quantile_ranks(list(names.values())), weight, counted), list(by), names)
