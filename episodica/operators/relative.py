"""Chunk-relative action profile: ``action[t+k] - state[t]`` over every full chunk of each episode."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.operators import ranks
from episodica.operators.series import EPISODE, attach, episode_lengths, halo
from episodica.operators.stats import QUANTILES, STATISTICS, finish_moments, merge_moments
from episodica.session import materialize


def pair_names(action_names: Sequence[str], state_names: Sequence[str], wanted: Sequence[str]) -> list[int]:
    """Positions of the wanted names; a name must be unique and sit at the same position in both features."""
    if len(action_names) != len(state_names) or len(set(action_names)) != len(action_names):
        raise ValueError("action and state need equal widths and unique names")
    out = []
    for name in wanted:
        if name not in action_names or state_names[action_names.index(name)] != name:
            raise ValueError(f"dimension {name} is not at the same position in action and state")
        out.append(action_names.index(name))
    if not out:
        raise ValueError("choose at least one relative dimension")
    return out


def relative_values(frames: DataFrame, dims: Sequence[int], chunk: int) -> DataFrame:
    """Long ``(dim, value)`` of the relative elements in single precision. Chunks never cross an episode."""
    if not 1 <= chunk <= 1024:
        raise ValueError("chunk size must be within 1..1024")
    a = F.array(*[F.get("action", F.lit(d)).cast("float") for d in dims])
    s = F.array(*[F.get("state", F.lit(d)).cast("float") for d in dims])
    rows = halo(frames.select(*EPISODE, "frame_index", a.alias("_a"), s.alias("_s")), "frame_index", after=chunk - 1)
    w = Window.partitionBy(*EPISODE, "_blk").orderBy("frame_index").rowsBetween(0, chunk - 1)
    ahead = rows.select(*EPISODE, "_own", "_s", F.collect_list("_a").over(w).alias("_ahead")).filter(
        F.col("_own") & (F.size("_ahead") == chunk))
    steps = ahead.select("_s", F.explode("_ahead").alias("_a"))
    long = steps.select(F.posexplode(F.arrays_zip("_a", "_s")).alias("_i", "z"))
    names = F.array(*[F.lit(d) for d in dims])
    return long.select(F.get(names, F.col("_i")).alias("dim"), (F.col("z._a") - F.col("z._s")).cast("double").alias("value"))


def absolute_values(frames: DataFrame, dims: Sequence[int], chunk: int) -> DataFrame:
    """Long ``(dim, value, weight)`` of untouched elements: frame t lies in ``weight`` full chunks, nothing is repeated."""
    rows = attach(frames.select(*EPISODE, "frame_index", "action"), episode_lengths(frames)).filter(F.col("length") >= chunk)
    t, n = F.col("frame_index"), F.col("length")
    weight = F.least(t + 1, F.lit(chunk), n - t, n - chunk + 1)
    picked = F.array(*[F.struct(F.lit(d).alias("dim"), F.get("action", F.lit(d)).cast("float").cast("double").alias("value")) for d in dims])
    return rows.select(weight.alias("weight"), F.explode(picked).alias("e")).select("e.dim", "e.value", "weight")


def _chunk_values(rows: pa.StructArray, element: int, moved: bool, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of one element over the full chunks that start in a block, and how often each occurs."""
    a = _element(rows.field("a"), len(rows), element)
    starts = min(int(np.count_nonzero(rows.field("_own").to_numpy(zero_copy_only=False))), len(a) - chunk + 1)
    if starts <= 0:
        return np.zeros(0), np.zeros(0, np.int64)
    if moved:
        s = _element(rows.field("s"), len(rows), element)
        found, times = np.unique(np.lib.stride_tricks.sliding_window_view(a, chunk)[:starts] - s[:starts, None], return_counts=True)
    else:  # an untouched row counts once for each chunk that it lies in
        at = np.arange(starts + chunk - 1)
        often = np.minimum(at, starts - 1) - np.maximum(at - chunk + 1, 0) + 1
        found, place = np.unique(a[:len(at)], return_inverse=True)
        times = np.bincount(place, often, len(found)).astype(np.int64)
    keep = ~np.isnan(found)
    return found[keep].astype(np.float64), times[keep]


def _element(vectors: pa.ListArray, n: int, element: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(n, -1)[:, element]


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.StructArray]:
    for batch in batches:
        lists = batch.column("_rows")
        for i in range(len(lists)):
            yield lists[i].values


def _digits(values: np.ndarray) -> np.ndarray:
    """Sign, exponent and eight bits of the fraction of ascending doubles, as ascending numbers."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits) >> 44


def _count_block(elements: Sequence[tuple[int, int, bool]], chunk: int):
    """Bins and, with a null bin, moments of every element of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks_of(batches):
            out = [[] for _ in range(7)]
            for dim, element, moved in elements:
                values, times = _chunk_values(rows, element, moved, chunk)
                if not len(values):
                    continue
                digit = _digits(values)
                first = np.flatnonzero(np.diff(digit, prepend=digit[0] - 1))
                last = np.append(first[1:], len(digit)) - 1
                mean = float(np.average(values, weights=times))
                parts = (digit[first], np.add.reduceat(times, first), values[first], values[last])
                for column, part, own in zip(out[1:5], parts, (None, int(times.sum()), values[0], values[-1])):
                    column += [*part.tolist(), own]
                out[0] += [dim] * (len(first) + 1)
                out[5] += [None] * len(first) + [mean]
                out[6] += [None] * len(first) + [float(np.average((values - mean) ** 2, weights=times))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (
                pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()))], ["dim", "_bin", "_c", "lo", "hi", "mean", "var"])
    return run


def _values_inside(elements: Sequence[tuple[int, int, bool]], chunk: int, places: dict[int, list[tuple[float, float]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks_of(batches):
            out = [[] for _ in range(5)]
            for dim, element, moved in elements:
                if dim not in places:
                    continue
                values, times = _chunk_values(rows, element, moved, chunk)
                for low, high in places[dim]:
                    some = slice(np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right"))
                    n = len(values[some])
                    for column, part in zip(out, ([dim] * n, [low] * n, [high] * n, values[some].tolist(), times[some].tolist())):
                        column += part
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))],
                                             ["dim", "_lo", "_hi", "_v", "_w"])
    return run


def profile(frames: DataFrame, dims: Sequence[int], width: int, chunk: int = 50) -> DataFrame:
    """Ten statistics per action element over all full chunks; ``dims`` are relative, the others absolute.

    Frames are read once and kept as blocks of at most ``BLOCK`` + ``chunk`` rows. A block's differences are made, sorted and
    collapsed inside its task; what leaves it are its moments and the counts of its first digits, so that neither the shuffle
    nor anything that is written grows with ``chunk``. Only values in the bins that hold a wanted rank are read on. NaN and
    missing numbers are left out.
    """
    if not 1 <= chunk <= 1024:
        raise ValueError("chunk size must be within 1..1024")
    picked = [*dims, *[d for d in range(width) if d not in dims]]
    elements = [(d, at, at < len(dims)) for at, d in enumerate(picked)]
    number = lambda name, d: F.coalesce(F.get(name, F.lit(d)).cast("float"), F.lit(float("nan")))
    vectors = [F.array(*[number(column, d) for d in picked]).alias(short) for column, short in (("action", "a"), ("state", "s"))]
    rows = halo(frames.select(*EPISODE, "frame_index", *vectors), "frame_index", after=chunk - 1)
    blocks = materialize(rows.groupBy(*EPISODE, "_blk").agg(
        F.sort_array(F.collect_list(F.struct("frame_index", "_own", "a", "s"))).alias("_rows")).select("_rows"), "chunks")
    counted = materialize(blocks.mapInArrow(_count_block(elements, chunk), "dim int, _bin long, _c long, lo double, hi double, mean double, var double"), "digits")
    moments = counted.filter("_bin is null").select("dim", F.col("_c").alias("n"), F.col("lo").alias("min"), F.col("hi").alias("max"),
                                                    F.col("mean").alias("anchor"), F.lit(0.0).alias("shift"), "var")

    def inside(places: DataFrame) -> DataFrame:
        found: dict[int, list[tuple[float, float]]] = {}
        for p in places.collect():  # at most ten bins of a declared element
            found.setdefault(p.dim, []).append((p._lo, p._hi))
        return blocks.mapInArrow(_values_inside(elements, chunk, found), "dim int, _lo double, _hi double, _v double, _w long")

    bins = ranks.roll_up(counted.filter("_bin is not null"), ["dim"])
    quants = ranks.interpolated(ranks.select_ranks(bins, ["dim"], ranks.quantile_ranks(list(QUANTILES.values())), inside), ["dim"], QUANTILES).drop("n")
    whole = finish_moments(merge_moments(moments, ["dim"]), ["dim"])
    return whole.join(quants, "dim").select("dim", *STATISTICS, F.col("dim").isin(list(dims)).alias("relative"))


def coverage(frames: DataFrame, chunk: int = 50) -> DataFrame:
    """How many episodes and chunks the profile covers; shorter episodes are counted, not used."""
    lengths = episode_lengths(frames)
    chunks = F.greatest(F.col("length") - chunk + 1, F.lit(0))
    return lengths.agg(
        F.count("*").alias("episodes_total"), F.count_if(chunks > 0).alias("episodes_used"),
        F.count_if(chunks == 0).alias("episodes_skipped_short"), F.sum(chunks).alias("valid_chunks"))
