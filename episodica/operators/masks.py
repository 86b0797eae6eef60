"""Operators over mask and visibility tables (areas per frame, visible frame ranges per candidate)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.operators.series import BLOCK, carry, lagged, running, runs
from episodica.session import materialize


def visible_ranges(areas: DataFrame, keys: Sequence[str], frame: str = "frame_index") -> DataFrame:
    """Inclusive runs of frames on which the object has pixels."""
    return runs(areas.filter(F.col("area") > 0), keys, frame)


def coverage_steps(ranges: DataFrame, keys: Sequence[str], edges: DataFrame | None = None) -> DataFrame:
    """Piecewise cover count ``(keys, from, to, cover)`` of possibly overlapping ranges, as [from, to).

    Works on range ends only; frames are never listed. ``edges(keys, pos)`` adds cut points.
    """
    keys = list(keys)
    ends = ranges.select(*keys, F.explode(F.array(
        F.struct(F.col("start").cast("bigint").alias("pos"), F.lit(1).alias("d")),
        F.struct((F.col("end") + 1).cast("bigint").alias("pos"), F.lit(-1).alias("d")))).alias("e")).select(
        *keys, "e.pos", "e.d", F.lit(0).alias("edge"))
    if edges is not None:
        ends = ends.unionByName(edges.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.lit(0).alias("d"), F.lit(1).alias("edge")))
    steps = ends.groupBy(*keys, "pos").agg(F.sum("d").alias("d"), F.max("edge").alias("edge")).filter("d <> 0 or edge = 1")
    # two rows per range at most, read several times below
    steps = materialize(steps, "range_ends")
    steps = running(steps, keys, "pos", F.col("d"), "cover")
    return carry(steps, keys, ["pos"], F.col("pos"), "to", reverse=True, inclusive=False).select(
        *keys, F.col("pos").alias("from"), "to", "cover")


def participating(candidates: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Candidates that count: free ones, auto-selected ones and explicitly selected ones."""
    rows = candidates
    chosen = F.lit(False)
    if selected is not None:
        rows = rows.join(selected.select("candidate_id", F.lit(True).alias("_chosen")).distinct(), "candidate_id", "left")
        chosen = F.coalesce("_chosen", F.lit(False))
    kept = rows.filter(~F.col("requires_selection") | F.coalesce("auto_selected", F.lit(False)) | chosen)
    return kept.drop("_chosen")


def object_coverage(candidates: DataFrame, ranges: DataFrame, frame_count: Column | int, selected: DataFrame | None = None) -> DataFrame:
    """Visible and missing frames per object over the candidates that take part.

    ``candidates(candidate_id, object_id, target, requires_selection, auto_selected, tracked)``; an object with an
    untracked candidate is left out rather than guessed. ``ranges(candidate_id, start, end)``.
    """
    used = participating(candidates, selected)
    objects = used.groupBy("object_id").agg(
        F.min_by("target", "candidate_id").alias("target"), F.min("tracked").alias("_known")).filter("_known").drop("_known")
    spans = ranges.join(used.select("candidate_id", "object_id"), "candidate_id").join(objects.select("object_id"), "object_id", "left_semi")
    total = frame_count if isinstance(frame_count, Column) else F.lit(frame_count).cast("bigint")
    edges = objects.select("object_id", F.explode(F.array(F.lit(0).cast("bigint"), total)).alias("pos"))
    steps = coverage_steps(spans.select("object_id", "start", "end"), ["object_id"], edges)
    size = F.col("to") - F.col("from")
    facts = steps.groupBy("object_id").agg(
        F.coalesce(F.sum(F.when(F.col("cover") > 0, size)), F.lit(0)).alias("visible_frames"),
        F.count_if((F.col("cover") == 0) & (F.col("from") < total) & size.isNotNull()).alias("gaps"),
        F.min(F.when((F.col("cover") == 0) & (F.col("from") < total) & size.isNotNull(), F.col("from"))).alias("first_missing"))
    return objects.join(facts, "object_id").withColumn("frame_count", total)


def missing_ranges(candidates: DataFrame, ranges: DataFrame, frame_count: int, selected: DataFrame | None = None) -> DataFrame:
    """Inclusive frame ranges on which a participating object is not visible."""
    used = participating(candidates, selected)
    objects = used.groupBy("object_id").agg(F.min("tracked").alias("_known")).filter("_known").select("object_id")
    spans = ranges.join(used.select("candidate_id", "object_id"), "candidate_id").join(objects, "object_id", "left_semi")
    edges = objects.select("object_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(frame_count).cast("bigint"))).alias("pos"))
    steps = coverage_steps(spans.select("object_id", "start", "end"), ["object_id"], edges)
    gaps = steps.filter((F.col("cover") == 0) & (F.col("from") < frame_count) & F.col("to").isNotNull())
    return gaps.select("object_id", F.col("from").alias("start"), (F.least("to", F.lit(frame_count)) - 1).alias("end"))


def coverage_signals(coverage: DataFrame) -> DataFrame:
    """One review row per object that is missing somewhere, at its first missing frame."""
    return coverage.filter("gaps > 0").select(
        F.col("first_missing").alias("frame_index"), F.lit("object_gap").alias("reason"), "object_id",
        (F.col("frame_count") - F.col("visible_frames")).alias("missing_frames"))


def auto_select(candidates: DataFrame, ranges: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Decision per object that needs a choice: ``explicit``, ``auto`` or ``unresolved``.

    Automatic when there is one proposal, or when all are tracked and never visible together: the summed length of
    the ranges equals the length of their union.
    """
    pending = candidates.filter("requires_selection")
    if selected is None:
        selected = candidates.select("candidate_id").limit(0)
    flagged = pending.join(selected.select("candidate_id", F.lit(True).alias("_chosen")).distinct(), "candidate_id", "left")
    spans = ranges.join(pending.select("candidate_id", "object_id"), "candidate_id")
    with_range = spans.select("candidate_id").distinct().withColumn("_ranged", F.lit(True))
    objects = flagged.join(with_range, "candidate_id", "left").groupBy("object_id").agg(
        F.count("*").alias("proposals"), F.max(F.coalesce("_chosen", F.lit(False))).alias("_chosen"),
        F.min(F.coalesce("_ranged", F.lit(False)) & F.col("tracked")).alias("_all_ranged"))
    length = spans.groupBy("object_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("_sum"))
    union = coverage_steps(spans.select("object_id", "start", "end"), ["object_id"]).filter("cover > 0").groupBy("object_id").agg(
        F.sum(F.col("to") - F.col("from")).alias("_union"))
    rows = objects.join(length, "object_id", "left").join(union, "object_id", "left")
    apart = F.col("_all_ranged") & (F.col("_sum") == F.col("_union"))
    return rows.select("object_id", "proposals", F.when(F.col("_chosen"), "explicit").when(
        (F.col("proposals") == 1) | F.coalesce(apart, F.lit(False)), "auto").otherwise("unresolved").alias("decision"))


def selection_signals(candidates: DataFrame) -> DataFrame:
    """Review rows for automatic choices: re-entries first, then plain automatic selections."""
    auto = F.coalesce("auto_selected", F.lit(False))
    again = F.coalesce("reentry", F.lit(False)) | (auto & F.coalesce("late_track", F.lit(False)))
    reason = F.when(again, "reentry").when(auto, "auto_selected")
    frame = F.when(again, F.coalesce("first_visible_frame", "frame_index", F.lit(0))).otherwise(F.coalesce("frame_index", F.lit(0)))
    return candidates.select(frame.alias("frame_index"), reason.alias("reason"), "candidate_id").filter("reason is not null")


def review_signals(areas: DataFrame, keys: Sequence[str], full_area: Column | int, frame: str = "frame_index") -> DataFrame:
    """Empty, full or abruptly changing masks; the first matching reason is reported."""
    keys = list(keys)
    full = full_area if isinstance(full_area, Column) else F.lit(full_area)
    rows = lagged(areas.select(*keys, frame, "area"), {"_prev": "area"}, keys, frame)
    jump = F.abs(F.col("area") - F.col("_prev")) > F.greatest("area", "_prev") * 0.5
    reason = F.when(F.col("area") == 0, "empty_mask").when(F.col("area") == full, "full_frame_mask").when(jump, "abrupt_area_change")
    return rows.select(*keys, frame, reason.alias("reason")).filter("reason is not null")


def unmatched_prompts(prompts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Prompts without a visible candidate of the same target and, where the prompt names one, the same object."""
    seen = candidates.filter("area_pixels > 0").select("object_id", "target").distinct()
    named = prompts.filter("object_id is not null").join(seen, ["object_id", "target"], "left_anti")
    free = prompts.filter("object_id is null").join(seen.select("target").distinct(), "target", "left_anti")
    return named.unionByName(free)


class _Room:
    """Occupancy of the frames from the current one on, as steps: ``taken[i]`` tracks on ``[cuts[i], cuts[i + 1])``."""

    def __init__(self) -> None:
        self.cuts, self.taken = [-(1 << 62)], [0]

    def _at(self, frame: int) -> int:
        i = bisect_left(self.cuts, frame)
        if i == len(self.cuts) or self.cuts[i] != frame:
            self.cuts.insert(i, frame)
            self.taken.insert(i, self.taken[i - 1])
        return i

    def most(self, start: int, end: int) -> int:
        return max(self.taken[bisect_right(self.cuts, start) - 1:bisect_right(self.cuts, end)])

    def add(self, start: int, end: int) -> None:
        low, high = self._at(start), self._at(end + 1)
        for i in range(low, high):
            self.taken[i] += 1

    def forget(self, frame: int) -> None:
        """Frames before ``frame`` are not asked for again."""
        i = bisect_right(self.cuts, frame) - 1
        if i > 4096:
            del self.cuts[:i], self.taken[:i]


def _merged(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending pieces of a track without overlaps: a frame counts once."""
    out: list[tuple[int, int]] = []
    for start, end in pieces:
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy acceptance, set by set in the order of first frames. From batch to batch only the room ahead is carried on."""
    held, room, pieces = None, _Room(), []  # held: set, track, whether initial, capacity
    done: list[tuple] = []

    def settle() -> None:
        if held is None or not pieces:
            return
        spans = _merged(pieces)
        if not held[2]:
            room.forget(spans[0][0])
        fits = held[2] or all(room.most(a, b) < held[3] for a, b in spans)
        if fits:
            for a, b in spans:
                room.add(a, b)
        if not held[2]:
            done.append((held[0][0], held[1], fits))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("group_id", "part", "track_id", "initial", "capacity", "start", "end")]
        for group, part, track, initial, capacity, start, end in zip(*columns):
            if held is None or held[0] != (group, part) or held[1] != track:
                settle()
                if held is None or held[0] != (group, part):
                    room = _Room()
                held, pieces = ((group, part), track, initial, capacity), []
            pieces.append((start, end))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.bool_()))], ["group_id", "track_id", "_ok"])
            done = []
    settle()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.bool_()))], ["group_id", "track_id", "_ok"])


def late_tracks(ranges: DataFrame) -> DataFrame:
    """Accept late tracks by first visible frame while every visible frame has room.

    ``ranges(group_id, track_id, start, end, initial, capacity)``; a NULL capacity accepts all. Where no more tracks
    are visible than the capacity allows, a track cannot be refused, so only stretches with more tracks matter; ranges of one
    track that overlap make such a stretch longer, never shorter. The greedy rule is sequential, but two tracks influence each
    other only through such a stretch: each group is split into sets of crowded frames that share no track. A set is swept in
    the order of first frames, batch by batch; what a task holds is the room on the frames ahead, not the set.
    """
    group = ["group_id"]
    tracks = materialize(ranges.groupBy("group_id", "track_id").agg(
        F.min("start").cast("bigint").alias("first_visible_frame"), F.first("initial").alias("initial"),
        F.first("capacity").cast("double").alias("capacity")), "tracks")
    limits = tracks.groupBy("group_id").agg(F.first("capacity").alias("_cap")).filter("_cap is not null")
    crowded = intervals(coverage_steps(ranges, group).join(limits, group), group, F.col("cover") > F.col("_cap"))
    pieces = materialize(overlaps(ranges, crowded, group), "crowded")
    hulls = pieces.groupBy("group_id", "track_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # each hull lies in one interval of the hulls' union; its first frame names the set
    sets = intervals(coverage_steps(hulls, group), group, F.col("cover") > 0).select(
        "group_id", F.col("from").alias("pos"), F.lit(0).alias("_o"), F.lit(None).cast("bigint").alias("track_id"), F.col("from").alias("_part"))
    tagged = sets.unionByName(hulls.select(
        "group_id", F.col("start").cast("bigint").alias("pos"), F.lit(1).alias("_o"), "track_id", F.lit(None).cast("bigint").alias("_part")))
    placed = carry(tagged, group, ["pos", "_o", "track_id"], F.col("_part"), "part").filter("track_id is not null").select("group_id", "track_id", "part")
    rows = pieces.join(placed, ["group_id", "track_id"]).join(tracks, ["group_id", "track_id"])
    sets_of = ["group_id", "part"]
    ordered = rows.repartition(*sets_of).sortWithinPartitions(*sets_of, F.desc("initial"), "first_visible_frame", "track_id", "start").select(
        *sets_of, "track_id", "initial", "capacity", "start", "end")
    decided = ordered.mapInArrow(_sweep, "group_id bigint, track_id bigint, _ok boolean")
    return tracks.filter("not initial").join(decided, ["group_id", "track_id"], "left").select(
        "group_id", "track_id", "first_visible_frame", F.coalesce("_ok", F.lit(True)).alias("accepted"),
        (F.coalesce("_ok", F.lit(True)) & F.col("capacity").isNotNull()).alias("reentry"))


def overlaps(ranges: DataFrame, segments: DataFrame, keys: Sequence[str], cell: int | None = None) -> DataFrame:
    """Inclusive parts of ``ranges`` inside ``segments`` ([from, to)), joined on cells of frames, each part once."""
    keys, cell = list(keys), cell or BLOCK
    low, high = F.floor(F.col("start") / cell), F.floor(F.col("end") / cell)
    left = ranges.withColumn("_cell", F.explode(F.sequence(low, high)))
    right = segments.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor((F.col("to") - 1) / cell))))
    meet = left.join(right, [*keys, "_cell"]).filter((F.col("start") < F.col("to")) & (F.col("end") >= F.col("from")))
    begin = F.greatest("start", "from")
    return meet.filter(F.floor(begin / cell) == F.col("_cell")).select(
        *keys, "track_id", begin.alias("start"), F.least(F.col("end"), F.col("to") - 1).alias("end"))


def intervals(steps: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """Maximal intervals ``(keys, from, to)`` over which ``flag`` of the cover steps holds."""
    keys = list(keys)
    marked = steps.select(*keys, "from", F.coalesce(flag, F.lit(False)).alias("_on"))
    turns = carry(marked, keys, ["from"], F.col("_on"), "_was", inclusive=False).filter(F.col("_on") != F.coalesce("_was", F.lit(False)))
    turns = materialize(turns, "turns")
    return carry(turns, keys, ["from"], F.col("from"), "to", reverse=True, inclusive=False).filter("_on").select(*keys, "from", "to")
