"""Language annotations: as-of and band joins, projection through a trim, nesting for the frame table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions import language as rules
from episodica.operators.series import EPISODE, Carry, attach, carry_sorted, episode_lengths, with_position

ATOM_FIELDS = ["role", "content", "style", "camera", "tool_calls"]


def _stack(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: Sequence[str], tie: Column) -> DataFrame:
    """Probes and values in one table: time, side (values before probes of the same time), tie and the two row structs."""
    probe = F.struct(*left.columns)
    body = F.struct(*payload)
    probe_type = left.select(probe.alias("x")).schema["x"].dataType
    body_type = right.select(body.alias("x")).schema["x"].dataType
    values = right.select(*keys, F.col(right_time).cast("double").alias("_t"), F.lit(0).alias("_side"), tie.cast("bigint").alias("_tie"),
                          F.lit(None).cast(probe_type).alias("_l"), body.alias("_r"))
    probes = left.select(*keys, F.col(left_time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_tie"),
                         probe.alias("_l"), F.lit(None).cast(body_type).alias("_r"))
    return values.unionByName(probes)


_ORDER = ["_t", "_side", "_tie"]


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, payload: Sequence[str],
         name: str, tie: Column) -> DataFrame:
    """Add struct ``name`` of the latest right row at or before the left time; the greatest ``tie`` wins equal times.

    Both sides are sorted together and cut by row position, so neither a long episode nor a crowded time is one task.
    """
    both = _stack(left, right, list(keys), left_time, right_time, payload, tie)
    found = carry_sorted(both, keys, _ORDER, [Carry(name, F.col("_r"))])
    return found.filter("_side = 1").select("_l.*", name)


def nearest_frame(atoms: DataFrame, frames: DataFrame, keys: Sequence[str] = EPISODE, time: str = "ts", frame_time: str = "timestamp") -> DataFrame:
    """Frame with the closest timestamp for each atom; the earlier one on a tie. Both directions in one pass."""
    keys = list(keys)
    # of frames with one time the lowest number counts
    single = frames.groupBy(*keys, frame_time).agg(F.min("frame_index").alias("frame_index"))
    both = _stack(atoms, single, keys, time, frame_time, [frame_time, "frame_index"], F.col("frame_index"))
    rows = carry_sorted(both, keys, _ORDER, [Carry("_back", F.col("_r")), Carry("_next", F.col("_r"), reverse=True)]).filter("_side = 1")
    ahead = F.col(f"_next.{frame_time}") - F.col("_t")
    behind = F.col("_t") - F.col(f"_back.{frame_time}")
    back = F.col("_back").isNotNull() & (F.col("_next").isNull() | (behind <= ahead))
    best = F.when(back, F.col("_back")).otherwise(F.col("_next"))
    return rows.select("_l.*", best["frame_index"].alias("frame_index"), best[frame_time].alias("frame_time"))


def active_at(probes: DataFrame, atoms: DataFrame, style: str, keys: Sequence[str] = EPISODE, time: str = "ts", probe_time: str = "timestamp") -> DataFrame:
    """Last atom of the style at or before each probe, the later list entry on equal times."""
    chosen = atoms.filter(F.col("style") == style)
    return asof(probes, chosen, keys, probe_time, time, ["ord", "role", "content", time], "active", F.col("ord"))


def within(probes: DataFrame, atoms: DataFrame, window: float, keys: Sequence[str] = EPISODE, strict: bool = False,
           time: str = "ts", probe_time: str = "timestamp") -> DataFrame:
    """Pairs of probe and atom at most ``window`` seconds apart (closer than it with ``strict``).

    An equi-join on the time cell: atoms are copied to the neighbouring cells, so no pair is compared twice and
    there is no nested loop.
    """
    keys = list(keys)
    cell = F.floor(F.col(probe_time) / window).cast("bigint")
    own = F.floor(F.col(time) / window).cast("bigint")
    left = probes.withColumn("_cell", cell)
    body = [c for c in atoms.columns if c not in keys]
    right = atoms.select(*keys, *body, F.explode(F.array(own - 1, own, own + 1)).alias("_cell"))
    distance = F.abs(F.col(time) - F.col(probe_time))
    near = distance < window if strict else distance <= window
    return left.join(right, [*keys, "_cell"]).filter(near).drop("_cell")


def spans(atoms: DataFrame, durations: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Time spans and ticks: subtask and plan last until the next of their kind, task_aug the whole episode."""
    keys = list(keys)
    chained = atoms.filter(F.col("style").isin("subtask", "plan"))
    later = carry_sorted(chained, [*keys, "style"], ["ts", "ord"], [Carry("_next", F.col("ts"), reverse=True, inclusive=False)])
    total = durations.select(*keys, "duration")
    spanned = later.join(total, keys).select(
        *keys, "ord", "style", F.lit("span").alias("kind"), F.col("ts").alias("start"), F.coalesce("_next", "duration").alias("end"))
    whole = atoms.filter(F.col("style") == "task_aug").join(total, keys).select(
        *keys, "ord", "style", F.lit("span").alias("kind"), F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    speech = F.col("style").isNull()
    ticks = atoms.filter(speech | F.col("style").isin("memory", "interjection") | ((F.col("style") == "vqa") & (F.col("role") == "assistant")))
    return spanned.unionByName(whole).unionByName(ticks.select(
        *keys, "ord", "style", F.lit("tick").alias("kind"), F.col("ts").alias("start"), F.col("ts").alias("end")))


def canonical_order(atoms: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Position of each atom by (time, style, role), stable in list order."""
    rows = atoms.withColumn("_style", F.coalesce("style", F.lit("")))
    return with_position(rows, list(keys), ["ts", "_style", "role", "ord"], "position").drop("_style")


def overlay(existing: DataFrame, annotated: DataFrame, annotations: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Atoms after annotation: an annotated episode gives up its old atoms even when its new list is empty.

    ``annotated`` lists the episodes that have an annotation record.
    """
    kept = existing.join(annotated.select(*keys).distinct(), list(keys), "left_anti")
    new = annotations.join(annotated.select(*keys).distinct(), list(keys), "left_semi")
    return kept.unionByName(new)


def unique_atoms(atoms: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Drop exact repeats inside an episode, keeping the first in list order."""
    fields = [c for c in ("role", "content", "style", "ts", "camera", "tool_calls") if c in atoms.columns]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    rest = [c for c in atoms.columns if c not in keys]
    first = atoms.withColumn("_json", text).groupBy(*keys, "_json").agg(F.min_by(F.struct(*rest), "ord").alias("_row"))
    return first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def project(atoms: DataFrame, frames: DataFrame, bounds: DataFrame, fps: float, cameras: Sequence[str] = (),
            keys: Sequence[str] = EPISODE) -> DataFrame:
    """Annotations of trimmed episodes in long form: ``column, frame_index (events), ts (persistent, rebased)``.

    Atoms snap to their nearest source frame. Persistent atoms before the cut: memory is dropped, the last subtask and
    plan are carried to time 0, task_aug moves to 0. Events outside the cut are dropped.
    """
    keys = list(keys)
    style = F.col("style")
    camera = F.col("camera") if "camera" in atoms.columns else F.lit(None).cast("string")
    bad = F.when((style == "vqa") & ~F.coalesce(camera.isin(list(cameras)), F.lit(False)), "annotation references an unavailable camera").when(
        F.coalesce(style != "vqa", F.lit(True)) & camera.isNotNull(), "only visual questions may name a camera").when(
        rules.column_for_style(style).isNull(), "annotation style is unsupported")
    target = F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(rules.column_for_style(style))
    snapped = nearest_frame(atoms, frames, keys).join(bounds.select(*keys, "start", "end"), keys).withColumn("column", target)
    frame, start, end = F.col("frame_index"), F.col("start"), F.col("end")
    persistent = snapped.filter((F.col("column") == rules.PERSISTENT) & (frame < end))
    inside = persistent.filter(frame >= start).withColumn("ts", ((frame - start) / F.lit(float(fps))).cast("float"))
    early = persistent.filter((frame < start) & (style != "memory"))
    moved = early.filter(style == "task_aug").withColumn("ts", F.lit(0.0).cast("float"))
    rest = [c for c in snapped.columns if c not in keys]
    carried = early.filter(style.isin("subtask", "plan")).groupBy(*keys, "style").agg(
        F.max_by(F.struct(*rest), "ord").alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).withColumn("ts", F.lit(0.0).cast("float"))
    events = snapped.filter((F.col("column") == rules.EVENTS) & (frame >= start) & (frame < end))
    fields = [c for c in atoms.columns if c not in (*keys, "ts")]
    none = F.lit(None).cast("bigint")
    lasting = inside.unionByName(moved).unionByName(carried).select(*keys, "column", none.alias("frame_index"), "ts", *fields)
    return lasting.unionByName(events.select(
        *keys, "column", (frame - start).cast("bigint").alias("frame_index"), F.lit(None).cast("float").alias("ts"), *fields))


def nest(projected: DataFrame, frames: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Put projected atoms into the two list columns of the frame table.

    The persistent list stands on every row of its episode, so its length is part of the format, not of this step;
    ``curate.invalid_annotation_lists`` names the lists that a save request may not hold.
    """
    keys = list(keys)
    rows = projected
    for name, kind in (("camera", "string"), ("tool_calls", rules.TOOL_CALLS)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    style = F.coalesce("style", F.lit(""))
    lasting = rows.filter(F.col("column") == rules.PERSISTENT).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col("ts").alias("k1"), style.alias("k2"), F.col("role").alias("k3"), F.col("ord").alias("k4"),
        F.struct("role", "content", "style", F.col("ts").alias("timestamp"), "camera", "tool_calls").alias("atom")))).alias("_p"))
    events = rows.filter(F.col("column") == rules.EVENTS).groupBy(*keys, "frame_index").agg(F.array_sort(F.collect_list(F.struct(
        style.alias("k1"), F.col("role").alias("k2"), F.coalesce("camera", F.lit("")).alias("k3"), F.col("ord").alias("k4"),
        F.struct("role", "content", "style", "camera", "tool_calls").alias("atom")))).alias("_e"))
    empty_p, empty_e = F.array().cast(rules.PERSISTENT_TYPE), F.array().cast(rules.EVENT_TYPE)
    # the list of an episode is joined on (episode, block), the events on the frame
    per = episode_lengths(frames, keys).join(lasting, keys, "left").withColumnRenamed("length", "_n")
    plain = frames.drop(rules.PERSISTENT, rules.EVENTS, "tools", "subtask_index")
    joined = attach(plain, per, keys, "_n").drop("_n").join(events, [*keys, "frame_index"], "left")
    return joined.withColumn(rules.PERSISTENT, F.coalesce(F.transform("_p", lambda x: x["atom"]).cast(rules.PERSISTENT_TYPE), empty_p)).withColumn(
        rules.EVENTS, F.coalesce(F.transform("_e", lambda x: x["atom"]).cast(rules.EVENT_TYPE), empty_e)).drop("_p", "_e")


def materialize_atoms(atoms: DataFrame, frames: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Whole-episode form without a trim: persistent atoms keep their time, events go to the nearest frame."""
    keys = list(keys)
    snapped = nearest_frame(atoms, frames, keys).withColumn("column", rules.column_for_style(F.col("style")))
    fields = [c for c in atoms.columns if c not in (*keys, "ts")]
    lasting = F.col("column") == rules.PERSISTENT
    return snapped.filter("column is not null").select(
        *keys, "column", F.when(~lasting, F.col("frame_index")).alias("frame_index"),
        F.when(lasting, F.col("ts").cast("float")).alias("ts"), *fields)


def extract_atoms(frames: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Long atoms of the nested columns: first non-empty persistent list without repeats, every event with the row time."""
    keys = list(keys)
    lists = frames.filter(F.size(rules.PERSISTENT) > 0).groupBy(*keys).agg(
        F.min_by(rules.PERSISTENT, "frame_index").alias("_list"))
    lasting = lists.select(*keys, F.posexplode("_list").alias("_i", "a")).filter("a.role is not null and a.role <> ''").select(
        *keys, F.lit(rules.PERSISTENT).alias("column"), F.lit(None).cast("bigint").alias("frame_index"), F.col("_i").alias("ord"), "a.role", "a.content", "a.style",
        F.coalesce(F.col("a.timestamp").cast("double"), F.lit(0.0)).alias("ts"), F.nullif("a.camera", F.lit("")).alias("camera"), "a.tool_calls")
    rest = [c for c in lasting.columns if c not in keys]
    # the five identifying fields; NULL content and camera compare as equal
    lasting = lasting.groupBy(*keys, "style", "role", "ts", "camera", "content").agg(
        F.min_by(F.struct(*rest), "ord").alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    events = frames.select(*keys, "frame_index", "timestamp", F.posexplode(rules.EVENTS).alias("_i", "a")).filter("a.role is not null and a.role <> ''").select(
        *keys, F.lit(rules.EVENTS).alias("column"), "frame_index", F.col("_i").alias("ord"), "a.role", "a.content", "a.style",
        F.col("timestamp").cast("double").alias("ts"), F.nullif("a.camera", F.lit("")).alias("camera"), "a.tool_calls")
    return lasting.unionByName(events)


def inconsistent_broadcast(frames: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Episodes whose persistent list is not the same on every row."""
    text = F.coalesce(F.to_json(rules.PERSISTENT), F.lit("[]"))  # no list and an empty list are the same
    return frames.groupBy(*keys).agg(F.min(text).alias("_lo"), F.max(text).alias("_hi")).filter("_lo <> _hi").select(*keys)


def task_text(frames: DataFrame, episodes: DataFrame, tasks: DataFrame, instruction_columns: Sequence[str] = (),
              keys: Sequence[str] = EPISODE) -> DataFrame:
    """Task text of an episode: its own list, else instructions of the first, middle or last row, else the task table."""
    keys = list(keys)
    lengths = frames.groupBy(*keys).agg(F.max("frame_index").alias("_last"))
    first = frames.filter("frame_index = 0").select(*keys, "task_index")
    rows = episodes.join(lengths, keys, "left").join(first, keys, "left").join(
        tasks.select("dataset_id", "task_index", "task"), ["dataset_id", "task_index"], "left")
    text = F.when(F.size("tasks") > 0, F.array_join("tasks", "\n"))
    if instruction_columns:
        # numbered instructions count only while the previous number is filled
        said = F.array(*[F.col(c) for c in instruction_columns[1:]])
        stop = F.coalesce(F.array_position(F.transform(said, lambda x: x.isNull()), True), F.lit(0))
        following = F.when(stop > 0, F.slice(said, F.lit(1), stop - 1)).otherwise(said)
        words = F.array_join(F.concat(F.filter(F.array(F.col(instruction_columns[0])), lambda x: x.isNotNull()), following), "\n")
        half = F.floor((F.col("_last") + 1) / 2)
        places = lengths.select(*keys, F.explode(F.array(
            F.struct(F.lit(0).cast("bigint").alias("frame_index"), F.lit(0).alias("o")),
            F.struct(half.cast("bigint").alias("frame_index"), F.lit(1).alias("o")),
            F.struct(F.col("_last").alias("frame_index"), F.lit(2).alias("o")))).alias("p")).select(*keys, "p.frame_index", "p.o")
        spoken = frames.join(places, [*keys, "frame_index"]).select(*keys, "o", words.alias("_w")).filter("_w <> ''").groupBy(*keys).agg(
            F.min_by("_w", "o").alias("_said"))
        rows = rows.join(spoken, keys, "left")
        text = F.coalesce(text, F.col("_said"))
    return rows.select(*keys, F.coalesce(text, F.col("task")).alias("task_text"))


def vqa_on_screen(atoms: DataFrame, probes: DataFrame, camera: Column | str, window: float = 0.05, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Answers drawn at each probe time on a camera: closer than ``window`` and matching the camera."""
    answers = atoms.filter((F.col("style") == "vqa") & (F.col("role") == "assistant"))
    return within(probes, answers, window, keys, strict=True).filter(rules.camera_matches(F.col("camera"), camera))
