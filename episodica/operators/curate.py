"""Curation: selections, splits, flags, annotation versions, tasks, and the whole recipe as one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions import language as rules
from episodica.functions.numeric import percent_count
from episodica.operators import language, trim
from episodica.operators.ranks import kth_values
from episodica.operators.series import EPISODE, attach, reindex, with_offsets, with_position
from episodica.session import materialize

MAX_CHANGES = 500


# --- selection and flags ------------------------------------------------------------------------------------------------

def select_episodes(episodes: DataFrame, flags: DataFrame, mode: str, split_by_flag: bool = False) -> DataFrame:
    """Episodes of a recipe: all, flagged, unflagged or delete_flagged. A flag-based split always takes all."""
    marked = flags.select(*EPISODE).distinct()
    if split_by_flag or mode == "all":
        chosen = episodes
    elif mode == "flagged":
        chosen = episodes.join(marked, EPISODE, "left_semi")
    elif mode in ("unflagged", "delete_flagged"):
        chosen = episodes.join(marked, EPISODE, "left_anti")
    else:
        raise ValueError(f"unknown selection mode {mode}")
    return chosen


def require_selection(selection: DataFrame) -> DataFrame:
    if selection.isEmpty():
        raise ValueError("no episode is selected")
    return selection


def with_output_index(selection: DataFrame) -> DataFrame:
    """Position of each selected episode: the episode number of the output."""
    return with_position(selection, ["dataset_id"], ["episode_index"], "output_index")


def select_frames(frames: DataFrame, selection: DataFrame) -> DataFrame:
    """Frames of selected episodes with their output episode number; ``selection`` carries ``length``."""
    return attach(frames, selection.select(*EPISODE, "length", "output_index")).drop("length")


def merge_flags(*rules: DataFrame) -> DataFrame:
    """Episodes named by any rule."""
    out = rules[0].select(*EPISODE)
    for rule in rules[1:]:
        out = out.unionByName(rule.select(*EPISODE))
    return out.distinct()


def check_changes(changes: DataFrame) -> DataFrame:
    """One request changes each episode at most once and at most 500 episodes."""
    count, unique = changes.agg(F.count("*"), F.count_distinct(*EPISODE)).first()
    if count > MAX_CHANGES or count != unique:
        raise ValueError("flag changes must be unique and at most 500")
    return changes


def effective_changes(flags: DataFrame, changes: DataFrame) -> DataFrame:
    """Requested changes that alter something."""
    now = flags.select(*EPISODE, F.lit(True).alias("_set")).distinct()
    return changes.join(now, EPISODE, "left").filter(F.coalesce("_set", F.lit(False)) != F.col("flagged")).drop("_set")


def apply_flags(flags: DataFrame, changes: DataFrame) -> DataFrame:
    effective = effective_changes(flags, changes)
    kept = flags.select(*EPISODE).distinct().join(effective.filter("not flagged").select(*EPISODE), EPISODE, "left_anti")
    return kept.unionByName(effective.filter("flagged").select(*EPISODE))


def next_revision(revisions: DataFrame, flags: DataFrame, changes: DataFrame) -> DataFrame:
    """Revision per data set after the changes: one more where any change was effective."""
    touched = effective_changes(flags, changes).select("dataset_id").distinct().withColumn("_up", F.lit(1))
    return revisions.join(touched, "dataset_id", "left").select(
        "dataset_id", (F.col("revision") + F.coalesce("_up", F.lit(0))).alias("revision"))


def upsert_annotations(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Latest annotation record per episode: a saved one replaces the old one and raises its revision by one."""
    old = current.select(*EPISODE, "revision", "task_override", "atoms")
    seen = current.groupBy(*EPISODE).agg(F.max("revision").alias("_rev"))
    new = saved.join(seen, EPISODE, "left").select(
        *EPISODE, (F.coalesce("_rev", F.lit(0)) + 1).alias("revision"), F.nullif(F.trim("task_override"), F.lit("")).alias("task_override"), "atoms")
    latest = F.max_by(F.struct("revision", "task_override", "atoms"), "revision")
    return old.unionByName(new).groupBy(*EPISODE).agg(latest.alias("_r")).select(*EPISODE, "_r.*")


def invalid_annotation_lists(atoms: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Episodes with more than 1000 saved atoms or a repeated one; repeats collapse before the count per episode."""
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    counted = atoms.groupBy(*EPISODE, text.alias("_json")).agg(F.count("*").alias("_n"))
    totals = counted.groupBy(*EPISODE).agg(F.sum("_n").alias("_all"), F.max("_n").alias("_most"))
    return totals.filter((F.col("_all") > rules.MAX_ATOMS) | (F.col("_most") > 1)).select(*EPISODE)


# --- splits -------------------------------------------------------------------------------------------------------------

def seeded_order(selection: DataFrame, seed: int) -> DataFrame:
    """``_rank`` of each episode in the order of a seeded MD5 of its id: a shuffle without any driver step, at any size.

    Works on one data set; its size is the scalar behind ``_total``.
    """
    if selection.select("dataset_id").distinct().limit(2).count() != 1:
        raise ValueError("a seeded draw works on one data set")
    key = F.md5(F.concat(F.lit(f"{seed}/"), F.col("dataset_id"), F.lit("/"), F.col("episode_index").cast("string")).cast("binary"))
    ranked = with_position(selection.withColumn("_key", key), [], ["_key", "episode_index"], "_rank")
    total = selection.agg(F.count("*").alias("n")).scalar()
    return ranked.withColumn("_total", total).drop("_key")


def random_split(selection: DataFrame, percent: float, seed: int) -> DataFrame:
    """``is_eval`` per selected episode: exactly the asked share, first in the seeded order."""
    drawn = seeded_order(selection, seed)
    return drawn.withColumn("is_eval", F.col("_rank") < percent_count(F.col("_total"), percent)).drop("_rank", "_total")


def hash_split(selection: DataFrame, percent: float, seed: int) -> DataFrame:
    """The same share of episodes without any driver step: the episodes with the smallest seeded hashes."""
    # 52 bits are exact in a double
    marked = selection.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *EPISODE), 12).cast("double"))
    # percent 0 asks for rank -1, which no row has: the scalar is then NULL
    cut = kth_values(marked, [], "_h", lambda n: F.array(percent_count(n, percent) - 1)).select("kth").scalar()
    return marked.withColumn("is_eval", F.coalesce(F.col("_h") <= cut, F.lit(False))).drop("_h")


def flag_split(selection: DataFrame, flags: DataFrame) -> DataFrame:
    marked = flags.select(*EPISODE, F.lit(True).alias("is_eval")).distinct()
    out = selection.join(marked, EPISODE, "left").withColumn("is_eval", F.coalesce("is_eval", F.lit(False)))
    if out.select("is_eval").distinct().count() < 2:
        raise ValueError("a flag-based split needs a non-empty train and eval side")
    return out


def split_sides(split: DataFrame) -> dict[str, DataFrame]:
    """Train is the selection without the eval side; an empty side is left out."""
    sides = {"train": split.filter("not is_eval"), "eval": split.filter("is_eval")}
    return {name: side for name, side in sides.items() if not side.isEmpty()}


def sample_episodes(selection: DataFrame, percent: float, seed: int) -> DataFrame:
    """A seeded share of the episodes, at least one; nothing of an empty selection."""
    if selection.isEmpty():
        return selection
    drawn = seeded_order(selection, seed)
    count = F.greatest(F.lit(1), percent_count(F.col("_total"), min(100.0, max(0.0, percent))))
    return drawn.filter(F.col("_rank") < count).drop("_rank", "_total")


# --- tasks --------------------------------------------------------------------------------------------------------------

def with_task(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """Frames with their task text. The task list is written first, so the plan knows its bytes: a short one is broadcast, a
    long one is shuffled with hot tasks split."""
    texts = materialize(tasks.select("dataset_id", "task_index", "task"), "task_texts")
    return frames.join(texts, ["dataset_id", "task_index"], "left")


def episode_tasks(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """Sorted distinct task texts per episode; only distinct (episode, task) pairs are gathered."""
    used = frames.select(*EPISODE, "task_index").distinct()
    return with_task(used, tasks).groupBy(*EPISODE).agg(F.array_sort(F.collect_set("task")).alias("tasks"))


def override_tasks(frames: DataFrame, episodes: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``episodes.task_override``: a known text keeps its id, new texts get the next ids in episode order."""
    wanted = episodes.filter("task_override is not null").select(*EPISODE, F.col("task_override").alias("task"), "length")
    known = tasks.select("dataset_id", "task_index", "task")
    fresh = wanted.join(known, ["dataset_id", "task"], "left_anti").groupBy("dataset_id", "task").agg(F.min("episode_index").alias("_first"))
    top = known.groupBy("dataset_id").agg(F.max("task_index").alias("_top"))
    fresh = with_position(fresh, ["dataset_id"], ["_first"], "_n").join(top, "dataset_id", "left").select(
        "dataset_id", (F.coalesce("_top", F.lit(-1)) + 1 + F.col("_n")).alias("task_index"), "task")
    all_tasks = known.unionByName(fresh)
    ids = wanted.join(all_tasks, ["dataset_id", "task"]).select(*EPISODE, "length", F.col("task_index").alias("_override"))
    lengths = episodes.select(*EPISODE, "length").join(ids.drop("length"), EPISODE, "left")
    changed = attach(frames, lengths.select(*EPISODE, "length", "_override")).withColumn(
        "task_index", F.coalesce("_override", "task_index")).drop("_override", "length")
    return changed, all_tasks


def remap_tasks(frames: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense task ids over the used ones, in order of the old ids. A used id without text is an error."""
    used = frames.select("dataset_id", "task_index").filter("task_index is not null").distinct()
    missing = used.join(tasks, ["dataset_id", "task_index"], "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"task metadata is missing indices {[m.task_index for m in missing]}")
    mapping = materialize(with_position(used, ["dataset_id"], ["task_index"], "_new"), "task_numbers")  # written, so its size is known
    renamed = frames.join(mapping, ["dataset_id", "task_index"], "left").withColumn("task_index", F.col("_new")).drop("_new")
    texts = tasks.join(mapping, ["dataset_id", "task_index"]).select("dataset_id", F.col("_new").alias("task_index"), "task")
    return renamed.select(*frames.columns), texts


# --- recipe -------------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Recipe:
    fps: float
    mode: str = "all"
    motion: trim.MotionTrim | None = None
    pairs: Sequence[tuple[int, int]] = field(default_factory=list)
    stationary: dict | None = None


@dataclass(frozen=True)
class Curated:
    frames: DataFrame
    episodes: DataFrame
    tasks: DataFrame
    lineage: DataFrame
    annotations: DataFrame | None


def curate(recipe: Recipe, frames: DataFrame, episodes: DataFrame, tasks: DataFrame, flags: DataFrame,
           atoms: DataFrame | None = None, overrides: DataFrame | None = None) -> Curated:
    """select → trim → reindex → annotate → tasks → lineage, as one lazy plan per output table."""
    selection = with_output_index(require_selection(select_episodes(episodes.select(*EPISODE, "length"), flags, recipe.mode)))
    chosen = attach(frames, selection.select(*EPISODE, "length")).drop("length")
    if recipe.motion is not None:
        bounds = trim.motion(chosen, recipe.fps, recipe.pairs, recipe.motion, overrides)
    elif recipe.stationary is not None:
        bounds = trim.stationary(chosen, recipe.fps, **recipe.stationary)
        bounds = trim.with_overrides(bounds, overrides) if overrides is not None else bounds
    else:
        bounds = selection.select(*EPISODE, F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end"), "length", F.lit("disabled").alias("method"))
    bounds = materialize(bounds.join(selection.select(*EPISODE, "output_index"), EPISODE), "bounds")
    short = bounds.filter(F.col("end") - F.col("start") < 2).limit(1).collect()
    if short:
        raise ValueError(f"episode {short[0].episode_index} keeps fewer than two frames")
    out = reindex(frames, bounds, recipe.fps)
    renamed, texts = remap_tasks(out, tasks)
    annotations = None
    if atoms is not None:
        placed = language.project(atoms, frames, bounds, recipe.fps)
        annotations = placed.join(bounds.select(*EPISODE, "output_index"), EPISODE).withColumn(
            "episode_index", F.col("output_index")).drop("output_index")
    lengths = bounds.select("dataset_id", F.col("output_index").alias("episode_index"), (F.col("end") - F.col("start")).alias("length"))
    result = with_offsets(lengths).join(episode_tasks(renamed, texts), EPISODE, "left")
    return Curated(renamed, result, texts, lineage(bounds), annotations)


def lineage(bounds: DataFrame) -> DataFrame:
    """Which source frames each output episode came from."""
    return bounds.select(
        "dataset_id", F.col("output_index").alias("output_episode_index"), F.col("episode_index").alias("source_episode_index"),
        F.col("start").alias("source_start_frame"), F.col("end").alias("source_end_frame"), "method")


def snapshot(recipes: DataFrame, catalog: DataFrame, flags: DataFrame, annotations: DataFrame) -> DataFrame:
    """Freeze the inputs of recipes: one row per (recipe, selected episode) with its flag and annotation revision.

    ``recipes(recipe_id, dataset_id, fingerprint, mode)``; a recipe whose data set has changed since is refused.
    """
    joined = recipes.join(catalog.select("dataset_id", F.col("fingerprint").alias("_now"), "total_episodes"), "dataset_id")
    checked = joined.withColumn("mode", F.when(F.col("_now") == F.col("fingerprint"), F.col("mode")).otherwise(
        F.raise_error(F.lit("the data set has changed since the recipe was made"))))
    ids = checked.select("recipe_id", "dataset_id", "mode", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("total_episodes") - 1)).alias("episode_index"))
    marked = ids.join(flags.select(*EPISODE, F.lit(True).alias("_f")).distinct(), EPISODE, "left").withColumn("flagged", F.coalesce("_f", F.lit(False)))
    kept = marked.filter((F.col("mode") == "all") | ((F.col("mode") == "flagged") == F.col("flagged")))
    return kept.join(annotations.select(*EPISODE, F.col("revision").alias("annotation_revision")), EPISODE, "left").select(
        "recipe_id", *EPISODE, "flagged", "annotation_revision")


def latest_runs(runs: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key; a map-side aggregate, so a key with many runs is not gathered."""
    rest = [c for c in runs.columns if c not in keys]
    newest = runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def export_allowed(runs: DataFrame, jobs: DataFrame, policy: str) -> DataFrame:
    """Data set versions whose newest export check succeeded, passed, used the current policy and left a manifest."""
    newest = latest_runs(runs.filter("mode = 'export_gate'"), ["dataset_id", "fingerprint"], ["created_at", "run_no"])
    rows = newest.join(jobs, "job_id")
    ok = (
        F.col("deleted_at").isNull() & (F.col("status") == "succeeded") & F.coalesce("passed", F.lit(False))
        & (F.col("policy") == policy) & (F.length("tree_sha256") > 0))
    return rows.select("dataset_id", "fingerprint", F.coalesce(ok, F.lit(False)).alias("allowed"))
