"""Joint-offset augmentation: shifted copies of episodes next to the originals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from episodica.operators.series import EPISODE, attach, with_offsets, with_position

# Arm order and joint count of a draw.
ARMS = ["right", "left"]
JOINTS = 7
MAX_COPIES = 10


def arm_positions(names: Sequence[str]) -> list[int]:
    """Element numbers of right then left joints 0..6."""
    wanted = [f"{arm}_arm_{joint}" for arm in ARMS for joint in range(JOINTS)]
    absent = [n for n in wanted if n not in names]
    if absent:
        raise ValueError(f"joint names are missing: {absent[:8]}")
    return [list(names).index(n) for n in wanted]


def draw_offsets(episodes: DataFrame, ranges_deg: Sequence[float], copies: int, seed: int) -> DataFrame:
    """One uniform offset per copy, episode, arm and joint, equal to drawing them one after another from the seed.

    The generator can jump ahead, so each task starts at the place of its own rows and nothing is drawn on the driver.
    """
    if not 1 <= copies <= MAX_COPIES:
        raise ValueError("copies must be within 1..10")
    bounds = np.asarray(list(ranges_deg), dtype=np.float64)
    placed = with_position(episodes, ["dataset_id"], ["episode_index"], "_place")
    totals = placed.groupBy("dataset_id").agg(F.count("*").alias("_total"))
    rows = placed.join(totals, "dataset_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn(
        "_draw", (F.col("copy") - 1) * F.col("_total") + F.col("_place"))
    per_draw = len(ARMS) * JOINTS

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at in batch["_draw"]:
                bits = np.random.PCG64(seed)
                bits.advance(int(at) * per_draw)
                values = np.random.Generator(bits).uniform(-1.0, 1.0, per_draw)
                out.append(values * np.tile(bounds, len(ARMS)))
            yield batch.assign(offsets_deg=out)

    schema = StructType([*rows.schema.fields, StructField("offsets_deg", ArrayType(DoubleType()))])
    return rows.mapInPandas(draw, schema).drop("_place")


def augment(frames: DataFrame, episodes: DataFrame, draws: DataFrame, action_positions: Sequence[int], state_positions: Sequence[int],
            width: int) -> DataFrame:
    """Originals followed by the copy blocks; offsets are added in radians in double precision, then cast back.

    ``episodes`` lists all originals with ``length``; ``draws`` the chosen ones with offsets.
    """
    totals = episodes.groupBy("dataset_id").agg(F.count("*").alias("_originals"))
    chosen = draws.join(totals, "dataset_id").select(
        *EPISODE, "copy", "length", (F.col("_originals") + F.col("_draw")).alias("_output"), "offsets_deg")
    originals = episodes.select(*EPISODE, F.lit(0).alias("copy"), "length", F.col("episode_index").alias("_output"),
                                F.lit(None).cast("array<double>").alias("offsets_deg"))
    plan = originals.unionByName(chosen)
    offsets = with_offsets(plan.select("dataset_id", F.col("_output").alias("episode_index"), "length")).select(
        "dataset_id", F.col("episode_index").alias("_output"), "dataset_from_index")
    rows = attach(frames, plan.join(offsets, ["dataset_id", "_output"]))

    def shifted(feature: str, positions: Sequence[int]):
        kind = frames.schema[feature].dataType.elementType
        slot = F.array(*[F.lit(positions.index(i) if i in positions else -1) for i in range(width)])

        def move(x, i):
            at = F.get(slot, i)
            return F.when(at >= 0, (x.cast("double") + F.radians(F.get("offsets_deg", at))).cast(kind)).otherwise(x)

        return F.when(F.col("copy") == 0, F.col(feature)).otherwise(F.transform(feature, move)).alias(feature)

    kept = [c for c in frames.columns if c not in ("dataset_id", "episode_index", "index", "action", "state")]
    return rows.select(
        "dataset_id", F.col("_output").alias("episode_index"), (F.col("dataset_from_index") + F.col("frame_index")).alias("index"), *kept,
        shifted("action", list(action_positions)), shifted("state", list(state_positions)),
        "copy", F.col("episode_index").alias("source_episode_index"))


def summary(episodes: DataFrame, chosen: DataFrame, copies: int) -> DataFrame:
    """Episode and frame totals before and after, and how many times more video the result refers to."""
    before = episodes.agg(F.count("*").alias("episodes"), F.sum("length").alias("frames"))
    added = chosen.agg(F.struct((F.count("*") * copies).alias("added_episodes"), (F.sum("length") * copies).alias("added_frames")).alias("a")).scalar()
    return before.withColumn("_a", added).select("*", "_a.*").select(
        "episodes", "frames", "added_episodes", "added_frames", (F.col("episodes") + F.col("added_episodes")).alias("total_episodes"),
        (F.col("frames") + F.col("added_frames")).alias("total_frames"),
        F.when(F.col("episodes") > 0, (F.col("episodes") + F.col("added_episodes")) / F.col("episodes")).otherwise(1.0).alias("video_factor"))
