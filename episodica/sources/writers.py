"""Sinks: frame shards, episode and task tables, statistics and annotation documents."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.functions import language as rules
from episodica.operators.series import EPISODE, attach, with_offsets
from episodica.operators.stats import STATISTICS
from episodica.sources.files import commit_names, local_uri, new_folder, remove, write_document

FILES_PER_CHUNK = 1000
ROWS_PER_TASK = 1_000_000
ROWS_PER_GROUP = 100_000
PLACE = ["_chunk", "_episode", "_nth"]
ROW_METADATA = "org.apache.spark.sql.parquet.row.metadata"  # column types, as Spark's own writer leaves them
INTERNAL = ("dataset_id", "_file", "_row", "source_episode_index", "source_frame_index", "source_ord", "copy")


def plan_shards(episodes: DataFrame, rows_per_file: int | None = None) -> DataFrame:
    """Episode table with offsets and the data shard of each episode.

    One shard per episode, or shards of about ``rows_per_file`` rows, which is what large data sets want.
    """
    placed = with_offsets(episodes)
    number = F.col("episode_index") if rows_per_file is None else F.floor(F.col("dataset_from_index") / rows_per_file)
    return placed.withColumn("data/chunk_index", F.floor(number / FILES_PER_CHUNK).cast("bigint")).withColumn(
        "data/file_index", (number % FILES_PER_CHUNK).cast("bigint"))


def _stored(frames: DataFrame) -> list:
    return [F.col(c).alias("observation.state") if c == "state" else F.col(c) for c in frames.columns if c not in INTERNAL]


def write_frames(frames: DataFrame, shards: DataFrame, root: str) -> None:
    """v3 shards ``data/chunk-CCC/file-FFF.parquet``, rows sorted by episode and frame.

    A shard of a very long episode is written by several tasks, one per million frames. Tasks are ranges in frame order,
    so the file names of a shard follow it. Files get their exact names after the write is complete.
    """
    place = shards.select(*EPISODE, "length", F.col("`data/chunk_index`").alias("chunk"), F.col("`data/file_index`").alias("file"))
    rows = attach(frames, place)
    part = F.floor(F.col("frame_index") / ROWS_PER_TASK)
    rows.withColumn("_part", part).repartitionByRange("chunk", "file", "episode_index", "_part").sortWithinPartitions("chunk", "file", "episode_index", "frame_index").select(
        *_stored(frames), "chunk", "file").write.partitionBy("chunk", "file").parquet(f"{root}/data")
    commit_names(frames.sparkSession, root)


def write_frames_v2(frames: DataFrame, root: str, chunks_size: int = 1000) -> None:
    """One file ``data/chunk-CCC/episode_EEEEEE.parquet`` per episode. Language columns cannot be stored in this layout.

    On a shared folder the tasks write the files under their exact names, several hundred a second and core. Other Hadoop
    file systems get them from Spark's writer, which the driver then renames one by one.
    """
    nested = [c for c in (rules.PERSISTENT, rules.EVENTS) if c in frames.columns]
    if nested:
        raise ValueError(f"language features cannot be written to layout v2: {nested}")
    # rows without a frame number come first
    part = F.coalesce(F.floor(F.col("frame_index") / ROWS_PER_TASK), F.lit(0).cast("bigint"))
    rows = frames.withColumn("_part", part).repartitionByRange("episode_index", "_part").sortWithinPartitions("episode_index", "frame_index")
    target = local_uri(frames.sparkSession, f"{root}/data")
    if target is None:
        rows.select(*_stored(frames), F.floor(F.col("episode_index") / chunks_size).alias("chunk"), F.col("episode_index").alias("episode")).write.partitionBy(
            "chunk", "episode").parquet(f"{root}/data")
        commit_names(frames.sparkSession, root, "episode", 6)
        return
    new_folder(frames.sparkSession, f"{root}/data")
    # parts of an episode are numbered without gaps, as their files are
    parts = frames.select("episode_index", part.alias("_part")).distinct()
    place = Window.partitionBy("episode_index").orderBy("_part")
    moved = parts.withColumn("_nth", F.row_number().over(place) - 1).filter("_nth <> _part")
    nth = F.col("_part")
    if not moved.isEmpty():
        rows = frames.withColumn("_part", part).join(moved, ["episode_index", "_part"], "left").repartitionByRange(
            "episode_index", "_part").sortWithinPartitions("episode_index", "frame_index")
        nth = F.coalesce("_nth", "_part")
    placed = rows.select(F.floor(F.col("episode_index") / chunks_size).alias("_chunk"), F.col("episode_index").alias("_episode"), nth.alias("_nth"), F.struct(*_stored(frames)).alias("_row"))
    files = placed.mapInArrow(_episode_files(target, placed.schema["_row"].dataType.json()), "files bigint")
    files.agg(F.sum("files")).collect()
    remove(frames.sparkSession, f"{root}/data/_temporary")
    write_document(frames.sparkSession, f"{root}/data/_SUCCESS", "")


def _episode_files(target: str, schema: str):
    """Task that writes its sorted rows as one file per episode and part.

    A file is written below ``_temporary`` and gets its exact name when it is whole, so a task that runs again replaces it.
    """
    def write(batches):
        system, base = fs.FileSystem.from_uri(target)
        scratch = f"{base}/_temporary/{uuid.uuid4().hex}.parquet"
        system.create_dir(f"{base}/_temporary")
        made: set[int] = set()
        place, waiting, out, done = None, [], None, 0

        def put():
            nonlocal out, waiting
            rows = pa.Table.from_batches(waiting).replace_schema_metadata({ROW_METADATA: schema})
            out = out or pq.ParquetWriter(scratch, rows.schema, filesystem=system)
            out.write_table(rows)
            waiting = []

        def finish():
            nonlocal out, done
            if waiting:
                put()
            out.close()
            chunk, episode, nth = place
            if chunk not in made:
                system.create_dir(f"{base}/chunk-{chunk:03d}")
                made.add(chunk)
            system.move(scratch, f"{base}/chunk-{chunk:03d}/episode_{episode:06d}{f'-{nth}' if nth else ''}.parquet")
            out, done = None, done + 1

        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column("_row"))
            keys = [batch.column(c).to_pylist() for c in PLACE]
            start = 0
            for key, same in itertools.groupby(zip(*keys, strict=True)):
                if place is not None and key != place:
                    finish()
                place, stop = key, start + sum(1 for _ in same)
                waiting.append(rows.slice(start, stop - start))
                if sum(w.num_rows for w in waiting) >= ROWS_PER_GROUP:
                    put()
                start = stop
        if place is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"files": pa.array([done], pa.int64())})

    return write


def write_tasks(tasks: DataFrame, root: str, layout: str = "v3") -> None:
    rows = tasks.select("task_index", "task")
    if layout == "v3":
        rows.write.parquet(f"{root}/meta/tasks.parquet")
    else:
        rows.write.json(f"{root}/meta/tasks.jsonl")


def with_video_segments(episodes: DataFrame, cameras: Sequence[str], fps: float) -> DataFrame:
    """Segment columns of an output that has one video per episode and camera."""
    out = episodes
    for camera in cameras:
        out = out.withColumn(f"videos/{camera}/chunk_index", F.col("`data/chunk_index`")).withColumn(
            f"videos/{camera}/file_index", F.col("`data/file_index`")).withColumn(
            f"videos/{camera}/from_timestamp", F.lit(0.0)).withColumn(f"videos/{camera}/to_timestamp", F.col("length") / F.lit(float(fps)))
    return out


def write_episodes(episodes: DataFrame, root: str, layout: str = "v3") -> None:
    if layout == "v3":
        episodes.drop("dataset_id").write.parquet(f"{root}/meta/episodes")
    else:
        episodes.select("episode_index", "tasks", "length").write.json(f"{root}/meta/episodes.jsonl")


def nested_stats(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Statistics as arrays in element order per (by, feature); a feature has one row per declared element."""
    rows = stats.groupBy(*by, "feature").agg(F.array_sort(F.collect_list(F.struct("dim", *STATISTICS))).alias("_d"))
    arrays = [F.transform("_d", _field(s)).alias(s) for s in STATISTICS if s != "count"]
    return rows.select(*by, "feature", *arrays, F.array(F.get("_d", F.lit(0))["count"]).alias("count"))


def _field(name: str):
    return lambda d: d[name]


def _folded(flat: list, shape: Sequence[int]) -> list:
    """A flat list in C order as nested lists of the given shape."""
    for n in reversed(shape[1:]):
        flat = [flat[i:i + n] for i in range(0, len(flat), n)]
    return flat


def write_stats_json(stats: DataFrame, root: str, shapes: dict[str, Sequence[int]] | None = None) -> None:
    """Global statistics as one document: feature → statistic → array of the feature's shape. One row per declared feature is
    collected."""
    rows = nested_stats(stats).select("feature", F.to_json(F.struct(*STATISTICS)).alias("json")).collect()
    document = {r.feature: json.loads(r.json) for r in sorted(rows, key=lambda r: r.feature)}
    for feature, shape in (shapes or {}).items():
        for name, value in document.get(feature, {}).items():
            if name != "count":
                document[feature][name] = _folded(value, shape)
    write_document(stats.sparkSession, f"{root}/meta/stats.json", json.dumps(document))


def write_episode_stats_jsonl(stats: DataFrame, root: str) -> None:
    per = nested_stats(stats, EPISODE)
    entry = F.struct("feature", F.struct(*STATISTICS).alias("s"))
    lines = per.groupBy(*EPISODE).agg(F.map_from_entries(F.collect_list(entry)).alias("stats"))
    lines.select("episode_index", "stats").write.json(f"{root}/meta/episodes_stats.jsonl")


def with_episode_stats(episodes: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """Episode table with ``stats/<feature>/<statistic>`` array columns in a stable order."""
    per = nested_stats(stats, EPISODE)
    named = [F.first(F.when(F.col("feature") == f, F.col(s)), True).alias(f"stats/{f}/{s}") for f in features for s in STATISTICS]
    return episodes.join(per.groupBy(*EPISODE).agg(*named), EPISODE, "left")


def write_lineage(lineage: DataFrame, root: str) -> None:
    lineage.write.json(f"{root}/meta/lineage")


def write_annotation_sidecar(atoms: DataFrame, path: str) -> None:
    """Annotation document, version 2: styles and the atoms of each episode as JSON lines below ``path``.

    The document is one line per episode, so that no task holds more than the list of one episode.
    """
    atom = F.struct("role", "content", "style", F.col("ts").alias("timestamp"), "camera", "tool_calls")
    lists = atoms.groupBy(*EPISODE).agg(F.array_sort(F.collect_list(F.struct("ord", atom.alias("a")))).alias("_l"))
    entry = F.map_from_arrays(F.array(F.col("episode_index").cast("string")), F.array(F.struct(F.transform("_l", lambda x: x["a"]).alias("atoms"))))
    lists.select(F.lit(2).alias("version"), F.struct(
        F.array(*[F.lit(s) for s in sorted(rules.PERSISTENT_STYLES)]).alias("persistent_styles"),
        F.array(*[F.lit(s) for s in sorted(rules.EVENT_STYLES)]).alias("event_styles")).alias("schema"), entry.alias("episodes")).write.json(path)


def typed(frames: DataFrame, schema: T.StructType) -> DataFrame:
    """Frames with exactly the given column types; with ANSI casts a value that does not fit is an error."""
    out = frames.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
    return out.to(schema)


def write_header(spark, root: str, header: dict) -> None:
    write_document(spark, f"{root}/meta/info.json", json.dumps(header))


def convert_to_v2(frames: DataFrame, episodes: DataFrame, tasks: DataFrame, header: dict, root: str) -> None:
    """v3 data set rewritten in layout v2.1; refused when it declares language features."""
    if any(f.get("dtype") == "language" for f in header["features"].values()):
        raise ValueError("layout v2.1 cannot hold language features")
    write_frames_v2(frames, root, header.get("chunks_size", 1000))
    write_episodes(episodes, root, "v2")
    write_tasks(tasks, root, "v2")
    write_header(frames.sparkSession, root, {**header, "codebase_version": "v2.1"})
