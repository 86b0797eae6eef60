import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import catalog, series, stats
from episodica.operators import validate as v
from episodica.sources import readers, writers
from episodica.sources.files import write_document
from tests.conftest import make_frames

VALUES = [0, 0, 0, 1, 2, 3, 3, 3, 3, 3]


def feature(dtype, shape=(1,), names=None):
    return {"dtype": dtype, "shape": list(shape), "names": names}


HEADER = {
    "codebase_version": "v3.0", "robot_type": "arm", "fps": 10, "total_episodes": 2, "total_frames": 20, "total_tasks": 1, "chunks_size": 1000,
    "splits": {"train": "0:2"},
    "features": {"action": feature("float32", names=["joint_0"]), "observation.state": feature("float32", names={"motors": ["joint_0"]}), "timestamp": feature("float64"),
                 "frame_index": feature("int64"), "episode_index": feature("int64"), "index": feature("int64"), "task_index": feature("int64")}}


def write(spark, root, frames=None, header=None, tasks=None, episodes=None, stored=None):
    x = np.array(VALUES)[:, None]
    good = make_frames(spark, [(x, x), (x, x)])
    frames = good if frames is None else frames(good)
    table = writers.plan_shards(series.episode_lengths(good).withColumn("tasks", F.array(F.lit("pick"))), rows_per_file=100)
    table = table if episodes is None else episodes(table)
    names = spark.createDataFrame([("d", 0, "pick")], "dataset_id string, task_index bigint, task string")
    # frames are written as they are, so that damaged ones stay damaged
    shown = frames.withColumnRenamed("state", "observation.state").drop("dataset_id")
    shown.coalesce(1).write.parquet(f"{root}/data/chunk-000")
    writers.write_episodes(table, root)
    writers.write_tasks(names if tasks is None else tasks(names), root)
    fresh = stats.feature_stats(good, ["action", "state"]).withColumn("feature", F.when(F.col("feature") == "state", "observation.state").otherwise(F.col("feature")))
    writers.write_stats_json(fresh if stored is None else stored(fresh), root)
    writers.write_header(spark, root, {**HEADER, **(header or {})})


def load(spark, root):
    head = readers.read_header(spark, root, "d")
    return v.Dataset("d", head, readers.read_features(head), readers.read_splits(head), readers.scan_tasks(spark, root, "d", "v3.0"),
                     readers.scan_episodes(spark, root, "d", "v3.0"), readers.scan_frames(spark, root, "d"))


def test_sound_data_set(spark, tmp_path, tiny):
    root = str(tmp_path)
    write(spark, root)
    found = v.run(load(spark, root), "full")
    assert v.summary(found).first().passed
    stored = readers.read_stats(spark, f"{root}/meta/stats.json", "d")
    data = load(spark, root)
    declared = data.features.filter("feature in ('action', 'observation.state')")
    assert v.stored_stats_issues(stored, declared).isEmpty()
    state = v.episode_state(data.frames, v.numeric_shapes(data.frames, declared.collect()))
    assert v.stats_issues(state, stored, declared, "d").isEmpty()
    with pytest.raises(ValueError):
        v.run(data, "fast")


def dataset(spark, frames, header=None, tasks=None, episodes=None, total=None):
    """A data set in memory; rows are stored in the order of their ``index``."""
    doc = {**HEADER, "total_episodes": total or 2, "total_frames": 10 * (total or 2), "splits": {"train": f"0:{total or 2}"}, **(header or {})}
    text = spark.createDataFrame([(json.dumps(doc),)], "value string")
    head = text.select(F.lit("d").alias("dataset_id"), F.from_json("value", readers.HEADER_TYPE).alias("h")).select("dataset_id", "h.*")
    n = total or 2
    table = spark.createDataFrame([("d", e, 10, ["pick"], 10 * e, 10 * e + 10) for e in range(n)],
                                  "dataset_id string, episode_index bigint, length bigint, tasks array<string>, dataset_from_index bigint, dataset_to_index bigint")
    names = spark.createDataFrame([("d", 0, "pick")], "dataset_id string, task_index bigint, task string")
    return v.Dataset("d", head, readers.read_features(head), readers.read_splits(head), names if tasks is None else tasks(names),
                     table if episodes is None else episodes(table), frames)


def stored_frames(spark, episodes=2):
    x = np.array(VALUES)[:, None]
    return make_frames(spark, [(x, x)] * episodes).withColumn("_file", F.lit("f")).withColumn("_row", F.col("index"))


def damaged(frames, episode, **columns):
    """Replace columns of one episode; the others keep their values."""
    for name, value in columns.items():
        frames = frames.withColumn(name, F.when(F.col("episode_index") == episode, value(F.col(name))).otherwise(F.col(name)))
    return frames


def failures(found):
    return {(r.code, r.episode_index) for r in found.filter("severity = 'FAIL'").collect()}


def test_damaged_episodes_are_told_apart(spark, tiny):
    f = stored_frames(spark, 9)
    f = damaged(f, 0, frame_index=lambda c: 9 - c)
    f = damaged(f, 1, frame_index=lambda c: c * 0)
    f = damaged(f, 2, task_index=lambda c: c + 999)
    f = damaged(f, 3, timestamp=lambda c: c + 100)
    f = damaged(f, 4, timestamp=lambda c: c * 0)
    f = damaged(f, 5, timestamp=lambda c: F.lit(float("nan")))
    f = damaged(f, 6, state=lambda c: F.array(F.lit(float("nan")).cast("float")))
    f = damaged(f, 7, action=lambda c: F.concat(c, c))
    assert failures(v.run(dataset(spark, f, total=9), "full")) == {
        ("frame_index_mismatch", 0), ("frame_index_mismatch", 1), ("task_reference_invalid", 2), ("timestamp_alignment", 3), ("timestamp_regression", 4),
        ("timestamp_alignment", 4), ("timestamp_non_finite", 5), ("feature_non_finite", 5), ("feature_non_finite", 6), ("feature_shape_mismatch", 7)}


def test_quick_run_reads_first_and_last_episode(spark):
    f = damaged(damaged(stored_frames(spark, 4), 1, timestamp=lambda c: c * 0), 3, timestamp=lambda c: c + 100)
    assert failures(v.run(dataset(spark, f, total=4), "quick")) == {("timestamp_alignment", 3)}


@pytest.mark.parametrize("change,code", [
    (lambda f: f.withColumn("frame_index", F.col("frame_index") + .25), "numeric_data_invalid"), (lambda f: f.drop("task_index"), "missing_required_column"),
    (lambda f: f.withColumn("action", F.array(F.lit("x"))), "feature_dtype_mismatch"),
    (lambda f: f.withColumn("action", F.col("action").cast("array<double>")), "feature_dtype_mismatch")])
def test_damaged_columns(spark, change, code):
    assert {(code, 0), (code, 1)} <= failures(v.run(dataset(spark, change(stored_frames(spark))), "full"))


def test_rows_stay_where_they_are_when_episodes_lie_in_one_file(spark):
    placed = v.with_storage_position(stored_frames(spark))
    joined = [line for line in placed._jdf.queryExecution().sparkPlan().toString().splitlines() if "LeftOuter" in line]
    assert joined and all("BroadcastHashJoin" in line for line in joined)
    assert sorted(r.pos for r in placed.collect()) == sorted(2 * list(range(len(VALUES))))


def test_damaged_numbers_and_metadata(spark, tiny):
    placed = v.with_storage_position(stored_frames(spark).withColumn("index", F.col("index") + 1))
    assert failures(v.index_issues(placed)) == {("global_index_mismatch", 0), ("global_index_mismatch", 1)}
    assert v.index_issues(placed, full=False).isEmpty()
    data = dataset(spark, stored_frames(spark))
    bad = ("metadata_schema_invalid", None)
    for ids in (data.episodes.filter("episode_index = 0"), data.episodes.union(data.episodes.filter("episode_index = 0"))):
        assert failures(v.id_issues(ids, "episode_index", data.header, "total_episodes")) == {bad}
    assert v.id_issues(data.episodes, "episode_index", data.header, "total_episodes").isEmpty()
    assert failures(v.id_issues(data.tasks.filter("task_index > 5"), "task_index", data.header, "total_tasks")) == {bad}
    assert failures(v.task_text_issues(data.tasks.withColumn("task", F.lit(" ")))) == {bad}
    longer = damaged(data.episodes, 0, length=lambda c: F.lit(99).cast("bigint"))
    assert failures(v.length_issues(data.frames, longer)) == {("episode_metadata_mismatch", 0)}
    moved = damaged(data.episodes, 1, dataset_to_index=lambda c: c + 1)
    assert failures(v.length_issues(data.frames, moved)) == {("invalid_episode_offsets", 1)}
    assert failures(v.length_issues(data.frames.filter("episode_index = 0"), data.episodes)) == {("empty_episode", 1)}
    other = damaged(data.episodes, 1, tasks=lambda c: F.array(F.lit("other")))
    assert failures(v.task_issues(data.frames, other, data.tasks)) == {("task_reference_invalid", 1)}
    assert failures(v.total_issues(data.frames, data.header.withColumn("total_frames", F.lit(21)))) == {("frame_total_mismatch", None)}
    named = data.frames.withColumn("_file", F.lit("data/chunk-000/episode_000001.parquet"))
    assert failures(v.file_episode_issues(named)) == {("episode_index_mismatch", 1)}


@pytest.mark.parametrize("header", [
    {"splits": {"train": "0:999"}}, {"splits": {"a": "0:1"}}, {"splits": {"a": "0:1", "b": "0:2"}}, {"splits": {"a": "0-2"}}, {"fps": -1}, {"total_tasks": 0},
    {"codebase_version": "v1.6"}, {"features": {k: f for k, f in HEADER["features"].items() if k != "timestamp"}},
    {"features": {**HEADER["features"], "x": feature("complex64")}}, {"features": {**HEADER["features"], "x": feature("int8", [0])}}])
def test_damaged_headers(spark, header):
    data = dataset(spark, stored_frames(spark), header)
    assert failures(v.header_issues(data.header, data.features).unionByName(v.split_issues(data.splits))) == {("metadata_schema_invalid", None)}


def test_missing_and_embedded_features(spark):
    declared = {**HEADER["features"], "observation.effort": feature("float32", [3])}
    data = dataset(spark, stored_frames(spark), {"features": declared})
    placed = v.with_storage_position(data.frames)
    assert failures(v.feature_issues(placed, data.features.collect())) == {("feature_shape_mismatch", 0), ("feature_shape_mismatch", 1)}


def test_video_tables(spark):
    lengths = spark.createDataFrame([("d", 0, 3), ("d", 1, 2)], "dataset_id string, episode_index bigint, length bigint")
    videos = spark.createDataFrame([("d", 0, "top", "a", 0.0, 0.3), ("d", 1, "top", "a", 0.3, 0.9)],
                                   "dataset_id string, episode_index bigint, camera string, path string, from_timestamp double, to_timestamp double")
    assert failures(v.segment_issues(videos, lengths, 10.0)) == {("video_segment_metadata_invalid", 1)}
    good = spark.createDataFrame([("d", "a", i, i / 10) for i in range(5)], "dataset_id string, path string, n bigint, pts double")
    assert v.pts_issues(good, 10.0).isEmpty()
    for change in (F.when(F.col("n") == 3, F.lit(0.2)).otherwise(F.col("pts")), F.col("pts") + 1, F.col("pts") * 1.3):
        assert failures(v.pts_issues(good.withColumn("pts", change), 10.0)) == {("video_pts_mismatch", None)}
    assert failures(v.segment_pts_issues(videos, lengths, good, 10.0)) == {("video_segment_pts_mismatch", 1)}
    assert failures(v.segment_pts_issues(videos, lengths, good.filter("n < 4"), 10.0)) == {("video_frame_mismatch", 1)}


def test_warnings(spark, tmp_path):
    write(spark, str(tmp_path), frames=lambda f: f.withColumn("action", F.transform("action", lambda x: (x * 20000).cast("float"))).withColumn("state", F.array(F.lit(1).cast("float"))))
    rows = v.run(load(spark, str(tmp_path)), "full").filter("severity = 'WARN'").collect()
    assert {(r.code, r.feature, r.episode_index) for r in rows} == {(c, f, e) for c, f in (("constant_sensor", "state"), ("action_jump", "action")) for e in (0, 1)}


def test_stored_statistics_are_compared(spark, tmp_path):
    root = str(tmp_path)
    write(spark, root, stored=lambda s: s.withColumn("mean", F.when(F.col("feature") == "action", F.col("mean") + 1e-3).otherwise(F.col("mean"))))
    data = load(spark, root)
    stored = readers.read_stats(spark, f"{root}/meta/stats.json", "d")
    declared = data.features.filter("feature in ('action', 'observation.state')")
    state = v.episode_state(data.frames, v.numeric_shapes(data.frames, declared.collect()))
    got = [(r.code, r.feature, r.detail) for r in v.stats_issues(state, stored, declared, "d").collect()]
    assert got == [("stats_value_mismatch", "action", "mean")]
    soft = v.stats_issues(state, stored.withColumn("feature", F.when(F.col("feature") == "action", "index").otherwise(F.col("feature"))), declared.withColumn(
        "feature", F.when(F.col("feature") == "action", "index").otherwise(F.col("feature"))), "d", official=True)
    assert [(r.severity, r.code, r.feature) for r in soft.collect()] == [("FAIL", "stats_feature_unavailable", "index")]


def test_export_gate_and_rerun(spark, tmp_path):
    root = str(tmp_path)
    write(spark, root, stored=lambda s: s)
    data = load(spark, root)
    shapes = {("state" if n == "observation.state" else n): [1] for n in HEADER["features"]}
    every = stats.feature_stats(data.frames, list(shapes), shapes=shapes, total=20)
    stored = v.long_stats(every.withColumn("feature", F.when(F.col("feature") == "state", "observation.state").otherwise(F.col("feature"))), "d", stats.STATISTICS).withColumn("depth", F.lit(1))
    import dataclasses
    data = dataclasses.replace(data, stats=stored, manifest=lambda: catalog.manifest(spark, root))
    found, kept = v.check(data, "export_gate")
    assert found.isEmpty()
    assert v.dirty_episodes(data, kept.manifest, kept.manifest).isEmpty()
    again, _ = v.check(data, "full", kept)
    assert again.isEmpty()
    other = kept.manifest.withColumn("sha256", F.lit("x"))
    assert {r.episode_index for r in v.dirty_episodes(data, kept.manifest, other).collect()} == {0, 1}
    calls = iter([kept.manifest, other])
    changed, _ = v.check(dataclasses.replace(data, manifest=lambda: next(calls)), "export_gate")
    assert {r.code for r in changed.collect()} == {"content_changed"}
    with pytest.raises(ValueError, match="manifest"):
        v.run(load(spark, root), "export_gate")
    deferred = v.run(dataclasses.replace(data, stats_deferred=True), "full").collect()
    assert [(r.severity, r.code) for r in deferred] == [("WARN", "stats_deferred")]


def test_stored_statistics_schema(spark, tmp_path):
    good = {"min": [0], "max": [1], "mean": [.5], "std": [.1], "count": [4]}
    doc = {"ok": good, "missing": {k: x for k, x in good.items() if k != "mean"}, "text": {**good, "mean": ["0.5"]}, "count": {**good, "count": [4.5]},
           "shape": {**good, "min": [[0]]}, "crossed": {**good, "min": [2]}, "negative": {**good, "std": [-1]}}
    path = f"{tmp_path}/stats.json"
    write_document(spark, path, json.dumps(doc, indent=1))
    stored = readers.read_stats(spark, path, "d")
    features = spark.createDataFrame([("d", f, "float32", [1]) for f in [*doc, "none"]], "dataset_id string, feature string, dtype string, shape array<int>")
    got = {(r.feature, r.code) for r in v.stored_stats_issues(stored, features).collect()}
    assert got == {("missing", "stats_field_missing"), ("text", "stats_value_invalid"), ("count", "stats_count_invalid"), ("shape", "stats_shape_mismatch"),
                   ("crossed", "stats_value_invalid"), ("negative", "stats_value_invalid"), ("none", "stats_feature_missing")}


def test_episode_statistics_lines(spark, tmp_path):
    lines = ['{"episode_index":0,"stats":{"a":{"min":[1,2]}}}', '{"episode_index":0,"stats":{"a":{"min":[1]}}}', '{"episode_index":2,"stats":{},"x":1}',
             '{"episode_index":3,"stats":{"a":{"min":["1"]}}}']
    write_document(spark, f"{tmp_path}/s.jsonl", "\n".join(lines))
    got = {(r.episode_index, r.problem) for r in readers.episode_stats_problems(spark, f"{tmp_path}/s.jsonl").collect()}
    assert got == {(0, "duplicate"), (None, "keys"), (3, "value")}


def test_old_sidecar_is_migrated(spark, tmp_path):
    doc = {"episodes": {"3": {"subtasks": [{"label": "reach", "start": 1.5}, {"start": 2}], "high_levels": [{"start": 2.0, "user_prompt": "stop", "robot_utterance": "ok"}]},
                        "4": {"atoms": [{"role": "user", "content": "hi", "style": "interjection", "timestamp": 0.5}]}, "5": {"atoms": []}}}
    write_document(spark, f"{tmp_path}/a.json", json.dumps(doc, indent=2))
    rows = readers.read_annotation_sidecar(spark, f"{tmp_path}/a.json", "d").orderBy("episode_index", "ord").collect()
    assert [(r.episode_index, r.role, r.content, r.style, r.ts) for r in rows] == [
        (3, "assistant", "reach", "subtask", 1.5), (3, "user", "stop", "interjection", 2.0), (3, "assistant", None, None, 2.0), (4, "user", "hi", "interjection", 0.5)]
    assert rows[2].tool_calls[0].function.arguments.text == "ok"


def test_layout_v2_refuses_language(spark, tmp_path):
    header = {**HEADER, "features": {**HEADER["features"], "language_events": feature("language")}}
    frames = make_frames(spark, [([[1]], [[1]])])
    with pytest.raises(ValueError):
        writers.convert_to_v2(frames, series.episode_lengths(frames), frames, header, str(tmp_path))


def test_manifest_changes(spark, tmp_path):
    write_document(spark, f"{tmp_path}/a/x.txt", "one")
    write_document(spark, f"{tmp_path}/a/y.txt", "two")
    before = spark.createDataFrame(catalog.manifest(spark, f"{tmp_path}/a").collect())
    write_document(spark, f"{tmp_path}/a/y.txt", "three")
    write_document(spark, f"{tmp_path}/a/z.txt", "four")
    after = catalog.manifest(spark, f"{tmp_path}/a")
    assert {(r.path, r.change) for r in catalog.changed(before, after).collect()} == {("y.txt", "changed"), ("z.txt", "added")}
    assert v.content_issues(before, after, "d").count() == 2
    import hashlib
    files = {"x.txt": b"one", "y.txt": b"three", "z.txt": b"four"}
    text = "".join(f"{p}\0{len(b)}\0{hashlib.sha256(b).hexdigest()}\n" for p, b in sorted(files.items()))
    row = catalog.tree_hash(after).first()
    assert (row.tree_sha256, row.file_count, row.total_bytes) == (hashlib.sha256(text.encode()).hexdigest(), 3, 12)


def test_catalogue_states(spark, tmp_path):
    root = str(tmp_path)
    for name, doc, data in (("ready", {"codebase_version": "v3.0", "features": {}, "total_episodes": 12, "fps": 30}, True), ("incomplete", {"codebase_version": "v2.1", "features": {}}, False),
                            ("unsupported", {"codebase_version": "v1.6"}, True), ("broken", [1], True), ("odd", {"codebase_version": "v3.0", "features": {}, "total_episodes": -1, "fps": True}, True)):
        write_document(spark, f"{root}/x/{name}/meta/info.json", json.dumps(doc))
        if data:
            write_document(spark, f"{root}/x/{name}/data/f.parquet", "x")
    got = {r.name: (r.readiness, r.total_episodes, r.fps) for r in catalog.scan(spark, root, "raw").collect()}
    assert got == {"ready": ("ready", 12, 30.0), "incomplete": ("incomplete", None, None), "unsupported": ("unsupported", None, None), "broken": ("invalid", None, None), "odd": ("ready", None, None)}
    assert catalog.scan(spark, root, "raw", max_depth=1).count() == 0
    with pytest.raises(ValueError):
        catalog.scan(spark, root, "raw", max_depth=0)


def test_search_is_literal(spark):
    rows = [("a_b", "p1"), ("aXb", "p2"), ("100%", "p3")]
    df = spark.createDataFrame([(n, p, "raw", "ready", None, None, "2019", n) for n, p in rows], "name string, relative_path string, storage_area string, readiness string, robot_type string, missing_since string, first_seen_at string, dataset_id string")
    assert [r.name for r in catalog.search(df, text="A_b").collect()] == ["a_b"]
    assert [r.name for r in catalog.search(df, text="%").collect()] == ["100%"]
    assert [r.name for r in catalog.search(df, sort="name_desc", limit=1, offset=1).collect()] == ["a_b"]
    with pytest.raises(ValueError):
        catalog.search(df, sort="size")


def test_split_ranges_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for d in range(60):
        cuts = sorted({0, 6, *map(int, rng.integers(0, 7, 3))})
        ranges = [(a, b) for a, b in zip(cuts, cuts[1:])]
        for _ in range(d % 3):
            a, b = map(int, rng.integers(0, 8, 2))
            ranges[int(rng.integers(0, len(ranges)))] = (a, b)
        ranges += ranges[:1] if d % 7 == 6 else []
        rows += [(f"d{d:02d}", 6, f"n{i}", f"{a}:{b}") for i, (a, b) in enumerate(ranges)]
        good = sorted((a, b) for a, b in ranges if a < b <= 6)
        want[f"d{d:02d}"] = sorted(
            [f"range n{i}" for i, (a, b) in enumerate(ranges) if not a < b <= 6]
            + ["ranges overlap or leave episodes out"] * bool(good and any(a != p for (a, _), p in zip(good, [0, *[b for _, b in good]])))
            + ["some episodes are in no range"] * (max((b for _, b in good), default=None) != 6))
    found = v.split_issues(spark.createDataFrame(rows, "dataset_id string, total_episodes bigint, name string, range string").repartition(3))
    got = {d: [] for d in want}
    for r in found.collect():
        got[r.dataset_id].append(r.detail)
    assert {d: sorted(x) for d, x in got.items()} == want
    # bounds are not listed as rows of their own
    assert "min_by" not in found._jdf.queryExecution().optimizedPlan().toString()
