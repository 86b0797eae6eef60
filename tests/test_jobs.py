import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.operators import augment, curate, merge, series, trim
from tests.conftest import make_frames

EP = series.EPISODE


def episodes(spark, lengths, dataset="d"):
    return spark.createDataFrame([(dataset, i, n) for i, n in enumerate(lengths)], "dataset_id string, episode_index bigint, length bigint")


def ids(spark, values):
    return spark.createDataFrame([("d", v) for v in values], "dataset_id string, episode_index bigint")


def drawn(kept, seed):
    return sorted(kept, key=lambda i: hashlib.md5(f"{seed}/d/{i}".encode()).hexdigest())


def test_seeded_split_equals_brute_force(spark):
    e = episodes(spark, [5] * 23)
    chosen = curate.select_episodes(e, ids(spark, [3, 4]), "unflagged")
    want = set(drawn([i for i in range(23) if i not in (3, 4)], 9)[:6])  # 30 % of 21, halves up
    got = curate.random_split(chosen.repartition(4), 30, 9)
    assert {r.episode_index for r in got.filter("is_eval").collect()} == want
    assert got.count() == 21 and got.columns == [*chosen.columns, "is_eval"]
    with pytest.raises(ValueError, match="one data set"):
        curate.random_split(e.unionByName(episodes(spark, [5], "other")), 30, 9)
    sides = curate.split_sides(curate.random_split(chosen, 0, 9))
    assert list(sides) == ["train"]
    with pytest.raises(ValueError):
        curate.flag_split(e, ids(spark, []))
    with pytest.raises(ValueError):
        curate.require_selection(curate.select_episodes(e, ids(spark, []), "flagged"))


def test_hash_split_is_exact_and_stable(spark):
    e = episodes(spark, [1] * 200)
    first = {r.episode_index for r in curate.hash_split(e, 12.5, 1).filter("is_eval").collect()}
    second = {r.episode_index for r in curate.hash_split(e.repartition(5), 12.5, 1).filter("is_eval").collect()}
    assert len(first) == 25 and first == second
    assert curate.hash_split(e, 0, 1).filter("is_eval").count() == 0
    assert curate.hash_split(e, 100, 1).filter("is_eval").count() == 200


@pytest.mark.parametrize("n,percent,count", [(10, 30, 3), (10, 0, 1), (0, 50, 0), (4, 100, 4), (4, 250, 4), (5, 50, 3)])
def test_seeded_sample_equals_brute_force(spark, n, percent, count):
    got = curate.sample_episodes(episodes(spark, [1] * n).repartition(3), percent, 42)
    assert {r.episode_index for r in got.collect()} == set(drawn(range(n), 42)[:count])


def test_flag_changes(spark):
    flags = ids(spark, [1, 2])
    changes = spark.createDataFrame([("d", 1, False), ("d", 2, True), ("d", 3, True), ("d", 4, False)], "dataset_id string, episode_index bigint, flagged boolean")
    assert {r.episode_index for r in curate.apply_flags(flags, curate.check_changes(changes)).collect()} == {2, 3}
    revisions = spark.createDataFrame([("d", 7), ("e", 1)], "dataset_id string, revision bigint")
    assert {r.dataset_id: r.revision for r in curate.next_revision(revisions, flags, changes).collect()} == {"d": 8, "e": 1}
    same = changes.filter("episode_index in (2, 4)")
    assert curate.next_revision(revisions, flags, same).filter("dataset_id = 'd'").first().revision == 7
    with pytest.raises(ValueError):
        curate.check_changes(changes.union(changes))


def test_recipe_end_to_end(spark, tiny):
    x = np.array([0, 0, 0, 1, 2, 3, 3, 3, 3, 3])[:, None]
    frames = make_frames(spark, [(x, x), (x, x), (x, x)])
    tasks = spark.createDataFrame([("d", 0, "pick"), ("d", 1, "unused")], "dataset_id string, task_index bigint, task string")
    manual = spark.createDataFrame([("d", 2, 2, 8)], "dataset_id string, episode_index bigint, start bigint, end bigint")
    recipe = curate.Recipe(fps=10, mode="delete_flagged", motion=trim.MotionTrim(threshold=.1, hold_time_s=.1, margin_s=0), pairs=[(0, 0)])
    out = curate.curate(recipe, frames, episodes(spark, [10, 10, 10]), tasks, ids(spark, [1]), overrides=manual)
    rows = out.frames.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(len(rows)))
    assert [(r.output_episode_index, r.source_episode_index, r.source_start_frame, r.source_end_frame, r.method) for r in out.lineage.orderBy("output_episode_index").collect()] == [
        (0, 0, 3, 6, "motion"), (1, 2, 2, 8, "manual")]
    second = [r for r in rows if r.episode_index == 1]
    assert [r.frame_index for r in second] == list(range(6)) and [r.timestamp for r in second] == pytest.approx([i / 10 for i in range(6)])
    assert [r.action[0] for r in second] == [0, 1, 2, 3, 3, 3]
    table = out.episodes.orderBy("episode_index").collect()
    assert [(r.length, r.dataset_from_index, r.dataset_to_index, r.tasks) for r in table] == [(3, 0, 3, ["pick"]), (6, 3, 9, ["pick"])]
    assert [r.task for r in out.tasks.collect()] == ["pick"]
    with pytest.raises(ValueError, match="missing"):
        curate.remap_tasks(frames, tasks.filter("task_index = 1"))


def test_draws_equal_sequential_numpy(spark):
    e = episodes(spark, [5, 5, 5, 5]).filter("episode_index <> 1")
    degrees = [1, 2, 3, 4, 5, 6, 7.5]
    got = {(r.copy, r.episode_index): r.offsets_deg for r in augment.draw_offsets(e.repartition(3), degrees, 2, 123).collect()}
    rng = np.random.default_rng(123)
    for c in (1, 2):
        for i in (0, 2, 3):
            want = np.concatenate([rng.uniform(-1, 1, 7) * degrees for _ in range(2)])
            assert got[c, i] == pytest.approx(want.tolist(), rel=0, abs=0)


def test_augmented_copies(spark, tiny):
    names = [f"right_arm_{i}" for i in range(7)] + [f"left_arm_{i}" for i in range(7)] + ["right_gripper_0", "left_gripper_0"]
    base = (np.arange(80).reshape(5, 16) / 100).astype(np.float32)
    data = [(base + e, base + e + np.float32(.5)) for e in range(3)]
    frames = make_frames(spark, data)
    e = episodes(spark, [5, 5, 5])
    draws = augment.draw_offsets(e, [1, 2, 3, 4, 5, 6, 7], 2, 5)
    at = augment.arm_positions(names)
    out = augment.augment(frames, e, draws, at, at, 16).orderBy("index").collect()
    assert len(out) == 45 and [r["index"] for r in out] == list(range(45)) and [r.episode_index for r in out] == [i // 5 for i in range(45)]
    offsets = {(r.copy, r.episode_index): np.array(r.offsets_deg) for r in draws.collect()}
    for r in out:
        a, s = data[r.source_episode_index][0][r.frame_index], data[r.source_episode_index][1][r.frame_index]
        shift = np.zeros(16)
        if r.copy:
            assert r.episode_index == 3 + (r.copy - 1) * 3 + r.source_episode_index
            shift[:14] = np.deg2rad(offsets[r.copy, r.source_episode_index])
        assert np.array_equal(np.float32(r.action), (a.astype(float) + shift).astype(np.float32))
        assert np.array_equal(np.float32(r.state), (s.astype(float) + shift).astype(np.float32))
    with pytest.raises(ValueError, match="right_arm_0"):
        augment.arm_positions(names[1:])


def test_merge(spark, tiny):
    x = np.arange(7)[:, None]
    one, two = make_frames(spark, [(x, x), (x[:3], x[:3])], dataset="a"), make_frames(spark, [(x[:5] + 10, x[:5])], dataset="b")
    tasks = spark.createDataFrame([(0, 0, 0, "pick"), (0, 1, 1, "place"), (1, 0, 0, "wipe"), (1, 1, 1, "pick")], "source_ord int, row_ord int, task_index bigint, task string")
    two = two.withColumn("task_index", F.lit(1).cast("bigint"))
    frames, lineage = merge.union_frames([one, two], tasks, "m")
    rows = frames.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(15)) and {r.task_index for r in rows} == {0}
    assert [(r.episode_index, r.source_ord, r.source_episode_index) for r in lineage.orderBy("episode_index").collect()] == [(0, 0, 0), (1, 0, 1), (2, 1, 0)]
    assert {(r.source_ord, r.task_index): r.merged_index for r in merge.union_tasks(tasks).collect()} == {(0, 0): 0, (0, 1): 1, (1, 0): 2, (1, 1): 0}
    assert merge.lost_rows(one.unionByName(two), frames, ["frame_index", "timestamp", "action"]).isEmpty()
    assert not merge.lost_rows(one, frames, ["frame_index", "action"]).isEmpty()
    with pytest.raises(ValueError):
        merge.union_frames([one], tasks, "m")
    with pytest.raises(ValueError, match="fps"):
        merge.check_headers([{"codebase_version": "v3.0", "fps": 10}, {"codebase_version": "v3.0", "fps": 30}])


def test_normalize_stops_at_a_changed_value(spark):
    kind = "dataset_id string, action array<double>, timestamp float"
    fine = merge.normalize(spark.createDataFrame([("d", [0.5, None, float("nan"), float("inf")], 0.5), ("d", None, None)], kind), {"action": 4})
    assert fine.schema["action"].dataType.simpleString() == "array<float>" and fine.schema["timestamp"].dataType.simpleString() == "double"
    rows = fine.collect()
    assert rows[0].action[:2] == [0.5, None] and np.isnan(rows[0].action[2]) and rows[1].action is None
    for value in (1.0 + 1e-12, 1e300):
        with pytest.raises(Exception, match="not exact as float"):
            merge.normalize(spark.createDataFrame([("d", [value], 0.0)], kind), {"action": 1}).collect()


def test_lost_rows_count_copies(spark):
    a = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, None), (3, [3.0])], "k int, v array<double>")
    b = spark.createDataFrame([(1, [1.0]), (2, None), (4, [3.0]), (4, [3.0])], "k int, v array<double>")
    assert sorted((r.k, r.side) for r in merge.lost_rows(a, b, ["k", "v"]).collect()) == [(1, "missing"), (3, "missing"), (4, "extra"), (4, "extra")]


@pytest.mark.parametrize("vector,time,column,problem", [
    (None, 0.0, "action", "null_vector"), ([1.0], 0.0, "action", "length"), ([1.0, None], 0.0, "action", "null_element"),
    ([1.0, float("nan")], 0.0, "action", "non_finite"), ([1.0, 2.0], float("nan"), "timestamp", "non_finite"), ([1.0, 2.0], 0.0, None, None)])
def test_merge_refuses_lossy_values(spark, vector, time, column, problem):
    df = spark.createDataFrame([("d", 0, 0, vector, time)], "dataset_id string, episode_index bigint, frame_index bigint, action array<float>, timestamp double")
    got = [(r.column, r.problem) for r in merge.value_problems(df, {"action": 2}).collect()]
    assert got == ([(column, problem)] if problem else [])


def test_merge_schemas(spark):
    vector = T.ArrayType(T.FloatType())
    a = T.StructType([T.StructField("action", vector), T.StructField("timestamp", T.FloatType()), T.StructField("index", T.LongType())])
    b = T.StructType([T.StructField("action", vector), T.StructField("timestamp", T.DoubleType()), T.StructField("index", T.LongType())])
    assert merge.schema_problems(a, b, {"action": 2}) == []
    c = T.StructType([b.fields[0], b.fields[1], T.StructField("index", T.IntegerType())])
    assert merge.schema_problems(a, c, {"action": 2}) == ["index: int instead of bigint"]
    assert "columns" in merge.schema_problems(a, T.StructType(a.fields[::-1]), {})[0]
    assert merge.schema_problems(a, T.StructType([T.StructField("action", T.ArrayType(T.DoubleType())), *a.fields[1:]]), {"action": 2}) == ["action: expected an array of float"]
    rows = [(s, i, n, d, [2], None) for s in (0, 1) for i, (n, d) in enumerate([("action", "float32"), ("timestamp", f"float{32 * (s + 1)}"), ("x", f"int{32 * (s + 1)}")])]
    features = spark.createDataFrame(rows, "source_ord int, ord int, feature string, dtype string, shape array<int>, names array<string>")
    assert [r.feature for r in merge.feature_differences(features).collect()] == ["x"]


def test_video_shards_keep_first_seen_order(spark):
    rows = [(0, "top", "b", 0), (0, "top", "a", 1), (0, "top", "b", 2), (1, "top", "b", 3), (0, "side", "z", 0)]
    df = spark.createDataFrame(rows, "source_ord int, camera string, path string, ord int")
    got = {(r.source_ord, r.camera, r.path): r.file_index for r in merge.dedupe_video_shards(df).collect()}
    assert got == {(0, "top", "b"): 0, (0, "top", "a"): 1, (1, "top", "b"): 2, (0, "side", "z"): 0}


def test_annotation_versions(spark):
    kind = "dataset_id string, episode_index bigint, revision bigint, task_override string, atoms array<string>"
    now = spark.createDataFrame([("d", 0, 3, None, ["x"]), ("d", 1, 1, "t", ["y"])], kind)
    saved = spark.createDataFrame([("d", 0, " new ", []), ("d", 2, " ", ["z"])], "dataset_id string, episode_index bigint, task_override string, atoms array<string>")
    got = {r.episode_index: (r.revision, r.task_override, r.atoms) for r in curate.upsert_annotations(now, saved).collect()}
    assert got == {0: (4, "new", []), 1: (1, "t", ["y"]), 2: (1, None, ["z"])}


def test_schema_repair(spark):
    kind = "id int, pose struct<vector:array<float>,shape:struct<points:array<array<double>>>>"
    rows = spark.createDataFrame([(1, ([1.0, 2.0], ([[1.0, 2.0]],))), (2, None), (3, (None, ([],)))], kind)
    widths = {"pose.vector": 2, "pose.shape.points[]": 2}
    assert merge.restore_schema(rows, rows.schema, widths).collect() == rows.collect()
    with pytest.raises(Exception, match="pose.vector has another length than 3: 2"):
        merge.restore_schema(rows, rows.schema, {"pose.vector": 3}).collect()
    with pytest.raises(Exception, match=r"points\[\] has another length than 1: 2"):
        merge.restore_schema(rows, rows.schema, {"pose.shape.points[]": 1}).collect()
    def refusal(other, widths=widths):
        with pytest.raises(ValueError) as error:
            merge.restore_schema(spark.createDataFrame([], other), rows.schema, widths)
        return str(error.value)
    assert refusal(kind.replace("float", "double")) == "pose.vector[]: double instead of float"
    assert refusal(kind.replace("shape:", "form:")) == "pose: ['vector', 'form'] instead of ['vector', 'shape']"
    assert refusal(kind + ", extra int").startswith("columns")
    assert refusal(kind, {"id": 2}) == "id: int is no list"
    odd = spark.createDataFrame([("d", 0, 0, ([1.0], ([[1.0, 2.0], [3.0]],)))], "dataset_id string, episode_index bigint, frame_index bigint, pose struct<vector:array<float>,shape:struct<points:array<array<double>>>>")
    got = {(r.path, r.length) for r in merge.width_violations(odd, {**widths, "pose.shape.points": 2}).collect()}
    assert got == {("pose.vector", 1), ("pose.shape.points[]", 1)}


def test_file_names_after_a_failed_commit(spark, tmp_path):
    from episodica.sources.files import commit_names
    root = str(tmp_path)
    spark.range(4).selectExpr("id", "id div 2 as chunk", "id as file").repartition(4).write.partitionBy("chunk", "file").parquet(f"{root}/data")
    assert commit_names(spark, root) == 4
    assert commit_names(spark, root) == 0
    assert sorted(str(p.relative_to(root)) for p in tmp_path.rglob("*.parquet")) == [f"data/chunk-00{c}/file-00{f}.parquet" for c, f in ((0, 0), (0, 1), (1, 2), (1, 3))]
    assert [r.id for r in spark.read.parquet(f"{root}/data/chunk-001/file-002.parquet").collect()] == [2]


def test_layout_v2_files_are_named_by_the_tasks(spark, tmp_path, monkeypatch):
    from episodica.sources import readers, writers
    monkeypatch.setattr(writers, "ROWS_PER_TASK", 4)
    monkeypatch.setattr(writers, "ROWS_PER_GROUP", 3)

    def no_renames(*_):
        raise AssertionError("the driver renames one file after the other")
    monkeypatch.setattr(writers, "commit_names", no_renames)
    kind = "dataset_id string, episode_index bigint, frame_index bigint, extra struct<a:array<float>,t:timestamp_ntz>, state array<double>, small tinyint"
    # 1 has parts without a gap, 2 lacks its first two, 3 has frames without a number, 1005 lies in the next chunk
    numbers = {1: range(10), 2: [8, 9, 17], 3: [None, None, 0, 5], 1005: [0]}
    rows = [("d", e, n, ([e / 2, None], None), [float(e), float(n or 0)], e % 100) for e, ns in numbers.items() for n in ns]
    frames = spark.createDataFrame(rows, kind).repartition(3)
    writers.write_frames_v2(frames, str(tmp_path))
    names = [f"chunk-000/episode_{n}.parquet" for n in ("000001-1", "000001-2", "000001", "000002-1", "000002", "000003-1", "000003")] + ["chunk-001/episode_001005.parquet"]
    assert sorted(str(p.relative_to(tmp_path / "data")) for p in (tmp_path / "data").rglob("*.parquet")) == names
    assert not (tmp_path / "data/_temporary").exists() and (tmp_path / "data/_SUCCESS").exists()
    back = readers.scan_frames(spark, str(tmp_path), "d")
    assert back.drop("_file", "_row").schema.simpleString() == frames.schema.simpleString()
    assert sorted(map(str, back.drop("_file", "_row").collect())) == sorted(map(str, frames.collect()))
    part = lambda n: [r.frame_index for r in spark.read.parquet(f"{tmp_path}/data/chunk-000/episode_{n}.parquet").collect()]
    assert (part("000001"), part("000001-1"), part("000001-2")) == ([0, 1, 2, 3], [4, 5, 6, 7], [8, 9])
    assert (part("000002"), part("000002-1"), part("000003")) == ([8, 9], [17], [None, None, 0])
    with pytest.raises(FileExistsError):
        writers.write_frames_v2(frames, str(tmp_path))
