import json
import random

import pytest
from pyspark.sql import functions as F

from episodica.functions import language as rules
from episodica.functions import text
from episodica.operators import language as lang

ATOM = f"dataset_id string, episode_index bigint, ord int, role string, content string, style string, ts double, camera string, tool_calls {rules.TOOL_CALLS}"


def atoms(spark, rows):
    return spark.createDataFrame([("d", 0, i, *row) for i, row in enumerate(rows)], ATOM)


def frames(spark, times):
    return spark.createDataFrame([("d", 0, i, float(t)) for i, t in enumerate(times)], "dataset_id string, episode_index bigint, frame_index bigint, timestamp double")


def bounds(spark, start, end, length):
    return spark.createDataFrame([("d", 0, start, end, length)], "dataset_id string, episode_index bigint, start bigint, end bigint, length bigint")


def test_nearest_frame(spark):
    times = [0, .1, .2, .3, 1.0]
    at = [0.0, 0.05, 0.16, 0.26, 0.64, 0.66, 5.0]
    a = atoms(spark, [("user", "x", "interjection", t, None, None) for t in at])
    got = {r.ts: r.frame_index for r in lang.nearest_frame(a, frames(spark, times)).collect()}
    for t in at:
        assert got[t] == min(range(len(times)), key=lambda i: abs(times[i] - t)), t


def test_active_at_takes_the_later_of_equal_times(spark):
    a = atoms(spark, [("assistant", "one", "subtask", .1, None, None), ("assistant", "two", "subtask", .1, None, None), ("assistant", "p", "plan", .2, None, None)])
    got = {r.frame_index: r.active for r in lang.active_at(frames(spark, [0, .1, .5]), a, "subtask").collect()}
    assert got[0] is None and got[1].content == "two" and got[2].content == "two"


def test_one_time_for_half_of_all_rows(spark):
    """Half of the probes and of the annotations have one time; partitions of a few rows cut straight through them."""
    size = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rng = random.Random(2)
        at = [0.5] * 60 + [round(rng.random(), 2) for _ in range(60)]
        said = [0.5] * 25 + [round(rng.random(), 2) for _ in range(25)]
        a = atoms(spark, [("assistant", f"s{i}", "subtask", t, None, None) for i, t in enumerate(said)])
        probes = spark.createDataFrame([("d", 0, i, t) for i, t in enumerate(at)], "dataset_id string, episode_index bigint, frame_index bigint, timestamp double")
        for r in lang.active_at(probes, a, "subtask").collect():
            before = [(t, i) for i, t in enumerate(said) if t <= at[r.frame_index]]
            assert (r.active.ord if r.active else None) == (max(before)[1] if before else None)
        near = lang.nearest_frame(a, probes).collect()
        assert len(near) == len(said)
        for r in near:
            assert r.frame_index == min(range(len(at)), key=lambda i: (abs(at[i] - r.ts), at[i], i))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", size)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_within_is_inclusive_or_strict(spark):
    a = atoms(spark, [("user", "x", "interjection", 0.5, None, None)])
    probes = frames(spark, [0.25, 0.5, 0.75, 1.0])
    assert sorted(r.frame_index for r in lang.within(probes, a, 0.25).collect()) == [0, 1, 2]
    assert sorted(r.frame_index for r in lang.within(probes, a, 0.25, strict=True).collect()) == [1]


def test_projection_through_a_trim(spark):
    rows = [("user", "say it", "task_aug", 0.0, None, None), ("assistant", "old", "subtask", 0.0, None, None), ("assistant", "late", "subtask", 0.1, None, None),
            ("assistant", "gone", "memory", 0.1, None, None), ("assistant", "kept", "memory", 0.3, None, None), ("user", "hi", "interjection", 0.31, None, None),
            ("user", "early", "interjection", 0.0, None, None), ("assistant", "after", "plan", 0.5, None, None)]
    fr = frames(spark, [0, .1, .2, .3, .4, .5])
    out = lang.project(atoms(spark, rows), fr, bounds(spark, 2, 5, 6), 10.0)
    lasting = {r.content: r.ts for r in out.filter("column = 'language_persistent'").collect()}
    assert lasting == {"say it": 0.0, "late": 0.0, "kept": pytest.approx(0.1)}
    events = [(r.content, r.frame_index) for r in out.filter("column = 'language_events'").collect()]
    assert events == [("hi", 1)]
    kept = fr.filter("frame_index between 2 and 4").withColumn("frame_index", F.col("frame_index") - 2)
    nested = lang.nest(out, kept).orderBy("frame_index").collect()
    assert [[a.content for a in r.language_persistent] for r in nested] == [["late", "say it", "kept"]] * 3
    assert [len(r.language_events) for r in nested] == [0, 1, 0]


def test_camera_rules_of_projection(spark):
    fr, b = frames(spark, [0, .1]), bounds(spark, 0, 2, 2)
    wrong = atoms(spark, [("user", "what?", "vqa", 0.0, "observation.other", None)])
    with pytest.raises(Exception, match="unavailable camera"):
        lang.project(wrong, fr, b, 10.0, ["observation.top"]).collect()
    other = atoms(spark, [("user", "x", "plan", 0.0, "observation.top", None)])
    with pytest.raises(Exception, match="only visual questions"):
        lang.project(other, fr, b, 10.0, ["observation.top"]).collect()


SAY = [{"type": "function", "function": {"name": "say", "arguments": {"text": "hello"}}}]


@pytest.mark.parametrize("row,problem", [
    (("user", "hello", "interjection", 0.0, None, None), None),
    ((None, "hello", "interjection", 0.0, None, None), "role"),
    (("user", "hello", "unknown", 0.0, None, None), "style"),
    (("user", "hello", "plan", -1.0, None, None), "timestamp"),
    (("user", "a\rb", "plan", 0.0, None, None), "content_characters"),
    (("user", " ", "plan", 0.0, None, None), "empty"),
    (("assistant", None, None, 0.0, None, SAY), None),
    (("user", None, None, 0.0, None, SAY), "speech"),
    (("assistant", None, None, 0.0, None, [{"type": "function", "function": {"name": "move", "arguments": {"text": "x"}}}]), "tool_calls"),
    (("user", "what?", "vqa", 0.0, None, None), "vqa_camera"),
    (("assistant", "no json", "vqa", 0.0, "observation.top", None), "vqa_answer"),
    (("assistant", '{"label":"cup","count":2}', "vqa", 0.0, "observation.top", None), None),
    (("user", "x", "plan", 0.0, "observation.top", None), "camera"),
])
def test_atom_rules(spark, row, problem):
    a = atoms(spark, [row])
    got = a.select(rules.atom_problem(*[F.col(c) for c in ("role", "content", "style", "ts", "camera", "tool_calls")]).alias("p")).first().p
    assert got == problem


@pytest.mark.parametrize("answer,kind,valid", [
    ({"detections": [{"label": "a", "bbox_format": "xyxy", "bbox": [0, 0, .5, 1]}]}, "bbox", True),
    ({"detections": [{"label": "a", "bbox_format": "xyxy", "bbox": [0, 0, 5, 1]}]}, "bbox", False),
    ({"detections": []}, "bbox", False),
    ({"detections": [{"label": "a", "bbox_format": "xyxy", "bbox": [0, 0, 1, 1], "score": 1}]}, "bbox", False),
    ({"label": "a", "point_format": "xy", "point": [.1, .2], "camera": "c"}, "keypoint", True),
    ({"label": "a", "point_format": "yx", "point": [.1, .2]}, "keypoint", False),
    ({"label": "a", "count": 2.5}, "count", False),
    ({"label": "a", "count": True}, None, False),
    ({"label": "a", "count": 0, "note": "fine"}, "count", True),
    ({"label": "a", "attribute": "color", "value": "red"}, "attribute", True),
    ({"label": 3, "attribute": "color", "value": "red"}, "attribute", False),
    ({"subject": "a", "relation": "on", "object": "b"}, "spatial", True),
    ({"something": 1}, None, False),
])
def test_visual_answers(spark, answer, kind, valid):
    j = F.lit(json.dumps(answer))
    row = spark.range(1).select(rules.vqa_kind(j).alias("k"), rules.vqa_valid(j).alias("v")).first()
    assert (row.k, row.v) == (kind, valid)


def test_legacy_camera_in_the_answer(spark):
    rows = [(None, '{"camera":"top"}', True), (None, '{"camera":"side"}', False), (None, "{}", True), ("side", '{"camera":"top"}', False),
            (None, '{"detections":[{"camera":"side"},{"camera":"top"}]}', True)]
    df = spark.createDataFrame(rows, "camera string, payload string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", rules.camera_matches(F.col("camera"), "top", F.col("payload"))).collect())


def test_names(spark):
    rows = [("  Ａbc  DEF ", "abc def"), ("STRASSE", "strasse"), ("straße", "strasse")]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert all(r.k == r.want for r in df.withColumn("k", text.name_key(F.col("raw"))).collect())
    problems = spark.createDataFrame([("",), ("x" * 101,), ("a\tb",), ("ok",)], "n string").select(text.name_problem(F.col("n")).alias("p")).collect()
    assert [p.p for p in problems] == ["empty", "too_long", "control_character", None]


def test_joint_names(spark):
    joints = spark.createDataFrame([("openarm_left_joint2",), ("openarm_right_finger_joint1",), ("hip",), ("elbow",), ("left_finger_joint2",), ("knee",)], "joint string")
    columns = spark.createDataFrame([(0, "state | left_joint_2.pos"), (1, "state | right_gripper"), (2, "state | kHip"), (3, "state | Elbow"), (4, "state | left_finger_joint2_x")], "ord int, column string")
    aliases = spark.createDataFrame([("khip", "hip")], "suffix string, joint string")
    got = {r.joint: (r.column, r.rule) for r in text.match_joints(joints, columns, aliases).collect()}
    assert got == {"openarm_left_joint2": ("state | left_joint_2.pos", 3), "openarm_right_finger_joint1": ("state | right_gripper", 4),
                   "hip": ("state | kHip", 2), "elbow": ("state | Elbow", 1)}


def test_names_found_by_their_parts(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("ab_1") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["", "x"]
    patterns = ["".join(rng.choice("ab_1") for _ in range(rng.randrange(1, 6))) for _ in range(40)] + ["", "zz", "x"]
    got = {(r.pattern, r.name) for r in text.containing(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(n,) for n in set(names)], "name string")).collect()}
    assert got == {(p, n) for p in patterns for n in names if p and p in n}
