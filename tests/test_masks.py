import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from episodica.operators import masks, series

CAND = "candidate_id string, object_id int, target string, requires_selection boolean, auto_selected boolean, tracked boolean"


def candidates(spark, rows):
    return spark.createDataFrame(rows, CAND)


def ranges(spark, rows):
    return spark.createDataFrame(rows, "candidate_id string, start bigint, end bigint")


def test_coverage(spark, tiny):
    cand = candidates(spark, [("a", 1, "protect", False, None, True), ("b", 1, "protect", True, True, True), ("c", 1, "protect", True, False, True),
                              ("d", 2, "replace", False, None, False), ("e", 3, "replace", False, None, True), ("f", 4, "replace", False, None, True)])
    rng = ranges(spark, [("a", 0, 3), ("a", 6, 8), ("b", 3, 7), ("c", 10, 11), ("e", 2, 2), ("e", 30, 40)])
    got = {r.object_id: r for r in masks.object_coverage(cand, rng, 12).collect()}
    assert set(got) == {1, 3, 4}
    assert (got[1].visible_frames, got[1].gaps, got[1].first_missing) == (9, 1, 9)
    assert (got[3].visible_frames, got[3].gaps) == (12, 2)
    missing = sorted((r.object_id, r.start, r.end) for r in masks.missing_ranges(cand, rng, 12).collect())
    assert missing == [(1, 9, 11), (3, 0, 1), (3, 3, 11), (4, 0, 11)]
    chosen = spark.createDataFrame([("c",)], "candidate_id string")
    again = {r.object_id: r for r in masks.object_coverage(cand, rng, 12, chosen).collect()}
    assert again[1].visible_frames == 11 and again[1].first_missing == 9
    signals = masks.coverage_signals(masks.object_coverage(cand, rng, 12)).collect()
    assert {(s.object_id, s.frame_index) for s in signals} == {(1, 9), (3, 0), (4, 0)}


def test_automatic_choice(spark):
    cand = candidates(spark, [("a", 1, "x", True, None, True), ("b", 2, "x", True, None, True), ("c", 2, "x", True, None, True), ("d", 3, "x", True, None, True),
                              ("e", 3, "x", True, None, True), ("f", 4, "x", True, None, True), ("g", 4, "x", True, None, True)])
    rng = ranges(spark, [("b", 0, 4), ("c", 5, 9), ("d", 0, 4), ("e", 4, 9), ("f", 0, 1)])
    got = {r.object_id: r.decision for r in masks.auto_select(cand, rng).collect()}
    assert got == {1: "auto", 2: "auto", 3: "unresolved", 4: "unresolved"}
    chosen = spark.createDataFrame([("d",)], "candidate_id string")
    assert {r.object_id: r.decision for r in masks.auto_select(cand, rng, chosen).collect()}[3] == "explicit"


def greedy(tracks, capacity):
    """``tracks``: id → (initial, ranges)."""
    occupied, out = {}, {}
    frames = {k: {f for a, b in r for f in range(a, b + 1)} for k, (_, r) in tracks.items()}
    for k, (initial, _) in tracks.items():
        if initial:
            for f in frames[k]:
                occupied[f] = occupied.get(f, 0) + 1
    for k in sorted((k for k, (i, _) in tracks.items() if not i), key=lambda k: (min(frames[k]), k)):
        ok = capacity is None or all(occupied.get(f, 0) < capacity for f in frames[k])
        if ok:
            for f in frames[k]:
                occupied[f] = occupied.get(f, 0) + 1
        out[k] = ok
    return out


@pytest.mark.parametrize("seed", range(4))
def test_late_tracks(spark, tiny, seed):
    rng = np.random.default_rng(seed)
    groups, rows = {}, []
    for g, capacity in ((1, 1), (2, 2), (3, None)):
        tracks = {}
        for k in range(14):
            start = int(rng.integers(0, 60))
            parts = [(start, start + int(rng.integers(0, 6)))]
            if rng.random() < 0.4:
                parts.append((parts[0][1] + 3, parts[0][1] + 5))
            tracks[k] = (bool(rng.random() < 0.2), parts)
            rows += [(g, k, a, b, tracks[k][0], capacity) for a, b in parts]
        groups[g] = greedy(tracks, capacity)
    df = spark.createDataFrame(rows, "group_id bigint, track_id bigint, start bigint, end bigint, initial boolean, capacity int")
    got = {(r.group_id, r.track_id): r for r in masks.late_tracks(df).collect()}
    assert {k: r.accepted for k, r in got.items()} == {(g, k): ok for g, out in groups.items() for k, ok in out.items()}
    assert not any(r.reentry for (g, _), r in got.items() if g == 3)


def test_review_signals(spark, tiny):
    areas = [10, 11, 0, 30, 14, 100, 100, 40]
    df = spark.createDataFrame([("d", 0, i, a) for i, a in enumerate(areas)], "dataset_id string, episode_index bigint, frame_index bigint, area int")
    got = {r.frame_index: r.reason for r in masks.review_signals(df, series.EPISODE, 100).collect()}
    want, before = {}, None
    for i, a in enumerate(areas):
        if a == 0:
            want[i] = "empty_mask"
        elif a == 100:
            want[i] = "full_frame_mask"
        elif before is not None and abs(a - before) > max(a, before) * .5:
            want[i] = "abrupt_area_change"
        before = a
    assert got == want
    visible = masks.visible_ranges(df, series.EPISODE).collect()
    assert sorted((r.start, r.end) for r in visible) == [(0, 1), (3, 7)]


def test_prompts(spark):
    prompts = spark.createDataFrame([(1, "protect"), (2, "replace"), (None, "replace"), (None, "protect")], "object_id int, target string")
    cand = spark.createDataFrame([(1, "protect", 5), (2, "replace", 0)], "object_id int, target string, area_pixels int")
    got = {(r.object_id, r.target) for r in masks.unmatched_prompts(prompts, cand).collect()}
    assert got == {(2, "replace"), (None, "replace")}


def test_overlapping_ranges_of_one_track_count_once(spark, tiny):
    rows = [("g", 1, 0, 9, True, 2), ("g", 2, 2, 6, False, 2), ("g", 2, 4, 8, False, 2), ("g", 3, 20, 22, False, 2)]
    ranges_ = spark.createDataFrame(rows, "group_id string, track_id bigint, start bigint, end bigint, initial boolean, capacity int").withColumn(
        "group_id", F.lit(1).cast("bigint"))
    assert {r.track_id: r.accepted for r in masks.late_tracks(ranges_).collect()} == {2: True, 3: True}


def test_sweep_over_many_batches_keeps_only_the_room_ahead():
    """Long sets arrive in small batches; the result is that of the plain rule."""
    rng = np.random.default_rng(11)
    tracks = {}
    for k in range(400):
        start = int(rng.integers(0, 300))
        parts = [(start, start + int(rng.integers(0, 30)))]
        if rng.random() < 0.3:
            parts.append((parts[0][1] - 1, parts[0][1] + 20))
        tracks[k] = (bool(rng.random() < 0.1), parts)
    rows = [(1, 0, k, initial, 6.0, a, b) for k, (initial, parts) in tracks.items() for a, b in parts]
    first = {k: min(a for a, _ in parts) for k, (_, parts) in tracks.items()}
    rows.sort(key=lambda r: (not r[3], first[r[2]], r[2], r[5]))
    names = ["group_id", "part", "track_id", "initial", "capacity", "start", "end"]
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows[i:i + 7]))))) for i in range(0, len(rows), 7)]
    got = {r["track_id"]: r["_ok"] for out in masks._sweep(iter(batches)) for r in out.to_pylist()}
    assert got == greedy(tracks, 6)
