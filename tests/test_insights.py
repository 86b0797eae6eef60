import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import insights as ins
from tests.conftest import make_frames


@pytest.fixture
def episodes():
    rng = np.random.default_rng(11)
    out = []
    for n in (34, 29, 41):
        a = np.cumsum(rng.normal(size=(n, 2)), axis=0)
        a[:, 1] = np.round(a[:, 1] > 0)  # two values only
        s = np.vstack([a[:1], a[:-1]])
        out.append((a.astype(np.float32), s.astype(np.float32)))
    return out


def test_autocorrelation(spark, tiny, episodes):
    frames = make_frames(spark, episodes)
    top = min(100, min(len(a) for a, _ in episodes) // 2)
    want = np.zeros((2, top))
    for a, _ in episodes:
        for d in range(2):
            x = a[:, d].astype(float) - a[:, d].astype(float).mean()
            for lag in range(1, top + 1):
                want[d, lag - 1] += (x[:-lag] * x[lag:]).sum() / (x * x).sum() / len(episodes)
    acf = ins.autocorrelation(frames)
    got = {(r["dim"], r["lag"]): r["acf"] for r in acf.collect()}
    assert len(got) == 2 * top
    for (d, lag), v in got.items():
        assert v == pytest.approx(want[d, lag - 1])
    first = sorted(int(np.argmax(w < .5)) + 1 for w in want if (w < .5).any())
    assert ins.suggested_chunk(acf).first()[0] == first[len(first) // 2]


def correlation(a, s, lag):
    a, s = a - a.mean(), s - s.mean()
    t = np.arange(len(a))
    ok = (t + lag >= 0) & (t + lag < len(a))
    x, y = a[t[ok]], s[t[ok] + lag]
    norm = np.sqrt((x * x).sum() * (y * y).sum())
    return (x * y).sum() / norm if norm > 0 else None


def test_alignment(spark, tiny, episodes):
    frames = make_frames(spark, episodes + [(episodes[0][0][:5], episodes[0][1][:5])])  # the short one is left out
    corr = ins.alignment(frames, max_lag=12)
    got = {(r.pair, r.lag): r["corr"] for r in corr.collect()}
    assert len(got) == 2 * 25
    for (pair, lag), v in got.items():
        each = [correlation(np.diff(a[:, pair].astype(float)), np.diff(s[:, pair].astype(float)), lag) for a, s in episodes]
        each = [c for c in each if c is not None]
        assert v == pytest.approx(np.mean(each)), (pair, lag)
    peaks = ins.alignment_peaks(corr).first()
    assert peaks.max_peak_lag == 1 and peaks.pairs == 2


def test_movement_activity_velocity(spark, tiny, episodes):
    frames = make_frames(spark, episodes + [([[1, 1]], [[1, 1]])])
    moves = {r.episode_index: r.movement for r in ins.movement(frames).collect()}
    assert moves[3] == 0
    for e, (a, _) in enumerate(episodes):
        want = np.sqrt((np.diff(a.astype(float), axis=0) ** 2).sum(axis=1)).mean()
        assert moves[e] == pytest.approx(np.floor(want * 10000 + .5) / 10000)
    ranges = {r.dim: r for r in ins.motor_ranges(frames).collect()}
    assert ranges[1].discrete and not ranges[0].discrete
    per = {(r.episode_index, r.dim): r for r in ins.episode_deltas(frames).collect()}
    for e, (a, _) in enumerate(episodes):
        for d in range(2):
            size = np.sort(np.abs(np.diff(a[:, d].astype(float))))
            assert per[e, d].active == (size[int(len(size) * .95)] >= ranges[d].motor_range * .001)
    for r in ins.velocity(frames).collect():
        pool = np.concatenate([np.diff(a[:, r.dim].astype(float)) for e, (a, _) in enumerate(episodes) if per[e, r.dim].active])
        assert r["std"] == pytest.approx(pool.std() / r.motor_range) and r.max_abs == pytest.approx(np.abs(pool).max() / r.motor_range)
    report = {r.episode_index: r for r in ins.insight_report(frames).collect()}
    jerk = {r.episode_index: r.jerkiness for r in ins.jerkiness(frames).collect()}
    for e in range(4):
        assert report[e].movement == moves[e] and report[e].jerkiness == pytest.approx(jerk[e])
    assert report[3].length == 1 and report[3].active_dims == 0


def test_idle_motors_get_no_verdict(spark):
    still = make_frames(spark, [(np.ones((5, 1)), np.ones((5, 1)))])
    names = spark.createDataFrame([(0, "joint")], "dim int, name string")
    row = ins.velocity_verdict(ins.velocity(still), names).first()
    assert row.verdict == "N/A" and row.excluded == 1
    acf = ins.autocorrelation(still)
    assert all(r.acf == 0 for r in acf.collect())


def test_length_histogram_of_equal_episodes(spark):
    e = spark.createDataFrame([("d", i, 50) for i in range(4)], "dataset_id string, episode_index bigint, length bigint")
    rows = ins.length_histogram(e, 10.0).collect()
    assert [(r.bin, r.low, r.episodes) for r in rows] == [(0, 5.0, 4)]
    s = ins.length_summary(e, 10.0).first()
    assert (s["mean"], s["median"], s["std"]) == (5.0, 5.0, 0.0)


def charts(ranges):
    """Straightforward grouping of (suffix, [series], lo, hi) in declaration order."""
    groups, used = [], set()
    for name, members, lo, hi in ranges:
        if name in used:
            continue
        used.add(name)
        unit = [members]
        for other, more, olo, ohi in ranges:
            if other in used or olo == ohi:
                continue
            near = lambda a, b: abs(np.log10(abs(a) + 1e-9) - np.log10(abs(b) + 1e-9)) <= 2
            if near(lo, olo) and near(hi, ohi):
                unit.append(more)
                used.add(other)
        groups.append(unit)
    groups.sort(key=lambda g: -len(g))
    flat = [[s for m in g for s in m] for g in groups]
    return [names[i:i + 6] for names in flat for i in range(0, len(names), 6)]


def test_scale_groups(spark):
    spec = [("a | x", 1, 5), ("b | x", 2, 9), ("a | y", 1000, 2e6), ("a | z", 3, 3), ("a | w", 2, 70), ("solo", 5e5, 9e5), ("c | y", 1, 3e6)]
    spec += [(f"m | j{i}", 1 + i, 30 + i) for i in range(7)]
    rows = [(name, i, float(v)) for i, (name, lo, hi) in enumerate(spec) for v in (lo, hi)]
    got = ins.scale_groups(spark.createDataFrame(rows, "series string, ord int, value double")).orderBy("chart", "place").collect()
    suffixes = {}
    for name, lo, hi in spec:
        key = name.split(" | ")[-1]
        members, a, b = suffixes.get(key, ([], np.inf, -np.inf))
        suffixes[key] = (members + [name], min(a, lo), max(b, hi))
    want = charts([(k, *v) for k, v in suffixes.items()])
    found = {}
    for r in got:
        found.setdefault(r.chart, []).append(r.series)
    assert list(found.values()) == want


def test_gripper_without_travel(spark):
    frames = make_frames(spark, [([[50.0], [50.0]], [[50.0], [50.0]])])
    assert [r.opening for r in ins.gripper_opening(frames, "state", 0).collect()] == [pytest.approx(0.022)] * 2
    units = ins.joint_radians(make_frames(spark, [([[0]] * 3, [[2048.0], [180.0], [1.0]])])).orderBy("frame_index").collect()
    assert [u.unit for u in units] == ["ticks", "degrees", "radians"]
    assert units[0].radians[0] == 0 and units[1].radians[0] == pytest.approx(np.pi) and units[2].radians[0] == 1


def test_series_min_max_skips_infinities(spark):
    from episodica.operators.stats import column_min_max
    rows = [("p", v) for v in (1.23456789, 0.1, float("inf"), float("nan"))]
    row = column_min_max(spark.createDataFrame(rows, "series string, value double")).first()
    assert (row["min"], row["max"]) == (0.1, 1.235)


def test_motor_ranges_of_short_episodes_meet_by_rows(spark, monkeypatch):
    monkeypatch.setattr(ins, "RANGE_BLOCK", 8)
    nan = float("nan")
    few, many = [0.0, -0.0, 1.0, 2.0, 3.0, nan], [0.0, -0.0, 1.0, 2.0, 3.0, 4.0]
    for values, discrete in ((few[:5] * 4, True), ([nan, nan, nan, nan, nan, *few], False), (many * 3, False), ([7.0] * 9, True)):
        frames = make_frames(spark, [([[x]], [[x]]) for x in values])
        found = ins.motor_ranges(frames)
        row = found.first()
        assert row.discrete == discrete, values
        assert row.motor_range == pytest.approx(max(values) - min(values) or 1.0, nan_ok=True) or nan in values
    assert "hashpartitioning(dataset_id" not in found._jdf.queryExecution().executedPlan().toString()
    none = spark.createDataFrame([("d", 0, 0, [None, 1.0])], "dataset_id string, episode_index bigint, frame_index bigint, action array<double>")
    assert [(r.dim, r.motor_range, r.discrete) for r in ins.motor_ranges(none).collect()] == [(1, 1.0, True)]


def test_cross_variance_picks_frames_by_their_own_time(spark):
    rng = np.random.default_rng(5)
    lengths = [1, 1, 2, 3, 7, 49, 50, 51, 99, 100, 347]
    data = [rng.normal(size=(n, 2)) for n in lengths]
    frames = make_frames(spark, [(x, x) for x in data]).withColumn("action", F.col("action").cast("array<double>"))
    for bins in (50, 7, 2):
        found = ins.cross_variance(frames, bins=bins)
        got = {(r.bin, r.dim): r.variance for r in found.collect()}
        assert len(got) == 2 * bins
        for b in range(bins):
            at = [min(int(np.floor(b / float(bins - 1) * (n - 1) + .5)), n - 1) for n in lengths]
            want = np.var([x[i] for x, i in zip(data, at, strict=True)], axis=0)
            assert [got[b, d] for d in range(2)] == pytest.approx(want, abs=1e-6)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("= frame_index" in line or "(frame_index" in line for line in joins)
