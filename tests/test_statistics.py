import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import ranks, stats
from tests.conftest import make_frames


def vectors(spark, rows, episode=None):
    data = [("d", int(episode[i]) if episode is not None else 0, i, [float(x) for x in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, "dataset_id string, episode_index bigint, frame_index bigint, signal array<double>")


def expected(values):
    q = np.quantile(values, list(stats.QUANTILES.values()))
    return dict(min=values.min(), max=values.max(), mean=values.mean(), std=values.std(), count=len(values), **dict(zip(stats.QUANTILES, q)))


def check(row, want, rel=1e-12):
    for name, value in want.items():
        assert row[name] == pytest.approx(value, rel=rel, abs=1e-12), name


def test_small_example(spark):
    v = np.array([1, 2, 10, 20, 30, 40, 50.0])
    rows = stats.feature_stats(vectors(spark, np.c_[v, -v]), ["signal"]).collect()
    assert len(rows) == 2
    for row in rows:
        check(row, expected(v if row.dim == 0 else -v))


@pytest.mark.parametrize("values", [1e12 + np.array([0, .25, .5, .75]), 1e6 + np.array([0, .125, .25, .375])])
def test_variance_is_stable_far_from_zero(spark, values):
    frames = vectors(spark, values[:, None])
    row = stats.feature_stats(frames, ["signal"]).first()
    assert row["std"] == pytest.approx((values - values[0]).std(), rel=1e-9)
    per = stats.feature_stats_by_episode(frames, ["signal"]).first()
    assert per["std"] == pytest.approx((values - values[0]).std(), rel=1e-9)


def test_by_episode_with_tiny_blocks(spark, tiny):
    rng = np.random.default_rng(7)
    episode = np.sort(rng.integers(0, 5, 120))
    values = rng.normal(size=(120, 2)) * [1, 1000]
    place = np.concatenate([np.arange((episode == e).sum()) for e in range(5)])
    data = [("d", int(e), int(p), [float(x) for x in row]) for e, p, row in zip(episode, place, values)]
    frames = spark.createDataFrame(data, "dataset_id string, episode_index bigint, frame_index bigint, signal array<double>")
    rows = stats.feature_stats_by_episode(frames, ["signal"]).collect()
    assert len(rows) == 10
    for row in rows:
        check(row, expected(values[episode == row.episode_index, row.dim]), rel=1e-9)
    merged = stats.combine(stats.feature_stats_by_episode(frames, ["signal"])).collect()
    for row in merged:
        whole = values[:, row.dim]
        assert row["mean"] == pytest.approx(whole.mean()) and row["std"] == pytest.approx(whole.std()) and row["count"] == 120


@pytest.mark.parametrize("octave, split", [(1, 2), (256, 1 << 16)])
def test_selection_with_hot_group_and_hot_value(spark, monkeypatch, octave, split):
    monkeypatch.setattr(ranks, "OCTAVE", octave)
    monkeypatch.setattr(ranks, "SPLIT", split)
    rng = np.random.default_rng(3)
    hot = np.concatenate([np.full(400, 2.5), rng.exponential(5, 500), [1e9, -1e9]])
    cold = rng.normal(size=6)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("cold", None), ("cold", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r for r in ranks.quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.99}).collect()}
    for name, values in (("hot", hot), ("cold", cold)):
        assert got[name].n == len(values)
        assert [got[name].a, got[name].b, got[name].c] == pytest.approx(list(np.quantile(values, [0.01, 0.5, 0.99])))
    whole = np.concatenate([hot, cold])
    every = ranks.quantiles(df, [], "v", {"q": 0.37}).first()
    assert every.q == pytest.approx(np.quantile(whole, 0.37))


def test_weighted_quantiles(spark):
    rng = np.random.default_rng(5)
    v, w = rng.integers(0, 20, 60).astype(float), rng.integers(1, 9, 60)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, w)], "v double, w int")
    whole = np.repeat(v, w)
    row = ranks.quantiles(df, [], "v", {"q": 0.31, "m": 0.5}, weight="w").first()
    assert (row.n, row.q, row.m) == (len(whole), pytest.approx(np.quantile(whole, .31)), pytest.approx(np.quantile(whole, .5)))


def test_histogram_rules(spark):
    levels = np.array([0, 0, 3, 3, 3, 10, 255, 255])
    df = spark.createDataFrame([("r", int(x), 1) for x in levels], "c string, level int, n int")
    row = stats.histogram_stats(df, ["c"]).first()
    assert row["mean"] == pytest.approx(levels.mean() / 255) and row["std"] == pytest.approx(levels.std() / 255)
    assert row["q90"] == pytest.approx(np.quantile(levels, .9) / 255)
    near = stats.histogram_stats(df, ["c"], rule="nearest").first()
    assert near["q50"] == pytest.approx(3 / 255)


def test_bad_rows_are_located(spark):
    frames = make_frames(spark, [([[1, 2], [3, 4]], [[1, 2], [3, float("nan")]])])
    bad = stats.shape_violations(frames, {"action": 2, "state": 2}).collect()
    assert [(b.frame_index, b.feature) for b in bad] == [(1, "state")]
    with pytest.raises(ValueError, match="state is invalid in 1 frames, first in episode 0, frame 1"):
        stats.feature_stats(frames, ["action", "state"], shapes={"action": [2], "state": [2]})
    with pytest.raises(ValueError, match="action is invalid in 2 frames"):
        stats.feature_stats_by_episode(frames, ["action"], shapes={"action": [3]})
    with pytest.raises(ValueError, match="action has 2 frames instead of 3"):
        stats.feature_stats(frames, ["action"], shapes={"action": [2]}, total=3)


MIXED = ("dataset_id string, episode_index bigint, frame_index bigint, timestamp float, done boolean, count smallint, big bigint, "
         "pair array<float>, image array<array<array<double>>>")


def mixed_frames(spark, rng, n=40):
    rows = [("d", k // 25, k % 25, k / 10, bool(k % 3), k - 20, (1 << 40) + k, [float(x) for x in rng.normal(size=2)],
             [[[float(x) for x in rng.normal(size=2)] for _ in range(3)] for _ in range(2)]) for k in range(n)]
    return spark.createDataFrame(rows, MIXED), rows


def test_every_kind_of_feature_at_both_grains(spark):
    frames, rows = mixed_frames(spark, np.random.default_rng(9))
    shapes = {"timestamp": [1], "done": [1], "count": [1], "big": [1], "pair": [2], "image": [2, 3, 2]}
    whole, per = stats.stats_of_both_grains(frames, list(shapes), shapes, 40)
    columns = {name: np.array([np.ravel(np.asarray(r[3 + i], np.float32 if name in ("timestamp", "pair") else float)) for r in rows], float) for i, name in enumerate(shapes)}
    episode = np.array([r[1] for r in rows])
    got = whole.collect()
    assert len(got) == sum(c.shape[1] for c in columns.values())
    for row in got:
        check(row, expected(columns[row.feature][:, row.dim]), rel=1e-9)
    got = per.collect()
    assert len(got) == 2 * sum(c.shape[1] for c in columns.values())
    for row in got:
        check(row, expected(columns[row.feature][episode == row.episode_index, row.dim]), rel=1e-9)


def test_declared_types_and_shapes(spark):
    frames, _ = mixed_frames(spark, np.random.default_rng(1), 3)
    def declared(*rows):
        return spark.createDataFrame(list(rows), "feature string, dtype string, shape array<int>")
    good = declared(("done", "bool", [1]), ("image", "float64", [2, 3, 2]), ("camera", "video", [3]), ("big", "int64", [1]))
    assert stats.declared_shapes(good, frames) == {"done": [1], "image": [2, 3, 2], "big": [1]}
    for bad, message in ((("big", "int32", [1]), "stored as bigint"), (("pair", "float32", [0]), "no valid shape"), (("lost", "float32", [1]), "no column"), (("pair", "complex64", [2]), "unsupported")):
        with pytest.raises(ValueError, match=message):
            stats.declared_shapes(declared(bad), frames)
    with pytest.raises(TypeError, match="not numeric"):
        stats.feature_stats(frames, ["dataset_id"])


def test_numeric_features(spark):
    rows = [("a", "float32", [2, 3]), ("s", "string", [1]), ("t", "str", [1]), ("z", "int64", [0])]
    got = stats.numeric_features(spark.createDataFrame(rows, "feature string, dtype string, shape array<int>")).collect()
    assert [(r.feature, r.width) for r in got] == [("a", 6)]


def test_dual_grain(spark):
    rows = [("d", 0, 5, "r", 1, 1), ("d", 1, 5, "r", 1, 1), ("d", 1, 6, "r", 2, 1)]
    df = spark.createDataFrame(rows, "dataset_id string, episode_index bigint, frame int, channel string, level int, n int")
    glob, episode = stats.dual_grain_histograms(df, ["frame"], ["channel"])
    assert glob.agg(F.sum("n")).first()[0] == 2 and episode.agg(F.sum("n")).first()[0] == 3


@pytest.mark.parametrize("values", [
    [float("-inf"), -1.7e308, -1.0, 0.0, 5e-324, 1e-300, 2.0, 1.7e308, float("inf"), float("inf")],
    [10.0 ** k for k in range(-300, 300, 25)], [3.5] * 9, [-4.0, -4.0, -1e-8, -0.0, 0.0, 7.0, 7.5, 7.25, 1e200]])
def test_ranks_of_any_double(spark, tiny, values):
    from episodica.operators import ranks
    rows = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    wanted = list(range(len(values)))
    got = {r["rank"]: r.kth for r in ranks.kth_values(rows, ["g"], "v", lambda n: F.array(*[F.lit(k) for k in wanted])).collect()}
    assert [got[k] for k in wanted] == sorted(values)
