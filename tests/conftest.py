import pytest

from episodica.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        # tiny inputs: compiling code would take longer than running the plans
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny(monkeypatch):
    """Small blocks and limits, so that every two-level step crosses block borders on small fixtures."""
    from episodica.operators import insights, ranks, series, validate
    monkeypatch.setattr(series, "BLOCK", 4)
    monkeypatch.setattr(insights, "LAG_BLOCK", 8)
    monkeypatch.setattr(ranks, "OCTAVE", 1)
    monkeypatch.setattr(ranks, "SPLIT", 4)
    monkeypatch.setattr(validate, "POSITION_BLOCK", 3)


FRAME_TYPE = ("dataset_id string, episode_index bigint, frame_index bigint, index bigint, task_index bigint, timestamp double, "
              "action array<float>, state array<float>")


def make_frames(spark, episodes, fps=10.0, dataset="d"):
    """``episodes``: list of (action rows, state rows)."""
    rows, at = [], 0
    for e, (action, state) in enumerate(episodes):
        for i, (a, s) in enumerate(zip(action, state)):
            rows.append((dataset, e, i, at, 0, i / fps, [float(x) for x in a], [float(x) for x in s]))
            at += 1
    return spark.createDataFrame(rows, FRAME_TYPE)
