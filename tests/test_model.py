"""The composed detector: saved, loaded, and equal to plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.operators.model import JointDetector, JointDetectorModel, ranked_windows, signal_scores
from fleetscope.operators.parameters import attention_output

NODES, WIDTH = 3, 4


def windows(spark, seed=2, per_client=30):
    rng = np.random.default_rng(seed)
    data = {c: rng.normal(size=(per_client, NODES, WIDTH)) + 2 * rng.integers(0, 2, (per_client, 1, 1)) for c in ("a", "b")}
    rows = [(c, i, x.tolist(), i >= 20, "kept") for c, xs in data.items() for i, x in enumerate(xs)]
    return data, spark.createDataFrame(rows, "robot string, win long, z array<array<double>>, calib boolean, m string")


def lloyd(flat, k, rounds):
    centres = flat[:k].copy()
    for _ in range(rounds):
        near = ((flat[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([flat[near == c].mean(0) for c in range(k) if (near == c).any()])
    return centres


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    data, df = windows(spark)
    model = JointDetector(client="robot", key="win", calibration="calib", prototypes=2, rounds=3, steps=3, neighbours=2).fit(df)
    path = "file://" + str(tmp_path_factory.mktemp("models") / "detector")
    model.save(path)
    return data, df, model, JointDetectorModel.load(path)


def test_reloaded_model_scores_alike(fitted):
    _, df, model, again = fitted
    assert again.uid == model.uid and again.getOrDefault("neighbours") == 2 and again.getOrDefault("nodes") == NODES
    columns = ["robot", "win", "calib", "m", "d_proto", "d_mahal", "device_score", "resid_struct", "z_node"]
    one, other = (sorted(m.transform(df).select(*columns).collect()) for m in (model, again))
    assert one == other and len(one) == 60


def test_signals_equal_numpy(fitted):
    data, df, _, model = fitted
    got = {(r.robot, r.win): r for r in model.transform(df).collect()}
    heads = {r.client: r.params for r in model.tables["attention"].collect()}
    net = model._head()
    for c, x in data.items():
        codes = lloyd(x[:20].reshape(20, -1), 2, 3).reshape(-1, NODES, WIDTH)
        per_node = ((x[:, None] - codes[None]) ** 2).sum(3)
        nearest = per_node.sum(2).argmin(1)
        d = per_node[np.arange(len(x)), nearest]
        calib = np.arange(len(x)) >= 20
        q = np.percentile(d[calib], [25, 50, 75], axis=0)
        z = (d - q[1]) / np.maximum(q[2] - q[0], 1e-8)
        whole = np.linalg.inv(np.cov(d[calib].T) + 0.01 * np.eye(NODES))
        gaps = (x - codes[nearest]).reshape(len(x), -1)
        residual = ((gaps.reshape(-1, NODES, WIDTH) - attention_output(net, gaps, net.unpack(np.array(heads[c])), 2)) ** 2).sum(2)
        for i in range(len(x)):
            r = got[c, i]
            assert r.m == nearest[i] and np.allclose(r.d_node, d[i]) and abs(r.d_proto - d[i].sum()) < 1e-9
            assert np.allclose(r.exemplar, per_node[i].min(0)) and np.allclose(r.z_node, z[i], atol=1e-6)
            own = calib & (nearest == nearest[i])
            n, rows = (own.sum(), d[own]) if own.sum() >= 5 else (calib.sum(), d[calib])
            precision = np.linalg.inv(np.cov(rows.T) + 0.01 * np.eye(NODES)) if own.sum() >= 5 else whole
            centred = d[i] - rows.mean(0)
            assert n >= 5 and abs(r.d_mahal - centred @ precision @ centred) < 1e-6
            assert np.allclose(r.resid_struct, residual[i], atol=1e-8)
            assert abs(r.device_score - d[i].mean() - residual[i].mean()) < 1e-8


def test_unknown_clients_and_null_vectors(fitted, spark):
    _, df, _, model = fitted
    more = df.unionByName(spark.createDataFrame([("c", 1, [[0.0] * WIDTH] * NODES, True, "x"), (None, 2, [[0.0] * WIDTH] * NODES, None, "x")], df.schema))
    assert model.transform(more).count() == 60
    assert JointDetector(client="robot", key="win").fit(more.where("robot = 'a'")).transform(more).count() == 30
    with pytest.raises(ValueError):
        JointDetector(client="robot", key="win").fit(df.limit(0))
    with pytest.raises(ValueError):
        JointDetectorModel({"other": df})


def test_reports_from_signals(fitted):
    _, df, model, _ = fitted
    scored = model.transform(df)
    scores = signal_scores(scored, ["robot", "win"])
    assert scores.count() == 180 and scores.where("signal = 'joint'").join(scored.select("robot", "win", "d_proto"), ["robot", "win"]).where(F.col("score") != F.col("d_proto")).count() == 0
    top = ranked_windows(scored, "robot", "win", k=3).collect()
    assert sorted((r.robot, r["rank"]) for r in top) == [(c, k) for c in "ab" for k in (1, 2, 3)]
