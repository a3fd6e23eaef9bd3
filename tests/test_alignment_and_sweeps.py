"""Blocked agreement, Adam refinement, kernel projection and refitted sweeps against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from fleetscope.operators import federation, projection, training
from fleetscope.operators.parameters import BETA1, BETA2, EPSILON, margin_prototypes
from fleetscope.plans import catalog
from fleetscope.plans.sweeps import ALPHAS, GRID
from fleetscope.operators.skew import dirichlet_budgets


def vectors(sf_dir):
    frame = pd.read_parquet(f"{sf_dir}/embeddings.parquet").sort_values("vec_id")
    frame["v"] = [np.asarray(v, float) for v in frame["embedding"]]
    frame["client"] = frame["vec_id"] % 4
    return frame


def first_prototypes(sf_dir):
    return vectors(sf_dir).groupby("client").head(4)


@pytest.mark.parametrize("block", [2, 5, 256])
@pytest.mark.parametrize("metric", ["cosine", "l2", "mahalanobis"])
def test_blocked_agreement_equals_numpy(spark, metric, block):
    rng = np.random.default_rng(1)
    protos = {g: (("x", "y", "z")[g % 3], rng.normal(size=(3, 4)) + g % 2) for g in (3, 1, 8, 20, 11, 7, 30)}
    rows = [(g, c, n, v.tolist()) for g, (c, z) in protos.items() for n, v in enumerate(z)]
    df = spark.createDataFrame(rows, "gid long, client string, node long, vec array<double>")
    flat = np.concatenate([z for _, z in protos.values()])
    precision = np.linalg.inv(np.cov(flat.T) + 1e-2 * np.eye(4))

    def similar(x, y):
        if metric == "cosine":
            return np.mean([a @ b / np.linalg.norm(a) / np.linalg.norm(b) for a, b in zip(x, y, strict=True)])
        m = precision if metric == "mahalanobis" else np.eye(4)
        return -np.mean([(a - b) @ m @ (a - b) for a, b in zip(x, y, strict=True)])

    expected = {(a, b): similar(protos[a][1], protos[b][1]) for a in protos for b in protos if a < b and protos[a][0] != protos[b][0]}
    got = federation.blocked_agreement(df, metric, block=block).collect()
    assert {(r.a, r.b) for r in got} == set(expected) and len(got) == len(expected)
    assert all(abs(r.sim - expected[r.a, r.b]) < 1e-9 and (r.client_a, r.client_b) == (protos[r.a][0], protos[r.b][0]) for r in got)
    cut = float(np.median(list(expected.values()))) + 1e-6
    above = federation.blocked_agreement(df, metric, delta=cut, block=block).collect()
    assert {(r.a, r.b) for r in above} == {k for k, v in expected.items() if v > cut}


def test_agreement_of_nothing(spark):
    empty = spark.createDataFrame([], "gid long, client string, node long, vec array<double>")
    for metric in ("cosine", "mahalanobis"):
        assert federation.blocked_agreement(empty, metric).count() == 0
    with pytest.raises(ValueError):
        federation.blocked_agreement(empty, "other")


def test_mahalanobis_query(spark, sf_dir):
    protos = first_prototypes(sf_dir)
    flat = np.stack(protos["v"]).reshape(-1, 8)
    precision = np.linalg.inv(np.cov(flat.T) + 1e-2 * np.eye(8))
    by_id = {i: (c, v.reshape(8, 8)) for i, c, v in zip(protos["vec_id"], protos["client"], protos["v"], strict=True)}
    got = catalog.QUERIES["fed03_mahalanobis_agreement"](spark, sf_dir).collect()
    assert len(got) == 16 * 12 // 2
    for r in got:
        gap = by_id[r.a][1] - by_id[r.b][1]
        assert abs(r.sim + np.einsum("nd,de,ne->n", gap, precision, gap).mean()) < 2e-6 and by_id[r.a][0] != by_id[r.b][0]


def refined(codes, labels, x, y, margin, steps, rate):
    """The margin loss in plain loops, and Adam on its mean."""
    codes, m, v = codes.copy(), 0.0, 0.0
    for step in range(1, steps + 1):
        grad = np.zeros_like(codes)
        for z, label in zip(x, y, strict=True):
            s = [z @ c / np.linalg.norm(z) / np.linalg.norm(c) for c in codes]
            own, other = [i for i in range(len(codes)) if labels[i] == label], [i for i in range(len(codes)) if labels[i] != label]
            if not own or not other:
                continue
            a, b = max(own, key=lambda i: s[i]), max(other, key=lambda i: s[i])
            if margin - (s[a] - s[b]) > 0:
                for i, sign in ((a, -1), (b, 1)):
                    n = np.linalg.norm(codes[i])
                    grad[i] += sign * (z / np.linalg.norm(z) / n - s[i] * codes[i] / n**2)
        grad /= len(x)
        m, v = BETA1 * m + (1 - BETA1) * grad, BETA2 * v + (1 - BETA2) * grad**2
        codes = codes - rate * (m / (1 - BETA1**step)) / (np.sqrt(v / (1 - BETA2**step)) + EPSILON)
    return codes


def test_adam_refinement_over_the_table(spark, sf_dir):
    frame, protos = vectors(sf_dir), first_prototypes(sf_dir)
    got = {(r.client, r.pid): (r.label, r.vec) for r in catalog.QUERIES["fed18_adam_refinement"](spark, sf_dir).collect()}
    assert len(got) == 16
    for c in range(4):
        p, rows = protos[protos["client"] == c], frame[frame["client"] == c]
        expected = refined(np.stack(p["v"]), p["label"].to_numpy(), np.stack(rows["v"]), rows["label"].to_numpy(), 0.1, 12, 1e-3)
        for i, label, code in zip(p["vec_id"], p["label"], expected, strict=True):
            assert got[c, i][0] == label and np.allclose(got[c, i][1], code, atol=2e-8)


def test_refinement_with_unequal_banks(spark):
    rng = np.random.default_rng(4)
    rows = [(c, int(i % 3), rng.normal(size=3).tolist()) for c in ("a", "b", "idle") for i in range(8) if c != "idle"]
    banks = {"a": [(1, 0), (2, 1), (5, 2)], "b": [(7, 0), (3, 1)], "idle": [(9, 1)]}
    protos = [(c, pid, label, rng.normal(size=3).tolist()) for c, found in banks.items() for pid, label in found]
    got = training.refine_with_adam(
        spark.createDataFrame(rows, "client string, label int, vec array<double>"), spark.createDataFrame(protos, "client string, pid long, label int, vec array<double>"), "client", 0.3, 50, 0.01
    ).collect()
    assert len(got) == 6
    for c in banks:
        own = sorted(p for p in protos if p[0] == c)
        x, y = [np.array(r[2]) for r in rows if r[0] == c], [r[1] for r in rows if r[0] == c]
        start = np.array([p[3] for p in own])
        expected = refined(start, [p[2] for p in own], x, y, 0.3, 50, 0.01) if x else start
        for p, code in zip(own, expected, strict=True):
            r = next(r for r in got if (r.client, r.pid) == (c, p[1]))
            assert r.label == p[2] and np.allclose(r.vec, code, atol=1e-8)


def test_margin_gradient():
    rng = np.random.default_rng(5)
    net = margin_prototypes(5, 3, 0.5)
    rows = np.hstack([rng.normal(size=(9, 3)), rng.integers(0, 3, (9, 1))])
    flat = np.concatenate([rng.normal(size=15), [0, 1, 2, 0, np.nan]])
    grad = net.pack(net.gradient(rows, net.unpack(flat))[1])
    for i in range(15):
        step = np.zeros(20)
        step[i] = 1e-6
        slope = (net.gradient(rows, net.unpack(flat + step))[0] - net.gradient(rows, net.unpack(flat - step))[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-5
    assert not grad[12:15].any()  # the prototype that is not there


def test_kernel_projection_is_close_to_exact_kernel_pca(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(3, 5)) * 2
    x = np.concatenate([c + 0.5 * rng.normal(size=(60, 5)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, x array<double>").repartition(3)
    fitted = projection.fit_kernel_projection(df, features=1024, gamma=0.2)
    got = {r.id: r.axes for r in projection.projected(df, fitted).collect()}
    assert got.pop(999) is None
    approximate = np.array([got[i] for i in range(len(x))])
    kernel = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(2))
    centred = kernel - kernel.mean(0) - kernel.mean(1)[:, None] + kernel.mean()
    values, axes = np.linalg.eigh(centred)
    exact = axes[:, -2:]
    q, _ = np.linalg.qr(approximate)
    assert np.linalg.svd(exact.T @ q)[1].min() > 0.98  # cosine of the largest angle between the two planes
    assert np.allclose(fitted.explained, values[::-1][:2] / values.sum(), atol=0.03)


def test_kernel_projection_query_and_limits(spark, sf_dir):
    rows = catalog.QUERIES["plt01_kernel_projection"](spark, sf_dir).collect()
    assert len(rows) == len(vectors(sf_dir)) and all(r.first is not None and r.second is not None for r in rows)
    empty = spark.createDataFrame([], "x array<double>")
    for features in (16, 10**6):
        with pytest.raises(ValueError):
            projection.fit_kernel_projection(empty, features=features)


def single_run(spark, frame, k):
    """AUROC of the distance to the nearest of ``k`` centres, by the plain operators."""
    rows = spark.createDataFrame([(int(c), int(i), v.tolist(), int(b)) for c, i, v, b in zip(frame["client"], frame["vec_id"], frame["v"], frame["label"], strict=True)], "group long, key long, vec array<double>, label int")
    centres = training.kmeans(rows, k, rounds=3).collect()
    out = {}
    for c, g in frame.groupby("client"):
        codes = np.array([r.vec for r in centres if r.group == c])
        score = np.round((((np.stack(g["v"])[:, None] - codes[None]) ** 2).sum(2)).min(1), 6)
        bad = (g["label"] < 3).to_numpy()
        pairs = [(p > n) + 0.5 * (p == n) for p in score[bad] for n in score[~bad]]
        out[c] = (len(g), float(np.mean(pairs)) if pairs else None)
    return out


def assert_cells(got, expected):
    assert set(got) == set(expected)
    for key, (n, auroc) in expected.items():
        assert got[key][0] == n and (got[key][1] is None) == (auroc is None) and (auroc is None or abs(got[key][1] - auroc) < 2e-6)


def test_sweep_over_sizes_equals_single_runs(spark, sf_dir):
    got = {(r.prototypes, r.client): (r.n, r.auroc) for r in catalog.QUERIES["rpt03_refitted_sweep"](spark, sf_dir).collect()}
    assert_cells(got, {(k, c): cell for k in GRID for c, cell in single_run(spark, vectors(sf_dir), k).items()})


def test_sweep_over_skews_equals_single_runs(spark, sf_dir):
    frame = vectors(sf_dir)
    got = {(r.alpha, r.client): (r.n, r.auroc) for r in catalog.QUERIES["rpt03_skew_sweep"](spark, sf_dir).collect()}
    expected = {}
    for alpha in ALPHAS:
        budgets = dirichlet_budgets(range(4), len(frame), alpha, least=20, seed=42)
        slices = pd.concat([g.head(budgets[c]) for c, g in frame.groupby("client")])
        expected |= {(alpha, c): cell for c, cell in single_run(spark, slices, 4).items()}
    assert_cells(got, expected)
