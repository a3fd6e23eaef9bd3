"""Queries that SQL cannot express, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.plans import catalog
from fleetscope.plans.views import embedded, prototypes


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    rows = embedded(spark, sf_dir).orderBy("vec_id").collect()
    return {name: np.array([r[name] for r in rows]) for name in ("vec_id", "client", "label", "v")}


@pytest.fixture(scope="module")
def codes(spark, sf_dir):
    found: dict = {}
    for r in prototypes(spark, sf_dir).orderBy("client", "m").collect():
        found.setdefault(r.client, []).append(np.array(r.z))
    return {c: np.array(z) for c, z in found.items()}


def run(spark, sf_dir, name):
    return catalog.QUERIES[name](spark, sf_dir).collect()


def test_full_rank_distance(spark, sf_dir, data, codes):
    d_node, m = {}, {}
    for i, c, v in zip(data["vec_id"], data["client"], data["v"], strict=True):
        gaps = ((codes[c] - v.reshape(8, 8)) ** 2).sum(-1)
        m[i] = int(gaps.sum(-1).argmin())
        d_node[i] = gaps[m[i]]
    client = dict(zip(data["vec_id"], data["client"], strict=True))

    def stats(ids):
        x = np.array([d_node[i] for i in ids])
        return x.mean(0), np.linalg.inv((np.cov(x.T) if len(x) > 1 else np.zeros((8, 8))) + 0.01 * np.eye(8))

    groups = {}
    for i in m:
        groups.setdefault((client[i], m[i]), []).append(i)
    for r in run(spark, sf_dir, "cov02_full_rank"):
        own = groups[r.client, r.m]
        mu, precision = stats(own if len(own) >= 9 else [i for i in m if client[i] == r.client])
        gap = d_node[r.vec_id] - mu
        assert r.m == m[r.vec_id]
        assert np.isclose(r.d_mahal, gap @ precision @ gap, rtol=1e-6)
        assert np.allclose(r.h_node, gap * (precision @ gap), rtol=1e-5, atol=1e-7)


def test_class_kmeans(spark, sf_dir, data):
    got = {(r.group, r.c): (r.n, np.array(r.vec)) for r in run(spark, sf_dir, "fed17_class_kmeans")}
    want = {}
    for label in np.unique(data["label"]):
        x = data["v"][data["label"] == label]
        centres = {c: x[c] for c in range(min(3, len(x)))}
        for _ in range(4):
            near = np.array([min(centres, key=lambda c: (((row - centres[c]) ** 2).sum(), c)) for row in x])  # noqa: B023
            centres = {int(c): x[near == c].mean(0) for c in np.unique(near)}
        want |= {(label, c): ((near == c).sum(), v) for c, v in centres.items()}
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and np.allclose(got[k][1], want[k][1]) for k in want)


def test_margin_refinement(spark, sf_dir, data):
    start = prototypes(spark, sf_dir).select(F.col("gid").alias("pid"), "label", F.flatten("z").alias("vec")).collect()
    bank = {r.pid: (r.label, np.array(r.vec)) for r in start}
    cosine = lambda a, b: round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 12)
    for _ in range(3):
        moves: dict = {}
        for x, label in zip(data["v"], data["label"], strict=True):
            best = {}
            for own in (True, False):
                near = [(cosine(x, v), -p) for p, (other, v) in bank.items() if (other == label) == own]
                best[own] = max(near) if near else None
            if best[True] and best[False] and best[True][0] - best[False][0] < 0.2:
                moves.setdefault(-best[True][1], []).append(x)
                moves.setdefault(-best[False][1], []).append(-x)
        bank = {p: (label, v + 0.1 * np.mean(moves[p], axis=0) if p in moves else v) for p, (label, v) in bank.items()}
    got = {r.pid: np.array(r.vec) for r in run(spark, sf_dir, "fed18_margin_refinement")}
    assert set(got) == set(bank) and all(np.allclose(got[p], bank[p][1], atol=1e-9) for p in bank)


def test_ridge_forecast(spark, sf_dir, data):
    z = data["v"].reshape(-1, 8, 8)
    x, y = z[:, :, :7].mean(-1), z[:, :, 7]
    for r in run(spark, sf_dir, "fcs01_ridge_forecast"):
        mine = data["client"] == r.client
        other = [k for k in range(8) if k != r.node]
        a = x[mine][:, other]
        want = np.zeros(8)
        want[other] = np.linalg.solve(a.T @ a + 0.01 * np.eye(7), a.T @ y[mine][:, r.node])
        assert r.n == mine.sum() and np.allclose(r.weights, want, atol=1e-8)


def test_explained_variance(spark, sf_dir, data):
    values = np.sort(np.linalg.eigvalsh(np.cov(data["v"].T)))[::-1]
    got = {r.component: r.share for r in run(spark, sf_dir, "plt01_explained_variance")}
    assert np.allclose([got[0], got[1]], values[:2] / values.sum(), atol=1e-9)


def test_capacity_clusters(spark, sf_dir, codes):
    rows = prototypes(spark, sf_dir).orderBy("gid").collect()
    ids, clients, x = [r.gid for r in rows], [r.client for r in rows], np.array([np.array(r.z).ravel() for r in rows])
    room, centres, label = -(-len(x) // 4), x[np.linspace(0, len(x) - 1, 4).astype(int)], None
    for _ in range(10):
        nearest = sorted((((x[i] - centres[c]) ** 2).sum(), i, c) for i in range(len(x)) for c in range(4))
        new: dict = {}
        for _, i, c in nearest:
            if i not in new and list(new.values()).count(c) < room:
                new[i] = c
        if new == label:
            break
        label = new
        centres = np.array([np.mean([x[i] for i in label if label[i] == c], axis=0) if c in label.values() else centres[c] for c in range(4)])
    want = {ids[i]: c if len({clients[j] for j in label if label[j] == c}) > 1 else -1 for i, c in label.items()}
    assert {r.gid: r.cluster for r in run(spark, sf_dir, "fed10_capacity_clusters")} == want
