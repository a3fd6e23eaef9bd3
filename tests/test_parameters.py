"""Parameter tables against plain numpy: gradients, steps, clustered rounds."""

import numpy as np
import pytest

from fleetscope.operators import parameters
from fleetscope.operators.parameters import (
    BETA1, BETA2, EPSILON, ClusteredRounds, applied, attention_output, autoencoder, encoded, federated_rounds, graph_attention, parameter_table, row_blocks, trained,
)

PRIOR = np.eye(4)[[1, 2, 3, 0]]


@pytest.mark.parametrize("net,width", [(autoencoder(5, 2), 5), (graph_attention(4, 3, 2, 3, PRIOR), 20), (graph_attention(4, 3, 3, 2), 24)])
def test_gradients_equal_finite_differences(net, width):
    rng = np.random.default_rng(3)
    rows, flat = rng.normal(size=(6, width)), rng.normal(size=net.size)
    _, grad = net.gradient(rows, net.unpack(flat))
    packed = net.pack(grad)
    for i in range(net.size):
        step = np.zeros(net.size)
        step[i] = 1e-6
        slope = (net.gradient(rows, net.unpack(flat + step))[0] - net.gradient(rows, net.unpack(flat - step))[0]) / 2e-6
        assert abs(slope - packed[i]) <= 1e-4 * max(1, abs(slope)), (i, slope, packed[i])


def client_rows(spark, sizes, width, seed=1, shift=0.0):
    rng = np.random.default_rng(seed)
    data = {c: rng.normal(size=(n, width)) + shift * (c % 2) for c, n in sizes.items()}
    rows = [(c, x.tolist()) for c, xs in data.items() for x in xs]
    return data, spark.createDataFrame(rows, "client long, x array<double>").repartition(3)


@pytest.mark.parametrize("adam", [False, True])
def test_steps_equal_numpy(spark, monkeypatch, adam):
    monkeypatch.setattr(parameters, "BLOCK", 7)
    net = autoencoder(4, 2)
    data, rows = client_rows(spark, {0: 30, 5: 11}, 4)
    blocks = row_blocks(rows, "client")
    steps = 50 if adam else 3
    if adam:  # few rows and one owner keep the fifty steps short
        blocks = blocks.where("owner = 5").coalesce(1)
    final, history = trained(blocks, parameter_table(blocks, net), net, steps, 0.05, adam)
    losses = {(r.owner, r.step): r.loss for r in history.collect()}
    for r in final.collect():
        flat, m, v = net.start(), np.zeros(net.size), np.zeros(net.size)
        x = data[r.owner]
        for step in range(steps):
            loss, grad = net.gradient(x, net.unpack(flat))
            assert abs(losses[r.owner, step] - loss / (len(x) * net.scale)) < 1e-9
            g = net.pack(grad) / (len(x) * net.scale)
            if adam:
                m, v = BETA1 * m + (1 - BETA1) * g, BETA2 * v + (1 - BETA2) * g * g
                flat = flat - 0.05 * (m / (1 - BETA1 ** (step + 1))) / (np.sqrt(v / (1 - BETA2 ** (step + 1))) + EPSILON)
            else:
                flat = flat - 0.05 * g
        assert np.allclose(r.params, flat, atol=1e-8)
        assert losses[r.owner, steps - 1] < losses[r.owner, 0]


def test_encoding_and_attention_of_stored_parameters(spark):
    net = autoencoder(4, 2)
    data, rows = client_rows(spark, {0: 9, 1: 4}, 4)
    params = parameter_table(row_blocks(rows, "client"), net)
    got = applied(rows, params, "client", "x", "z", lambda x, flat: encoded(x, net.unpack(flat))).collect()
    assert len(got) == 13
    for r in got:
        assert np.allclose(r.z, encoded(np.array([r.x]), net.unpack(net.start()))[0])
    heads = graph_attention(4, 3, 2, 3, PRIOR)
    x = np.random.default_rng(2).normal(size=(5, 12))
    p = heads.unpack(heads.start())
    out = attention_output(heads, x, p, 3, PRIOR)
    assert out.shape == (5, 4, 2)
    assert abs(heads.gradient(np.hstack([x, np.zeros((5, 8))]), p)[0] - (out**2).sum()) < 1e-9


def noisy(net, flat, spread, seeds):
    rng = np.random.default_rng(seeds)
    return net.pack({n: v + rng.normal(size=v.shape) * spread * v.std() for n, v in net.unpack(flat).items()})


def reference_rounds(data, plan):
    """Clustered rounds in plain loops."""
    net, warm = plan.net, max(1, round(plan.warm_up * plan.rounds))
    replicas, unused, history, respawned = [net.start(plan.seed)], [0], [], 0
    for number in range(1, plan.rounds + 1):
        results = {}
        for c in sorted(data):
            x = data[c]
            losses = [net.gradient(x, net.unpack(r))[0] / (len(x) * net.scale) for r in replicas]
            taken = 0 if number <= warm else int(np.argmin(losses))
            flat = replicas[taken]
            for _ in range(plan.local_steps):
                flat = flat - plan.rate * net.pack(net.gradient(x, net.unpack(flat))[1]) / (len(x) * net.scale)
            results.setdefault(taken, []).append((flat, len(x), c))
            history.append((c, number, taken, None if number <= warm else losses[taken]))
        for k, members in results.items():
            replicas[k] = np.average([m[0] for m in members], axis=0, weights=[m[1] for m in members])
        unused = [0 if k in results else u + 1 for k, u in enumerate(unused)]
        if number == warm:
            replicas += [noisy(net, replicas[0], plan.spread, [plan.seed, number, k]) for k in range(1, plan.replicas)]
            unused = [0] * plan.replicas
        elif number > warm:
            busiest = min(results, key=lambda k: (-len(results[k]), results[k][0][2]))
            base = replicas[busiest]
            for k in range(plan.replicas):
                if unused[k] >= plan.patience:
                    replicas[k], unused[k], respawned = noisy(net, base, plan.spread, [plan.seed, number, k]), 0, respawned + 1
    return history, replicas, respawned


def test_clustered_rounds_equal_numpy_with_a_respawn(spark, monkeypatch):
    monkeypatch.setattr(parameters, "BLOCK", 8)
    plan = ClusteredRounds(autoencoder(4, 2), replicas=3, rounds=5, rate=0.2, local_steps=2, warm_up=0.34, patience=1, spread=1.0)
    data, rows = client_rows(spark, {0: 20, 1: 12, 2: 9, 3: 15}, 4, shift=3.0)
    expected, replicas, respawned = reference_rounds(data, plan)
    assert respawned
    history, final = plan.run(row_blocks(rows, "client"))
    got = {(r.owner, r.round): r for r in history.collect()}
    assert len(got) == len(expected)
    for owner, number, taken, loss in expected:
        r = got[owner, number]
        assert (r.replica, r.n, r.warm_up) == (taken, len(data[owner]), number <= 2)
        assert (r.loss is None) == (loss is None) and (loss is None or abs(r.loss - loss) < 1e-9)
        assert r.bytes_up == 8 * plan.net.size and r.bytes_down == 8 * plan.net.size * (1 if r.warm_up else 3)
    for r in final.collect():
        assert np.allclose(r.params, replicas[r.replica], atol=1e-9)


def test_replicas_must_fit_beside_the_rows(spark, monkeypatch):
    monkeypatch.setattr(parameters, "MOST_BYTES", 100)
    _, rows = client_rows(spark, {0: 3}, 4)
    with pytest.raises(ValueError):
        ClusteredRounds(autoencoder(4, 2), replicas=3, rounds=3).run(row_blocks(rows, "client"))


def test_blocks_keep_owners_apart_and_drop_null_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("a", [5.0, 6.0]), ("a", None)], "client string, x array<double>").coalesce(1)
    got = {r.owner: (r.n, r.x) for r in row_blocks(df, "client").collect()}
    assert got == {"a": (2, [1.0, 2.0, 5.0, 6.0]), "b": (1, [3.0, 4.0])}


@pytest.mark.parametrize("shared", [None, ["w1", "b1", "w2", "b2"]])
def test_federated_rounds_equal_numpy(spark, shared):
    net = autoencoder(4, 2)
    data, rows = client_rows(spark, {0: 20, 1: 7, 2: 13}, 4, shift=2.0)
    final, history = federated_rounds(row_blocks(rows, "client"), net, rounds=3, local_steps=2, rate=0.1, shared=shared)
    flats, losses = dict.fromkeys(data, net.start()), {}
    for number in range(3):
        for c, x in data.items():
            for step in range(2):
                loss, grad = net.gradient(x, net.unpack(flats[c]))
                losses[c, number, step] = loss / (len(x) * net.scale)
                flats[c] = flats[c] - 0.1 * net.pack(grad) / (len(x) * net.scale)
        mean = net.unpack(np.average([flats[c] for c in data], axis=0, weights=[len(data[c]) for c in data]))
        flats = {c: net.pack({n: mean[n] if shared is None or n in shared else own for n, own in net.unpack(flat).items()}) for c, flat in flats.items()}
    got = {(r.owner, r.round, r.step): r.loss for r in history.collect()}
    assert set(got) == set(losses) and all(abs(got[k] - v) < 1e-9 for k, v in losses.items())
    assert all(np.allclose(r.params, flats[r.owner], atol=1e-9) for r in final.collect())
