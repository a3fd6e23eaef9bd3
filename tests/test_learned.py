"""The learned queries against plain numpy on the same rows."""

import numpy as np
import pandas as pd

from fleetscope.operators.parameters import BETA1, BETA2, EPSILON, attention_output, encoded, neighbours
from fleetscope.plans import catalog
from fleetscope.plans.learned import ENCODER, FORECAST, NEIGHBOURS, RATE, RING, SENSORS, SPAN, STEPS, STRIDE, STRUCTURE


def adam(net, x):
    flat, m, v, losses = net.start(), 0.0, 0.0, []
    for step in range(STEPS):
        loss, grad = net.gradient(x, net.unpack(flat))
        losses.append(loss / (len(x) * net.scale))
        g = net.pack(grad) / (len(x) * net.scale)
        m, v = BETA1 * m + (1 - BETA1) * g, BETA2 * v + (1 - BETA2) * g * g
        flat = flat - RATE * (m / (1 - BETA1 ** (step + 1))) / (np.sqrt(v / (1 - BETA2 ** (step + 1))) + EPSILON)
    return flat, losses


def by_client(sf_dir):
    frame = pd.read_parquet(f"{sf_dir}/embeddings.parquet").sort_values("vec_id")
    return {c: (g["vec_id"].to_numpy(), np.stack(g["embedding"].to_numpy()).astype(float)) for c, g in frame.groupby(frame["vec_id"] % 4)}


def test_encoder_and_decoder(spark, sf_dir):
    local = {c: adam(ENCODER, v.reshape(-1, 8))[0] for c, (_, v) in by_client(sf_dir).items()}
    sizes = {c: len(ids) * 8 for c, (ids, _) in by_client(sf_dir).items()}
    mean = np.average([local[c] for c in local], axis=0, weights=[sizes[c] for c in local])
    p = ENCODER.unpack(mean)
    z = {(r.vec_id, r.node): r.z for r in catalog.QUERIES["enc01_node_encoder"](spark, sf_dir).collect()}
    errors = {(r.vec_id, r.node): r.error for r in catalog.QUERIES["enc02_decoder_error"](spark, sf_dir).collect()}
    for ids, v in by_client(sf_dir).values():
        for i, row in zip(ids, v.reshape(-1, 8, 8), strict=True):
            code = encoded(row, p)
            assert np.allclose([z[i, n] for n in range(8)], code, atol=2e-6)
            assert np.allclose([errors[i, n] for n in range(8)], ((code @ p["w3"] + p["b3"] - row) ** 2).mean(1), atol=2e-6)


def test_attention_learns_and_equals_numpy(spark, sf_dir):
    residual = {(r.vec_id, r.node): r.residual for r in catalog.QUERIES["att02_learned_attention"](spark, sf_dir).collect()}
    chosen = {(r.client, r.node): r.neighbours for r in catalog.QUERIES["att01_learned_neighbours"](spark, sf_dir).collect()}
    for client, (ids, v) in by_client(sf_dir).items():
        codes = v[:4]
        nearest = ((v[:, None] - codes[None]) ** 2).sum(2).argmin(1)
        d = v - codes[nearest]
        flat, losses = adam(STRUCTURE, np.hstack([d, d]))
        assert losses[-1] < losses[0]
        p = STRUCTURE.unpack(flat)
        expected = ((d.reshape(-1, 8, 8) - attention_output(STRUCTURE, d, p, NEIGHBOURS, RING)) ** 2).sum(2)
        assert np.allclose([[residual[i, n] for n in range(8)] for i in ids], expected, atol=1e-5)
        near = neighbours(p["nodes"], NEIGHBOURS)
        assert all(chosen[client, n] == near[n].tolist() for n in range(8))
        assert all(n not in chosen[client, n] for n in range(8))


def test_forecasts_of_whole_series(spark, sf_dir):
    frame = pd.read_parquet(f"{sf_dir}/lineitem.parquet")
    columns = list(SENSORS)
    frame[columns] = (frame[columns] - frame[columns].mean()) / frame[columns].std(ddof=0)
    rows, keys = {c: [] for c in range(4)}, {c: [] for c in range(4)}
    for session, g in frame.groupby("l_suppkey"):
        v = g.sort_values(["l_shipdate", "l_orderkey", "l_linenumber"])[columns].to_numpy()
        count = max(0, (len(v) - SPAN) // STRIDE + 1)
        for k in range(count - 1):
            past, ahead = v[k * STRIDE : k * STRIDE + SPAN], v[k * STRIDE + SPAN : k * STRIDE + SPAN + STRIDE]
            rows[session % 4].append(np.concatenate([past.T.ravel(), ahead.T.ravel()]))
            keys[session % 4].append((session, k))
    losses = {(r.client, r.step): r.loss for r in catalog.QUERIES["fcs01_attention_forecast"](spark, sf_dir).collect()}
    residual = {(r.session, r.k, r.node): r.residual for r in catalog.QUERIES["fcs02_learned_residual"](spark, sf_dir).collect()}
    assert len(residual) == 4 * sum(map(len, keys.values()))
    for c in range(4):
        x = np.array(rows[c])
        flat, expected = adam(FORECAST, x)
        assert np.allclose([losses[c, s] for s in range(STEPS)], expected, atol=1e-6) and expected[-1] < expected[0]
        ahead = x[:, len(SENSORS) * SPAN :].reshape(-1, len(SENSORS), STRIDE)
        gaps = ((ahead - attention_output(FORECAST, x, FORECAST.unpack(flat), 3)) ** 2).sum(2)
        got = np.array([[residual[s, k, n] for n in range(len(SENSORS))] for s, k in keys[c]])
        assert np.allclose(got, gaps, atol=1e-4)


def test_clustered_rounds_over_the_table(spark, sf_dir):
    rows = catalog.QUERIES["fed13_clustered_rounds"](spark, sf_dir).collect()
    sizes = {c: len(ids) for c, (ids, _) in by_client(sf_dir).items()}
    assert sorted((r.client, r.round) for r in rows) == [(c, n) for c in range(4) for n in range(1, 5)]
    assert all(r.n == sizes[r.client] and r.warm_up == (r.round == 1) and 0 <= r.replica < 3 for r in rows)


def test_federated_detection_counts_the_tested_windows(spark, sf_dir):
    got = {r.client: (r.n, r.auroc) for r in catalog.QUERIES["slice_federated_detection"](spark, sf_dir).collect()}
    frame = pd.read_parquet(f"{sf_dir}/lineitem.parquet")
    tested = dict.fromkeys(range(4), 0)
    normal = dict.fromkeys(range(4), 0)
    for session, g in frame.groupby("l_suppkey"):
        flags = (g.sort_values(["l_shipdate", "l_orderkey", "l_linenumber"])["l_returnflag"] == "R").to_numpy()
        for k in range(max(0, (len(flags) - SPAN) // STRIDE + 1)):
            if flags[k * STRIDE : k * STRIDE + SPAN].any():
                tested[session % 4] += 1
            else:
                normal[session % 4] += 1
    for c in range(4):
        n = normal[c]
        tested[c] += n - int(n * 0.70) - int(n * 0.15)
    assert {c: n for c, (n, _) in got.items()} == tested
    assert all(0 <= auroc <= 1 for _, auroc in got.values())
