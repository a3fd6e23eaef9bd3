"""Hand-made fixtures and properties of the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.functions import vectors as V
from fleetscope.functions.numbers import share_of, to_number
from fleetscope.operators import clean, evaluate, federation, memory, report, scoring, skew, training, windows
from fleetscope.sources import sessions
from fleetscope.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_smooth_max_goes_from_mean_to_max(spark):
    assert one(spark, V.smooth_max(array(0, 0))) == 0
    assert abs(one(spark, V.smooth_max(array(1, 3), 1e-3)) - 3) < 1e-9
    assert abs(one(spark, V.smooth_max(array(1, 3), 1e6)) - 2) < 1e-3


def test_contributions_sum_to_the_quadratic_form(spark):
    rng = np.random.default_rng(1)
    for _ in range(5):
        v, a = rng.normal(size=4), rng.normal(size=(4, 4))
        matrix = V.literal_matrix(a @ a.T)
        row = spark.range(1).select(V.quadratic(array(*v), matrix).alias("q"), V.total(V.contributions(array(*v), matrix)).alias("s")).first()
        assert abs(row.q - row.s) < 1e-9 and abs(row.q - v @ a @ a.T @ v) < 1e-9


def test_coercion_and_fill(spark):
    got = spark.createDataFrame([("1.5",), (" TRUE ",), ("false",), ("x",), (None,)], "t string").select(to_number(F.col("t")).alias("x"))
    assert [r.x for r in got.collect()] == [1.5, 1.0, 0.0, None, None]
    rows = [("a", 0, None), ("a", 1, 5.0), ("a", 2, None), ("a", 3, 7.0), ("b", 0, None)]
    df = spark.createDataFrame(rows, "s string, i long, v double")
    filled = clean.fill_gaps(df, ["v"], ["s"], ["i"]).orderBy("s", "i").collect()
    assert [r.v for r in filled] == [5, 5, 5, 7, 0]


def test_split_counts_in_double_arithmetic(spark):
    ns = spark.createDataFrame([(90,), (170,), (180,), (330,), (100,)], "n long").select("n", share_of(F.col("n"), 0.7).alias("k"))
    assert {r.n: r.k for r in ns.collect()} == {n: int(n * 0.70) for n in (90, 170, 180, 330, 100)}
    df = spark.createDataFrame([("c", i) for i in range(90)], "client string, id long")
    got = windows.chronological_split(df, ["client"], ["id"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"fit": 62, "calib": 13, "test": 15}


def test_count_windows_follow_the_slices(spark):
    rows = [("s", i, float(i)) for i in range(200)] + [("short", i, 0.0) for i in range(59)]
    df = spark.createDataFrame(rows, "session string, seq long, v double")
    got = windows.count_windows(df, ["session"], "seq", F.col("v"), 60, 32).orderBy("k").collect()
    assert [r.x[0] for r in got] == [0, 32, 64, 96, 128] and all(len(r.x) == 60 for r in got)
    assert one(spark, windows.expected_windows(F.lit(200), 60, 32)) == 5
    assert one(spark, windows.expected_windows(F.lit(59), 60, 32)) == 0


def test_future_is_the_time_ahead(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(100)], "session string, seq long, v double")
    w = windows.count_windows(df, ["session"], "seq", F.col("v"), 12, 5)
    paired = windows.forecast_pairs(w, ["session"], "k", 3)
    for r in windows.future_values(paired, ["session"], "k", "x", 5, 3).where("paired").collect():
        assert r.future == [float(r.k * 5 + 12 + j) for j in range(15)]


def test_numbering_over_range_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.random(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    key = lambda r: (r.g, r.id, r.seq)
    a = sorted(map(key, windows.numbered(df, ["g"], ["v", "id"]).collect()))
    b = sorted(map(key, windows.numbered_at_scale(df, ["g"], ["v", "id"], part_rows=80).collect()))
    assert a == b


@pytest.mark.parametrize("part_rows", [3, 1_000_000])
def test_a_null_group_is_a_group_like_any_other(spark, monkeypatch, part_rows):
    monkeypatch.setattr(windows, "PART_ROWS", part_rows)
    rows = [(g, float(i % 5), i) for i, g in enumerate(["a", None] * 10)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    numbered = windows.numbered_at_scale(df, ["g"], ["id"], part_rows=part_rows).collect()
    assert sorted((r.g or "", r.seq) for r in numbered) == sorted((g, k) for g in ("", "a") for k in range(10))
    sums = windows.running_sums(df, ["g"], ["id"], ["v"], part_rows=part_rows).collect()
    for g in ("a", None):
        values = [v for h, v, _ in rows if h == g]
        assert [r.run_v for r in sorted((r for r in sums if r.g == g), key=lambda r: r.id)] == np.cumsum(values).tolist()
    split = windows.chronological_split(df, ["g"], ["id"]).groupBy("g", "split").count().collect()
    assert {(r.g, r.split): r["count"] for r in split} == {(g, s): n for g in ("a", None) for s, n in (("fit", 7), ("calib", 1), ("test", 2))}
    stats = scoring.robust_stats(df, ["g"], "v")
    expected = {g: np.percentile([v for h, v, _ in rows if h == g], [25, 50, 75]) for g in ("a", None)}
    assert {r.g: (r.n, r.med, r.iqr) for r in stats.collect()} == {g: (10, q[1], q[2] - q[0]) for g, q in expected.items()}
    assert scoring.z_scores(df, stats, ["g"], "v").count() == 20
    metrics = evaluate.detection_metrics(df, ["g"], "v", F.col("id") >= 10).collect()
    assert {r.g: r.n for r in metrics} == {"a": 10, None: 10} and all(r.auroc is not None for r in metrics)
    budgets = spark.createDataFrame([("a", 4), (None, 3)], "g string, budget long")
    taken = skew.take_slices(df, budgets, "g", ["id"]).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in taken} == {"a": 4, None: 3}


def test_a_value_that_fills_a_group(spark):
    df = spark.range(1000).selectExpr("'s' AS g", "if(id < 950, 0.0D, id * 1.0D) AS v")
    r = scoring.robust_stats(df, ["g"], "v").first()
    q = np.percentile([0.0 if i < 950 else float(i) for i in range(1000)], [25, 50, 75])
    assert (r.n, r.med, r.iqr) == (1000, q[1], q[2] - q[0])
    q = scoring.ranked_quantiles(df, ["g"], "v", [0.0, 0.9505, 0.99, 1.0]).first().q
    assert np.allclose(q, np.percentile([0.0 if i < 950 else float(i) for i in range(1000)], [0, 95.05, 99, 100]))


def test_array_split_sizes(spark):
    got = spark.range(10).select(clean.array_split_block(F.col("id"), F.lit(10), 4).alias("b")).groupBy("b").count().orderBy("b")
    assert [r["count"] for r in got.collect()] == [len(x) for x in np.array_split(np.arange(10), 4)]


def test_grid_starts_at_the_first_sample(spark):
    df = spark.createDataFrame([("s", 130_000, "a", 1.0), ("s", 320_000, "a", 3.0), ("s", 735_000, "a", 5.0)], "session string, t long, node string, v double")
    got = clean.resample(df, "session", "t", "node", "v", ["a"], 200_000).orderBy("bin").collect()
    assert [(r.bin, r.a) for r in got] == [(0, 2.0), (1, 2.0), (2, 2.0), (3, 5.0)]


def test_quantiles_by_rank_equal_percentiles(spark):
    rng = random.Random(2)
    rows = [(g, round(rng.random(), 2)) for g in "abc" for _ in range(rng.randint(1, 60))] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    a = {r.g: (r.n, round(r.med, 9), round(r.iqr, 9)) for r in scoring.robust_stats(df, ["g"], "v").collect()}
    b = {r.g: (r.n, round(r.med, 9), round(r.iqr, 9)) for r in scoring.robust_stats(df, ["g"], "v", "ranked").collect()}
    assert a == b


def test_robust_z_of_a_constant_column(spark):
    df = spark.createDataFrame([("n", 2.0)] * 5, "node string, v double")
    z = scoring.z_scores(df, scoring.robust_stats(df, ["node"], "v"), ["node"], "v")
    assert {r.z for r in z.collect()} == {0.0}


def test_ties_go_to_the_lowest_prototype(spark):
    w = spark.createDataFrame([(1, "c", [[0.0], [0.0]])], "id long, client string, z array<array<double>>")
    p = spark.createDataFrame([("c", 1, [[1.0], [0.0]]), ("c", 0, [[0.0], [-1.0]])], "client string, m long, z array<array<double>>")
    assert memory.assign(w, p).first().m == 0


def test_covariance_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([("c", i % 2, r.tolist()) for i, r in enumerate(x)], "client string, m long, d_node array<double>")
    got = memory.covariance_stats(df, ["client", "m"]).where("m = 0").first()
    part = x[::2]
    assert np.allclose(got.mu, part.mean(0))
    assert np.allclose(got.precision, np.linalg.inv(np.cov(part.T) + 0.01 * np.eye(3)))


def metrics(spark, pairs):
    df = spark.createDataFrame(pairs, "s double, y boolean").withColumn("g", F.lit(1))
    return evaluate.detection_metrics(df, ["g"], "s", F.col("y")).first()


def test_auroc_ties_reversal_and_one_class(spark):
    assert metrics(spark, [(1.0, True), (1.0, False), (1.0, False)]).auroc == 0.5
    assert metrics(spark, [(1.0, True), (2.0, True)]).auroc is None
    rng = random.Random(4)
    data = [(float(rng.randrange(8)), rng.random() < 0.4) for _ in range(80)]
    a, b = metrics(spark, data), metrics(spark, [(-s, y) for s, y in data])
    assert abs(a.auroc + b.auroc - 1) < 1e-12
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(a.auroc - brute) < 1e-12
    precision = {t: sum(y for s, y in data if s >= t) / sum(s >= t for s, _ in data) for t in {s for s, _ in data}}
    ap = sum(sum(y for s, y in data if s == t) / len(pos) * precision[t] for t in precision)
    assert abs(a.auprc - ap) < 1e-12


def test_point_adjustment(spark):
    truth, pred = "0110110", "0010000"
    df = spark.createDataFrame([(i, t == "1", p == "1") for i, (t, p) in enumerate(zip(truth, pred, strict=True))], "i long, t boolean, p boolean").withColumn("g", F.lit(0))
    got = evaluate.point_adjusted(df, ["g"], ["i"], "t", "p").orderBy("i").collect()
    assert "".join("01"[r.adjusted] for r in got) == "0110000"


def test_weighted_mean_of_parameters(spark):
    params = spark.createDataFrame([(1, "w", 0, 2.0), (2, "w", 0, 6.0), (1, "steps", 0, 3.0), (2, "steps", 0, 4.0)], "client long, name string, idx long, value double")
    counts = spark.createDataFrame([(1, 1), (2, 3)], "client long, n long")
    got = {r.name: r.value for r in federation.average_parameters(params, counts, integers=["steps"]).collect()}
    assert got == {"w": 5.0, "steps": 3.0}


def test_alignment_of_three_clients(spark):
    vec = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.9, math.sqrt(1 - 0.81)], 4: [-1.0, 0.0], 5: [0.0, -1.0], 6: [-0.6, -0.8]}
    rows = [(g, (g - 1) // 2, 0, v) for g, v in vec.items()]
    protos = spark.createDataFrame(rows, "gid long, client long, node long, vec array<double>")
    pairs = federation.agreement(protos)
    edges = federation.links(pairs, delta=0.85)
    members = federation.clusters(protos.select("gid"), edges)
    assert {(r.gid, r.cluster) for r in members.collect()} == {(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (6, 6)}
    shared = federation.shared_prototypes(protos, members, 1)
    got = {r["dim"]: r.value for r in shared.collect()}
    assert abs(got[0] - 0.95) < 1e-9
    used = spark.createDataFrame([(g, 10 - g) for g in vec], "gid long, n long")
    slots = federation.personal_slots(protos, members, pairs, used, shared, 2).collect()
    assert {r.gid for r in slots if r.client == 0} == {1, 2} and [r.gid for r in slots if r.client == 0 and r.slot == 0] == [2]


def test_chained_links_make_one_single_linkage_cluster(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 4)], "gid long")
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9)], "a long, b long, sim double")
    members = federation.clusters(nodes, edges)
    assert {r.cluster for r in members.collect()} == {1}
    assert federation.complete_clusters(members, edges).count() == 0


def test_random_baseline(spark):
    from fleetscope.operators.localize import chance_of_hit

    assert round(100 * one(spark, chance_of_hit(F.lit(26), F.lit(7), 3)), 1) == 62.7


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(5)
    p = {n: rng.normal(size=s) for n, s in training._shapes(5, 2).items()}
    x = rng.normal(size=(7, 5))
    _, grad = training.gradients(x, p)
    for name in p:
        at = tuple(0 for _ in p[name].shape)
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][at] += 1e-6
        down[name][at] -= 1e-6
        slope = (training.gradients(x, up)[0] - training.gradients(x, down)[0]) / 2e-6
        assert abs(slope - grad[name][at]) < 1e-3 * max(1, abs(slope))


def test_training_lowers_the_loss_and_repeats(spark):
    rng = np.random.default_rng(6)
    basis = rng.normal(size=(2, 6))
    rows = [(c, (rng.normal(size=2) @ basis).tolist()) for c in (0, 1) for _ in range(60)]
    df = spark.createDataFrame(rows, "client long, x array<double>")
    a = {(r.client, r.round): r.loss for r in training.train_autoencoders(df, "client", 2, 6).collect()}
    assert all(a[c, 5] < a[c, 0] for c in (0, 1))
    b = {(r.client, r.round): r.loss for r in training.train_autoencoders(df, "client", 2, 6).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)
    together = training.train_autoencoders(df, "client", 2, 3, federate=True)
    assert together.where("round = 0").count() == 2


def test_forecast_and_slices(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    y = x @ np.array([[0, 0.5, 0.2], [0.3, 0, 0.1], [0.7, 0.4, 0]])
    df = spark.createDataFrame([("c", a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "client string, x array<double>, y array<double>")
    got = {r.node: r.weights for r in training.ridge_forecast(df, "client").collect()}
    assert np.allclose(got[0], [0, 0.3, 0.7], atol=1e-2)
    assert sum(skew.dirichlet_budgets(["a", "b"], 100, 1e6, 5).values()) in range(98, 101)


def test_readers(spark, tmp_path):
    folder = tmp_path / "rob_1" / "fault_2.drag"
    folder.mkdir(parents=True)
    (folder / "merged.csv").write_text("a,b\n1,TRUE\n2,x\n")
    (folder / "._merged.csv").write_text("a,b\n9,9\n")
    rows = sessions.read_sessions(spark, str(tmp_path), {"a": "n1", "b": "n2"})
    assert [(r.n1, r.n2) for r in rows.select("n1", "n2").collect()] == [("1", "TRUE"), ("2", "x")]
    label = sessions.coded(sessions.path_part(F.col("file"), -2), {"fault_2.drag": 2}, "label")
    assert {r.l for r in rows.select(label.alias("l")).collect()} == {2}
    with pytest.raises(ValueError, match="missing|not in"):
        sessions.read_sessions(spark, str(tmp_path), {"zz": "q"})
    with pytest.raises(Exception, match="unknown label"):
        rows.select(sessions.coded(F.lit("odd"), {"x": 1}, "label")).collect()


def test_topics(spark, tmp_path):
    (tmp_path / "f1-imu.csv").write_text("%time,field.x\n1500000000123456789,0.5\n1500000000223456789,bad\n")
    got = sessions.read_topics(spark, str(tmp_path), "%time", {"field.x": "x"}).select("session", "topic", "node", "value", F.unix_micros("ts").alias("t")).collect()
    assert [tuple(r) for r in got] == [("f1", "imu", "x", 0.5, 1500000000123456)]


def test_live_windows_equal_batch_windows(spark, tmp_path):
    rows = [(s, i, float(i * s)) for s in (1, 2) for i in range(23)]
    schema = "session long, seq long, v double"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 8 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    out = live.live_windows(source, "session", "seq", "v", 6, 4)
    query = out.writeStream.format("memory").queryName("lw").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.session, r.k): r.total for r in spark.table("lw").collect()}
    df = spark.createDataFrame(rows, schema)
    batch = windows.count_windows(df, ["session"], "seq", F.col("v"), 6, 4)
    assert got == {(r.session, r.k): sum(r.x) for r in batch.collect()}


def test_live_scores(spark):
    df = spark.createDataFrame([("n", 10.0), ("n", 1.0)], "node string, v double")
    stats = spark.createDataFrame([("n", 1.0, 2.0)], "node string, med double, iqr double")
    assert sorted((r.z, r.alarm) for r in live.scored(df, stats, ["node"], "v").collect()) == [(0.0, False), (4.5, True)]


def test_comparison_table(spark):
    ours = spark.createDataFrame([(0.9,), (0.7,)], "auroc double")
    got = report.comparison({"ours": (ours, True)}).first()
    assert (got.method, round(got.auroc, 9), got.clients, got.comparable) == ("ours", 0.8, 2, True)


def test_prebuilt_windows_lose_their_dead_nodes(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    rows = [("a", [1.0, 2.0, 3.0]), ("b", [4.0, 5.0, 6.0]), ("b", None)]
    sessions.write_dataset(spark.createDataFrame(rows, "client string, x array<double>"), path, {"nodes": '["u", "v", "w"]'})
    windows_, names = sessions.read_prebuilt(spark, path, "x", dead=["v"])
    assert names == ["u", "w"] and sorted((r.client, r.x) for r in windows_.collect() if r.x) == [("a", [1.0, 3.0]), ("b", [4.0, 6.0])] and windows_.count() == 3
    with pytest.raises(ValueError):
        sessions.read_prebuilt(spark, path, "x", dead=["other"])


def test_only_implemented_methods_are_compared(spark):
    result = lambda *values: lambda spark, _: spark.createDataFrame([(v,) for v in values], "auroc double")
    methods = [report.Method("one", result(0.5, 1.0, None)), report.Method("two", result(0.25), supervised=True), report.Method("three")]
    table = report.compared(methods, spark, "")
    assert {(r.method, r.auroc, r.clients, r.comparable) for r in table.collect()} == {("one", 0.75, 2, True), ("two", 0.25, 1, False)}
    listed = {(r.method, r.supervised, r.implemented, r.clients) for r in report.registry(methods, table).collect()}
    assert listed == {("one", False, True, 2), ("two", True, True, 1), ("three", False, False, 0)}


def test_a_large_bank_votes_as_one_row_does(spark, monkeypatch):
    rng = np.random.default_rng(3)
    samples = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(12)], "key long, vec array<double>")
    bank = spark.createDataFrame([(i, i % 3, rng.normal(size=4).tolist()) for i in range(20)], "pid long, label int, vec array<double>")
    votes = lambda: sorted((r.key, r.label, round(r.vote, 9), round(r.alpha, 9)) for r in federation.retrieval_vote(samples, bank, 3).collect())
    whole = votes()
    monkeypatch.setattr(federation, "BANK_ROWS", 6)
    assert votes() == whole
    with pytest.raises(ValueError):
        federation.one_row_bank(bank, ["pid", "vec"])


def test_splits_of_null_strata(spark):
    df = spark.createDataFrame([("a" if i % 2 else None, i) for i in range(40)], "g string, id long")
    split = windows.hashed_split(df, ["g"], "id").groupBy("g", "split").count().collect()
    assert {(r.g, r.split): r["count"] for r in split} == {(g, s): n for g in ("a", None) for s, n in (("train", 14), ("test", 6))}
    dealt = windows.round_robin(df, ["g"], ["id"], 3).collect()
    assert all(r.client == (r.id // 2) % 3 for r in dealt) and len(dealt) == 40


def test_prototype_statistics_by_rank(spark, monkeypatch):
    monkeypatch.setattr(windows, "PART_ROWS", 50)
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(3), rng.randrange(2), round(rng.random(), 2) if rng.random() < 0.9 else None) for _ in range(300)]
    df = spark.createDataFrame(rows, "client string, m int, node int, v double")
    key = lambda r: (r.client, -1 if r.m is None else r.m, r.node, r.n, round(r.med, 9), round(r.iqr, 9), r.valid, r.overall)
    one, other = (sorted(map(key, scoring.prototype_stats(df, "client", "m", "node", "v", 20, method).collect())) for method in ("percentile", "ranked"))
    assert one == other and len(one) == 16
    with pytest.raises(ValueError):
        scoring.prototype_stats(df, "client", "m", "node", "v", method="other")
