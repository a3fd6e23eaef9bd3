import re
from collections import Counter

import numpy as np
import pytest
from corpus import SCHEMA, awkward_texts, rows
from pyspark.sql import functions as F

from fleetscope.llm import source_mix
from fleetscope.llm.queries import op1_source_mix
from fleetscope.llm.source_mix import flight, land, mix_sources


def targets(sizes, weights=(5, 2, 1), most=3):
    """Sources in code-point order, null last; shares by weight, the excess over a cap shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return share | capped
        capped |= {s: most * sizes[s] for s in over}


def check(got, texts_sources):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in texts_sources}
    by_source = {}
    for d, _, s in texts_sources:
        by_source[s] = by_source.get(s, 0) + size[d]
    want, taken, source = targets(by_source), {}, {d: s for d, _, s in texts_sources}
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], by_source[s])
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in by_source:
        largest = max(size[d] for d in size if source[d] == s)
        assert abs(taken[s] - want[s]) <= largest
    return {r.doc_id: r.taken for r in got}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    first = check(op1_source_mix(spark, sf_dir).collect(), docs)
    assert first == check(op1_source_mix(spark, sf_dir).collect(), docs)


def test_awkward_rows(spark):
    data = rows(awkward_texts())
    check(mix_sources(spark.createDataFrame(data, SCHEMA)).collect(), [(r[0], r[1], r[3]) for r in data])
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame(rows([None, "", " "]), SCHEMA)
    assert [(r.target, r.taken) for r in mix_sources(blank).collect()] == [(0.0, 0)] * 3


def test_null_and_repeated_ids_beside_large_ones(spark):
    big = [2**60 + 1, 2**60 + 3, 2**60 + 7]
    data = [(None, "a b c", "x"), *[(d, "a b " * (i + 1), "x") for i, d in enumerate(big)], (5, "one", "y"), (5, "two words", "y"), (None, "z", "y")]
    got = mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(d) for d, *_ in data)
    assert sorted(r.size for r in got if r.doc_id == 5) == [1, 2]


def test_many_equal_rows_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "BLOCK", 20)
    data = [(None, "same text here", "x")] * 900 + [(i, "w " * (i % 7 + 1), "y") for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mix_sources(df).collect()
    target = {r.source_size: r.target for r in got}
    for size, want in target.items():
        assert abs(sum(r.taken for r in got if r.source_size == size) - want) <= 7
    rows_ = df.select("doc_id", "text", F.lit(0).alias("place"), F.xxhash64("text").alias("mark"))
    assert max(r["count"] for r in source_mix._salted(rows_).groupBy("mixed").count().collect()) <= 10


@pytest.mark.parametrize("block", [20, 500])
def test_the_split_of_the_input_does_not_matter(spark, monkeypatch, block):
    monkeypatch.setattr(source_mix, "BLOCK", block)
    data = [(7, "equal row of five words", "x")] * 1001 + [(i, "w " * (i % 37 + 1), "xyz"[i % 3]) for i in range(299)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    results = [Counter((r.doc_id, r.size, r.taken) for r in mix_sources(df.repartition(n)).collect()) for n in (1, 3, 5)]
    assert results[0] == results[1] == results[2]


def test_large_documents_are_settled_first():
    size, start = np.array([400.0, 300.0, *np.arange(60, 0, -1) * 3]), np.full(62, 0.6)
    hits, totals = np.zeros(62), []
    for k in range(300):
        p = flight(start, size, np.random.default_rng(k))
        assert abs((p - start) @ size) < 1e-6 and p[0] in (0, 1) and p[1] in (0, 1)
        q = land(p, size)
        hits += q
        totals.append(abs((q - start) @ size))
    assert np.percentile(totals, 90) <= 60
    assert abs(hits[:2].mean() / 300 - 0.6) < 0.08 and abs(hits[2:].mean() / 300 - 0.6) < 0.05
    hopeless = flight(np.full(3, 0.5), np.array([1000.0, 2.0, 1.0]), np.random.default_rng(1))
    assert abs((hopeless - 0.5) @ np.array([1000.0, 2.0, 1.0])) < 1e-6


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 500, 300).astype(float)
    hits = np.zeros(300)
    for k in range(200):
        p = flight(np.full(300, 0.3), size, np.random.default_rng(k))
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert abs(p.sum() - 90) < 1e-6 and abs((p * size).sum() - 0.3 * size.sum()) < 1e-3
        q = land(p, size)
        assert set(q) <= {0.0, 1.0}
        hits += q
    assert 0.2 < hits.mean() / 200 < 0.4 and hits.min() > 20 and hits.max() < 100
