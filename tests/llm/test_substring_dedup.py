import random
from collections import Counter

import numpy as np
import pytest
from corpus import SCHEMA, awkward_texts, rows
from oracle import assert_same, connect

from fleetscope.llm.queries import ORACLES, op5_substring_dedup
from fleetscope.llm.substring_dedup import WINDOW, greedy_factors, remove_duplicate_passages, sliding_argmin


def brute(texts):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    windows = Counter(tuple(w[k : k + WINDOW]) for w in words.values() for k in range(len(w) - WINDOW + 1))
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - WINDOW + 1) if windows[tuple(w[k : k + WINDOW])] > 1 for j in range(k, k + WINDOW)}
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def passages(seed, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    shared = [[word() for _ in range(rng.choice([30, 34, 35, 36, 60, 200]))] for _ in range(12)]
    texts = []
    for _ in range(n):
        words = [word() for _ in range(rng.choice([0, 10, 50]))]
        for _ in range(rng.randrange(4)):
            passage = rng.choice(shared)
            a = rng.randrange(len(passage))
            words += passage[a : a + rng.choice([20, 40, 500])] if rng.random() < 0.5 else passage
            words += [word() for _ in range(rng.choice([0, 1, 20]))]
        texts.append(" ".join(words))
    return texts + ["same " * 80, "x y " * 30, "q r s " * 12, texts[3], texts[3]]


@pytest.mark.parametrize("seed,broadcast", [(1, "10m"), (2, "-1")])
def test_matches_brute_force(spark, seed, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    data = rows(passages(seed) + awkward_texts())
    got = remove_duplicate_passages(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute({r[0]: r[1] for r in data})


def test_empty_table_and_null_ids(spark):
    assert remove_duplicate_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (None, text), (1, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in remove_duplicate_passages(df).collect()) == [(0, 0), (40, 40), (40, 40)]


def test_repeated_ids_are_documents_of_their_own(spark):
    long = [f"w{i}" for i in range(300)]
    texts = [" ".join(long), " ".join(long[:100] + ["other"] + long[101:]), "short one", None, " ".join(long[50:90])]
    df = spark.createDataFrame(list(zip([1, 2, 1, 3, None], texts, strict=True)), "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed, r.kept_text) for r in remove_duplicate_passages(df).collect())
    assert got == sorted(brute(dict(enumerate(texts))).values())


def test_greedy_factors_follow_their_reference():
    key, other = {"a": 1, "b": 2}, {"a": 3, "b": 4}
    at = lambda start, windows, k, ref: {"start": start, "windows": windows, "reference": {"key": k, "start": ref}}
    ranges = [at(10, 5, key, 100), at(15, 1, other, 7), at(15, 3, key, 105), at(18, 1, key, 108), at(19, 2, other, 30), at(40, 1, key, 0)]
    assert greedy_factors(ranges) == [(10, 9 + WINDOW - 1), (19, 2 + WINDOW - 1), (40, WINDOW)]


def test_a_short_range_does_not_hide_a_longer_one():
    at = lambda start, windows, k, ref: {"start": start, "windows": windows, "reference": {"key": {"a": k, "b": 0}, "start": ref}}
    factors = greedy_factors([at(0, 10, 7, 100), at(10, 1, 7, 110), at(10, 20, 9, 50)])
    assert factors == [(0, 11 + WINDOW - 1), (11, 19 + WINDOW - 1)]


def test_factors_cover_all_ranges():
    rng = random.Random(8)
    for _ in range(2000):
        ranges = [
            {"start": rng.randrange(60), "windows": rng.choice([1, 1, 2, 5, 20]), "reference": {"key": {"a": rng.randrange(2), "b": 0}, "start": rng.randrange(40)}}
            for _ in range(rng.randrange(1, 12))
        ]
        ranges.sort(key=lambda r: r["start"])
        covered = {w for r in ranges for w in range(r["start"], r["start"] + r["windows"])}
        windows = [w for start, words in greedy_factors(ranges) for w in range(start, start + words - WINDOW + 1)]
        assert len(windows) == len(set(windows)) and set(windows) == covered


def test_factors_of_a_copy(spark):
    rng = random.Random(9)
    source = [f"v{rng.randrange(10**9)}" for _ in range(500)]
    pasted = ["x"] * 3 + source[100:300] + ["y"] + source[350:400]
    rows_ = [(1, " ".join(source)), (2, " ".join(pasted)), (3, "z " * 10)]
    got = {r.doc_id: (r.n_removed, r.n_factors) for r in remove_duplicate_passages(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert got == {1: (250, 2), 2: (250, 2), 3: (0, 0)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_equals_sql(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    assert_same(op5_substring_dedup(spark, sf_dir), ORACLES["op5_substring_dedup"], connect(sf_dir))


def test_sliding_argmin():
    rng = np.random.default_rng(4)
    for width in (1, 2, 3, 7, 8, 28):
        values = rng.integers(0, 9, 60).astype(np.uint64)
        assert list(sliding_argmin(values, width)) == [i + int(np.argmin(values[i : i + width])) for i in range(61 - width)]
