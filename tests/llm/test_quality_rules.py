import math
from collections import Counter

import pytest
from corpus import SCHEMA, WORD, awkward_texts, rows
from oracle import assert_same, connect
from pyspark.sql import functions as F

from fleetscope.llm.queries import ORACLES, op9_quality_rules
from fleetscope.llm.quality_rules import LADDER, RATIOS, binomial_cdf, quality_verdicts, risk_controlled_steps, text_features


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines),
        len(lines) - len(set(lines)), len(covered),
    )


def test_features_match_brute_force(spark, sf_dir):
    data = rows(awkward_texts())
    data += [(1000 + r.doc_id, r.text, r.lang, r.source, 0, "", "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r[0]: tuple(r)[1:] for r in text_features(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {r[0]: brute(r[1]) for r in data}


def test_binomial_cdf_is_exact(spark):
    cases = [(k, n, p) for n in (1, 7, 50, 3000) for k in (0, 1, n // 3, n) for p in (0.003, 0.3)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    for r in df.select("*", binomial_cdf(F.col("k"), F.col("n"), F.col("p")).alias("cdf")).collect():
        exact = sum(
            math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(r.p) + (r.n - j) * math.log1p(-r.p))
            for j in range(r.k + 1)
        )
        assert abs(r.cdf - exact) < 1e-9


def test_cutoffs_reject_junk_only_where_labels_allow(spark):
    clean = [f"word{i} of the plain text number{i * 7} and more " * 1 + " ".join(f"t{i}x{j}" for j in range(30)) for i in range(6000)]
    junk = [" ".join(f"b{i}x{j}***###" for j in range(40)) for i in range(50)]
    texts = clean + junk
    docs = spark.createDataFrame([(i, t, "en" if i % 300 else "rare") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < len(clean)), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_verdicts(docs, labels).collect()}
    assert all(got[i] for i in range(len(clean)))
    assert not any(got[i] for i in range(len(clean), len(texts)) if i % 300)
    no_labels = quality_verdicts(docs, labels.where("false")).collect()
    assert all(r.kept for r in no_labels)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_verdicts(docs, labels).count() == 0
    assert {rule for rule, _ in LADDER} == set(RATIOS)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql_and_cutoffs_switch_on(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    got = op9_quality_rules(spark, sf_dir)
    assert_same(got, ORACLES["op9_quality_rules"], connect(sf_dir))
    if sf == "sf0.01":
        assert got.where("not kept and not base_failed").count() > 0


def exact_step(hits, bad_hits, limit=0.025, level=0.05):
    """By brute force for one stratum."""
    n, best = len(hits), (0.0, 0)
    for s in range(1, len(LADDER) + 1):
        k = sum(h is not None and h <= s for h in hits)
        tail = sum(math.comb(n, j) * limit**j * (1 - limit) ** (n - j) for j in range(k + 1))
        if k <= n * limit and tail <= level:
            gain = sum(h is not None and h <= s for h in bad_hits) / max(1, len(bad_hits)) - k / n
            best = max(best, (gain, -s))
    return -best[1]


def test_steps_by_brute_force_and_pooled_strata(spark):
    hits = [None] * 390 + [20] * 3 + [25] * 7
    bad = [None] * 5 + [3] * 20 + [14] * 10 + [24] * 5
    rows_ = [(None, h, True) for h in hits] + [(None, h, False) for h in bad]
    rows_ += [(name, None, True) for name in ("x", "y") for _ in range(90)] + [("x", 2, False), ("y", 7, False)]
    labelled = spark.createDataFrame(rows_, "stratum string, first_step int, good boolean")
    got = {r.stratum: r.step for r in risk_controlled_steps(labelled).collect()}
    assert got[None] == exact_step(hits, bad, level=0.05 / 3) == 24
    # 90 good documents are too few for a stratum of its own, 180 are enough for both together.
    assert got["x"] == got["y"] == 7
    alone = {r.stratum: r.step for r in risk_controlled_steps(labelled.where("stratum = 'x'")).collect()}
    assert alone == {"x": 0}


def test_the_guarantee_holds_for_random_labels(spark):
    """A step whose true rate is twice the limit is used in at most alpha of many strata."""
    import random

    rng = random.Random(8)
    used = 0
    for _ in range(2):
        data = [(f"s{i}", 1 if rng.random() < 0.05 else None, True) for i in range(20) for _ in range(300)]
        data += [(f"s{i}", 1, False) for i in range(20) for _ in range(5)]
        steps = risk_controlled_steps(spark.createDataFrame(data, "stratum string, first_step int, good boolean")).collect()
        used += any(r.step for r in steps)
    assert used <= 1
