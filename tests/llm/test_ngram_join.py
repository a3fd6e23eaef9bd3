import random
import re

import pytest
from corpus import SCHEMA, awkward_texts, rows
from oracle import assert_same, connect

from fleetscope.llm import ngram_join
from fleetscope.llm.components import connected_components
from fleetscope.llm.queries import ORACLES, op10_ngram_join
from fleetscope.llm.ngram_join import jaccard_components, one_of_each_component


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, n=260):
    """Copies at all distances, a passage in most texts, and groups with equal prefixes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    centres = [[word() for _ in range(rng.choice([6, 30, 100, 200]))] for _ in range(8)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(centres))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words = words[: rng.randrange(1, len(words) + 1)]
        if rng.random() < 0.4:
            words += passage
        texts.append(" ".join(words) if rng.random() < 0.8 else "\n".join(words).upper())
    return texts


@pytest.mark.parametrize("seed,step", [(1, 1), (2, 16)])
def test_components_match_brute_force(spark, monkeypatch, seed, step):
    monkeypatch.setattr(ngram_join, "SAMPLE_STEP", step)
    data = rows(near_copies(seed) + awkward_texts())
    got = jaccard_components(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute({r[0]: r[1] for r in data})


def test_isolated_pairs_with_equal_prefixes_link(spark):
    """Pairs that differ behind the prefix only: in the last word, or in the first (one shingle of each set)."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    texts = []
    for i in range(60):
        words = [word() for _ in range(104)]
        changed = [*words[:-1], word()] if i % 2 else [word(), *words[1:]]
        texts += [" ".join(words), " ".join(changed)]
    data = rows(texts)
    got = jaccard_components(spark.createDataFrame(data, SCHEMA)).collect()
    want = brute({r[0]: r[1] for r in data})
    assert all(want[i + 1][1] == i for i in range(0, len(texts), 2))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("seed,n_words", [(1, 60), (2, 61), (3, 33)])
def test_single_changes_anywhere_link(spark, seed, n_words):
    """300 isolated pairs with one word changed at a random place."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    texts = []
    for _ in range(300):
        words = [word() for _ in range(n_words)]
        changed = list(words)
        changed[rng.randrange(n_words)] = word()
        texts += [" ".join(words), " ".join(changed)]
    data = rows(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(data, SCHEMA)).collect()}
    pairs = {r[0]: r[1] for r in data}
    for i in range(0, len(texts), 2):
        assert {k: got[k] for k in (i, i + 1)} == brute({k: pairs[k] for k in (i, i + 1)})


@pytest.mark.parametrize("few,leaders", [(0, (1,)), (1e9, ())])
def test_few_leaders_and_shuffled_ids_lose_nothing(spark, monkeypatch, few, leaders):
    """With the last round after a round of one leader as well as with it alone."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    monkeypatch.setattr(ngram_join, "MOST_IDS", 0)
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 3)
    data = rows(near_copies(3))
    got = jaccard_components(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute({r[0]: r[1] for r in data})


def test_empty_null_ids_and_filter(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    data = [(None, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (5, None), (6, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 2), (2, 2, 2), (2, 2, 2), (5, 0, 5), (6, 1, 6)], key=str)
    assert sorted(str(r.doc_id) for r in one_of_each_component(df).collect()) == ["2", "5", "6", "None"]


def test_repeated_ids_with_other_texts(spark):
    """Each row goes by its own text, whatever else has its id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    near = lambda text: text.rsplit(" ", 1)[0] + " changed"
    data = [(7, a), (7, b), (8, near(a)), (9, near(b)), (9, c), (9, c), (2**60 + 1, near(c)), (None, a)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (8, 7), (9, 7), (9, 9), (9, 9), (2**60 + 1, 9), (None, None)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in one_of_each_component(df).collect()), key=str)
    assert kept == sorted([(7, a), (7, b), (9, c), (None, a)], key=str)


def test_query_equals_sql(spark, sf_dir):
    assert_same(op10_ngram_join(spark, sf_dir), ORACLES["op10_ngram_join"], connect(sf_dir))


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == label
