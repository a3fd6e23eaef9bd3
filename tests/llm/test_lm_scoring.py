import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import SCHEMA, awkward_texts, rows

from fleetscope.llm import lm_scoring
from fleetscope.llm.lm_scoring import pack, pack_sorted, predictive, score_documents, score_texts, seated, unpack, unpack_sorted, word_step
from fleetscope.llm.queries import op8_lm_scoring


def tokens(text):
    lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute(data):
    train, out = Counter(), []
    for doc_id, text in data:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10:
            train.update(tokens(text))
    n, v = sum(train.values()), len(train)
    for doc_id, text in data:
        ts = tokens(text)
        base = sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0
        out.append((str(doc_id), held, len(ts), sum(train[t] > 0 for t in ts), n, base))
    return sorted(out)


def check(got, data):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    want = brute(data)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for r, w in zip(got, want, strict=True):
        assert abs(r[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert math.isfinite(r[6]) and r[6] < 0


def test_query_base_score_and_held_out_perplexity(spark, sf_dir):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op8_lm_scoring(spark, sf_dir).collect()
    check(got, data)
    held = [r for r in got if r.held_out]
    per_token = lambda name: -sum(r[name] for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") < per_token("base_score") - 0.3


@pytest.mark.parametrize("sizes", [(16 << 20, 8 << 20, 64 << 20), (2_000, 900, 3_000)])
def test_awkward_rows_in_one_and_in_many_buckets(spark, monkeypatch, sizes):
    for name, size in zip(("CHUNK_BYTES", "PAIR_BYTES", "WORD_BYTES"), sizes, strict=True):
        monkeypatch.setattr(lm_scoring, name, size)
    data = [(r[0], r[1]) for r in rows(awkward_texts())] + [(None, "a b c"), (None, "a b c"), (2**60 + 1, "a b"), (2**60 + 1, "other text"), (7, "x y " * 40_000)]
    df = spark.createDataFrame([(d, t, "en", "s", 0, "", "") for d, t in data], SCHEMA)
    check(score_documents(df).collect(), data)


def test_empty_tables(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    for text in ("a b", None):  # nothing to learn from
        (r,) = score_documents(spark.createDataFrame([(held, text)], "doc_id long, text string")).collect()
        assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score)


def test_rare_words_are_contexts_too(spark):
    """Each "k<i>" is always followed by its own "v<i>"; all are equally rare."""
    texts = [(i, " ".join(f"k{j} v{j}" for j in range(i % 3, 1500, 3)), False) for i in range(12)]
    texts += [(1000 + i, f"k{i} v{i}", True) for i in range(9)] + [(2000 + i, f"k{i} v{i + 9}", True) for i in range(9)]
    found, _ = score_texts(spark.createDataFrame(texts, "key long, text string, held boolean"))
    got = {r.key: r.score for r in found.collect()}
    assert all(got[1000 + i] > got[2000 + i] + 1.5 for i in range(9))


def test_blocks_of_numbers():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 2**63, 1000).astype(np.uint64), np.zeros(0, np.uint64), np.array([2**64 - 1], np.uint64)):
        assert (unpack(pack(values), np.uint64) == values).all()
        assert (unpack_sorted(pack_sorted(np.sort(values)), np.uint64) == np.sort(values)).all()
    assert list(unpack(pack(np.array([True, False])), np.bool_)) == [True, False]


def law(c, weight, d):
    """P(t) by the recursion in plain numbers."""
    table = np.zeros(c + 2)
    table[1] = 1.0
    for k in range(1, c):
        table[1:] = (k - d * np.arange(1, c + 2)) * table[1:] + weight * table[:-1]
        table /= table.sum()
    return table[: c + 1]


@pytest.mark.parametrize("c,weight,least", [(2, 0.5, 0.01), (7, 0.7, 0.01), (64, 3.0, 0.02), (512, 30.0, 0.02)])
def test_seating_follows_its_law(c, weight, least):
    got = seated(np.full(40_000, c), np.full(40_000, weight), 0.4, np.random.default_rng(5))
    assert np.abs(np.bincount(got, minlength=c + 1)[: c + 1] / 40_000 - law(c, weight, 0.4)).max() < least


@pytest.mark.parametrize("c,weight", [(600, 4.0), (900, 60.0), (3000, 8.0)])
def test_seating_of_many_customers_is_near_its_law(c, weight):
    """The mean of the proposed and corrected seatings is within 5 % of that of the law."""
    got = seated(np.full(4000, c), np.full(4000, weight), 0.4, np.random.default_rng(6)).mean()
    exact = (law(c, weight, 0.4) * np.arange(c + 1)).sum()
    assert abs(got - exact) < 0.05 * exact, (got, exact)


def gibbs_by_customer(texts, d, strength, sweeps, burn, rng):
    """Plain Gibbs sampling, one customer at a time; averaged P(word | context)."""
    words = sorted({w for t in texts for w in [*t, "</s>"]})
    base = 1 / (len(words) + 1)
    pairs = [(u, w) for t in texts for u, w in zip(["<s>", *t], [*t, "</s>"], strict=True)]
    tables: dict = {}  # (context, word) -> sizes of tables; the context None is the root
    total, count = Counter(), Counter()

    def p(u, w):
        below = base if u is None else p(None, w)
        own = tables.get((u, w), [])
        return (sum(own) - d * len(own) + (strength + d * count[u]) * below) / (strength + total[u])

    def add(u, w):
        below = base if u is None else p(None, w)
        own = tables.setdefault((u, w), [])
        weights = [n - d for n in own] + [(strength + d * count[u]) * below]
        k = rng.choice(len(weights), p=np.array(weights) / sum(weights))
        total[u] += 1
        if k == len(own):
            own.append(1)
            count[u] += 1
            if u is not None:
                add(None, w)
        else:
            own[k] += 1

    def remove(u, w):
        own = tables[u, w]
        k = rng.choice(len(own), p=np.array(own) / sum(own))
        own[k] -= 1
        total[u] -= 1
        if not own[k]:
            own.pop(k)
            count[u] -= 1
            if u is not None:
                remove(None, w)

    for u, w in pairs:
        add(u, w)
    contexts, mean = sorted({u for u, _ in pairs}), 0.0
    for sweep in range(sweeps):
        for u, w in pairs:
            remove(u, w)
            add(u, w)
        if sweep >= burn:
            mean = mean + np.array([[p(u, w) for w in words] + [p(u, "never")] for u in contexts]) / (sweeps - burn)
    return contexts, words, mean


def blocked_gibbs(texts, contexts, words, d, strength, sweeps, burn, rng):
    """The operator's own steps in one bucket, for many sweeps; and P(word | context) by its ``predictive``."""
    names = [*words, "<s>", "never"]
    place = {w: i for i, w in enumerate(names)}
    seen = Counter((place[u], place[w]) for t in texts for u, w in zip(["<s>", *t], [*t, "</s>"], strict=True))
    v, w = np.array(list(seen)).T
    c = np.array(list(seen.values()))
    n = len(names)
    follow = np.bincount(v, c, n)
    t, root = np.ones(len(c), np.int64), {"known": len(words), "tables": len(words), "tokens": int(c.sum())}
    grid_v, grid_w = np.repeat([place[u] for u in contexts], len(words) + 1), np.tile([*range(len(words)), place["never"]], len(contexts))
    grid_c = np.array([seen.get(k, 0) for k in zip(grid_v.tolist(), grid_w.tolist(), strict=True)])
    mean = 0.0
    for sweep in range(sweeps):
        tables, customers = np.bincount(v, t, n), np.bincount(w, t, n).astype(np.int64)
        root = root | {"customers": int(t.sum()), "g": rng.gamma(strength / d + root["tables"])}
        root_tables, g, of_root = word_step(customers, tables, root, d, rng)
        root = root | {"tables": int(root_tables.sum())}
        if sweep >= burn:
            of_pair = dict(zip(zip(v.tolist(), w.tolist(), strict=True), t.tolist(), strict=True))
            grid_t = np.array([of_pair.get(k, 0) for k in zip(grid_v.tolist(), grid_w.tolist(), strict=True)])
            mean = mean + predictive(grid_c, grid_t, follow, [tables], [customers], [root_tables], grid_v, grid_w, [root], d) / (sweeps - burn)
        t = seated(c, d * g[v] * of_root[w], d, rng)
    return mean.reshape(len(contexts), -1)


def test_posterior_predictive_equals_that_of_a_plain_sampler():
    """On a tiny corpus, against Gibbs sampling one customer at a time; both sum to one."""
    rng = np.random.default_rng(2)
    texts = [rng.choice(["a", "b", "c", "dd"], p=[0.5, 0.25, 0.15, 0.1], size=rng.integers(1, 9)).tolist() for _ in range(14)]
    d = 0.5
    contexts, words, want = gibbs_by_customer(texts, d, lm_scoring.STRENGTH, 1200, 100, rng)
    got = blocked_gibbs(texts, contexts, words, d, lm_scoring.STRENGTH, 4000, 200, rng)
    assert np.abs(want.sum(axis=1) - 1).max() < 1e-9
    assert np.abs(got.sum(axis=1) - 1).max() < 1e-9
    assert np.abs(got - want).max() < 0.012, np.abs(got - want).max()
