import hashlib
import re

import corpus_pipeline
import public_tokenizers
import tiktoken
from oracle import connect
from test_ngram_join import brute as components
from test_quality_rules import brute as features

from fleetscope.llm.byte_bpe import read_ranks
from fleetscope.llm.common import documents
from fleetscope.llm.queries import ORACLES


def run_stages(spark, sf_dir, path):
    docs, kept = documents(spark, sf_dir), {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{path}/{len(kept)}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs
    return kept


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    before = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    kept = run_stages(spark, sf_dir, tmp_path)
    names = list(kept)
    assert names == ["quality rules", "exact dedup", "n-gram Jaccard join", "source mix", "byte-level BPE"]
    columns = documents(spark, sf_dir).columns
    assert all(kept[n].columns == columns for n in names[:-1])

    good = {r.doc_id: r.text for r in kept[names[0]].collect()}
    failed = {d for d, t in before.items() for f in [features(t)] if f[0] < 20 or 100 * f[5] > 30 * f[0]}
    assert set(good) == set(before) - failed  # too few labels here for a cutoff of its own

    content = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t) for d, t in good.items()}
    first = {}
    for d in sorted(content):
        first.setdefault(content[d], d)
    single = {r.doc_id: r.text for r in kept[names[1]].collect()}
    assert set(single) == set(first.values())

    alone = {r.doc_id: r.text for r in kept[names[2]].collect()}
    assert set(alone) == {d for d, (_, c) in components(single).items() if c == d}

    mixed = [r.doc_id for r in kept[names[3]].collect()]
    assert set(mixed) <= set(alone) and max(mixed.count(d) for d in set(mixed)) <= 3

    ranks = read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = kept[names[4]].collect()
    assert sorted(r.doc_id for r in coded) == sorted(mixed)
    assert all(r.round_trip and r.token_ids == exact.encode_ordinary(r.text) for r in coded)

    key = lambda rows: sorted((r.doc_id, hashlib.md5(str(r.token_ids).encode()).hexdigest()) for r in rows)
    assert key(corpus_pipeline.run(spark, sf_dir).collect()) == key(coded)


def test_stages_judge_rows_not_ids(spark, sf_dir):
    """Rows of one id with other texts, null ids, and ids above 2^53."""
    plain = lambda k: " ".join(f"t{k}x{i}" for i in range(40))
    big = 2**60 + 3
    data = [(1, plain(1)), (1, "short"), (None, plain(2)), (None, "tiny"), (big, plain(3)), (big, plain(1)), (5, plain(3)), (None, plain(2))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in data], documents(spark, sf_dir).schema)
    good = stage(spark, docs, sf_dir, 0)
    assert ids(good) == ids(docs.where("n_chars > 20"))
    single = stage(spark, good, sf_dir, 1)
    assert ids(single) == [("1", plain(1)), ("5", plain(3)), ("None", plain(2))]
    assert ids(stage(spark, single, sf_dir, 2)) == ids(single)
    mixed = stage(spark, single, sf_dir, 3)
    assert set(ids(mixed)) <= set(ids(single)) and mixed.columns == docs.columns


def test_learned_cutoffs_take_effect(spark):
    """At sf0.01 there are labels enough for cutoffs: the stage keeps what the SQL of its query keeps."""
    sf_dir = "/root/testdata/sf0.01"
    verdicts = connect(sf_dir).sql(ORACLES["op9_quality_rules"]).df()
    assert (~verdicts["base_failed"] & ~verdicts["kept"]).sum() > 10
    kept = stage(spark, documents(spark, sf_dir), sf_dir, 0)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(verdicts.loc[verdicts["kept"], "doc_id"])


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = documents(spark, sf_dir).limit(0)
    for k in range(5):
        out = stage(spark, docs, sf_dir, k)
        assert out.count() == 0 and set(docs.columns) <= set(out.columns)


def stage(spark, docs, sf_dir, k):
    return corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)


def ids(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())
