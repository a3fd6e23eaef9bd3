import hashlib
import re
from collections import defaultdict

import pytest
from corpus import SCHEMA, awkward_texts, rows
from oracle import assert_same, connect
from pyspark.sql import functions as F

from fleetscope.llm import exact_dedup
from fleetscope.llm.exact_dedup import content_hash, drop_exact_duplicates, exact_duplicates
from fleetscope.llm.queries import ORACLES, op7_exact_dedup


def brute(data):
    groups = defaultdict(list)
    content = {}
    for doc_id, text, *_ in data:
        content[doc_id] = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups[content[doc_id]].append(doc_id)
    return {
        (d, min(groups[c]), len(groups[c]), d == min(groups[c]), hashlib.sha256(c.encode()).hexdigest())
        for d, c in content.items()
    }


@pytest.mark.parametrize("hash_fn", [content_hash, lambda c: F.length(c) % 3, lambda c: F.lit(1)])
def test_matches_brute_force_even_when_hashes_collide(spark, hash_fn):
    data = rows(awkward_texts())
    got = exact_duplicates(spark.createDataFrame(data, SCHEMA), hash_fn=hash_fn).collect()
    assert len(got) == len(data)
    assert {tuple(r) for r in got} == brute(data)


def test_empty_null_ids_and_repeated_rows(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    data = [(None, "x"), (4, "x"), (4, "x"), (None, "y"), (None, "y")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)
    assert [tuple(r) for r in got] == [
        (4, 4, 3, False), (4, 4, 3, True), (None, 4, 3, False), (None, None, 2, False), (None, None, 2, True),
    ]


def test_repeated_ids_with_other_texts_and_large_ids(spark):
    """A row stays by its own text, whatever other rows of its id do; ids above 2^53 keep every digit."""
    big = 2**60 + 1
    data = [(1, "a b"), (1, "c"), (2, "a  b"), (2, "d"), (2, "d"), (big, "c"), (None, "e"), (None, "a b")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in drop_exact_duplicates(df).collect()), key=str)
    assert kept == sorted([(1, "a b"), (1, "c"), (2, "d"), (None, "e")], key=str)
    got = exact_duplicates(df).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(d or 0 for d, _ in data)
    assert sorted(str(r.doc_id) for r in got if r.kept) == ["1", "1", "2", "None"]
    assert {r.keep_id for r in got if r.doc_id == big} == {1}


def test_many_repeats_are_written_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "REPEATS", 3)
    df = spark.createDataFrame([(7, "x")] * 8 + [(None, "y")] * 3, "doc_id long, text string")
    got = exact_duplicates(df).collect()
    assert len(got) == 11 and sum(r.kept for r in got) == 2


def test_filter_keeps_columns_and_one_row_a_group(spark):
    df = spark.createDataFrame(rows(awkward_texts()), SCHEMA)
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[1] for r in brute(rows(awkward_texts()))})


def test_query_equals_sql(spark, sf_dir):
    assert_same(op7_exact_dedup(spark, sf_dir), ORACLES["op7_exact_dedup"], connect(sf_dir))
