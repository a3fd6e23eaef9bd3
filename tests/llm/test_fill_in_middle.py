import hashlib
import random
import re

import pytest
from corpus import SCHEMA, awkward_texts, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect

from fleetscope.llm.fill_in_middle import SENTINELS, fill_in_middle, fit_index, line_ends, line_index, restored
from fleetscope.llm.queries import ORACLES, op11_fill_in_middle


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(mark in text for mark in SENTINELS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), output


@given(st.lists(st.integers(0, 5000), max_size=80), st.sampled_from([0, 1, 5, 100, 1000]))
@settings(max_examples=300, deadline=None)
def test_index_is_bounded_and_exact(gaps, error):
    offsets = [0]
    for gap in gaps:
        offsets.append(offsets[-1] + gap)
    index = fit_index(offsets, error)
    assert [index.offset(k) for k in range(len(offsets))] == offsets
    assert all(abs(index.predicted(k) - o) <= error for k, o in enumerate(offsets))
    assert index.first == sorted(set(index.first))


def test_even_lines_need_one_segment():
    assert len(fit_index([7 * k for k in range(10_000)]).first) == 1
    rng = random.Random(1)
    noisy = [0]
    for _ in range(10_000):
        noisy.append(noisy[-1] + rng.randrange(40, 60))
    assert len(fit_index(noisy).first) < 200


def test_line_ends():
    assert line_ends("") == [0]
    assert line_ends("a") == [0, 1]
    assert line_ends("a\n") == [0, 2]
    assert line_ends("\n\né😀\nx") == [0, 1, 2, 5, 6]


TEXTS = ["\n", "\n\n\n", "a\nb", "one <P> two\nthree", "x <S", "<\nS>", "<P\n>\n<", "S>a\nM><", "é\n😀\n", "line\n" * 20_000, "y" * 300_000 + "\n" + "z\n" * 5]


@pytest.mark.parametrize("extra", [TEXTS, awkward_texts()])
def test_matches_brute_force(spark, extra):
    data = rows(extra + extra[:3])
    got = restored(fill_in_middle(spark.createDataFrame(data, SCHEMA)))
    assert got.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "n_units", "form", "prefix_chars", "middle_chars", "output", "restored"]
    for r in got.collect():
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.restored == (r.text or "")


def test_shares_of_forms(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "'a\nb\nc' AS text")
    counts = {r.form: r["count"] for r in fill_in_middle(df, percent=50, spm_percent=20).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 1000) < 120 and abs(counts["spm"] - 200) < 60
    assert restored(fill_in_middle(df, percent=50)).where("restored <> text").count() == 0


def test_null_ids_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a\nb\n"), (3, "a\nb\n"), (3, "a\nb\n"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_in_middle(df).collect())
    assert got == sorted((i is None, *brute(i, t)) for i, t in [(None, "a\nb\n"), (3, "a\nb\n"), (3, "a\nb\n"), (3, None)])
    assert fill_in_middle(df.limit(0)).count() == 0


def test_stored_index(spark):
    df = spark.createDataFrame([(1, "a\nbb\nccc"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_index(df).collect()}
    one = got[1].segments[0]
    assert [one.offset + round(one.slope * k) + r for k, r in enumerate(got[1].residuals)] == [0, 2, 5, 8]
    assert got[2].residuals == [0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    assert_same(op11_fill_in_middle(spark, sf_dir), ORACLES["op11_fill_in_middle"], connect(sf_dir))
