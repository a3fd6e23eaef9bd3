import pytest
from oracle import assert_same, connect

from fleetscope.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], con)


#: Compared with numpy in test_learned.py and test_alignment_and_sweeps.py.
COMPARED = {
    "att01_learned_neighbours", "att02_learned_attention", "enc01_node_encoder", "enc02_decoder_error", "fcs01_attention_forecast",
    "fcs02_learned_residual", "fed03_mahalanobis_agreement", "fed13_clustered_rounds", "fed18_adam_refinement", "plt01_kernel_projection",
    "rpt03_refitted_sweep", "rpt03_skew_sweep", "slice_federated_detection",
}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - COMPARED))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
