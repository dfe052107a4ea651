"""One user, customer and order hold a third of all rows: split scans must still match the oracle."""

import pytest
from compare import TABLES, compare, duck

import __spark_entry__ as entry
from visitloom.functions import ordered

SOURCE = "/root/testdata/sf0.001"
HOT = {"events": ("user_id", "event_id"), "orders": ("o_custkey", "o_orderkey"), "lineitem": ("l_orderkey", "l_partkey")}
NAMES = ["d03_stitch_fill", "d04_stitch_global", "d06_collapse_sequential", "d07_path_touches", "d07_paths", "d08_serialise_d",
         "d12_transition_probs", "d25_position_based", "d27_weighted_attribution", "d33_vocab_coverage", "d39_dim_customer",
         "d44_first_order_features", "d46_pareto_bucket", "d49_repeat_buyer_fact", "d50_churn_episodes", "d55_stratified_split",
         "d58_impute_clip", "m04_quantile_transform", "m14_auc_by_group", "m19_gain_gini", "a10_quantiles", "j17_group_total",
         "w01_prior_sum", "w14_cumsum", "w14_global_cumsum", "w16_frequency_rank"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    con = duck(SOURCE)
    for name in TABLES:
        hot = ""
        if name in HOT:
            key, by = HOT[name]
            hot = f" REPLACE (CASE WHEN {by} % 3 = 0 THEN 1 ELSE {key} END AS {key})"
        con.execute(f"COPY (SELECT *{hot} FROM {name}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, folder, name, monkeypatch):
    monkeypatch.setattr(ordered, "MIN_ROWS", 60)
    df = entry.queries()[name](spark, folder)
    assert compare(df, duck(folder), entry.oracle_sql()[name]) is None
