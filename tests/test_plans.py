"""Plans that scale: pushed filters, pruned columns, limits before shuffles, no product of tables."""

import re

import pytest

from karstwell.plans.registry import QUERIES


def plan(spark, smoke, name, mode="formatted"):
    return QUERIES[name](spark, smoke)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_filters_and_columns_reach_the_scan(spark, smoke):
    p = plan(spark, smoke, "j17_unreferenced_files")
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in p  # no text
    assert "ReadSchema: struct<doc_id:bigint>" in p
    assert "PushedFilters: [IsNotNull(l_orderkey)]" not in p
    assert "GreaterThan(n_chars,100)" in plan(spark, smoke, "f14_raw_sql")
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string,n_chars:bigint>" not in plan(spark, smoke, "f8_prefix_scope")


@pytest.mark.parametrize("name", ["f1_regex_search", "v1_semantic_search", "v3_similar_chunks", "v5_search_by_vector", "a9_top_files"])
def test_pages_are_top_k(spark, smoke, name):
    assert "TakeOrderedAndProject" in plan(spark, smoke, name)


@pytest.mark.parametrize("name", ["d2_dedup_exact", "d4_dedup_embeddings", "d6_dedup_keep_best", "d13_ledger_constants", "v22_symbol_search"])
def test_first_of_each_key_is_limited_before_the_shuffle(spark, smoke, name):
    p = plan(spark, smoke, name, "simple")
    assert re.search(r"WindowGroupLimit.*Final.*Exchange.*WindowGroupLimit.*Partial", p, re.S)


@pytest.mark.parametrize("name", [n for n in QUERIES if n[0] in "fjd" or n.startswith(("p1", "a4", "a12", "t"))])
def test_no_cartesian_product(spark, smoke, name):
    p = plan(spark, smoke, name, "simple")
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["v1_semantic_search", "p3_chunk_metrics", "a14_cluster_quality", "j6_line_range_overlap", "r5_line_coverage", "t8_pressure"])
def test_no_python(spark, smoke, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, smoke, name, "simple"))
