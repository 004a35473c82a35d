"""What the optimiser makes of the queries: filters and columns reach the scan, nothing runs in one task, nothing in Python that needn't."""

import re

import pytest

from merkleframe.plans import registry

SF = "/root/testdata/sf0.001"
#: These cut, compress, match or fill in Python, by their nature.
IN_PYTHON = {"fastcdc_chunks", "zstd_chunk_sizes", "needle_scan", "pack_fill", "pack_seal", "pack_footer_index"}
#: These number or add up within a page of a stated limit, or one row for each partition.
ONE_TASK_WINDOWS = {"page_by_bytes", "frozen_set_page", "facts_page", "prefix_scan_page"}


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = registry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString(), df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text, _ = plan(spark, "object_point_lookup")
    assert "EqualTo(p_partkey,42)" in text and re.search(r"ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string>", text)
    text, _ = plan(spark, "prefix_scan_page")
    assert "GreaterThan(url,http://b)" in text and "LessThan(url,http:/0)" in text and "html" not in text
    text, _ = plan(spark, "payload_batch")
    assert re.search(r"ReadSchema: struct<p_partkey:bigint,p_name:string>", text) and "p_brand" not in text
    text, _ = plan(spark, "tree_list")
    assert "EqualTo(l_orderkey,101)" in text and "l_shipdate" not in text


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - {n for n in registry.oracle_sql() if n in IN_PYTHON}))
def test_no_python_and_no_single_task(spark, name):
    text, whole = plan(spark, name)
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|FlatMapGroups", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in ONE_TASK_WINDOWS:
        windows = re.findall(r"(Window [^\n]*)\n[^\n]*(?:Sort[^\n]*\n[^\n]*)?Exchange SinglePartition", text)
        assert all(w.startswith("Window [sum(_sum#") for w in windows)
