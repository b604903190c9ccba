"""Plan shapes of the registered queries: every scan of a large table reaches
its first shuffle through a partial aggregate (map-side combine), except the
funnel, whose stage rows go by session into their windows."""

import os

import pytest

import __spark_entry__ as entry
from tidemark.plans.inspect import plan_text

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="check tables not present")


def _tree(text):
    """(depth, node line) of the simple-mode plan tree."""
    nodes = []
    for line in text.splitlines():
        stripped = line.lstrip(" :+-")
        if not stripped or line.startswith("=="):
            continue
        nodes.append((len(line) - len(stripped), stripped))
    return nodes


def _scan_paths(text):
    """For each scan, the nodes from it up to the nearest Exchange."""
    nodes = _tree(text)
    paths = []
    for i, (depth, node) in enumerate(nodes):
        if not node.startswith("FileScan"):
            continue
        path, want = [], depth
        for j in range(i - 1, -1, -1):
            d, n = nodes[j]
            if d < want:
                path.append(n)
                want = d
                if n.startswith("Exchange") or n.startswith("BroadcastExchange"):
                    break
        paths.append((node.split("[")[0], path))
    return paths


@pytest.mark.parametrize("name", ["cohort_retention", "rfm_totals",
                                  "dq_audit", "kpis", "event_mix", "funnel_unordered"])
def test_scans_are_partially_aggregated_before_any_shuffle(spark, name):
    if name == "rfm_totals":      # what rfm_base writes
        from tidemark.operators import rfm
        df = rfm._customer_totals(entry.dt.transactions(spark, SF), "customer_id", "transaction_timestamp",
                                  "transaction_id", "amount", "status", entry.dt.COMPLETED, 2)
    else:
        df = entry.queries()[name](spark, SF)
    paths = _scan_paths(plan_text(df, "simple"))
    assert paths
    for scan, path in paths:
        if path and path[-1].startswith("Exchange"):
            assert any(n.startswith("HashAggregate") or n.startswith("ObjectHashAggregate")
                       for n in path[:-1]), (name, scan, path)


def test_funnel_stage_scans_prune_columns_and_filter(spark):
    text = plan_text(entry.queries()["funnel_by_device"](spark, SF), "simple")
    assert "In(event_type, [click,purchase,signup,view])" in text
    assert "value" not in "".join(line for line in text.splitlines() if "ReadSchema" in line)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_unordered_funnel_pushes_its_stages(spark):
    text = plan_text(entry.queries()["funnel_unordered"](spark, SF), "simple")
    assert "In(event_type, [click,purchase,signup,view])" in text


def test_cohorts_exchange_user_rows_once(spark):
    text = plan_text(entry.queries()["cohort_retention"](spark, SF), "simple")
    by = [line for line in text.splitlines() if "Exchange hashpartitioning(_u#" in line]
    assert len(by) == 1 and text.count("FileScan") == 1
    assert not any("Window" in n for n in _scan_paths(text)[0][1])


def test_audit_reads_each_table_once_in_one_exchange(spark):
    text = plan_text(entry.queries()["dq_audit"](spark, SF), "simple")
    assert text.count("FileScan") == 3 and "Join" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_rfm_base_reads_transactions_once(spark):
    base = entry.queries()["rfm_base"](spark, SF)
    assert "FileScan" not in plan_text(base)          # the totals were written on that one read


def test_rfm_scores_put_no_customers_in_one_task(spark):
    text = plan_text(entry.queries()["rfm_scores"](spark, SF), "simple")
    assert "SinglePartition" not in text and "Window" not in text and "Exchange" not in text
