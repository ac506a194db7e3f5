"""Every registered query against its SQL on the smallest tables, with a look at its plan."""

import os
import re

import pytest

import __spark_entry__ as contract
from workload.oracles import ORACLES
from workload.queries import QUERIES
from workload.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BANNED = ["EvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = plan_of(df)
    assert not [b for b in BANNED if b in plan]
    assert compare(df, con, ORACLES[name]) == ""


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_flagship_shuffles_once_on_the_group(spark):
    plan = plan_of(QUERIES["deployment_summary"](spark, SF_DIR))
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    # The other exchange belongs to the view that makes nodes from order lines.
    assert keys.count("grp") == 1 and len(keys) == 2
    assert "l_comment" not in plan and "l_shipdate" not in plan


def test_listing_shuffles_nodes_once(spark):
    plan = plan_of(QUERIES["nested_documents"](spark, SF_DIR))
    assert len(re.findall(r"Exchange hashpartitioning\(grp#", plan)) == 1
    assert "Join" not in plan


def test_planning_is_one_narrow_stage(spark):
    plan = plan_of(QUERIES["topology_labels"](spark, SF_DIR))
    assert "Exchange" not in plan and "Union" not in plan


def test_masking_is_one_narrow_stage(spark):
    assert "Exchange" not in plan_of(QUERIES["mask_credentials"](spark, SF_DIR))


def test_host_strings_move_only_what_they_show(spark):
    plan = plan_of(QUERIES["host_strings"](spark, SF_DIR))
    for part in re.findall(r"Exchange hashpartitioning\(grp#[^\n]*\n[^\n]*Project \[([^\n]*)\]", plan):
        assert not re.search(r"\b(id|data_dir|container_data_dir|image_tags|ports|arbiter)#", part)
