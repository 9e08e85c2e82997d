"""How the queries of cards and of blocks are shuffled: once by locus, without rows multiplied for distinct counts, ties found once."""

import re

import pytest

from locuskit.operators import cards
from locuskit.plans import cards as plans
from tests.test_operators import rows


@pytest.mark.parametrize("name", ["r21_structure_differences", "r22_decision_focus", "r23_card_gates"])
def test_sets_are_dealt_once_while_narrow(spark, name):
    plan = getattr(plans, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange (?:hash|range)partitioning\((\w+)#", plan)
    assert dealt and set(dealt) == {"l_orderkey"} and "Expand" not in plan


def test_differences_with_missing_values(spark):
    """Missing values are no values: a locus that has none of them is not told apart by them."""
    schema = "locus int, set_id string, evidence struct<coding_qc:string,short_read_junction:string,long_read:string,protein:string>"
    given = [(1, "a", ("pass", "", None, "x")), (1, "b", ("fail", None, "exact", "x")), (2, "a", (None, None, None, None))]
    got = {r.locus: (r.shared, r.differing) for r in cards.evidence_differences(rows(spark, given, schema)).collect()}
    assert got == {1: (["long_read=exact", "protein=x"], ["coding_qc"]), 2: ([], [])}


def test_lines_are_tied_to_their_blocks_once(spark):
    from locuskit.plans import export

    plan = export.k06_policy_blocks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
