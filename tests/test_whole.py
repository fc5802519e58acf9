"""Registered queries read whole tables."""

import os
import re
from collections import defaultdict

import pytest

from fjordgraph.plans import catalog
from fjordgraph.plans import tables as t

SF = "/root/testdata/sf0.001"


def test_no_thinned_graph_in_sql():
    assert not [q for q, sql in catalog.ORACLE_SQL.items() if "% 9 = 0" in sql or re.search(r"o_orderkey < \\d", sql)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_part_graph_has_all_edges(spark):
    orders = defaultdict(list)
    for r in t.table(spark, SF, "lineitem").collect():
        orders[r.l_orderkey].append((r.l_linenumber, r.l_partkey, r.l_suppkey))
    chain = {(a[1], b[1]) for rows in orders.values() for a, b in zip(sorted(rows), sorted(rows)[1:])}
    got = [(r.dst, r.src) for r in catalog.QUERIES["transpose"](spark, SF).collect()]
    assert len(got) == len(chain) and set(got) == chain
