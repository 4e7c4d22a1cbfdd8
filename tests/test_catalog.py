"""Every catalog query against its DuckDB oracle, on the smallest tables."""

import pytest
from oracle import assert_same, connect

from slackline import catalog
from slackline.sources import bindings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_potentials_of_the_whole_circle_match_brute_force(spark):
    n = {r["id"]: r["wf"] for r in bindings.nodes(spark, SF).select("id", "wf").collect()}
    d = lambda a, b: min(abs(a - b), 64 - abs(a - b))
    pairs = [(a, b) for a in range(64) for b in range(64)]
    full = {r["id"]: r for r in catalog.QUERIES["canonical_potential_full"](spark, SF).collect()}
    evader = {r["id"]: r["phi"] for r in catalog.QUERIES["evader_potential_full"](spark, SF).collect()}
    part = {r["id"]: r["value"] for r in catalog.QUERIES["canonical_potential"](spark, SF).collect()}
    assert full.keys() == evader.keys() == n.keys()
    for i in sorted(n)[:40]:
        w = n[i]
        values = [w[a] + w[(b + 32) % 64] - 2 * d(a, b) for a, b in pairs]
        assert full[i]["value"] == min(values) and values[full[i]["a_id"]] == min(values)
        assert evader[i] == min(w[a] + w[b] - d(a, b) for a, b in pairs)
    assert all(full[i]["value"] == part[i] for i in n)
