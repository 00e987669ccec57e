"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from compare import open_tables, spark_table, sql_table
from surveyloom.plans import ENTRIES

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: contract.queries()[name] for name in ENTRIES}
SQL = {name: sql for name, sql in contract.oracle_sql().items() if name in ENTRIES}


@pytest.fixture(scope="module")
def engine():
    return open_tables(FOLDER)


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, engine, name):
    assert spark_table(QUERIES[name](spark, FOLDER)) == sql_table(engine, SQL[name])


LARGER = "/root/testdata/sf0.01"
# Fits and trees, whose losses and steps grow with the table.
FITTED = sorted(n for n in SQL if "stump" in n or n.startswith(("glm_", "odds_", "stepwise", "heart_profile", "quantile_sketch")))


@pytest.mark.parametrize("name", FITTED)
def test_fit_equals_its_sql_on_more_rows(spark, name):
    assert spark_table(QUERIES[name](spark, LARGER)) == sql_table(open_tables(LARGER), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_the_survey_tree_is_pruned_to_more_than_its_root(spark):
    nodes = QUERIES["heart_tree_nodes"](spark, LARGER).collect()
    leaves = [r for r in nodes if r.is_leaf]
    assert len(nodes) == 2 * len(leaves) - 1 >= 3 and sum(r.n for r in leaves) == nodes[0].n
    choice = QUERIES["heart_tree_choice"](spark, LARGER).first()
    table = sorted(QUERIES["heart_tree_cp"](spark, LARGER).collect(), key=lambda r: -r.cp)
    chosen = table[choice.optimal_index - 1]
    assert chosen.nsplit == len(leaves) - 1 and chosen.cp <= choice.cp <= table[choice.optimal_index - 2].cp
    cells = {(r.actual, r.predicted): r for r in QUERIES["heart_tree_confusion"](spark, LARGER).collect()}
    assert abs(sum(r.prop for r in cells.values()) - 1) < 1e-12
    assert abs(cells["No", "No"].prop + cells["Yes", "Yes"].prop - cells["No", "No"].accuracy) < 1e-12


def test_profile_limits_hold_the_odds_ratios(spark):
    for r in QUERIES["heart_odds_ratios"](spark, LARGER).collect():
        assert 0 < r.lower < r.odds_ratio < r.upper


def test_entry(spark):
    assert contract.entry(spark).count() == 40
