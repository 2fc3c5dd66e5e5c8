import pytest

from graphloom import catalog
from tests import oracle

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    assert oracle.rows(QUERIES[name](spark, small)) == oracle.expected(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


def _keys(*names):
    """Sort key of a row: columns by name, ``-`` for falling."""
    return lambda r: tuple(-r[n[1:]] if n[0] == "-" else r[n] for n in names)


#: Queries that promise an order of their rows.
ORDERED = {
    "scan_nodes": ["node_id"], "scan_edges": ["edge_id"], "get_nodes_layer": ["node_id"], "get_edges_source": ["edge_id"], "get_adjacent": ["edge_id"], "dangling_nodes": ["node_id"], "transitions": ["source", "target", "edge_id"],
    "transitions_page": ["position"], "passages_by_ids": ["ord"], "facts_by_ids": ["ord"], "schemas_by_ids": ["ord"], "facts_by_entities": ["fact_id"], "active_facts": ["pos"], "utf16_order": ["node_id"],
    "vector_search": ["-score", "id"], "vector_search_threshold": ["-score", "id"], "lexical_search": ["-score", "passage_id"], "fact_expand": ["-score", "fact_id"],
    "flagship": ["n"], "match_order_skip_limit": ["id"], "with_alias": ["id"], "rel_order_skip_limit": ["n"],
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_order_of_rows(spark, small, name):
    rows = [r.asDict() for r in QUERIES[name](spark, small).collect()]
    assert rows and rows == sorted(rows, key=_keys(*ORDERED[name]))
