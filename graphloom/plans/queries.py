"""Cypher queries over the relational graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import cypher_view, number
from graphloom.plans.cypher import Graph
from graphloom.sources import fixtures
from graphloom.sources.fixtures import with_views

FLAGSHIP = "MATCH (n)-[r]->(m) WHERE r.weight > 100000 RETURN n,r,m ORDER BY n.id LIMIT 100"


def _graph(spark: SparkSession, d: str) -> Graph:
    return Graph(*fixtures.property_graph(spark, d))


def _nodes(df: DataFrame) -> DataFrame:
    return df.select("id", F.array_join("labels", ":").alias("label"))


def _read(text: str, dialect: str | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        result = _graph(spark, d).query(text, dialect)
        return _nodes(result.df) if result.kind == "nodes" else result.df

    return run


def _post(text: str, *names: str):
    """Post-state of a write: the nodes with the named properties."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        result = _graph(spark, d).query(text)
        props = [F.coalesce(F.col("properties")[n]["s"], F.col("properties")[n]["i"].cast("string")).alias(n.lower()) for n in names]
        return result.nodes.select("id", F.array_join("labels", ":").alias("label"), *props)

    return run


def detach_post(spark: SparkSession, d: str) -> DataFrame:
    result = _graph(spark, d).query("DELETE NODE 'nation:3' DETACH")
    return result.nodes.select(F.lit("node").alias("kind"), "id").unionByName(result.edges.select(F.lit("edge").alias("kind"), "id"))


def _corpus_view(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = fixtures.g_nodes(spark, d).withColumn("ref", F.lit("{}"))
    return cypher_view(nodes, fixtures.g_edges(spark, d).withColumn("bridge_kind", F.lit(None).cast("string")), "tpch")


def view_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = _corpus_view(spark, d)
    return nodes.select("id", F.array_join("labels", ":").alias("label"), F.col("properties")["nodeId"]["s"].alias("node_id"), F.col("properties")["layer"]["s"].alias("layer"))


def view_edges(spark: SparkSession, d: str) -> DataFrame:
    _, edges = _corpus_view(spark, d)
    return edges.select("id", "from", "to", "edge_type", F.round(number(F.col("properties"), "weight"), 2).alias("weight"))


_N, _E, _NE = with_views("g_nodes"), with_views("g_edges"), with_views("g_nodes", "g_edges")
_ROWS = "SELECT source_node_id AS n, edge_id AS r, target_node_id AS m FROM g_edges"
_BACK = "SELECT target_node_id AS n, edge_id AS r, source_node_id AS m FROM g_edges"
_ALONE = "SELECT node_id AS n, 'NULL' AS r, 'NULL' AS m FROM g_nodes WHERE node_id NOT IN"
_PROPS = ", corpus_id AS corpusid, layer"

QUERIES = {
    "flagship": _read(FLAGSHIP),
    "match_label": _read("MATCH (n:Customer) RETURN n"),
    "match_where_id": _read("MATCH (n:Nation) WHERE n.id = 'nation:7' RETURN n"),
    "match_order_skip_limit": _read("MATCH (n) RETURN n ORDER BY n.id SKIP 20 LIMIT 30"),
    "optional_node": _read("OPTIONAL MATCH (n:Supplier) RETURN n"),
    "with_alias": _read("MATCH (n:Region) WITH n AS place RETURN place ORDER BY place.id"),
    "exists_uncorrelated": _read("MATCH (n:Nation) WHERE EXISTS { MATCH (m)-[r]->(k) WHERE r.weight > 1000 RETURN m,r,k } RETURN n"),
    "rel_directed": _read("MATCH (n)-[r]->(m) RETURN n,r,m"),
    "rel_undirected": _read("MATCH (n)-[r]-(m) WHERE r.weight > 200000 RETURN n,r,m"),
    "rel_weight_filter": _read("MATCH (n)-[r]->(m) WHERE r.weight > 150000.5 RETURN n,r,m"),
    "rel_optional": _read("OPTIONAL MATCH (n)-[r]->(m) WHERE r.weight > 150000 RETURN n,r,m"),
    "rel_optional_undirected": _read("OPTIONAL MATCH (n)-[r]-(m) WHERE r.weight > 150000 RETURN n,r,m"),
    "rel_order_skip_limit": _read("MATCH (n)-[r]->(m) WITH n,r,m RETURN n,r,m ORDER BY n.id SKIP 50 LIMIT 100"),
    "rel_type_filter": _read("MATCH (n:Nation)-[r:IN_REGION]->(m) RETURN n,r,m", "extended"),
    "case_literal": _read("RETURN CASE WHEN 1 = 1.0 THEN 'same' ELSE 'other' END"),
    "call_count": _read("CALL { MATCH (n:Part) RETURN n } RETURN count(*)"),
    "call_star": _read("CALL { MATCH (n:Supplier) RETURN n } RETURN *"),
    "unwind_count": _read("UNWIND [1, 'a,b', true] AS x RETURN count(x)"),
    "unwind_collect": _read("UNWIND ['b', 'a', 'b'] AS x RETURN collect(x)"),
    "unwind_sum": _read("UNWIND [1, 2.5, 4] AS x RETURN sum(x)"),
    "unwind_avg": _read("UNWIND [1, 2, 6] AS x RETURN avg(x)"),
    "unwind_min": _read("UNWIND [3, NaN, 1.5] AS x RETURN min(x)"),
    "unwind_max": _read("UNWIND [3, inf, 1.5] AS x RETURN max(x)"),
    "unwind_rows": _read("UNWIND [3, 1, 3] AS x RETURN x"),
    "meta_schema": _read("CALL apoc.meta.schema()"),
    "union_nodes": _read("MATCH (n:Region) RETURN n UNION MATCH (n:Nation) RETURN n UNION MATCH (n:Region) RETURN n"),
    "union_rows": _read("MATCH (n)-[r]->(m) WHERE r.weight > 300000 RETURN n,r,m UNION MATCH (n)-[r]->(m) WHERE r.weight > 250000 RETURN n,r,m"),
    "union_all": _read("MATCH (n:Region) RETURN n UNION ALL MATCH (n:Region) RETURN n"),
    "apoc_to_set": _read("CALL apoc.coll.toSet(['b', 'a', 'b', 'c'])"),
    "apoc_text_join": _read("CALL apoc.text.join(['a', 1, 2.0, true], '-')"),
    "apoc_rename_label": _read("CALL apoc.refactor.rename.label('Customer', 'Client')"),
    "cypher_create_post": _post("CREATE (x:Region {name: 'Atlantis', corpusId: 'new'})", "name", "corpusId"),
    "cypher_merge_post": _post("MERGE (x:Nation {layer: 'ontology'}) ON CREATE SET note = 'made' ON MATCH SET note = 'seen'", "note", "layer"),
    "cypher_set_post": _post("SET NODE 'region:1' layer = 'top', rank = 4", "layer", "rank"),
    "cypher_remove_post": _post("REMOVE NODE 'region:1' layer", "layer", "corpusId"),
    "cypher_detach_post": detach_post,
    "cypher_view_nodes": view_nodes,
    "cypher_view_edges": view_edges,
}

SQL = {
    "flagship": _E + _ROWS + " WHERE weight > 100000 ORDER BY n, r, m LIMIT 100",
    "match_label": _N + "SELECT node_id AS id, label FROM g_nodes WHERE label = 'Customer'",
    "match_where_id": _N + "SELECT node_id AS id, label FROM g_nodes WHERE label = 'Nation' AND node_id = 'nation:7'",
    "match_order_skip_limit": _N + "SELECT node_id AS id, label FROM g_nodes ORDER BY node_id LIMIT 30 OFFSET 20",
    "optional_node": _N + "SELECT node_id AS id, label FROM g_nodes WHERE label = 'Supplier'",
    "with_alias": _N + "SELECT node_id AS id, label FROM g_nodes WHERE label = 'Region'",
    "exists_uncorrelated": _NE + "SELECT node_id AS id, label FROM g_nodes WHERE label = 'Nation' AND EXISTS (SELECT 1 FROM g_edges WHERE weight > 1000)",
    "rel_directed": _E + _ROWS,
    "rel_undirected": _E + f"{_ROWS} WHERE weight > 200000 UNION ALL {_BACK} WHERE weight > 200000",
    "rel_weight_filter": _E + _ROWS + " WHERE weight > 150000.5",
    "rel_optional": _NE + f"{_ROWS} WHERE weight > 150000 UNION ALL {_ALONE} (SELECT source_node_id FROM g_edges WHERE weight > 150000)",
    "rel_optional_undirected": _NE + f"{_ROWS} WHERE weight > 150000 UNION ALL {_BACK} WHERE weight > 150000 UNION ALL {_ALONE} (SELECT source_node_id FROM g_edges WHERE weight > 150000 UNION SELECT target_node_id FROM g_edges WHERE weight > 150000)",
    "rel_order_skip_limit": _E + _ROWS + " ORDER BY n, r, m LIMIT 100 OFFSET 50",
    "rel_type_filter": _E + _ROWS + " WHERE relation = 'IN_REGION'",
    "case_literal": "SELECT 'other' AS \"case\"",
    "call_count": _N + "SELECT CAST(count(*) AS BIGINT) AS count FROM g_nodes WHERE label = 'Part'",
    "call_star": _N + "SELECT node_id AS id, label FROM g_nodes WHERE label = 'Supplier'",
    "unwind_count": "SELECT CAST(3 AS BIGINT) AS count",
    "unwind_collect": "SELECT ['b', 'a', 'b'] AS collect",
    "unwind_sum": "SELECT CAST(7.5 AS DOUBLE) AS sum",
    "unwind_avg": "SELECT CAST(3 AS DOUBLE) AS avg",
    "unwind_min": "SELECT CAST(1.5 AS DOUBLE) AS min",
    "unwind_max": "SELECT CAST(0 AS DOUBLE) AS max",
    "unwind_rows": "SELECT CAST(unnest([3, 1, 3]) AS BIGINT) AS x",
    "meta_schema": _NE + "SELECT CAST((SELECT count(*) FROM g_nodes) AS BIGINT) AS nodes, CAST((SELECT count(*) FROM g_edges) AS BIGINT) AS relationships",
    "union_nodes": _N + "SELECT node_id AS id, label FROM g_nodes WHERE label IN ('Region', 'Nation')",
    "union_rows": _E + _ROWS + " WHERE weight > 250000",
    "union_all": _N + "SELECT node_id AS id, label FROM g_nodes WHERE label = 'Region' UNION ALL SELECT node_id, label FROM g_nodes WHERE label = 'Region'",
    "apoc_to_set": "SELECT ['b', 'a', 'c'] AS values",
    "apoc_text_join": "SELECT 'a-1-2-true' AS value",
    "apoc_rename_label": _N + "SELECT CAST(count(*) AS BIGINT) AS updatedNodeCount FROM g_nodes WHERE label = 'Customer'",
    "cypher_create_post": _N + "SELECT node_id AS id, label, CAST(NULL AS VARCHAR) AS name, corpus_id AS corpusid FROM g_nodes UNION ALL SELECT 'n1', 'Region', 'Atlantis', 'new'",
    "cypher_merge_post": _N + "SELECT node_id AS id, label, CASE WHEN node_id = (SELECT min(node_id) FROM g_nodes WHERE label = 'Nation' AND layer = 'ontology') THEN 'seen' END AS note, layer FROM g_nodes",
    "cypher_set_post": _N + "SELECT node_id AS id, label, CASE WHEN node_id = 'region:1' THEN 'top' ELSE layer END AS layer, CASE WHEN node_id = 'region:1' THEN '4' END AS rank FROM g_nodes",
    "cypher_remove_post": _N + "SELECT node_id AS id, label, CASE WHEN node_id = 'region:1' THEN NULL ELSE layer END AS layer, corpus_id AS corpusid FROM g_nodes",
    "cypher_detach_post": _NE + "SELECT 'node' AS kind, node_id AS id FROM g_nodes WHERE node_id <> 'nation:3' UNION ALL SELECT 'edge', edge_id FROM g_edges WHERE source_node_id <> 'nation:3' AND target_node_id <> 'nation:3'",
    "cypher_view_nodes": _N + "SELECT 'n' || row_number() OVER (ORDER BY corpus_id, node_id) AS id, label, node_id, layer FROM g_nodes",
    "cypher_view_edges": _NE.rstrip() + ",\nv AS (SELECT node_id, 'n' || row_number() OVER (ORDER BY corpus_id, node_id) AS id FROM g_nodes)\nSELECT 'e' || row_number() OVER (ORDER BY e.corpus_id, e.edge_id) AS id, a.id AS \"from\", b.id AS \"to\", relation AS edge_type, round(weight, 2) AS weight FROM g_edges e JOIN v a ON a.node_id = e.source_node_id JOIN v b ON b.node_id = e.target_node_id",
}
