"""A graph store, vectors, facts and passages derived from the relational tables.

Each view exists twice: as a DataFrame here and as text for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import fixed_properties
from graphloom.session import table

SQL_VIEWS = {
    "g_nodes": """SELECT 'tpch' AS corpus_id, 'region:' || r_regionkey AS node_id, 'ontology' AS layer, 'Region' AS label FROM region
UNION ALL SELECT 'tpch', 'nation:' || n_nationkey, 'ontology', 'Nation' FROM nation
UNION ALL SELECT 'tpch', 'customer:' || c_custkey, 'entity', 'Customer' FROM customer
UNION ALL SELECT 'tpch', 'supplier:' || s_suppkey, 'entity', 'Supplier' FROM supplier
UNION ALL SELECT 'tpch', 'part:' || p_partkey, 'passage', 'Part' FROM part
UNION ALL SELECT 'tpch', 'order:' || o_orderkey, 'fact', 'Order' FROM orders""",
    "g_edges": """SELECT 'tpch' AS corpus_id, 'placed:' || o_orderkey AS edge_id, 'customer:' || o_custkey AS source_node_id, 'order:' || o_orderkey AS target_node_id, 'PLACED' AS relation, CAST(o_totalprice AS DOUBLE) AS weight FROM orders
UNION ALL SELECT 'tpch', 'in-nation:c:' || c_custkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION', CAST(1 AS DOUBLE) FROM customer
UNION ALL SELECT 'tpch', 'in-nation:s:' || s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION', CAST(1 AS DOUBLE) FROM supplier
UNION ALL SELECT 'tpch', 'in-region:' || n_nationkey, 'nation:' || n_nationkey, 'region:' || n_regionkey, 'IN_REGION', CAST(1 AS DOUBLE) FROM nation
UNION ALL SELECT 'tpch', 'contains:' || l_orderkey || ':' || l_partkey, 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', CAST(SUM(l_quantity) AS DOUBLE) FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "g_vectors": """SELECT 'memory' AS corpus_id, 'passage:' || vec_id AS id, 'label' || label AS namespace, CAST(embedding AS DOUBLE[]) AS vals, '' || vec_id AS document_id FROM embeddings""",
    "g_lexical": """SELECT 'memory' AS corpus_id, '' || doc_id AS passage_id, source AS document_id, text FROM documents""",
    "g_facts": """SELECT 'memory' AS corpus_id, event_id AS pos, 'f' || event_id AS fact_id, event_type AS schema_id, CASE WHEN event_id % 4 = 0 THEN 'inactive' ELSE 'active' END AS state,
'User ' || user_id AS head_entity, event_type AS relation, 'Key ' || json_extract_string(props, '$.k') AS tail_entity, '' || (event_id % (SELECT COUNT(*) FROM documents)) AS passage_id, CAST(value AS DOUBLE) AS confidence FROM events""",
    "g_schemas": """SELECT 'memory' AS corpus_id, event_type AS schema_id, CAST(COUNT(*) AS BIGINT) AS frequency, CASE WHEN COUNT(*) >= 2000 THEN 'stable' ELSE 'pending' END AS state FROM events GROUP BY event_type""",
    "m_edges": """SELECT 'memory' AS corpus_id, 'schema-instance:' || schema_id || ':' || fact_id AS edge_id, 'schema:' || schema_id AS source_node_id, 'fact:' || fact_id AS target_node_id, 'schema_instance' AS relation, CAST(1 AS DOUBLE) AS weight FROM g_facts
UNION ALL SELECT 'memory', 'fact-evidence:' || fact_id || ':' || passage_id, 'fact:' || fact_id, 'passage:' || passage_id, 'fact_evidence', confidence FROM g_facts
UNION ALL SELECT 'memory', 'passage-fact:' || passage_id || ':' || fact_id, 'passage:' || passage_id, 'fact:' || fact_id, 'passage_fact', CAST(1 AS DOUBLE) FROM g_facts
UNION ALL SELECT 'memory', 'entity-cooccur:' || lower(head_entity) || ':' || lower(tail_entity) || ':' || fact_id, 'entity:' || lower(head_entity), 'entity:' || lower(tail_entity), 'entity_cooccurrence', CAST(1 AS DOUBLE) FROM g_facts
UNION ALL SELECT 'memory', 'entity-mention:' || lower(head_entity) || ':' || passage_id, 'entity:' || lower(head_entity), 'passage:' || passage_id, 'entity_mention', CAST(COUNT(*) AS DOUBLE) FROM g_facts GROUP BY lower(head_entity), passage_id""",
    "m_nodes": """SELECT 'memory' AS corpus_id, node_id, CASE split_part(node_id, ':', 1) WHEN 'schema' THEN 'ontology' ELSE split_part(node_id, ':', 1) END AS layer FROM (SELECT source_node_id AS node_id FROM m_edges UNION SELECT target_node_id FROM m_edges)""",
}
_NEEDS = {"m_edges": ["g_facts"], "m_nodes": ["g_facts", "m_edges"]}


def with_views(*names: str) -> str:
    """``WITH`` clause of the named views and those they need."""
    wanted = [v for v in SQL_VIEWS if v in names or any(v in _NEEDS.get(n, []) for n in names)]
    return "WITH " + ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in wanted) + "\n"


def _text(prefix: str, *parts: str):
    out = [F.lit(prefix)]
    for i, p in enumerate(parts):
        out += [F.lit(":")] * bool(i) + [F.col(p).cast("string")]
    return F.concat(*out)


def g_nodes(spark: SparkSession, d: str) -> DataFrame:
    kinds = (("region", "region:", "r_regionkey", "ontology", "Region"), ("nation", "nation:", "n_nationkey", "ontology", "Nation"), ("customer", "customer:", "c_custkey", "entity", "Customer"),
             ("supplier", "supplier:", "s_suppkey", "entity", "Supplier"), ("part", "part:", "p_partkey", "passage", "Part"), ("orders", "order:", "o_orderkey", "fact", "Order"))
    out = None
    for name, prefix, key, layer, label in kinds:
        df = table(spark, d, name).select(F.lit("tpch").alias("corpus_id"), _text(prefix, key).alias("node_id"), F.lit(layer).alias("layer"), F.lit(label).alias("label"))
        out = df if out is None else out.unionByName(df)
    return out


def g_edges(spark: SparkSession, d: str) -> DataFrame:
    def edge(df: DataFrame, edge_id, source, target, relation: str, weight=None) -> DataFrame:
        weight = F.lit(1.0) if weight is None else weight
        return df.select(F.lit("tpch").alias("corpus_id"), edge_id.alias("edge_id"), source.alias("source_node_id"), target.alias("target_node_id"), F.lit(relation).alias("relation"), weight.cast("double").alias("weight"))

    orders, customer, supplier, nation = (table(spark, d, t) for t in ("orders", "customer", "supplier", "nation"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return (
        edge(orders, _text("placed:", "o_orderkey"), _text("customer:", "o_custkey"), _text("order:", "o_orderkey"), "PLACED", F.col("o_totalprice"))
        .unionByName(edge(customer, _text("in-nation:c:", "c_custkey"), _text("customer:", "c_custkey"), _text("nation:", "c_nationkey"), "IN_NATION"))
        .unionByName(edge(supplier, _text("in-nation:s:", "s_suppkey"), _text("supplier:", "s_suppkey"), _text("nation:", "s_nationkey"), "IN_NATION"))
        .unionByName(edge(nation, _text("in-region:", "n_nationkey"), _text("nation:", "n_nationkey"), _text("region:", "n_regionkey"), "IN_REGION"))
        .unionByName(edge(lines, _text("contains:", "l_orderkey", "l_partkey"), _text("order:", "l_orderkey"), _text("part:", "l_partkey"), "CONTAINS", F.col("q")))
    )


def property_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The relational graph as a property graph for the Cypher front end."""
    nodes, edges = g_nodes(spark, d), g_edges(spark, d)
    return (
        nodes.select(F.col("node_id").alias("id"), F.array("label").alias("labels"), fixed_properties(corpusId=(F.col("corpus_id"), "s"), layer=(F.col("layer"), "s")).alias("properties")),
        edges.select(F.col("edge_id").alias("id"), F.col("source_node_id").alias("from"), F.col("target_node_id").alias("to"), F.col("relation").alias("edge_type"), fixed_properties(weight=(F.col("weight"), "d")).alias("properties")),
    )


def g_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.lit("memory").alias("corpus_id"), _text("passage:", "vec_id").alias("id"), _text("label", "label").alias("namespace"), F.col("embedding").cast("array<double>").alias("values"), F.col("vec_id").cast("string").alias("document_id")
    )


def g_lexical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.lit("memory").alias("corpus_id"), F.col("doc_id").cast("string").alias("passage_id"), F.col("source").alias("document_id"), "text")


def g_facts(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").count()
    return table(spark, d, "events").select(
        F.lit("memory").alias("corpus_id"),
        F.col("event_id").alias("pos"),
        _text("f", "event_id").alias("fact_id"),
        F.col("event_type").alias("schema_id"),
        F.when(F.col("event_id") % 4 == 0, "inactive").otherwise("active").alias("state"),
        _text("User ", "user_id").alias("head_entity"),
        F.col("event_type").alias("relation"),
        F.concat(F.lit("Key "), F.get_json_object("props", "$.k")).alias("tail_entity"),
        (F.col("event_id") % documents).cast("string").alias("passage_id"),
        F.col("value").cast("double").alias("confidence"),
    )


def g_schemas(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("schema_id")).agg(F.count(F.lit(1)).alias("frequency"))
    return n.select(F.lit("memory").alias("corpus_id"), "schema_id", "frequency", F.when(F.col("frequency") >= 2000, "stable").otherwise("pending").alias("state"))


def m_edges(spark: SparkSession, d: str) -> DataFrame:
    facts = g_facts(spark, d)
    head, tail = F.lower("head_entity"), F.lower("tail_entity")

    def edge(df: DataFrame, relation: str, edge_id, source, target, weight) -> DataFrame:
        return df.select(F.lit("memory").alias("corpus_id"), edge_id.alias("edge_id"), source.alias("source_node_id"), target.alias("target_node_id"), F.lit(relation).alias("relation"), weight.cast("double").alias("weight"))

    def c(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    f, p, s = F.col("fact_id"), F.col("passage_id"), F.col("schema_id")
    mentions = facts.groupBy(head.alias("head"), "passage_id").agg(F.count(F.lit(1)).alias("n"))
    one = F.lit(1.0)
    return (
        edge(facts, "schema_instance", c("schema-instance:", s, ":", f), c("schema:", s), c("fact:", f), one)
        .unionByName(edge(facts, "fact_evidence", c("fact-evidence:", f, ":", p), c("fact:", f), c("passage:", p), F.col("confidence")))
        .unionByName(edge(facts, "passage_fact", c("passage-fact:", p, ":", f), c("passage:", p), c("fact:", f), one))
        .unionByName(edge(facts, "entity_cooccurrence", c("entity-cooccur:", head, ":", tail, ":", f), c("entity:", head), c("entity:", tail), one))
        .unionByName(edge(mentions, "entity_mention", c("entity-mention:", F.col("head"), ":", p), c("entity:", F.col("head")), c("passage:", p), F.col("n")))
    )


def m_nodes(spark: SparkSession, d: str) -> DataFrame:
    edges = m_edges(spark, d)
    ids = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")).distinct()
    kind = F.split_part("node_id", F.lit(":"), F.lit(1))
    return ids.select(F.lit("memory").alias("corpus_id"), "node_id", F.when(kind == "schema", "ontology").otherwise(kind).alias("layer"))
