"""Queries of the general data problems, over whole tables, and their SQL."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hot_keys, nested, references
from graphloom.session import shared_folder, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = hot_keys.eager_join_aggregate(
        table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"), on=[("corpus_id", "corpus_id")], by=["corpus_id"]
    )
    return hot_keys.hot_keys(rolled, "corpus_id", "nodes", "edges")


def p1_corpus_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per corpus: rows of both tables, and edges joined with the versions of their source node."""
    rolled = hot_keys.eager_join_aggregate(
        table(spark, sf_dir, "nodes"),
        table(spark, sf_dir, "edges"),
        on=[("corpus_id", "corpus_id"), ("node_id", "source_node_id")],
        by=["corpus_id"],
        left_sums={"labelled": F.when(F.col("label").isNotNull(), 1).otherwise(0)},
        right_sums={"weight": F.col("weight").cast("decimal(20,6)")},
    )
    return rolled.select(
        "corpus_id",
        F.col("left_rows").alias("node_rows"),
        F.col("right_rows").alias("edge_rows"),
        F.col("pairs").alias("joined_rows"),
        F.coalesce("labelled", F.lit(0)).cast("bigint").alias("labelled_joined"),
        F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("joined_weight"),
    )


_P1_CORPUS_JOIN = """
WITH n AS (SELECT corpus_id, count(*) AS c FROM nodes GROUP BY corpus_id),
e AS (SELECT corpus_id, count(*) AS c FROM edges GROUP BY corpus_id),
j AS (SELECT n.corpus_id, count(*) AS c, sum(CASE WHEN n.label IS NOT NULL THEN 1 ELSE 0 END) AS l,
             sum(CAST(e.weight AS DECIMAL(20,6))) AS w
      FROM nodes n JOIN edges e ON n.corpus_id = e.corpus_id AND n.node_id = e.source_node_id GROUP BY n.corpus_id)
SELECT coalesce(n.corpus_id, e.corpus_id) AS corpus_id, CAST(coalesce(n.c, 0) AS BIGINT) AS node_rows,
       CAST(coalesce(e.c, 0) AS BIGINT) AS edge_rows, CAST(coalesce(j.c, 0) AS BIGINT) AS joined_rows,
       CAST(coalesce(j.l, 0) AS BIGINT) AS labelled_joined, coalesce(CAST(j.w AS DOUBLE), 0.0) AS joined_weight
FROM n FULL JOIN e ON n.corpus_id IS NOT DISTINCT FROM e.corpus_id
LEFT JOIN j ON j.corpus_id = coalesce(n.corpus_id, e.corpus_id)
"""

_P1_FOUND = """
SELECT 'nodes' AS table_name, corpus_id FROM nodes WHERE corpus_id IS NOT NULL
GROUP BY corpus_id HAVING count(*) * 100 >= (SELECT count(*) FROM nodes) * 5
UNION ALL
SELECT 'edges', corpus_id FROM edges WHERE corpus_id IS NOT NULL
GROUP BY corpus_id HAVING count(*) * 100 >= (SELECT count(*) FROM edges) * 5
"""


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every orphan reference of edges and passages, one row per stored referring row."""
    edges, passages = table(spark, sf_dir, "edges"), table(spark, sf_dir, "mem_passages")
    fields = ("source_node_id", "target_node_id")
    from_edges = edges.select(
        "corpus_id",
        F.col("edge_id").alias("row_id"),
        F.col("ingested_at").alias("at"),
        F.explode(F.array(*[F.struct(F.lit(f"edges.{f}").alias("src"), F.col(f).alias("ref")) for f in fields])).alias("x"),
    ).select("corpus_id", "row_id", "at", "x.src", "x.ref", F.lit("node").alias("kind"))
    from_passages = passages.select(
        "corpus_id", F.col("passage_id").alias("row_id"), F.col("ingested_at").alias("at"), F.lit("mem_passages.fact_ids").alias("src"), F.explode("fact_ids").alias("ref"), F.lit("fact").alias("kind")
    )

    def keyed(df: DataFrame, kind: str) -> DataFrame:
        key = references.reference_key(kind, F.col("corpus_id"), F.col("ref"))
        return df.filter(references.is_reference(F.col("ref"))).select("src", "row_id", key.alias("key"), "at")

    def versions(name: str, kind: str, column: str) -> DataFrame:
        df = table(spark, sf_dir, name).filter(F.col(column).isNotNull())
        return df.select(references.reference_key(kind, F.col("corpus_id"), F.col(column)).alias("key"), F.col("ingested_at").alias("at"), F.col("deleted_at").alias("until"))

    refs = keyed(from_edges, "node").unionByName(keyed(from_passages, "fact"))
    parents = versions("nodes", "node", "node_id").unionByName(versions("mem_facts", "fact", "fact_id"))
    return references.find_orphans(refs, parents).select(
        F.split_part("src", F.lit("."), F.lit(1)).alias("table_name"),
        "corpus_id",
        "row_id",
        F.split_part("src", F.lit("."), F.lit(2)).alias("field_name"),
        "ref_id",
        "cause",
        F.date_format("at", "yyyy-MM").alias("ingest_month"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, sf_dir).distinct()


def p3_orphans_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report: orphan references per table, field, cause and month of arrival."""
    found = orphans(spark, sf_dir)
    return found.groupBy("table_name", "field_name", "cause", "ingest_month").agg(F.count(F.lit(1)).alias("n"))


_ORPHANS = """
WITH r AS (
  SELECT 'edges' AS table_name, corpus_id, edge_id AS row_id, 'source_node_id' AS field_name, source_node_id AS ref_id, ingested_at AS t, 'n' AS kind FROM edges
  UNION ALL SELECT 'edges', corpus_id, edge_id, 'target_node_id', target_node_id, ingested_at, 'n' FROM edges
  UNION ALL SELECT 'mem_passages', corpus_id, passage_id, 'fact_ids', unnest(fact_ids), ingested_at, 'f' FROM mem_passages),
v AS (SELECT 'n' AS kind, corpus_id, node_id AS id, ingested_at, deleted_at FROM nodes
  UNION ALL SELECT 'f', corpus_id, fact_id, ingested_at, deleted_at FROM mem_facts),
u AS (SELECT DISTINCT * FROM r WHERE ref_id IS NOT NULL AND trim(ref_id) <> ''),
c AS (SELECT u.table_name, u.corpus_id, u.row_id, u.field_name, u.ref_id, u.t, count(v.id) AS versions,
             coalesce(bool_or(v.ingested_at <= u.t), false) AS begun,
             coalesce(bool_or(v.ingested_at <= u.t AND (v.deleted_at IS NULL OR v.deleted_at > u.t)), false) AS alive
      FROM u LEFT JOIN v ON v.kind = u.kind AND v.id = u.ref_id AND v.corpus_id = u.corpus_id
      GROUP BY ALL),
o AS (SELECT table_name, corpus_id, row_id, field_name, ref_id, t,
             CASE WHEN versions = 0 THEN 'missing' WHEN begun THEN 'deleted' ELSE 'late' END AS cause,
             strftime(t, '%Y-%m') AS ingest_month FROM c WHERE NOT alive)
"""
_P3_FOUND = _ORPHANS + "SELECT DISTINCT table_name, corpus_id, row_id, field_name, ref_id, cause, ingest_month FROM o"
_P3_MONTHS = (
    _ORPHANS.replace("SELECT DISTINCT * FROM r", "SELECT *, count(*) AS k FROM r").replace("trim(ref_id) <> '')", "trim(ref_id) <> '' GROUP BY ALL)").replace("u.t, count(v.id)", "u.t, u.k, count(v.id)").replace("ref_id, t,\n", "ref_id, t, k,\n")
    + "SELECT table_name, field_name, cause, ingest_month, CAST(sum(k) AS BIGINT) AS n FROM o GROUP BY ALL"
)


def _p4_tables(spark: SparkSession, sf_dir: str, tags: tuple[str, ...]) -> dict[str, DataFrame]:
    """The flat tables, written partitioned by tag into the shared folder and read under their schemas."""
    return nested.write_tables(nested.emit(table(spark, sf_dir, "raw_snapshots"), tags), f"{shared_folder(spark)}/p4-{uuid4()}")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _p4_tables(spark, sf_dir, tuple(nested.ARRAYS))
    parts = [flat[tag].select("snapshot_id", "passage_id", F.lit(tag).alias("field_name"), "ord", "val") for tag in nested.ARRAYS]
    return reduce(DataFrame.unionByName, parts).distinct()


def p4_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every flat table per snapshot, repeated deliveries once."""
    flat = _p4_tables(spark, sf_dir, tuple(nested.SCHEMAS))
    rows = reduce(DataFrame.unionByName, [df.select("snapshot_id", F.lit(tag).alias("tag"), "parent_pk") for tag, df in flat.items()])
    return rows.groupBy("snapshot_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("parent_pk").alias("n_parents"))


_OPEN = """SELECT snapshot_id, body, CASE
  WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN json_valid(v->>'$') THEN CAST(v->>'$' AS JSON) END
  WHEN json_type(v) = 'OBJECT' AND NOT list_contains(json_keys(v), 'passages') AND json_type(v->'result') IN ('OBJECT', 'VARCHAR') THEN v->'result'
  WHEN json_type(v) = 'OBJECT' AND NOT list_contains(json_keys(v), 'passages') AND json_type(v->'snapshot') IN ('OBJECT', 'VARCHAR') THEN v->'snapshot'
  ELSE v END AS v FROM v{}"""
_NAME = "CASE WHEN json_type(x->'{0}') NOT IN ('NULL', 'OBJECT', 'ARRAY') THEN x->>'{0}' ELSE k END"
_BODIES = (
    "WITH v0 AS (SELECT DISTINCT snapshot_id, body, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS v FROM raw_snapshots),\n"
    + ",\n".join(f"v{i + 1} AS ({_OPEN.format(i)})" for i in range(6))
    + f""",
s AS (SELECT snapshot_id, body, v FROM v6 WHERE json_type(v) = 'OBJECT'),
lists AS (SELECT snapshot_id, body, 'p' AS kind, v->'passages' AS a FROM s UNION ALL SELECT snapshot_id, body, 'f', v->'facts' FROM s),
items AS (SELECT * FROM (
  SELECT snapshot_id, body, kind, i, CAST(NULL AS VARCHAR) AS k, json_extract(a, '$[' || i || ']') AS x FROM (SELECT *, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS i FROM lists WHERE json_type(a) = 'ARRAY')
  UNION ALL SELECT snapshot_id, body, kind, i, ks[i + 1], json_extract(a, '$."' || ks[i + 1] || '"') FROM (SELECT *, json_keys(a) AS ks, unnest(range(0, CAST(len(json_keys(a)) AS BIGINT))) AS i FROM lists WHERE json_type(a) = 'OBJECT'))
  WHERE json_type(x) = 'OBJECT'),
arrays AS (SELECT snapshot_id, body, kind, i, {_NAME.format('passageId')} AS id, 'section_path' AS tag, 'title' AS o, x->'metadata'->'sectionPath' AS a FROM items WHERE kind = 'p'
  UNION ALL SELECT snapshot_id, body, kind, i, {_NAME.format('passageId')}, 'entity_mentions', 'name', x->'entityMentions' FROM items WHERE kind = 'p'
  UNION ALL SELECT snapshot_id, body, kind, i, {_NAME.format('passageId')}, 'fact_ids', 'factId', x->'factIds' FROM items WHERE kind = 'p'
  UNION ALL SELECT snapshot_id, body, kind, i, {_NAME.format('factId')}, 'fact_passage', 'passageId', x->'passageIds' FROM items WHERE kind = 'f'),
elements AS (SELECT * EXCLUDE (a), json_extract(a, '$[' || j || ']') AS e FROM (SELECT *, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS j FROM arrays WHERE json_type(a) = 'ARRAY')
  UNION ALL SELECT * EXCLUDE (a), 0, a FROM arrays WHERE json_type(a) <> 'ARRAY'),
named AS (SELECT * EXCLUDE (e), CASE WHEN json_type(e) = 'OBJECT' THEN list_filter([e->o, e->'title', e->'name', e->'factId'], lambda y: json_type(y) <> 'NULL')[1] ELSE e END AS e FROM elements),
rows_ AS (SELECT * EXCLUDE (e), CASE WHEN json_type(e) = 'VARCHAR' THEN e->>'$' ELSE CAST(e AS VARCHAR) END AS val FROM named WHERE json_type(e) NOT IN ('NULL', 'OBJECT', 'ARRAY'))
"""
)
_P4_FOUND = _BODIES + "SELECT DISTINCT snapshot_id, id AS passage_id, tag AS field_name, CAST(j AS BIGINT) AS ord, val FROM rows_ WHERE kind = 'p'"
_P4_COUNTS = (
    _BODIES
    + """, every AS (SELECT snapshot_id, 'snapshot' AS tag, CAST(NULL AS VARCHAR) AS parent FROM s
  UNION ALL SELECT snapshot_id, CASE kind WHEN 'p' THEN 'passage' ELSE 'fact' END, body FROM items
  UNION ALL SELECT snapshot_id, tag, body || kind || i FROM rows_)
SELECT snapshot_id, tag, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT parent) AS BIGINT) AS n_parents FROM every GROUP BY ALL"""
)

QUERIES = {
    "p1_found": p1_found,
    "p1_corpus_join": p1_corpus_join,
    "p3_found": p3_found,
    "p3_orphans_per_month": p3_orphans_per_month,
    "p4_found": p4_found,
    "p4_child_counts": p4_child_counts,
}
SQL = {"p1_found": _P1_FOUND, "p1_corpus_join": _P1_CORPUS_JOIN, "p3_found": _P3_FOUND, "p3_orphans_per_month": _P3_MONTHS, "p4_found": _P4_FOUND, "p4_child_counts": _P4_COUNTS}
