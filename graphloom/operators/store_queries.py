"""Queries of the corpus store and the retrieval operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.functions.scalar import document_ids, fold, merge_token, sort_work, utf16_key
from graphloom.operators import delete_document as dd
from graphloom.operators import pagerank, retrieval, store
from graphloom.session import table
from graphloom.sources import fixtures
from graphloom.sources.fixtures import with_views

CORPUS, MEMORY = "tpch", "memory"
LARGE = "corpus-coastal-health"
SEEDS = {"entity:user 1": 0.9, "entity:key 7": 0.5, "entity:nobody": 1.0}
PPR_EPSILON = 1e-4
FACT_SEEDS = {"user 1": 0.9, "key 7": 0.5}
WANTED = ["7", "3", "7", "none", "12"]


def scan_nodes(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.g_nodes(spark, d).orderBy("node_id")


def scan_edges(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.g_edges(spark, d).orderBy("edge_id")


def get_node(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.g_nodes(spark, d).filter((F.col("corpus_id") == CORPUS) & (F.col("node_id") == "customer:7"))


def get_nodes_layer(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.g_nodes(spark, d).filter((F.col("corpus_id") == CORPUS) & (F.col("layer") == "ontology")).orderBy("node_id")


def get_edges_source(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.g_edges(spark, d).filter((F.col("corpus_id") == CORPUS) & (F.col("source_node_id") == "order:7")).orderBy("edge_id")


def get_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return store.adjacent(fixtures.g_edges(spark, d), CORPUS, "nation:3")


def dangling_nodes(spark: SparkSession, d: str) -> DataFrame:
    return store.dangling(fixtures.g_nodes(spark, d), fixtures.g_edges(spark, d), CORPUS)


def node_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").groupBy("corpus_id").agg(F.count(F.lit(1)).alias("nodes"))


def graph_admission(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges").filter("corpus_id IS NOT NULL AND source_node_id IS NOT NULL AND target_node_id IS NOT NULL")
    return store.graph_admission(edges)


def _memory(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, d, f"mem_{n}") for n in ("passages", "facts", "schemas"))


def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.section_counts(*_memory(spark, d), LARGE)


def memory_load(spark: SparkSession, d: str) -> DataFrame:
    return store.memory_load(*_memory(spark, d))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    return store.transitions(fixtures.g_edges(spark, d), CORPUS)


def transitions_page(spark: SparkSession, d: str) -> DataFrame:
    page = store.transitions_page(fixtures.g_edges(spark, d).withColumn("weight", F.lit(1.5)), CORPUS, 100, 8192)
    return page.select("position", "source", "target")


def passages_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return store.by_ids(fixtures.g_lexical(spark, d), "passage_id", WANTED).select("ord", "passage_id", "document_id", "text")


def facts_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return store.by_ids(fixtures.g_facts(spark, d), "fact_id", [f"f{i}" for i in WANTED]).select("ord", "fact_id", "head_entity", "tail_entity", "state")


def schemas_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return store.by_ids(fixtures.g_schemas(spark, d), "schema_id", ["view", "click", "none", "purchase"], unique_request=True).select("ord", "schema_id", "frequency", "state")


def facts_by_entities(spark: SparkSession, d: str) -> DataFrame:
    return store.facts_by_entities(fixtures.g_facts(spark, d), ["USER 1", "key 7"], active_only=True).select("fact_id", "head_entity", "tail_entity")


def active_facts(spark: SparkSession, d: str) -> DataFrame:
    return store.active_facts(fixtures.g_facts(spark, d), 50).select("pos", "fact_id", "state")


def schema_projection(spark: SparkSession, d: str) -> DataFrame:
    return store.schema_projection(table(spark, d, "mem_schemas"), "doc-5f301317")


def schema_merge_token(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mem_schemas").select("corpus_id", "schema_id", merge_token(F.col("raw")).alias("token"))


def entity_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mem_facts").select(fold(F.col("head_entity")).alias("folded")).groupBy("folded").agg(F.count(F.lit(1)).alias("n"))


def utf16_order(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.g_nodes(spark, d).orderBy(utf16_key(F.col("node_id"))).select("node_id").limit(100)


def doc_ids_from_ref(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(k).alias("kind"), F.col(c).alias("id"), F.explode(document_ids(F.col("raw"))).alias("document_id")) for t, k, c in (("mem_facts", "fact", "fact_id"), ("mem_passages", "passage", "passage_id"))]
    return parts[0].unionByName(parts[1])


def _query_vector(spark: SparkSession, d: str) -> tuple[list[float], str]:
    row = table(spark, d, "embeddings").filter("vec_id = 0").select("embedding", "label").first()
    return [float(x) for x in row["embedding"]], f"label{row['label']}"


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    q, space = _query_vector(spark, d)
    return retrieval.vector_search(fixtures.g_vectors(spark, d), MEMORY, space, q, 10).select("id", F.round("score", 6).alias("score"))


def vector_search_threshold(spark: SparkSession, d: str) -> DataFrame:
    q, space = _query_vector(spark, d)
    return retrieval.vector_search(fixtures.g_vectors(spark, d), MEMORY, space, q, 10_000, 0.1).select("id", F.round("score", 6).alias("score"))


def candidate_search(spark: SparkSession, d: str) -> DataFrame:
    q, _ = _query_vector(spark, d)
    slots = [{"slot_id": f"s{i}", "namespace": f"label{i}", "query": q, "threshold": -1.0, "limit": 5 + i} for i in range(3)]
    items = fixtures.g_lexical(spark, d).select(F.concat(F.lit("passage:"), "passage_id").alias("id"), F.col("document_id").alias("payload"))
    # vectors beyond the documents have an item without payload
    vectors = fixtures.g_vectors(spark, d)
    items = vectors.select("id").join(items, "id", "left")
    return retrieval.candidate_search(vectors, MEMORY, slots, items).select("slot_id", "rank", "id", F.round("score", 6).alias("score"), "payload")


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_search(fixtures.g_lexical(spark, d), MEMORY, "The and ing the", 25)


def fact_expand(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fact_expand(fixtures.g_facts(spark, d), FACT_SEEDS, ["f4"], 0.8, 64).select("fact_id", F.round("score", 9).alias("score"))


def ppr_fixed_iters(spark: SparkSession, d: str) -> DataFrame:
    edges = fixtures.m_edges(spark, d).filter("weight > 0")
    ranking = pagerank.personalised_pagerank(edges, SEEDS, 0.15, None, 3, 100)
    return ranking.scores.select("node_id", F.round("score", 9).alias("score")).filter("score > 0")


def ppr_converged(spark: SparkSession, d: str) -> DataFrame:
    """Ranks, stored items, rounds and last change of a ranking that converges."""
    ranking = pagerank.personalised_pagerank(fixtures.m_edges(spark, d).filter("weight > 0"), SEEDS, 0.15, PPR_EPSILON, 128, 100)
    if not ranking.converged:
        raise GraphError("INTEGRITY", "the ranking did not converge")
    ranking.scores = ranking.scores.withColumn("score", F.round("score", 9))
    passages = fixtures.g_lexical(spark, d).select(F.concat(F.lit("passage:"), "passage_id").alias("node_id"), F.col("document_id").alias("payload"))
    facts = fixtures.g_facts(spark, d).select(F.concat(F.lit("fact:"), "fact_id").alias("node_id"), F.col("state").alias("payload"))
    # passages follow from the events' ids: the documents need not have them, and either table may repeat an id
    out = pagerank.materialise(ranking, {"passage:": (20, passages), "fact:": (20, facts)}, strict=False)
    return out.withColumn("l1_delta", F.round("l1_delta", 9))


def _delta(nodes: DataFrame) -> DataFrame:
    regions = nodes.filter("label = 'Region'").withColumn("_o", F.lit(1))
    again = nodes.filter("node_id = 'region:2'").withColumn("label", F.lit("Twice")).withColumn("_o", F.lit(2))
    new = nodes.filter("node_id = 'region:1'").withColumn("node_id", F.lit("region:new")).withColumn("_o", F.lit(1))
    return regions.unionByName(again).unionByName(new).withColumn("layer", F.lit("updated"))


def upsert_nodes_post(spark: SparkSession, d: str) -> DataFrame:
    nodes = fixtures.g_nodes(spark, d)
    return store.upsert(nodes, _delta(nodes), ["corpus_id", "node_id"], "_o")


def upsert_edges_post(spark: SparkSession, d: str) -> DataFrame:
    edges = fixtures.g_edges(spark, d)
    return store.upsert(edges, edges.filter("relation = 'IN_REGION'").withColumn("weight", F.lit(9.0)), ["corpus_id", "edge_id"])


_GONE = ["nation:3", "order:1", "missing:1"]


def delete_nodes_post(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([(x,) for x in _GONE], "node_id string")
    nodes, edges = store.delete_nodes(fixtures.g_nodes(spark, d), fixtures.g_edges(spark, d), CORPUS, ids)
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


def delete_edges_post(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([(CORPUS, f"in-region:{i}") for i in range(3)], "corpus_id string, edge_id string")
    return store.delete_edges(fixtures.g_edges(spark, d), ids).select("edge_id")


def delete_by_document_post(spark: SparkSession, d: str) -> DataFrame:
    facts, passages = table(spark, d, "mem_facts"), table(spark, d, "mem_passages")
    document = facts.filter(F.col("corpus_id") == LARGE).select(F.explode("source_document_ids").alias("x")).agg(F.min("x")).first()[0]
    nodes = facts.select("corpus_id", F.concat(F.lit("fact:"), "fact_id").alias("node_id"), F.col("raw").alias("ref"))
    vectors = passages.select("corpus_id", F.col("passage_id").alias("id"), F.col("metadata.documentId").alias("document_id"))
    lexical = passages.select("corpus_id", "passage_id", F.col("metadata.documentId").alias("document_id"))
    edges = table(spark, d, "edges").select("corpus_id", "edge_id", "source_node_id", "target_node_id")
    after = store.delete_by_document(nodes, edges, vectors, lexical, LARGE, document)
    parts = [df.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)) for df, k in zip(after, ("node", "edge", "vector", "lexical"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def delete_by_corpus_post(spark: SparkSession, d: str) -> DataFrame:
    after = store.delete_by_corpus({t: table(spark, d, t) for t in ("nodes", "edges", "mem_passages", "mem_facts", "mem_schemas")}, LARGE)
    parts = [df.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(t)) for t, df in after.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vector_upsert_post(spark: SparkSession, d: str) -> DataFrame:
    vectors = fixtures.g_vectors(spark, d)
    delta = vectors.filter("document_id IN ('1', '2')").withColumn("namespace", F.lit("moved"))
    return store.upsert_vectors(vectors, delta).select("id", "namespace")


def vector_delete_post(spark: SparkSession, d: str) -> DataFrame:
    return store.delete_document_rows(fixtures.g_vectors(spark, d), MEMORY, "3").select("id")


def lexical_delete_post(spark: SparkSession, d: str) -> DataFrame:
    return store.delete_document_rows(fixtures.g_lexical(spark, d), MEMORY, "survey").select("passage_id")


def memory_upsert_post(spark: SparkSession, d: str) -> DataFrame:
    facts = fixtures.g_facts(spark, d).select("corpus_id", "pos", "fact_id", "state")
    delta = spark.createDataFrame([(MEMORY, "f3", "first", 0), (MEMORY, "f-b", "new", 1), (MEMORY, "f3", "last", 2), (MEMORY, "f-a", "new", 3)], "corpus_id string, fact_id string, state string, _ord int")
    return store.memory_upsert(facts, delta, "fact_id")


def _latest_schemas(spark: SparkSession, d: str) -> DataFrame:
    schemas = table(spark, d, "mem_schemas")
    return schemas.groupBy("corpus_id", "schema_id").agg(F.max_by(F.struct(*[c for c in schemas.columns if c not in ("corpus_id", "schema_id")]), F.struct("ingested_at", "raw")).alias("x")).select("corpus_id", "schema_id", "x.*")


def schema_merge_post(spark: SparkSession, d: str) -> DataFrame:
    stored = _latest_schemas(spark, d)
    intents = stored.filter(F.col("corpus_id") == LARGE).select(
        "corpus_id", "schema_id", merge_token(F.col("raw")).alias("token"), F.lit("doc-new").alias("document_id"), F.lit(1).cast("bigint").alias("frequency_delta"), F.array(F.lit("f-new"), F.lit("f-new")).alias("fact_ids"),
        F.array(F.struct(F.lit("new name").alias("label"), F.lit("en").alias("language"), F.lit("test").alias("source"), F.lit(1.0).alias("confidence"), F.lit(False).alias("isCanonical"))).alias("aliases"),
    )
    out = store.schema_merge(stored, intents)
    return out.select("corpus_id", "schema_id", "frequency", F.size("fact_ids").alias("facts"), F.get("source_document_ids", F.size("source_document_ids") - 1).alias("last_document"), F.size("aliases").alias("aliases"))


def schema_create_post(spark: SparkSession, d: str) -> DataFrame:
    """The large corpus' schemas created under new ids beside all stored ones."""
    stored = _latest_schemas(spark, d)
    rest = [c for c in stored.columns if c not in ("corpus_id", "schema_id")]
    intents = stored.filter(F.col("corpus_id") == LARGE).select(
        "corpus_id", F.concat("schema_id", F.lit("-new")).alias("schema_id"), F.lit(None).cast("string").alias("token"), F.lit("doc-new").alias("document_id"), F.lit(1).cast("bigint").alias("frequency_delta"),
        "fact_ids", "aliases", F.lit("create").alias("mode"), F.struct(*rest).alias("created"),
    )
    return store.schema_merge(stored, intents).select("corpus_id", "schema_id", "frequency", F.size("fact_ids").alias("facts"), "relation")


def upsert_duplicates_post(spark: SparkSession, d: str) -> DataFrame:
    """Stored versions of nodes merged by key into those without a corpus: of repeated keys the last delivery stays."""
    nodes = table(spark, d, "nodes").select("corpus_id", "node_id", F.coalesce("label", F.lit("-")).alias("label"), "ingested_at")
    delta = nodes.withColumn("_o", F.struct("ingested_at", "label"))
    return store.upsert(nodes.limit(0), delta, ["corpus_id", "node_id"], "_o").select("corpus_id", "node_id", "label")


def schema_nodes_post(spark: SparkSession, d: str) -> DataFrame:
    """Nodes after an upsert that hydrates the nodes of the large corpus' schemas."""
    nodes = table(spark, d, "nodes").select("corpus_id", "node_id", "layer", "ref", "label").filter("layer = 'ontology'").dropDuplicates(["corpus_id", "node_id"])
    schemas = _latest_schemas(spark, d)
    wanted = schemas.filter(F.col("corpus_id") == LARGE).select("corpus_id", "schema_id")
    out = store.upsert_nodes(nodes, nodes.limit(0).withColumn("_o", F.lit(1)), "_o", schemas, wanted)
    return out.filter(F.col("corpus_id") == LARGE).select("node_id", F.when(F.col("ref").contains('"schemaId"'), "schema").otherwise("other").alias("kind"))


def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    passages, facts, _ = _memory(spark, d)
    return store.integrity(table(spark, d, "nodes"), table(spark, d, "edges"), facts, passages)


def job_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints of one job per source, one of them saved again, and read back."""
    jobs = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("job_id")).distinct().withColumn("body", F.lit("{}"))
    saved = store.save_checkpoint(jobs, "survey", "c", ["d1", "d2"], "t1")
    return store.load_checkpoint(saved, "survey")


def lexical_index_post(spark: SparkSession, d: str) -> DataFrame:
    """Passages after two of them were indexed again and one is new."""
    lexical = fixtures.g_lexical(spark, d)
    again = lexical.filter("passage_id IN ('1', '2')").withColumn("document_id", F.lit("again"))
    new = lexical.filter("passage_id = '3'").withColumn("passage_id", F.lit("new"))
    return store.index_passages(lexical, again.unionByName(new)).select("passage_id", "document_id")


def sort_work_per_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons charged for sorting each corpus' edges."""
    n = table(spark, d, "edges").groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("corpus_id", "n", sort_work(F.col("n")).alias("work"))


def vector_validate(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of every namespace after an upsert of all of them, checked."""
    vectors = fixtures.g_vectors(spark, d)
    out = store.upsert_vectors(vectors, vectors.withColumn("namespace", F.concat(F.lit("checked-"), "namespace")))
    return out.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("values")).alias("dimensions"))


def activate_facts_post(spark: SparkSession, d: str) -> DataFrame:
    facts = fixtures.g_facts(spark, d).withColumn("updated_at", F.lit("old"))
    return store.activate_facts(facts, ["view", "click"], "now").select("fact_id", "state", "updated_at")


def delete_store(spark: SparkSession, d: str) -> dd.Store:
    """A document store over the events: facts with one or two documents, passages, schemas, nodes, edges and vectors."""
    facts = fixtures.g_facts(spark, d).select(
        "corpus_id", "fact_id", "schema_id", F.array_distinct(F.array(*[F.concat(F.lit("d"), ((F.col("pos") + k) % 40).cast("string")) for k in (0, 3)])).alias("two"), "pos", "passage_id", "head_entity", "tail_entity"
    )
    facts = facts.select("corpus_id", "fact_id", "schema_id", F.when(F.col("pos") % 5 == 0, F.col("two")).otherwise(F.slice("two", 1, 1)).alias("source_document_ids"), F.array("passage_id").alias("passage_ids"), F.lit("t0").alias("updated_at"))
    lexical = fixtures.g_lexical(spark, d).select("corpus_id", "passage_id", F.concat(F.lit("d"), (F.col("passage_id").cast("bigint") % 40).cast("string")).alias("document_id"))
    schemas = facts.groupBy("corpus_id", "schema_id").agg(F.count(F.lit(1)).alias("frequency"))
    schemas = schemas.select("corpus_id", "schema_id", F.array(F.lit("d7"), F.lit("d8")).alias("source_document_ids"), F.array().cast("array<string>").alias("fact_ids"), "frequency", F.col("frequency").alias("stabilization_threshold"), F.lit("stable").alias("state"), F.lit("t0").alias("updated_at"))
    edges = fixtures.m_edges(spark, d).select("corpus_id", "edge_id", "source_node_id", "target_node_id", "relation")
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def node(df: DataFrame, node_id, layer: str, item=none, document=none, documents=empty, passages=empty, fact_ids=empty) -> DataFrame:
        return df.select("corpus_id", node_id.alias("node_id"), F.lit(layer).alias("layer"), item.alias("item_id"), document.alias("document_id"), documents.alias("source_document_ids"), passages.alias("passage_ids"), fact_ids.alias("fact_ids"), F.lit("t0").alias("updated_at"))

    def named(prefix: str, column: str):
        return F.concat(F.lit(prefix), column)

    entities = fixtures.m_nodes(spark, d).filter("layer = 'entity'")
    nodes = (
        node(facts, named("fact:", "fact_id"), "fact", F.col("fact_id"), none, F.col("source_document_ids"), F.col("passage_ids"))
        .unionByName(node(lexical, named("passage:", "passage_id"), "passage", F.col("passage_id"), F.col("document_id")))
        .unionByName(node(schemas, named("schema:", "schema_id"), "ontology", F.col("schema_id"), none, F.col("source_document_ids"), empty, F.col("fact_ids")))
        .unionByName(node(entities, F.col("node_id"), "entity"))
    )
    vectors = facts.select("corpus_id", named("fact:", "fact_id").alias("id"), F.lit("fact").alias("namespace"), F.get("source_document_ids", F.lit(0)).alias("document_id"))
    vectors = vectors.unionByName(lexical.select("corpus_id", named("passage:", "passage_id").alias("id"), F.lit("passage").alias("namespace"), "document_id"))
    return dd.Store(nodes, edges, vectors, lexical, lexical, facts, schemas)


def _deleted(spark: SparkSession, d: str) -> tuple[dd.Store, DataFrame]:
    return dd.delete_document(delete_store(spark, d), MEMORY, "d7", "t1")


def delete_document_counts(spark: SparkSession, d: str) -> DataFrame:
    return _deleted(spark, d)[1]


def delete_document_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _deleted(spark, d)[0].nodes.select("node_id", "layer")


def delete_document_edges(spark: SparkSession, d: str) -> DataFrame:
    return _deleted(spark, d)[0].edges.select("edge_id")


def delete_document_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _deleted(spark, d)[0].vectors.select("id", "document_id")


def delete_document_facts(spark: SparkSession, d: str) -> DataFrame:
    return _deleted(spark, d)[0].facts.select("fact_id", F.array_join("source_document_ids", ",").alias("documents"), F.size("passage_ids").alias("passages"))


def delete_document_schemas(spark: SparkSession, d: str) -> DataFrame:
    return _deleted(spark, d)[0].schemas.select("schema_id", "frequency", "state", F.array_join("source_document_ids", ",").alias("documents"))


_N, _E, _NE, _F, _L, _V = with_views("g_nodes"), with_views("g_edges"), with_views("g_nodes", "g_edges"), with_views("g_facts"), with_views("g_lexical"), with_views("g_vectors")
_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_SCORED = _V.rstrip() + f",\nq AS (SELECT CAST(embedding AS DOUBLE[]) AS q, 'label' || label AS space FROM embeddings WHERE vec_id = 0),\nh AS (SELECT id, round(list_cosine_similarity(vals, q), 6) AS score, list_cosine_similarity(vals, q) AS exact FROM g_vectors, q WHERE namespace = space)\n"
_COUNT = "CAST((length(lower(text)) - length(replace(lower(text), '{t}', ''))) / length('{t}') AS BIGINT)"
_PPR_HEAD = (
    with_views("m_edges").rstrip()
    + """,
pos AS (SELECT * FROM m_edges WHERE weight > 0),
deg AS (SELECT node, sum(w) AS o, count(*) AS n FROM (SELECT source_node_id AS node, weight AS w FROM pos UNION ALL SELECT target_node_id, NULL FROM pos) GROUP BY node),
sh AS (SELECT e.source_node_id AS src, e.target_node_id AS dst, e.weight / a.o * CASE WHEN b.node LIKE 'schema:%' AND b.n > 100 THEN 1.0 / log2(b.n + 2) ELSE CAST(1 AS DOUBLE) END AS share
       FROM pos e JOIN deg a ON a.node = e.source_node_id JOIN deg b ON b.node = e.target_node_id),
seed AS (SELECT * FROM (VALUES ('entity:user 1', CAST(0.9 AS DOUBLE)), ('entity:key 7', CAST(0.5 AS DOUBLE)), ('entity:nobody', CAST(1 AS DOUBLE))) t(node, s) WHERE node IN (SELECT node FROM deg)),
s0 AS (SELECT node, s / (SELECT sum(s) FROM seed) AS score FROM seed)"""
)
_PPR_CONVERGED = (
    _PPR_HEAD.replace("WITH ", "WITH RECURSIVE ", 1)
    + """,
it(i, node, score, delta) AS (
  SELECT 0, node, score, CAST(1 AS DOUBLE) FROM s0
  UNION ALL
  SELECT i, node, score, sum(abs(score - old)) OVER () FROM (
    SELECT max(i) AS i, node, sum(new) AS score, sum(old) AS old FROM (
      SELECT i + 1 AS i, dst AS node, score * share * 0.85 AS new, CAST(0 AS DOUBLE) AS old FROM it JOIN sh ON src = it.node WHERE delta >= {eps} AND i < 128
      UNION ALL SELECT i + 1, node, 0, score FROM it WHERE delta >= {eps} AND i < 128
      UNION ALL SELECT k.i + 1, s0.node, s0.score * 0.15, 0 FROM s0, (SELECT DISTINCT i FROM it WHERE delta >= {eps} AND i < 128) k)
    GROUP BY node)),
last AS (SELECT * FROM it WHERE i = (SELECT max(i) FROM it)),
best AS (SELECT split_part(node, ':', 1) AS kind, node AS node_id, round(score, 9) AS score, i, delta, row_number() OVER (PARTITION BY split_part(node, ':', 1) ORDER BY round(score, 9) DESC, node) AS rank FROM last WHERE node LIKE 'passage:%' OR node LIKE 'fact:%'),
items AS (SELECT 'passage:' || CAST(doc_id AS VARCHAR) AS node_id, source AS payload FROM documents UNION ALL SELECT 'fact:' || fact_id, state FROM g_facts)

SELECT kind, CAST(rank AS INTEGER) AS rank, node_id, score, payload, CAST(i AS INTEGER) AS iterations, delta < {eps} AS converged, round(delta, 9) AS l1_delta FROM best LEFT JOIN items USING (node_id) WHERE rank <= 20
"""
)
_PPR_STEP = """,
s{k} AS (SELECT node, sum(x) AS score FROM (SELECT dst AS node, score * share * 0.85 AS x FROM sh JOIN s{j} ON src = node UNION ALL SELECT node, score * 0.15 FROM s0) GROUP BY node)"""
_FACTS_SQL = _F + "SELECT {c} FROM g_facts "


def _ordered(ids: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(dict.fromkeys(ids))) + ") w(ord, id)"


_LATEST = "SELECT * FROM mem_schemas QUALIFY row_number() OVER (PARTITION BY corpus_id, schema_id ORDER BY ingested_at DESC, raw DESC) = 1"
_DOCUMENT = f"(SELECT min(x) FROM (SELECT unnest(source_document_ids) AS x FROM mem_facts WHERE corpus_id = '{LARGE}'))"

_DELETED = (
    with_views("m_nodes", "g_lexical").rstrip()
    + """,
f AS (SELECT fact_id, schema_id, passage_id, CASE WHEN pos % 5 = 0 THEN ['d' || (pos % 40), 'd' || ((pos + 3) % 40)] ELSE ['d' || (pos % 40)] END AS docs FROM g_facts),
p AS (SELECT passage_id, 'd' || (CAST(passage_id AS BIGINT) % 40) AS doc FROM g_lexical),
lost_p AS (SELECT passage_id FROM p WHERE doc = 'd7'),
t AS (SELECT *, list_filter(docs, lambda x: x <> 'd7') AS kept, passage_id IN (SELECT passage_id FROM lost_p) AS lost FROM f WHERE list_contains(docs, 'd7')),
lost_f AS (SELECT fact_id FROM t WHERE lost OR len(kept) = 0),
keep_f AS (SELECT * FROM t WHERE NOT lost AND len(kept) > 0),
sch AS (SELECT schema_id, CAST(count(*) AS BIGINT) AS frequency FROM f GROUP BY 1),
n AS (SELECT 'fact:' || fact_id AS node_id, 'fact' AS layer FROM f UNION ALL SELECT 'passage:' || passage_id, 'passage' FROM p UNION ALL SELECT 'schema:' || schema_id, 'ontology' FROM sch UNION ALL SELECT node_id, layer FROM m_nodes WHERE layer = 'entity'),
gone AS (SELECT 'fact:' || fact_id AS id FROM lost_f UNION ALL SELECT 'passage:' || passage_id FROM lost_p),
e AS (SELECT edge_id, source_node_id AS a, target_node_id AS b, relation, source_node_id IN (SELECT id FROM gone) OR target_node_id IN (SELECT id FROM gone)
             OR (relation = 'entity_cooccurrence' AND split_part(edge_id, ':', 4) IN (SELECT fact_id FROM lost_f)) AS cut FROM m_edges),
ends AS (SELECT a AS id, cut, relation FROM e UNION ALL SELECT b, cut, relation FROM e),
orphan AS (SELECT DISTINCT id FROM ends WHERE cut AND id LIKE 'entity:%' AND id NOT IN (SELECT id FROM ends WHERE NOT cut AND relation IN ('entity_mention', 'entity_cooccurrence'))),
x AS (SELECT *, cut OR a IN (SELECT id FROM orphan) OR b IN (SELECT id FROM orphan) AS removed FROM e),
v AS (SELECT 'fact:' || fact_id AS id, docs[1] AS doc, (SELECT kept[1] FROM keep_f k WHERE k.fact_id = f.fact_id) AS next FROM f UNION ALL SELECT 'passage:' || passage_id, doc, NULL FROM p),
w AS (SELECT *, CASE WHEN id IN (SELECT id FROM gone) OR (doc = 'd7' AND next IS NULL) THEN 'remove' WHEN doc = 'd7' THEN 'rekey' ELSE 'keep' END AS fate FROM v)
"""
)
_C = "CAST((SELECT count(*) FROM {}) AS BIGINT) AS {}"

QUERIES = {
    f.__name__: f
    for f in (
        scan_nodes, scan_edges, get_node, get_nodes_layer, get_edges_source, get_adjacent, dangling_nodes, node_count, graph_admission, section_counts, memory_load, transitions, transitions_page, passages_by_ids,
        facts_by_ids, schemas_by_ids, facts_by_entities, active_facts, schema_projection, schema_merge_token, entity_fold, utf16_order, doc_ids_from_ref, vector_search, vector_search_threshold, candidate_search,
        lexical_search, fact_expand, ppr_fixed_iters, ppr_converged, upsert_nodes_post, upsert_edges_post, delete_nodes_post, delete_edges_post, delete_by_document_post, delete_by_corpus_post, vector_upsert_post,
        vector_delete_post, lexical_delete_post, memory_upsert_post, schema_merge_post, schema_create_post, upsert_duplicates_post, schema_nodes_post, integrity_report, job_checkpoint, vector_validate, lexical_index_post, sort_work_per_corpus, activate_facts_post, delete_document_counts, delete_document_nodes, delete_document_edges, delete_document_vectors,
        delete_document_facts, delete_document_schemas,
    )
}

SQL = {
    "scan_nodes": _N + "SELECT * FROM g_nodes",
    "scan_edges": _E + "SELECT * FROM g_edges",
    "get_node": _N + "SELECT * FROM g_nodes WHERE node_id = 'customer:7'",
    "get_nodes_layer": _N + "SELECT * FROM g_nodes WHERE layer = 'ontology'",
    "get_edges_source": _E + "SELECT * FROM g_edges WHERE source_node_id = 'order:7'",
    "get_adjacent": _E + "SELECT * FROM g_edges WHERE source_node_id = 'nation:3' OR target_node_id = 'nation:3'",
    "dangling_nodes": _NE + "SELECT node_id FROM g_nodes WHERE node_id NOT IN (SELECT source_node_id FROM g_edges)",
    "node_count": "SELECT corpus_id, CAST(count(*) AS BIGINT) AS nodes FROM nodes GROUP BY corpus_id",
    "graph_admission": "WITH e AS (SELECT * FROM edges WHERE corpus_id IS NOT NULL AND source_node_id IS NOT NULL AND target_node_id IS NOT NULL), n AS (SELECT corpus_id, source_node_id AS x FROM e UNION SELECT corpus_id, target_node_id FROM e) SELECT a.corpus_id, a.nodes, b.edges FROM (SELECT corpus_id, CAST(count(*) AS BIGINT) AS nodes FROM n GROUP BY 1) a JOIN (SELECT corpus_id, CAST(count(*) AS BIGINT) AS edges FROM e GROUP BY 1) b USING (corpus_id)",
    "section_counts": f"SELECT CAST((SELECT count(*) FROM mem_passages WHERE corpus_id = '{LARGE}') AS BIGINT) AS passages, CAST((SELECT count(*) FROM mem_facts WHERE corpus_id = '{LARGE}') AS BIGINT) AS facts, CAST((SELECT count(*) FROM mem_schemas WHERE corpus_id = '{LARGE}') AS BIGINT) AS schemas",
    "memory_load": "SELECT corpus_id, 'passages' AS section, pos, raw FROM mem_passages UNION ALL SELECT corpus_id, 'facts', pos, raw FROM mem_facts UNION ALL SELECT corpus_id, 'schemas', pos, raw FROM mem_schemas",
    "transitions": _E + "SELECT source_node_id AS source, target_node_id AS target, weight, edge_id FROM g_edges",
    "transitions_page": _E.rstrip() + ",\np AS (SELECT source_node_id AS source, target_node_id AS target, edge_id FROM g_edges ORDER BY 1, 2, 3 LIMIT 100000 OFFSET 100),\nb AS (SELECT *, row_number() OVER (ORDER BY source, target, edge_id) AS n, sum(strlen('{\"source\":\"' || source || '\",\"target\":\"' || target || '\",\"weight\":1.5}')) OVER (ORDER BY source, target, edge_id ROWS UNBOUNDED PRECEDING) AS bytes FROM p)\nSELECT CAST(n + 100 AS INTEGER) AS position, source, target FROM b WHERE bytes <= 8192 OR n = 1",
    "passages_by_ids": _L + f"SELECT CAST(ord AS INTEGER) AS ord, passage_id, document_id, text FROM g_lexical JOIN {_ordered(WANTED)} ON w.id = passage_id",
    "facts_by_ids": _F + f"SELECT CAST(ord AS INTEGER) AS ord, fact_id, head_entity, tail_entity, state FROM g_facts JOIN {_ordered([f'f{i}' for i in WANTED])} ON w.id = fact_id",
    "schemas_by_ids": with_views("g_schemas") + f"SELECT CAST(ord AS INTEGER) AS ord, schema_id, frequency, state FROM g_schemas JOIN {_ordered(['view', 'click', 'none', 'purchase'])} ON w.id = schema_id",
    "facts_by_entities": _F + "SELECT fact_id, head_entity, tail_entity FROM g_facts WHERE (lower(head_entity) IN ('user 1', 'key 7') OR lower(tail_entity) IN ('user 1', 'key 7')) AND state = 'active' ORDER BY fact_id LIMIT 100",
    "active_facts": _F + "SELECT pos, fact_id, state FROM g_facts WHERE state = 'active' ORDER BY pos LIMIT 50",
    "schema_projection": "SELECT corpus_id, schema_id, canonical_key, head_type, relation, tail_type, frequency, stabilization_threshold, version, state, source_document_ids[1] AS first_source_document_id, coalesce(list_contains(source_document_ids, 'doc-5f301317'), false) AS contribution_present, sha256('graphloom-schema-merge-token-v1:' || raw) AS merge_token FROM mem_schemas",
    "schema_merge_token": "SELECT corpus_id, schema_id, sha256('graphloom-schema-merge-token-v1:' || raw) AS token FROM mem_schemas",
    "entity_fold": "SELECT lower(head_entity) AS folded, CAST(count(*) AS BIGINT) AS n FROM mem_facts GROUP BY 1",
    "utf16_order": _N + "SELECT node_id FROM g_nodes ORDER BY node_id LIMIT 100",
    "doc_ids_from_ref": "SELECT 'fact' AS kind, fact_id AS id, unnest(json_extract_string(raw, '$.sourceDocumentIds[*]')) AS document_id FROM mem_facts UNION ALL SELECT 'passage', passage_id, json_extract_string(raw, '$.metadata.documentId') FROM mem_passages WHERE json_extract_string(raw, '$.metadata.documentId') IS NOT NULL",
    "vector_search": _SCORED + "SELECT id, score FROM h ORDER BY exact DESC, id LIMIT 10",
    "vector_search_threshold": _SCORED + "SELECT id, score FROM h WHERE exact >= 0.1 ORDER BY exact DESC, id LIMIT 10000",
    "candidate_search": with_views("g_vectors", "g_lexical").rstrip() + f",\nh AS (SELECT 's' || substr(namespace, 6) AS slot_id, CAST(substr(namespace, 6) AS INTEGER) AS k, v.id, list_cosine_similarity(vals, {_Q}) AS exact, l.document_id AS payload FROM g_vectors v LEFT JOIN g_lexical l ON v.id = 'passage:' || l.passage_id WHERE namespace IN ('label0', 'label1', 'label2')),\nr AS (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY exact DESC, id) AS rank FROM h)\nSELECT slot_id, CAST(rank AS INTEGER) AS rank, id, round(exact, 6) AS score, payload FROM r WHERE rank <= 5 + k",
    "lexical_search": _L + f"SELECT passage_id, score FROM (SELECT passage_id, {_COUNT.format(t='the')} * 2 + {_COUNT.format(t='and')} + {_COUNT.format(t='ing')} AS score FROM g_lexical) WHERE score > 0 ORDER BY score DESC, passage_id LIMIT 25",
    "fact_expand": _F + "SELECT fact_id, round(greatest(CASE lower(head_entity) WHEN 'user 1' THEN 0.9 WHEN 'key 7' THEN 0.5 ELSE 0 END, CASE lower(tail_entity) WHEN 'user 1' THEN 0.9 WHEN 'key 7' THEN 0.5 ELSE 0 END) * CAST(0.8 AS DOUBLE), 9) AS score FROM g_facts WHERE fact_id <> 'f4' AND (lower(head_entity) IN ('user 1', 'key 7') OR lower(tail_entity) IN ('user 1', 'key 7')) ORDER BY score DESC, fact_id LIMIT 64",
    "ppr_fixed_iters": _PPR_HEAD + "".join(_PPR_STEP.format(k=k, j=k - 1) for k in (1, 2, 3)) + "\nSELECT node AS node_id, round(score, 9) AS score FROM s3 WHERE round(score, 9) > 0",
    "ppr_converged": _PPR_CONVERGED.replace("{eps}", "CAST(1e-4 AS DOUBLE)"),
    "upsert_nodes_post": _N + "SELECT * FROM g_nodes WHERE label <> 'Region' UNION ALL SELECT corpus_id, node_id, 'updated', CASE WHEN node_id = 'region:2' THEN 'Twice' ELSE label END FROM g_nodes WHERE label = 'Region' UNION ALL SELECT 'tpch', 'region:new', 'updated', 'Region'",
    "upsert_edges_post": _E + "SELECT corpus_id, edge_id, source_node_id, target_node_id, relation, CASE WHEN relation = 'IN_REGION' THEN CAST(9 AS DOUBLE) ELSE weight END AS weight FROM g_edges",
    "delete_nodes_post": _NE + "SELECT 'node' AS kind, node_id AS id FROM g_nodes WHERE node_id NOT IN ('nation:3', 'order:1', 'missing:1') UNION ALL SELECT 'edge', edge_id FROM g_edges WHERE source_node_id NOT IN ('nation:3', 'order:1', 'missing:1') AND target_node_id NOT IN ('nation:3', 'order:1', 'missing:1')",
    "delete_edges_post": _E + "SELECT edge_id FROM g_edges WHERE edge_id NOT IN ('in-region:0', 'in-region:1', 'in-region:2')",
    "delete_by_document_post": f"WITH x AS (SELECT {_DOCUMENT} AS doc), gone AS (SELECT DISTINCT 'fact:' || fact_id AS id FROM mem_facts, x WHERE corpus_id = '{LARGE}' AND list_contains(source_document_ids, doc)) SELECT corpus_id, CAST(count(*) AS BIGINT) AS n, 'node' AS kind FROM mem_facts WHERE corpus_id <> '{LARGE}' OR 'fact:' || fact_id NOT IN (SELECT id FROM gone) GROUP BY 1 UNION ALL SELECT corpus_id, CAST(count(*) AS BIGINT), 'edge' FROM edges WHERE corpus_id <> '{LARGE}' OR (coalesce(source_node_id, '') NOT IN (SELECT id FROM gone) AND coalesce(target_node_id, '') NOT IN (SELECT id FROM gone)) GROUP BY 1 UNION ALL SELECT corpus_id, CAST(count(*) AS BIGINT), k FROM mem_passages, x, (VALUES ('vector'), ('lexical')) t(k) WHERE corpus_id <> '{LARGE}' OR metadata.documentId IS DISTINCT FROM doc GROUP BY corpus_id, k",
    "delete_by_corpus_post": " UNION ALL ".join(f"SELECT corpus_id, CAST(count(*) AS BIGINT) AS n, '{t}' AS kind FROM {t} WHERE corpus_id IS DISTINCT FROM '{LARGE}' GROUP BY 1" for t in ("nodes", "edges", "mem_passages", "mem_facts", "mem_schemas")),
    "vector_upsert_post": _V + "SELECT id, CASE WHEN document_id IN ('1', '2') THEN 'moved' ELSE namespace END AS namespace FROM g_vectors",
    "vector_delete_post": _V + "SELECT id FROM g_vectors WHERE document_id <> '3'",
    "lexical_delete_post": _L + "SELECT passage_id FROM g_lexical WHERE document_id IS DISTINCT FROM 'survey'",
    "memory_upsert_post": _F + "SELECT corpus_id, pos, fact_id, CASE WHEN fact_id = 'f3' THEN 'last' ELSE state END AS state FROM g_facts UNION ALL SELECT 'memory', (SELECT max(pos) FROM g_facts) + 1, 'f-b', 'new' UNION ALL SELECT 'memory', (SELECT max(pos) FROM g_facts) + 2, 'f-a', 'new'",
    "schema_merge_post": f"WITH s AS ({_LATEST}) SELECT corpus_id, schema_id, CASE WHEN corpus_id = '{LARGE}' THEN coalesce(frequency, 0) + 1 ELSE frequency END AS frequency, CAST(len(fact_ids) + CASE WHEN corpus_id = '{LARGE}' THEN 1 ELSE 0 END AS INTEGER) AS facts, CASE WHEN corpus_id = '{LARGE}' THEN 'doc-new' ELSE source_document_ids[-1] END AS last_document, CAST(len(aliases) + CASE WHEN corpus_id = '{LARGE}' THEN 1 ELSE 0 END AS INTEGER) AS aliases FROM s",
    "schema_create_post": f"WITH s AS ({_LATEST}) SELECT corpus_id, schema_id, frequency, CAST(len(fact_ids) AS INTEGER) AS facts, relation FROM s UNION ALL SELECT corpus_id, schema_id || '-new', frequency, CAST(len(fact_ids) AS INTEGER), relation FROM s WHERE corpus_id = '{LARGE}'",
    "upsert_duplicates_post": "SELECT corpus_id, node_id, coalesce(label, '-') AS label FROM nodes QUALIFY row_number() OVER (PARTITION BY corpus_id, node_id ORDER BY ingested_at DESC, coalesce(label, '-') DESC) = 1",
    "schema_nodes_post": f"WITH s AS (SELECT DISTINCT 'schema:' || schema_id AS node_id FROM mem_schemas WHERE corpus_id = '{LARGE}'), n AS (SELECT DISTINCT node_id, CASE WHEN first(ref) LIKE '%\"schemaId\"%' THEN 'schema' ELSE 'other' END AS kind FROM nodes WHERE layer = 'ontology' AND corpus_id = '{LARGE}' GROUP BY node_id) SELECT node_id, kind FROM n WHERE node_id NOT IN (SELECT node_id FROM s) UNION ALL SELECT node_id, 'schema' FROM s",
    "integrity_report": """SELECT 'duplicate_node' AS "check", corpus_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT corpus_id FROM nodes GROUP BY corpus_id, node_id HAVING count(*) > 1) GROUP BY corpus_id
UNION ALL SELECT 'duplicate_edge', corpus_id, count(*) FROM (SELECT corpus_id FROM edges GROUP BY corpus_id, edge_id HAVING count(*) > 1) GROUP BY corpus_id
UNION ALL SELECT 'duplicate_fact', corpus_id, count(*) FROM (SELECT corpus_id FROM mem_facts GROUP BY corpus_id, fact_id HAVING count(*) > 1) GROUP BY corpus_id
UNION ALL SELECT 'duplicate_passage', corpus_id, count(*) FROM (SELECT corpus_id FROM mem_passages GROUP BY corpus_id, passage_id HAVING count(*) > 1) GROUP BY corpus_id
UNION ALL SELECT 'dangling_source', corpus_id, count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.corpus_id = e.corpus_id AND n.node_id = e.source_node_id) GROUP BY corpus_id
UNION ALL SELECT 'dangling_target', corpus_id, count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.corpus_id = e.corpus_id AND n.node_id = e.target_node_id) GROUP BY corpus_id
UNION ALL SELECT 'bad_weight', corpus_id, count(*) FROM edges WHERE weight < 0 OR isnan(weight) OR isinf(weight) GROUP BY corpus_id
UNION ALL SELECT 'missing_evidence', corpus_id, count(*) FROM (SELECT corpus_id, unnest(passage_ids) AS p FROM mem_facts) f WHERE NOT EXISTS (SELECT 1 FROM mem_passages m WHERE m.corpus_id = f.corpus_id AND m.passage_id = f.p) GROUP BY corpus_id""",
    "job_checkpoint": """SELECT 'survey' AS job_id, '{"corpusId":"c","jobId":"survey","processedDocumentIds":["d1","d2"],"updatedAt":"t1"}' AS body""",
    "lexical_index_post": _L + "SELECT passage_id, CASE WHEN passage_id IN ('1', '2') THEN 'again' ELSE document_id END AS document_id FROM g_lexical UNION ALL SELECT 'new', document_id FROM g_lexical WHERE passage_id = '3'",
    "sort_work_per_corpus": "SELECT corpus_id, n, CASE WHEN n > 1 THEN CAST(n * k - pow(2, k) + 1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS work FROM (SELECT corpus_id, CAST(count(*) AS BIGINT) AS n, CAST(ceil(log2(count(*))) AS BIGINT) AS k FROM edges GROUP BY corpus_id)",
    "vector_validate": _V + "SELECT 'checked-' || namespace AS namespace, CAST(count(*) AS BIGINT) AS n, CAST(max(len(vals)) AS INTEGER) AS dimensions FROM g_vectors GROUP BY 1",
    "activate_facts_post": _F + "SELECT fact_id, CASE WHEN schema_id IN ('view', 'click') THEN 'active' ELSE state END AS state, CASE WHEN schema_id IN ('view', 'click') AND state = 'inactive' THEN 'now' ELSE 'old' END AS updated_at FROM g_facts",
    "delete_document_counts": _DELETED + "SELECT " + ", ".join(
        _C.format(a, b)
        for a, b in (
            ("lost_p", "removed_passages"), ("lost_f", "removed_facts"), ("keep_f", "pruned_shared_facts"), ("sch", "pruned_schemas"), ("sch", "schema_frequency_adjusted"), ("lost_p", "removed_passage_nodes"),
            ("lost_f", "removed_fact_nodes"), ("orphan", "removed_entity_nodes"), ("sch WHERE false", "removed_other_nodes"), ("keep_f", "pruned_shared_nodes"), ("sch", "pruned_ontology_nodes"), ("sch WHERE false", "removed_ontology_nodes"),
            ("x WHERE removed", "removed_edges"), ("w WHERE fate = 'remove'", "removed_vectors"), ("w WHERE fate = 'rekey'", "rekeyed_vectors"), ("lost_p", "removed_lexical_passages"),
        )
    ),
    "delete_document_nodes": _DELETED + "SELECT node_id, layer FROM n WHERE node_id NOT IN (SELECT id FROM gone) AND node_id NOT IN (SELECT id FROM orphan)",
    "delete_document_edges": _DELETED + "SELECT edge_id FROM x WHERE NOT removed",
    "delete_document_vectors": _DELETED + "SELECT id, CASE fate WHEN 'rekey' THEN next ELSE doc END AS document_id FROM w WHERE fate <> 'remove'",
    "delete_document_facts": _DELETED + "SELECT fact_id, array_to_string(docs, ',') AS documents, CAST(1 AS INTEGER) AS passages FROM f WHERE NOT list_contains(docs, 'd7') UNION ALL SELECT fact_id, array_to_string(kept, ','), 1 FROM keep_f",
    "delete_document_schemas": _DELETED + "SELECT schema_id, frequency - 1 AS frequency, 'pending' AS state, 'd8' AS documents FROM sch",
}
