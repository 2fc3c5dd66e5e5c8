"""Removal of one document from a corpus with everything that only it supports.

A fixed sequence of joins: node fates, snapshot, ontology, edges, entities without
support (one round), vectors, lexical passages. Stores are DataFrames before and
after; the sixteen counters come from one aggregation over tagged rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpoint

COUNTERS = (
    "removed_passages", "removed_facts", "pruned_shared_facts", "pruned_schemas", "schema_frequency_adjusted", "removed_passage_nodes", "removed_fact_nodes", "removed_entity_nodes",
    "removed_other_nodes", "pruned_shared_nodes", "pruned_ontology_nodes", "removed_ontology_nodes", "removed_edges", "removed_vectors", "rekeyed_vectors", "removed_lexical_passages",
)


@dataclass
class Store:
    """nodes: corpus_id, node_id, layer, item_id, document_id, source_document_ids, passage_ids, fact_ids, updated_at;
    edges: corpus_id, edge_id, source_node_id, target_node_id, relation;
    vectors: corpus_id, id, namespace, document_id; lexical: corpus_id, passage_id, document_id;
    passages: corpus_id, passage_id, document_id;
    facts: corpus_id, fact_id, schema_id, source_document_ids, passage_ids, updated_at;
    schemas: corpus_id, schema_id, source_document_ids, fact_ids, frequency, stabilization_threshold, state, updated_at.
    Further columns pass through."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    lexical: DataFrame
    passages: DataFrame
    facts: DataFrame
    schemas: DataFrame


def _has(array: str | Column, value: str) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def _drop(array: str, value: Column | str) -> Column:
    return F.filter(array, lambda x: x.isNull() | (x != value))


def _flag(df: DataFrame, ids: DataFrame, key: Column | str, name: str) -> DataFrame:
    """Adds a boolean: the key is among the one-column ids."""
    known = ids.toDF("_id").distinct().withColumn(name, F.lit(True))
    key = F.col(key) if isinstance(key, str) else key
    return df.join(known, key == F.col("_id"), "left").drop("_id").withColumn(name, F.coalesce(name, F.lit(False)))


def _partition(df: DataFrame, row: str, array: str, ids: DataFrame, kept: str, lost: str) -> DataFrame:
    """Splits an id array by membership in ``ids``, in order: ``kept`` and whether any (``lost``) was among them."""
    items = df.select(row, F.posexplode(array).alias("_at", "_item"))
    marked = _flag(items, ids, "_item", "_gone")
    parts = marked.groupBy(row).agg(F.array_sort(F.collect_list(F.when(~F.col("_gone"), F.struct("_at", "_item")))).alias("_k"), F.max("_gone").alias(lost))
    parts = parts.select(row, F.transform("_k", lambda x: x["_item"]).alias(kept), lost)
    out = df.join(parts, row, "left").withColumn(lost, F.coalesce(lost, F.lit(False)))
    return out.withColumn(kept, F.coalesce(kept, F.col(array)))


def delete_document(store: Store, corpus_id: str, document_id: str, updated_at: str) -> tuple[Store, DataFrame]:
    """(store afterwards, one row of counters). Arrays of one item are bounded by the item; nothing is collected."""
    w = document_id

    def mine(df: DataFrame) -> DataFrame:
        return df.filter(F.col("corpus_id") == corpus_id)

    def rest(df: DataFrame) -> DataFrame:
        return df.filter(~F.col("corpus_id").eqNullSafe(F.lit(corpus_id)))

    nodes, edges, vectors, lexical, passages, facts, schemas = (mine(getattr(store, n)) for n in Store.__dataclass_fields__)
    listed, single = F.col("source_document_ids").isNotNull(), F.col("document_id").eqNullSafe(F.lit(w))
    mentions = (listed & _has("source_document_ids", w)) | (~listed & single)
    others = F.exists(F.coalesce("source_document_ids", F.array().cast("array<string>")), lambda x: x != w)

    # node fates
    plain = nodes.filter(~F.coalesce(F.col("layer").isin("ontology", "entity"), F.lit(False)) & mentions)
    plain = plain.withColumn("_fate", F.when(listed & others, "prune").otherwise("remove"))
    lost_passages = plain.filter("layer = 'passage' AND _fate = 'remove'").select(F.coalesce("item_id", "node_id").alias("id")).unionByName(passages.filter(single).select(F.col("passage_id").alias("id"))).distinct()
    plain = _partition(plain, "node_id", "passage_ids", lost_passages, "_passages", "_lost")
    all_lost = (F.size("passage_ids") > 0) & (F.size("_passages") == 0)
    plain = checkpoint(plain.withColumn("_fate", F.when((F.col("layer") == "fact") & all_lost, "remove").otherwise(F.col("_fate"))))
    lost_facts = plain.filter("layer = 'fact' AND _fate = 'remove'").select(F.coalesce("item_id", "node_id").alias("id"))

    # snapshot
    touched = _partition(facts.filter(_has("source_document_ids", w)), "fact_id", "passage_ids", lost_passages, "_passages", "_lost")
    touched = touched.withColumn("_docs", _drop("source_document_ids", w))
    keeps = (F.size("_docs") > 0) & ~((F.size("passage_ids") > 0) & (F.size("_passages") == 0))
    touched = checkpoint(touched.withColumn("_keep", F.coalesce(keeps, F.lit(False))))
    lost_facts = checkpoint(lost_facts.unionByName(touched.filter(~F.col("_keep")).select(F.col("fact_id").alias("id"))).distinct())
    pruned_facts = touched.filter("_keep").withColumn("source_document_ids", F.col("_docs")).withColumn("passage_ids", F.col("_passages")).withColumn("updated_at", F.lit(updated_at))
    facts_after = facts.filter(~_has("source_document_ids", w)).unionByName(pruned_facts.select(*facts.columns))

    s = _partition(schemas, "schema_id", "fact_ids", lost_facts, "_facts", "_lost")
    s = _flag(s, touched.select("schema_id"), "schema_id", "_of_fact")
    s = s.withColumn("_affected", _has("source_document_ids", w) | F.col("_lost") | F.col("_of_fact"))
    counted = F.col("_affected") & F.col("frequency").isNotNull()
    frequency = F.greatest(F.col("frequency") - 1, F.lit(0))
    state = F.when(counted & F.col("stabilization_threshold").isNotNull(), F.when(frequency >= F.col("stabilization_threshold"), "stable").otherwise("pending")).otherwise(F.col("state"))
    s = s.withColumn("state", state).withColumn("_adjusted", counted).withColumn("frequency", F.when(counted, frequency).otherwise(F.col("frequency")))
    s = s.withColumn("source_document_ids", F.when(F.col("_affected"), _drop("source_document_ids", w)).otherwise(F.col("source_document_ids")))
    s = s.withColumn("fact_ids", F.when(F.col("_affected"), F.col("_facts")).otherwise(F.col("fact_ids"))).withColumn("updated_at", F.when(F.col("_affected"), updated_at).otherwise(F.col("updated_at")))
    s = checkpoint(s)

    # ontology nodes mirror their schema, or are pruned in place without one
    post = s.select(F.concat(F.lit("schema:"), "schema_id").alias("_node"), F.lit(True).alias("_stored"), F.col("_affected").alias("_hit"), F.col("source_document_ids").alias("_docs_after"), F.col("fact_ids").alias("_facts_after"))
    onto = nodes.filter("layer = 'ontology'").join(post, F.col("node_id") == F.col("_node"), "left").drop("_node")
    onto = onto.filter(mentions | F.coalesce("_hit", F.lit(False)))
    onto = _partition(onto, "node_id", "fact_ids", lost_facts, "_own_facts", "_lost")
    onto = onto.withColumn("_docs", F.when(F.col("_stored"), F.col("_docs_after")).otherwise(_drop("source_document_ids", w)))
    onto = onto.withColumn("_support", F.get("_docs", F.lit(0)))
    onto = checkpoint(onto.withColumn("_new_facts", F.when(F.col("_stored"), F.col("_facts_after")).otherwise(F.col("_own_facts"))))

    # shared fact nodes whose fact went with the snapshot go too
    plain = _flag(plain, lost_facts, F.when(F.col("layer") == "fact", F.coalesce("item_id", "node_id")), "_fact_gone")
    plain = checkpoint(plain.withColumn("_fate", F.when(F.col("_fact_gone"), "remove").otherwise(F.col("_fate"))))
    pruned = plain.filter("_fate = 'prune'").withColumn("source_document_ids", _drop("source_document_ids", w)).withColumn("passage_ids", F.col("_passages")).withColumn("updated_at", F.lit(updated_at))
    pruned_onto = onto.filter("_support IS NOT NULL").withColumn("source_document_ids", F.col("_docs")).withColumn("fact_ids", F.col("_new_facts")).withColumn("updated_at", F.lit(updated_at))
    gone = plain.filter("_fate = 'remove'").select("node_id").unionByName(onto.filter("_support IS NULL").select("node_id"))
    changed = plain.select("node_id").unionByName(onto.select("node_id"))
    nodes_mid = nodes.join(changed, "node_id", "left_anti").unionByName(pruned.select(*nodes.columns)).unionByName(pruned_onto.select(*nodes.columns))

    # edges at removed nodes, co-occurrence edges of removed facts, then entities that lost their last support
    name = F.concat(F.lit("entity-cooccur:"), F.expr("substring(source_node_id, 8)"), F.lit(":"), F.expr("substring(target_node_id, 8)"), F.lit(":"))
    of_fact = (F.col("relation") == "entity_cooccurrence") & F.col("source_node_id").startswith("entity:") & F.col("target_node_id").startswith("entity:") & F.col("edge_id").startswith(name)
    e = _flag(edges, gone, "source_node_id", "_a")
    e = _flag(e, gone, "target_node_id", "_b")
    e = _flag(e, lost_facts, F.when(of_fact, F.expr("substring(edge_id, length(source_node_id) + length(target_node_id) + 4)")), "_c")
    e = checkpoint(e.withColumn("_out", F.col("_a") | F.col("_b") | F.col("_c")))
    ends = F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")
    candidates = e.filter("_out").select(ends).filter(F.col("node_id").startswith("entity:")).distinct().join(nodes_mid.filter("layer = 'entity'").select("node_id"), "node_id", "left_semi")
    support = e.filter(~F.col("_out") & F.col("relation").isin("entity_mention", "entity_cooccurrence")).select(ends)
    orphans = checkpoint(candidates.join(support, "node_id", "left_anti"))
    e = _flag(_flag(e, orphans, "source_node_id", "_d"), orphans, "target_node_id", "_f")
    e = e.withColumn("_out", F.col("_out") | F.col("_d") | F.col("_f"))
    nodes_after = nodes_mid.join(orphans, "node_id", "left_anti")

    # vectors of removed nodes and of the document; a survivor is named after its first remaining source
    rekey = pruned.select(F.col("node_id").alias("_node"), F.get("source_document_ids", F.lit(0)).alias("_first")).unionByName(onto.select(F.col("node_id").alias("_node"), F.col("_support").alias("_first")))
    rekey = rekey.unionByName(s.filter("_affected").select(F.concat(F.lit("schema:"), "schema_id").alias("_node"), F.get("source_document_ids", F.lit(0)).alias("_first"))).filter("_first IS NOT NULL")
    rekey = rekey.groupBy("_node").agg(F.min("_first").alias("_first"))
    v = _flag(vectors, gone.unionByName(orphans), "id", "_a").join(rekey, F.col("id") == F.col("_node"), "left").drop("_node")
    of_document = F.col("document_id").eqNullSafe(F.lit(w))
    v = v.withColumn("_fate", F.when(F.col("_a") | (of_document & F.col("_first").isNull()), "remove").when(of_document, "rekey").otherwise("keep"))
    vectors_after = v.filter("_fate <> 'remove'").withColumn("document_id", F.when(F.col("_fate") == "rekey", F.col("_first")).otherwise(F.col("document_id")))

    def tag(df: DataFrame, counter: str) -> DataFrame:
        return df.select(F.lit(counter).alias("counter"))

    layer = F.when(F.col("layer").isin("passage", "fact"), F.concat(F.lit("removed_"), "layer", F.lit("_nodes"))).otherwise(F.lit("removed_other_nodes"))
    rows = [
        tag(passages.filter(single), "removed_passages"), tag(touched.filter(~F.col("_keep")), "removed_facts"), tag(pruned_facts, "pruned_shared_facts"),
        tag(s.filter("_affected"), "pruned_schemas"), tag(s.filter("_adjusted"), "schema_frequency_adjusted"), plain.filter("_fate = 'remove'").select(layer.alias("counter")),
        tag(orphans, "removed_entity_nodes"), tag(pruned, "pruned_shared_nodes"), tag(pruned_onto, "pruned_ontology_nodes"), tag(onto.filter("_support IS NULL"), "removed_ontology_nodes"),
        tag(e.filter("_out"), "removed_edges"), tag(v.filter("_fate = 'remove'"), "removed_vectors"), tag(v.filter("_fate = 'rekey'"), "rekeyed_vectors"), tag(lexical.filter(single), "removed_lexical_passages"),
    ]
    all_rows = rows[0]
    for r in rows[1:]:
        all_rows = all_rows.unionByName(r)
    counts = all_rows.agg(*[F.count(F.when(F.col("counter") == c, 1)).alias(c) for c in COUNTERS])
    after = Store(
        rest(store.nodes).unionByName(nodes_after.select(*store.nodes.columns)),
        rest(store.edges).unionByName(e.filter(~F.col("_out")).select(*store.edges.columns)),
        rest(store.vectors).unionByName(vectors_after.select(*store.vectors.columns)),
        rest(store.lexical).unionByName(lexical.filter(~single)),
        rest(store.passages).unionByName(passages.filter(~single)),
        rest(store.facts).unionByName(facts_after.select(*store.facts.columns)),
        rest(store.schemas).unionByName(s.select(*store.schemas.columns)),
    )
    return after, counts
