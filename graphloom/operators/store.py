"""Reads and keyed writes of the corpus store; every write returns the state afterwards."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import GraphError, invalid
from graphloom.functions.scalar import document_ids, fold, merge_token

MAX_BY_IDS, MAX_ENTITIES, MAX_FACTS = 4096, 64, 100
#: Bytes of the shortest entry of a page: its field names and signs.
LEAST_ENTRY = len('{"source":"","target":""}')


# -- reads
def adjacent(edges: DataFrame, corpus_id: str, node_id: str) -> DataFrame:
    """Edges of a node in either direction, a self-loop once."""
    return edges.filter((F.col("corpus_id") == corpus_id) & ((F.col("source_node_id") == node_id) | (F.col("target_node_id") == node_id))).orderBy("edge_id")


def dangling(nodes: DataFrame, edges: DataFrame, corpus_id: str) -> DataFrame:
    """Nodes without an outgoing edge."""
    sources = edges.filter(F.col("corpus_id") == corpus_id).select(F.col("source_node_id").alias("node_id"))
    return nodes.filter(F.col("corpus_id") == corpus_id).join(sources, "node_id", "left_anti").select("node_id").orderBy("node_id")


def by_ids(items: DataFrame, id_column: str, ids: Sequence[str], unique_request: bool = False) -> DataFrame:
    """Stored items in request order: first mention wins, unknown ids are left out, an id stored twice is an error."""
    if len(ids) > MAX_BY_IDS:
        raise GraphError("RESOURCE_LIMIT", f"at most {MAX_BY_IDS} ids")
    if unique_request and len(set(ids)) < len(ids):
        raise invalid("an id is requested twice")
    wanted = items.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(ids))), f"_ord int, {id_column} string")
    hit = items.join(F.broadcast(wanted), id_column)  # the request is bounded above
    n = F.count(F.lit(1)).over(Window.partitionBy(id_column))
    checked = F.when(n > 1, F.raise_error(F.lit("INTEGRITY: a requested id is stored twice")).cast("int")).otherwise(F.col("_ord"))
    return hit.withColumn("ord", checked).drop("_ord").orderBy("ord")


def facts_by_entities(facts: DataFrame, entities: Sequence[str], active_only: bool = False, limit: int = MAX_FACTS) -> DataFrame:
    """Facts whose folded head or tail is one of the folded entities, by fact id."""
    if len(entities) > MAX_ENTITIES or not 0 <= limit <= MAX_FACTS:
        raise GraphError("RESOURCE_LIMIT", "too many entities or facts")
    keys = F.array(*[fold(F.lit(e)) for e in entities]).cast("array<string>")
    hit = facts.filter(F.arrays_overlap(F.array(fold(F.col("head_entity")), fold(F.col("tail_entity"))), keys))
    if active_only:
        hit = hit.filter("state = 'active'")
    return hit.orderBy("fact_id").limit(limit)


def active_facts(facts: DataFrame, limit: int) -> DataFrame:
    """The first active facts in stored order."""
    if not 0 <= limit <= MAX_FACTS:
        raise GraphError("RESOURCE_LIMIT", f"at most {MAX_FACTS} facts")
    return facts.filter("state = 'active'").orderBy("pos").limit(limit)


def section_counts(passages: DataFrame, facts: DataFrame, schemas: DataFrame, corpus_id: str) -> DataFrame:
    """Rows of each section of one corpus; zeros for an unknown one. One pass over the three tables."""
    sections = {"passages": passages, "facts": facts, "schemas": schemas}
    rows = None
    for name, df in sections.items():
        part = df.filter(F.col("corpus_id") == corpus_id).select(F.lit(name).alias("section"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(*[F.count(F.when(F.col("section") == n, 1)).alias(n) for n in sections])


def graph_admission(edges: DataFrame) -> DataFrame:
    """Nodes (distinct endpoints) and edges per corpus."""
    ends = edges.select("corpus_id", F.explode(F.array("source_node_id", "target_node_id")).alias("node")).distinct()
    n = ends.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("nodes"))
    return edges.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("edges")).join(n, "corpus_id").select("corpus_id", "nodes", "edges")


def transitions(edges: DataFrame, corpus_id: str) -> DataFrame:
    """``source, target, weight`` in the total order of pages."""
    return edges.filter(F.col("corpus_id") == corpus_id).orderBy("source_node_id", "target_node_id", "edge_id").select(F.col("source_node_id").alias("source"), F.col("target_node_id").alias("target"), "weight", "edge_id")


def transitions_page(edges: DataFrame, corpus_id: str, offset: int, budget: int) -> DataFrame:
    """Rows from ``offset`` whose JSON together stays within ``budget`` bytes (at least one row).

    An entry has at least ``LEAST_ENTRY`` bytes, so the rows that can fit are known:
    the window runs over them only, whatever the graph's size.
    """
    if offset < 0 or budget <= 0:
        raise invalid("offset and budget")
    page = transitions(edges, corpus_id).offset(offset).limit(budget // LEAST_ENTRY + 1)
    entry = F.to_json(F.struct("source", "target", "weight"))
    ordered = Window.orderBy("source", "target", "edge_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = page.withColumn("bytes", F.sum(F.octet_length(entry)).over(ordered)).withColumn("n", F.row_number().over(Window.orderBy("source", "target", "edge_id")))
    return sized.filter((F.col("bytes") <= budget) | (F.col("n") == 1)).select((F.col("n") + offset).alias("position"), "source", "target", "weight")


def transitions_pages(edges: DataFrame, corpus_id: str, offset: int, budget: int, generation: int | None = None, current: int | None = None) -> tuple[DataFrame, dict]:
    """A page with its protocol: ``generation``, ``total``, ``next_offset`` (null after the last row).

    A generation other than the current one raises ``GENERATION_CHANGED``; an
    offset at or beyond the end raises, unless the graph is empty and it is 0.
    """
    if generation is not None and generation != current:
        raise GraphError("GENERATION_CHANGED", f"generation {generation} was superseded by {current}")
    total = edges.filter(F.col("corpus_id") == corpus_id).count()
    if offset >= total and (offset or total):
        raise invalid(f"offset {offset} lies beyond the {total} rows")
    page = transitions_page(edges, corpus_id, offset, budget)
    rows = page.count()
    following = offset + rows
    return page, {"generation": current, "total": total, "next_offset": following if following < total else None}


def memory_load(passages: DataFrame, facts: DataFrame, schemas: DataFrame) -> DataFrame:
    """``corpus_id, section, pos, raw``: the items of all snapshots in stored order, one row per item."""
    parts = [df.select("corpus_id", F.lit(n).alias("section"), "pos", "raw") for n, df in (("passages", passages), ("facts", facts), ("schemas", schemas))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def schema_projection(schemas: DataFrame, document_id: str) -> DataFrame:
    """The short form of stored schemas for canonicalisation, with the token a merge must present."""
    return schemas.select(
        "corpus_id", "schema_id", "canonical_key", "head_type", "relation", "tail_type", "frequency", "stabilization_threshold", "version", "state",
        F.get("source_document_ids", F.lit(0)).alias("first_source_document_id"),
        F.coalesce(F.array_contains("source_document_ids", document_id), F.lit(False)).alias("contribution_present"),
        merge_token(F.col("raw")).alias("merge_token"),
    )


# -- writes
def _not_in(old: DataFrame, delta: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``delta``; nulls in keys equal each other."""
    keys = delta.select(*[F.col(k).alias(f"_{k}") for k in key])
    return old.join(keys, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]), "left_anti")


def upsert(old: DataFrame, delta: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Replace by key; within the delta the last row by ``order`` wins. Nothing of the old rows is sorted.

    Without an ``order`` a key that the delta holds twice raises ``CONFLICT``. A null
    in the key is a value like any other: it replaces the rows with the same null.
    """
    key = list(key)
    names = [c for c in delta.columns if c != order]
    row = F.struct(*names)
    one = F.max_by(row, order) if order is not None else F.any_value(row)
    rows = delta.groupBy(*key).agg(one.alias("_x"), F.count(F.lit(1)).alias("_n"))
    if order is None:
        rows = rows.withColumn("_x", F.when(F.col("_n") > 1, F.raise_error(F.lit("CONFLICT: the delta holds a key twice")).cast(rows.schema["_x"].dataType)).otherwise(F.col("_x")))
    rows = rows.select("_x.*")
    return _not_in(old, rows, key).select(*old.columns).unionByName(rows.select(*old.columns))


def upsert_nodes(nodes: DataFrame, delta: DataFrame, order: str, schemas: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Upsert of nodes; ``wanted`` (corpus_id, schema_id) adds the node of each stored schema, whose ``ref`` is the schema itself.

    A wanted schema that is not stored raises ``INTEGRITY``; wanted twice counts once.
    """
    out = upsert(nodes, delta, ["corpus_id", "node_id"], order)
    if wanted is None:
        return out
    ids = wanted.select("corpus_id", "schema_id").distinct()
    found = ids.join(schemas.select("corpus_id", "schema_id", "raw", F.lit(True).alias("_there")), ["corpus_id", "schema_id"], "left")
    missing = F.raise_error(F.lit("INTEGRITY: a wanted schema is not stored")).cast("string")
    hydrated = {"corpus_id": F.col("corpus_id"), "node_id": F.concat(F.lit("schema:"), "schema_id"), "layer": F.lit("ontology"), "ref": F.when(F.col("_there"), F.col("raw")).otherwise(missing)}
    rows = found.select(*[hydrated.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema])
    return upsert(out, rows, ["corpus_id", "node_id"])


def create_edge(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add edges; an id that is stored, or an end that is no node, raises."""
    key = ["corpus_id", "edge_id"]
    known = new.join(edges.select(*key, F.lit(True).alias("_old")), key, "left")
    for end in ("source_node_id", "target_node_id"):
        known = known.join(nodes.select("corpus_id", F.col("node_id").alias(end), F.lit(True).alias(f"_{end}")).distinct(), ["corpus_id", end], "left")
    bad = F.when(F.col("_old"), F.raise_error(F.lit("CONFLICT: the edge exists"))).when(F.col("_source_node_id").isNull() | F.col("_target_node_id").isNull(), F.raise_error(F.lit("NOT_FOUND: an end of the edge is no node")))
    checked = known.withColumn("edge_id", F.coalesce(bad.cast("string"), F.col("edge_id")))
    return edges.unionByName(checked.select(*edges.columns))


def update_edge(edges: DataFrame, corpus_id: str, edge_id: str, **values: object) -> DataFrame:
    """Set columns of one edge; an unknown id changes nothing."""
    hit = (F.col("corpus_id") == corpus_id) & (F.col("edge_id") == edge_id)
    return edges.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges without those of ``ids`` (corpus_id, edge_id)."""
    return _not_in(edges, ids, ["corpus_id", "edge_id"])


def get_edge(edges: DataFrame, corpus_id: str, edge_id: str) -> DataFrame:
    return edges.filter((F.col("corpus_id") == corpus_id) & (F.col("edge_id") == edge_id))


def exists(df: DataFrame) -> bool:
    return bool(df.take(1))


def delete_by_corpus(tables: dict[str, DataFrame], corpus_id: str) -> dict[str, DataFrame]:
    """Every table without the rows of a corpus; rows of no corpus stay."""
    return {name: df.filter(~F.col("corpus_id").eqNullSafe(F.lit(corpus_id))) for name, df in tables.items()}


def delete_document_rows(df: DataFrame, corpus_id: str, document_id: str) -> DataFrame:
    """Vectors or lexical passages of a corpus without those of one document."""
    return df.filter(~((F.col("corpus_id") == corpus_id) & F.col("document_id").eqNullSafe(F.lit(document_id))))


def upsert_vectors(vectors: DataFrame, delta: DataFrame, order: str | None = None, max_dimensions: int = 4096) -> DataFrame:
    """Upsert of vectors by id; a vector without values, with too many, or with one that is null or not finite raises."""
    size = F.size("values")
    strange = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bad = F.col("values").isNull() | (size < 1) | (size > max_dimensions) | F.coalesce(strange, F.lit(True))
    wrong = F.raise_error(F.lit(f"INVALID_ARGUMENT: a vector has 1 to {max_dimensions} finite values")).cast("array<double>")
    return upsert(vectors, delta.withColumn("values", F.when(bad, wrong).otherwise(F.col("values"))), ["corpus_id", "id"], order)


def index_passages(lexical: DataFrame, delta: DataFrame, order: str | None = None) -> DataFrame:
    """Lexical passages replaced by (corpus_id, passage_id); a passage without an id raises."""
    named = F.when(F.col("passage_id").isNull(), F.raise_error(F.lit("INVALID_ARGUMENT: a passage has no id")).cast("string")).otherwise(F.col("passage_id"))
    return upsert(lexical, delta.withColumn("passage_id", named), ["corpus_id", "passage_id"], order)


def save_checkpoint(checkpoints: DataFrame, job_id: str, corpus_id: str, processed: Sequence[str], updated_at: str) -> DataFrame:
    """Job checkpoints (job_id, body) with the one of this job replaced; ``body`` is canonical JSON."""
    body = json.dumps({"corpusId": corpus_id, "jobId": job_id, "processedDocumentIds": list(processed), "updatedAt": updated_at}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    row = checkpoints.sparkSession.createDataFrame([(job_id, body)], "job_id string, body string")
    return upsert(checkpoints.select("job_id", "body"), row, ["job_id"])


def load_checkpoint(checkpoints: DataFrame, job_id: str) -> DataFrame:
    """The body of a job's checkpoint, or no row."""
    return checkpoints.filter(F.col("job_id") == job_id).select("job_id", "body")


def integrity(nodes: DataFrame, edges: DataFrame, facts: DataFrame, passages: DataFrame) -> DataFrame:
    """``check, corpus_id, n``: violations per corpus; no row for a check without any.

    Ids stored twice, edges whose ends are no nodes, weights that are negative or
    not finite, and evidence of facts that is no passage.
    """
    parts = []
    for name, df, column in (("duplicate_node", nodes, "node_id"), ("duplicate_edge", edges, "edge_id"), ("duplicate_fact", facts, "fact_id"), ("duplicate_passage", passages, "passage_id")):
        parts.append(df.groupBy("corpus_id", column).count().filter("count > 1").select(F.lit(name).alias("check"), "corpus_id"))
    known = nodes.select("corpus_id", "node_id").distinct()
    for end in ("source", "target"):
        ends = edges.select("corpus_id", F.col(f"{end}_node_id").alias("node_id"))
        parts.append(ends.join(known, ["corpus_id", "node_id"], "left_anti").select(F.lit(f"dangling_{end}").alias("check"), "corpus_id"))
    parts.append(edges.filter((F.col("weight") < 0) | F.isnan("weight") | (F.abs("weight") == float("inf"))).select(F.lit("bad_weight").alias("check"), "corpus_id"))
    evidence = facts.select("corpus_id", F.explode("passage_ids").alias("passage_id"))
    parts.append(evidence.join(passages.select("corpus_id", "passage_id").distinct(), ["corpus_id", "passage_id"], "left_anti").select(F.lit("missing_evidence").alias("check"), "corpus_id"))
    return reduce(DataFrame.unionByName, parts).groupBy("check", "corpus_id").agg(F.count(F.lit(1)).alias("n"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, corpus_id: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and all edges at these ids go, also edges of ids that were no node. ``ids``: node_id."""
    gone = ids.select(F.lit(corpus_id).alias("corpus_id"), "node_id").distinct()
    kept = nodes.join(gone, ["corpus_id", "node_id"], "left_anti")
    for end in ("source_node_id", "target_node_id"):
        edges = edges.join(gone.withColumnRenamed("node_id", end), ["corpus_id", end], "left_anti")
    return kept, edges


def delete_by_document(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, lexical: DataFrame, corpus_id: str, document_id: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Whole nodes that list the document (shared ones too), their edges, and its vectors and lexical passages."""
    listed = nodes.filter((F.col("corpus_id") == corpus_id) & F.array_contains(document_ids(F.col("ref")), document_id)).select("node_id")
    nodes, edges = delete_nodes(nodes, edges, corpus_id, listed)
    mine = (F.col("corpus_id") == corpus_id) & F.col("document_id").eqNullSafe(F.lit(document_id))
    return nodes, edges, vectors.filter(~mine), lexical.filter(~mine)


def activate_facts(facts: DataFrame, schema_ids: Sequence[str], updated_at: str) -> DataFrame:
    """Inactive facts of these schemas become active."""
    hit = F.coalesce((F.col("state") == "inactive") & F.col("schema_id").isin(list(schema_ids)), F.lit(False))
    return facts.withColumn("updated_at", F.when(hit, updated_at).otherwise(F.col("updated_at"))).withColumn("state", F.when(hit, "active").otherwise(F.col("state")))


def memory_upsert(stored: DataFrame, delta: DataFrame, id_column: str) -> DataFrame:
    """Section merge: a stored id is replaced in its (last) place, new ids follow in request order (``_ord``).

    A request of more than ``MAX_BY_IDS`` items raises ``RESOURCE_LIMIT``.
    """
    if delta.limit(MAX_BY_IDS + 1).count() > MAX_BY_IDS:
        raise GraphError("RESOURCE_LIMIT", f"at most {MAX_BY_IDS} items")
    columns = [c for c in stored.columns if c != "pos"]
    last = delta.groupBy("corpus_id", id_column).agg(F.max_by(F.struct(*columns), "_ord").alias("_x"), F.min("_ord").alias("_ord"))
    place = stored.groupBy("corpus_id", id_column).agg(F.max("pos").alias("pos"))
    known = last.join(place, ["corpus_id", id_column]).select("_x.*", "pos")
    replaced = known.select("corpus_id", id_column, "pos")
    kept = stored.join(replaced, ["corpus_id", id_column, "pos"], "left_anti")
    end = stored.groupBy("corpus_id").agg(F.max("pos").alias("_end"))
    new = last.join(place, ["corpus_id", id_column], "left_anti")
    rank = F.row_number().over(Window.partitionBy("corpus_id").orderBy("_ord"))  # the request only, at most one section's delta
    added = new.join(end, "corpus_id", "left").select("_x.*", (F.coalesce("_end", F.lit(-1)) + rank).cast("bigint").alias("pos"))
    return kept.select(*stored.columns).unionByName(known.select(*stored.columns)).unionByName(added.select(*stored.columns))


def memory_update(stored: dict[str, DataFrame], sections: dict[str, DataFrame], merges: DataFrame | None = None) -> dict[str, DataFrame]:
    """All sections of a memory request at once; whole schemas and schema merges exclude each other."""
    if "schemas" in sections and merges is not None:
        raise invalid("schemas and schema merges exclude each other")
    ids = {"passages": "passage_id", "facts": "fact_id", "schemas": "schema_id"}
    if unknown := sections.keys() - ids.keys():
        raise invalid(f"unknown sections: {sorted(unknown)}")
    out = {name: memory_upsert(df, sections[name], ids[name]) if name in sections else df for name, df in stored.items()}
    return out | {"schemas": schema_merge(out["schemas"], merges)} if merges is not None else out


_EMPTY = "array<string>"


def schema_merge(stored: DataFrame, intents: DataFrame) -> DataFrame:
    """Compare-and-swap merge of schemas.

    ``intents``: corpus_id, schema_id, token, document_id, frequency_delta, fact_ids,
    aliases, and optionally ``mode`` (``merge`` if null) and ``created``, a struct of
    the other stored columns. ``create``: the schema must be absent and becomes the
    struct. ``merge``: it must be stored, the token must equal the stored row's, and
    ``frequency_delta`` is positive exactly if the document is new. Appends keep
    order; aliases are unique by (label, language, source). Two intents for one
    schema are invalid. A null array counts as an empty one. Any error fails the
    whole merge; a schema without an intent stays as it is.
    """
    key = ["corpus_id", "schema_id"]
    rest = [f for f in stored.schema if f.name not in key]
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    have = set(intents.columns)
    i = intents.select(
        *key, *[F.col(c).alias(f"_{c}") for c in ("token", "document_id", "frequency_delta", "fact_ids", "aliases")],
        F.coalesce(F.col("mode") if "mode" in have else F.lit(None).cast("string"), F.lit("merge")).alias("_mode"),
        (F.col("created") if "created" in have else F.lit(None)).cast(f"struct<{made.replace('` ', '`: ')}>").alias("_created"),
    )
    names = [c for c in i.columns if c not in key]
    i = i.groupBy(*key).agg(F.any_value(F.struct(*names)).alias("_i"), F.count(F.lit(1)).alias("_n")).select(F.col("corpus_id").alias("_c"), F.col("schema_id").alias("_s"), "_n", "_i.*")
    j = stored.withColumn("_stored", F.lit(True)).join(i, F.col("corpus_id").eqNullSafe(F.col("_c")) & F.col("schema_id").eqNullSafe(F.col("_s")), "full")

    def listed(column: str, kind: str = _EMPTY) -> Column:
        return F.coalesce(F.col(column), F.array().cast(kind))

    def fail(message: str) -> Column:
        return F.raise_error(F.lit(message)).cast("bigint")

    hit, create, there = F.col("_n").isNotNull(), F.col("_mode") == "create", F.col("_stored").isNotNull()
    new = ~F.array_contains(listed("source_document_ids"), F.col("_document_id"))
    frequency = (
        F.when(~hit, F.col("frequency"))
        .when(F.col("_n") > 1, fail("INVALID_ARGUMENT: two intents for one schema"))
        .when(~F.col("_mode").isin("create", "merge"), fail("INVALID_ARGUMENT: mode"))
        .when(create & there, fail("CONFLICT: the schema exists"))
        .when(create & F.col("_created").isNull(), fail("INVALID_ARGUMENT: nothing to create"))
        .when(create, F.col("_created")["frequency"])
        .when(~there, fail("CONFLICT: the schema is not stored"))
        .when(~F.col("_token").eqNullSafe(merge_token(F.col("raw"))), fail("CONFLICT: the schema changed"))
        .when(F.coalesce(new != (F.col("_frequency_delta") > 0), F.lit(True)), fail("INVALID_ARGUMENT: frequency delta"))
        .otherwise(F.coalesce("frequency", F.lit(0)) + F.col("_frequency_delta"))
    )
    facts = F.concat(listed("fact_ids"), F.filter(F.array_distinct(listed("_fact_ids")), lambda x: ~F.coalesce(F.array_contains(listed("fact_ids"), x), F.lit(False))))
    documents = F.when(new, F.concat(listed("source_document_ids"), F.array("_document_id"))).otherwise(F.col("source_document_ids"))
    kind = stored.schema["aliases"].dataType.simpleString()

    def same(a: Column, b: Column) -> Column:
        return a["label"].eqNullSafe(b["label"]) & a["language"].eqNullSafe(b["language"]) & a["source"].eqNullSafe(b["source"])

    fresh = F.filter(listed("_aliases", kind), lambda x: ~F.exists(listed("aliases", kind), lambda y: same(x, y)))
    merged = {"fact_ids": facts, "source_document_ids": documents, "aliases": F.concat(listed("aliases", kind), fresh)}
    out = {"corpus_id": F.coalesce("corpus_id", "_c"), "schema_id": F.coalesce("schema_id", "_s"), "frequency": frequency}
    for f in rest:
        if f.name != "frequency":
            value = F.when(hit, merged[f.name]).otherwise(F.col(f.name)) if f.name in merged else F.col(f.name)
            out[f.name] = F.when(hit & create, F.col("_created")[f.name]).otherwise(value)
    return j.select(*[out[c].alias(c) for c in stored.columns])
