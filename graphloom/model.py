"""Schemas of the stores, and tagged property values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import checkpoint

VALUE = "struct<t:string,s:string,i:bigint,d:double,b:boolean,x:binary>"
PROPERTIES = f"map<string,{VALUE}>"
GRAPH_NODES = f"id string, labels array<string>, properties {PROPERTIES}"
GRAPH_EDGES = f"id string, `from` string, `to` string, edge_type string, properties {PROPERTIES}"
#: Fields of a tagged value by Python type; a value keeps its type, so 1 and 1.0 differ.
_FIELD = {str: "s", bool: "b", int: "i", float: "d", bytes: "x"}


def tagged(value: object) -> Column:
    """A literal of the closed scalar union."""
    field = _FIELD[type(value)]
    parts = [F.lit(field).alias("t")]
    for name, kind in (("s", "string"), ("i", "bigint"), ("d", "double"), ("b", "boolean"), ("x", "binary")):
        parts.append((F.lit(value) if name == field else F.lit(None)).cast(kind).alias(name))
    return F.struct(*parts).cast(VALUE)


def tagged_column(column: Column, field: str) -> Column:
    """A column as tagged values."""
    parts = [F.lit(field).alias("t")]
    for name, kind in (("s", "string"), ("i", "bigint"), ("d", "double"), ("b", "boolean"), ("x", "binary")):
        parts.append((column if name == field else F.lit(None)).cast(kind).alias(name))
    return F.struct(*parts)


def properties(**columns: tuple[Column, str]) -> Column:
    """Property map of non-null columns: ``name=(column, field)``."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.when(c.isNotNull(), tagged_column(c, f)).alias("value")) for k, (c, f) in columns.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def fixed_properties(**columns: tuple[Column, str]) -> Column:
    """Property map of columns that are never null; the optimizer sees through it, so filters on a property reach the scan."""
    return F.create_map(*[x for k, (c, f) in columns.items() for x in (F.lit(k), tagged_column(c, f))])


def number(properties: Column, name: str) -> Column:
    """A numeric property as double; 0.0 for a missing or other value."""
    v = properties[name]
    return F.coalesce(F.when(v["t"] == "d", v["d"]).when(v["t"] == "i", v["i"].cast("double")), F.lit(0.0))


def cypher_view(nodes: DataFrame, edges: DataFrame, corpus_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The corpus store as a property graph: stable ids ``n1 ...`` in key order, edges without both endpoints dropped.

    Numbering needs one total order, so ids come from a range sort: each
    partition's rows are numbered after the counts of the partitions before it.
    """
    if corpus_id is not None:
        nodes, edges = nodes.filter(F.col("corpus_id") == corpus_id), edges.filter(F.col("corpus_id") == corpus_id)
    ids = numbered(nodes, ["corpus_id", "node_id"], "_n").select("corpus_id", "node_id", F.concat(F.lit("n"), F.col("_n")).alias("id"))
    props = properties(nodeId=(F.col("node_id"), "s"), corpusId=(F.col("corpus_id"), "s"), layer=(F.col("layer"), "s"), ref=(F.col("ref"), "s"))
    out_nodes = nodes.join(ids, ["corpus_id", "node_id"]).select("id", F.array("label").alias("labels"), props.alias("properties"))
    a = ids.select("corpus_id", F.col("node_id").alias("source_node_id"), F.col("id").alias("from"))
    b = ids.select("corpus_id", F.col("node_id").alias("target_node_id"), F.col("id").alias("to"))
    kept = edges.join(a, ["corpus_id", "source_node_id"]).join(b, ["corpus_id", "target_node_id"])
    props = properties(edgeId=(F.col("edge_id"), "s"), weight=(F.col("weight"), "d"), bridgeKind=(F.col("bridge_kind"), "s"))
    numbered_edges = numbered(kept, ["corpus_id", "edge_id"], "_n")
    out_edges = numbered_edges.select(F.concat(F.lit("e"), F.col("_n")).alias("id"), "from", "to", F.col("relation").alias("edge_type"), props.alias("properties"))
    return out_nodes, out_edges


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in key order without gathering all rows in one task.

    One range sort; the offsets of the partitions come from their counts (one row
    each). The sorted rows are checkpointed: range bounds are sampled, so a second
    run of the sort could cut elsewhere.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpoint(placed.withColumn("_mid", F.monotonically_increasing_id()))
    part, at = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("_part", part)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    earlier = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(earlier), "_part").withColumn(name, F.col("_before") + at + 1).drop("_mid", "_part", "_before")
