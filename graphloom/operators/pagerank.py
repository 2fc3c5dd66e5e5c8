"""Weighted personalised PageRank with damped hubs, as an iteration of joins.

Scores are kept sparse: a node that no mass has reached has no row. Nodes get
numbers once, and the edges are prepared once (weight share times damping of the
target) and stay partitioned by source: an iteration moves scores along them and
shuffles only partial sums by target, which are again partitioned like the sources.
Sources with more edges than a partition should hold are kept apart: their edges
lie anywhere and meet the few scores of such sources in a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.errors import GraphError, invalid
from graphloom.functions.scalar import utf16_key
from graphloom.session import checkpoint, shuffle_partitions

MAX_ITERATIONS, MAX_SEEDS, MAX_HITS = 128, 512, 100
#: In the loop the plans are known: nothing is to be coalesced, so that scores stay where their edges are.
_LOOP = {"spark.sql.adaptive.enabled": "false", "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@dataclass
class Ranking:
    scores: DataFrame  # node_id, score
    iterations: int
    converged: bool
    l1_delta: float


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def number_nodes(edges: DataFrame, hub_threshold: int) -> DataFrame:
    """``node, id, out, degree, damp`` of every endpoint; written once, so the numbers stay."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("weight").alias("w"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(None).cast("double").alias("w"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    degree = ends.groupBy("node").agg(F.sum("w").alias("out"), F.count(F.lit(1)).alias("degree"), F.sum("o").alias("out_edges"))
    hub = F.col("node").startswith("schema:") & (F.col("degree") > hub_threshold)
    return checkpoint(degree.select("node", F.monotonically_increasing_id().alias("id"), "out", "out_edges", F.when(hub, 1.0 / F.log2(F.col("degree") + 2.0)).otherwise(F.lit(1.0)).alias("damp")))


def checked(edges: DataFrame) -> DataFrame:
    """``src, dst, weight``; a null endpoint and a weight that is null, negative or not finite raise."""
    e = edges.select(F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"), "weight")
    bad = F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") == float("inf"))
    weight = F.when(bad, F.raise_error(F.lit("INTEGRITY: a weight is negative or not finite")).cast("double")).otherwise(F.col("weight"))
    open_end = F.col("src").isNull() | F.col("dst").isNull()
    return e.withColumn("weight", F.when(open_end, F.raise_error(F.lit("INTEGRITY: an edge has no source or no target")).cast("double")).otherwise(weight))


def prepare(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, share`` in node numbers: weight over the source's out-weight, damped at the target."""
    stuck = F.raise_error(F.lit("INTEGRITY: the weights of a source sum to 0")).cast("double")
    share = F.when(F.col("out") > 0, F.col("weight") / F.col("out") * F.col("damp")).otherwise(stuck)
    target = nodes.select(F.col("node").alias("dst"), F.col("id").alias("_to"), "damp")
    source = nodes.select(F.col("node").alias("src"), F.col("id").alias("_from"), "out")
    return edges.join(target, "dst").join(source, "src").select(F.col("_from").alias("src"), F.col("_to").alias("dst"), share.alias("share"))


def teleport(nodes: DataFrame, seeds: dict[str, float]) -> DataFrame:
    """``id, score``: seeds in the graph over their sum, or uniform over all nodes if the sum is not positive."""
    spark = nodes.sparkSession
    given = spark.createDataFrame([(k, float(v)) for k, v in seeds.items()] or [("", 0.0)], "node string, score double")
    found = nodes.join(F.broadcast(given), "node").select("id", "score").collect() if seeds else []  # at most MAX_SEEDS rows
    total = sum(r["score"] for r in found)
    if total > 0:
        return spark.createDataFrame([(r["id"], r["score"] / total) for r in found], "id bigint, score double").coalesce(1)
    n = nodes.count()
    return nodes.select("id", F.lit(1.0 / n if n else 0.0).alias("score"))


def personalised_pagerank(
    edges: DataFrame, seeds: dict[str, float], teleport_probability: float = 0.15, epsilon: float | None = 1e-9, max_iterations: int = 32, hub_threshold: int = 100
) -> Ranking:
    """Iterate until the L1 change is below ``epsilon`` or ``max_iterations`` are done.

    ``edges``: source_node_id, target_node_id, weight of one corpus; repeated edges
    count again. Mass of sinks and of damped hubs is lost. ``epsilon=None`` runs
    exactly ``max_iterations``; ``l1_delta`` is the change of the last one. Nodes
    without mass have no row. A null endpoint, a null, negative or infinite weight
    and a source whose weights sum to 0 raise ``INTEGRITY``. No edges: no scores,
    converged.
    """
    if max_iterations > MAX_ITERATIONS or len(seeds) > MAX_SEEDS:
        raise GraphError("RESOURCE_LIMIT", "too many iterations or seeds")
    spark, parts = edges.sparkSession, shuffle_partitions(edges.sparkSession)
    edges = checked(edges)
    nodes = number_nodes(edges, hub_threshold)
    size = nodes.agg(F.coalesce(F.sum("out_edges"), F.lit(0)).alias("n")).first()["n"]
    # fewer than ``parts`` sources can have more than their share of the edges
    large = [r["id"] for r in nodes.filter(F.col("out_edges") * parts > size).select("id").collect()] if size > parts * 1000 else []
    is_large = F.col("src").isin(large) if large else F.lit(False)
    shares = checkpoint(prepare(edges, nodes))
    kept = 1.0 - teleport_probability
    with settings(spark, _LOOP):
        by_source = shares.filter(~is_large).repartition(parts, "src").sortWithinPartitions("src").persist()
        of_large = shares.filter(is_large).persist() if large else None
        jump = teleport(nodes, seeds).persist()
        restart = jump.select("id", (F.col("score") * teleport_probability).alias("new"))

        def moved(scores: DataFrame) -> DataFrame:
            """New shares of mass by target, and the restarts."""
            along = by_source.join(scores, F.col("src") == F.col("id"))
            if of_large is not None:
                few = F.broadcast(scores.filter(F.col("id").isin(large)))  # fewer rows than partitions
                along = along.unionByName(of_large.join(few, F.col("src") == F.col("id")))
            return along.select(F.col("dst").alias("id"), (F.col("score") * F.col("share") * kept).alias("new")).unionByName(restart)

        scores, delta, done = jump, 0.0, 0
        for done in range(1, max_iterations + 1):
            both = moved(scores).withColumn("old", F.lit(0.0)).unionByName(scores.select("id", F.lit(0.0).alias("new"), F.col("score").alias("old")))
            change = Observation()
            step = both.groupBy("id").agg(F.sum("new").alias("score"), F.sum("old").alias("old"))
            step = step.observe(change, F.sum(F.abs(F.col("score") - F.col("old"))).alias("delta")).select("id", "score")
            # one job for the scores and their change; every plan starts from written scores, a lost executor costs one iteration
            scores, delta = checkpoint(step), change.get["delta"] or 0.0
            if epsilon is not None and delta < epsilon:
                break
        out = checkpoint(scores.filter("score > 0"))
        for df in (by_source, of_large, jump):
            if df is not None:
                df.unpersist()
    converged = epsilon is None or not max_iterations or delta < epsilon
    if not size:
        done, converged = 0, True
    return Ranking(out.join(nodes, "id").select(F.col("node").alias("node_id"), "score"), done, converged, delta)


def top_nodes(scores: DataFrame, prefix: str, limit: int) -> DataFrame:
    """``rank, node_id, score`` of the best nodes of one kind, ties in UTF-16 order."""
    best = scores.filter(F.col("node_id").startswith(prefix)).orderBy(F.desc("score"), utf16_key(F.col("node_id"))).limit(limit)
    # only the limited rows are numbered
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), utf16_key(F.col("node_id")))).alias("rank"), "node_id", "score")


def materialise(ranking: Ranking, kinds: dict[str, tuple[int, DataFrame]], strict: bool = True) -> DataFrame:
    """The whole result of a ranking: ``kind, rank, node_id, score, payload, iterations, converged, l1_delta``.

    ``kinds``: prefix of the node ids -> (limit, items ``node_id, payload``). Ranked
    nodes must have exactly one stored item; none or two raise ``INTEGRITY``.
    Without ``strict`` a node that has none keeps its row with a null payload, and
    one that has several gets a row of its rank for each.
    """
    out = None
    for prefix, (limit, items) in kinds.items():
        if not 0 <= limit <= MAX_HITS:
            raise invalid(f"a limit lies in 0..{MAX_HITS}")
        best = top_nodes(ranking.scores, prefix, limit)
        found = items.select("node_id", "payload").join(F.broadcast(best.select("node_id")), "node_id", "left_semi")  # at most MAX_HITS rows
        payload = F.col("payload")
        if strict:
            found = found.groupBy("node_id").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("_n"))
            payload = F.when(F.col("_n") == 1, payload).otherwise(F.raise_error(F.lit("INTEGRITY: a ranked node has no stored item, or several")).cast("string"))
        part = best.join(found, "node_id", "left").select(F.lit(prefix.rstrip(":")).alias("kind"), "rank", "node_id", "score", payload.alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("iterations", F.lit(ranking.iterations)).withColumn("converged", F.lit(ranking.converged)).withColumn("l1_delta", F.lit(ranking.l1_delta))
