"""Exact vector search, lexical search, fact expansion and candidate search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import GraphError, invalid
from graphloom.functions.scalar import cosine, fold, token_score, utf16_key
from graphloom.session import map_arrow, spread

#: Limits of a request; all may be raised.
MAX_DIMENSIONS, MAX_TOP_K, MAX_SLOTS, MAX_SLOT_HITS, MAX_SEEDS = 4096, 10_000, 8, 128, 512


def _check_query(vector: Sequence[float]) -> np.ndarray:
    q = np.asarray(vector, float)
    if q.ndim != 1 or not 1 <= len(q) <= MAX_DIMENSIONS or not np.isfinite(q).all():
        raise invalid(f"a query vector has 1 to {MAX_DIMENSIONS} finite values")
    return q


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, usable): rows of another length or with nulls are zero and unusable."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy()
    usable = lengths == dim
    flat = pa.compute.list_flatten(column.filter(pa.array(usable))).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dim))
    out[usable] = flat.reshape(-1, dim)
    finite = np.isfinite(out).all(axis=1)
    out[~finite] = 0.0
    return out, usable


def scored(vectors: DataFrame, queries: dict[str, tuple[str, np.ndarray, float, int]], strict: bool = False) -> DataFrame:
    """Best rows of each batch for each slot ``{slot: (namespace, vector, threshold, k)}``: slot, id, score.

    One matrix product per Arrow batch, and at most ``k`` rows (and ties) per slot
    leave it: the global top-k sorts a sliver of the table. ``strict`` raises for
    stored vectors of another length instead of scoring them 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = np.array(batch.column(2).to_pylist(), object)
            for slot, (namespace, q, threshold, k) in queries.items():
                mine = np.flatnonzero(spaces == namespace)
                if not len(mine) or not k:
                    continue
                part = batch.take(pa.array(mine))
                rows, usable = _matrix(part.column(1), len(q))
                if strict and not usable.all():
                    raise GraphError("INTEGRITY", "a stored vector has other dimensions than the query")
                score = cosine(rows, q)
                if strict:
                    score = np.clip(score, -1.0, 1.0)
                keep = np.flatnonzero(score >= threshold)
                if len(keep) > k:
                    cut = np.partition(score[keep], len(keep) - k)[len(keep) - k]
                    keep = keep[score[keep] >= cut]
                yield pa.RecordBatch.from_arrays([pa.array([slot] * len(keep), pa.string()), part.column(0).take(pa.array(keep)), pa.array(score[keep], pa.float64())], names=["slot", "id", "score"])

    return map_arrow(spread(vectors.select("id", "values", "namespace")), run, "slot string, id string, score double")


def vector_search(vectors: DataFrame, corpus_id: str, namespace: str, query: Sequence[float], top_k: int = 10, threshold: float | None = None) -> DataFrame:
    """``id, score``: exact cosine top-k of a corpus and namespace, ties by id. Vectors of another length score 0."""
    q = _check_query(query)
    if not 0 <= top_k <= MAX_TOP_K:
        raise GraphError("INVALID_TOP_K", f"top_k lies in 0..{MAX_TOP_K}")
    mine = vectors.filter((F.col("corpus_id") == corpus_id) & (F.col("namespace") == namespace))
    hits = scored(mine, {"": (namespace, q, -np.inf if threshold is None else threshold, top_k)})
    return hits.select("id", "score").orderBy(F.desc("score"), "id").limit(top_k)


def candidate_search(vectors: DataFrame, corpus_id: str, slots: Sequence[dict], items: DataFrame | None = None) -> DataFrame:
    """``slot_id, rank, id, score`` of up to eight slots in one scan; with ``items`` (id, payload) the hits are hydrated and must exist."""
    if len(slots) > MAX_SLOTS or sum(s["limit"] for s in slots) > MAX_SLOT_HITS or len({s["slot_id"] for s in slots}) < len(slots):
        raise GraphError("RESOURCE_LIMIT", "too many slots or hits, or a slot id twice")
    queries = {s["slot_id"]: (s["namespace"], _check_query(s["query"]), s.get("threshold", -1.0), s["limit"]) for s in slots}
    mine = vectors.filter((F.col("corpus_id") == corpus_id) & F.col("namespace").isin([s["namespace"] for s in slots]))
    best = Window.partitionBy("slot").orderBy(F.desc("score"), utf16_key(F.col("id")))
    limits = F.create_map(*[x for s in slots for x in (F.lit(s["slot_id"]), F.lit(s["limit"]))])
    hits = scored(mine, queries, strict=True).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limits[F.col("slot")])
    hits = hits.select(F.col("slot").alias("slot_id"), "rank", "id", "score")
    if items is None:
        return hits
    joined = hits.join(items.select("id", "payload", F.lit(True).alias("_there")), "id", "left")
    missing = F.raise_error(F.lit("INTEGRITY: a hit has no stored item")).cast("string")
    return joined.withColumn("payload", F.when(F.col("_there"), F.col("payload")).otherwise(missing)).drop("_there")


def lexical_search(passages: DataFrame, corpus_id: str, query: str, top_k: int = 10) -> DataFrame:
    """``passage_id, score``: passages by substring counts of the query's tokens, ties by id."""
    score = token_score(F.col("text"), query)
    return (
        passages.filter(F.col("corpus_id") == corpus_id)
        .select("passage_id", F.coalesce(score, F.lit(0)).alias("score"))
        .filter("score > 0")
        .orderBy(F.desc("score"), "passage_id")
        .limit(max(top_k, 0))
    )


def fact_expand(facts: DataFrame, seeds: dict[str, float], excluded: Sequence[str] = (), attenuation: float = 1.0, limit: int = 64) -> DataFrame:
    """``fact_id, score``: facts whose folded head or tail is a seed, by the better seed times the attenuation.

    An absent end counts 0, so a negative seed beside an absent one gives 0.
    """
    if len(seeds) > MAX_SEEDS:
        raise GraphError("RESOURCE_LIMIT", f"at most {MAX_SEEDS} seeds")
    if not seeds:
        return facts.select("fact_id", F.lit(0.0).alias("score")).limit(0)
    spark = facts.sparkSession
    keys = spark.createDataFrame([(k, float(v)) for k, v in seeds.items()], "key string, seed double")

    def side(name: str) -> DataFrame:  # at most MAX_SEEDS rows
        return F.broadcast(keys.select(F.col("key").alias(f"_{name}"), F.col("seed").alias(f"_{name}_score")))

    hit = facts.filter(~F.col("fact_id").isin(list(excluded))) if excluded else facts
    hit = hit.select("fact_id", fold(F.col("head_entity")).alias("_head"), fold(F.col("tail_entity")).alias("_tail"))
    hit = hit.join(side("head"), "_head", "left").join(side("tail"), "_tail", "left").filter("_head_score IS NOT NULL OR _tail_score IS NOT NULL")
    score: Column = F.greatest(F.coalesce("_head_score", F.lit(0.0)), F.coalesce("_tail_score", F.lit(0.0))) * attenuation
    return hit.select("fact_id", score.alias("score")).orderBy(F.desc("score"), utf16_key(F.col("fact_id"))).limit(limit)
