"""References to records that do not exist, at the moment the referring row arrived.

Parents and references are range-partitioned together on one key. In each range
the parents become sorted arrays (keys, version starts, running latest end); the
references stream past them in Arrow batches and are probed by binary search.
Only misses leave the range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import map_arrow, shuffle_partitions

_FOREVER = np.iinfo(np.int64).max
_CAUSES = np.array(["", "missing", "deleted", "late"], dtype=object)
_PROBED = "src string, row_id string, key string, at timestamp_ntz, cause string"


def reference_key(kind: str, corpus: Column, ref: Column) -> Column:
    """One string per (kind, corpus, id): unambiguous through the corpus' length, -1 for a null corpus."""
    return F.concat(
        F.lit(f"{kind}:"), F.coalesce(F.length(corpus), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(corpus, F.lit("")), ref
    )


def split_key(key: Column) -> tuple[Column, Column]:
    """(corpus, id) of a :func:`reference_key`."""
    n = F.split_part(key, F.lit(":"), F.lit(2)).cast("int")
    body = F.regexp_replace(key, r"^[^:]*:-?\d+:", "")
    return (
        F.when(n >= 0, F.substring(body, F.lit(1), n)),
        F.substring(body, F.greatest(n, F.lit(0)) + 1, F.length(body)),
    )


def is_reference(ref: Column) -> Column:
    """Null and blank values refer to nothing."""
    return ref.isNotNull() & ref.rlike(r"(?U)\S")


class SortedParents:
    """The versions of one range: unique keys, and per key starts with the latest end so far."""

    def __init__(self, keys: np.ndarray, start: np.ndarray, end: np.ndarray):
        order = np.argsort(keys, kind="stable")
        keys, start, end = keys[order], start[order], end[order]
        new = np.ones(len(keys), bool)
        if len(keys):
            new[1:] = keys[1:] != keys[:-1]
        self.keys = keys[new]
        code = np.cumsum(new) - 1
        self.starts, start_rank = np.unique(start, return_inverse=True)
        self.ends, end_rank = np.unique(end, return_inverse=True)
        # (key, start) and the running maximum of (key, end) each fit one integer
        self.width = len(self.starts) + 1
        by_start = np.argsort(code * self.width + start_rank, kind="stable")
        self.points = (code * self.width + start_rank)[by_start]
        tall = len(self.ends) + 1
        self.latest = np.maximum.accumulate((code * tall + end_rank)[by_start]) % tall if len(code) else code
        self.first = np.searchsorted(self.points, np.arange(len(self.keys)) * self.width)

    def probe(self, keys: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """0 fine, 1 missing, 2 deleted, 3 late for each reference."""
        if not len(self.keys):
            return np.ones(len(keys), np.int8)
        run = np.ones(len(keys), bool)
        run[1:] = keys[1:] != keys[:-1]
        found = np.searchsorted(self.keys, keys[run])
        found = np.minimum(found, len(self.keys) - 1)
        hit = self.keys[found] == keys[run]
        each = np.cumsum(run) - 1
        code, hit = found[each], hit[each]
        rank = np.searchsorted(self.starts, at, side="right")
        last = np.searchsorted(self.points, code * self.width + rank) - 1
        begun = last >= self.first[code]
        alive = begun & (self.ends[self.latest[np.maximum(last, 0)]] > at)
        cause = np.where(~begun, 3, np.where(alive, 0, 2)).astype(np.int8)
        cause[~known] = 0
        cause[~hit] = 1
        return cause


def _micros(column: pa.Array, null: int) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, start, end, parents = [], [], [], None
    for batch in batches:
        tag = batch.column("tag").to_numpy(zero_copy_only=False)
        n = int(np.searchsorted(tag, 1))
        if n:
            part = batch.slice(0, n)
            keys.append(part.column("key").to_numpy(zero_copy_only=False))
            start.append(_micros(part.column("at"), _FOREVER))
            end.append(_micros(part.column("until"), _FOREVER))
        if n == batch.num_rows:
            continue
        if parents is None:
            none = np.empty(0, np.int64)
            parents = SortedParents(
                np.concatenate(keys) if keys else np.empty(0, object),
                np.concatenate(start) if start else none,
                np.concatenate(end) if end else none,
            )
            keys, start, end = [], [], []
        refs = batch.slice(n)
        cause = parents.probe(
            refs.column("key").to_numpy(zero_copy_only=False),
            _micros(refs.column("at"), _FOREVER),
            refs.column("at").is_valid().to_numpy(zero_copy_only=False),
        )
        miss = np.flatnonzero(cause)
        if len(miss):
            out = refs.take(pa.array(miss))
            yield pa.RecordBatch.from_arrays(
                [out.column("src"), out.column("row_id"), out.column("key"), out.column("at"), pa.array(_CAUSES[cause[miss]], pa.string())],
                names=["src", "row_id", "key", "at", "cause"],
            )


def frequent_keys(refs: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges`` keys that each hold more references than an average range; from one mergeable sketch.

    The sketch only steers placement: a key it misses stays in one range.
    """
    row = refs.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(key, {ranges}, {max(1000, 4 * ranges)})").alias("top")).first()
    if not row or not row["n"]:
        return []
    return [x["item"] for x in row["top"] if x["item"] is not None and x["count"] * ranges > row["n"]]


def find_orphans(refs: DataFrame, parents: DataFrame, ranges: int | None = None, hot: list[str] | None = None) -> DataFrame:
    """References without a living parent: ``src, row_id, corpus_id, ref_id, at, cause``.

    ``refs``: ``src, row_id, key, at``; ``parents``: ``key, at, until`` (versions; a
    null ``until`` is open). ``key`` comes from :func:`reference_key`. ``cause`` is
    ``missing`` (no version at any time), ``late`` (all versions begin after ``at``)
    or ``deleted`` (some version began, none is alive at ``at``).

    A reference whose own time is null is only checked for ``missing``; a version
    without a start counts as begun at no time. Repeated rows are each reported.
    Empty parents make every reference missing; empty references give no row.
    Null keys must be removed before (:func:`is_reference`). A key that holds more
    references than an average range is split over ranges by its row id, and its
    few versions are copied to those ranges. Ids compare by code point.
    """
    spark = refs.sparkSession
    ranges = ranges or shuffle_partitions(spark)
    hot = frequent_keys(refs, ranges) if hot is None else hot
    spread = F.col("key").isin(hot) if hot else F.lit(False)
    null = F.lit(None)
    tagged_parents = parents.select(
        F.lit(0).cast("tinyint").alias("tag"),
        "key",
        F.explode(F.when(spread, F.sequence(F.lit(0), F.lit(ranges - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
        if hot
        else F.lit(0).alias("salt"),
        "at",
        "until",
        null.cast("string").alias("src"),
        null.cast("string").alias("row_id"),
    )
    tagged_refs = refs.select(
        F.lit(1).cast("tinyint").alias("tag"),
        "key",
        F.when(spread, F.pmod(F.xxhash64("row_id", "src", "at"), F.lit(ranges)).cast("int")).otherwise(F.lit(0)).alias("salt"),
        "at",
        null.cast("timestamp_ntz").alias("until"),
        "src",
        "row_id",
    )
    placed = tagged_parents.unionByName(tagged_refs).repartitionByRange(ranges, "key", "salt")
    misses = map_arrow(placed.sortWithinPartitions("tag", "key"), _probe, _PROBED)
    corpus, ref = split_key(F.col("key"))
    return misses.select("src", "row_id", corpus.alias("corpus_id"), ref.alias("ref_id"), "at", "cause")
