"""Deeply nested JSON exports flattened into related tables in one pass.

A depth-first visitor reads each body once and emits tagged rows: the table, the
row's key, its parent's key and a small JSON payload. The tagged stream is written
partitioned by tag, or read back per tag under that table's schema.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import map_arrow, spread

EMITTED = "tag string, snapshot_id string, pk string, parent_pk string, payload string"

#: Payload schema of each table; ``rest`` is the JSON of all fields that have neither a column nor a table of their own.
SCHEMAS = {
    "snapshot": "corpus_id string, schema_version bigint, exported_at string, rest string",
    "passage": "passage_id string, ord bigint, corpus_id string, text string, normalized_text string, quality_score double, created_at string, updated_at string, document_id string, language string, title string, rest string",
    "section_path": "passage_id string, ord bigint, val string",
    "entity_mentions": "passage_id string, ord bigint, val string",
    "fact_ids": "passage_id string, ord bigint, val string",
    "fact": "fact_id string, ord bigint, state string, rest string",
    "fact_passage": "fact_id string, ord bigint, val string",
}

#: Array field of a passage item -> the key that stands for an element that is an object.
ARRAYS = {"section_path": "title", "entity_mentions": "name", "fact_ids": "factId"}
_WRAPPERS = ("result", "snapshot")
_FIELDS = {
    "corpus_id": "corpusId", "text": "text", "normalized_text": "normalizedText", "quality_score": "qualityScore",
    "created_at": "createdAt", "updated_at": "updatedAt",
}


_PASSAGE = frozenset({"passageId", "entityMentions", "factIds", *_FIELDS.values()})
_META = frozenset({"documentId", "language", "title", "sectionPath"})


def _rest(item: dict, taken: Iterable[str]) -> str | None:
    """Canonical JSON of the other fields, null if there are none."""
    other = {k: v for k, v in item.items() if k not in taken}
    return _text(json.dumps(other, ensure_ascii=False, sort_keys=True, separators=(",", ":"))) if other else None


def _reject(token: str) -> None:
    raise ValueError(token)


def _load(body: str):
    return json.loads(body, parse_constant=_reject)


def _text(value) -> str | None:
    """Decoded text of a scalar; numbers and booleans as JSON writes them; a lone surrogate becomes U+FFFD."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return None if value is None else json.dumps(value)


def open_snapshot(body: str | None) -> dict | None:
    """The snapshot object of a body, through JSON strings and wrappers; None for no complete JSON or no object."""
    if body is None:
        return None
    try:
        value = _load(body.removeprefix("﻿"))
        while True:
            if isinstance(value, str):
                value = _load(value)
            elif isinstance(value, dict) and "passages" not in value and (inner := next((value[w] for w in _WRAPPERS if isinstance(value.get(w), (dict, str))), None)) is not None:
                value = inner
            else:
                return value if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        return None


def elements(value, name: str) -> Iterator[tuple[int, str]]:
    """(position, text) of an array's elements; a bare value is its only element."""
    if value is None:
        return
    for i, x in enumerate(value if isinstance(value, list) else [value]):
        if isinstance(x, dict):
            x = next((x[k] for k in (name, *ARRAYS.values()) if x.get(k) is not None), None)
        if x is not None and not isinstance(x, (list, dict)):
            yield i, _text(x)


def _items(value) -> Iterator[tuple[int, str | None, dict]]:
    if isinstance(value, dict):
        value = ((k, x) for k, x in value.items())
    elif isinstance(value, list):
        value = ((None, x) for x in value)
    else:
        return
    for i, (key, x) in enumerate(value):
        if isinstance(x, dict):
            yield i, key, x


def visit(snapshot_id: str | None, body: str | None, tags: frozenset[str]) -> Iterator[tuple[str, str | None, str, str | None, dict]]:
    """Tagged rows of one body, parents before children."""
    snap = open_snapshot(body)
    if snap is None:
        return
    # two bodies under one id have keys of their own, a repeated delivery has the same
    root = f"{snapshot_id}/{hashlib.blake2b(body.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"
    if "snapshot" in tags:
        version = snap.get("schemaVersion")
        yield "snapshot", snapshot_id, root, None, {
            "corpus_id": _text(snap.get("corpusId")),
            "schema_version": version if isinstance(version, int) else None,
            "exported_at": _text(snap.get("exportedAt")),
            "rest": _rest(snap, ("schemaVersion", "corpusId", "exportedAt", "passages", "facts")),
        }
    for i, key, item in _items(snap.get("passages")):
        pid = item.get("passageId")
        pid = _text(key if pid is None or isinstance(pid, (dict, list)) else pid)
        pk = f"{root}/p{i}"
        meta = item.get("metadata")
        meta = meta if isinstance(meta, dict) else {}
        if "passage" in tags:
            scalars = {c: item.get(f) for c, f in _FIELDS.items()} | {c: meta.get(f) for c, f in (("document_id", "documentId"), ("language", "language"), ("title", "title"))}
            payload = {c: v if c == "quality_score" and isinstance(v, (int, float)) else _text(v) for c, v in scalars.items() if not isinstance(v, (dict, list))}
            payload["rest"] = _rest({f: x for f, x in item.items() if f != "metadata" or not meta} | ({"metadata": {f: x for f, x in meta.items() if f not in _META}} if meta.keys() - _META else {}), _PASSAGE)
            yield "passage", snapshot_id, pk, root, {"passage_id": pid, "ord": i} | payload
        for tag, value in (("section_path", meta.get("sectionPath")), ("entity_mentions", item.get("entityMentions")), ("fact_ids", item.get("factIds"))):
            if tag in tags:
                for j, x in elements(value, ARRAYS[tag]):
                    yield tag, snapshot_id, f"{pk}/{tag}/{j}", pk, {"passage_id": pid, "ord": j, "val": x}
    if "fact" in tags or "fact_passage" in tags:
        for i, key, item in _items(snap.get("facts")):
            fid = item.get("factId")
            fid = _text(key if fid is None or isinstance(fid, (dict, list)) else fid)
            pk = f"{root}/f{i}"
            if "fact" in tags:
                state = item.get("state")
                yield "fact", snapshot_id, pk, root, {"fact_id": fid, "ord": i, "state": None if isinstance(state, (dict, list)) else _text(state), "rest": _rest(item, ("factId", "state", "passageIds"))}
            if "fact_passage" in tags:
                for j, x in elements(item.get("passageIds"), "passageId"):
                    yield "fact_passage", snapshot_id, f"{pk}/fact_passage/{j}", pk, {"fact_id": fid, "ord": j, "val": x}


def emit(snapshots: DataFrame, tags: Iterable[str] = tuple(SCHEMAS), id_column: str = "snapshot_id", body_column: str = "body") -> DataFrame:
    """Tagged rows of all bodies, in one pass; only an input of fewer partitions than cores is spread first: ``tag, snapshot_id, pk, parent_pk, payload``.

    Null, empty and broken bodies (also NaN literals and nesting too deep for the
    parser) give no row. Null elements give no row but keep their position; empty
    strings count; a bare value is an array of one; an object stands for its
    ``title``, ``name`` or ``factId``, and for nothing without them, like an array
    inside an array. Of equal JSON keys the last one holds. Repeated input rows
    repeat their rows with the same keys; :func:`tables` removes them. Further
    input columns are not read.
    """
    wanted = frozenset(tags)
    if unknown := wanted - SCHEMAS.keys():
        raise ValueError(f"unknown tables: {sorted(unknown)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tag", "snapshot_id", "pk", "parent_pk", "payload"]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for sid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in visit(sid, body, wanted):
                    for column, x in zip(rows, (*row[:4], json.dumps(row[4], ensure_ascii=False))):
                        column.append(x)
                if len(rows[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in rows], names=names)
                    rows = [[] for _ in names]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in rows], names=names)

    bodies = snapshots.select(F.col(f"`{id_column}`").alias("_i"), F.col(f"`{body_column}`").alias("_b"))
    return map_arrow(spread(bodies), run, EMITTED)


def tables(emitted: DataFrame, tags: Sequence[str]) -> dict[str, DataFrame]:
    """Each tag's distinct rows under its own schema, with ``snapshot_id``, ``pk`` and ``parent_pk``."""
    return {
        tag: emitted.filter(F.col("tag") == tag)
        .select("snapshot_id", "pk", "parent_pk", F.from_json("payload", SCHEMAS[tag]).alias("x"))
        .select("snapshot_id", "pk", "parent_pk", "x.*")
        .distinct()
        for tag in tags
    }


def write_tables(emitted: DataFrame, path: str) -> dict[str, DataFrame]:
    """Write the stream once, partitioned by tag, and open every table from it; a tag without rows is an empty table."""
    emitted.write.mode("overwrite").partitionBy("tag").parquet(path)
    spark: SparkSession = emitted.sparkSession
    return tables(spark.read.schema(EMITTED).parquet(path), tuple(SCHEMAS))
