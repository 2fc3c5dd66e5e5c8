"""Scalar functions of the engine as column expressions and vectorised kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(column: Column) -> Column:
    """Entity fold: Unicode lower case with the final-sigma rule (ICU mappings, the session default)."""
    return F.lower(column)


def utf16_key(column: Column) -> Column:
    """Sort key that orders strings by UTF-16 code units."""
    return F.encode(column, "UTF-16BE")


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a token as a substring."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("bigint")


def token_score(text: Column, query: str) -> Column:
    """Sum over the query's tokens of their occurrences in the lower-case text; repeated tokens count again."""
    lowered, score = F.lower(text), F.lit(0).cast("bigint")
    for token in query.lower().split():
        score = score + occurrences(lowered, token)
    return score


def document_ids(ref: Column) -> Column:
    """Documents of a JSON ``ref``: ``sourceDocumentIds`` (strings only) if it is an array, else ``metadata.documentId``, else none."""
    parsed = F.from_json(ref, "sourceDocumentIds array<string>, metadata struct<documentId:string>")
    raw = F.get_json_object(ref, "$.sourceDocumentIds")
    strings = F.filter(parsed["sourceDocumentIds"], lambda x: x.isNotNull())
    single = parsed["metadata"]["documentId"]
    return F.when(raw.startswith("["), strings).when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<string>"))


def merge_token(canonical_json: Column) -> Column:
    """Digest that a compare-and-swap merge of a stored schema must present."""
    return F.sha2(F.concat(F.lit("graphloom-schema-merge-token-v1:"), canonical_json), 256)


def sort_work(n: Column) -> Column:
    """Comparisons that a merge sort of ``n`` rows is charged: n * ceil(log2 n) - 2 ** ceil(log2 n) + 1, and none below two rows."""
    depth = F.ceil(F.log2(n.cast("double")))
    return F.when(n > 1, n * depth - F.pow(F.lit(2.0), depth).cast("bigint") + 1).otherwise(F.lit(0)).cast("bigint")


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query; 0 for zero norms and non-finite values, scaled where squares overflow."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        dot, norms = rows @ query, np.sqrt(np.einsum("ij,ij->i", rows, rows)) * np.sqrt(query @ query)
        out = dot / norms
        odd = ~np.isfinite(out) | ~np.isfinite(norms)
        if odd.any():
            r = rows[odd] / np.maximum(np.abs(rows[odd]).max(axis=1, keepdims=True), 1e-300)
            q = query / max(np.abs(query).max(), 1e-300)
            scaled = (r @ q) / (np.sqrt(np.einsum("ij,ij->i", r, r)) * np.sqrt(q @ q))
            out[odd] = np.where(np.isfinite(scaled), scaled, 0.0)
    return out
