"""Versioned Parquet store: immutable parts, one manifest per generation, compare-and-swap publish.

A generation lists the parts of every table. A writer stages new parts, then creates
``MANIFEST-<n>.json``, which fails if another writer was first. A reader opens the
highest complete manifest and sees only its parts, so a writer that dies before
leaves nothing but an unreferenced folder. Keyed changes are appended as delta
parts and merged when read, until they are folded into the table.

The folder may lie in any file system that Spark can write to: a local path is
linked into place, others go through the Hadoop file system, whose exclusive
create is atomic.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import GraphError

#: Compact a table that has more parts than this.
MAX_PARTS = 256
_NAME = re.compile(r"MANIFEST-(\d+)\.json")


#: Marks the delta parts of a table, and its key, among the names of a manifest.
_DELTA, _KEY, _SEQ = "@delta", "@key", "_seq"


@dataclass(frozen=True)
class Generation:
    number: int
    tables: dict[str, list[str]]


class LocalFiles:
    """A folder that driver and executors share as a local path."""

    def __init__(self, root: str):
        self.root = root
        os.makedirs(os.path.join(root, "parts"), exist_ok=True)

    def names(self, folder: str = "") -> dict[str, float]:
        """Name -> time of the last change."""
        with os.scandir(os.path.join(self.root, folder)) as found:
            return {e.name: e.stat().st_mtime for e in found}

    def text(self, name: str) -> str:
        with open(os.path.join(self.root, name), encoding="utf-8") as f:
            return f.read()

    def create(self, name: str, text: str) -> None:
        """A new file, whole or not at all; ``FileExistsError`` if the name is taken."""
        draft = os.path.join(self.root, f"draft-{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, os.path.join(self.root, name))
        finally:
            os.unlink(draft)

    def remove(self, name: str) -> None:
        shutil.rmtree(os.path.join(self.root, name))


class HadoopFiles:
    """A folder in a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.root, self.path = root, lambda name="": jvm.org.apache.hadoop.fs.Path(f"{root}/{name}" if name else root)
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path("parts"))

    def names(self, folder: str = "") -> dict[str, float]:
        return {x.getPath().getName(): x.getModificationTime() / 1000 for x in self.fs.listStatus(self.path(folder))}

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        try:
            stream = self.fs.create(self.path(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise FileExistsError(name) from None
            raise
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class GenerationStore:
    """Tables under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.files = HadoopFiles(spark, root) if "://" in root else LocalFiles(root)

    def _manifests(self) -> list[tuple[int, dict[str, list[str]]]]:
        """Complete manifests, the newest first; one that is being written does not parse yet."""
        out = []
        for n in sorted((int(m[1]) for name in self.files.names() if (m := _NAME.fullmatch(name))), reverse=True):
            try:
                out.append((n, json.loads(self.files.text(f"MANIFEST-{n}.json"))))
            except ValueError:
                continue
        return out

    def current(self) -> Generation:
        return Generation(*next(iter(self._manifests()), (0, {})))

    def _open(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in parts])

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        """A table as of a generation, its delta parts merged; a pinned generation that is no longer the current one is refused."""
        now = self.current()
        if generation is not None and generation != now.number:
            raise GraphError("GENERATION_CHANGED", f"generation {generation} was superseded by {now.number}")
        base, delta = now.tables.get(table), now.tables.get(table + _DELTA)
        if base is None and not delta:
            raise GraphError("NOT_FOUND", f"no table {table}")
        if not delta:
            return self._open(base)
        changes, key = self._open(delta), now.tables[table + _KEY]
        names = [c for c in changes.columns if c != _SEQ]
        last = changes.groupBy(*key).agg(F.max_by(F.struct(*names), _SEQ).alias("_x")).select("_x.*")
        if not base:
            return last
        old = self._open(base).select(*names)
        keys = last.select(*[F.col(k).alias(f"_{k}") for k in key])
        return old.join(keys, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]), "left_anti").unionByName(last)

    def stage(self, df: DataFrame, table: str) -> str:
        """Write rows as an unpublished part."""
        part = f"parts/{table.replace(_DELTA, '-delta')}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{part}")
        return part

    def publish(self, base: Generation, replaced: dict[str, list[str]] | None = None, appended: dict[str, list[str]] | None = None) -> Generation:
        """Make ``base`` with whole tables replaced and parts appended the next generation, if ``base`` is still current."""
        tables = {t: list(p) for t, p in base.tables.items()}
        tables.update(replaced or {})
        for t, parts in (appended or {}).items():
            tables[t] = [*tables.get(t, []), *parts]
        following = Generation(base.number + 1, tables)
        try:
            if self.current().number != base.number:
                raise FileExistsError
            self.files.create(f"MANIFEST-{following.number}.json", json.dumps(tables, sort_keys=True))
        except FileExistsError:
            raise GraphError("RETRYABLE_CONFLICT", f"generation {base.number} is no longer current") from None
        return following

    def prepare(self, base: Generation, parts: dict[str, list[str]]) -> str:
        """Evidence of staged parts (table -> parts): digest of the base, the parts and their rows, counted from file footers."""
        rows = {p: self._open([p]).count() for each in parts.values() for p in each}
        return hashlib.sha256(json.dumps([base.number, parts, rows], sort_keys=True).encode()).hexdigest()

    def commit(self, base: Generation, parts: dict[str, list[str]], evidence: str) -> Generation:
        """Append prepared parts; if they or the base are not what was prepared, ``EVIDENCE_MISMATCH``."""
        if self.prepare(base, parts) != evidence:
            raise GraphError("EVIDENCE_MISMATCH", "the staged parts are not those that were prepared")
        return self.publish(base, appended=parts)

    def replace(self, table: str, df: DataFrame) -> Generation:
        base = self.current()
        return self.publish(base, replaced={table: [self.stage(df, table)], table + _DELTA: []})

    def append(self, table: str, df: DataFrame) -> Generation:
        base = self.current()
        following = self.publish(base, appended={table: [self.stage(df, table)]})
        return self.compact(table) if len(following.tables[table]) > MAX_PARTS else following

    def change(self, table: str, delta: DataFrame, key: Sequence[str], order: str, sequence: int) -> Generation:
        """Append keyed changes, the last row per key by ``order``: work in proportion to the changes, not to the table.

        Of two changes of one key the one of the higher ``sequence`` holds, so a
        change that is delivered again does no harm.
        """
        base = self.current()
        names = [c for c in delta.columns if c != order]
        rows = delta.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("_x")).select("_x.*", F.lit(sequence).cast("bigint").alias(_SEQ))
        part = self.stage(rows, table + _DELTA)
        following = self.publish(base, replaced={table + _KEY: list(key)}, appended={table + _DELTA: [part]})
        return self.compact(table) if len(following.tables[table + _DELTA]) > MAX_PARTS else following

    def compact(self, table: str) -> Generation:
        """One part with the rows of all, changes merged."""
        return self.replace(table, self.read(table, self.current().number))

    def lineage(self, table: str) -> list[tuple[int, list[str]]]:
        """Parts of a table in every published generation."""
        return [(n, tables.get(table, [])) for n, tables in sorted(self._manifests(), key=lambda x: x[0])]

    def discard_unreferenced(self, older_than: float = 24 * 3600.0) -> list[str]:
        """Remove parts that no generation lists and that were not written to for so many seconds:
        what writers left that died before publishing. A writer has that long to publish."""
        used = {p for _, tables in self._manifests() for parts in tables.values() for p in parts}
        now = time.time()
        gone = [p for name, at in self.files.names("parts").items() if (p := f"parts/{name}") not in used and at <= now - older_than]
        for p in gone:
            self.files.remove(p)
        return sorted(gone)

    def forget(self, keep: int) -> list[str]:
        """Remove parts that only generations before the last ``keep`` list; their readers are refused anyway."""
        manifests = self._manifests()
        used = {p for _, tables in manifests[:keep] for parts in tables.values() for p in parts}
        here = {f"parts/{name}" for name in self.files.names("parts")}
        gone = {p for _, tables in manifests[keep:] for parts in tables.values() for p in parts if p in here} - used
        for p in gone:
            self.files.remove(p)
        return sorted(gone)


def read_snapshot_files(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files (one JSON document each) as ``snapshot_id, body``, ready for :func:`graphloom.operators.nested.emit`."""
    files = spark.read.text(path, wholetext=True)
    return files.selectExpr("_metadata.file_name AS snapshot_id", "value AS body")


def append_audit(df: DataFrame, path: str) -> None:
    """Append audit events as JSON lines."""
    df.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All audit events; lines that are no JSON are null rows and left out."""
    return spark.read.schema(schema).json(path).dropna("all")


def capabilities() -> dict[str, object]:
    """What the engine answers to a client that asks for its protocol."""
    return {
        "protocol": 1,
        "operations": ["nodes", "edges", "vectors", "lexical", "memory", "retrieval", "cypher", "generations"],
        "limits": {"ids": 4096, "entities": 64, "facts": 100, "seeds": 512, "iterations": 128, "slots": 8, "dimensions": 4096, "top_k": 10_000},
        "transactions": "one writer a generation, compare and swap",
    }


def ping() -> str:
    return "pong"
