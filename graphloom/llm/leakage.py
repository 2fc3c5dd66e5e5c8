"""Evaluation passages inside training texts, found through template windows.

Numbers, units and names become typed placeholders; what remains of a run of
``window`` words is its template. Windows of documents and of evaluation passages
meet in an equi-join on the template's hash. A second hash describes which slots
hold equal fillers (1st, 2nd, 1st ...), so equal patterns mean that one consistent
renaming of slots turns one window into the other: a re-parameterised copy. A
third covers the words themselves: equal fillers in every slot, a literal copy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bitfield import Field, field_of_words
from graphloom.session import checkpoint, map_arrow, spread

WINDOW = 12
#: Broadcast the evaluation windows up to this many; beyond it both sides shuffle by hash.
BROADCAST_WINDOWS = 500_000
#: The plain words of templates are words of at least this many evaluation items, kept in a bit field of
#: ``WORD_BITS`` bits (2 MB). A name that the field holds by accident is plain on both sides: literal copies stay equal.
COMMON_ITEMS, WORD_BITS = 3, 24
#: A template has at least this many plain words. A window of fewer says nothing but its fillers: it meets literal
#: copies only, so that runs of names have no template in common.
LEAST_PLAIN = 3

#: Units of measure and money (fixed values).
UNITS = frozenset(
    "coin coins taler talern real reales sou sous euro euros dollar dollars yen cent cents "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "sekunde sekunden minute minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren "
    "seconde secondes heure heures jour jours semaine semaines mois an ans "
    "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años "
    "m km cm mm g kg mg l ml".split()
)
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_NUMBER, _UNIT, _NAME = 1, 2, 3
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits, without case."""
    return _WORD.findall(text.casefold()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; spreads small integers over the whole range."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_word(w: str) -> int:
    h = 0xCBF29CE484222325
    for b in w.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


class Templates:
    """Word -> (class code, word code); equal words have equal codes in every process."""

    def __init__(self, common: Container[str]):
        self.common = common
        self.seen: dict[str, tuple[int, int]] = {}

    def code(self, w: str) -> tuple[int, int]:
        got = self.seen.get(w)
        if got is None:
            h = _hash_word(w)
            if unicodedata.category(w[0])[0] == "N" and all(unicodedata.category(c)[0] == "N" for c in w):
                kind = _NUMBER
            elif w in UNITS:
                kind = _UNIT
            elif w in self.common:
                kind = h | 4
            else:
                kind = _NAME
            if len(self.seen) > 500_000:
                self.seen.clear()
            got = self.seen[w] = (kind, h)
        return got

    def windows(self, texts: list[str | None], size: int) -> tuple[np.ndarray, ...]:
        """(row, position, template, slots, words, fillers) of every window of every text; hashes are int64, fillers a list of them."""
        coded = [[self.code(w) for w in words(t)] for t in texts]
        lengths = np.array([len(c) for c in coded], np.int64)
        flat = np.array([x for c in coded for x in c], np.uint64).reshape(-1, 2)
        row = np.repeat(np.arange(len(coded)), lengths)
        begin = np.cumsum(lengths) - lengths
        position = np.arange(len(flat)) - np.repeat(begin, lengths)
        starts = np.flatnonzero(position + size <= np.repeat(lengths, lengths))
        kinds, plain = mix(flat[:, 0]), mix(flat[:, 1])
        slot = flat[:, 0] <= _NAME
        # distance to the last equal filler, 0 beyond the window or for the first: the slots' equality pattern
        back = np.zeros(len(flat), np.uint64)
        if len(flat):
            order = np.lexsort((position, flat[:, 1], row))
            same = (row[order][1:] == row[order][:-1]) & (flat[order, 1][1:] == flat[order, 1][:-1])
            gap = position[order][1:] - position[order][:-1]
            back[order[1:]] = np.where(same, gap, 0).astype(np.uint64)
        template, slots, exact = (np.zeros(len(starts), np.uint64) for _ in range(3))
        plain_words = np.zeros(len(starts), np.int64)
        for i in range(size):
            at = starts + i
            template = template * _M1 + kinds[at]
            exact = exact * _M2 + plain[at]
            plain_words += ~slot[at]
            near = np.where(slot[at] & (back[at] <= i), back[at], 0).astype(np.uint64)
            slots = slots * _M3 + mix(near + np.uint64(1))
        bare = plain_words < LEAST_PLAIN
        template, slots = np.where(bare, exact ^ _M3, template), np.where(bare, np.uint64(0), slots)
        at = starts[:, None] + np.arange(size)
        filled = slot[at] if len(starts) else np.zeros((0, size), bool)
        fillers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled.sum(axis=1))]), pa.int32()), pa.array(plain[at][filled].view(np.int64) if len(starts) else np.empty(0, np.int64)))
        return row[starts], position[starts], *(mix(x).view(np.int64) for x in (template, slots, exact)), fillers


def common_words(items: DataFrame, column: str = "passage") -> Field:
    """Words in at least ``COMMON_ITEMS`` evaluation passages: the fixed part of templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [w for t in batch.column(0).to_pylist() for w in set(words(t))]
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.string())], names=["w"])

    counted = map_arrow(items.select(column), run, "w string").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return field_of_words(counted.filter(F.col("n") >= COMMON_ITEMS).select("w"), WORD_BITS)


def template_windows(df: DataFrame, id_column: str, text_column: str, common: Field, size: int = WINDOW, fillers: bool = False) -> DataFrame:
    """``id, pos, template, slots, words`` (and ``fillers``) of each window of each text; made in the scan, no shuffle."""
    id_type = df.schema[id_column].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(common.slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Templates(Field(shared.value, WORD_BITS))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                row, pos, *hashes, filled = coder.windows(part.column(1).to_pylist(), size)
                columns = [part.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32)), *map(pa.array, hashes)]
                yield pa.RecordBatch.from_arrays(columns + [filled] * fillers, names=["id", "pos", "template", "slots", "words"] + ["fillers"] * fillers)

    return map_arrow(
        spread(df.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))), run, f"id {id_type}, pos int, template bigint, slots bigint, words bigint" + ", fillers array<bigint>" * fillers
    )


def leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", window: int = WINDOW
) -> DataFrame:
    """(document, item) pairs sharing a template window under a consistent renaming of slots.

    Columns: ``doc_id, item_id, windows`` (matching windows of the document),
    ``literal`` (those that are literal copies; 0: only re-parameterised) and
    ``first_pos``. A literal window is ``window`` consecutive equal words: every
    such run is found, as equal words give equal templates, slots and words.

    Null and empty texts, and those of fewer than ``window`` words, give no row.
    Repeated rows count once per id. A window of many items (shared phrases)
    counts for each. Items may repeat; further columns are not read. A document
    is never collected as a group: windows are joined one by one.
    """
    common = common_words(items, passage)
    of_items = (
        template_windows(items, item_id, passage, common, window)
        .select(F.col("id").alias("item_id"), "template", "slots", F.col("words").alias("item_words"))
        .distinct()
    )
    of_items = checkpoint(of_items)  # windows are made once, for the count and the join
    small = of_items.count() <= BROADCAST_WINDOWS
    of_docs = template_windows(documents, doc_id, text, common, window).withColumnRenamed("id", "doc_id")
    hits = of_docs.join(F.broadcast(of_items) if small else of_items, ["template", "slots"])
    # one state per (document, item) and map task before anything is shuffled
    return hits.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum((F.col("words") == F.col("item_words")).cast("bigint")).alias("literal"),
        F.min("pos").alias("first_pos"),
    )


def reparameterised(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", window: int = WINDOW
) -> DataFrame:
    """Documents that hold an item's template under other fillers: ``doc_id, item_id, windows, first_pos``.

    Pairs without a literal window only. Along one alignment of document and item
    all matching windows together must rename slots one to one: the same filler of
    the item always stands for the same filler of the document, and the reverse.
    The longest alignment that does so is reported. Nulls, empty and repeated rows
    as in :func:`leaks`.
    """
    pairs = checkpoint(leaks(documents, items, doc_id, text, item_id, passage, window).filter("literal = 0").select("doc_id", "item_id"))
    common = common_words(items, passage)
    few = documents.join(pairs.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_semi")
    d = template_windows(few, doc_id, text, common, window, fillers=True).withColumnRenamed("id", "doc_id").drop("words").distinct()
    i = template_windows(items, item_id, passage, common, window, fillers=True).select(F.col("id").alias("item_id"), F.col("pos").alias("_at"), "template", "slots", F.col("fillers").alias("_item")).distinct()
    hits = d.join(i, ["template", "slots"]).join(pairs, ["doc_id", "item_id"]).withColumn("shift", F.col("pos") - F.col("_at"))
    along = ["doc_id", "item_id", "shift"]
    bound = hits.select(*along, F.explode(F.arrays_zip("fillers", "_item")).alias("x")).select(*along, F.col("x.fillers").alias("a"), F.col("x._item").alias("b")).distinct()
    broken = bound.groupBy(*along, "a").count().filter("count > 1").select(*along).unionByName(bound.groupBy(*along, "b").count().filter("count > 1").select(*along)).distinct()
    whole = hits.groupBy(*along).agg(F.countDistinct("pos").alias("windows"), F.min("pos").alias("first_pos")).join(broken, along, "left_anti")
    best = whole.groupBy("doc_id", "item_id").agg(F.max(F.struct("windows", -F.col("first_pos"))).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.windows").alias("windows"), (-F.col("x")["col2"]).alias("first_pos"))
