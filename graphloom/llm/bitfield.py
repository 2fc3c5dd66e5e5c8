"""Sets of words of any number in a bit field of fixed size, built where the words lie."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import map_arrow

#: 8 MB. A fuller field has more false members, which cost work and change no result.
BITS = 26
MEMO = 100_000


def positions(word: str, bits: int = BITS) -> tuple[int, int]:
    """The two bits of a word."""
    h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h & ((1 << bits) - 1), h >> (64 - bits)


class Field:
    """A set of words in a fixed number of bits; may hold words that were never added, never lacks one that was."""

    def __init__(self, slots: np.ndarray | None = None, bits: int = BITS):
        self.bits = bits
        self.slots = np.zeros(1 << (bits - 6), np.uint64) if slots is None else slots
        self.memo: dict[str, bool] = {}

    def add(self, word: str) -> None:
        for p in positions(word, self.bits):
            self.slots[p >> 6] |= np.uint64(1 << (p & 63))

    def __contains__(self, word: str) -> bool:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            got = self.memo[word] = all(int(self.slots[p >> 6]) >> (p & 63) & 1 for p in positions(word, self.bits))
        return got

    def rows(self) -> pa.RecordBatch:
        """The slots in use: slot, bits."""
        hit = np.flatnonzero(self.slots)
        return pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(self.slots[hit].view(np.int64))], names=["slot", "bits"])


ROWS = "slot int, bits bigint"


def collect(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    """The slots of all :meth:`Field.rows` together; at most ``2 ** (bits - 6)`` rows reach the driver."""
    found = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots = np.zeros(1 << (bits - 6), np.uint64)
    slots[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return slots


def field_of_words(words: DataFrame, bits: int = BITS) -> Field:
    """The field of a one-column frame of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(bits=bits)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                field.add(word)
        yield field.rows()

    return Field(collect(map_arrow(words, run, ROWS), bits), bits)
