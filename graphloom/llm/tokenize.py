"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern. In BPE the encoding of a
prefix extends the encoding of a shorter prefix by one token, so the *last token*
of every prefix describes the whole encoding. The distinct words of a batch, in
byte order, are the depth-first order of their trie: walking them with a stack of
last tokens per depth computes each shared prefix once.

Runs inside the scan (``mapInArrow``): no shuffle, no state on the driver but the
vocabulary's path.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import map_arrow, spread

DEFAULT_VOCABULARY = os.environ.get("GRAPHLOOM_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Word pattern that the vocabulary was built with (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept between batches; beyond it the memo starts anew, results do not change.
MEMO_WORDS = 200_000
MEMO_BYTES = 64


class TrieEncoder:
    """Byte-pair encoding of words through last tokens of prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = {t: len(b) for b, t in ranks.items()}
        self.bytes_of = {t: b for b, t in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.ok: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}
        lengths: dict[bytes, set[int]] = {}
        for b in ranks:
            if len(b) > 1:
                lengths.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}

    @classmethod
    def load(cls, path: str) -> TrieEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one, or (token, token) for a single byte."""
        if token in self.parts:
            return self.parts[token]
        whole = self.bytes_of[token]
        pieces = [whole[i : i + 1] for i in range(len(whole))]
        while len(pieces) > 2:
            best, at = None, -1
            for i in range(len(pieces) - 1):
                r = self.ranks.get(pieces[i] + pieces[i + 1])
                if r is not None and r < token and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        out = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else (token, token)
        self.parts[token] = out
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` followed by ``right`` is what BPE gives for their bytes: no merge crosses their border first."""
        key = (left, right)
        known = self.ok.get(key)
        if known is not None:
            return known
        limit, ranks, by = 1 << 62, self.ranks, self.bytes_of
        a, b = left, right
        while True:
            crossing = ranks.get(by[a] + by[b])
            if crossing is not None and crossing < limit:
                result = False
                break
            # undo whichever of the two was merged last: the border was open before that
            if a > b:
                limit, (x, y) = a, self.split(a)
                if x == a:
                    limit, (x, y) = b, self.split(b)
                    if x == b:
                        result = True
                        break
                    b = x
                    limit += 1
                else:
                    a = y
            else:
                limit, (x, y) = b, self.split(b)
                if x == b:
                    limit, (x, y) = a, self.split(a)
                    if x == a:
                        result = True
                        break
                    a = y
                else:
                    b = x
                    limit += 1
        self.ok[key] = result
        return result

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Token ids of each distinct word, by one depth-first walk of their trie."""
        out: dict[bytes, list[int]] = {}
        ranks, size, compatible, lengths = self.ranks, self.size, self.compatible, self.lengths
        last: list[int] = [-1]  # last[d]: last token of the prefix of length d on the current path
        previous = b""
        for word in sorted(set(words)):
            if not word:
                out[word] = []
                continue
            shared = 0
            for x, y in zip(word, previous):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                token = -1
                for n in lengths.get(word[d - 2 : d], ()) if d > 1 else ():
                    if n <= d:
                        t = ranks.get(word[d - n : d])
                        if t is not None and (n == d or compatible(last[d - n], t)):
                            token = t
                            break
                last.append(ranks[word[d - 1 : d]] if token < 0 else token)
            ids, d = [], len(word)
            while d:
                ids.append(last[d])
                d -= size[last[d]]
            out[word] = ids[::-1]
            previous = word
        return out

    def encode_batch(self, texts: list[str | None], pattern: regex.Pattern) -> list[list[int]]:
        cut = [pattern.findall(t) if t else [] for t in texts]
        memo = self.memo
        fresh = {w for words in cut for w in words if w not in memo}
        coded = {w: w.encode("utf-8") for w in fresh}
        found = self.encode_words(coded.values())
        local = {w: found[b] for w, b in coded.items()}
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids.extend(memo.get(w) or local.get(w) or ())
            out.append(ids)
        if len(memo) > MEMO_WORDS or len(self.ok) > 4 * MEMO_WORDS:
            memo.clear()
            self.ok.clear()
        memo.update((w, ids) for w, ids in local.items() if len(coded[w]) <= MEMO_BYTES)
        return out


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids`` of every row, without special tokens.

    Null and empty texts have the empty list; blank texts have the ids of their
    spaces; strings of special tokens are ordinary text. Texts of any length are
    encoded whole. Repeated rows repeat; null ids stay null; further columns are
    not read; an empty table gives no rows. ``vocabulary`` must be readable on
    every executor.
    """
    id_type = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pattern = TrieEncoder.load(vocabulary), regex.compile(PATTERN)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = encoder.encode_batch(part.column(1).to_pylist(), pattern)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    return map_arrow(spread(documents.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))), run, f"`{id_column}` {id_type}, ids array<int>")
