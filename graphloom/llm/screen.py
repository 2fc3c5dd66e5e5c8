"""Which words any encode-decode chain could make likelier, for a whole array of words at once.

The same chains, stretches and scores as :meth:`graphloom.llm.encoding.Repairer.word`,
worked out over one concatenated array: a word that no chain gains on is in order in
every text that holds it, so each distinct word of a corpus is screened once. The
words that might gain are kept as a bit field of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

from graphloom.llm import encoding as E
from graphloom.llm.bitfield import Field

#: Characters that are screened together.
CHUNK = 200_000
#: Gains below this are none: differences of long sums have that much noise.
_ZERO = 1e-8


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Screen:
    """Screens words under one model."""

    def __init__(self, model: E.CharModel):
        self.model = model
        self.read = {c: E.CharBytes(c) for c in E.READ_AS}
        self.one = {t: self._table(t) for t in E.WRITTEN_IN if t not in E._SEQUENCE}

    @staticmethod
    def _table(codec: str) -> np.ndarray:
        """Byte -> code point, -1 where the codec has none."""
        return np.array([-1 if (c := E.decode(bytes([b]), codec)) is None else ord(c) for b in range(256)], np.int64)

    def gains(self, codes: np.ndarray, upto: np.ndarray, start: np.ndarray, end: np.ndarray, new: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Gain of each stretch [start, end) read as the next ``size`` characters of ``new``, with two characters on both sides."""
        off = np.cumsum(size + 4) - size - 4
        tails = np.empty(int(size.sum()) + 4 * len(size), np.uint64)
        tails[off], tails[off + 1] = codes[start - 2], codes[start - 1]
        tails[off + 2 + size], tails[off + 3 + size] = codes[end], codes[end + 1]
        tails[np.repeat(off + 2 - (np.cumsum(size) - size), size) + np.arange(len(new))] = new
        log = self.model.log_probs(tails)
        log[off], log[off + 1] = 0.0, 0.0
        gain = np.add.reduceat(log, off) - (upto[end + 2] - upto[start])
        return np.where(np.abs(gain) < _ZERO, 0.0, gain)

    def _chunks(self, words: list[str]) -> Iterator[list[str]]:
        first = 0
        while first < len(words):
            last, size = first, 0
            while last < len(words) and (not size or size + len(words[last]) < CHUNK):
                size += len(words[last]) + 4
                last += 1
            yield words[first:last]
            first = last

    def suspicious(self, words: list[str]) -> np.ndarray:
        """For each word whether some chain makes it likelier."""
        found = [np.empty(0, bool)]
        for chunk in self._chunks(words):
            hit = np.array(["�" in w for w in chunk], bool)
            for _, whole, of, start, g, _ in self._chains(chunk):
                if whole:
                    total = np.bincount(of[start], np.maximum(g, -E.LOSS), len(chunk))
                    hit[of[start][total[of[start]] > 0]] = True
                else:
                    hit[of[start[g > 0]]] = True
            found.append(hit)
        return np.concatenate(found)

    def scores(self, words: list[str]) -> dict[str, list[tuple[tuple[str, str], float, None]]]:
        """:meth:`Repairer.word` of every word, without the texts, and but for replacement characters."""
        out: dict[str, list] = {}
        for chunk in self._chunks(words):
            each: list[list] = [[] for _ in chunk]
            begin = np.cumsum([0, *(len(w) + 4 for w in chunk)]).tolist()
            least = None
            for chain, whole, of, start, g, log in self._chains(chunk):
                if least is None:
                    rare = np.minimum.reduceat(np.where(self._inside(begin), log, 0.0), begin[:-1])
                    west = np.array([bool(E._WESTERN.search(w)) for w in chunk])
                    least = np.where(rare > np.where(west, E.UNUSUAL, E.UNUSUAL_CJK), -E.IN_ORDER, -np.inf).tolist()
                keep = np.arange(len(start)) if whole else np.flatnonzero(g > 0)
                word = of[start[keep]]
                total = np.bincount(word, np.maximum(g[keep], -E.LOSS), len(chunk))
                for w in np.unique(word).tolist():
                    each[w].append((chain, max(float(total[w]), least[w]), None))
            out.update(zip(chunk, each))
        return out

    @staticmethod
    def _inside(begin: list[int]) -> np.ndarray:
        """Positions that end a trigram of a padded word."""
        mask = np.ones(begin[-1], bool)
        at = np.array(begin[:-1])
        mask[at] = mask[at + 1] = False
        return mask

    def _chains(self, words: list[str]) -> Iterator[tuple]:
        """(chain, whether it reads single bytes, word of each position, starts and gains of stretches, log probabilities)
        of each chain that has any stretch."""
        text = "".join(f"  {w}  " for w in words)
        codes = _points(text).astype(np.uint64)
        of = np.repeat(np.arange(len(words)), [len(w) + 4 for w in words])
        log = self.model.log_probs(codes)
        upto = np.concatenate([[0.0], np.cumsum(log)])
        chars, at_char = np.unique(codes, return_inverse=True)
        chars = [chr(c) for c in chars.tolist()]
        high = (codes > 0x7F) & (codes != 0xA0)
        for name, read in self.read.items():
            each = [read[c] for c in chars]
            known = np.array([b is not None for b in each], bool)[at_char]
            if not (known & (codes > 0x7F)).any():
                continue
            wide = np.array([list((b or b"\n").ljust(4, b"\0")) for b in each], np.uint8)
            sizes = np.array([len(b) if b else 1 for b in each], np.int64)[at_char]
            data = wide[at_char][np.arange(4) < sizes[:, None]]
            begin = np.cumsum(sizes) - sizes
            for written, start, end, new, size in self._one_byte(name, codes, high & known, begin, sizes, data):
                g = self.gains(codes, upto, start, end, new, size)
                yield (name, written), True, of, start, g, log
            for written, start, end, news in self._several_bytes(name, text, codes, begin, data.tobytes()):
                g = self.gains(codes, upto, start, end, _points("".join(news)), np.array([len(x) for x in news]))
                yield (name, written), False, of, start, g, log

    def _one_byte(self, name: str, codes: np.ndarray, mask: np.ndarray, begin: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        start, end = edges[::2], edges[1::2]
        if not len(start):
            return
        first = begin[start]
        n = begin[end - 1] + sizes[end - 1] - first
        run = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        raw = data[first[run] + within]
        alike = n == end - start  # as many characters as before: perhaps the same ones
        old = codes[np.minimum(start[run] + within, len(codes) - 1)].astype(np.int64)
        for written, table in self.one.items():
            if written == name:
                continue
            new = table[raw]
            same = alike & (np.bincount(run, new != old, len(n)) == 0)
            use = ~same & (np.bincount(run, new < 0, len(n)) == 0)
            if use.any():
                yield written, start[use], end[use], new[use[run]].astype(np.uint64), n[use]

    def _several_bytes(self, name: str, text: str, codes: np.ndarray, begin: np.ndarray, data: bytes) -> Iterator[tuple]:
        char_at = np.full(len(data) + 1, -1, np.int64)
        char_at[begin] = np.arange(len(begin))
        char_at[len(data)] = len(begin)
        high = np.concatenate([[0], np.cumsum(codes > 0x7F)])
        for written, pattern in E._RUN.items():
            if written == name:
                continue
            spans = np.array([m.span() for m in pattern.finditer(data)], np.int64).reshape(-1, 2)
            for k in np.flatnonzero((char_at[spans] < 0).any(axis=1)).tolist():
                spans[k] = self._aligned(char_at, data, *spans[k].tolist(), E._ONE[written])
            start, end = char_at[spans[:, 0]], char_at[spans[:, 1]]
            use = high[end] > high[start]
            spans, start, end = spans[use], start[use], end[use]
            news = _decoded([data[s:e] for s, e in spans.tolist()], written)
            use = np.array([x is not None and x != text[i:j] for x, i, j in zip(news, start.tolist(), end.tolist())], bool)
            if use.any():
                yield written, start[use], end[use], [x for x, u in zip(news, use.tolist()) if u]

    @staticmethod
    def _aligned(char_at: np.ndarray, data: bytes, s: int, e: int, one: re.Pattern) -> tuple[int, int]:
        """The run on whole characters at both sides; (0, 0) if none is left."""
        if char_at[e] < 0:  # the last character may end in an ASCII byte of the text
            f = e + 1
            while char_at[f] < 0:
                f += 1
            if data[e:f].isascii():
                e = f
        if char_at[s] >= 0 and char_at[e] >= 0:
            return s, e
        aligned = [c for c in (*(m.start() for m in one.finditer(data, s, e)), e) if char_at[c] >= 0]
        return (aligned[0], aligned[-1]) if len(aligned) > 1 else (0, 0)


def _decoded(pieces: list[bytes], codec: str) -> list[str | None]:
    """Each piece decoded, None where it does not decode; pieces hold no line break."""
    out = b"\n".join(pieces).decode(codec, "replace").split("\n")
    if len(out) != len(pieces):
        return [E.decode(p, codec) for p in pieces]
    return [E.decode(p, codec) if "\ufffd" in x else x for x, p in zip(out, pieces)]


def field_of(words: Iterable[list[str]], model: E.CharModel, judge: bool = False) -> Field:
    """The field of the words that some chain makes likelier, of an iteration of word lists.

    A model that is only to ``judge`` which records that look clean are not needs no
    words with signs of a wrong encoding, and none with CJK characters.
    """
    screen, field, clean = Screen(model), Field(), E.CleanTexts()
    for some in words:
        some = [w for w in some if not judge or max(w) < "⺀" and clean.word(w)]
        for word, hit in zip(some, screen.suspicious(some) if some else ()):
            if hit:
                field.add(word)
    return field
