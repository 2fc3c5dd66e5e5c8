"""Text decoded with the wrong character encoding: detection and repair.

A smoothed character trigram model is trained on the clean records of the whole
corpus. For each text every chain "encode with the codec that was used by mistake,
decode with the right one" is applied wherever the bytes allow it, and the model
scores the result against the text as stored, on the changed stretches and their
borders. The likeliest chain is accepted if its gain passes a margin that was
validated on clean records; repeated for text that went wrong more than once.

Three passes over the text. The first counts n-grams and gives the distinct words
with non-ASCII characters; each distinct word is scored once over the corpus, all
chains together (:mod:`graphloom.llm.screen`). The second takes suspects out of the
counts, the third scores in full the texts that hold a word some chain gains on.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpoint, map_arrow, shuffle_partitions, spread

#: Size of the hashed count tables of 1-, 2- and 3-grams: the model's proven bound.
BITS = (16, 19, 21)
_OFFSETS = (0, 1 << BITS[0], (1 << BITS[0]) + (1 << BITS[1]))
TABLE = _OFFSETS[2] + (1 << BITS[2])
#: Interpolation weights of trigram, bigram, unigram and uniform share.
WEIGHTS = (0.55, 0.3, 0.1499, 0.0001)
#: Least margin in nats.
LEAST_MARGIN = 1.8
#: Nats that choose a chain of UTF-8 bytes, which rarely form by chance, over one that could read any bytes; no part of the gain.
STRUCTURE = 12.0
#: A word in which every character follows the two before it with more than this log probability is in order; it is scored like any other.
UNUSUAL = -6.0
#: The same for words of CJK and ASCII characters only: their characters vary more, misread ones are hardly ever seen.
UNUSUAL_CJK = -9.0
#: Nats that a stretch speaks at most against a chain, and all stretches of a word in order together.
LOSS, IN_ORDER = 10.0, 4.0
#: Documents with more than this gain under the first model do not train the second.
SUSPECT = 1.5
#: Marks of good typography, which texts may have even if the clean records have none (fixed values), and their least share.
_TYPOGRAPHY, TYPOGRAPHY_SHARE = "’‘“”„–—…€£°«»•™®", 3e-5
#: Texts already repaired that a task remembers, by word.
MEMO = 100_000

#: Codecs read by mistake, and codecs the bytes were in. "ansi" is cp1252 with C1 controls for its undefined bytes.
READ_AS = ("ansi", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "gb18030", "cp932", "big5", "cp949")
WRITTEN_IN = ("utf_8", "cp932", "euc_jp", "gb18030", "big5", "cp949", "ansi", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r")
#: Byte sequences of one non-ASCII character in each multi-byte codec (fixed by the codecs).
_SEQUENCE = {
    "utf_8": rb"[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}",
    "cp932": rb"[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]|[\xA1-\xDF]",
    "euc_jp": rb"\x8F[\xA1-\xFE]{2}|\x8E[\xA1-\xDF]|[\xA1-\xFE]{2}",
    "gb18030": rb"[\x81-\xFE][\x30-\x39][\x81-\xFE][\x30-\x39]|[\x81-\xFE][\x40-\x7E\x80-\xFE]",
    "big5": rb"[\x81-\xFE][\x40-\x7E\xA1-\xFE]",
    "cp949": rb"[\x81-\xFE][\x41-\x5A\x61-\x7A\x81-\xFE]",
}
_RUN = {t: re.compile(rb"(?:(?:%s)[\x21-\x7E]{0,12}?)*(?:%s)" % (p, p), re.S) for t, p in _SEQUENCE.items() if t != "utf_8"}
_RUN["utf_8"] = re.compile(rb"(?:%s)+" % _SEQUENCE["utf_8"], re.S)
#: Borders of words: ASCII white space (no codec has it inside a character) and the full stops of CJK text.
_SPACE = re.compile(r"[ \t\r\n\f\v]+|(?<=[。！？])(?![。！？])")
_WORD = re.compile(r"[^ \t\r\n\f\v。！？]+[。！？]*|[。！？]+")
_WESTERN = re.compile("[\x80-\u2e7f\ue000-\U0010ffff]")
#: Non-ASCII stretches that a one-byte codec may have misread; a no-break space stands for itself.
_HIGH = re.compile("[^\x00-\x7f\xa0]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\n\f\v]+|[\r\n]+")
_ONE = {t: re.compile(p, re.S) for t, p in _SEQUENCE.items()}
#: Signs that a record is not clean; only for choosing training records.
_UNCLEAN = re.compile("[\u0080-\u009f-�｡-ﾟ─-▟]|[¡-ÿŒœŠšŸŽžƒˆ˜–-™]{3}")

#: What a short stretch must decode to before it bars a record from training: Western letters and punctuation, CJK, or anything long.
_USUAL = re.compile("[\u00a0-\u00ffŒœŠšŽžŸ–-…€™]+|[\u3000-\u9fff\uac00-\ud7a3\uff01-\uff60]{2,}|.{4,}", re.S)


def ansi(data: bytes) -> str:
    try:
        return data.decode("cp1252")
    except UnicodeDecodeError:
        return "".join(_ANSI[b] for b in data)


_ANSI = [bytes([b]).decode("cp1252", "replace") for b in range(256)]
_ANSI = [chr(b) if c == "�" else c for b, c in enumerate(_ANSI)]


class CharBytes(dict):
    """Char -> bytes in one codec, None where it has none; filled on demand."""

    def __init__(self, codec: str):
        super().__init__()
        self.codec = codec
        if codec == "ansi":
            self.update((chr(b), bytes([b])) for b in range(256))
            self.update((c, bytes([b])) for b, c in enumerate(_ANSI))

    def __missing__(self, c: str) -> bytes | None:
        out = None
        if self.codec != "ansi":
            try:
                out = c.encode(self.codec)
            except UnicodeEncodeError:
                pass
        self[c] = out
        return out


def decode(data: bytes, codec: str) -> str | None:
    if codec == "ansi":
        return ansi(data)
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return None


Segment = tuple[int, int, bytes, "Offsets"]


class Offsets(dict):
    """Byte offset -> char of a stretch written in one codec; worked out when first asked."""

    def __init__(self, text: str, start: int, read: CharBytes):
        super().__init__()
        self.text, self.start, self.read = text, start, read
        self.high: list[tuple[int, int, bytes]] | None = None

    def runs(self, text: str, i: int, j: int, read: CharBytes) -> list[tuple[int, int, bytes]]:
        """Runs of non-ASCII characters with their bytes."""
        if self.high is None:
            self.high = [(m.start(), m.end(), b"".join(map(read.__getitem__, m[0]))) for m in _HIGH.finditer(text, i, j)]
        return self.high

    def __contains__(self, offset: object) -> bool:
        if not self:
            size = 0
            for k, c in enumerate(self.text, self.start):
                self[size] = k
                size += len(self.read[c])
            self[size] = self.start + len(self.text)
        return super().__contains__(offset)


def segments(text: str, read: CharBytes) -> list[Segment]:
    """Stretches that the codec can write and that are not plain ASCII: start, end, bytes, byte offset -> char."""
    if read.codec != "ansi":
        try:
            return [(0, len(text), text.encode(read.codec), Offsets(text, 0, read))]
        except UnicodeEncodeError:
            pass
    out, n, i = [], len(text), 0
    while i < n:
        if read[text[i]] is None:
            i += 1
            continue
        j = i
        while j < n and read[text[j]] is not None:
            j += 1
        if not (part := text[i:j]).isascii():
            out.append((i, j, b"".join(map(read.__getitem__, part)), Offsets(part, i, read)))
        i = j
    return out


def spans(text: str, cut: list[Segment], read: CharBytes, written: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, text read rightly) of the stretches whose bytes make sense in ``written``."""
    for i, j, data, at in cut:
        if written not in _RUN:
            for s, e, high in at.runs(text, i, j, read):
                new = decode(high, written)
                if new is not None and new != text[s:e]:
                    yield s, e, new
            continue
        for run in _RUN[written].finditer(data):
            s, e = run.span()
            if e not in at:  # the last character may end in an ASCII byte of the text
                f = e + 1
                while f < len(data) and f not in at:
                    f += 1
                if f in at and data[e:f].isascii():
                    e = f
            if s not in at or e not in at:  # keep to whole characters on both sides
                aligned = [c for c in (*(m.start() for m in _ONE[written].finditer(data, s, e)), e) if c in at]
                if len(aligned) < 2:
                    continue
                s, e = aligned[0], aligned[-1]
            new = decode(data[s:e], written)
            if new is not None and (old := text[at[s] : at[e]]) != new and not old.isascii():
                yield at[s], at[e], new


class Utf8Signs:
    """Quick test for stretches that may be UTF-8 bytes of usual text read in one codec."""

    def __init__(self, codec: str):
        self.read = CharBytes(codec)
        pairs = [bytes([b]) for b in range(0x80, 256)] + [bytes([a, b]) for a in range(0x80, 256) for b in range(0x30, 256) if codec in _SEQUENCE]
        known = {c for b in pairs if (c := decode(b, codec)) is not None and len(c) == 1 and "\x80" <= c < "\U00010000"} | {c for c in self.read if c > "\x7f"}
        of = [(c, self.read[c]) for c in sorted(known)]

        def chars(test) -> str:
            found = "".join(re.escape(c) for c, b in of if b and test(b))
            return f"[{found}]" if found else "(?!)"

        def tail(x: int) -> bool:
            return 0x80 <= x <= 0xBF

        if codec not in _SEQUENCE:
            self.pattern = re.compile(chars(lambda b: 0xC2 <= b[0] <= 0xF4) + chars(lambda b: tail(b[0])))
        else:  # two bytes a character: a Western letter is one of them, punctuation begins in one, CJK lies over three
            one = chars(lambda b: len(b) == 2 and (b[0] in (0xC2, 0xC3, 0xC5) and tail(b[1]) or b[0] == 0xE2 and b[1] in (0x80, 0x82, 0x84)))
            head, middle, last = chars(lambda b: len(b) == 2 and b[0] >= 0xE3 and tail(b[1])), chars(lambda b: len(b) == 2 and tail(b[0]) and b[1] >= 0xE3), chars(lambda b: len(b) == 2 and tail(b[0]) and tail(b[1]))
            self.pattern = re.compile(f"{one}|{head}{middle}{last}")

    def found(self, text: str) -> bool:
        return bool(self.pattern.search(text)) and any(_USUAL.fullmatch(new) for _, _, new in spans(text, segments(text, self.read), self.read, "utf_8"))


class CharModel:
    """Interpolated character trigrams over hashed counts."""

    def __init__(self, counts: np.ndarray):
        counts = np.array(counts, np.float32)
        self.total = float(counts[: _OFFSETS[1]].sum()) or 1.0
        usual = [ord(c) for c in _TYPOGRAPHY]
        counts[usual] = np.maximum(counts[usual], TYPOGRAPHY_SHARE * self.total)
        self.counts = memoryview(counts)
        self.memo: dict[str, float] = {}

    @staticmethod
    def buckets(codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bucket of the 1-, 2- and 3-gram that ends at each position but the first two."""
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        with np.errstate(over="ignore"):
            two = b * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(0xC2B2AE3D27D4EB4F)
            three = (a * np.uint64(0x165667B19E3779F9) ^ two) * np.uint64(0xD6E8FEB86659FD93)
        return c & np.uint64(_OFFSETS[1] - 1), two >> np.uint64(64 - BITS[1]), three >> np.uint64(64 - BITS[2])

    def char(self, gram: str) -> float:
        """Log probability of the last of three characters after the two before it."""
        memo = self.memo
        got = memo.get(gram)
        if got is None:
            a, b, c = map(ord, gram)
            m = 0xFFFFFFFFFFFFFFFF
            two = (b * 0x9E3779B97F4A7C15 + c * 0xC2B2AE3D27D4EB4F) & m
            three = (((a * 0x165667B19E3779F9) & m ^ two) * 0xD6E8FEB86659FD93) & m
            before = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & m
            n = self.counts
            c1, c1b = n[c & (_OFFSETS[1] - 1)], n[b & (_OFFSETS[1] - 1)]
            c2, c2b = n[_OFFSETS[1] + (two >> (64 - BITS[1]))], n[_OFFSETS[1] + (before >> (64 - BITS[1]))]
            c3 = n[_OFFSETS[2] + (three >> (64 - BITS[2]))]
            # no gram is more frequent than its parts: bounds what collisions of the hash tables can add
            c2, c2b = min(c2, c1, c1b), min(c2b, c1b)
            c3 = min(c3, c2, c2b)
            w3, w2, w1, w0 = WEIGHTS
            p = w3 * min(1.0, c3 / (c2b + 0.5)) + w2 * min(1.0, c2 / (c1b + 0.5)) + w1 * c1 / self.total + w0 / 65536
            if len(memo) > 1_000_000:
                memo.clear()
            got = memo[gram] = math.log(p)
        return got

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """:meth:`char` at every position of an array of code points; 0 for the first two."""
        out = np.zeros(len(codes))
        if len(codes) < 3:
            return out
        codes = codes.astype(np.uint64)
        table = np.frombuffer(self.counts, np.float32)
        one, two, three = self.buckets(codes)
        single = codes[1:-1] & np.uint64(_OFFSETS[1] - 1)
        with np.errstate(over="ignore"):
            pair = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS[1])
        c1, c1b = table[one].astype(float), table[single].astype(float)
        c2 = np.minimum(np.minimum(table[_OFFSETS[1] + two.astype(np.int64)], c1), c1b)
        c2b = np.minimum(table[_OFFSETS[1] + pair.astype(np.int64)], c1b)
        c3 = np.minimum(np.minimum(table[_OFFSETS[2] + three.astype(np.int64)], c2), c2b)
        w3, w2, w1, w0 = WEIGHTS
        out[2:] = np.log(w3 * np.minimum(1.0, c3 / (c2b + 0.5)) + w2 * np.minimum(1.0, c2 / (c1b + 0.5)) + w1 * c1 / self.total + w0 / 65536)
        return out

    def whole(self, text: str) -> float:
        """Log probability of a text between spaces."""
        return float(self.log_probs(np.frombuffer(f"  {text}  ".encode("utf-32-le", "surrogatepass"), np.uint32)).sum())

    def score(self, text: str) -> float:
        """Log probability of a text after its first two characters."""
        return sum(self.char(text[i - 2 : i + 1]) for i in range(2, len(text)))


def _spaced(text: str) -> str:
    """The words of a text, two spaces between them."""
    if not text.isascii():
        return _SPACE.sub("  ", text).strip(" \t\r\n\f\v")
    for c in "\t\r\n\f\v":
        text = text.replace(c, " ")
    return "  ".join(w for w in text.split(" ") if w)


def add_ngrams(sums: np.ndarray, texts: Iterable[str]) -> None:
    """Count all n-grams of the texts; words stand between two spaces each."""
    part: list[str] = []
    size = 0
    for text in itertools.chain(texts, (None,)):
        if text is not None:
            part.append(text)
            size += len(text)
        if part and (text is None or size > 100_000):
            joined = "  ".join(["", *map(_spaced, part), ""])
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            for b, o in zip(CharModel.buckets(codes), _OFFSETS):
                np.add.at(sums, b.astype(np.int64) + o, 1)
            part, size = [], 0
            if text is None:
                break


def count_ngrams(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of :func:`add_ngrams`."""
    sums = np.zeros(TABLE, np.int64)
    add_ngrams(sums, texts)
    hit = np.flatnonzero(sums)
    return hit, sums[hit]


def words_of(text: str) -> list[str]:
    """The words with non-ASCII characters, which chains are scored on."""
    return [] if text.isascii() else [w for part in text.split(" ") if not part.isascii() for w in _WORD.findall(part) if not w.isascii()]


@cache
def signs_of(codec: str) -> Utf8Signs:
    """One per codec and worker process."""
    return Utf8Signs(codec)


def is_clean(text: str, signs: Iterable[Utf8Signs]) -> bool:
    """No sign of a wrong encoding: nothing odd, and no stretch that reads as UTF-8 bytes of usual text."""
    return text.isascii() or not _UNCLEAN.search(text) and not any(s.found(text) for s in signs)


class CleanTexts:
    """:func:`is_clean` word by word, each word judged once in a task."""

    def __init__(self):
        self.signs = [signs_of(c) for c in READ_AS]
        self.memo: dict[str, bool] = {}

    def word(self, word: str) -> bool:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            got = self.memo[word] = is_clean(word, self.signs)
        return got

    def __call__(self, words: list[str]) -> bool:
        return all(map(self.word, words))


#: What the first pass over the texts gives: n-gram counts, and words with non-ASCII characters.
_SURVEY = "bucket int, n bigint, word string"


def _count_rows(sums: np.ndarray, sign: int = 1) -> Iterator[pa.RecordBatch]:
    hit = np.flatnonzero(sums)
    for at in range(0, len(hit), 100_000):
        part = hit[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(sign * sums[part]), pa.nulls(len(part), pa.string())], names=["bucket", "n", "word"])


def _collect_counts(rows: DataFrame, counts: np.ndarray) -> np.ndarray:
    """``counts`` plus the sum of all count rows, at most ``TABLE`` of them."""
    counted = rows.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = counts.copy()
    out[counted.column("bucket").to_numpy()] += counted.column("n").to_numpy()
    return out


def _non_ascii(texts: DataFrame) -> DataFrame:
    return texts.filter(F.col(texts.columns[-1]).rlike(r"[^\x00-\x7F]"))


def survey(texts: DataFrame, clean: list[DataFrame]) -> DataFrame:
    """One pass over all texts: n-gram counts of the clean records of ``texts`` and of all of ``clean``, and the words of ``texts``
    that chains are scored on, each at most a few times a task. Written once; the counts have a fixed size, the words are the corpus' own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, sums, seen = CleanTexts(), np.zeros(TABLE, np.int64), set()
        for batch in batches:
            new: dict[str, None] = {}
            learnt = []
            for text, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                words = [] if known else words_of(text)
                new.update(dict.fromkeys(words))
                if judge(words):
                    learnt.append(text)
            add_ngrams(sums, learnt)
            if len(seen) > MEMO:
                seen.clear()
            words = [w for w in new if w not in seen]
            seen.update(words)
            if words:
                none = pa.nulls(len(words), pa.int64())
                yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none, pa.array(words, pa.string())], names=["bucket", "n", "word"])
        yield from _count_rows(sums)

    rows = texts.toDF("t").withColumn("known", F.lit(False))
    for more in clean:
        rows = rows.unionByName(more.toDF("t").withColumn("known", F.lit(True)))
    return checkpoint(map_arrow(spread(rows), run, _SURVEY))


def suspicious_words(words: DataFrame, model: CharModel, judge: bool = False) -> np.ndarray:
    """The field (:mod:`graphloom.llm.screen`) of the distinct words that some chain makes likelier; every word is screened once."""
    from graphloom.llm import bitfield, screen

    shared = words.sparkSession.sparkContext.broadcast(np.frombuffer(model.counts, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield screen.field_of((b.column(0).to_pylist() for b in batches), CharModel(shared.value), judge).rows()

    return bitfield.collect(map_arrow(words, run, bitfield.ROWS))


def without_suspects(texts: DataFrame, counts: np.ndarray, first: CharModel, slots: np.ndarray) -> np.ndarray:
    """Counts without the clean-looking records whose words the ``first`` model would repair
    (one-byte codecs misread into plausible letters, which show no other sign)."""
    from graphloom.llm.bitfield import Field

    shared = texts.sparkSession.sparkContext.broadcast((np.frombuffer(first.counts, np.float32), slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = shared.value
        clean, judge, field, sums = CleanTexts(), Repairer(CharModel(table), SUSPECT), Field(bits), np.zeros(TABLE, np.int64)

        for batch in batches:
            each = ((t, words_of(t)) for t in batch.column(0).to_pylist())
            texts = [t for t, words in each if any(w in field for w in words) and clean(words)]
            judge.prepare(texts, western=True)
            add_ngrams(sums, [t for t in texts if (found := judge.best(t, western=True)) is not None and found[1] > SUSPECT])
        yield from _count_rows(sums, -1)

    return _collect_counts(map_arrow(spread(_non_ascii(texts)), run, _SURVEY), counts)


class Repairer:
    """Scores chains word by word and repairs texts."""

    def __init__(self, model: CharModel, margin: float = LEAST_MARGIN):
        self.model, self.margin = model, margin
        self.wrong = {c: CharBytes(c) for c in READ_AS}
        self.memo: dict[str, list[tuple[tuple[str, str], float, str | None]]] = {}
        counts = np.frombuffer(model.counts, np.float32)[: _OFFSETS[1]]
        top = np.argsort(-counts, kind="stable")[:300]
        self.common = [chr(c) for c in top if counts[c] > 0 and not 0xD800 <= c < 0xE000]
        self._screen = None

    def gain(self, before: str, old: str, new: str, after: str) -> float:
        before, after = before[-2:], after[:2]
        return self.model.score(before + new + after) - self.model.score(before + old + after)

    def word(self, word: str, only: tuple[str, str] | None = None) -> list[tuple[tuple[str, str], float, str | None]]:
        """(chain, gain, word repaired) of each chain that makes this word likelier, or of one chain; no text for words that were prepared."""
        got = self.memo.get(word)
        if got is not None and only is None:
            return got
        out, padded, char = self._replaced(word), f"  {word}  ", self.model.char
        each = [char(padded[i - 2 : i + 1]) for i in range(2, len(padded))]
        least = -IN_ORDER if min(each) > (UNUSUAL if _WESTERN.search(word) else UNUSUAL_CJK) else -math.inf
        upto = [0.0, 0.0, *itertools.accumulate(each)]
        seen: dict[tuple[int, int, str], float] = {}
        for name, read in self.wrong.items():
            if only and name != only[0] or not any(c > "\x7f" and read[c] is not None for c in word):
                continue
            cut = segments(padded, read)
            for written in WRITTEN_IN:
                if written == name or only and written != only[1]:
                    continue
                total, parts, last, whole = 0.0, [], 2, written not in _SEQUENCE
                for s, e, new in spans(padded, cut, read, written):
                    g = seen.get((s, e, new))
                    if g is None:
                        # log probabilities only fall: stop as soon as the stored text is likelier
                        tail = padded[s - 2 : s] + new + padded[e : e + 2]
                        g = upto[s - 1] - upto[min(e + 1, len(padded) - 1)]
                        for i in range(2, len(tail)):
                            g += char(tail[i - 2 : i + 1])
                            if g <= -LOSS:
                                break
                        seen[s, e, new] = g
                    if g > 0 or whole:  # one wrong codec reads every character of a stretch wrongly
                        total += max(g, -LOSS)
                        parts += [padded[last:s], new]
                        last = e
                if total > 0 or whole and parts:
                    out.append(((name, written), max(total, least), "".join([*parts, padded[last:-2]])))
        if only:
            return out
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[word] = out
        return out

    def _replaced(self, word: str) -> list[tuple[tuple[str, str], float, str]]:
        return [(("lossy", ""), self.lossy(f"  {word}  "), word)] if "\ufffd" in word else []

    def lossy(self, padded: str) -> float:
        """Gain of any fitting character in place of each replacement character."""
        total, text = 0.0, padded
        while (i := text.find("\ufffd")) >= 0:
            around = [ord(x) for x in (text[i - 2], text[i - 1], "\ufffd", text[i + 1], text[i + 2])]
            tails = np.tile(np.array(around, np.uint64), (len(self.common) + 1, 1))
            tails[1:, 2] = [ord(c) for c in self.common]
            log = self.model.log_probs(tails.ravel()).reshape(tails.shape)[:, 2:].sum(axis=1)
            gains = log[1:] - log[0]
            best = max(zip(gains.tolist(), self.common), default=(0.0, "?"))
            total += max(0.0, best[0])
            text = text[:i] + best[1] + text[i + 1 :]
        return total

    def prepare(self, texts: Iterable[str], western: bool = False) -> None:
        """Score the words of these texts together; the same results as one by one."""
        new = [w for w in dict.fromkeys(w for t in texts for w in words_of(t)) if w not in self.memo and not (western and max(w) >= "\u2e80")]
        if new:
            if len(self.memo) > MEMO:
                self.memo.clear()
            if self._screen is None:
                from graphloom.llm.screen import Screen

                self._screen = Screen(self.model)
            for word, scores in self._screen.scores(new).items():
                self.memo[word] = self._replaced(word) + scores

    def best(self, text: str, only_utf8: bool = False, western: bool = False) -> tuple[tuple[str, str], float, str] | None:
        """The chain with the highest gain over the whole text; bytes that form UTF-8 count for themselves.

        Sequences of several bytes rarely make sense by chance: each word that gains
        counts. A one-byte codec can read anything, so such a chain must gain over
        whole sentences, against the words that it would spoil. ``western`` looks
        only at words without CJK characters.
        """
        gains: dict[tuple[str, str], float] = {}
        for sentence in _SENTENCE.split(text):
            if sentence.isascii():
                continue
            words = [w for w in _WORD.findall(sentence) if not w.isascii() and not (western and max(w) >= "\u2e80")]
            here: dict[tuple[str, str], float] = {}
            for w in words:
                for chain, g, _ in self.word(w):
                    here[chain] = here.get(chain, 0.0) + g
            for chain, g in here.items():
                if g > 0 and (not only_utf8 or chain[1] == "utf_8"):
                    gains[chain] = gains.get(chain, 0.0) + g
        if not gains:
            return None
        passed = [c for c in gains if gains[c] > self.margin] or list(gains)
        chain = max(passed, key=lambda c: (gains[c] + STRUCTURE * (c[1] == "utf_8"), c))
        return chain, gains[chain], self.apply(text, chain)

    def apply(self, text: str, chain: tuple[str, str]) -> str:
        """The text with each sentence that gains under the chain read rightly."""

        def read(word: str) -> tuple[float, str | None] | None:
            return None if word.isascii() else next(((g, x) for c, g, x in self.word(word) if c == chain), None)

        def replace(m: re.Match) -> str:
            found = read(m[0])
            if found and found[1] is None:
                found = next(((g, x) for c, g, x in self.word(m[0], chain) if c == chain), None)
            return found[1] if found else m[0]

        out = []
        for sentence in re.split(f"({_SENTENCE.pattern})", text):
            gained = sum(found[0] for w in _WORD.findall(sentence) if (found := read(w)))
            out.append(_WORD.sub(replace, sentence) if gained > 0 else sentence)
        return "".join(out)

    def repair(self, text: str | None) -> tuple[str, float, str | None] | None:
        """(chains, gain, restored text or None if bytes were lost); None for a text that is in order."""
        return self.repair_all([text])[0]

    def repair_all(self, texts: list[str | None]) -> list[tuple[str, float, str | None] | None]:
        """:meth:`repair` of each text. What was repaired is scored again for bytes that form UTF-8 (text that went wrong more than once) as long as the whole text gains more than the margin."""
        now = {i: t for i, t in enumerate(texts) if t and not t.isascii()}
        done: dict[int, tuple[list[str], float, bool]] = {}
        open_ = list(now)
        while open_:
            self.prepare(now[i] for i in open_)
            following = []
            for i in open_:
                found = self.best(now[i], only_utf8=i in done)
                if found is None or found[1] <= self.margin:
                    continue
                chain, g, fixed = found
                if i in done and self.model.whole(fixed) <= self.model.whole(now[i]) + self.margin:
                    continue
                chains, total, _ = done.get(i, ([], 0.0, False))
                lossy = chain[0] == "lossy" or fixed == now[i]
                done[i] = [*chains, ">".join(filter(None, chain))], total + g, lossy
                if not lossy:
                    now[i] = fixed
                    following.append(i)
            open_ = following
        return [(" ".join(done[i][0]), done[i][1], None if done[i][2] or "\ufffd" in now[i] else now[i]) if i in done else None for i in range(len(texts))]


def highest_gain(repairer: Repairer, clean: Iterable[str]) -> float:
    return max((found[1] for t in clean if t and not t.isascii() and (found := repairer.best(t))), default=0.0)


def margin_above(worst: float, least: float = LEAST_MARGIN) -> float:
    return max(least, 1.25 * worst)


def validated_margin(model: CharModel, clean: list[str], least: float = LEAST_MARGIN) -> float:
    """The least margin, or more if a clean record would pass it: above every gain on the validation records."""
    return margin_above(highest_gain(Repairer(model, 0.0), clean), least)


def margin_over_all(model: CharModel, clean: list[DataFrame]) -> float:
    """:func:`validated_margin` over all rows of the one-column frames ``clean``, judged where they lie."""
    if not clean:
        return LEAST_MARGIN
    rows = reduce(DataFrame.unionByName, [df.toDF("t") for df in clean])
    shared = rows.sparkSession.sparkContext.broadcast(np.frombuffer(model.counts, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trial = Repairer(CharModel(shared.value), 0.0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([highest_gain(trial, batch.column(0).to_pylist())], pa.float64())], names=["gain"])

    return margin_above(map_arrow(spread(rows), run, "gain double").agg(F.coalesce(F.max("gain"), F.lit(0.0))).first()[0])


def find_garbled(documents: DataFrame, clean: list[DataFrame], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, chain, gain, restored`` of each record whose text was decoded wrongly.

    ``clean``: one-column frames of texts known to be clean; they join the clean
    records of ``documents`` in training, and all of them validate the margin (the
    model has counted them). ``restored`` is null where characters were lost.

    Null, empty and ASCII texts are in order. Long texts are scored whole. Repeated
    rows repeat; ties between chains go to the last name. Further columns are not
    read; empty tables give no rows.
    """
    from graphloom.llm.bitfield import Field

    spark = documents.sparkSession
    id_type = documents.schema[id_column].dataType.simpleString()
    texts = documents.select(F.col(f"`{text_column}`"))
    surveyed = survey(texts, clean)
    tasks = max(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism)
    words = surveyed.filter("word IS NOT NULL").select("word").repartition(tasks, "word").distinct()
    counts = _collect_counts(surveyed, np.zeros(TABLE, np.float32))
    first = CharModel(counts)
    model = CharModel(without_suspects(texts, counts, first, suspicious_words(words, first, judge=True)))
    margin = margin_over_all(model, clean)
    shared = spark.sparkContext.broadcast((np.frombuffer(model.counts, np.float32), suspicious_words(words, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = shared.value
        repairer, field = Repairer(CharModel(table), margin), Field(bits)
        for batch in batches:
            texts = [(i, t) for i, t in enumerate(batch.column(1).to_pylist()) if any(w in field for w in words_of(t))]
            rows = [(i, *found) for (i, _), found in zip(texts, repairer.repair_all([t for _, t in texts])) if found]
            if rows:
                at, chain, gain, restored = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(chain), pa.array(gain, pa.float64()), pa.array(restored, pa.string())],
                    names=[id_column, "chain", "gain", "restored"],
                )

    rows = _non_ascii(documents.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")))
    return map_arrow(spread(rows), run, f"`{id_column}` {id_type}, chain string, gain double, restored string")
