"""Language of passages and of one-language stretches in them.

Sparse multinomial logistic regression on TF-IDF character n-grams. It is trained
on the labelled samples by follow-the-regularised-leader with L1 and L2 penalties,
and its probabilities are calibrated by a temperature on samples left out of
training. A passage is cut into clauses; the likeliest path through the clauses'
probabilities, at a cost per change of language, gives the stretches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import map_arrow, spread

LANGUAGES = ("de", "en", "es", "fr", "ja", "zh")
#: Labelled samples used for training at most.
MAX_SAMPLES = 5000
ORDERS, BITS = (1, 2, 3), 16
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.002, 12
#: Nats that a change of language costs between clauses.
SWITCH = 1.2
#: A stretch counts as a language from so many words (CJK: letters; two letters are a word).
LEAST_WORDS, LEAST_CJK = 3, 5

#: What labels call each language (fixed values).
NAMES = {
    "de": "de deu ger german deutsch allemand alemán aleman ドイツ語 德语 德語",
    "en": "en eng english englisch anglais inglés ingles 英語 英语",
    "es": "es spa spanish spanisch español espanol castellano castilian espagnol スペイン語 西班牙语 西班牙語",
    "fr": "fr fra fre french französisch franzosisch français francais francés frances フランス語 法语 法語",
    "ja": "ja jpn jp japanese japanisch japonais japonés japones 日本語 日语 日語 nihongo",
    "zh": "zh zho chi cmn cn chinese chinesisch chinois chino mandarin 中文 汉语 漢語 中国語 普通话 普通話 简体中文 繁體中文 简体 繁體 zhongwen",
}

_CLAUSE = regex.compile(r"""[^.!?。！？｡;；:：\n\r/|()（）\[\]{}"“”„«»「」『』—–•・,，、､…]+""")
_LETTERS = regex.compile(r"\p{L}")
_LATIN_WORD = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{M}'’]+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_HIDDEN = regex.compile(r"[\p{Cf}]+")
_DIGITS = re.compile(r"\d+")


def label_language(label: Column) -> Column:
    """The language that a label names, whatever its spelling; null for none and for other languages."""
    plain = F.lower(F.regexp_replace(F.trim(label), r"(?U)^\s+|\s+$", ""))
    head = F.regexp_extract(plain, r"^([^-_ (]+)", 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(plain.isin(names.split()) | head.isin(names.split()), F.lit(lang)).otherwise(out)
    return F.when(label.isNotNull(), out)


def clean(text: str) -> str:
    """One form of a clause for counting: compatibility forms and invisible characters gone, lower case, one digit."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return f" {_DIGITS.sub('0', text.lower()).strip()} "


def clauses(text: str) -> list[tuple[int, int, str]]:
    """(start, end, cleaned text) of the stretches between punctuation that hold a letter."""
    return [(m.start(), m.end(), clean(m[0])) for m in _CLAUSE.finditer(text) if _LETTERS.search(m[0])]


def size(text: str) -> tuple[int, int]:
    """(words of alphabetic scripts, CJK letters)."""
    return len([w for w in _LATIN_WORD.findall(text) if w.strip("'’")]), len(_CJK.findall(text))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the character n-grams of each text, sorted by row."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    keys = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for n in ORDERS:
            # h: hash of the n-gram that begins at each position
            h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            inside = row[: len(h)] == row[n - 1 :]
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keys.append(((row[: len(h)] << BITS) | (mixed >> np.uint64(64 - BITS)).astype(np.int64))[inside])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


def tfidf(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight): sublinear term frequency times idf, each text of length one."""
    row, bucket, count = features(texts)
    w = (1 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.bincount(row, w * w, minlength=len(texts)))
    return row, bucket, w / np.maximum(norm[row], 1e-12)


class LanguageModel:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float = 1.0):
        self.weights, self.bias, self.idf, self.temperature = weights, bias, idf, temperature

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.bias, (len(texts), 1))
        if texts:
            row, bucket, w = tfidf(texts, self.idf)
            np.add.at(out, row, self.weights[bucket] * w[:, None])
        return out

    def log_probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts) / self.temperature
        z -= z.max(axis=1, keepdims=True, initial=-np.inf) if len(z) else 0
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by per-coordinate FTRL-proximal with elastic net; z and n are its two sums."""
    k, d = len(LANGUAGES), 1 << BITS
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))  # the last row is the bias, never penalised

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        l1 = np.where(at == d, 0.0, L1)[:, None]
        l2 = np.where(at == d, 0.0, L2)[:, None]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(nn)) / ALPHA + l2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(d + 1))
    return w[:-1].astype(np.float32), w[-1]


def fit(samples: list[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """Train on (language, text) samples: sentences and clauses of four fifths; calibrate on the rest, then train on all."""
    samples = sorted((l, t) for l, t in samples if l in LANGUAGES and t)
    if not samples:
        raise ValueError("no labelled samples")
    pieces: list[tuple[int, str, bool]] = []
    for i, (lang, text) in enumerate(samples):
        cut = clauses(text)
        held = i % 5 == 4
        pieces += [(LANGUAGES.index(lang), clean(text), held)]
        pieces += [(LANGUAGES.index(lang), c, held) for _, _, c in cut]
    texts, y, held = [p[1] for p in pieces], np.array([p[0] for p in pieces]), np.array([p[2] for p in pieces])
    row, bucket, _ = features(texts)
    df = np.bincount(bucket, minlength=1 << BITS)
    idf = np.log((1 + len(texts)) / (1 + df)) + 1

    def train(use: np.ndarray) -> LanguageModel:
        row, bucket, w = tfidf(texts, idf)
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        d = 1 << BITS
        rows = [(np.append(bucket[a:b], d), np.append(w[a:b], 1.0)) for a, b in zip(ends[:-1], ends[1:])]
        chosen = np.flatnonzero(use)
        return LanguageModel(*_ftrl([rows[i] for i in chosen], y[chosen], np.random.default_rng(seed)), idf)

    trial = train(~held)
    model = train(np.ones(len(texts), bool))
    if held.any():
        z = trial.logits([t for t, h in zip(texts, held) if h])
        # targets smoothed by one error more than was seen, else perfect separation would leave no doubt at all
        target = np.full(z.shape, 1 / (len(z) + 2) / (z.shape[1] - 1))
        target[np.arange(len(z)), y[held]] = 1 - 1 / (len(z) + 2)

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float(-(target * (s - np.log(np.exp(s).sum(axis=1, keepdims=True)))).sum(axis=1).mean())

        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def stretches(model: LanguageModel, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, language, confidence) of the one-language stretches of each text that count as a language."""
    cut = [clauses(t) if t else [] for t in texts]
    flat = [c for cs in cut for _, _, c in cs]
    logp = model.log_probabilities(flat)
    weight = np.array([min(1.0, (w + c / 2) / 4) for w, c in map(size, flat)])
    out, at = [], 0
    for text, cs in zip(texts, cut):
        n = len(cs)
        own = logp[at : at + n] * weight[at : at + n, None]
        probability = np.exp(logp[at : at + n])
        at += n
        found: list[tuple[int, int, str, float]] = []
        if n:
            path = _viterbi(own)
            i = 0
            while i < n:
                j = i
                while j < n and path[j] == path[i]:
                    j += 1
                words = cjk = 0
                for _, _, c in cs[i:j]:
                    w, k = size(c)
                    words, cjk = words + w, cjk + k
                counts = cjk >= LEAST_CJK if LANGUAGES[path[i]] in ("ja", "zh") else words >= LEAST_WORDS
                if counts:
                    length = np.array([len(c) for _, _, c in cs[i:j]], float)
                    found.append((cs[i][0], cs[j - 1][1], LANGUAGES[path[i]], float(probability[i:j, path[i]] @ length / length.sum())))
                i = j
        out.append(found)
    return out


def _viterbi(own: np.ndarray) -> np.ndarray:
    """Likeliest path of languages, each change at the cost of ``SWITCH``."""
    n, k = own.shape
    score, back = own[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        best = int(score.argmax())
        change = score[best] - SWITCH
        back[i] = np.where(score >= change, np.arange(k), best)
        score = np.maximum(score, change) + own[i]
    path = np.zeros(n, np.int64)
    path[-1] = int(score.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def detect(passages: DataFrame, samples: DataFrame, keys: list[str], text: Column, label: Column, sample_lang: str = "lang", sample_text: str = "text") -> DataFrame:
    """One row per one-language stretch: ``keys, label_lang, segment, start, end, lang, confidence``.

    ``label_lang`` is the language the stored label names, null for none.
    ``start``/``end`` are character offsets, ``confidence`` the calibrated
    probability averaged over the stretch. Null and empty texts and texts without
    words (figures alone) give no row. Names and remarks of one or two words make
    no stretch. Long texts are read whole; repeated rows repeat; extra columns are
    not read. Training uses at most ``MAX_SAMPLES`` labelled samples; without any, no
    stretch is recognised.
    """
    # beyond the bound the samples of the lowest hashes, whatever their place; in stored order
    drawn = samples.select(F.col(sample_lang).alias("l"), F.col(sample_text).alias("t"), F.monotonically_increasing_id().alias("o"))
    drawn = drawn.orderBy(F.xxhash64("l", "t"), "l", "t").limit(MAX_SAMPLES).collect()
    labelled = [(r["l"], r["t"]) for r in sorted(drawn, key=lambda r: r["o"])]
    model = fit(labelled) if any(l in LANGUAGES and t for l, t in labelled) else None
    if model is None:  # nothing to learn from: nothing is recognised
        passages, model = passages.limit(0), LanguageModel(np.zeros((1 << BITS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES)), np.ones(1 << BITS))
    shared = passages.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.idf, model.temperature))
    names = [f"k{i}" for i in range(len(keys))]
    picked = passages.select(*[F.col(c).cast("string").alias(k) for c, k in zip(keys, names)], label_language(label).alias("label_lang"), text.alias("text")).filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LanguageModel(*shared.value)
        columns = [*names, "label_lang"]
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                rows = [(i, s, *x) for i, found in enumerate(stretches(known, part.column("text").to_pylist())) for s, x in enumerate(found)]
                if rows:
                    at, segment, start, end, lang, confidence = zip(*rows)
                    kept = part.select(columns).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(segment, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(lang), pa.array(confidence, pa.float64())],
                        names=[*columns, "segment", "start", "end", "lang", "confidence"],
                    )

    schema = ", ".join(f"{k} string" for k in names) + ", label_lang string, segment int, start int, end int, lang string, confidence double"
    found = map_arrow(spread(picked), run, schema)
    return found.select(*[F.col(k).alias(c.split(".")[-1]) for k, c in zip(names, keys)], "label_lang", "segment", "start", "end", "lang", "confidence")


def wrong_labels(found: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys, lang`` of the passages whose label is missing, wrong, or one for several languages."""
    each = found.groupBy(*keys, "label_lang").agg(F.collect_set("lang").alias("langs"))
    right = (F.size("langs") == 1) & F.col("label_lang").isNotNull() & (F.element_at("langs", 1) == F.col("label_lang"))
    return each.filter(~right).select(*keys, F.explode("langs").alias("lang")).distinct()
