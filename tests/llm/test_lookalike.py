import collections
import unicodedata

import regex
from pyspark.sql import functions as F

from graphloom.llm import lookalike as L
from graphloom.llm import queries

# an own, simpler mapping as the check
STANDS = dict(zip("аеорсухіјѕАВЕКМНОРСТХІЈЅοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsABEKMHOPCTXIJSoABEZHIKMNOPTYX"))
BACK = dict(zip("aeopcyxijsABEKMHOPCTXIJS", "аеорсухіјѕАВЕКМНОРСТХІЈЅ"))


def look(text):
    keep = ("<super", "<frac", "<sub", "<circ")
    text = "".join(c if unicodedata.decomposition(c).startswith(keep) else unicodedata.normalize("NFKC", c) for c in text)
    text = unicodedata.normalize("NFD", regex.sub("[­​-‏⁠﻿]", "", text))

    def word(m):
        w = m[0]
        if regex.search(r"\p{Latin}", w) and regex.search(r"[\p{Cyrillic}\p{Greek}]", w):
            latin = "".join(STANDS.get(c, c) for c in w)
            cyrillic = "".join(BACK.get(c, c) for c in w)
            return latin if not regex.search(r"[\p{Cyrillic}\p{Greek}]", latin) else cyrillic if not regex.search(r"\p{Latin}", cyrillic) else w
        return w

    return unicodedata.normalize("NFC", regex.sub(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{M}]+", word, text))


def brute(rows):
    classes = collections.defaultdict(set)
    for grp, key, value in rows:
        if None not in (grp, key, value) and regex.search(r"[^\p{Z}\p{C}]", value):
            classes[grp, look(value)].add((key, value))
    return {(g, a[0], b[0]) for (g, _), s in classes.items() for a in s for b in s if a[0] < b[0] and a[1] != b[1]}


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "g string, k string, v string, look int")
    values = L.values_of(df, "g", "k", F.col("v"), "f")
    return {(r["grp"], r["key_a"], r["key_b"]) for r in L.lookalike_pairs(values).collect()}


def test_whole_table_equals_brute_force(spark, small):
    p = spark.read.parquet(f"{small}/mem_passages.parquet")
    want = {(g, "normalized_text", a, b) for g, a, b in brute([tuple(r) for r in p.select("corpus_id", "passage_id", "normalized_text").collect()])}
    mentions = [tuple(r) for r in p.select("corpus_id", F.explode("entity_mentions").alias("m")).select("corpus_id", "m", "m").collect()]
    want |= {(g, "entity_mentions", a, b) for g, a, b in brute(mentions)}
    assert want and {tuple(r) for r in queries.p5_found(spark, small).collect()} == want


SAME = [
    ("Ｋｉｔ", "Kit"), ("café", "café"), ("a​b", "ab"), ("a b", "a b"), ("a　b", "a b"), ("dаta", "data"), ("データ", "ﾃﾞｰﾀ"), ("用", "⽤"), ("ﬁn", "fin"), ("Κit", "Kit"),
    ("сaрова", "сарова"), ("Kelvin", "Kelvin"), ("co­op", "coop"), ("ё‍", "ё"), ("fаhο̈l", "fahöl"), ("Ⅳ", "IV"), ("ﾊﾟ", "パ"), ("Ｂ２", "B2"),
]
DIFFERENT = [("Kit", "kit"), ("cafe", "café"), ("m²", "m2"), ("½", "1/2"), ("a1", "a2"), ("end", "end."), ("сара", "capa"), ("かな", "カナ"), ("①", "1"), ("ab", "a b"), ("ñ", "n")]


def test_kinds_of_disguise(spark):
    rows = [(f"s{i}", f"{j}", x) for i, p in enumerate(SAME) for j, x in enumerate(p)]
    assert pairs(spark, rows) == {(f"s{i}", "0", "1") for i in range(len(SAME))}


def test_visible_differences(spark):
    assert pairs(spark, [(f"d{i}", f"{j}", x) for i, p in enumerate(DIFFERENT) for j, x in enumerate(p)]) == set()


def test_nulls_copies_ties_and_long_texts(spark):
    long = "sample text " * 20_000
    rows = [("g", "a", "x y"), ("g", "b", "x y"), ("g", "c", "x y"), ("g", "c", "x y"), ("h", "d", "x y"), (None, "e", "x y"), ("g", None, "x y"), ("g", "f", None), ("g", "g", ""), ("g", "h", " "), ("g", "i", "​")]
    rows += [("l", "1", long), ("l", "2", long.replace("text", "te​xt", 1))]
    assert pairs(spark, rows) == brute(rows) == {("g", "a", "c"), ("g", "b", "c"), ("l", "1", "2")}
    assert pairs(spark, []) == set()


def test_canonical_member_is_the_plain_one(spark):
    df = spark.createDataFrame([("g", x, x) for x in ("ｋit", "kit", "ki​t", "other")], "g string, k string, v string")
    got = L.canonical_members(L.values_of(df, "g", "k", F.col("v"), "f")).collect()
    assert {r["value"]: r["canonical"] for r in got} == {"ｋit": "kit", "kit": "kit", "ki​t": "kit", "other": "other"}
    assert {r["variants"] for r in got} == {1, 3}


def test_classes_and_pieces_give_the_same_pairs(spark, monkeypatch):
    rows = [("g", f"k{i:03d}", "kit" if i % 3 else "ｋit") for i in range(90)] + [("g", "z", "other")]
    whole = pairs(spark, rows)
    monkeypatch.setattr(L, "PIECE", 7)
    assert pairs(spark, rows) == whole == brute(rows) and len(whole) == 30 * 60
    values = L.values_of(spark.createDataFrame(rows, "g string, k string, v string"), "g", "k", F.col("v"), "f")
    member = {r["key"]: r for r in L.lookalike_classes(values).collect()}
    assert set(member) == {k for _, k, v in rows if v != "other"} and {r["variants"] for r in member.values()} == {2} and len({r["class_id"] for r in member.values()}) == 1
