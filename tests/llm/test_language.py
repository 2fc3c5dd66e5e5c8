import pytest
from pyspark.sql import functions as F

from graphloom.llm import language as L
from graphloom.llm import queries


@pytest.fixture(scope="module")
def samples(spark, small):
    return [(r["lang"], r["text"]) for r in spark.read.parquet(f"{small}/lang_samples.parquet").orderBy("sample_id").collect()]


@pytest.fixture(scope="module")
def model(samples):
    return L.fit(samples)


def test_held_out_accuracy(samples):
    trained = L.fit([s for i, s in enumerate(samples) if i % 4])
    held = [s for i, s in enumerate(samples) if i % 4 == 0]
    right = [len({x[2] for x in found}) == 1 and found[0][2] == lang for (lang, _), found in zip(held, L.stretches(trained, [t for _, t in held]))]
    assert sum(right) / len(right) >= 0.98
    assert 0.05 < trained.temperature < 5
    assert (trained.weights == 0).mean() > 0.5  # the L1 penalty keeps the model sparse


def languages(model, text):
    return [x[2] for x in L.stretches(model, [text])[0]]


def test_mixed_texts(model):
    en, de, ja, zh = "The results were compared with those from the control group", "Die Ergebnisse wurden mit denen der Kontrollgruppe verglichen", "この結果は対照群の値と比較した", "我们与对照组的结果进行了比较"
    for sep in (". ", "; ", "\n\n", " / ", ", ", " – "):
        assert languages(model, sep.join((en, de))) == ["en", "de"]
        assert languages(model, sep.join((en, ja, zh))) == ["en", "ja", "zh"]
    assert languages(model, f"{en} ({de})") == ["en", "de"]
    found = L.stretches(model, [f"{en}. {de}."])[0]
    assert found[0][0] == 0 and 0.5 < found[0][3] <= 1.0


def test_what_is_no_language(model):
    for text in (None, "", "   ", "84.01 | 1.40 | 0.08 ± 0.01 %", "Tamolo (sic)"):
        assert languages(model, text) == []
    assert languages(model, "The results were compared (sic) with those from the second group, ad hoc.") == ["en"]
    assert languages(model, "Tamoloデータ was measured in 12 samples and compared with the others") == ["en"]
    assert languages(model, "The results were compared with those from the control group. " * 3000) == ["en"]


def test_label_spellings(spark):
    labels = {"en": "en", "en-US": "en", "EN": "en", "English": "en", " eng ": "en", "Deutsch": "de", "de_AT": "de", "日本語": "ja", "zh-Hans": "zh", "zho": "zh", "español": "es", "fr-CA": "fr", "": None, "  ": None, "unknown": None, "und": None, "mixed": None, "-": None, "n/a": None, "it": None, None: None, "entity": None}
    df = spark.createDataFrame([(k, v) for k, v in labels.items()], "label string, want string")
    assert [r["label"] for r in df.filter(~L.label_language(F.col("label")).eqNullSafe(F.col("want"))).collect()] == []


EN, DE = "The results were compared with those from the control group.", "Die Ergebnisse wurden mit denen der Kontrollgruppe verglichen."


def test_wrong_labels(spark, small):
    rows = [("c", "right", "en", EN), ("c", "spelling", "en-GB", EN), ("c", "none", None, EN), ("c", "wrong", "fr", EN), ("c", "mixed", "mixed", EN), ("c", "two", "en", EN + " " + DE), ("c", "figures", None, "1.2 | 3"), ("c", "null", "en", None), ("c", "none", None, EN), (None, "k", "de", EN)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "corpus_id string, passage_id string, l string, t string, lang string, segment int")
    samples = spark.read.parquet(f"{small}/lang_samples.parquet")
    keys = ["corpus_id", "passage_id"]
    found = L.detect(df, samples, keys, F.col("t"), F.col("l"))
    got = {tuple(r) for r in L.wrong_labels(found, keys).collect()}
    assert got == {("c", "none", "en"), ("c", "wrong", "en"), ("c", "mixed", "en"), ("c", "two", "en"), ("c", "two", "de"), (None, "k", "en")}
    assert L.detect(df.limit(0), samples, keys, F.col("t"), F.col("l")).count() == 0
    assert L.detect(df, samples.limit(0), keys, F.col("t"), F.col("l")).count() == 0


def test_queries(spark, small):
    segments = queries.p2_segments(spark, small)
    assert segments.filter("confidence < 0 OR confidence > 1 OR `end` <= `start`").count() == 0
    assert {r["lang"] for r in queries.p2_found(spark, small).collect()} <= set(L.LANGUAGES)
