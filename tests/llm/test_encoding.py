import numpy as np
import pytest

from graphloom.llm import encoding as E
from graphloom.llm import queries


@pytest.fixture(scope="module")
def clean(spark, small):
    docs = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect() if r[0]]
    signs = [E.Utf8Signs(c) for c in E.READ_AS]
    texts = [t for t in docs if E.is_clean(t, signs)]
    return texts + [r[0] for r in spark.read.parquet(f"{small}/lang_samples.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def repairer(clean):
    buckets, counts = E.count_ngrams(clean)
    table = np.zeros(E.TABLE, np.float32)
    table[buckets] = counts
    model = E.CharModel(table)
    return E.Repairer(model, E.validated_margin(model, clean))


def read_wrongly(text, written, read):
    data = text.encode(written)
    return E.ansi(data) if read == "ansi" else data.decode(read)


@pytest.mark.parametrize("written, read", [("utf_8", "ansi"), ("utf_8", "mac_roman"), ("utf_8", "cp437"), ("utf_8", "cp850"), ("utf_8", "koi8_r")])
def test_round_trip_of_western_texts(clean, repairer, written, read):
    texts = [t for t in clean if not t.isascii() and sum(c > "\x7f" for c in t) >= 3 and max(t) < "ɐ"][:60]
    right = 0
    for t in texts:
        found = repairer.repair(read_wrongly(t, written, read))
        right += found is not None and found[2] == t
    assert len(texts) > 20 and right / len(texts) >= 0.95


@pytest.mark.parametrize("written, read", [("cp932", "ansi"), ("euc_jp", "ansi"), ("utf_8", "ansi"), ("gb18030", "ansi")])
def test_round_trip_of_cjk_texts(clean, repairer, written, read):
    texts = []
    for t in clean:
        try:
            if any("一" <= c <= "鿿" for c in t) and t.encode(written):
                texts.append(t)
        except UnicodeEncodeError:
            pass
    texts = texts[:40]
    found = [repairer.repair(read_wrongly(t, written, read)) for t in texts]
    assert len(texts) > 20 and sum(f is not None for f in found) / len(texts) >= 0.95


def test_clean_records_pass(clean, repairer):
    assert [t for t in clean if repairer.repair(t)] == []


def test_twice_wrong_and_lossy(repairer):
    once = "Côté couvercle, ça vaut vraiment l'achat. Côté fermeture, rien à redire après 89 lavages."
    twice = read_wrongly(read_wrongly(once, "utf_8", "ansi"), "utf_8", "ansi")
    assert repairer.repair(twice)[2] == once
    lossy = once.encode("latin-1").decode("utf-8", "replace")
    found = repairer.repair(lossy)
    assert found is not None and found[2] is None


def test_genuine_oddities_are_in_order(repairer):
    for t in (None, "", "plain", "M%C3%BCll", "&eacute;t&eacute;", "caf\\u00e9", "👩‍👧 👍🏽 ☕️", "x" * 100_000):
        assert repairer.repair(t) is None


def test_ngrams_count_words_between_two_spaces():
    buckets, counts = E.count_ngrams(["ab", "a b"])
    assert counts.sum() == 3 * (len("  ab  a  b  ") - 2)
    assert E.count_ngrams([])[1].sum() == 0


def test_operator_edges(spark, clean):
    good = spark.createDataFrame([(t,) for t in clean], "t string")
    bad = "Die Größe ist schön und die Lieferung war für uns überraschend schnell".encode().decode("latin-1")
    rows = [(1, bad, "x"), (1, bad, "x"), (None, bad, "x"), (2, None, "x"), (3, "", "x"), (4, "Die Größe ist schön", None), (5, bad * 200, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, chain string")
    got = E.find_garbled(df, [good]).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "5", "None"]
    assert {r["restored"] for r in got if r["doc_id"] == 1} == {"Die Größe ist schön und die Lieferung war für uns überraschend schnell"}
    assert E.find_garbled(df.limit(0), [good.limit(0)]).count() == 0


def test_queries(spark, small):
    found = {r["doc_id"] for r in queries.p8_found(spark, small).collect()}
    lost = {r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").filter("text LIKE '%�%'").collect()}
    assert lost <= found


def test_frequent_misreadings_are_scored(spark):
    """A source that repeats one misreading makes its garbled trigrams usual; its words are scored all the same."""
    kinds = ("Tür", "Gerüche", "Hülle", "Bügel", "Füße", "Schlüssel")
    good = [f"Die {k} ist für mich sehr schön und überall günstig zu haben, Nummer {i}." for i in range(100) for k in kinds]
    bad = [read_wrongly(f"Die {k} ist für mich sehr schön und überall günstig zu haben.", "cp1252", "cp850") for k in kinds] * 8
    buckets, counts = E.count_ngrams(good + bad)
    table = np.zeros(E.TABLE, np.float32)
    table[buckets] = counts
    model = E.CharModel(table)
    word = bad[0].split()[3]
    assert min(model.char(f"  {word}  "[i - 2 : i + 1]) for i in range(2, len(word) + 4)) > -6
    assert (("cp850", "ansi"), "für") in [(c, new) for c, g, new in E.Repairer(model).word(word) if g > 0]
    rows = list(enumerate(good + bad))
    got = E.find_garbled(spark.createDataFrame(rows, "doc_id bigint, text string"), []).collect()
    assert {r["doc_id"] for r in got} == set(range(len(good), len(rows)))
    assert {r["restored"] for r in got} <= {g.split(", Nummer")[0] + "." for g in good}


def test_every_known_clean_record_validates_the_margin(spark):
    """The one odd record among the known clean ones counts wherever it stands."""
    known = [f"Das ist für Gäste Nummer {i} schön." for i in range(2500)] + ["Das f³r ist genau so gemeint."]
    good = spark.createDataFrame([(t,) for t in known], "t string").coalesce(1)
    docs = spark.createDataFrame([(1, "Das f³r ist genau so."), (2, "Das ist für Gäste schön.")], "doc_id bigint, text string")
    assert E.find_garbled(docs, [good]).collect() == []
