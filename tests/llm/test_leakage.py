import regex

from graphloom.llm import leakage, queries
from tests import oracle

ITEMS = "item_id string, passage string, doc_id int"
DOCS = "doc_id bigint, text string, item_id string, words int"


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", text.casefold()) if text else []


def brute(docs, items):
    index = {}
    for item, passage in items:
        w = words(passage)
        for k in range(len(w) - 11):
            index.setdefault(tuple(w[k : k + 12]), set()).add(item)
    out = set()
    for doc, text in docs:
        w = words(text)
        for k in range(len(w) - 11):
            out |= {(doc, i) for i in index.get(tuple(w[k : k + 12]), ())}
    return out


def found(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    return leakage.leaks(d, i).collect()


def literal(rows):
    return {(r["doc_id"], r["item_id"]) for r in rows if r["literal"]}


def test_whole_table_equals_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/eval_items.parquet").select("item_id", "passage").collect()]
    want = brute(docs, items)
    assert want and {tuple(r) for r in queries.p7_found(spark, small).collect()} == want


STORY = "The ferry crew of Tamolo counted 12 barrels of herring worth 30 coins near the gate of Tamolo before noon while 7 widows of Bereku watched the river"


def test_cases(spark):
    base = STORY.split()
    items = [("a", STORY), ("b", "Prologue. " + " ".join(base[:14])), ("short", " ".join(base[:11])), ("n", None), ("e", ""), ("a", STORY)]
    docs = [
        (1, " ".join(base[:12])),
        (2, " ".join(base[:11])),
        (3, "<p>" + " *** ".join(x.upper() for x in base[3:16]) + "</p>"),
        (4, STORY.replace("herring", "hering")[:60]),
        (5, None),
        (6, ""),
        (7, ("filler text. " * 20_000) + STORY),
        (8, STORY),
        (8, STORY),
        (9, "Straße " * 12),
    ]
    got = literal(found(spark, docs, items))
    assert got == brute(docs, items) == {(1, "a"), (1, "b"), (3, "a"), (7, "a"), (7, "b"), (8, "a"), (8, "b")}


def test_case_folding(spark):
    text = " ".join(f"große{i}" for i in range(12))
    assert literal(found(spark, [(1, text.upper())], [("g", text)])) == {(1, "g")}


def renamed(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    return {(r["doc_id"], r["item_id"]): r for r in leakage.reparameterised(d, i).collect()}


def test_reparameterised_copy_needs_consistent_slots(spark):
    # three items make the plain words common; the copies change names and numbers
    items = [(f"i{k}", STORY.replace("Tamolo", t).replace("Bereku", b)) for k, (t, b) in enumerate((("Tamolo", "Bereku"), ("Sidova", "Harane"), ("Wilabu", "Nodero")))]
    same = STORY.replace("Tamolo", "Kolira").replace("Bereku", "Zumona").replace("12", "99")
    broken = same.replace("Kolira", "Pamuto", 1)  # the name returns beyond one window
    merged = same.replace("Zumona", "Kolira")
    docs = [(1, same), (2, broken), (3, merged), (4, STORY), (5, None), (6, ""), (1, same)]
    got = renamed(spark, docs, items)
    # document 3 differs in every window that holds both names; 4 is literal between the names
    assert set(got) == {(d, f"i{k}") for k in range(3) for d in (1, 3)}
    full = len(STORY.split()) - 11
    assert all(r["windows"] == full if d == 1 else r["windows"] < full for (d, _), r in got.items())
    assert {r["first_pos"] for r in got.values()} == {0}
    assert renamed(spark, [], items) == {} and renamed(spark, docs, []) == {}


def test_empty_tables(spark):
    assert found(spark, [], [("a", STORY)]) == []
    assert found(spark, [(1, STORY)], []) == []


def test_large_item_sets_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 1)
    assert literal(found(spark, [(1, STORY)], [("a", STORY)])) == {(1, "a")}


def test_found_equals_sql(spark, small):
    assert oracle.rows(queries.p7_found(spark, small)) == oracle.expected(oracle.connect(small), queries.SQL["p7_found"])


def test_runs_of_names_share_no_template(spark):
    """Windows of rare words alone meet literal copies, however many documents hold such runs."""
    docs = [(i, " ".join(f"zq{i}x{k}" for k in range(14))) for i in range(3000)]
    items = [("names", " ".join(f"vw{k}" for k in range(14))), ("copy", docs[7][1]), *((f"i{k}", STORY) for k in range(3))]
    rows = found(spark, docs, items)
    assert {(r["doc_id"], r["item_id"], r["literal"]) for r in rows} == {(7, "copy", 3)}


def test_recall_and_precision_of_renamed_items(spark, small):
    """Sixteen words around a name of each item, under new names, between other text: found, and no untouched document is."""
    items = [tuple(r) for r in spark.read.parquet(f"{small}/eval_items.parquet").filter("lang = 'en'").select("item_id", "passage").collect()]
    coder = leakage.Templates(leakage.common_words(spark.createDataFrame([(*r, 1) for r in items], ITEMS)))

    def is_name(w):
        return coder.code(w)[0] == leakage._NAME

    planted, docs = set(), []
    for n, (item, passage) in enumerate(items):
        w = words(passage)
        at = next((k for k in range(8, len(w) - 8) if is_name(w[k])), None)
        if at is not None:
            piece = " ".join(f"Q{sum(map(ord, x)) * 7919 % 100003}x" if is_name(x) else x for x in w[at - 8 : at + 8])
            planted.add((n, item))
            docs.append((n, f"So far so good. {piece} It works well."))
    docs += [(1000 + n, f"This is an ordinary review number {n} of a lamp that we bought for the garden and liked a lot.") for n in range(50)]
    got = {(d, i) for d, i in renamed(spark, docs, items)}
    assert len(planted) > 50 and len(got & planted) / len(planted) >= 0.95
    assert not {d for d, _ in got if d >= 1000}
