import pytest
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.functions.scalar import document_ids, fold, merge_token, utf16_key
from graphloom.operators import delete_document as dd
from graphloom.operators import store
from graphloom.sources.generation import GenerationStore, append_audit, capabilities, ping, read_audit, read_snapshot_files
from graphloom.streaming import ingest


def test_by_ids(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, x int")
    assert [r["id"] for r in store.by_ids(df.filter("x < 3"), "id", ["b", "z", "a", "b"]).collect()] == ["b", "a"]
    with pytest.raises(Exception, match="INTEGRITY"):
        store.by_ids(df, "id", ["b"]).collect()
    with pytest.raises(GraphError):
        store.by_ids(df, "id", ["a", "a"], unique_request=True)


def test_fold_and_order(spark):
    df = spark.createDataFrame([("ΟΔΟΣ",), ("�",), ("😀",), ("École",), ("K",)], "s string")
    assert {r[0] for r in df.select(fold(F.col("s"))).collect()} >= {"οδος", "école", "k"}
    two = df.filter(F.col("s").isin("�", "😀")).orderBy(utf16_key(F.col("s")))
    assert [r["s"] for r in two.collect()] == ["😀", "�"]


def test_document_ids(spark):
    refs = ['{"sourceDocumentIds":["a","b"]}', '{"metadata":{"documentId":"c"}}', '{"sourceDocumentIds":[],"metadata":{"documentId":"c"}}', "{}", None, "broken"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "i int, ref string")
    assert [r[0] for r in df.orderBy("i").select(document_ids(F.col("ref"))).collect()] == [["a", "b"], ["c"], [], [], [], []]


def test_page_concatenation(spark):
    edges = spark.createDataFrame([("c", f"e{i}", f"s{i % 7}", f"t{i % 5}", float(i)) for i in range(50)], "corpus_id string, edge_id string, source_node_id string, target_node_id string, weight double")
    whole = [tuple(r) for r in store.transitions(edges, "c").select("source", "target", "weight").collect()]
    got, offset = [], 0
    while offset < 50:
        page = store.transitions_page(edges, "c", offset, 300).orderBy("position").collect()
        got += [(r["source"], r["target"], r["weight"]) for r in page]
        offset = page[-1]["position"]
    assert got == whole


def test_memory_upsert(spark):
    stored = spark.createDataFrame([("c", 0, "a", "1"), ("c", 1, "b", "2"), ("c", 2, "a", "3")], "corpus_id string, pos bigint, id string, v string")
    delta = spark.createDataFrame([("c", "a", "x", 0), ("d", "n", "y", 1), ("c", "m", "z", 2)], "corpus_id string, id string, v string, _ord int")
    got = sorted(tuple(r) for r in store.memory_upsert(stored, delta, "id").collect())
    assert got == [("c", 0, "a", "1"), ("c", 1, "b", "2"), ("c", 2, "a", "x"), ("c", 3, "m", "z"), ("d", 0, "n", "y")]


ALIAS = "array<struct<label string, language string, source string, confidence double, isCanonical boolean>>"


def test_schema_merge(spark):
    stored = spark.createDataFrame([("c", "s", 2, ["f"], ["d"], [("l", "en", "x", 1.0, True)], "{}")], f"corpus_id string, schema_id string, frequency bigint, fact_ids array<string>, source_document_ids array<string>, aliases {ALIAS}, raw string")
    token = stored.select(merge_token(F.col("raw"))).first()[0]

    def intent(token, document, delta):
        return spark.createDataFrame([("c", "s", token, document, delta, ["f", "g", "g"], [("l", "en", "x", 0.5, False), ("m", None, "x", 0.5, False)])], f"corpus_id string, schema_id string, token string, document_id string, frequency_delta bigint, fact_ids array<string>, aliases {ALIAS}")

    r = store.schema_merge(stored, intent(token, "e", 1)).first()
    assert (r["frequency"], r["fact_ids"], r["source_document_ids"], [a["label"] for a in r["aliases"]]) == (3, ["f", "g"], ["d", "e"], ["l", "m"])
    assert store.schema_merge(stored, intent(token, "d", 0)).first()["source_document_ids"] == ["d"]
    for bad in (intent("stale", "e", 1), intent(token, "e", 0), intent(token, "d", 1)):
        with pytest.raises(Exception, match="CONFLICT|INVALID_ARGUMENT"):
            store.schema_merge(stored, bad).collect()


W, X, C = "doc-w", "doc-x", "c"
NODE = "corpus_id string, node_id string, layer string, item_id string, document_id string, source_document_ids array<string>, passage_ids array<string>, fact_ids array<string>, updated_at string"


@pytest.fixture(scope="module")
def deleted(spark):
    facts = [("w1", "s1", [W], ["pw"], "copper", "bronze"), ("w2", "s2", [W], ["pw"], "zinc", "solder"), ("x1", "s1", [X], ["px"], "copper", "kettle"), ("sh", "s1", [W, X], ["pw", "px"], "copper", "gong")]
    nodes = [(C, f"fact:{f}", "fact", f, None, d, p, None, "t") for f, _, d, p, _, _ in facts]
    nodes += [(C, f"passage:{p}", "passage", p, d, None, None, None, "t") for p, d in (("pw", W), ("px", X))]
    nodes += [(C, f"entity:{e}", "entity", None, None, None, None, None, "t") for e in ("copper", "bronze", "zinc", "solder", "kettle", "gong")]
    nodes += [(C, "schema:s1", "ontology", "s1", None, [W, X], None, ["w1", "x1", "sh"], "t"), (C, "schema:s2", "ontology", "s2", None, [W], None, ["w2"], "t")]
    edges = [(f"schema-instance:{s}:{f}", f"schema:{s}", f"fact:{f}", "schema_instance") for f, s, *_ in facts]
    edges += [(f"fact-evidence:{f}:{p}", f"fact:{f}", f"passage:{p}", "fact_evidence") for f, _, _, ps, *_ in facts for p in ps]
    edges += [(f"entity-cooccur:{h}:{t}:{f}", f"entity:{h}", f"entity:{t}", "entity_cooccurrence") for f, _, _, _, h, t in facts]
    edges += [(f"entity-mention:{e}:{p}", f"entity:{e}", f"passage:{p}", "entity_mention") for e, p in (("copper", "pw"), ("bronze", "pw"), ("zinc", "pw"), ("solder", "pw"), ("copper", "px"), ("kettle", "px"), ("gong", "pw"), ("gong", "px"))]
    edges += [("type-bridge:s1:s2", "schema:s1", "schema:s2", "type_based_bridge")]
    vectors = [("schema:s1", "schema", W), ("schema:s2", "schema", W), ("fact:w1", "fact", W), ("fact:w2", "fact", W), ("fact:x1", "fact", X), ("fact:sh", "fact", W), ("passage:pw", "passage", W), ("passage:px", "passage", X)]
    vectors += [(f"entity:{e}", "entity", None) for e in ("copper", "bronze", "zinc", "solder", "kettle", "gong")]
    make = spark.createDataFrame
    other = ("other", "passage:pw", "passage", "pw", W, None, None, None, "t")
    passages = make([(C, "pw", W), (C, "px", X), ("other", "pw", W)], "corpus_id string, passage_id string, document_id string")
    before = dd.Store(
        make([*nodes, other], NODE),
        make([(C, *e) for e in edges], "corpus_id string, edge_id string, source_node_id string, target_node_id string, relation string"),
        make([(C, *v) for v in vectors], "corpus_id string, id string, namespace string, document_id string"),
        passages,
        passages,
        make([(C, f, s, d, p, "t") for f, s, d, p, _, _ in facts], "corpus_id string, fact_id string, schema_id string, source_document_ids array<string>, passage_ids array<string>, updated_at string"),
        make([(C, "s1", [W, X], ["w1", "x1", "sh"], 3, 3, "stable", "t"), (C, "s2", [W], ["w2"], 1, 3, "pending", "t")], "corpus_id string, schema_id string, source_document_ids array<string>, fact_ids array<string>, frequency bigint, stabilization_threshold bigint, state string, updated_at string"),
    )
    return dd.delete_document(before, C, W, "now")


def test_delete_document_counters(deleted):
    assert deleted[1].first().asDict() == {
        "removed_passages": 1, "removed_facts": 2, "pruned_shared_facts": 1, "pruned_schemas": 2, "schema_frequency_adjusted": 2, "removed_passage_nodes": 1, "removed_fact_nodes": 2, "removed_entity_nodes": 3, "removed_other_nodes": 0,
        "pruned_shared_nodes": 1, "pruned_ontology_nodes": 1, "removed_ontology_nodes": 1, "removed_edges": 13, "removed_vectors": 7, "rekeyed_vectors": 2, "removed_lexical_passages": 1,
    }


def test_delete_document_state(deleted):
    after = deleted[0]

    def mine(df):
        return df.filter(F.col("corpus_id") == C).collect()

    assert {r["node_id"] for r in mine(after.nodes)} == {"entity:copper", "entity:gong", "entity:kettle", "fact:sh", "fact:x1", "passage:px", "schema:s1"}
    assert {r["edge_id"] for r in mine(after.edges)} == {
        "schema-instance:s1:x1", "schema-instance:s1:sh", "fact-evidence:x1:px", "fact-evidence:sh:px", "entity-cooccur:copper:kettle:x1", "entity-cooccur:copper:gong:sh", "entity-mention:copper:px", "entity-mention:kettle:px", "entity-mention:gong:px",
    }
    assert {(r["id"], r["document_id"]) for r in mine(after.vectors)} == {("schema:s1", X), ("fact:x1", X), ("fact:sh", X), ("passage:px", X), ("entity:copper", None), ("entity:kettle", None), ("entity:gong", None)}
    assert {r["fact_id"]: (r["source_document_ids"], r["passage_ids"], r["updated_at"]) for r in mine(after.facts)} == {"x1": ([X], ["px"], "t"), "sh": ([X], ["px"], "now")}
    assert {r["schema_id"]: (r["source_document_ids"], r["fact_ids"], r["frequency"], r["state"]) for r in mine(after.schemas)} == {"s1": ([X], ["x1", "sh"], 2, "pending"), "s2": ([], [], 0, "pending")}
    assert {r["node_id"]: r["fact_ids"] for r in mine(after.nodes)}["schema:s1"] == ["x1", "sh"]
    assert after.nodes.filter("corpus_id = 'other'").count() == 1 and after.lexical.count() == 2


def test_generations(spark, tmp_path):
    s = GenerationStore(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([(1,)], "x int")
    s.append("t", one)
    second = s.append("t", one)
    assert s.read("t").count() == 2 and s.read("t", second.number).count() == 2
    base = s.current()
    s.stage(one, "t")  # a writer that dies before publishing
    assert s.read("t").count() == 2
    s.append("t", one)
    with pytest.raises(GraphError, match="RETRYABLE_CONFLICT"):
        s.publish(base, appended={"t": ["parts/none"]})
    with pytest.raises(GraphError, match="GENERATION_CHANGED"):
        s.read("t", base.number)
    s.compact("t")
    assert s.read("t").count() == 3 and len(s.current().tables["t"]) == 1
    assert s.discard_unreferenced() == []  # its writer may still be alive
    assert len(s.discard_unreferenced(0)) == 1 and s.read("t").count() == 3
    assert [len(p) for _, p in s.lineage("t")] == [1, 2, 3, 1]
    with pytest.raises(GraphError, match="NOT_FOUND"):
        s.read("none")
    assert len(s.forget(1)) == 3 and s.read("t").count() == 3


def test_generations_in_a_hadoop_file_system(spark, tmp_path):
    s = GenerationStore(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([(1, "a", 0)], "k int, v string, o int")
    s.replace("t", one.drop("o"))
    base = s.current()
    s.change("t", spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], one.schema), ["k"], "o", 5)
    s.change("t", spark.createDataFrame([(1, "old", 9)], one.schema), ["k"], "o", 4)  # dekettleed late
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "c"), (2, "d")]
    with pytest.raises(GraphError, match="RETRYABLE_CONFLICT"):
        s.publish(base)
    with pytest.raises(FileExistsError):
        s.files.create("MANIFEST-1.json", "{}")
    (tmp_path / "store" / "MANIFEST-9.json").write_text('{"t": [')  # another writer, not yet done
    assert s.current().number == 3
    (tmp_path / "store" / "MANIFEST-9.json").unlink()
    s.compact("t")
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "c"), (2, "d")]


def test_prepare_and_commit(spark, tmp_path):
    s = GenerationStore(spark, str(tmp_path / "store"))
    one, base = spark.range(3), s.current()
    parts = {"t": [s.stage(one, "t")]}
    evidence = s.prepare(base, parts)
    with pytest.raises(GraphError, match="EVIDENCE_MISMATCH"):
        s.commit(base, {"t": [*parts["t"], s.stage(one, "t")]}, evidence)
    assert s.commit(base, parts, evidence).number == 1 and s.read("t").count() == 3
    with pytest.raises(GraphError, match="RETRYABLE_CONFLICT"):
        s.commit(base, parts, evidence)


def test_audit_and_capabilities(spark, tmp_path):
    path = str(tmp_path / "audit")
    events = spark.createDataFrame([("u", 1)], "actor string, n int")
    append_audit(events, path)
    append_audit(events, path)
    assert read_audit(spark, path, "actor string, n int").count() == 2
    assert capabilities()["limits"]["seeds"] == 512 and ping() == "pong"


def test_streaming_upserts(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "corpus_id string, node_id string, label string, o int"

    def feed(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.stream_upserts(stream, root, "nodes", ["corpus_id", "node_id"], "o", str(tmp_path / "cp")).awaitTermination()

    feed([("c", "a", "1", 1), ("c", "a", "2", 2), ("c", "b", "1", 1)])
    feed([("c", "a", "3", 1)])
    got = GenerationStore(spark, root).read("nodes")
    assert sorted(tuple(r) for r in got.collect()) == [("c", "a", "3"), ("c", "b", "1")]


def test_snapshot_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"passages": []}')
    r = read_snapshot_files(spark, str(tmp_path)).first()
    assert (r["snapshot_id"], r["body"]) == ("a.json", '{\n"passages": []}')


def test_upsert_keys(spark):
    old = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int")
    delta = spark.createDataFrame([(None, 20, 1), ("a", 10, 1), ("a", 11, 2)], "k string, v int, o int")
    assert sorted(map(tuple, store.upsert(old, delta, ["k"], "o").collect()), key=str) == [("a", 11), ("c", 3), (None, 20)]
    with pytest.raises(Exception, match="CONFLICT"):
        store.upsert(old, delta.drop("o"), ["k"]).collect()


def test_schema_merge_errors_and_create(spark):
    schema = f"corpus_id string, schema_id string, frequency bigint, fact_ids array<string>, source_document_ids array<string>, aliases {ALIAS}, raw string"
    stored = spark.createDataFrame([("c", "s", None, None, None, None, "{}"), ("c", "t", 5, [], [], [], None)], schema)
    token = stored.filter("schema_id = 's'").select(merge_token(F.col("raw"))).first()[0]
    kind = f"corpus_id string, schema_id string, token string, document_id string, frequency_delta bigint, fact_ids array<string>, aliases {ALIAS}, mode string, created struct<frequency bigint, fact_ids array<string>, source_document_ids array<string>, aliases {ALIAS}, raw string>"
    merge = ("c", "s", token, "e", 1, ["f"], [("m", None, "x", 0.5, False)], None, None)
    create = ("c", "n", None, None, None, None, None, "create", (7, ["f"], ["d"], [], "{}"))
    got = {r["schema_id"]: r for r in store.schema_merge(stored, spark.createDataFrame([merge, create], kind)).collect()}
    assert (got["s"]["frequency"], got["s"]["fact_ids"], got["s"]["source_document_ids"], len(got["s"]["aliases"])) == (1, ["f"], ["e"], 1)
    assert (got["n"]["corpus_id"], got["n"]["frequency"], got["n"]["raw"], got["t"]["frequency"]) == ("c", 7, "{}", 5)
    unknown, exists, nothing, mode = ("c", "x", *merge[2:]), ("c", "s", *create[2:]), (*create[:8], None), (*merge[:7], "other", None)
    for bad in ([merge, merge], [unknown], [exists], [nothing], [mode]):
        with pytest.raises(Exception, match="CONFLICT|INVALID_ARGUMENT"):
            store.schema_merge(stored, spark.createDataFrame(bad, kind)).collect()
    assert store.schema_merge(stored, spark.createDataFrame([], kind)).count() == 2


def test_edges_by_id(spark):
    schema = "corpus_id string, edge_id string, source_node_id string, target_node_id string, weight double"
    edges = spark.createDataFrame([("c", "e", "a", "b", 1.0)], schema)
    nodes = spark.createDataFrame([("c", "a"), ("c", "b")], "corpus_id string, node_id string")

    def make(*row):
        return spark.createDataFrame([row], schema)

    assert store.create_edge(edges, make("c", "f", "b", "a", 2.0), nodes).count() == 2
    for bad, code in ((make("c", "e", "a", "b", 1.0), "CONFLICT"), (make("c", "g", "a", "z", 1.0), "NOT_FOUND")):
        with pytest.raises(Exception, match=code):
            store.create_edge(edges, bad, nodes).collect()
    assert store.update_edge(edges, "c", "e", weight=5.0).first()["weight"] == 5.0
    assert store.delete_edges(edges, edges.select("corpus_id", "edge_id")).count() == 0
    assert store.exists(store.get_edge(edges, "c", "e")) and not store.exists(store.get_edge(edges, "c", "none"))


def test_pages_follow_the_protocol(spark):
    edges = spark.createDataFrame([("c", f"e{i:03d}", "s", "t", 1.0) for i in range(40)], "corpus_id string, edge_id string, source_node_id string, target_node_id string, weight double")
    offset, seen = 0, 0
    while offset is not None:
        page, head = store.transitions_pages(edges, "c", offset, 400, 3, 3)
        seen, offset = seen + page.count(), head["next_offset"]
    assert seen == head["total"] == 40
    for call, code in (((edges, "c", 40, 400), "INVALID_ARGUMENT"), ((edges, "c", 0, 400, 2, 3), "GENERATION_CHANGED"), ((edges, "none", 1, 400), "INVALID_ARGUMENT")):
        with pytest.raises(GraphError, match=code):
            store.transitions_pages(*call)
    assert store.transitions_pages(edges, "none", 0, 400)[1] == {"generation": None, "total": 0, "next_offset": None}


def test_vectors_checkpoints_and_sections(spark):
    vectors = spark.createDataFrame([("c", "v", [1.0], "n")], "corpus_id string, id string, values array<double>, namespace string")
    for bad in ([], [float("nan")], [float("inf")], [None], None, [1.0] * 5):
        with pytest.raises(Exception, match="INVALID_ARGUMENT"):
            store.upsert_vectors(vectors, spark.createDataFrame([("c", "w", bad, "n")], vectors.schema), max_dimensions=4).collect()
    none = spark.createDataFrame([], "job_id string, body string")
    twice = store.save_checkpoint(store.save_checkpoint(none, "j", "c", [], "t0"), "j", "c", ["d"], "t1")
    assert [r["body"] for r in store.load_checkpoint(twice, "j").collect()] == ['{"corpusId":"c","jobId":"j","processedDocumentIds":["d"],"updatedAt":"t1"}']
    assert store.load_checkpoint(twice, "k").count() == 0
    with pytest.raises(GraphError):
        store.memory_update({}, {"schemas": none}, none)
    stored = spark.createDataFrame([], "corpus_id string, pos bigint, fact_id string")
    with pytest.raises(GraphError, match="RESOURCE_LIMIT"):
        store.memory_upsert(stored, spark.range(5000).selectExpr("'c' AS corpus_id", "string(id) AS fact_id", "int(id) AS _ord"), "fact_id")
