import json

from graphloom.operators import nested, queries


def emit(spark, bodies, tags=tuple(nested.ARRAYS)):
    df = spark.createDataFrame([(f"s{i}", b, 1) for i, b in enumerate(bodies)], "snapshot_id string, body string, tag int")
    t = nested.tables(nested.emit(df, tags), tags)
    return {(r["snapshot_id"], r["passage_id"], tag, r["ord"], r["val"]) for tag in tags for r in t[tag].collect()}


P = {"passageId": "p", "metadata": {"sectionPath": ["a", None, "", {"title": "t", "x": 1}]}, "entityMentions": "one", "factIds": [{"factId": "f"}, {"no": 1}, ["g"], 5, True]}
WANT = {("p", "section_path", 0, "a"), ("p", "section_path", 2, ""), ("p", "section_path", 3, "t"), ("p", "entity_mentions", 0, "one"), ("p", "fact_ids", 0, "f"), ("p", "fact_ids", 3, "5"), ("p", "fact_ids", 4, "true")}


def test_shapes_of_bodies(spark):
    snap = {"passages": [P]}
    bodies = [json.dumps(b) for b in (snap, {"result": snap}, {"meta": 1, "snapshot": snap}, json.dumps(snap), {"result": json.dumps({"snapshot": snap})}, {"passages": {"p": {**P, "passageId": None}}})]
    got = emit(spark, bodies)
    for i in range(len(bodies)):
        assert {r[1:] for r in got if r[0] == f"s{i}"} == WANT, bodies[i]


def test_bodies_without_rows(spark):
    whole = json.dumps({"passages": [P]})
    assert emit(spark, [None, "", " ", "[]", "null", "7", whole[:-1], whole + "x", '{"passages": NaN}', "[" * 100_000, json.dumps({"passages": None}), json.dumps({"passages": [1, None, "x"]})]) == set()


def test_null_parts_and_unicode(spark):
    items = [{"passageId": "q", "metadata": None, "entityMentions": None, "factIds": []}, {"passageId": "u", "entityMentions": ["é", "😀", "x" * 100_000]}]
    body = json.dumps({"passages": items})
    assert emit(spark, [body]) == {("s0", "u", "entity_mentions", 0, "é"), ("s0", "u", "entity_mentions", 1, "😀"), ("s0", "u", "entity_mentions", 2, "x" * 100_000)}
    assert ("s0", "z", "fact_ids", 0, "�") in emit(spark, ['{"passages":[{"passageId":"z","factIds":["\\ud800"]}]}'])


def test_links_and_written_tables(spark, tmp_path):
    body = json.dumps({"corpusId": "c", "passages": [P, {"passageId": "p2"}], "facts": [{"factId": "f", "state": "active", "passageIds": ["p"]}]})
    df = spark.createDataFrame([("s", body), ("s", body)], "snapshot_id string, body string")
    t = nested.write_tables(nested.emit(df), str(tmp_path / "t"))
    assert t["passage"].count() == 2 and t["fact"].count() == 1
    parents = {r["pk"] for r in t["passage"].collect()}
    assert {r["parent_pk"] for r in t["fact_ids"].collect()} <= parents
    assert {r["parent_pk"] for r in t["passage"].collect()} == {r["pk"] for r in t["snapshot"].collect()}
    assert nested.emit(df.limit(0)).count() == 0


def test_registered_queries_write_and_read_each_tag(spark, small, monkeypatch):
    """On a whole table: through the written folder, with the rows that the stream holds."""
    paths, write = [], nested.write_tables
    monkeypatch.setattr(nested, "write_tables", lambda emitted, path: paths.append(path) or write(emitted, path))
    found, counts = queries.p4_found(spark, small), queries.p4_child_counts(spark, small)
    assert len(set(paths)) == 2
    want = {(sid, p["passage_id"], tag, p["ord"], p["val"]) for r in spark.read.parquet(f"{small}/raw_snapshots.parquet").collect() for tag, sid, _, _, p in nested.visit(r["snapshot_id"], r["body"], frozenset(nested.ARRAYS))}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) > 0
    assert {r["tag"] for r in counts.collect()} == set(nested.SCHEMAS)


def test_no_rows_to_write(spark, tmp_path):
    df = spark.createDataFrame([("s", None)], "snapshot_id string, body string")
    assert {t.count() for t in nested.write_tables(nested.emit(df), str(tmp_path / "t")).values()} == {0}
