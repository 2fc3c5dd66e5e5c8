import duckdb
import numpy as np
import pytest

from graphloom.errors import GraphError
from graphloom.functions.scalar import cosine
from graphloom.operators import pagerank, retrieval, store_queries
from tests import oracle

V = "corpus_id string, id string, namespace string, values array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [("tie-b", [0.8, 0.6]), ("tie-a", [0.8, 0.6]), ("low", [0.1, 1.0]), ("high", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("huge", [1e308, 1e308]), ("short", [1.0]), ("none", None), ("opposite", [-1.0, 0.0])]
    return spark.createDataFrame([("c", i, "p", v) for i, v in rows] + [("d", "other", "p", [1.0, 0.0]), ("c", "else", "q", [1.0, 0.0])], V)


def test_vector_order_and_overflow(vectors):
    got = [(r["id"], round(r["score"], 6)) for r in retrieval.vector_search(vectors, "c", "p", [1.0, 0.0], 5).collect()]
    assert got == [("high", 1.0), ("tie-a", 0.8), ("tie-b", 0.8), ("huge", 0.707107), ("low", 0.099504)]
    assert retrieval.vector_search(vectors, "c", "p", [1.0, 0.0], 0).count() == 0
    assert retrieval.vector_search(vectors, "c", "p", [1.0, 0.0], 100, -1.0).count() == 9
    assert retrieval.vector_search(vectors, "none", "p", [1.0, 0.0], 5).count() == 0
    for bad in ([], [float("nan")], [1.0] * 5000):
        with pytest.raises(GraphError):
            retrieval.vector_search(vectors, "c", "p", bad)
    with pytest.raises(GraphError, match="INVALID_TOP_K"):
        retrieval.vector_search(vectors, "c", "p", [1.0], 10**6)


def test_cosine_kernel():
    rows = np.array([[3e-200, 4e-200], [1e200, 0], [0, 0]])
    assert cosine(rows, np.array([1.0, 0.0])) == pytest.approx([0.6, 1.0, 0.0])


def test_candidate_search(spark, vectors):
    usable = vectors.filter("id NOT IN ('short', 'none')")
    slots = [{"slot_id": "b", "namespace": "q", "query": [1.0, 0.0], "limit": 3}, {"slot_id": "a", "namespace": "p", "query": [0.0, 1.0], "limit": 2, "threshold": 0.5}]
    got = sorted(tuple(r) for r in retrieval.candidate_search(usable, "c", slots).select("slot_id", "rank", "id").collect())
    assert got == [("a", 1, "low"), ("a", 2, "huge"), ("b", 1, "else")]
    with pytest.raises(Exception, match="INTEGRITY"):
        retrieval.candidate_search(vectors, "c", slots).collect()
    items = spark.createDataFrame([("low", "x")], "id string, payload string")
    with pytest.raises(Exception, match="INTEGRITY"):
        retrieval.candidate_search(usable, "c", slots, items).collect()


def test_lexical(spark):
    df = spark.createDataFrame([("c", "b", "Aa aA"), ("c", "a", "aaaa"), ("c", "n", None), ("c", "e", ""), ("d", "z", "aa")], "corpus_id string, passage_id string, text string")
    assert [tuple(r) for r in retrieval.lexical_search(df, "c", " AA aa ").collect()] == [("a", 4), ("b", 4)]
    assert retrieval.lexical_search(df, "c", "").count() == 0


def test_fact_expand(spark):
    df = spark.createDataFrame([("f1", "X", "y"), ("f2", "x", "Z"), ("f3", "q", "q"), ("f4", "neg", "q"), ("f5", None, "x")], "fact_id string, head_entity string, tail_entity string")
    got = [tuple(r) for r in retrieval.fact_expand(df, {"x": 1.0, "z": 2.0, "neg": -1.0}, ["f9"], 0.5).collect()]
    assert got == [("f2", 1.0), ("f1", 0.5), ("f5", 0.5), ("f4", 0.0)]
    assert retrieval.fact_expand(df, {}).count() == 0


def model(edges, seeds, p, eps, n, hub):
    names = sorted({x for s, d, _ in edges for x in (s, d)})
    at = {x: i for i, x in enumerate(names)}
    out, deg = np.zeros(len(names)), np.zeros(len(names))
    for s, d, w in edges:
        out[at[s]] += w
        deg[at[s]] += 1
        deg[at[d]] += 1
    damp = np.array([1 / np.log2(deg[i] + 2) if x.startswith("schema:") and deg[i] > hub else 1.0 for i, x in enumerate(names)])
    jump = np.zeros(len(names))
    for k, v in seeds.items():
        if k in at:
            jump[at[k]] = v
    jump = jump / jump.sum() if jump.sum() > 0 else np.full(len(names), 1 / len(names))
    score = jump
    for i in range(1, n + 1):
        new = p * jump
        for s, d, w in edges:
            new[at[d]] += (1 - p) * score[at[s]] * w / out[at[s]] * damp[at[d]]
        delta, score = abs(new - score).sum(), new
        if delta < eps:
            break
    return {x: score[at[x]] for x in names if score[at[x]] > 0}, i


@pytest.mark.parametrize("seeds", [{"passage:1": 2.0, "passage:9": 5.0, "fact:2": 1.0}, {}, {"gone": 1.0}])
def test_pagerank_of_seeds(spark, seeds):
    rnd = np.random.default_rng(3)
    names = [f"{k}:{i}" for k in ("passage", "fact", "schema") for i in range(4)]
    edges = [(rnd.choice(names), "schema:0" if i % 4 == 0 else rnd.choice(names), float(rnd.integers(1, 5))) for i in range(60)]
    edges = [(str(s), str(d), w) for s, d, w in edges]
    df = spark.createDataFrame(edges, "source_node_id string, target_node_id string, weight double")
    want, steps = model(edges, seeds, 0.2, 1e-4, 50, 5)
    got = pagerank.personalised_pagerank(df, seeds, 0.2, 1e-4, 50, 5)
    assert (got.iterations, got.converged) == (steps, True)
    assert {r["node_id"]: r["score"] for r in got.scores.collect()} == pytest.approx(want)


def test_pagerank_fixed_iterations(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("c", "a", 1.0)]
    df = spark.createDataFrame(edges, "source_node_id string, target_node_id string, weight double")
    want, _ = model(edges, {"a": 1.0}, 0.15, -1.0, 3, 100)
    got = pagerank.personalised_pagerank(df, {"a": 1.0}, 0.15, None, 3, 100)
    assert got.iterations == 3 and got.l1_delta > 0 and {r["node_id"]: r["score"] for r in got.scores.collect()} == pytest.approx(want)


def test_pagerank_of_a_source_with_most_edges_and_many_rounds(spark):
    rnd = np.random.default_rng(5)
    edges = [("hub", f"n{i % 900}", 1.0 + i % 3) for i in range(5000)] + [(f"n{int(a)}", f"n{int(b)}", 1.0) for a, b in rnd.integers(0, 900, (3000, 2))] + [(f"n{i}", "hub", 1.0) for i in range(0, 900, 7)]
    df = spark.createDataFrame(edges, "source_node_id string, target_node_id string, weight double")
    want, steps = model(edges, {"n1": 1.0}, 0.15, 1e-5, 128, 100)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    got = pagerank.personalised_pagerank(df, {"n1": 1.0}, 0.15, 1e-5, 128, 100)
    assert steps > 20 and (got.iterations, got.converged) == (steps, True)
    assert {r["node_id"]: r["score"] for r in got.scores.collect()} == pytest.approx(want)
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def test_pagerank_result_is_hydrated_once(spark):
    df = spark.createDataFrame([("passage:1", "fact:1", 1.0), ("fact:1", "passage:1", 1.0)], "source_node_id string, target_node_id string, weight double")
    ranking = pagerank.personalised_pagerank(df, {"fact:1": 1.0})
    items = [("passage:1", "one"), ("fact:1", "two"), ("fact:9", "three")]
    stored = spark.createDataFrame(items, "node_id string, payload string")
    rows = pagerank.materialise(ranking, {"passage:": (5, stored), "fact:": (5, stored)}).collect()
    assert [(r["kind"], r["rank"], r["payload"]) for r in rows] == [("passage", 1, "one"), ("fact", 1, "two")]
    for wrong in (items[1:], items + items[:1]):
        with pytest.raises(Exception, match="INTEGRITY"):
            pagerank.materialise(ranking, {"passage:": (5, spark.createDataFrame(wrong, "node_id string, payload string"))}).collect()


def test_pagerank_result_keeps_nodes_with_no_item_or_several(spark):
    df = spark.createDataFrame([("passage:1", "fact:1", 1.0), ("fact:1", "passage:1", 1.0)], "source_node_id string, target_node_id string, weight double")
    ranking = pagerank.personalised_pagerank(df, {"fact:1": 1.0})
    stored = spark.createDataFrame([("fact:1", "two"), ("fact:1", "two"), ("fact:1", None), ("fact:9", "three")], "node_id string, payload string")
    rows = pagerank.materialise(ranking, {"passage:": (5, stored), "fact:": (5, stored)}, strict=False).collect()
    got = sorted(((r["kind"], r["rank"], r["payload"]) for r in rows), key=repr)
    assert got == [("fact", 1, "two"), ("fact", 1, "two"), ("fact", 1, None), ("passage", 1, None)]


def test_pagerank_query_equals_sql_where_documents_lack_or_repeat_ids(spark, small, tmp_path):
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * FROM '{small}/documents.parquet' WHERE doc_id % 2 = 0 UNION ALL SELECT * FROM '{small}/documents.parquet' WHERE doc_id % 8 = 0) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT * FROM '{small}/events.parquet' UNION ALL SELECT * FROM '{small}/events.parquet' WHERE event_id % 3 = 0) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    columns, got = oracle.rows(store_queries.ppr_converged(spark, str(tmp_path)))
    kind, payload, rank = (columns.index(x) for x in ("kind", "payload", "rank"))
    assert any(r[payload] is None for r in got)
    for k in ("passage", "fact"):
        ranks = [r[rank] for r in got if r[kind] == k]
        assert set(ranks) == set(range(1, 21)) and len(ranks) > 20
    assert (columns, got) == oracle.expected(oracle.connect(tmp_path), store_queries.SQL["ppr_converged"])


def test_pagerank_limits(spark):
    empty = spark.createDataFrame([], "source_node_id string, target_node_id string, weight double")
    none = pagerank.personalised_pagerank(empty, {"a": 1.0})
    assert none.converged and none.scores.count() == 0
    bad = spark.createDataFrame([("a", "b", -1.0)], "source_node_id string, target_node_id string, weight double")
    with pytest.raises(Exception, match="INTEGRITY"):
        pagerank.personalised_pagerank(bad, {})
    for open_end in [("a", None, 1.0), (None, "a", 1.0), ("a", "b", None)]:
        with pytest.raises(Exception, match="INTEGRITY"):
            pagerank.personalised_pagerank(spark.createDataFrame([open_end], bad.schema), {})
    with pytest.raises(GraphError, match="RESOURCE_LIMIT"):
        pagerank.personalised_pagerank(empty, {}, max_iterations=1000)
