import pytest
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.model import GRAPH_EDGES, GRAPH_NODES, number, tagged
from graphloom.plans.cypher import Graph, parse


@pytest.fixture(scope="module")
def graph(spark):
    empty = F.from_json(F.lit("{}"), GRAPH_NODES.split("properties ")[1])
    nodes = spark.createDataFrame([("n1", ["A"]), ("n10", ["A", "B"]), ("n2", ["B"])], "id string, labels array<string>").withColumn("properties", empty)
    edges = spark.createDataFrame([("e1", "n1", "n2", "T", 0.9), ("e2", "n2", "n2", "U", None)], "id string, `from` string, `to` string, edge_type string, w double")
    props = F.when(F.col("w").isNotNull(), F.create_map(F.lit("weight"), tagged(0.9))).otherwise(empty)
    return Graph(nodes, edges.withColumn("properties", props).drop("w"), next_id=11)


def rows(result):
    return [tuple(r) for r in result.df.collect()]


def ids(result):
    return [r["id"] for r in result.df.collect()]


def test_match(graph):
    assert sorted(ids(graph.query("MATCH (n) RETURN n"))) == ["n1", "n10", "n2"]
    assert ids(graph.query("MATCH (n:B) RETURN n ORDER BY n.id")) == ["n10", "n2"]  # bytes, not numbers
    assert ids(graph.query("MATCH (n) WHERE n.id = 'n2' RETURN n;")) == ["n2"]
    assert ids(graph.query("MATCH (n) RETURN n ORDER BY n.id SKIP 1 LIMIT 1")) == ["n10"]
    assert ids(graph.query("OPTIONAL MATCH (n:Z) RETURN n")) == []


def test_relationships(graph):
    assert sorted(rows(graph.query("MATCH (n)-[r]->(m) RETURN n,r,m"))) == [("n1", "e1", "n2"), ("n2", "e2", "n2")]
    assert sorted(rows(graph.query("MATCH (n)-[r]-(m) RETURN n,r,m"))) == [("n1", "e1", "n2"), ("n2", "e1", "n1"), ("n2", "e2", "n2"), ("n2", "e2", "n2")]
    # a missing weight counts 0; the filter comes before the outer test
    assert sorted(rows(graph.query("OPTIONAL MATCH (n)-[r]->(m) WHERE r.weight > 0.5 RETURN n,r,m"))) == [("n1", "e1", "n2"), ("n10", "NULL", "NULL"), ("n2", "NULL", "NULL")]
    assert rows(graph.query("MATCH (n)-[r:U]->(m) RETURN n,r,m", "extended")) == [("n2", "e2", "n2")]
    assert rows(graph.query("MATCH (n:A)-[r]->(m:B) RETURN n,r,m", "extended")) == [("n1", "e1", "n2")]


def test_dangling_edge_is_an_error(graph):
    broken = Graph(graph.nodes.filter("id <> 'n2'"), graph.edges)
    with pytest.raises(Exception, match="REFERENTIAL_INTEGRITY_VIOLATION"):
        broken.query("MATCH (n)-[r]->(m) RETURN n,r,m").df.collect()


def test_subqueries_and_unions(graph):
    assert ids(graph.query("MATCH (n) WHERE EXISTS { MATCH (m:Z) RETURN m } RETURN n")) == []
    assert len(ids(graph.query("MATCH (n) WHERE EXISTS { MATCH (m:A) RETURN m } RETURN n"))) == 3
    assert rows(graph.query("CALL { MATCH (n) RETURN n } RETURN count(*)")) == [(3,)]
    assert sorted(ids(graph.query("MATCH (n:A) RETURN n UNION MATCH (n:B) RETURN n"))) == ["n1", "n10", "n2"]
    assert len(ids(graph.query("MATCH (n:A) RETURN n UNION ALL MATCH (n:B) RETURN n"))) == 4


def test_literals(graph):
    assert rows(graph.query("RETURN CASE WHEN 1 = 1 THEN 'y' ELSE 'n' END")) == [("y",)]
    assert rows(graph.query("RETURN CASE WHEN 1 = 1.0 THEN 'y' ELSE 'n' END")) == [("n",)]
    assert rows(graph.query("UNWIND [] AS x RETURN sum(x)")) == [(0.0,)]
    assert rows(graph.query("UNWIND [inf, 2] AS x RETURN max(x)")) == [(0.0,)]
    assert rows(graph.query("UNWIND [NaN] AS x RETURN min(x)")) == [(0.0,)]
    assert rows(graph.query("UNWIND ['a,b', 1] AS x RETURN count(x)")) == [(2,)]
    assert rows(graph.query("CALL apoc.text.join([1.0, 2.5, false], '/')")) == [("1/2.5/false",)]
    assert rows(graph.query("CALL apoc.coll.toSet([1, 1.0, 1])")) == [(["1", "1"],)]
    with pytest.raises(GraphError, match="INVALID_ARGUMENT"):
        graph.query("UNWIND ['a'] AS x RETURN x")


@pytest.mark.parametrize(
    "query, clause",
    [
        ("FOREACH (x IN [1] | CREATE (n:A))", "FOREACH"),
        ("MATCH p = shortestPath((a)-[r]->(b)) RETURN p", "shortestPath"),
        ("MATCH (n)-[r*1..2]->(m) RETURN n,r,m", "variable-length path"),
        ("RETURN [(n)-[r]->(m) | n]", "pattern comprehension"),
        ("LOAD CSV FROM 'x' AS row RETURN row", "LOAD CSV"),
        ("MATCH (n) RETURN n ORDER BY n.id DESC", "ORDER BY DESC"),
        ("MATCH (n) RETURN n UNION MATCH (n) RETURN n UNION ALL MATCH (n) RETURN n", "UNION mixed with UNION ALL"),
        ("MATCH (n)-[r:T]->(m) RETURN n,r,m", "[r:T]"),
        ("CALL apoc.other()", "apoc.other"),
        ("DROP x", "DROP"),
        ("MATCH (n) WHERE n.id > 'a' RETURN n", "WHERE"),
    ],
)
def test_unsupported(query, clause):
    for text in (query, "CYPHER neo4j-compat " + query):
        with pytest.raises(GraphError) as e:
            parse(text)
        assert e.value.code == "UNSUPPORTED_FEATURE" and e.value.details["unsupported_clause"] == clause


def test_clause_names_inside_strings_are_text(graph):
    assert ids(graph.query("MATCH (n) WHERE n.id = 'FOREACH' RETURN n")) == []


def test_scope_and_kinds(graph):
    for text in ("MATCH (n) WITH n AS x RETURN n", "MATCH (n) RETURN m"):
        with pytest.raises(GraphError, match="SCOPE_ERROR"):
            graph.query(text)
    for text in ("CREATE (n:A) UNION MATCH (n) RETURN n", "CALL { CREATE (n:A) } RETURN count(*)", "MATCH (n) RETURN n UNION MATCH (n)-[r]->(m) RETURN n,r,m"):
        with pytest.raises(GraphError, match="UNSUPPORTED_FEATURE"):
            graph.query(text)


def test_writes(graph):
    made = graph.query("CREATE (x:C {name: 'a', rank: 3})")
    got = {r["id"]: r for r in made.nodes.collect()}
    assert got["n11"]["labels"] == ["C"] and got["n11"]["properties"]["rank"]["i"] == 3
    again = Graph(made.nodes, made.edges).query("MERGE (x:C {rank: 3}) ON MATCH SET name = 'b'")
    assert {r["properties"]["name"]["s"] for r in again.nodes.collect() if r["id"] == "n11"} == {"b"}
    assert graph.query("MERGE (x:C {rank: 3}) ON CREATE SET name = 'new'").nodes.count() == 4
    assert Graph(made.nodes, made.edges).query("MERGE (x:C {rank: 3.0})").nodes.count() == 5  # 3 is not 3.0
    gone = Graph(made.nodes, made.edges).query("REMOVE NODE n11 rank")
    assert "rank" not in {r["id"]: r for r in gone.nodes.collect()}["n11"]["properties"]
    with pytest.raises(GraphError, match="REFERENTIAL"):
        graph.query("SET NODE n99 a = 1")
    with pytest.raises(GraphError, match="REFERENTIAL"):
        graph.query("DELETE NODE n1")
    cut = graph.query("DELETE NODE n1 DETACH")
    assert cut.nodes.count() == 2 and cut.edges.count() == 1
    assert graph.query("DELETE NODE n99").nodes.count() == 3
    renamed = graph.query("CALL apoc.refactor.rename.label('A', 'Z')")
    assert rows(renamed) == [(2,)] and sorted(sum((r["labels"] for r in renamed.nodes.collect()), [])) == ["B", "B", "Z", "Z"]


def test_weights(spark):
    df = spark.range(1).select(F.create_map(F.lit("a"), tagged(2), F.lit("b"), tagged("x")).alias("p"))
    assert tuple(df.select(*[number(F.col("p"), k) for k in ("a", "b", "c")]).first()) == (2.0, 0.0, 0.0)
    assert GRAPH_EDGES.count("string") >= 4


def test_page_is_taken_before_its_ends_are_checked(spark):
    nodes = spark.createDataFrame([("a", ["A"]), ("b", ["B"])], "id string, labels array<string>").withColumn("properties", F.from_json(F.lit("{}"), GRAPH_NODES.split("properties ")[1]))
    edges = spark.createDataFrame([("e1", "a", "b", "T"), ("e2", "b", "a", "T"), ("e3", "c", "a", "T")], "id string, from string, to string, edge_type string").withColumn("properties", F.from_json(F.lit("{}"), GRAPH_NODES.split("properties ")[1]))
    graph = Graph(nodes, edges)
    got = graph.query("MATCH (n)-[r]->(m) RETURN n,r,m ORDER BY n.id LIMIT 2").df.collect()
    assert [tuple(r) for r in got] == [("a", "e1", "b"), ("b", "e2", "a")]
    for text in ("MATCH (n)-[r]->(m) RETURN n,r,m ORDER BY n.id LIMIT 3", "MATCH (n)-[r]->(m) RETURN n,r,m", "MATCH (n)-[r]->(m:A) RETURN n,r,m"):
        with pytest.raises(Exception, match="REFERENTIAL_INTEGRITY_VIOLATION"):
            graph.query(text).df.collect()
