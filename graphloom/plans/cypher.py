"""Cypher subset: text -> tokens -> small plan -> DataFrames.

Everything is checked before a DataFrame is built, so a bad query touches no data.
The compatible dialect accepts the documented clauses; ``extended`` adds node
labels and a relationship type inside relationship patterns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphError, invalid, syntax, unsupported
from graphloom.model import GRAPH_NODES, number, tagged
from graphloom.session import checkpoint

DIALECTS = {"opencypher9": "opencypher9", "neo4j-compat": "neo4j-compat", "neo4j_compat": "neo4j-compat", "extended": "extended"}
AGGREGATES = ("count", "collect", "sum", "avg", "min", "max")
_TOKEN = re.compile(r"\s*(?:('(?:[^'])*')|(-?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+))|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(<-|->|<=|>=|<>|.))", re.S)


@dataclass(frozen=True)
class Token:
    kind: str  # str, num, name, sym
    text: str
    start: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text


def tokenize(query: str) -> list[Token]:
    out, at = [], 0
    query = query.rstrip().rstrip(";")
    while at < len(query):
        m = _TOKEN.match(query, at)
        if m is None or not m[m.lastindex or 0]:
            break
        kind = ("", "str", "num", "name", "sym")[m.lastindex]
        if m[m.lastindex] == "'":
            raise syntax("unterminated string")
        out.append(Token(kind, m[m.lastindex], m.start(m.lastindex)))
        at = m.end()
    return out


#: Up to so many rows of a page are taken first and checked then.
PAGE_ROWS = 10_000


@dataclass
class Page:
    order: bool = False
    skip: int | None = None
    limit: int | None = None


@dataclass
class Match:
    variable: str
    label: str | None = None
    node_id: str | None = None
    exists: object | None = None
    column: str = "id"
    page: Page = field(default_factory=Page)


@dataclass
class Relation:
    directed: bool
    optional: bool
    weight: float | None = None
    edge_type: str | None = None
    labels: tuple[str | None, str | None] = (None, None)
    page: Page = field(default_factory=Page)


@dataclass
class Case:
    value: object


@dataclass
class Unwind:
    values: list
    function: str | None


@dataclass
class Union:
    parts: list
    all: bool


@dataclass
class CallQuery:
    inner: object
    count: bool


@dataclass
class Procedure:
    name: str
    args: list


@dataclass
class Write:
    kind: str
    label: str | None = None
    properties: dict = field(default_factory=dict)
    on_create: dict = field(default_factory=dict)
    on_match: dict = field(default_factory=dict)
    node_id: str | None = None
    key: str | None = None
    detach: bool = False


class Parser:
    def __init__(self, tokens: list[Token], dialect: str):
        self.tokens, self.at, self.dialect = tokens, 0, dialect

    # -- tokens
    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k].word if self.at + k < len(self.tokens) else ""

    def next(self) -> Token:
        if self.at >= len(self.tokens):
            raise syntax("unexpected end of query")
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, *words: str) -> bool:
        for k, w in enumerate(words):
            if self.peek(k) != w:
                return False
        self.at += len(words)
        return True

    def need(self, word: str) -> None:
        if not self.take(word):
            raise syntax(f"expected {word} before {self.peek() or 'the end'}")

    def name(self) -> str:
        t = self.next()
        if t.kind != "name":
            raise syntax(f"expected a name, found {t.text}")
        return t.text

    # -- literals
    def literal(self) -> object:
        t = self.next()
        if t.kind == "str":
            return t.text[1:-1]
        if t.word in ("TRUE", "FALSE"):
            return t.word == "TRUE"
        if t.kind == "num" and re.fullmatch(r"-?\d+", t.text) and -(1 << 63) <= int(t.text) < 1 << 63:
            return int(t.text)
        try:
            return float(t.text)
        except ValueError:
            raise syntax(f"not a literal: {t.text}") from None

    def list(self) -> list:
        self.need("[")
        out = []
        while not self.take("]"):
            if out:
                self.need(",")
            out.append(self.literal())
        return out

    def assignments(self, end: str | None) -> dict:
        """``k: v`` or ``k = v``, optionally ``n.k = v``, separated by commas."""
        out = {}
        while end is None or not self.take(end):
            if out:
                if not self.take(","):
                    break
            key = self.name().split(".")[-1]
            if not self.take(":"):
                self.need("=")
            out[key] = self.literal()
            if end is None and self.peek() != ",":
                break
        return out

    # -- queries
    def query(self, stop: str = "") -> object:
        parts, kinds = [self.single(stop)], set()
        while self.take("UNION"):
            kinds.add("ALL" if self.take("ALL") else "DISTINCT")
            parts.append(self.single(stop))
        if len(kinds) > 1:
            raise unsupported("UNION mixed with UNION ALL")
        if self.peek() != stop:
            raise unsupported(self.peek())
        return parts[0] if len(parts) == 1 else Union(parts, kinds == {"ALL"})

    def single(self, stop: str) -> object:
        first = self.peek()
        if first == "RETURN":
            return self.case()
        if first == "MATCH":
            self.at += 1
            return self.match(optional=False)
        if first == "OPTIONAL":
            self.at += 1
            self.need("MATCH")
            return self.match(optional=True)
        if first == "CALL":
            self.at += 1
            if self.take("{"):
                inner = self.query("}")
                self.need("}")
                self.need("RETURN")
                if self.take("*"):
                    return CallQuery(inner, False)
                if self.take("COUNT", "(", "*", ")"):
                    return CallQuery(inner, True)
                raise unsupported("CALL {")
            return self.procedure()
        if first == "UNWIND":
            return self.unwind()
        if first in ("CREATE", "MERGE", "SET", "REMOVE", "DELETE"):
            return self.write()
        raise unsupported(first or "empty query")

    def case(self) -> Case:
        self.need("RETURN")
        if not self.take("CASE"):
            raise unsupported("RETURN")
        self.need("WHEN")
        a = self.literal()
        self.need("=")
        b = self.literal()
        self.need("THEN")
        x = self.literal()
        if not self.take("ELSE"):
            raise syntax("CASE needs ELSE")
        y = self.literal()
        self.need("END")
        return Case(x if type(a) is type(b) and a == b else y)

    def node(self) -> tuple[str, str | None]:
        self.need("(")
        variable, label = self.name(), None
        if self.take(":"):
            label = self.name()
        if not self.take(")"):
            raise unsupported(self.peek())
        return variable, label

    def match(self, optional: bool) -> object:
        variable, label = self.node()
        if self.peek() in ("-", "<-"):
            return self.relation(optional, variable, label)
        plan = Match(variable, label)
        if self.take("WHERE"):
            if self.take("EXISTS", "{"):
                plan.exists = self.query("}")
                self.need("}")
            else:
                if self.name() != f"{variable}.id" or not self.take("="):
                    raise unsupported("WHERE")
                value = self.literal()
                if not isinstance(value, str):
                    raise unsupported("WHERE")
                plan.node_id = value
        shown = variable
        if self.take("WITH"):
            if self.name() != variable:
                raise GraphError("SCOPE_ERROR", f"WITH must project {variable}")
            if self.take("AS"):
                shown = self.name()
        self.need("RETURN")
        if self.name() != shown:
            raise GraphError("SCOPE_ERROR", f"only {shown} is in scope")
        plan.page = self.page(shown)
        return plan

    def relation(self, optional: bool, source: str, source_label: str | None) -> Relation:
        if not self.take("-"):
            raise unsupported("<-[")
        if not self.take("["):
            raise unsupported("()-->()")
        edge, kind = self.name(), None
        if self.take("*"):
            raise unsupported("variable-length path")
        if self.take(":"):
            kind = self.name()
        if self.take("*"):
            raise unsupported("variable-length path")
        self.need("]")
        directed = self.take("->")
        if not directed:
            self.need("-")
        target, target_label = self.node()
        if self.dialect != "extended":
            if kind is not None:
                raise unsupported(f"[{edge}:{kind}]")
            source_label = target_label = None  # node labels in relationship patterns do not filter
        plan = Relation(directed, optional, edge_type=kind, labels=(source_label, target_label))
        if self.take("WHERE"):
            if self.name() != f"{edge}.weight" or not self.take(">"):
                raise unsupported("WHERE")
            value = self.literal()
            if isinstance(value, (str, bool)):
                raise unsupported("WHERE")
            plan.weight = float(value)
        names = [source, edge, target]
        for clause in ("WITH", "RETURN"):
            if self.take(clause):
                for i, n in enumerate(names):
                    if i:
                        self.need(",")
                    if self.name() != n:
                        raise unsupported(clause)
            elif clause == "RETURN":
                raise syntax("RETURN is missing")
        plan.page = self.page(source)
        return plan

    def page(self, variable: str) -> Page:
        page = Page()
        if self.take("ORDER", "BY"):
            if self.name() != f"{variable}.id":
                raise unsupported("ORDER BY")
            self.take("ASC")
            if self.peek() == "DESC":
                raise unsupported("ORDER BY DESC")
            page.order = True
        for word in ("SKIP", "LIMIT"):
            if self.take(word):
                n = self.literal()
                if type(n) is not int or n < 0:
                    raise syntax(f"{word} needs a count")
                setattr(page, word.lower(), n)
        return page

    def unwind(self) -> Unwind:
        self.need("UNWIND")
        values = self.list()
        self.need("AS")
        name = self.name()
        self.need("RETURN")
        if self.peek() == name.upper() and self.peek(1) != "(":
            self.at += 1
            function = None
        else:
            function = self.name().lower()
            if function not in AGGREGATES:
                raise unsupported(function)
            self.need("(")
            if self.name() != name:
                raise GraphError("SCOPE_ERROR", f"only {name} is in scope")
            self.need(")")
        numeric = all(type(v) in (int, float) for v in values)
        if function not in ("count", "collect") and not numeric:
            raise invalid("numbers expected")
        return Unwind(values, function)

    def procedure(self) -> Procedure:
        name = self.name()
        if name not in PROCEDURES:
            raise GraphError("UNSUPPORTED_FEATURE", f"procedure {name} is not allowed", unsupported_clause=name)
        self.need("(")
        args: list = []
        while not self.take(")"):
            if args:
                self.need(",")
            args.append(self.list() if self.peek() == "[" else self.literal())
        return Procedure(name, args)

    def write(self) -> Write:
        kind = self.next().word
        if kind in ("CREATE", "MERGE"):
            self.need("(")
            self.name()
            if not self.take(":"):
                raise syntax("a label is needed")
            plan = Write(kind.lower(), label=self.name())
            if self.take("{"):
                plan.properties = self.assignments("}")
            self.need(")")
            while kind == "MERGE" and self.take("ON"):
                where = self.next().word
                self.need("SET")
                if where not in ("CREATE", "MATCH"):
                    raise syntax("ON CREATE or ON MATCH expected")
                setattr(plan, f"on_{where.lower()}", self.assignments(None))
            return plan
        self.need("NODE")
        plan = Write(kind.lower(), node_id=str(self.literal()) if self.tokens[self.at : self.at + 1] and self.tokens[self.at].kind == "str" else self.name())
        if kind == "SET":
            plan.properties = self.assignments(None)
        elif kind == "REMOVE":
            plan.key = self.name().split(".")[-1]
        else:
            plan.detach = self.take("DETACH")
        return plan


PROCEDURES = ("apoc.meta.schema", "apoc.coll.toSet", "apoc.text.join", "apoc.refactor.rename.label")


def parse(query: str, dialect: str | None = None) -> object:
    """Plan of a query; the dialect argument wins over a ``CYPHER <dialect>`` prefix."""
    head = re.match(r"\s*CYPHER\s+([\w-]+)\s+", query, re.I)
    if head:
        query = query[head.end() :]
    chosen = DIALECTS.get((dialect or (head[1] if head else "opencypher9")).lower())
    if chosen is None:
        raise invalid(f"unknown dialect {dialect or head[1]}")
    tokens = tokenize(query)
    words = [t.word for t in tokens if t.kind != "str"]
    for clause, shown in (("SHORTESTPATH", "shortestPath"), ("FOREACH", "FOREACH")):
        if clause in words:
            raise unsupported(shown)
    for a, b in zip(words, words[1:]):
        if (a, b) == ("LOAD", "CSV"):
            raise unsupported("LOAD CSV")
        if a == "[" and b == "(":
            raise unsupported("pattern comprehension")
    return Parser(tokens, chosen).query()


@dataclass
class Result:
    """``kind`` is ``nodes`` (id, labels, properties), ``table`` or ``ack``; ``nodes``/``edges`` are the store afterwards."""

    kind: str
    df: DataFrame | None
    nodes: DataFrame
    edges: DataFrame


class Graph:
    """A property graph of two DataFrames; queries return results, writes return a new graph in the result."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, next_id: int = 1):
        self.nodes, self.edges, self.next_id = nodes, edges, next_id
        self.spark = nodes.sparkSession

    def query(self, text: str, dialect: str | None = None) -> Result:
        plan = parse(text, dialect)
        self._kinds(plan)
        return self._run(plan)

    # -- checks before execution
    def _kinds(self, plan: object) -> str:
        if isinstance(plan, Union):
            kinds = {self._kinds(p) for p in plan.parts}
            if "ack" in kinds or len(kinds) > 1:
                raise unsupported("UNION")
            return kinds.pop()
        if isinstance(plan, CallQuery):
            inner = self._kinds(plan.inner)
            if inner == "ack":
                raise unsupported("CALL {")
            return "table" if plan.count else inner
        if isinstance(plan, Match):
            if plan.exists is not None and self._kinds(plan.exists) == "ack":
                raise unsupported("EXISTS {")
            return "nodes"
        return "ack" if isinstance(plan, Write) else "table"

    # -- execution
    def _run(self, plan: object) -> Result:
        kind, df, nodes, edges = "table", None, self.nodes, self.edges
        if isinstance(plan, Match):
            kind, df = "nodes", self._match(plan)
        elif isinstance(plan, Relation):
            df = self._relation(plan)
        elif isinstance(plan, Case):
            df = self.spark.range(1).select(F.lit(plan.value).alias("case"))
        elif isinstance(plan, Unwind):
            df = self._unwind(plan)
        elif isinstance(plan, Union):
            kind, df = self._union(plan)
        elif isinstance(plan, CallQuery):
            inner = self._run(plan.inner)
            kind, df = ("table", inner.df.agg(F.count(F.lit(1)).alias("count"))) if plan.count else (inner.kind, inner.df)
        elif isinstance(plan, Procedure):
            df, nodes = self._procedure(plan)
        elif isinstance(plan, Write):
            kind = "ack"
            nodes, edges = self._write(plan)
        return Result(kind, df, nodes, edges)

    def _page(self, df: DataFrame, page: Page, *order: str) -> DataFrame:
        if page.order or page.skip or page.limit is not None:
            df = df.orderBy(*order)
        if page.skip:
            df = df.offset(page.skip)
        return df if page.limit is None else df.limit(page.limit)

    def _match(self, plan: Match) -> DataFrame:
        df = self.nodes
        if plan.label is not None:
            df = df.filter(F.array_contains("labels", plan.label))
        if plan.node_id is not None:
            df = df.filter(F.col("id") == plan.node_id)
        if plan.exists is not None:
            # uncorrelated: any row of the inner query keeps all rows of the outer one
            probe = self._run(plan.exists).df.limit(1).select(F.lit(1).alias("_one"))
            df = df.withColumn("_one", F.lit(1)).join(F.broadcast(probe), "_one", "left_semi").drop("_one")
        return self._page(df, plan.page, "id")

    def _relation(self, plan: Relation) -> DataFrame:
        e = self.edges
        if plan.weight is not None:
            e = e.filter(number(F.col("properties"), "weight") > plan.weight)
        if plan.edge_type is not None:
            e = e.filter(F.col("edge_type") == plan.edge_type)
        e = e.select(F.col("id").alias("r"), F.col("from").alias("n"), F.col("to").alias("m"))
        if not any(plan.labels) and not plan.optional and plan.page.limit is not None and plan.page.limit <= PAGE_ROWS:
            return self._few(self._page(self._both(e.select("n", "r", "m"), plan), plan.page, "n", "r", "m"))
        ends = self.nodes.select("id", "labels")
        for column, label in (("n", plan.labels[0]), ("m", plan.labels[1])):
            # a missing endpoint is an error, raised in the row that has it
            side = ends.select(F.col("id").alias(column), F.lit(True).alias("_there"), *([F.array_contains("labels", label).alias("_ok")] if label else []))
            e = e.join(side, column, "left")
            there = F.when(F.col("_there"), F.col(column)).otherwise(F.raise_error(F.lit("REFERENTIAL_INTEGRITY_VIOLATION: missing edge endpoint")).cast("string"))
            e = (e.filter(F.coalesce("_ok", F.col("_there").isNull())) if label else e).withColumn(column, there).drop("_there", "_ok")
        rows = self._both(e.select("n", "r", "m"), plan)
        if plan.optional:
            matched = rows.select(F.col("n").alias("id")).distinct()
            alone = self.nodes.select("id").join(matched, "id", "left_anti")
            rows = rows.unionByName(alone.select(F.col("id").alias("n"), F.lit("NULL").alias("r"), F.lit("NULL").alias("m")))
        return self._page(rows, plan.page, "n", "r", "m")

    @staticmethod
    def _both(rows: DataFrame, plan: Relation) -> DataFrame:
        """Rows in both directions, if the pattern has none."""
        if plan.directed:
            return rows
        return rows.withColumn("x", F.explode(F.array(F.struct("n", "r", "m"), F.struct(F.col("m").alias("n"), "r", F.col("n").alias("m"))))).select("x.*")

    def _few(self, rows: DataFrame) -> DataFrame:
        """At most ``PAGE_ROWS`` rows in order; a missing endpoint among them is an error. The nodes are not shuffled."""
        rows = checkpoint(rows)
        ids = rows.select(F.explode(F.array("n", "m")).alias("id")).distinct()
        known = self.nodes.select("id").join(F.broadcast(ids), "id", "left_semi").distinct()
        for column in ("n", "m"):
            rows = rows.join(F.broadcast(known.select(F.col("id").alias(column), F.lit(True).alias("_there"))), column, "left")
            there = F.when(F.col("_there"), F.col(column)).otherwise(F.raise_error(F.lit("REFERENTIAL_INTEGRITY_VIOLATION: missing edge endpoint")).cast("string"))
            rows = rows.withColumn(column, there).drop("_there")
        return rows.select("n", "r", "m").orderBy("n", "r", "m")

    def _unwind(self, plan: Unwind) -> DataFrame:
        one = self.spark.range(1)
        if plan.function in ("count", "collect"):
            items = F.array(*[F.to_json(F.struct(F.lit(v).alias("v"))) for v in plan.values]) if plan.values else F.array().cast("array<string>")
            if plan.function == "count":
                return one.select(F.size(items).cast("bigint").alias("count"))
            same = len({type(v) for v in plan.values}) <= 1
            return one.select((F.array(*map(F.lit, plan.values)) if same else F.transform(items, lambda x: F.get_json_object(x, "$.v"))).alias("collect"))
        x = one.select(F.explode(F.array(*[F.lit(float(v)) for v in plan.values]).cast("array<double>")).alias("x"))
        if plan.function is None:
            if all(type(v) is int for v in plan.values):
                x = x.select(F.col("x").cast("bigint").alias("x"))
            return x
        if plan.function in ("sum", "avg"):
            return x.agg(F.coalesce(getattr(F, plan.function)("x"), F.lit(0.0)).alias(plan.function))
        finite = F.when(~F.isnan("x"), F.col("x"))
        extreme = x.agg(getattr(F, plan.function)(finite).alias("e"))
        return extreme.select(F.when(F.col("e").isNull() | (F.abs("e") == float("inf")), 0.0).otherwise(F.col("e")).alias(plan.function))

    def _union(self, plan: Union) -> tuple[str, DataFrame]:
        results = [self._run(p) for p in plan.parts]
        first = results[0]
        for other in results[1:]:
            if other.df.columns != first.df.columns:
                raise invalid("UNION needs the same columns in each part")
        df = first.df
        for other in results[1:]:
            df = df.union(other.df)
        if not plan.all:
            df = df.dropDuplicates(["id"]) if first.kind == "nodes" else df.distinct()
        return first.kind, df

    def _procedure(self, plan: Procedure) -> tuple[DataFrame, DataFrame]:
        one, args = self.spark.range(1), plan.args
        if plan.name == "apoc.meta.schema":
            counts = self.nodes.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(self.edges.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
            return counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("b"), F.lit(0)).alias("relationships")), self.nodes
        if plan.name == "apoc.coll.toSet":
            if len(args) != 1 or not isinstance(args[0], list):
                raise invalid("toSet takes one list")
            distinct = list(dict.fromkeys((type(v), v) for v in args[0]))
            return one.select(F.array(*[F.lit(show(v) if len({t for t, _ in distinct}) > 1 else v) for _, v in distinct]).alias("values")), self.nodes
        if plan.name == "apoc.text.join":
            if len(args) != 2 or not isinstance(args[0], list):
                raise invalid("join takes a list and a separator")
            if not isinstance(args[1], str):
                raise invalid("the separator is a string")
            return one.select(F.array_join(F.array(*[F.lit(show(v)) for v in args[0]]).cast("array<string>"), args[1]).alias("value")), self.nodes
        if len(args) != 2 or not all(isinstance(a, str) and a for a in args):
            raise invalid("a label is renamed from one name to another")
        old, new = args
        hit = self.nodes.filter(F.array_contains("labels", old)).agg(F.count(F.lit(1)).alias("updatedNodeCount"))
        renamed = F.transform("labels", lambda x: F.when(x == old, F.lit(new)).otherwise(x))
        return hit, self.nodes.withColumn("labels", renamed)

    def _write(self, plan: Write) -> tuple[DataFrame, DataFrame]:
        nodes, edges = self.nodes, self.edges

        def put(column, values: dict):
            if not values:
                return column
            new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), tagged(v))])
            return F.map_concat(F.map_filter(column, lambda k, _: ~k.isin(list(values))), new)

        def fresh(values: dict) -> DataFrame:
            empty = F.from_json(F.lit("{}"), GRAPH_NODES.split("properties ")[1])
            return self.spark.range(1).select(F.lit(f"n{self.next_id}").alias("id"), F.array(F.lit(plan.label)).alias("labels"), put(empty, values).alias("properties"))

        if plan.kind == "create":
            return nodes.unionByName(fresh(plan.properties)), edges
        if plan.kind == "merge":
            match = F.array_contains("labels", plan.label)
            for k, v in plan.properties.items():
                match = match & F.coalesce(F.col("properties")[k] == tagged(v), F.lit(False))
            hit = nodes.filter(match).agg(F.min("id").alias("id")).first()["id"]  # the least id, so that the outcome is certain
            if hit is None:
                return nodes.unionByName(fresh(plan.properties | plan.on_create)), edges
            return nodes.withColumn("properties", F.when(F.col("id") == hit, put(F.col("properties"), plan.on_match)).otherwise(F.col("properties"))), edges
        there = bool(nodes.filter(F.col("id") == plan.node_id).take(1))
        if plan.kind == "delete":
            incident = (F.col("from") == plan.node_id) | (F.col("to") == plan.node_id)
            if there and not plan.detach and edges.filter(incident).take(1):
                raise GraphError("REFERENTIAL_INTEGRITY_VIOLATION", f"node {plan.node_id} has relationships")
            return (nodes.filter(F.col("id") != plan.node_id), edges.filter(~incident)) if there else (nodes, edges)
        if not there:
            raise GraphError("REFERENTIAL_INTEGRITY_VIOLATION", f"no node {plan.node_id}")
        new = put(F.col("properties"), plan.properties) if plan.kind == "set" else F.map_filter("properties", lambda k, _: k != plan.key)
        return nodes.withColumn("properties", F.when(F.col("id") == plan.node_id, new).otherwise(F.col("properties"))), edges


def show(value: object) -> str:
    """Text of a literal: whole doubles without a fraction, booleans in lower case."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e16 else repr(value)
    return str(value)
