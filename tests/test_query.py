"""The query language over a small graph made by hand."""

import json

import pytest

from shelfgraph.operators.fold import build
from shelfgraph.plans.compiler import run_query
from shelfgraph.plans.syntax import parse, tokenize
from shelfgraph.schema import GraphError
from shelfgraph.sources.pages import statement_log


@pytest.fixture(scope="module")
def graph(spark):
    """Kitchen ware of three makers, two offers that products share, and one category."""
    products = {
        "k1": ("Copper Kettle", {"weight": 1450, "maker": "Aldous", "boxed": True, "code": "0077", "tags": ["hot", 2]}),
        "k2": ("Birch Spoon Set", {"weight": 210, "maker": "Ravn", "boxed": True, "mix": 1}),
        "k3": ("Copper Ladle Long", {"weight": 330, "maker": "Aldous", "boxed": False, "mix": 1.0}),
        "k4": ("Slate Board", {"maker": "Ravn", "code": "913"}),
        "k5": ("Iron Trivet", {"weight": 1450, "maker": "Holt"}),
        "k6": ("Linen Apron Long", {"weight": 330, "maker": "Ravn", "boxed": True}),
    }
    log = [("node", "Product", i, n, json.dumps(p)) for i, (n, p) in products.items()]
    log += [("node", "Offer", o, "", json.dumps({"amount": a})) for o, a in (("o1", 35), ("o2", 20))]
    log += [("node", "Category", "c1", "Kitchen", "{}")]
    log += [("edge", p, "Offers", o) for p, o in (("k1", "o1"), ("k1", "o2"), ("k5", "o2"))]
    log += [("edge", p, "Category", "c1") for p in ("k2", "k4", "k6")]
    return build(statement_log(spark, log))


ALL = {"Copper Kettle", "Birch Spoon Set", "Copper Ladle Long", "Slate Board", "Iron Trivet", "Linen Apron Long"}
LIGHT = {"Birch Spoon Set", "Copper Ladle Long", "Linen Apron Long"}


def names(graph, where, rest="RETURN p.name AS n"):
    return [r[0] for r in run_query(graph, f"MATCH (p:Product) {where} {rest}", ordered=True).collect()]


@pytest.mark.parametrize(
    "where, expected",
    [
        ("WHERE p.weight > 300", ALL - {"Birch Spoon Set", "Slate Board"}),
        ("WHERE NOT p.weight > 300", {"Birch Spoon Set", "Slate Board"}),  # null is false, so NOT is true
        ("WHERE NOT p.nothing = 1", ALL),
        ("WHERE p.nothing <> 7", set()),
        ("WHERE p.maker <> 7", ALL),
        ("WHERE p.code = '0077'", {"Copper Kettle"}),
        ("WHERE p.code = 913", {"Slate Board"}),
        ("WHERE p.code = '913'", set()),
        ("WHERE p.weight IS NULL", {"Slate Board"}),
        ("WHERE p.weight IS NOT NULL AND NOT p.boxed", {"Copper Ladle Long", "Iron Trivet"}),
        ("WHERE (p.maker = 'Holt') IS NULL AND p.boxed", {"Copper Kettle", "Birch Spoon Set", "Linen Apron Long"}),
        ("WHERE p.name FUZZY 'Ladlx'", {"Copper Ladle Long", "Slate Board"}),
        ("WHERE p.name FUZZY 'v'", {"Iron Trivet"}),
        ("WHERE p.name STARTS WITH 'COPPER' AND p.name ENDS WITH 'long'", {"Copper Ladle Long"}),
        ("WHERE p.name =~ 'n.*g' AND p.boxed", {"Linen Apron Long"}),
        ("WHERE p.weight IN [210, 'x', true]", {"Birch Spoon Set"}),
        ("WHERE p.weight > -1 AND p.weight < 400", LIGHT),
        ("WHERE p.kind = 'Product' AND q.x = 1", set()),
    ],
)
def test_where(graph, where, expected):
    assert set(names(graph, where)) == expected


def test_order_and_limits(graph):
    assert names(graph, "WHERE p.weight > 0", "RETURN p.name AS n ORDER BY p.weight SKIP 1 LIMIT 3") == ["Copper Ladle Long", "Linen Apron Long", "Copper Kettle"]
    assert names(graph, "", "RETURN p.name AS n ORDER BY p.weight DESC SKIP 1 LIMIT 2") == ["Copper Kettle", "Iron Trivet"]  # behind the null
    assert names(graph, "WHERE p.name FUZZY 'Copper' OR p.name FUZZY 'Long'", "RETURN p.name AS n LIMIT 1") == ["Copper Ladle Long"]
    assert names(graph, "", "RETURN DISTINCT p.maker AS n ORDER BY p.maker DESC") == ["Ravn", "Holt", "Aldous"]
    assert names(graph, "WHERE p.weight < 1000") == ["Birch Spoon Set", "Copper Ladle Long", "Linen Apron Long"]  # as they were stated


def test_aggregates(graph):
    rows = run_query(graph, "MATCH (p:Product) RETURN p.maker AS b, count(p.weight) AS c, sum(p.weight) AS s, max(p.name) AS m ORDER BY c DESC, b").collect()
    assert [tuple(r) for r in rows] == [("Ravn", 3, 540.0, None), ("Aldous", 2, 1780.0, None), ("Holt", 1, 1450.0, None)]
    assert run_query(graph, "MATCH (p:Review) RETURN count(*) AS n").collect() == []
    assert len(run_query(graph, "MATCH (p:Product) RETURN p.mix AS m, count(*) AS n").collect()) == 3  # 1, 1.0 and null


def test_paths_and_values(graph):
    row = run_query(graph, "MATCH (o:Offer)<-[:Offers|Brand]-(p) WHERE o.amount = 35 RETURN p, o.amount AS `a b.c`, p.tags").first()
    assert row["p"]["name"] == "Copper Kettle" and row["a b.c"] == 35 and row["p.tags"] == ["hot", "2"]
    assert run_query(graph, "MATCH (a)-->(b)<--(a) RETURN a.name AS n").count() == 14  # a name that comes again does not bind
    assert sorted(r[0] for r in run_query(graph, "MATCH ()-[:Offers]->(o) RETURN o.amount AS n").collect()) == [20, 20, 35]
    assert [r[0] for r in run_query(graph, "MATCH (count:Category)<--(min) RETURN count.name AS c, count(min) AS n").collect()] == ["Kitchen"]


def counts(graph, text):
    return sorted(map(tuple, run_query(graph, text).collect()))


def test_counts_through_a_hub(graph):
    """Paths through a shared node are counted from both sides' counts."""
    assert counts(graph, "MATCH (a:Product)-[:Category]->(c)<-[:Category]-(b:Product) RETURN c.name AS c, count(*) AS n") == [("Kitchen", 9)]
    assert counts(graph, "MATCH (a:Product)-->(c)<--(b:Product) RETURN c.kind AS k, count(*) AS n, sum(a.weight) AS s, min(b.weight) AS m") == [("Category", 9, 3 * (210.0 + 330.0), 210.0), ("Offer", 5, 1450.0 + 4 * 1450.0, 1450.0)]
    assert counts(graph, "MATCH (a:Product)-->(c)<--(b:Product) WHERE a.weight < 300 RETURN b.maker AS k, count(*) AS n, avg(a.weight) AS s") == [("Ravn", 3, 210.0)]
    assert counts(graph, "MATCH (a:Product)-->(c)<--(b:Product) WHERE a.weight < b.weight RETURN count(*) AS n") == [(1,)]
    assert counts(graph, "MATCH (a:Product)-->(c)<--(a) RETURN a.name AS k, count(*) AS n") == [("Birch Spoon Set", 3), ("Copper Kettle", 3), ("Iron Trivet", 2), ("Linen Apron Long", 3), ("Slate Board", 3)]
    assert counts(graph, "MATCH (a)-[:Offers]->(o)<-[:Offers]-(b)-[:Offers]->(d) RETURN d.amount AS k, count(*) AS n") == [(20, 5), (35, 3)]


def test_no_python_in_plan(graph):
    plan = run_query(graph, "MATCH (p:Product)-[:Offers]->(v) WHERE p.name CONTAINS 'a' OR v.amount > 5 RETURN p.name AS n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(
    "text, message",
    [
        ("RETURN 1", "must start with MATCH"),
        ("MATCH (a)", "expected RETURN"),
        ("MATCH (a:Nope) RETURN a", "unknown node label"),
        ("MATCH (a)-[:nope]->(b) RETURN a", "unknown rel type"),
        ("MATCH (a) RETURN a.x AS `", "unterminated backtick"),
        ("MATCH (a) RETURN a.x AS ``", "empty backtick"),
        ("MATCH (a) WHERE a.x = 'y RETURN a", "unterminated string"),
        ("MATCH (a) RETURN a; ", "unexpected character"),
        ("MATCH (a) RETURN a LIMIT 5 SKIP 2", "unexpected"),
        ("MATCH (a)--(b) RETURN a", "expected"),
        ("MATCH (a) WHERE a.x = 99999999999999999999 RETURN a", "bad int"),
    ],
)
def test_errors(text, message):
    with pytest.raises(GraphError, match=message):
        parse(text)


def test_compile_errors(graph):
    for text in ("MATCH (a) RETURN b", "MATCH (a) WHERE a.n =~ '(' RETURN a", r"MATCH (a) WHERE a.n =~ '(?=x)' RETURN a"):
        with pytest.raises(GraphError):
            run_query(graph, text)


def test_words_of_any_script():
    assert [t.value for t in tokenize("MATCH (é:Product) WHERE é.naïve = '日本 🎉'")][2] == "é"
    with pytest.raises(GraphError):
        tokenize("MATCH (🎉)")
