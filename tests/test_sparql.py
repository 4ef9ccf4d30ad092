"""Semantics of queries: correlated EXISTS, unbound variables, typed values, paths, graphs."""

import pytest

from trellis.functions import prefixes as P
from trellis.functions import terms
from trellis.plans import sparql
from trellis.plans.closure import closure

INT, DEC, TIME = P.XSD + "integer", P.XSD + "decimal", P.XSD + "dateTime"


@pytest.fixture(scope="module")
def g(spark):
    lit = lambda s, p, o, d=None: (s, "iri", p, o, "lit", d, None)
    link = lambda s, p, o, k="iri": (s, "iri", p, o, k, None, None)
    rows = [link("s1", "a", "X"), link("s2", "a", "X"), link("s3", "a", "X"), lit("s1", "p", "1", INT), lit("s2", "p", "2", INT), lit("t", "q", "1", INT)]
    rows += [lit("m", "age", "30", INT), lit("n", "age", "40", INT), link("m", "likes", "n"), link("n", "likes", "m"), lit("m", "age", "31", INT)]
    rows += [lit("e1", "at", "2020-01-02T00:00:00+05:00", TIME), lit("e2", "at", "2020-01-01T23:00:00Z", TIME), lit("e3", "at", "2020-01-01T19:00:00Z", TIME)]
    rows += [lit("b1", "big", "9007199254740993", INT), lit("b2", "big", "9007199254740992", INT), lit("b3", "big", "0.1", DEC), lit("b4", "big", "0.2", DEC), lit("w", "num", "word"), lit("w", "num", "3", INT)]
    rows += [link("c1", "next", "c2"), link("c2", "next", "c3"), link("c3", "next", "c1"), link("c3", "next", "c4"), link("c4", "other", "c5")]
    rows += [link("r", "part", "z1", "bnode"), ("z1", "bnode", "part", "z2", "bnode", None, None), ("z2", "bnode", "name", "deep", "lit", None, None), ("z3", "bnode", "name", "else", "lit", None, None)]
    rows += [lit("half", "v", "-2.5", DEC), lit("half", "v", "2.5", DEC)]
    return spark.createDataFrame(rows, terms.TRIPLE).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        # A filter inside names a variable from outside.
        ("SELECT ?s WHERE { ?s <likes> ?t . ?t <age> ?y FILTER EXISTS { ?s <age> ?x FILTER(?x > ?y) } }", [("n",), ("n",)]),
        ("SELECT ?s WHERE { ?s <likes> ?t . ?t <age> ?y FILTER NOT EXISTS { ?s <age> ?x FILTER(?x > ?y) } }", [("m",)]),
        ("SELECT ?s ?y WHERE { ?s <likes> ?t . ?t <age> ?y FILTER(?y = 31 || EXISTS { ?s <age> ?x FILTER(?x > ?y + 9) }) }", [("n", "30"), ("n", "31")]),
        ("SELECT ?s WHERE { ?s <a> <X> FILTER(!EXISTS { ?s <p> ?o } || EXISTS { ?s <p> 2 }) }", [("s2",), ("s3",)]),
        ("SELECT ?s WHERE { ?s <a> <X> OPTIONAL { ?s <p> ?o } FILTER EXISTS { { ?t <q> ?v FILTER(?v = ?o) } UNION { ?t <age> ?v FILTER(?v < ?o) } } }", [("s1",)]),
        ("SELECT ?s ?k WHERE { ?s <a> <X> BIND(EXISTS { ?s <p> ?o } AS ?k) }", [("s1", "true"), ("s2", "true"), ("s3", "false")]),
        ("SELECT ?s WHERE { ?s <a> <X> FILTER EXISTS { ?zz <age> 40 } }", [("s1",), ("s2",), ("s3",)]),
        # Unbound variables.
        ("SELECT ?s ?o WHERE { ?s <a> <X> OPTIONAL { ?s <p> ?o } MINUS { ?t <q> ?o } }", [("s2", "2"), ("s3", None)]),
        ("SELECT ?s ?o WHERE { ?s <a> <X> OPTIONAL { ?s <p> ?o } MINUS { ?s <a> <X> OPTIONAL { ?t <q> ?o } } }", [("s2", "2")]),
        ("SELECT ?s ?t ?o WHERE { ?s <a> <X> OPTIONAL { ?s <p> ?o } OPTIONAL { ?t <q> ?o } }", [("s1", "t", "1"), ("s2", None, "2"), ("s3", "t", "1")]),
        ("SELECT ?s ?t ?o WHERE { ?s <a> <X> OPTIONAL { ?s <p> ?o } ?t <q> ?o }", [("s1", "t", "1"), ("s3", "t", "1")]),
        ("SELECT ?s ?o ?x WHERE { { ?s <a> <X> OPTIONAL { ?s <p> ?o } } { ?x <a> <X> OPTIONAL { ?x <p> ?o } } FILTER(?s < ?x) }", [("s1", "1", "s3"), ("s2", "2", "s3")]),
        ("SELECT ?s ?o WHERE { ?s <a> <X> OPTIONAL { ?s <p> ?o } OPTIONAL { { ?s <a> <X> } UNION { ?t <q> ?o } } }", [("s1", "1"), ("s1", "1"), ("s2", "2"), ("s3", None), ("s3", "1")]),
        ("SELECT ?s WHERE { ?s <a> <X> OPTIONAL { ?s <p> ?o } FILTER EXISTS { ?t <q> ?o } }", [("s1",), ("s3",)]),
        ("SELECT ?s ?o WHERE { ?s <a> <X> . VALUES (?s ?o) { (<s1> UNDEF) (UNDEF 5) } }", [("s1", None), ("s1", "5"), ("s2", "5"), ("s3", "5")]),
        # Values.
        ("SELECT ?x ?y WHERE { ?x <at> ?a . ?y <at> ?b FILTER(?a < ?b) }", [("e1", "e2"), ("e3", "e2")]),
        ("SELECT ?x ?y WHERE { ?x <at> ?a . ?y <at> ?b FILTER(?a = ?b && ?x < ?y) }", [("e1", "e3")]),
        ("SELECT ?x WHERE { ?x <big> ?v FILTER(?v = 9007199254740993) }", [("b1",)]),
        ("SELECT ?x ?y WHERE { ?x <big> ?v . ?y <big> ?w FILTER(?v > ?w && ?w > 1) }", [("b1", "b2")]),
        ("SELECT ?x WHERE { VALUES ?x { <b3> } <b3> <big> ?v . <b4> <big> ?w FILTER(?v + ?w = 0.3) }", [("b3",)]),
        ("SELECT (STR(SUM(?v)) AS ?n) WHERE { ?x <big> ?v FILTER(?v > 1) }", [("18014398509481985",)]),
        ("SELECT (STR(SUM(?v)) AS ?n) WHERE { ?x <big> ?v FILTER(?v < 1) }", [("0.3",)]),
        ("SELECT (STR(SUM(?v)) AS ?n) (DATATYPE(SUM(?v)) AS ?d) WHERE { ?x <none> ?v }", [("0", INT)]),
        ("SELECT (SUM(?v) AS ?n) (AVG(?v) AS ?m) WHERE { <w> <num> ?v }", [(None, None)]),
        ("SELECT (MAX(?v) AS ?n) (MIN(?v) AS ?m) WHERE { ?x <big> ?v FILTER(?v > 1) }", [("9007199254740993", "9007199254740992")]),
        ("SELECT (MAX(?v) AS ?n) (MIN(?v) AS ?m) WHERE { ?x <at> ?v FILTER(?x != <e3>) }", [("2020-01-01T23:00:00Z", "2020-01-02T00:00:00+05:00")]),
        ("SELECT (STR(ROUND(?v)) AS ?n) WHERE { <half> <v> ?v }", [("-2",), ("3",)]),
        ("SELECT (STR(7 / 2) AS ?a) (STR(2 * 3) AS ?b) (STR(1 / 0) AS ?c) (DATATYPE(1 / 2) AS ?d) WHERE { }", [("3.5", "6", None, DEC)]),
        ("SELECT (MD5('a') AS ?m) (SHA256('a') AS ?h) (ENCODE_FOR_URI('a b/é~*') AS ?u) WHERE { }", [("0cc175b9c0f1b6a831c399e269772661", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb", "a%20b%2F%C3%A9~%2A")]),
        ("SELECT (STRDT('5', <" + INT + ">) AS ?a) (LANG(STRLANG('x', 'en')) AS ?b) (STR(HOURS(?v)) AS ?c) (STR(MINUTES(?v)) AS ?d) (STR(SECONDS(?v)) AS ?e) WHERE { <e1> <at> ?v }", [("5", "en", "0", "0", "0")]),
        # Variables.
        ("SELECT ?x ?X WHERE { ?x <likes> ?X }", [("m", "n"), ("n", "m")]),
        ("SELECT * WHERE { ?_x <likes> <n> }", [("m",)]),
        ("SELECT ?x WHERE { ?x <part> [ <part> [ <name> 'deep' ] ] }", [("r",)]),
        # Paths.
        ("SELECT ?o WHERE { <zz> <next>* ?o }", [("zz",)]),
        ("SELECT ?o WHERE { ?o <next>? <zz> }", [("zz",)]),
        ("SELECT ?o WHERE { <c1> <next>+ ?o }", [("c1",), ("c2",), ("c3",), ("c4",)]),
        ("SELECT ?o WHERE { ?o <next>+ <c4> }", [("c1",), ("c2",), ("c3",)]),
        ("SELECT ?o WHERE { ?o ^<next>+ <c4> }", []),
        ("SELECT ?o WHERE { <c4> (^<next>)+ ?o }", [("c1",), ("c2",), ("c3",)]),
        ("SELECT ?o WHERE { <c4> !<next> ?o }", [("c5",)]),
        ("SELECT ?o WHERE { <c4> !(<next>|<other>) ?o }", []),
        ("SELECT ?o WHERE { <c4> !(<next>|^<part>) ?o }", [("c3",), ("c5",)]),
        ("SELECT ?o WHERE { <c4> !^<other> ?o }", [("c3",)]),
        ("SELECT ?o WHERE { <c3> (<next>|!<next>)+ ?o }", [("c1",), ("c2",), ("c3",), ("c4",), ("c5",)]),
    ],
)
def test_queries(g, text, want):
    assert rows(sparql.run(text, g)) == sorted(want, key=repr)


def test_names():
    for n in ("x", "X", "_x", "x_1", "aB_cD9", "é", "__", "_1", "A1"):
        assert sparql.name_of(sparql.column_of(n)) == n and sparql.column_of(n) == sparql.column_of(n).lower()
    assert len({sparql.column_of(n) for n in ("ab", "aB", "a_b", "a__b", "a_B", "AB")}) == 6


def test_joins_by_equality_only(g):
    """No join compares each with each, though both sides may be unbound."""
    q = "SELECT * WHERE { { ?s <a> <X> OPTIONAL { ?s <p> ?o } } { ?t <a> <X> OPTIONAL { ?t <p> ?o } } OPTIONAL { ?u <q> ?o } MINUS { ?u <age> ?o } }"
    plan = sparql.run(q, g)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_construct(g):
    got = rows(sparql.run("CONSTRUCT { ?s <of> _:k . _:k <value> ?o . ?o <wrong> ?s } WHERE { ?s <p> ?o }", g).select("s", "s_kind", "p", "o", "o_kind", "o_datatype"))
    nodes = {r[3] for r in got if r[2] == "of"}
    assert len(got) == 4 and len(nodes) == 2 and {r[0] for r in got if r[2] == "value"} == nodes
    assert {r[3:] for r in got if r[2] == "value"} == {("1", "lit", INT), ("2", "lit", INT)}
    assert rows(sparql.run("CONSTRUCT WHERE { ?s <likes> ?o }", g).select("s", "o")) == [("m", "n"), ("n", "m")]
    assert sparql.run("CONSTRUCT { ?s <of> ?none } WHERE { ?s <p> ?o }", g).count() == 0


def test_describe(g):
    assert {(r.s, r.p, r.o) for r in sparql.run("DESCRIBE <r>", g).collect()} == {("r", "part", "z1"), ("z1", "part", "z2"), ("z2", "name", "deep")}
    assert {(r.s, r.p) for r in sparql.run("DESCRIBE ?x <c4> WHERE { ?x <likes> <n> }", g).collect()} == {("m", "age"), ("m", "likes"), ("c4", "other")}
    assert sparql.run("DESCRIBE <nobody>", g).count() == 0


@pytest.mark.parametrize("text", ["CONSTRUCT { ?s <p>+ ?o } WHERE { ?s <p> ?o }", "ASK { ?s !() }", "ASK { ?s <p> ( ?x", "SELECT ?s WHERE { ?s <p> [ <q> ?x }"])
def test_errors(g, text):
    assert sparql.ask(text, g) is None


def test_closure(spark):
    """A ring, a chain and a tree, against plain reachability; a chain in as many rounds as its length's logarithm."""
    edges = [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("r2", "t0"), ("t0", "t1"), ("t0", "t2"), ("t2", "t3"), ("x", "x")] + [(f"k{i}", f"k{i + 1}") for i in range(40)]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    one = spark.createDataFrame(edges, "a string, b string")
    assert rows(closure(one)) == sorted((a, b) for a in after for b in reach(a))
    start = spark.createDataFrame([("k3",), ("r1",), ("nobody",)], "a string")
    assert rows(closure(one, start)) == sorted((a, b) for a in ("k3", "r1") for b in reach(a))
    assert closure(one.limit(0)).count() == 0
