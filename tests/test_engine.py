"""Turtle, N-Triples, materialisation, SPARQL, planning, logs, streaming and the pipeline."""

import pytest
from pyspark.sql import functions as F

from tests import diamond
from trellis.functions import prefixes as P
from trellis.functions import terms
from trellis.operators import experiments, matching, profile
from trellis.pipeline import build_graph, evaluate, report, run_matrix, save, table_of
from trellis.plans import sparql
from trellis.plans.mapping import MappingError, parse
from trellis.plans.materialize import compile_mapping, register_term_function
from trellis.plans.rml import to_rml
from trellis.sources import ntriples, tables
from trellis.sources.ontology import read_ontology
from trellis.sources.turtle import Term, TurtleError, parse_turtle
from trellis.streaming.materialize import start

ONTOLOGY = """@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>. @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#>. @prefix xsd: <http://www.w3.org/2001/XMLSchema#>.
@prefix owl: <http://www.w3.org/2002/07/owl#>. @prefix dbo: <http://dbpedia.org/ontology/>.
# comment
dbo:Person a owl:Class ; rdf:label "person" ; rdfs:subClassOf dbo:Agent .
dbo:Film a owl:Class ; rdfs:label "film" .
dbo:name a owl:DatatypeProperty ; rdfs:label "name" ; rdfs:domain dbo:Person ; rdfs:range rdf:langString .
dbo:birthYear a owl:DatatypeProperty ; rdfs:label "birth year" ; rdfs:domain dbo:Person ; rdfs:range xsd:gYear .
dbo:title a owl:DatatypeProperty ; rdfs:label "title" ; rdfs:domain dbo:Film .
<http://dbpedia.org/ontology/Work/runtime> rdf:type owl:DatatypeProperty ; rdfs:range <https://dbpedia.org/datatype/minute> .
dbo:starring a owl:ObjectProperty ; rdfs:label "redaktor"@pl , "starring"@en ; rdfs:domain dbo:Film ; rdfs:range dbo:Person ; owl:propertyChainAxiom ( dbo:a [ a owl:Thing ; rdfs:label 5 , 1.5 , 1e3 , true , '''long "text"\\n''' ] ) .
"""


def test_turtle():
    triples, prefixes = parse_turtle(ONTOLOGY)
    assert prefixes["dbo"] == "http://dbpedia.org/ontology/"
    o = read_ontology(ONTOLOGY)
    assert [c[0].rsplit("/", 1)[-1] for c in o.classes] == ["Person", "Film"] and o.classes[0][1] is None
    p = {x.uri.rsplit("/", 1)[-1]: x for x in o.properties}
    assert p["starring"].label == "starring" and p["starring"].kind == "object" and p["runtime"].range.endswith("minute") and p["runtime"].domain is None
    kinds = {(x.value, x.datatype) for _, q, x in triples if q.endswith("label") and x.kind == "lit"}
    assert {("5", P.XSD + "integer"), ("1.5", P.XSD + "decimal"), ("1e3", P.XSD + "double"), ("true", P.XSD + "boolean"), ('long "text"\n', None)} <= kinds
    assert "dbo:starring: dbo:Film -> dbo:Person" in o.summary(["starring"])
    for bad in ("a b c .", "<x> <y> .", "zz:a zz:b zz:c .", "<a> <b> <c>"):
        with pytest.raises(TurtleError):
            parse_turtle(bad)
    assert Term("x", "lit") in {t[2] for t in parse_turtle('<s> <p> "x"^^<http://www.w3.org/2001/XMLSchema#string> .')[0]}


def test_ntriples_lines(spark):
    lines = ['<a:s> <a:p> "q\\"\\\\n\\n\\u00e9\\U0001F600"@en-GB .', "_:b <a:p> _:c . # end", '<a:s> <a:p> "5"^^<x:int> .', "", "# no", "broken <a> .", '<a:s> <a:p> "s"^^<http://www.w3.org/2001/XMLSchema#string> .']
    df = ntriples.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted([("a:s", "iri", "a:p", 'q"\\n\né😀', "lit", None, "en-GB"), ("b", "bnode", "a:p", "c", "bnode", None, None), ("a:s", "iri", "a:p", "5", "lit", "x:int", None), ("a:s", "iri", "a:p", "s", "lit", None, None)])
    again = ntriples.parse(df.select(ntriples.line().alias("value")))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(rows, key=repr)


def test_names():
    assert P.expand("dbo:Film", {"dbo": "http://d/"}) == "http://d/Film" and P.expand("<http://x>", {}) == "http://x" and P.expand("xsd:date", {}) == P.XSD + "date"
    assert P.compact("http://d/x/y", {"a": "http://d/", "b": "http://d/x/"}) == "b:y" and P.compact("urn:x", {"a": "http://d/"}) == "urn:x"
    assert P.host_prefix("https://data.acme.com/kg/") == "data" and P.host_prefix("http://mykg.org/") == "mykg" and P.normal_base("a.b") == "http://a.b/"
    assert terms.fallback("index") == ("ex:rowIndex", "xsd:integer") and terms.fallback("colour") is None and terms.camel("a_bC_d") == "aBcD"
    assert round(terms.similarity("runtimeMinutes", "runtime"), 3) == 0.667


def test_term_columns(spark):
    df = spark.createDataFrame([("http://example.com/rental/42", "a b~*+é/1", "$(x)/{y_z}-{p q}"), ("http://example.org/b#Record_42", "", "none"), ("http://x/Bike_Shop", None, "$(a)$(a)")], "u string, v string, t string")
    got = df.select(terms.uri_tail(F.col("u")), terms.row_id(F.col("u")), terms.iri_safe(F.col("v")), F.array_join(terms.column_refs_braces(F.col("t")), "|"), terms.last_segment(F.concat("u", F.lit("//")))).collect()
    assert tuple(got[0]) == ("42", "42", "a%20b~%2A%2B%C3%A9%2F1", "x|y_z|p|q", "42")
    assert tuple(got[1])[:2] == ("Record_42", "42") and tuple(got[2])[:2] == ("Bike_Shop", "Bike_Shop") and got[2][3] == "a"


HEAD = "prefixes:\n  kg: http://kg/\nmappings:\n"


def test_terms_of_types(spark):
    df = spark.sql("SELECT 1 AS i, 1.50D AS d, 1e8D AS e, CAST(2.50 AS DECIMAL(5,2)) AS x, TIMESTAMP'2020-01-02 03:04:05' AS t, DATE'2020-01-02' AS y, true AS b, '' AS z, CAST(NULL AS STRING) AS n, 'http://ok/a' AS u, 'not an iri' AS v")
    po = "".join(f"      - [kg:{c}, $({c})]\n" for c in "idextybzn") + "      - [kg:u, $(u)~iri]\n      - [kg:v, $(v)~iri]\n      - [kg:l, $(v), en~lang]\n"
    g = {r.p.rsplit("/", 1)[-1]: r for r in compile_mapping(parse(f"{HEAD}  A:\n    sources: [[t~csv]]\n    s: kg:A/$(i)\n    po:\n{po}"), {"t": df}).collect()}
    assert {k: r.o for k, r in g.items()} == {"i": "1", "d": "1.5", "e": "100000000", "x": "2.5", "t": "2020-01-02T03:04:05", "y": "2020-01-02", "b": "true", "u": "http://ok/a", "l": "not an iri"}
    assert g["u"].o_kind == "iri" and g["l"].o_lang == "en"
    assert compile_mapping(parse(f"{HEAD}  A:\n    sources: [[t~csv]]\n    s: kg:A/$(n)\n    po:\n      - [kg:p, $(i)]\n"), {"t": df}).count() == 0
    with pytest.raises(MappingError):
        compile_mapping(parse(f"{HEAD}  A:\n    sources: [[t~csv]]\n    s: kg:A/$(nope)\n    po:\n      - [kg:p, $(i)]\n"), {"t": df})


def test_one_scan_and_pruned_columns(spark, tmp_path):
    spark.range(10).select("id", F.lit("a").alias("x"), F.lit("b").alias("unused")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    two = f"{HEAD}  A:\n    sources: [[t~csv]]\n    s: kg:A/$(id)\n    po:\n      - [kg:x, $(x)]\n  B:\n    sources: [[t~csv]]\n    s: kg:B/$(x)\n    po:\n      - [a, kg:B]\n"
    plan = compile_mapping(parse(two), {"t": df})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "unused" not in plan


def test_rml():
    triples, _ = parse_turtle(to_rml(parse(diamond.MAPPING)))
    maps = [s for s, p, o in triples if o.value.endswith("TriplesMap")]
    templates = {o.value for _, p, o in triples if p.endswith("#template")}
    assert len(maps) == 2 and templates == {"http://mykg.org/resource/Film/{movie_id}", "http://mykg.org/resource/Person/{person_id}"}
    assert sum(p.endswith("#reference") for _, p, _ in triples) == 12 and sum(p.endswith("#predicateObjectMap") for _, p, _ in triples) == 15


def test_term_functions(spark):
    register_term_function("upper", F.upper)
    g = compile_mapping(parse(f"{HEAD}  A:\n    sources: [[t~csv]]\n    s: kg:A/$(upper:n)\n    po:\n      - [a, kg:A]\n"), {"t": spark.createDataFrame([("x",)], "n string")})
    assert g.first().s == "http://kg/A/X"


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("d", "p", "d2")]
    data = [(s, "iri", p, o, "iri", None, None) for s, p, o in rows]
    data += [("a", "iri", "n", "5", "lit", P.XSD + "integer", None), ("b", "iri", "n", "12", "lit", P.XSD + "integer", None), ("c", "iri", "n", "x", "lit", None, None), ("a", "iri", "l", "hi", "lit", None, "en"), ("a", "iri", "l", "salut", "lit", None, "fr")]
    return spark.createDataFrame(data, terms.TRIPLE).cache()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT ?y WHERE { <a> <p>+ ?y }", [("a",), ("b",), ("c",)]),
        ("SELECT ?y WHERE { <d> <p>* ?y }", [("d",), ("d2",)]),
        ("SELECT ?y WHERE { <d> <p>? ?y }", [("d",), ("d2",)]),
        ("SELECT ?x WHERE { ?x (<p>/<p>)/<p> ?x }", [("a",), ("b",), ("c",)]),
        ("SELECT ?x WHERE { ?x <n> ?v FILTER(?v > 6) }", [("b",)]),
        ("SELECT ?x WHERE { ?x <n> ?v FILTER(?v = 5.0) }", [("a",)]),
        ("SELECT ?x WHERE { ?x <n> 5 }", [("a",)]),
        ("SELECT ?v WHERE { <a> <l> ?v FILTER(LANG(?v) = 'en') }", [("hi",)]),
        ("SELECT ?x ?v WHERE { ?x <p> ?y OPTIONAL { ?y <n> ?v FILTER(?v > 6) } }", [("a", "12"), ("b", None), ("c", None), ("d", None)]),
        ("SELECT ?x WHERE { ?x <p> ?y OPTIONAL { ?y <n> ?v } FILTER(!BOUND(?v)) }", [("d",)]),
        ("SELECT ?x ?k WHERE { ?x <p> ?y BIND(IF(?x = <a>, 'one', 'two') AS ?k) VALUES ?x { <a> <d> } }", [("a", "one"), ("d", "two")]),
        ("SELECT (COUNT(*) AS ?c) (COUNT(DISTINCT ?p) AS ?d) WHERE { ?s ?p ?o }", [(9, 3)]),
        ("SELECT ?p (GROUP_CONCAT(?o; SEPARATOR='|') AS ?g) WHERE { <a> ?p ?o } GROUP BY ?p HAVING(COUNT(?o) > 1)", [("l", "hi|salut")]),
        ("SELECT ?x WHERE { ?x <p> ?y FILTER NOT EXISTS { ?x <n> ?v } }", [("d",)]),
        ("SELECT ?x WHERE { ?x <p> ?y FILTER(?x IN (<a>, <b>)) }", [("a",), ("b",)]),
        ("SELECT DISTINCT ?s WHERE { ?s ?p ?o . FILTER(isLiteral(?o) && STRLEN(?o) < 2) }", [("a",), ("c",)]),
        ("SELECT (SUM(?v) / COUNT(?v) AS ?m) WHERE { ?x <n> ?v FILTER(isNumeric(?v)) }", [(8.5,)]),
        ("ASK { <a> <p> <b> ; <n> 5 . <b> <n> ?z }", [(True,)]),
        ("ASK { }", [(True,)]),
    ],
)
def test_sparql(small, text, want):
    assert sorted(map(tuple, sparql.run(text, small).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("text", ["", "ASK", "ASK {", "SELECT WHERE { ?s ?p ?o }", "ASK { ?s q:p ?o }", "ASK { ?s ?p }", "DESCRIBE <a>", "ASK { ?s ?p ?o } x", "ASK { ?s ?p ?o FILTER(NOPE(?s)) }"])
def test_sparql_errors(small, text):
    assert sparql.ask(text, small) is None


def test_unknown_prefix(small):
    assert sparql.ask("ASK { <a> zz:p <b> }", small, {"ex": ""}, "ex")


def test_planning(spark):
    o = read_ontology(ONTOLOGY)
    cols = diamond.CSV.splitlines()[0].split(",")
    p = matching.plan_entities(o, cols)
    by = {e.cls: e for e in p.entities}
    assert p.multi_node and by["dbo:Person"].identifier == "person_id" and by["dbo:Film"].identifier == "movie_id"
    assert ("birthYear", "dbo:birthYear", "xsd:gYear") in by["dbo:Person"].data and by["dbo:Film"].links == [("dbo:starring", "ex:Person/$(person_id)")]
    assert "URI_TEMPLATE_LINKS" in p.text() and "category" in p.unmatched
    props = spark.createDataFrame([(i, x.uri, x.kind, x.label, x.domain, x.range) for i, x in enumerate(o.properties)], "ord int, uri string, kind string, label string, domain string, range string")
    found = {r.column: r for r in matching.match_columns(spark.createDataFrame(list(enumerate(cols)), "ordinal int, column string"), props).collect()}
    assert found["birthYear"].score == 1.0 and found["primaryName"].uri.endswith("/name")
    with pytest.raises(ValueError, match="no class"):
        matching.plan_entities(read_ontology(""), cols)


def test_pipeline(spark, tmp_path):
    (tmp_path / "movie_data.csv").write_text(diamond.CSV)
    table = tables.read_csv(spark, str(tmp_path / "movie_data.csv"))
    r = build_graph(spark, table, "movie_data.csv", ONTOLOGY)
    assert r.triples.count() > 40 and all(q["passed"] for q in r.questions) and r.conforms
    m = evaluate(r, table)
    assert m["L3_column_coverage_by_yarrrml"] == 1.0 and m["L4_cq_coverage"] == 1.0 and m["L2_skipped"]
    save(r, str(tmp_path / "out"), m)
    assert (tmp_path / "out/mapping.rml.ttl").exists() and "coverage" in report(m, r.seconds)
    assert (tmp_path / "out/final_mapping.yaml").exists() and (tmp_path / "out/metrics.json").exists()
    given = build_graph(spark, table, "movie_data.csv", ONTOLOGY, diamond.MAPPING, asks=[("", q) for q, _ in diamond.ASKS], validate=False)
    assert sum(q["passed"] is True for q in given.questions) == 8 and given.triples.count() == 67
    with pytest.raises(MappingError):
        build_graph(spark, table, "movie_data.csv", ONTOLOGY, "no mapping")


def test_logs(spark, tmp_path):
    rows = run_matrix([{"dataset": "d", "llm": x} for x in "ab"], lambda dataset, llm: {"f1": 0.5, "L2_skipped": False} if llm == "a" else 1 / 0)
    t = table_of(spark, rows)
    assert t.columns == sorted(["dataset", "llm", "f1", "L2_skipped", "L1_pipeline_success", "error"])
    tables.write_log(t, str(tmp_path / "log"))
    back = tables.read_logs(spark, [str(tmp_path / "log"), str(tmp_path / "log")])
    s = experiments.summarise(back, ["dataset", "llm"], [], ["f1"]).where("llm = 'a'").first()
    assert (s.n_runs, s.f1_mean, s.f1_std) == (2, 0.5, 0.0) and experiments.not_skipped(back, "L2_skipped").count() == 2


def test_text_lists():
    assert tables.read_questions("# no\n\nWhich?\n  What? \n") == ["Which?", "What?"]
    assert tables.read_asks("PREFIX a: <b>\nASK { ?s ?p ?o }\n\nSELECT ?s { }\n\nask {}") == ["PREFIX a: <b>\nASK { ?s ?p ?o }", "ask {}"]
    assert tables.rdf_format("x.nt") == "ntriples" and "-a" in tables.text_diff("a\n", "b\n")


def test_empty_table(spark):
    t = spark.createDataFrame([], "a string, b string")
    assert {r.is_unique for r in profile.profile(t).collect()} == {True} and profile.empty_columns(t) == {"a", "b"}
    assert compile_mapping(parse(f"{HEAD}  A:\n    sources: [[t~csv]]\n    s: kg:A/$(a)\n    po:\n      - [a, kg:A]\n"), {"t": t}).count() == 0


def test_stream(spark, tmp_path):
    rows = [(i % 5, f"2020-01-01 00:00:{i:02d}") for i in range(20)]
    spark.createDataFrame(rows, "id int, t string").select("id", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id int, t timestamp").parquet(str(tmp_path / "in"))
    doc = parse(f"{HEAD}  E:\n    sources: [[events~parquet]]\n    s: kg:E/$(id)\n    po:\n      - [a, kg:E]\n")
    start(doc, "events", s, "t", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("s").distinct().count() == 5 == spark.read.parquet(str(tmp_path / "out")).count()
