"""The published results of the film table."""

import pytest

from tests import diamond
from trellis.operators import quality as Q
from trellis.operators import questions
from trellis.operators.profile import profile
from trellis.plans import rules, shacl, sparql
from trellis.plans.mapping import dump, parse
from trellis.plans.materialize import compile_mapping
from trellis.sources.ntriples import read_ntriples, write_ntriples
from trellis.sources.tables import read_csv


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("diamond") / "movie_data.csv"
    p.write_text(diamond.CSV)
    return read_csv(spark, str(p)).cache()


@pytest.fixture(scope="module")
def graph(spark, table):
    return compile_mapping(parse(diamond.MAPPING), {"movie_data.csv": table}).cache()


@pytest.fixture(scope="module")
def gold(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("gold") / "gold.nt"
    p.write_text(diamond.gold())
    return read_ntriples(spark, str(p)).cache()


def test_profile(table):
    rows = {r.column: r for r in profile(table).collect()}
    assert {c for c, r in rows.items() if r.is_unique} == {"person_id", "primaryName", "ordering"}
    assert not any(r.is_empty for r in rows.values())
    assert rows["deathYear"].n_null == 7 and rows["deathYear"].n_distinct == 3 and rows["category"].n_distinct == 8


def test_graph(graph, gold):
    by = {r.p.rsplit("/", 1)[-1].rsplit("#", 1)[-1]: r["count"] for r in graph.groupBy("p").count().collect()}
    assert graph.count() == 67 and gold.count() == 49
    assert by == {"type": 11, "name": 10, "birthYear": 6, "deathYear": 3, "title": 1, "originalTitle": 1, "startYear": 1, "genre": 1, "starring": 10, "runtime": 1, "profession": 10, "ordering": 10, "titleType": 1, "isAdult": 1}


def test_round_trip(spark, graph, tmp_path):
    write_ntriples(graph, str(tmp_path / "kg"))
    again = read_ntriples(spark, str(tmp_path / "kg"))
    assert graph.exceptAll(again).isEmpty() and again.exceptAll(graph).isEmpty()


def test_compare(graph, gold):
    r = Q.compare_graphs(graph, gold).first()
    assert (r.norm_triple_tp, r.norm_triple_fp, r.norm_triple_fn) == (37, 30, 12)
    assert (r.norm_triple_precision, r.norm_triple_recall, r.norm_triple_f1) == (0.5522, 0.7551, 0.6379)
    assert (r.predicate_precision, r.predicate_recall, r.predicate_f1) == (0.6429, 0.6, 0.6207)
    assert (r.class_precision, r.class_recall, r.class_f1) == (1.0, 0.6667, 0.8)
    assert r.predicates_missing == ["composer", "director", "editing", "producer", "runtime", "writer"]
    assert r.predicates_extra == ["isAdult", "ordering", "profession", "runtime", "titleType"]
    assert (r.total_generated, r.total_gold, r.object_type_mismatches) == (67, 49, 0)


def test_external(graph, gold):
    scores = Q.external_scores(graph, gold)
    got = {k: tuple(d.first()) for k, d in scores.items()}
    counts = {k: v[:3] for k, v in got.items()}
    assert counts["predicates"] == (38, 29, 11) and counts["classes"] == (11, 0, 4) and counts["literals"] == (23, 23, 2)
    assert counts["predicate_objects"] == (24, 32, 13) and counts["subjects_fuzzy"] == (11, 0, 0) and counts["subjects_exact"][0] == 0
    assert round(got["predicates"][5], 3) == 0.655 and round(got["literals"][5], 3) == 0.648 and round(got["classes_unique"][5], 3) == 0.8
    assert len(scores) == 9 and Q.external_average(scores).first().average_f1 == pytest.approx(sum(v[5] for v in got.values()) / 9, abs=1e-4)


def test_columns(table, graph):
    doc = parse(diamond.MAPPING)
    assert Q.mapped_columns(table.columns, doc.columns)["coverage"] == 1.0
    missing = {r.column for r in Q.value_coverage(table, graph, ["ordering"]).where("NOT found").collect()}
    assert missing == {"movie_id", "person_id"}


def test_questions(spark, graph):
    passed = [sparql.ask(q, graph, diamond.PREFIXES) for q, _ in diamond.ASKS]
    assert passed == [p for _, p in diamond.ASKS]
    r = questions.run_questions([("?", q) for q, _ in diamond.ASKS] + [("broken", "ASK { ?s ")], graph, diamond.PREFIXES)
    assert r[-1]["passed"] is None and questions.accept(r)
    c = Q.question_coverage(spark.createDataFrame([(x["passed"],) for x in r[:-1]], "passed boolean")).first()
    assert (c.cq_total, c.cq_passed, c.cq_failed, c.cq_error, c.cq_coverage) == (10, 8, 2, 0, 0.8)


def test_shapes(spark, graph):
    turtle = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix dbo: <http://dbpedia.org/ontology/> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
    <http://x/P> a sh:NodeShape ; sh:nodeKind sh:IRI ; sh:targetClass dbo:Person ; sh:property <http://x/name> , <http://x/born> , <http://x/none> .
    <http://x/name> a sh:PropertyShape ; sh:path dbo:name ; sh:datatype rdf:langString ; sh:nodeKind sh:Literal .
    <http://x/born> a sh:PropertyShape ; sh:path dbo:birthYear ; sh:datatype xsd:gYear .
    <http://x/none> a sh:PropertyShape ; sh:datatype xsd:gYear .
    <http://x/W> a sh:NodeShape ; sh:nodeKind sh:IRI ; sh:targetClass dbo:Work ; sh:property <http://x/title> .
    <http://x/title> a sh:PropertyShape ; sh:path dbo:title ; sh:datatype rdf:langString ."""
    v = shacl.validate(graph, shacl.read_shapes(spark, turtle)).cache()
    assert v.count() == 10 and not shacl.conforms(v)
    g = shacl.grouped(v).collect()
    assert len(g) == 1 and g[0].n == 10 and g[0].component == "DatatypeConstraintComponent" and len(g[0].examples) == 2
    assert len(shacl.fingerprint(shacl.grouped(v)).first().fingerprint) == 12


def test_document_round_trip():
    doc = parse(diamond.MAPPING)
    assert parse(dump(doc)) == doc
    assert all(not x for x in rules.check(doc, rules.Context(columns=sorted(doc.columns))).values())
