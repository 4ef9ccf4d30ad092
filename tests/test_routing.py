"""What failed checks and failed questions change in a document, and when that ends."""

import pytest

from trellis.operators import questions
from trellis.pipeline import build_graph
from trellis.plans import rules
from trellis.plans.mapping import PO, parse

HEAD = "prefixes:\n  kg: http://kg.test/\nmappings:\n"
ONTOLOGY = """@prefix kg: <http://kg.test/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
kg:Film a owl:Class . kg:Person a owl:Class .
kg:title a owl:DatatypeProperty ; rdfs:domain kg:Film ; rdfs:range xsd:string .
kg:year a owl:DatatypeProperty ; rdfs:domain kg:Film ; rdfs:range xsd:gYear .
kg:starring a owl:ObjectProperty ; rdfs:domain kg:Film ; rdfs:range kg:Person .
"""
FILM = "  Film:\n    sources: [[films.csv~csv]]\n    s: kg:Film/$(film_id)\n    po:\n"


def ask(pattern):
    return pattern, f"PREFIX kg: <http://kg.test/> ASK {{ {pattern} }}"


@pytest.fixture(scope="module")
def films(spark):
    rows = [("f1", "Alien", "1979", "p1"), ("f2", "Heat", "1995", "p2"), ("f3", "Heat", "1986", None)]
    return spark.createDataFrame(rows, "film_id string, title string, film_year string, person_id string")


@pytest.mark.parametrize(
    ("passed", "failed", "errors", "want"),
    [(3, 0, 0, True), (0, 0, 3, True), (0, 0, 0, True), (0, 1, 2, True), (0, 1, 1, False), (3, 3, 4, False), (7, 3, 0, True), (69, 31, 0, False), (70, 30, 0, True)],
)
def test_acceptance(passed, failed, errors, want):
    assert questions.accept([{"passed": x} for x in [True] * passed + [False] * failed + [None] * errors]) == want


def test_acceptance_can_ask_for_more():
    r = [{"passed": x} for x in [True] * 9 + [False]]
    seen = []
    assert not questions.accept(r, go_on=lambda *a: not seen.append(a)) and seen == [(9, 10)]
    assert questions.accept(r, go_on=lambda *_: False) and not questions.accept(r, 0.95)


def test_demands():
    q = "PREFIX kg: <http://kg.test/> ASK { ?f a kg:Film ; kg:starring ?p ; kg:title \"Heat\" . ?p a kg:Person . ?f ?any ?x . ?f kg:a/kg:b ?y FILTER(?x > 1) }"
    assert questions.demands(q) == [questions.Demand(f"http://kg.test/{c}") for c in ("Film", "Person")] + [questions.Demand("http://kg.test/Film", "http://kg.test/starring", "http://kg.test/Person"), questions.Demand("http://kg.test/Film", "http://kg.test/title")]


def test_two_repairs_in_turn():
    """A prefix that isn't declared, and two columns under one predicate."""
    doc = parse(HEAD + FILM + "      - [a, kg:Film]\n      - [zz:name, $(title)]\n      - [zz:name, $(other)]\n")
    fixed, found, rounds = rules.repaired(doc, rules.Context(columns=["film_id", "title", "other"]))
    assert rounds == 2 and not any(found.values())
    assert "zz" in fixed.prefixes and len({x.predicate for x in fixed.mappings["Film"].po}) == 3
    assert rules.repaired(fixed)[2] == 0


def test_repairs_that_cannot_help_end_at_once():
    two = FILM + "      - [a, kg:Film]\n      - [kg:title, $(title)]\n" + "  Person:\n    sources: [[people.csv~csv]]\n    s: kg:Person/$(person_id)\n    po:\n      - [a, kg:Person]\n      - [kg:label, $(label)]\n"
    doc = parse(HEAD + two)
    fixed, found, rounds = rules.repaired(doc)
    assert rounds == 0 and fixed == doc and found["islands"] == ["Film", "Person"]


def test_repairs_that_undo_each_other_end(monkeypatch):
    swap = {"kg:a": "kg:b", "kg:b": "kg:a"}

    def rule(doc, ctx):
        doc.mappings["Film"].po = [PO(swap.get(x.predicate, x.predicate), x.object, x.kind) for x in doc.mappings["Film"].po]
        return doc

    monkeypatch.setattr(rules, "REPAIRS", {"uncovered": rule})
    doc = parse(HEAD + FILM + "      - [kg:a, $(title)]\n")
    assert rules.repaired(doc, rules.Context(columns=["film_id", "title", "never"]), 100)[2] == 1


def test_questions_repair_the_document(spark, films):
    doc = HEAD + FILM + "      - [kg:title, $(title)]\n"
    asks = [ask("?f a kg:Film"), ask("?f a kg:Film ; kg:year ?y"), ask('?f kg:title "Heat"'), ask("?f a kg:Film ; kg:year ?y ; kg:title ?t")]
    r = build_graph(spark, films, "films.csv", ONTOLOGY, doc, asks=asks, validate=False)
    assert all(q["passed"] for q in r.questions) and r.attempts == 2
    year = [x for x in r.document.mappings["Film"].po if x.columns == ("film_year",)]
    assert [(x.predicate, x.datatype) for x in year] == [("kg:year", "xsd:gYear")]


def test_a_new_plan_where_repairs_do_not_help(spark, films):
    """No mapping makes people; only a plan from the ontology does."""
    doc = HEAD + FILM + "      - [a, kg:Film]\n      - [kg:title, $(title)]\n  Note:\n    sources: [[films.csv~csv]]\n    s: kg:Note/$(film_id)\n    po:\n      - [a, kg:Note]\n      - [kg:text, $(film_year)]\n"
    asks = [ask("?p a kg:Person"), ask("?f kg:starring ?p . ?p a kg:Person")]
    r = build_graph(spark, films, "films.csv", ONTOLOGY, doc, asks=asks, validate=False)
    assert [q["passed"] for q in r.questions] == [True, True]
    assert {c for m in r.document.mappings.values() for c in m.classes} == {"kg:Film", "kg:Person"}


def test_hopeless_questions_end_and_keep_the_best(spark, films):
    doc = HEAD + FILM + "      - [a, kg:Film]\n      - [kg:title, $(title)]\n"
    asks = [ask("?f a kg:Film"), ask('?f kg:title "None"'), ask("?f kg:never ?x"), ask("?f kg:title")]
    r = build_graph(spark, films, "films.csv", ONTOLOGY, doc, asks=asks, validate=False)
    assert [q["passed"] for q in r.questions] == [True, False, False, None] and r.attempts <= 4
    assert r.triples.count() > 0


def test_accepted_graphs_are_left_alone(spark, films):
    doc = HEAD + FILM + "      - [a, kg:Film]\n      - [kg:title, $(title)]\n"
    asks = [ask("?f a kg:Film"), ask("?f kg:title ?t"), ask('?f kg:title "Heat"'), ask("?f a kg:Film ; kg:year ?y")]
    r = build_graph(spark, films, "films.csv", ONTOLOGY, doc, asks=asks, validate=False)
    assert [q["passed"] for q in r.questions] == [True, True, True, False] and r.attempts == 1
    more = build_graph(spark, films, "films.csv", ONTOLOGY, doc, asks=asks, validate=False, go_on=lambda *_: True)
    assert all(q["passed"] for q in more.questions)
