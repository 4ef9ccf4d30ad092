"""Accepted shapes of mapping documents, rewrites and checks."""

import pytest

from trellis.plans import rules as R
from trellis.plans.mapping import PO, MappingError, dump, parse

HEAD = "prefixes:\n  ex: http://example.org/\n  dbo: http://dbpedia.org/ontology/\nmappings:\n"


def one(po: str, subject: str = "ex:A/$(id)") -> list[PO]:
    return parse(f"{HEAD}  A:\n    sources: [[a.csv~csv]]\n    s: {subject}\n    po:\n{po}").mappings["A"].po


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("      - [a, dbo:Film]", PO("a", "dbo:Film", "type")),
        ("      - [rdf:type, dbo:Film]", PO("a", "dbo:Film", "type")),
        ("      - [ex:p, $(c), xsd:integer]", PO("ex:p", "$(c)", "literal", "xsd:integer")),
        ("      - [ex:p, $(c)]", PO("ex:p", "$(c)", "literal")),
        ("      - [ex:p, ex:C/$(fk)~iri]", PO("ex:p", "ex:C/$(fk)", "iri")),
        ("      - [ex:p, $(c)~iri]", PO("ex:p", "$(c)", "iri_reference")),
        ('      - [ex:p, "const", xsd:string]', PO("ex:p", "const", "const_lit", "xsd:string")),
        ("      - [ex:p, B~iri, {joins: {child: c, parent: p}}]", PO("ex:p", "B", "join", child="c", parent="p")),
        ("      - ex:p: $(c)", PO("ex:p", "$(c)", "literal")),
        ("      - ex:p: {value: $(c), datatype: xsd:date}", PO("ex:p", "$(c)", "literal", "xsd:date")),
        ("      - [[ex:p, $(c)]]", PO("ex:p", "$(c)", "literal")),
        ("      - [ex#local, $(c)]", PO("ex:local", "$(c)", "literal")),
        ("      - [ex:Unnamed: 0, $(c)]", PO("ex:Unnamed_0", "$(c)", "literal")),
        ("      - [ex:p, ex:C/{fk}~iri]", PO("ex:p", "ex:C/$(fk)", "iri")),
        ("      - {p: ex:p, o: $(c)}", PO("ex:p", "$(c)", "literal")),
    ],
)
def test_entries(text, want):
    assert one(text) == [want]


def test_subjects_and_errors():
    doc = parse(f'{HEAD}  A:\n    sources: [[a.csv~csv]]\n    s: ["ex:c/", "$(id)"]\n    po: []\n')
    assert doc.mappings["A"].subject == "ex:c/$(id)"
    assert parse(f"```yaml\n{HEAD}  A:\n    sources: [[a.csv~csv]]\n    s: ex:c/{{id}}\n    po: []\n```").mappings["A"].subject == "ex:c/$(id)"
    for bad in ("", "a: b", "mappings: {A: {po: []}}", "mappings: [", f"{HEAD}  A:\n    s: x\n    po:\n      - [lonely]\n"):
        with pytest.raises(MappingError):
            parse(bad)
    assert parse(f"{HEAD}  A:\n    sources: [[a.csv~csv]]\n    s: ex:c/$(id)\n    po:\n      - [ex:p, $(c)~iri]\n", bare_iri="literal").mappings["A"].po[0].kind == "literal"


def doc(po: str, more: str = "", prefixes: str = HEAD):
    return parse(f"{prefixes}  A:\n    sources: [[a.csv~csv]]\n    s: ex:A/$(id)\n    po:\n      - [a, ex:Thing]\n{po}\n{more}")


def test_prefix_rules():
    d = doc("      - [foaf:name, $(n)]\n      - [zzz:q, $(m)]\n      - [local, $(k)]")
    assert R.missing_prefixes(d) == {"foaf", "zzz"}
    n = R.normalize(d, R.Context(ontology_prefixes={"zzz": "http://z/"}))
    assert n.prefixes == {"ex": "http://example.org/", "foaf": "http://xmlns.com/foaf/0.1/", "zzz": "http://z/"}
    assert [x.predicate for x in n.mappings["A"].po][-1] == "ex:local"
    assert R.normalize(doc("      - [q:p, $(n)]")).prefixes["q"] == "http://example.org/q#"
    old = doc("      - [schema:name, $(n)]", prefixes=HEAD.replace("prefixes:\n", "prefixes:\n  schema: https://schema.org/\n"))
    assert R.normalize(old).prefixes["schema"] == "http://schema.org/"


def test_duplicates():
    d = doc("      - [ex:p, $(a)]\n      - [ex:p, $(a)]\n      - [ex:p, ex:T/$(a)~iri]\n      - [ex:q, $(b)]\n      - [ex:q, $(c_d)]")
    assert R.duplicate_predicates(d) == [("A", "ex:q", ["b", "c_d"])]
    got = [(x.predicate, x.object, x.kind) for x in R.normalize(d).mappings["A"].po][1:]
    assert got == [("ex:p", "ex:T/$(a)", "iri"), ("ex:q", "$(b)", "literal"), ("ex:cD", "$(c_d)", "literal")]


def test_redundancy_islands_and_columns():
    more = "  B:\n    sources: [[a.csv~csv]]\n    s: ex:B/$(b)\n    po:\n      - [a, ex:Thing]\n      - [ex:p, $(b)]\n  C:\n    sources: [[c.csv~csv]]\n    s: ex:C/$(c)\n    po:\n      - [a, ex:Other]\n      - [ex:r, $(c)]\n"
    d = doc("      - [ex:p, $(b)]\n      - [ex:s, $(x)]", more)
    assert R.redundancies(d) == {("ex:p", "b"): ["A", "B"]}
    assert R.islands(d) == ["A", "B", "C"]
    ctx = R.Context(columns=["id", "b", "x", "lost_price", "blank"], empty_columns={"blank"})
    n = R.normalize(d, ctx)
    assert all(x.object != "$(b)" for x in n.mappings["A"].po) and R.uncovered(n, ctx) == []
    assert PO("ex:lostPrice", "$(lost_price)", "literal", "xsd:decimal") in n.mappings["A"].po
    assert any(x.object == "ex:B/$(b)" and x.kind == "iri" for x in n.mappings["A"].po)
    assert R.normalize(n, ctx) == n


def test_rebase_and_real_columns():
    d = doc("      - [ex:p, $(metformin_pioglitazone)]\n      - [ex:of, ex:A/$(up)~iri]")
    n = R.normalize(d, R.Context(columns=["id", "up", "metformin-pioglitazone"], base_uri="http://mykg.org/"))
    assert n.mappings["A"].subject == "mykg:A/$(id)" and n.prefixes["mykg"] == "http://mykg.org/"
    assert [x.object for x in n.mappings["A"].po][1:] == ["$(metformin-pioglitazone)", "mykg:A/$(up)"]


def test_phantoms_and_links():
    more = "  P:\n    sources: [[a.csv~csv]]\n    s: ex:P/$(p)\n    po:\n      - [a, ex:Thing]\n"
    assert set(R.normalize(doc("      - [ex:p, $(b)]", more), batch=(R.drop_phantoms,)).mappings) == {"A"}
    d = R.add_links(doc(""), [("A", PO("ex:x", "ex:P/$(p)", "iri"))] * 2)
    assert len(d.mappings["A"].po) == 2
    assert R.metadata_classes(parse(f"{HEAD}  M:\n    sources: [[a~csv]]\n    s: ex:A/$(id)/Metadata\n    po:\n      - [a, ex:Thing]\n"), R.Context()).mappings["M"].classes == ["ex:ThingMetadata"]


def test_dump_round_trip():
    d = doc('      - [ex:p, "a: b, \\"c\\" {x}", xsd:string]\n      - [ex:q, B~iri, {joins: {child: c, parent: p}}]\n      - [ex:r, $(Unnamed: 0)]\n      - [ex:s, $(t)~iri]')
    assert parse(dump(d)) == d


@pytest.mark.parametrize(
    ("column", "want"),
    [
        ("store_lat", ("geo:lat", "xsd:decimal")),
        ("Longitude", ("geo:long", "xsd:decimal")),
        ("birth_date", ("ex:birthDate", "xsd:dateTime")),
        ("unit_price", ("ex:unitPrice", "xsd:decimal")),
        ("release_year", ("ex:releaseYear", "xsd:integer")),
        ("is_open", ("ex:isOpen", "xsd:boolean")),
        ("user_id", ("ex:userId", "xsd:string")),
        ("a b", ("ex:aB", "xsd:string")),
    ],
)
def test_added_columns(column, want):
    """What nothing uses is typed by a table of its own, which has no identifiers, and dates with a time."""
    d = R.add_columns(doc("      - [ex:p, $(c)]"), R.Context(columns=["id", "c", column]))
    x = d.mappings["A"].po[-1]
    assert (x.predicate, x.datatype, x.columns) == (*want, (column,))


def test_added_columns_go_to_the_mapping_of_their_name():
    two = "  AirportMapping:\n    sources: [[a.csv~csv]]\n    s: ex:B/$(b)\n    po:\n      - [a, ex:U]\n"
    d = R.add_columns(doc("      - [ex:p, $(c)]", two), R.Context(columns=["id", "b", "c", "airport_name", "air", "other"]))
    assert [x.columns for x in d.mappings["AirportMapping"].po[1:]] == [("airport_name",)]
    assert [x.columns for x in d.mappings["A"].po[2:]] == [("air",), ("other",)]
