"""Ontologies: classes, properties, and text of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from trellis.functions.prefixes import OWL, RDF_TYPE, RDFS, compact
from trellis.sources.turtle import Term, parse_turtle


@dataclass(frozen=True)
class Property:
    uri: str
    kind: str
    label: str | None = None
    domain: str | None = None
    range: str | None = None
    comment: str | None = None


@dataclass
class Ontology:
    triples: list[tuple[Term, str, Term]] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)

    def best(self, s: str, *predicates: str) -> str | None:
        """A literal of the first predicate that has one: English before no language before any other."""
        for p in predicates:
            found = [o for t, q, o in self.triples if t.value == s and q == p and o.kind == "lit"]
            if found:
                return min(found, key=lambda o: (o.lang is None or not o.lang.startswith("en"), o.lang is not None, found.index(o))).value
        return None

    def first(self, s: str, p: str) -> str | None:
        return next((o.value for t, q, o in self.triples if t.value == s and q == p and o.kind == "iri"), None)

    def typed(self, kind: str) -> list[str]:
        return list(dict.fromkeys(s.value for s, p, o in self.triples if p == RDF_TYPE and o.value == OWL + kind and s.kind == "iri"))

    @property
    def classes(self) -> list[tuple[str, str | None, str | None, str | None]]:
        return [(c, self.best(c, RDFS + "label"), self.first(c, RDFS + "subClassOf"), self.best(c, RDFS + "comment")) for c in self.typed("Class")]

    @property
    def properties(self) -> list[Property]:
        return [
            Property(p, kind, self.best(p, RDFS + "label"), self.first(p, RDFS + "domain"), self.first(p, RDFS + "range"), self.best(p, RDFS + "comment"))
            for kind, owl in (("object", "ObjectProperty"), ("data", "DatatypeProperty"))
            for p in self.typed(owl)
        ]

    @property
    def object_properties(self) -> list[Property]:
        """Those with a range, which links need."""
        return [p for p in self.properties if p.kind == "object" and p.range]

    def name(self, uri: str | None) -> str | None:
        return uri and compact(uri, self.prefixes)

    def summary(self, keywords: list[str] | None = None) -> str:
        """Sorted prefixes, classes and properties, and the first 50 statements with a keyword."""
        out = ["PREFIXES", *sorted(f"{p}: {u}" for p, u in self.prefixes.items() if p not in ("xml", "rdf"))]
        out += ["CLASSES", *sorted(f"{self.name(c)}" + (f" ({label})" if label else "") for c, label, _, _ in self.classes)]
        out += ["PROPERTIES", *sorted(f"{self.name(p.uri)}: {self.name(p.domain) or '?'} -> {self.name(p.range) or '?'}" for p in self.properties)]
        if keywords:
            lines = {f"{s.value} {p} {o.value}" for s, p, o in self.triples}
            out += ["KEYWORD-MATCHED", *sorted(x for x in lines if any(k.lower() in x.lower() for k in keywords))[:50]]
        return "\n".join(out)

    def class_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.classes, "uri string, label string, parent string, comment string")

    def property_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p.uri, p.kind, p.label, p.domain, p.range, p.comment) for p in self.properties], "uri string, kind string, label string, domain string, range string, comment string")

    def prefix_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.prefixes.items()), "prefix string, uri string")


def read_ontology(text: str) -> Ontology:
    return Ontology(*parse_turtle(text))
