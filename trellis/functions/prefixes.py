"""Prefixes: the well-known ones, and expansion and compaction of names."""

from __future__ import annotations

import re
from urllib.parse import urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public namespaces that mappings may use without declaring them.
WELL_KNOWN = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "schema": "http://schema.org/",
    "schema1": "http://schema.org/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "dct": "http://purl.org/dc/terms/",
    "terms": "http://purl.org/dc/terms/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "geo": "http://www.w3.org/2003/01/geo/wgs84_pos#",
    "wgs": "http://www.w3.org/2003/01/geo/wgs84_pos#",
    "sosa": "http://www.w3.org/ns/sosa/",
    "ssn": "http://www.w3.org/ns/ssn/",
    "prov": "http://www.w3.org/ns/prov#",
    "dcat": "http://www.w3.org/ns/dcat#",
    "void": "http://rdfs.org/ns/void#",
    "time": "http://www.w3.org/2006/time#",
    "vcard": "http://www.w3.org/2006/vcard/ns#",
    "org": "http://www.w3.org/ns/org#",
    "gr": "http://purl.org/goodrelations/v1#",
    "gtfs": "http://vocab.gtfs.org/terms#",
    "eli": "http://data.europa.eu/eli/ontology#",
    "dbo": "http://dbpedia.org/ontology/",
    "dbr": "http://dbpedia.org/resource/",
    "dbp": "http://dbpedia.org/property/",
    "wikidata": "http://www.wikidata.org/entity/",
    "wd": "http://www.wikidata.org/entity/",
    "wdt": "http://www.wikidata.org/prop/direct/",
    "rr": "http://www.w3.org/ns/r2rml#",
    "rml": "http://semweb.mmlab.be/ns/rml#",
    "ql": "http://semweb.mmlab.be/ns/ql#",
    "ex": "http://example.org/",
}
#: Never need declaring; and what is a URI's scheme, not a prefix.
IMPLICIT = frozenset({"xsd", "rdf", "rdfs"})
SCHEMES = frozenset({"http", "https", "ftp", "urn", "mailto", "file"})

RDF, RDFS, OWL, XSD = (WELL_KNOWN[k] for k in ("rdf", "rdfs", "owl", "xsd"))
RDF_TYPE = RDF + "type"
CURIE = re.compile(r"(?<![\w/:.<-])([A-Za-z_][\w-]*):(?!//)")


def expand(name: str, prefixes: dict[str, str]) -> str:
    """The IRI of ``<iri>``, ``prefix:local`` or a plain IRI; a template's braces stay as they are."""
    name = name.strip()
    if name.startswith("<") and name.endswith(">"):
        return name[1:-1]
    head, colon, local = name.partition(":")
    if colon and head in SCHEMES:
        return name
    if colon and (ns := prefixes.get(head, WELL_KNOWN.get(head) if head in IMPLICIT else None)) is not None:
        return ns + local
    return name


def compact(iri: str, prefixes: dict[str, str]) -> str:
    """``prefix:local`` by the longest namespace that the IRI starts with, else the IRI."""
    fits = [(len(ns), p) for p, ns in prefixes.items() if ns and iri.startswith(ns)]
    if not fits:
        return iri
    n, p = max(fits, key=lambda x: (x[0], -len(x[1]), x[1]))
    return f"{p}:{iri[n:]}"


def compact_column(iri: Column, prefixes: dict[str, str]) -> Column:
    """``compact`` of a column: namespaces are tried from the longest on."""
    out = iri
    for p, ns in sorted(prefixes.items(), key=lambda x: (len(x[1]), len(x[0]), x[0])):
        out = F.when(F.startswith(iri, F.lit(ns)), F.concat(F.lit(p + ":"), F.substring(iri, len(ns) + 1, 1 << 20))).otherwise(out)
    return out


def used(text: str) -> set[str]:
    """Prefixes that names in a text use."""
    return {p for p in CURIE.findall(re.sub(r"<[^>]*>", " ", text)) if p not in SCHEMES}


def normal_base(uri: str) -> str:
    """A base IRI with a scheme and a separator at its end."""
    uri = uri.strip()
    if "://" not in uri:
        uri = "http://" + uri
    return uri if uri[-1] in "/#" else uri + "/"


def host_prefix(uri: str) -> str:
    """A prefix named after a URI's host: the first label that is no ``www`` or common top-level name."""
    host = urlparse(normal_base(uri)).hostname or ""
    labels = [x for x in host.removeprefix("www.").split(".") if x not in {"com", "org", "net", "io", "eu"}]
    name = re.sub(r"[-_]", "", labels[0]) if labels else ""
    return name if name.isidentifier() else "base"
