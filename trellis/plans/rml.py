"""Mapping documents as RML, for other engines."""

from __future__ import annotations

import re

from trellis.functions.prefixes import RDF_TYPE, WELL_KNOWN, expand
from trellis.functions.terms import REFERENCE
from trellis.plans.mapping import PO, MappingDoc

#: Vocabularies of an RML document.
VOCABULARIES = {"rr": WELL_KNOWN["rr"], "rml": WELL_KNOWN["rml"], "ql": WELL_KNOWN["ql"], "xsd": WELL_KNOWN["xsd"]}
FORMULATIONS = {"csv": "ql:CSV", "json": "ql:JSONPath", "xml": "ql:XPath"}


def _text(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _template(text: str, prefixes: dict[str, str]) -> str:
    """A template with references in braces; braces of its own are escaped."""
    out, at = "", 0
    text = expand(text, prefixes)
    for m in REFERENCE.finditer(text):
        out += re.sub(r"([{}])", r"\\\1", text[at : m.start()]) + "{" + m[1] + "}"
        at = m.end()
    return _text(out + re.sub(r"([{}])", r"\\\1", text[at:]))


def _object(x: PO, doc: MappingDoc, name: str) -> list[str]:
    if x.kind == "join":
        return [f"rr:parentTriplesMap <#{x.object}>", f"rr:joinCondition [ rr:child {_text(x.child)} ; rr:parent {_text(x.parent)} ]"]
    if x.kind in ("type", "const_iri"):
        return [f"rr:constant <{expand(x.object, doc.prefixes)}>"]
    if x.kind == "const_lit":
        parts = [f"rr:constant {_text(x.object)}"]
    elif x.kind == "iri_reference":
        return [f"rml:reference {_text(x.columns[0])}", "rr:termType rr:IRI"]
    elif x.kind == "iri":
        return [f"rr:template {_template(x.object, doc.prefixes)}", "rr:termType rr:IRI"]
    elif re.fullmatch(r"\$\([^)]+\)", x.object):
        parts = [f"rml:reference {_text(x.columns[0])}"]
    else:
        parts = [f"rr:template {_template(x.object, {})}", "rr:termType rr:Literal"]
    if x.datatype:
        parts.append(f"rr:datatype <{expand(x.datatype, doc.prefixes)}>")
    elif x.lang:
        parts.append(f"rr:language {_text(x.lang)}")
    return parts


def to_rml(doc: MappingDoc) -> str:
    """A Turtle document with a triples map for each mapping and source."""
    lines = [f"@prefix {p}: <{u}> ." for p, u in VOCABULARIES.items()] + [""]
    for m in doc.mappings.values():
        for i, source in enumerate(m.sources):
            path, _, form = source.partition("~")
            lines += [f"<#{m.name}{i or ''}> a rr:TriplesMap ;", f"  rml:logicalSource [ rml:source {_text(path)} ; rml:referenceFormulation {FORMULATIONS.get(form, 'ql:CSV')} ] ;", f"  rr:subjectMap [ rr:template {_template(m.subject, doc.prefixes)} ] ;"]
            for x in m.po:
                p = RDF_TYPE if x.kind == "type" else expand(x.predicate, doc.prefixes)
                lines.append(f"  rr:predicateObjectMap [ rr:predicateMap [ rr:constant <{p}> ] ; rr:objectMap [ {' ; '.join(_object(x, doc, m.name))} ] ] ;")
            lines[-1] = lines[-1].removesuffix(" ;") + " ."
            lines.append("")
    return "\n".join(lines)
