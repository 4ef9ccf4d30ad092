"""Competency questions: made from a mapping, run as ASK queries, tallied and diagnosed."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.prefixes import RDF_TYPE, XSD, compact, expand
from trellis.operators.matching import THRESHOLD, score
from trellis.plans import sparql
from trellis.plans.mapping import PO, Mapping, MappingDoc
from trellis.plans.rules import _base, primary
from trellis.sources.ontology import Ontology

RESULT = "cq string, sparql string, passed boolean, diagnosis string, source string"


def questions_of(doc: MappingDoc) -> list[tuple[str, str]]:
    """Question and ASK query of each class, attribute and link."""
    head = "".join(f"PREFIX {p}: <{u}>\n" for p, u in doc.prefixes.items())
    target = {_base(m.subject): m for m in doc.mappings.values()}
    local = lambda n: re.split(r"[:/#]", n)[-1]
    out = []
    for m in doc.mappings.values():
        if not m.classes:
            continue
        cls = m.classes[0]
        out.append((f"Which instances of {local(cls)} are there?", f"{head}ASK {{ ?s a {cls} . }}"))
        for x in m.po:
            if x.kind == "literal":
                out.append((f"What is the {local(x.predicate)} of a {local(cls)}?", f"{head}ASK {{ ?s a {cls} ; {x.predicate} ?v . }}"))
            elif x.kind in ("iri", "join") and (t := target.get(_base(x.object)) or doc.mappings.get(x.object)) and t.classes:
                out.append((f"Which {local(t.classes[0])} has a {local(cls)} by {local(x.predicate)}?", f"{head}ASK {{ ?s a {cls} ; {x.predicate} ?o . ?o a {t.classes[0]} . }}"))
    return out


def numbered(text: str) -> list[str]:
    """Questions of a numbered list: lines of more than ten characters that begin with a capital."""
    lines = [re.sub(r"^\d+[.)]\s*", "", x.strip()) for x in text.splitlines()]
    return [x for x in lines if len(x) > 10 and x[0].isupper()]


def merged(own: list[str], made: list[str]) -> list[str]:
    """The user's questions and then the others, each once."""
    return list(dict.fromkeys(own + made))


def probe(triples: DataFrame, classes: int = 40, predicates: int = 60) -> tuple[DataFrame, DataFrame]:
    """The first classes and predicates of a graph, in order."""
    c = triples.where(F.col("p") == RDF_TYPE).select(F.col("o").alias("class")).distinct().orderBy("class").limit(classes)
    return c, triples.select(F.col("p").alias("predicate")).distinct().orderBy("predicate").limit(predicates)


def diagnose(query: str, triples: DataFrame, prefixes: dict[str, str] | None = None) -> str:
    """Why an ASK is false: a type without instances, else the pattern that isn't met."""
    body = query[query.find("{") + 1 : query.rfind("}")].strip()
    q = sparql.parse(query, prefixes)
    for part in q.where.parts:
        if part[0] == "triple" and isinstance(part[2], sparql.Path) and part[2].parts[0] == RDF_TYPE and isinstance(part[3], sparql.Const):
            if triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == part[3].text[1:-1])).isEmpty():
                return f"no instance of {part[3].text}"
    return f"ASK returned false. Missing: {body}"


def run_questions(questions: list[tuple[str, str]], triples: DataFrame, prefixes: dict[str, str] | None = None, source: str = "generated_cq") -> list[dict]:
    """A result for each question: passed is None for a query that can't be read."""
    out = []
    for cq, query in questions:
        passed = sparql.ask(query, triples, prefixes)
        out.append({"cq": cq, "sparql": query, "passed": passed, "diagnosis": diagnose(query, triples, prefixes) if passed is False else None, "source": source})
    return out


def accept(results: list[dict], threshold: float = 0.7, go_on: Callable[[int, int], bool] | None = None) -> bool:
    """Whether the graph stands as it is.

    It does if no question is answered by no, or if at most one is and twice as many can't be
    read: then the queries are at fault. With the threshold's share passed, it does unless
    ``go_on(passed, total)`` asks for another try.
    """
    n = len(results)
    passed, errors = sum(r["passed"] is True for r in results), sum(r["passed"] is None for r in results)
    failed = n - passed - errors
    if failed == 0 or (failed == 1 and errors >= 2):
        return True
    return passed >= threshold * n and not (go_on and go_on(passed, n))


@dataclass(frozen=True)
class Demand:
    """What a question asks of a subject: its class, a predicate, and the class of that one's object; None where it doesn't say."""

    cls: str | None
    predicate: str | None = None
    target: str | None = None


def demands(query: str, prefixes: dict[str, str] | None = None) -> list[Demand]:
    """The demands of a query's triple patterns, those of classes first; patterns with paths or variables as predicates make none."""
    parts = [x[1:4] for x in sparql.parse(query, prefixes).where.parts if x[0] == "triple"]
    plain = [(s, p.parts[0], o) for s, p, o in parts if isinstance(p, sparql.Path) and p.op == "iri"]
    types = {s: o.text[1:-1] for s, p, o in plain if p == RDF_TYPE and isinstance(o, sparql.Const)}
    return [Demand(c) for c in dict.fromkeys(types.values())] + [Demand(types.get(s), p, types.get(o)) for s, p, o in plain if p != RDF_TYPE]


def repaired(doc: MappingDoc, failed: list[str], ontology: Ontology, columns: list[str]) -> MappingDoc:
    """The document with the classes and entries that failed queries ask for, and that it lacks.

    A class goes to the mapping that states most of what the query asks of it. A predicate
    becomes a link where its object has a class with a mapping of the same source, else a
    literal of the column that fits its name best; an entry of that column under a name that
    the ontology doesn't have gives way. What nothing fits is left out.
    """
    doc = doc.copy()
    names = {**ontology.prefixes, **doc.prefixes}
    known = {p.uri: p for p in ontology.properties}
    full = lambda n: expand(n, names)

    def name(uri: str) -> str:
        short = compact(uri, names)
        if (p := short.partition(":")[0]) in names and short != uri:
            doc.prefixes.setdefault(p, names[p])
        return short

    def states(m: Mapping) -> set[str]:
        return {full(x.predicate) for x in m.po if x.kind != "type"}

    def of(cls: str) -> Mapping | None:
        return next((m for m in doc.mappings.values() if cls in map(full, m.classes)), None)

    for query in failed:
        asked = demands(query, names)
        for d in asked:
            m = of(d.cls) if d.cls else primary(doc)
            if d.predicate is None:
                wanted = {x.predicate for x in asked if x.cls == d.cls and x.predicate}
                fits = max(doc.mappings.values(), key=lambda m: len(wanted & states(m)), default=None)  # noqa: B023
                if m is None and fits and (wanted & states(fits) or len(doc.mappings) == 1):
                    fits.po.insert(0, PO("a", name(d.cls), "type"))
            elif m is not None and d.predicate not in states(m):
                entry, column = None, None
                to = of(d.target) if d.target else None
                if to and to is not m and set(to.sources) & set(m.sources):
                    entry = PO(name(d.predicate), to.subject, "iri")
                elif not d.target:
                    prop, local = known.get(d.predicate), re.split(r"[/#]", d.predicate)[-1]
                    s, _, column = max(((score(c, local, prop and prop.label), -i, c) for i, c in enumerate(columns)), default=(0, 0, None))
                    if s >= THRESHOLD:
                        kind = ontology.name(prop.range) if prop and prop.range and prop.range.startswith(XSD) else None
                        entry = PO(name(d.predicate), f"$({column})", "literal", kind)
                if entry:
                    m.po = [x for x in m.po if not (entry.kind == x.kind == "literal" and x.columns == (column,) and full(x.predicate) not in known)] + [entry]
    return doc
