"""Mapping documents: their form in memory, a lenient reader, a writer, and their relational form."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import yaml
from pyspark.sql import DataFrame, SparkSession

from trellis.functions.prefixes import RDF_TYPE, SCHEMES
from trellis.functions.terms import REFERENCE

TYPE_NAMES = {"a", "rdf:type", RDF_TYPE, f"<{RDF_TYPE}>"}


class MappingError(ValueError):
    pass


@dataclass(frozen=True)
class PO:
    """One predicate and object. ``kind``: type, iri (template), iri_reference, literal, const_iri, const_lit or join."""

    predicate: str
    object: str
    kind: str
    datatype: str | None = None
    lang: str | None = None
    child: str | None = None
    parent: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(REFERENCE.findall(self.object)))


@dataclass
class Mapping:
    name: str
    sources: list[str]
    subject: str
    po: list[PO] = field(default_factory=list)

    @property
    def classes(self) -> list[str]:
        return [x.object for x in self.po if x.kind == "type"]

    @property
    def columns(self) -> set[str]:
        return set(REFERENCE.findall(self.subject)) | {c for x in self.po for c in x.columns} | {x.child for x in self.po if x.child}


@dataclass
class MappingDoc:
    prefixes: dict[str, str] = field(default_factory=dict)
    mappings: dict[str, Mapping] = field(default_factory=dict)

    def copy(self) -> MappingDoc:
        return MappingDoc(dict(self.prefixes), {k: replace(m, sources=list(m.sources), po=list(m.po)) for k, m in self.mappings.items()})

    @property
    def columns(self) -> set[str]:
        return {c for m in self.mappings.values() for c in m.columns}


def repaired(text: str) -> str:
    """Text that YAML can read: fences go, templates and names that YAML would misread get quotes, URL keys lose brackets."""
    text = re.sub(r"(?m)^```[\w-]*\s*$", "", text)
    text = re.sub(r"(?m)^(\s*)<(https?://[^>]+)>\s*:", r'\1"\2":', text)
    text = re.sub(r"(?<![<\w])ex#(\w+)", r"ex:\1", text)
    return text


def _quoted(text: str) -> str:
    """Flow lists with bare templates or spaces in names, item by item in quotes."""

    def one(m: re.Match) -> str:
        items, depth, cur, quote = [], 0, "", ""
        for c in m[2]:
            if quote:
                quote = "" if c == quote else quote
                cur += c
            elif c in "\"'" and not cur.strip():
                quote = c
                cur += c
            elif c == "," and not depth:
                items.append(cur)
                cur = ""
            else:
                depth += (c in "({[") - (c in ")}]")
                cur += c
        items.append(cur)
        return m[1] + ", ".join(x.strip() if x.strip()[:1] in "\"'[{" else '"' + x.strip().replace('"', '\\"') + '"' for x in items if x.strip()) + m[3]

    return re.sub(r"(?m)^(\s*-\s*\[)(.*)(\]\s*)$", one, text)


def _braces(template: str, anyway: bool = True) -> str:
    """``{col}`` and ``{$(col)}`` as ``$(col)``."""
    template = re.sub(r"\{\s*\$\(([^)]+)\)\s*\}", r"$(\1)", template)
    return re.sub(r"(?<!\$)\{([^{}$]+)\}", r"$(\1)", template) if anyway else template


def _predicate(name: str) -> str:
    """Without surrounding brackets of a name; spaces and further colons become underscores."""
    name = name.strip()
    if name in TYPE_NAMES:
        return "a"
    if name.startswith("<") and name.endswith(">"):
        return name
    head, colon, local = name.partition(":")
    if colon and head not in SCHEMES:
        return f"{head}:" + re.sub(r"[\s:]+", "_", local)
    return name if "://" in name else re.sub(r"\s+", "_", name)


def entry(predicate: str, value: str, datatype: str | None = None, bare_iri: str = "iri") -> PO:
    """A predicate-object pair from a document's strings."""
    predicate, value = _predicate(predicate), str(value).strip()
    iri = value.endswith("~iri")
    value = value.removesuffix("~iri").strip()
    if datatype and iri:
        iri = False
    value = _braces(value, iri or not datatype)
    lang = None
    if datatype and (datatype.endswith("~lang") or re.fullmatch(r"@[A-Za-z-]+", datatype)):
        lang, datatype = datatype.removesuffix("~lang").lstrip("@"), None
    refs = REFERENCE.findall(value)
    if predicate == "a":
        return PO("a", value, "type")
    if iri:
        bare = re.fullmatch(r"\$\([^)]+\)", value)
        if bare and bare_iri == "literal":
            return PO(predicate, value, "literal", "xsd:string")
        return PO(predicate, value, "iri_reference" if bare else "iri" if refs else "const_iri")
    if refs and re.match(r"https?://", value) and not datatype:
        return PO(predicate, value, "iri")
    return PO(predicate, value, "literal" if refs else "const_lit", datatype, lang)


def _entries(items, bare_iri: str) -> list[PO]:
    out = []
    for x in items or []:
        if isinstance(x, dict) and ("p" in x or "predicates" in x):
            predicates, objects = x.get("p", x.get("predicates")), x.get("o", x.get("objects"))
            for p in predicates if isinstance(predicates, list) else [predicates]:
                for o in objects if isinstance(objects, list) else [objects]:
                    out += _entries([{p: o}] if isinstance(o, dict) else [[p, *o]] if isinstance(o, list) else [[p, o]], bare_iri)
        elif isinstance(x, dict):
            joins = x.get("joins") or x.get("join") or x.get("condition")
            for p, o in x.items():
                if p in ("joins", "join", "condition"):
                    continue
                if isinstance(o, dict):
                    if "mapping" in o:
                        c = o.get("condition") or o.get("joins") or {}
                        c = c[0] if isinstance(c, list) else c
                        pairs = [y[-1] if isinstance(y, list) else y for y in c.get("parameters", [])]
                        child, parent = (REFERENCE.sub(r"\1", str(y)) for y in pairs) if len(pairs) == 2 else (c.get("child"), c.get("parent"))
                        out.append(PO(_predicate(str(p)), str(o["mapping"]), "join", child=child, parent=parent))
                    else:
                        value = str(o.get("value", ""))
                        out.append(entry(str(p), value + ("~iri" if o.get("type") == "iri" and not value.endswith("~iri") else ""), o.get("datatype"), bare_iri))
                else:
                    out += _entries([[p, *o]] if isinstance(o, list) else [[p, o]], bare_iri)
                    if joins and out:
                        j = joins[0] if isinstance(joins, list) else joins
                        out[-1] = PO(out[-1].predicate, out[-1].object, "join", child=str(j["child"]), parent=str(j["parent"]))
        elif isinstance(x, (list, tuple)):
            if len(x) == 1 and isinstance(x[0], (list, tuple, dict)):
                out += _entries(x, bare_iri)
                continue
            # A colon and a space in a bare name have made it a pair.
            x = [f"{k}: {v}" if isinstance(y, dict) and len(y) == 1 and not isinstance(v := next(iter(y.values())), (dict, list)) and (k := next(iter(y))) not in ("joins", "child", "parent") else y for y in x]  # noqa: PLW2901
            j = next((y for y in x if isinstance(y, dict)), None)
            rest = [str(y) for y in x if not isinstance(y, dict) and y is not None]
            if j is not None and len(rest) == 2:
                j = j.get("joins", j)
                j = j[0] if isinstance(j, list) else j
                out.append(PO(_predicate(rest[0]), rest[1].removesuffix("~iri"), "join", child=str(j["child"]), parent=str(j["parent"])))
            elif len(rest) >= 2:
                out.append(entry(rest[0], rest[1], rest[2] if len(rest) > 2 else None, bare_iri))
            else:
                raise MappingError(f"no pair of predicate and object: {x!r}")
        elif isinstance(x, str) and ": " in x:
            out.append(entry(*x.split(": ", 1), bare_iri=bare_iri))
        else:
            raise MappingError(f"no pair of predicate and object: {x!r}")
    return out


def _sources(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    if isinstance(x, dict):
        return [str(x.get("access", "")) + "~" + str(x.get("referenceFormulation", "csv"))]
    out = []
    for y in x:
        out += [str(y[0])] if isinstance(y, (list, tuple)) and y and not isinstance(y[0], (list, dict)) else _sources(y)
    return out


def parse(text: str, bare_iri: str = "iri") -> MappingDoc:
    """A document from YAML in any of the accepted shapes.

    ``bare_iri``: what a column alone with ``~iri`` is, an ``iri`` or a ``literal``. Raises
    MappingError if the text is no mapping document.
    """
    text = repaired(text)
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        try:
            data = yaml.safe_load(_quoted(text))
        except yaml.YAMLError as e:
            raise MappingError(f"no YAML: {e}") from None
    if not isinstance(data, dict) or not isinstance(data.get("mappings"), dict):
        raise MappingError("there are no mappings")
    prefixes = {}
    for k, v in (data.get("prefixes") or {}).items():
        if isinstance(v, str) and "://" not in str(k):
            prefixes[str(k).rstrip(":")] = v.strip().strip("<>")
    shared = {k: _sources([v]) for k, v in (data.get("sources") or {}).items()} if isinstance(data.get("sources"), dict) else {}
    doc = MappingDoc(prefixes)
    for name, m in data["mappings"].items():
        if not isinstance(m, dict):
            raise MappingError(f"{name} is no mapping")
        s = m.get("s", m.get("subjects", m.get("subject")))
        if s is None:
            raise MappingError(f"{name} has no subject")
        s = "".join(map(str, s)) if isinstance(s, list) else str(s)
        sources = [y for x in _sources(m.get("sources", m.get("source"))) for y in shared.get(x, [x])]
        po = _entries(m.get("po", m.get("predicateobjects", [])), bare_iri)
        doc.mappings[str(name)] = Mapping(str(name), sources, _braces(s.strip().removesuffix("~iri")).strip("<>"), po)
    return doc


def dump(doc: MappingDoc) -> str:
    """YAML text; ``parse`` gives the same document back."""
    q = lambda s: s if re.fullmatch(r"[\w$():/.#~-]+", s) and not s.endswith(":") and s not in ("a", "true", "false", "null") else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = ["prefixes:", *(f'  {p}: "{u}"' for p, u in doc.prefixes.items()), "", "mappings:"]
    for m in doc.mappings.values():
        lines += [f"  {m.name}:", "    sources:", *(f"      - [{q(s)}]" for s in m.sources), f"    s: {q(m.subject)}", "    po:"]
        for x in m.po:
            if x.kind == "join":
                lines.append(f"      - [{q(x.predicate)}, {q(x.object + '~iri')}, {{joins: {{child: {q(x.child)}, parent: {q(x.parent)}}}}}]")
                continue
            parts = ["a" if x.kind == "type" else q(x.predicate), q(x.object + "~iri" * (x.kind in ("iri", "iri_reference", "const_iri")))]
            parts += [q(x.datatype)] if x.datatype else [q(x.lang + "~lang")] if x.lang else []
            lines.append(f"      - [{', '.join(parts)}]")
        lines.append("")
    return "\n".join(lines)


def mapping_frame(spark: SparkSession, doc: MappingDoc) -> DataFrame:
    rows = [(m.name, s, m.subject, (m.classes or [None])[0]) for m in doc.mappings.values() for s in m.sources or [None]]
    return spark.createDataFrame(rows, "name string, source string, subject_template string, class string")


def po_frame(spark: SparkSession, doc: MappingDoc) -> DataFrame:
    rows = [(m.name, i, x.predicate, x.object, x.kind, x.datatype, list(x.columns)) for m in doc.mappings.values() for i, x in enumerate(m.po)]
    return spark.createDataFrame(rows, "mapping string, ord int, predicate string, object_template string, kind string, datatype string, columns array<string>")


def summary(doc: MappingDoc) -> str:
    """Names, subjects, classes and predicates, a mapping a line."""
    return "\n".join(f"{m.name}: {m.subject} a {', '.join(m.classes) or '-'}; {', '.join(x.predicate for x in m.po if x.kind != 'type')}" for m in doc.mappings.values())
