"""Rewrites of mapping documents, and the batch that runs them to a fixed point.

A rule takes and gives a document and notes what it did. They work on the document's
form in memory, so none can lose another's prefixes or undo its quoting.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from trellis.functions.prefixes import IMPLICIT, SCHEMES, WELL_KNOWN, host_prefix, normal_base
from trellis.functions.terms import INJECTED, REFERENCE, camel, fallback
from trellis.plans.mapping import PO, Mapping, MappingDoc, dump

#: Prefixes that name structure, not a domain.
STRUCTURAL = frozenset({"rdf", "rdfs", "owl", "xsd", "rr", "rml", "ql", "sh"})


@dataclass
class Context:
    """What rules may know besides the document."""

    columns: list[str] | None = None
    empty_columns: set[str] = field(default_factory=set)
    ontology_prefixes: dict[str, str] = field(default_factory=dict)
    classes: set[str] = field(default_factory=set)
    base_uri: str | None = None
    #: Also link entity types that nothing connects within one source.
    wire_single_source: bool = False
    notes: list[str] = field(default_factory=list)

    def note(self, rule: str, text: str) -> None:
        self.notes.append(f"{rule}: {text}")


Rule = Callable[[MappingDoc, Context], MappingDoc]


def names_of(doc: MappingDoc) -> list[str]:
    """All names in a document that may have a prefix."""
    out = []
    for m in doc.mappings.values():
        out.append(m.subject)
        for x in m.po:
            out += [x.predicate] if x.kind != "type" else []
            out += [x.object] if x.kind in ("type", "iri", "const_iri") else []
            out += [x.datatype] if x.datatype else []
    return out


def prefix_of(name: str) -> str | None:
    head, colon, rest = name.partition(":")
    return head if colon and re.fullmatch(r"[A-Za-z_][\w-]*", head) and head not in SCHEMES and not rest.startswith("//") else None


def used_prefixes(doc: MappingDoc) -> set[str]:
    return {p for n in names_of(doc) if (p := prefix_of(n))}


def missing_prefixes(doc: MappingDoc) -> set[str]:
    return used_prefixes(doc) - set(doc.prefixes) - IMPLICIT


def _each(doc: MappingDoc, f: Callable[[Mapping], list[PO]]) -> MappingDoc:
    for m in doc.mappings.values():
        m.po = f(m)
    return doc


def canonical_prefixes(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """Well-known prefixes have their well-known namespaces."""
    for p, uri in doc.prefixes.items():
        known = WELL_KNOWN.get(p)
        if known and uri != known and p != "ex" and uri.rstrip("/#").split("://")[-1] == known.rstrip("/#").split("://")[-1]:
            doc.prefixes[p] = known
            ctx.note("canonical_prefixes", p)
    return doc


def add_prefixes(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """Prefixes in use are declared: as the ontology has them, else as they are known, else below example.org."""
    for p in sorted(missing_prefixes(doc)):
        doc.prefixes[p] = ctx.ontology_prefixes.get(p) or WELL_KNOWN.get(p) or f"http://example.org/{p}#"
        ctx.note("add_prefixes", p)
    return doc


def drop_prefixes(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """Prefixes without use go."""
    keep = used_prefixes(doc)
    for p in [p for p in doc.prefixes if p not in keep and p not in IMPLICIT]:
        del doc.prefixes[p]
        ctx.note("drop_prefixes", p)
    return doc


def example_subjects(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """Subjects below http://example.com/ get the shortest domain prefix."""
    domain = [p for p in doc.prefixes if p not in STRUCTURAL]
    if domain:
        best = min(domain, key=lambda p: (len(p), p))
        for m in doc.mappings.values():
            if m.subject.startswith("http://example.com/"):
                m.subject = f"{best}:{m.subject[len('http://example.com/') :]}"
                ctx.note("example_subjects", m.name)
    return doc


def source_names(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """A source says its format."""
    for m in doc.mappings.values():
        m.sources = list(dict.fromkeys(s if "~" in s else s + "~csv" for s in m.sources))
    return doc


def real_columns(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """References have the source's spelling of its columns."""
    if not ctx.columns:
        return doc
    plain = lambda s: re.sub(r"[^a-zA-Z0-9_]", "_", s)
    alias = {plain(c): c for c in ctx.columns if plain(c) != c}
    fix = lambda t: REFERENCE.sub(lambda m: f"$({m[1] if m[1] in ctx.columns else alias.get(plain(m[1]), m[1])})", t)
    for m in doc.mappings.values():
        m.subject = fix(m.subject)
    return _each(doc, lambda m: [replace(x, object=fix(x.object)) for x in m.po])


def prefixed_predicates(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """A predicate without prefix gets the first that names a domain."""
    first = next((p for p in doc.prefixes if p not in STRUCTURAL), "ex")
    fix = lambda x: x if x.kind == "type" or prefix_of(x.predicate) or "://" in x.predicate else replace(x, predicate=f"{first}:{x.predicate}")
    return _each(doc, lambda m: [fix(x) for x in m.po])


def exact_duplicates(doc: MappingDoc, ctx: Context) -> MappingDoc:
    return _each(doc, lambda m: list(dict.fromkeys(m.po)))


def one_entry_a_predicate(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """Of entries with one predicate and the same columns, the first IRI stays, else the last literal."""

    def f(m: Mapping) -> list[PO]:
        groups: dict[tuple, list[PO]] = {}
        for x in m.po:
            key = (x.predicate, x.columns) if x.kind != "type" and x.columns else (x.predicate, x.object, x.kind)
            groups.setdefault(key, []).append(x)
        keep = {id(next((x for x in g if x.kind in ("iri", "iri_reference", "join")), g[-1])) for g in groups.values()}
        return [x for x in m.po if id(x) in keep]

    return _each(doc, f)


def duplicate_predicates(doc: MappingDoc) -> list[tuple[str, str, list[str]]]:
    """Mapping, predicate and columns where one predicate takes several columns."""
    out = []
    for m in doc.mappings.values():
        by: dict[str, list[str]] = {}
        for x in m.po:
            if x.kind != "type":
                by.setdefault(x.predicate, []).extend(c for c in x.columns if c not in by.get(x.predicate, []))
        out += [(m.name, p, cs) for p, cs in by.items() if len(cs) > 1 and sum(x.predicate == p for x in m.po) > 1]
    return out


def rename_duplicates(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """Every further column of a predicate gets one of its own name."""
    for name, p, cs in duplicate_predicates(doc):
        m, head = doc.mappings[name], p.partition(":")[0]
        taken, seen, out = {x.predicate for x in m.po}, False, []
        for x in m.po:
            if x.predicate == p and seen and x.columns:
                own = f"{head}:{camel(re.sub(r'[^a-zA-Z0-9_]', '_', x.columns[0]))}"
                own = own if own not in taken else f"{head}:has{own.partition(':')[2][:1].upper()}{own.partition(':')[2][1:]}"
                taken.add(own)
                ctx.note("rename_duplicates", f"{name} {p} -> {own}")
                x = replace(x, predicate=own)  # noqa: PLW2901
            seen |= x.predicate == p
            out.append(x)
        m.po = out
    return doc


def primary(doc: MappingDoc) -> Mapping | None:
    """The mapping with most entries from columns; of several the one with the least name."""
    return min(doc.mappings.values(), key=lambda m: (-sum(bool(x.columns) and x.kind != "iri" for x in m.po), m.name), default=None)


def redundancies(doc: MappingDoc) -> dict[tuple[str, str], list[str]]:
    """Predicate and column that several mappings of one class state."""
    by: dict[tuple[str, str], list[str]] = {}
    for m in doc.mappings.values():
        for x in m.po:
            if x.kind == "literal" and len(x.columns) == 1:
                by.setdefault((x.predicate, x.columns[0]), []).append(m.name)
    return {k: v for k, v in by.items() if len(v) > 1 and len({tuple(doc.mappings[n].classes) for n in v}) < len(v)}


def single_owner(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """A statement of several mappings stays where the column names the subject, else where the class is in the predicate, else away from the primary mapping."""
    main = primary(doc)
    for (p, c), names in redundancies(doc).items():
        key = lambda n: (c not in REFERENCE.findall(doc.mappings[n].subject), not any(k.split(":")[-1].lower() in p.lower() for k in doc.mappings[n].classes), n == main.name, n)  # noqa: E731, B023
        for n in set(names) - {min(names, key=key)}:
            doc.mappings[n].po = [x for x in doc.mappings[n].po if not (x.predicate == p and x.columns == (c,) and x.kind == "literal")]
            ctx.note("single_owner", f"{n} {p} {c}")
    return doc


def invalid_classes(doc: MappingDoc, ctx: Context) -> list[str]:
    """Classes in use that the ontology hasn't."""
    return sorted({c for m in doc.mappings.values() for c in m.classes} - ctx.classes) if ctx.classes else []


def metadata_classes(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """A mapping whose subject ends in /Metadata has a class of that name."""
    for m in doc.mappings.values():
        if m.subject.endswith("/Metadata"):
            m.po = [replace(x, object=x.object + "Metadata") if x.kind == "type" and not x.object.endswith("Metadata") else x for x in m.po]
    return doc


def _base(template: str) -> str:
    t = re.sub(r"\$\([^)]*\)", "", template)
    t = t.partition(":")[2] if prefix_of(t) else t
    return re.sub(r"/{2,}", "/", t).rstrip("_/").strip("/")


def islands(doc: MappingDoc, single_source: bool = False) -> list[str]:
    """Mappings that neither link to another nor are linked to; only asked of several mappings of several sources."""
    if len(doc.mappings) < 2 or (len({s for m in doc.mappings.values() for s in m.sources}) < 2 and not single_source):
        return []
    linked: set[str] = set()
    for m in doc.mappings.values():
        for other in doc.mappings.values():
            if m is not other and any((x.kind == "join" and x.object == other.name) or (x.kind == "iri" and _base(x.object) == _base(other.subject)) for x in m.po):
                linked |= {m.name, other.name}
    return [n for n in doc.mappings if n not in linked]


def wire_islands(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """The primary mapping links to islands of its own source."""
    main = primary(doc)
    for n in islands(doc, ctx.wire_single_source):
        m = doc.mappings[n]
        if m is not main and set(m.sources) & set(main.sources) and REFERENCE.search(m.subject):
            own = f"ex:has{n.removesuffix('Mapping')}"
            main.po.append(PO(own, m.subject, "iri"))
            ctx.note("wire_islands", f"{main.name} {own}")
    return doc


def drop_phantoms(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """Mappings that state nothing but a type, and that nothing links to, go."""
    linked = {_base(x.object) for m in doc.mappings.values() for x in m.po if x.kind == "iri"} | {x.object for m in doc.mappings.values() for x in m.po if x.kind == "join"}
    for n, m in list(doc.mappings.items()):
        if len(doc.mappings) > 1 and all(x.kind == "type" for x in m.po) and _base(m.subject) not in linked and n not in linked:
            del doc.mappings[n]
            ctx.note("drop_phantoms", n)
    return doc


def uncovered(doc: MappingDoc, ctx: Context) -> list[str]:
    """Columns without use, but for empty ones."""
    return [c for c in ctx.columns or [] if c not in doc.columns and c not in ctx.empty_columns]


def add_columns(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """Columns without use become literals of the primary mapping, or of one whose name has their first six letters (five, if they have no more)."""
    main = primary(doc)
    for c in uncovered(doc, ctx) if main else []:
        start = c.lower().replace("_", "")[:6]
        named = (m for m in doc.mappings.values() if len(start) >= 5 and start in m.name.lower().replace("_", "").replace("mapping", ""))
        to = next((m for m in named if m is not main), main)
        clean = re.sub(r"[^a-zA-Z0-9_]", "_", c)
        predicate, datatype = fallback(clean, INJECTED)
        if any(x.predicate == predicate for x in to.po):
            predicate = f"ex:{camel(clean)}"
        to.po.append(PO(predicate, f"$({c})", "literal", datatype))
        ctx.note("add_columns", f"{c} -> {to.name} {predicate}")
    return doc


def rebase(doc: MappingDoc, ctx: Context) -> MappingDoc:
    """Subjects, and links to them, stand below the base IRI, whose prefix is named after its host."""
    if not ctx.base_uri:
        return doc
    base = normal_base(ctx.base_uri)
    p = next((k for k, v in doc.prefixes.items() if v == base), host_prefix(base))
    doc.prefixes[p] = base
    bases = {_base(m.subject) for m in doc.mappings.values()}

    def fix(t: str) -> str:
        if prefix_of(t):
            return f"{p}:{t.partition(':')[2]}"
        if "://" in t:
            return f"{p}:{t.split('://', 1)[1].partition('/')[2]}"
        return f"{p}:{t}"

    for m in doc.mappings.values():
        m.po = [replace(x, object=fix(x.object)) if x.kind == "iri" and _base(x.object) in bases else x for x in m.po]
        m.subject = fix(m.subject)
    return doc


def add_links(doc: MappingDoc, links: list[tuple[str, PO]]) -> MappingDoc:
    """Entries for named mappings; one that is there already isn't added again."""
    for name, x in links:
        if name in doc.mappings and x not in doc.mappings[name].po:
            doc.mappings[name].po.append(x)
    return doc


def literal_to_iri(doc: MappingDoc, predicates: set[str], ctx: Context) -> MappingDoc:
    """Literals of the given predicates become IRIs below ex:, for shapes that want nodes."""
    fix = lambda x: PO(x.predicate, f"ex:{x.predicate.split(':')[-1]}/{x.object}", "iri") if x.kind == "literal" and x.predicate in predicates and x.columns else x
    return _each(doc, lambda m: [fix(x) for x in m.po])


def multi_node(doc: MappingDoc) -> bool:
    return len({c for m in doc.mappings.values() for c in m.classes}) > 1


def distribution(doc: MappingDoc) -> dict[str, list[str]]:
    """Columns by mapping, and under "identifier" the one most used in subjects."""
    keys = Counter(c for m in doc.mappings.values() for c in REFERENCE.findall(m.subject))
    best = max(keys, key=lambda c: (keys[c], c)) if keys else None
    return {m.name: sorted(m.columns) for m in doc.mappings.values()} | {"identifier": [best] if best else []}


BATCH: tuple[Rule, ...] = (
    source_names, canonical_prefixes, real_columns, prefixed_predicates, example_subjects, metadata_classes, exact_duplicates, one_entry_a_predicate,
    rename_duplicates, single_owner, wire_islands, drop_phantoms, add_columns, rebase, add_prefixes, drop_prefixes,
)


def normalize(doc: MappingDoc, ctx: Context | None = None, batch: tuple[Rule, ...] = BATCH, rounds: int = 10) -> MappingDoc:
    """The batch over and over until nothing changes."""
    ctx, doc = ctx or Context(), doc.copy()
    for _ in range(rounds):
        before = doc.copy()
        for rule in batch:
            doc = rule(doc, ctx)
        if doc == before:
            break
    return doc


def check(doc: MappingDoc, ctx: Context | None = None) -> dict[str, list]:
    """What is wrong with a document, by check; all lists are empty if nothing is."""
    ctx = ctx or Context()
    return {
        "missing_prefixes": sorted(missing_prefixes(doc)),
        "duplicate_predicates": duplicate_predicates(doc),
        "redundancies": sorted(redundancies(doc)),
        "islands": islands(doc),
        "uncovered": uncovered(doc, ctx),
        "invalid_classes": invalid_classes(doc, ctx),
    }


#: The rule that mends what a check finds. Classes that the ontology lacks are only reported.
REPAIRS: dict[str, Rule] = {
    "missing_prefixes": add_prefixes,
    "duplicate_predicates": rename_duplicates,
    "redundancies": single_owner,
    "islands": wire_islands,
    "uncovered": add_columns,
}


def fingerprint(doc: MappingDoc) -> str:
    return hashlib.md5(dump(doc).encode()).hexdigest()


def repaired(doc: MappingDoc, ctx: Context | None = None, limit: int = 6) -> tuple[MappingDoc, dict[str, list], int]:
    """The document after repairs, what is still wrong with it, and how many repairs there were.

    Each round the first failed check whose rule leads to a document that wasn't there before
    has its way, so repairs that undo each other end as well as those that change nothing.
    """
    ctx = ctx or Context()
    seen, found = {fingerprint(doc)}, check(doc, ctx)
    for rounds in range(limit):
        for rule in (r for name, r in REPAIRS.items() if found[name]):
            fixed = rule(doc.copy(), ctx)
            if (f := fingerprint(fixed)) not in seen:
                break
        else:
            return doc, found, rounds
        seen.add(f)
        doc, found = fixed, check(fixed, ctx)
    return doc, found, limit
