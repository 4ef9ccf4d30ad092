"""Compiles a mapping document to one Catalyst plan that makes its triples.

All mappings of a source share one scan: a row becomes an array of terms, which is
inlined. Equal triples go in one aggregation at the end. A link to another mapping by a
join is a join only if it has to be: where both mappings read one source by the same key,
and the target's subject needs nothing else, it is a template.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.prefixes import RDF_TYPE, expand
from trellis.functions.terms import COLUMNS, REFERENCE, TRIPLE, datatype_name, iri_safe, lexical
from trellis.plans.mapping import PO, Mapping, MappingDoc, MappingError

PIECE = re.compile(r"\$\(([^)]+)\)")
#: Functions that a template may name as ``$(f:column)``; see ``register_term_function``.
FUNCTIONS: dict[str, object] = {}


def register_term_function(name: str, f) -> None:
    """Makes ``f``, from column to column, usable in references: ``$(name:column)``."""
    FUNCTIONS[name] = f


def resolve(df: DataFrame, name: str) -> str:
    """The column that a reference means: as spelled, else regardless of case and special signs."""
    if name in df.columns:
        return name
    plain = lambda s: re.sub(r"[^a-zA-Z0-9_]", "_", s).lower()
    found = [c for c in df.columns if plain(c) == plain(name)]
    if len(found) != 1:
        raise MappingError(f"the source has no column {name}")
    return found[0]


def value(df: DataFrame, name: str) -> Column:
    """A column's lexical form, null where it is empty."""
    head, colon, rest = name.partition(":")
    if colon and head in FUNCTIONS and name not in df.columns:
        return FUNCTIONS[head](value(df, rest))
    c = resolve(df, name)
    return lexical(F.col(f"`{c}`"), df.schema[c].dataType)


def template(df: DataFrame, text: str, encode: bool) -> Column:
    """Text with references filled in; null if any of them is."""
    parts, at = [], 0
    for m in PIECE.finditer(text):
        if m.start() > at:
            parts.append(F.lit(text[at : m.start()]))
        v = value(df, m[1])
        parts.append(iri_safe(v) if encode else v)
        at = m.end()
    if at < len(text):
        parts.append(F.lit(text[at:]))
    return F.concat(*parts) if parts else F.lit("")


def _iri(df: DataFrame, text: str, prefixes: dict[str, str]) -> Column:
    if re.fullmatch(r"\$\([^)]+\)", text):
        v = value(df, text[2:-1])
        return F.when(v.rlike(r'^[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>"{}|^`\\]*$'), v)
    return template(df, expand(text, prefixes), True)


def _object(df: DataFrame, x: PO, prefixes: dict[str, str]) -> tuple[Column, str, str | None]:
    if x.kind in ("type", "const_iri", "iri", "iri_reference"):
        return _iri(df, x.object, prefixes), "iri", None
    d = datatype_name(expand(x.datatype, prefixes) if x.datatype else None)
    return template(df, x.object, False), "lit", d


def _row(s: Column, p: str, o: Column, kind: str, datatype: str | None, lang: str | None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), (F.lit(datatype) if datatype else null).alias("o_datatype"), (F.lit(lang) if lang else null).alias("o_lang"))


def _predicate(x: PO, prefixes: dict[str, str]) -> str:
    return RDF_TYPE if x.kind == "type" else expand(x.predicate, prefixes)


def find_source(sources: dict[str, DataFrame], name: str) -> DataFrame:
    """The table that a mapping's source means: by its whole name, its file's name, or that without extension."""
    plain = name.split("~")[0]
    tail = plain.rsplit("/", 1)[-1]
    for key in (name, plain, tail, tail.rsplit(".", 1)[0]):
        if key in sources:
            return sources[key]
    raise MappingError(f"no source {name}")


def link_template(doc: MappingDoc, m: Mapping, x: PO) -> str | None:
    """The template that a join on one source's own key comes to, or None."""
    target = doc.mappings.get(x.object)
    if target and set(m.sources) == set(target.sources) and x.child == x.parent and set(REFERENCE.findall(target.subject)) <= {x.parent}:
        return target.subject
    return None


def compile_mapping(doc: MappingDoc, sources: dict[str, DataFrame], distinct: bool = True, apart: bool = False) -> DataFrame:
    """The triples of a document over its sources, as a set unless ``distinct`` is off.

    All predicates of a source come from one scan, or with ``apart`` each from one of its own:
    for plans that look up few predicates, as a filter on ``p`` then drops the other scans, and
    a filter on a term reaches its column. A term with a null or empty value is none, and makes no triple.
    """
    scans: dict[int, tuple[DataFrame, list[Column]]] = {}
    joined: list[DataFrame] = []
    for m in doc.mappings.values():
        if not m.sources:
            raise MappingError(f"{m.name} has no source")
        for name in m.sources:
            df = find_source(sources, name)
            _, rows = scans.setdefault(id(df), (df, []))
            s = _iri(df, m.subject, doc.prefixes)
            for x in m.po:
                if x.kind == "join":
                    own = link_template(doc, m, x)
                    if own is None:
                        joined.append(_joined(doc, sources, df, m, x))
                        continue
                    x = PO(x.predicate, own, "iri")  # noqa: PLW2901
                o, kind, datatype = _object(df, x, doc.prefixes)
                rows.append(_row(s, _predicate(x, doc.prefixes), o, kind, datatype, x.lang))
    if apart:
        parts = [df.select(*(r[c].alias(c) for c in COLUMNS)) for df, rows in scans.values() for r in rows] + joined
    else:
        parts = [df.select(F.inline(F.array(*rows))) for df, rows in scans.values() if rows] + joined
    if not parts:
        raise MappingError("the document makes no triples")
    all_rows = reduce(DataFrame.unionByName, parts).where(F.col("s").isNotNull() & F.col("o").isNotNull()).select(*COLUMNS)
    return all_rows.dropDuplicates() if distinct else all_rows


def _joined(doc: MappingDoc, sources: dict[str, DataFrame], df: DataFrame, m: Mapping, x: PO) -> DataFrame:
    target = doc.mappings.get(x.object)
    if target is None:
        raise MappingError(f"{m.name} links to {x.object}, which isn't there")
    parts = []
    for name in target.sources:
        other = find_source(sources, name)
        child = df.select(_iri(df, m.subject, doc.prefixes).alias("s"), value(df, x.child).alias("k")).distinct()
        parent = other.select(_iri(other, target.subject, doc.prefixes).alias("o"), value(other, x.parent).alias("k")).distinct()
        parts.append(child.join(parent, "k").select(F.inline(F.array(_row(F.col("s"), expand(x.predicate, doc.prefixes), F.col("o"), "iri", None, None)))))
    return reduce(DataFrame.unionByName, parts)


def drop_literal_types(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without type statements whose object is a literal; and a one-row table of how many there were."""
    bad = (F.col("p") == RDF_TYPE) & (F.col("o_kind") == "lit")
    return triples.where(~bad), triples.agg(F.count_if(bad).alias("removed"))


def keyword_triples(triples: DataFrame, keywords: list[str], n: int = 50) -> DataFrame:
    """First ``n`` triples, in order, in whose lower-cased text a keyword occurs."""
    text = F.lower(F.concat_ws(" ", "s", "p", "o"))
    words = F.array(*(F.lit(k.lower()) for k in keywords)) if keywords else F.array().cast("array<string>")
    return triples.where(F.exists(words, lambda k: F.contains(text, k))).select("s", "p", "o").distinct().orderBy("s", "p", "o").limit(n)


__all__ = ["COLUMNS", "TRIPLE", "compile_mapping", "drop_literal_types", "keyword_triples", "register_term_function"]
