"""SHACL: shapes from Turtle or from an ontology, and violations as a table.

Each kind of constraint is one plan over all shapes that have it: values reach their
shape by a join with the small shape table, and what fails stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.prefixes import OWL, RDF, RDF_TYPE, RDFS, XSD
from trellis.functions.terms import boolean
from trellis.plans.closure import closure, staged
from trellis.sources.turtle import Term, parse_turtle

SH = "http://www.w3.org/ns/shacl#"
SHAPE = "shape_id string, kind string, target_class string, target_subjects_of string, path string, node_kind string, class string, datatype string, pattern string"
VIOLATION = ["component", "focus", "path", "value", "message", "shape"]
#: What each node kind allows.
KINDS = {"IRI": ["iri"], "Literal": ["lit"], "BlankNode": ["bnode"], "BlankNodeOrIRI": ["bnode", "iri"], "IRIOrLiteral": ["iri", "lit"], "BlankNodeOrLiteral": ["bnode", "lit"]}
#: Lexical forms that a datatype's values must have.
FORMS = {
    XSD + "integer": r"^[+-]?\d+$",
    XSD + "int": r"^[+-]?\d+$",
    XSD + "long": r"^[+-]?\d+$",
    XSD + "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$",
    XSD + "double": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$",
    XSD + "float": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$",
    XSD + "gYear": r"^-?\d{4,}(Z|[+-]\d\d:\d\d)?$",
    XSD + "date": r"^-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$",
    XSD + "dateTime": r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$",
}


def sanitize(triples: list[tuple[Term, str, Term]]) -> tuple[list[tuple[Term, str, Term]], int]:
    """Without property shapes that have no path, and without references to them; and how many went."""
    has_path = {s for s, p, _ in triples if p == SH + "path"}
    bad = {s for s, p, o in triples if p == RDF_TYPE and o.value == SH + "PropertyShape" and s not in has_path}
    return [t for t in triples if t[0] not in bad and not (t[1] == SH + "property" and t[2] in bad)], len(bad)


def shape_rows(triples: list[tuple[Term, str, Term]]) -> list[tuple]:
    """A row for each node shape and target, and one for each property shape of each target that it has."""
    triples, _ = sanitize(triples)
    of: dict[Term, dict[str, list[Term]]] = {}
    for s, p, o in triples:
        of.setdefault(s, {}).setdefault(p, []).append(o)
    one = lambda s, k: next((o.value for o in of.get(s, {}).get(SH + k, [])), None)
    rows = []
    node_shapes = [s for s, ps in of.items() if any(o.value == SH + "NodeShape" for o in ps.get(RDF_TYPE, [])) or SH + "targetClass" in ps or SH + "targetSubjectsOf" in ps]
    owned: set[Term] = set()
    for s in node_shapes:
        targets = [(o.value, None) for o in of[s].get(SH + "targetClass", [])] + [(None, o.value) for o in of[s].get(SH + "targetSubjectsOf", [])]
        for target, subjects in targets:
            nk = (one(s, "nodeKind") or "").removeprefix(SH) or None
            if one(s, "path") is None:
                rows.append((s.value, "node", target, subjects, None, nk, one(s, "class"), None, one(s, "pattern")))
            for p in of[s].get(SH + "property", []) + ([s] if one(s, "path") else []):
                owned.add(p)
                rows.append((p.value, "property", target, subjects, one(p, "path"), (one(p, "nodeKind") or "").removeprefix(SH) or None, one(p, "class"), one(p, "datatype"), one(p, "pattern")))
    # Property shapes that no node shape owns say something of every subject of their path.
    for s, ps in of.items():
        if SH + "path" in ps and s not in owned and s not in node_shapes:
            rows.append((s.value, "property", None, one(s, "path"), one(s, "path"), (one(s, "nodeKind") or "").removeprefix(SH) or None, one(s, "class"), one(s, "datatype"), one(s, "pattern")))
    return rows


def read_shapes(spark: SparkSession, turtle: str) -> DataFrame:
    return spark.createDataFrame(shape_rows(parse_turtle(turtle)[0]), SHAPE)


def derive_shapes(spark: SparkSession, ontology: list[tuple[Term, str, Term]]) -> DataFrame:
    """Classes want IRIs; object properties IRI values, datatype properties literals. Only names from http, and no class of OWL's own."""
    typed = lambda k: [s.value for s, p, o in ontology if p == RDF_TYPE and o.value == OWL + k and s.kind == "iri" and s.value.startswith("http")]
    rows = [(c + "Shape", "node", c, None, None, "IRI", None, None, None) for c in typed("Class") if "owl#" not in c]
    for k, nk in (("ObjectProperty", "IRI"), ("DatatypeProperty", "Literal")):
        rows += [(p + "Shape", "property", None, p, p, nk, None, None, None) for p in typed(k)]
    return spark.createDataFrame(list(dict.fromkeys(rows)), SHAPE)


def structural_shapes(spark: SparkSession) -> DataFrame:
    """Whatever has a type is an IRI."""
    return spark.createDataFrame([("structural", "node", None, RDF_TYPE, None, "IRI", None, None, None)], SHAPE)


def validate(triples: DataFrame, shapes: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """component, focus, path, value, message, shape of every result.

    Instances of a class are those with its type, and with the type of a class below it, over
    any number of levels, where the data say so; nothing else is inferred. ``counts``: how many
    triples each predicate has, if that is known.
    """
    # Shapes are metadata: what they name prunes the scans, and what they lack needs no plan.
    rows = shapes.collect()
    names = lambda k: sorted({r[k] for r in rows if r[k] is not None})
    shapes = F.broadcast(shapes)
    types = triples.where(F.col("p") == RDF_TYPE).select("s", "s_kind", F.col("o").alias("type"))
    instances, below = types, triples.where((F.col("p") == RDFS + "subClassOf") & (F.col("o_kind") != "lit")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    # Where predicates are counted, no job has to ask whether there are subclasses.
    if (names("target_class") or names("class")) and (counts is None or counts.get(RDFS + "subClassOf")) and not below.isEmpty():
        above = closure(below).where(F.col("b").isin(names("target_class") + names("class"))).toDF("type", "above")
        instances = types.unionByName(types.join(above, "type").select("s", "s_kind", F.col("above").alias("type")))
    instances = instances.where(F.col("type").isin(names("target_class") + names("class"))).distinct()
    targets = []
    if names("target_class") or not names("target_subjects_of"):
        targets.append(instances.join(shapes.where("target_class IS NOT NULL"), F.col("type") == F.col("target_class")).drop("type"))
    if names("target_subjects_of"):
        subjects = triples.where(F.col("p").isin(names("target_subjects_of"))).select("s", "s_kind", F.col("p").alias("_p")).distinct()
        targets.append(subjects.join(shapes.where("target_subjects_of IS NOT NULL"), F.col("_p") == F.col("target_subjects_of")).drop("_p"))
    focus = reduce(DataFrame.unionByName, targets)

    nodes = focus.where("kind = 'node'").select("s", F.lit(None).cast("string").alias("path"), F.col("s").alias("value"), F.col("s_kind").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"), "shape_id", "node_kind", "class", "datatype", "pattern")
    props = focus.where("kind = 'property'").drop("s_kind").join(triples.where(F.col("p").isin(names("path"))).select("s", F.col("p").alias("path"), F.col("o").alias("value"), "o_kind", "o_datatype", "o_lang"), ["s", "path"])
    kinds = [nodes] * any(r.kind == "node" for r in rows) + [props.select(*nodes.columns)] * any(r.kind == "property" for r in rows)
    values = reduce(DataFrame.unionByName, kinds or [nodes]).distinct()

    def results(bad, component: str, message) -> DataFrame:
        return values.where(bad).select(F.lit(component).alias("component"), F.col("s").alias("focus"), "path", "value", message.alias("message"), F.col("shape_id").alias("shape"))

    allowed = F.create_map(*(x for k, v in KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    kind_bad = F.col("node_kind").isNotNull() & ~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("node_kind")), F.col("o_kind")), F.lit(False))
    effective = F.coalesce("o_datatype", F.when(F.col("o_lang").isNotNull(), RDF + "langString").otherwise(XSD + "string"))
    form = F.lit(True)
    for d, r in FORMS.items():
        form = F.when(F.col("datatype") == d, F.col("value").rlike(r)).otherwise(form)
    form = F.when(F.col("datatype") == XSD + "boolean", boolean(F.col("value")).isNotNull()).otherwise(form)
    type_bad = F.col("datatype").isNotNull() & ((F.col("o_kind") != "lit") | (effective != F.col("datatype")) | ~form)
    pattern_bad = F.col("pattern").isNotNull() & ((F.col("o_kind") == "bnode") | ~F.regexp(F.col("value"), F.col("pattern")))
    wanted = values.where("class IS NOT NULL")
    some = lambda k, part: [part] if names(k) else []
    class_bad = wanted.join(instances.select(F.col("s").alias("value"), F.col("type").alias("class")).distinct(), ["value", "class"], "left_anti")
    parts = [
        *some("node_kind", results(kind_bad, "NodeKindConstraintComponent", F.concat(F.lit("Value is not of Node Kind sh:"), F.col("node_kind")))),
        *some("datatype", results(type_bad, "DatatypeConstraintComponent", F.concat(F.lit("Value is not Literal with datatype "), F.col("datatype")))),
        *some("pattern", results(pattern_bad, "PatternConstraintComponent", F.concat(F.lit("Value does not match pattern "), F.col("pattern")))),
        *some("class", class_bad.select(F.lit("ClassConstraintComponent").alias("component"), F.col("s").alias("focus"), "path", "value", F.concat(F.lit("Value does not have class "), F.col("class")).alias("message"), F.col("shape_id").alias("shape"))),
    ] or [results(F.lit(False), "", F.lit(""))]
    return reduce(DataFrame.unionByName, parts).select(*VIOLATION)


def conforms(violations: DataFrame) -> bool:
    return violations.isEmpty()


def grouped(violations: DataFrame) -> DataFrame:
    """component, path (or message), n, the two least focus nodes, summary. Only counts and two examples leave a task.

    The violations are staged, as they are read twice.
    """
    key = F.coalesce("path", "message")
    least = F.min("focus")
    g = staged(violations.select("component", key.alias("path"), "message", "focus"))
    one = g.groupBy("component", "path").agg(F.count("*").alias("n"), least.alias("first"), F.min("message").alias("message"))
    two = g.join(one.select("component", "path", "first"), ["component", "path"]).where(F.col("focus") > F.col("first")).groupBy("component", "path").agg(F.min("focus").alias("second"))
    both = one.join(two, ["component", "path"], "left")
    examples = F.array_compact(F.array("first", "second"))
    text = F.concat(F.lit("["), F.col("component"), F.lit("] path="), F.col("path"), F.lit(" | "), F.col("message"), F.when(F.col("n") > 1, F.concat(F.lit(" | ("), F.col("n").cast("string"), F.lit(" nodes affected)"))).otherwise(""), F.lit(" | e.g. "), F.array_join(examples, ", "))
    return both.select("component", "path", "n", examples.alias("examples"), text.alias("summary"))


def fingerprint(summaries: DataFrame, column: str = "summary") -> DataFrame:
    """12 characters that stay the same as long as the set of summaries does; summaries are few."""
    return summaries.agg(F.substring(F.md5(F.array_join(F.array_sort(F.collect_list(column)), "|").cast("binary")), 1, 12).alias("fingerprint"))


def persists(before: list[str], now: list[str]) -> bool:
    """Whether a retry left all earlier summaries or paths in place."""
    return bool(before) and set(before) <= set(now)


def remedies(violations: DataFrame, properties: DataFrame) -> DataFrame:
    """component, path, kind of property, advice; up to eight."""
    g = violations.groupBy("component", "path").agg(F.count("*").alias("n"))
    j = g.join(F.broadcast(properties.select(F.col("uri").alias("path"), F.col("kind").alias("property_kind"))), "path", "left")
    node = F.col("component") == "NodeKindConstraintComponent"
    advice = F.when(node & (F.col("property_kind") == "object"), "map the column to an IRI template").when(node & (F.col("property_kind") == "data"), "map the column to a literal").when(F.col("component") == "DatatypeConstraintComponent", "give the literal the datatype of the property's range").when(F.col("component") == "ClassConstraintComponent", "link to a subject with the class of the property's range").otherwise("see the shape")
    return j.select("component", "path", "property_kind", "n", advice.alias("advice")).orderBy(F.desc("n"), "component", "path").limit(8)
