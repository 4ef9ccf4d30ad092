"""From a table and an ontology to a validated and scored graph, with bounded retries."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from trellis.operators import profile, quality, questions
from trellis.operators.matching import Plan, plan_entities, plan_mapping
from trellis.plans import rules, shacl
from trellis.plans.mapping import MappingDoc, MappingError, dump, parse
from trellis.plans.materialize import compile_mapping, drop_literal_types
from trellis.plans.rml import to_rml
from trellis.sources.ntriples import write_ntriples
from trellis.sources.ontology import Ontology, read_ontology
from trellis.sources.tables import write_report

#: Most attempts after syntax errors, failed checks, violated shapes and failed questions; those of questions that keep the plan.
SYNTAX, LOGIC, SHAPES, QUESTIONS, KEEPING = 10, 6, 3, 3, 2


@dataclass
class Result:
    document: MappingDoc
    triples: DataFrame
    plan: Plan | None
    checks: dict[str, list]
    notes: list[str]
    attempts: int
    violations: DataFrame | None = None
    conforms: bool | None = None
    questions: list[dict] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)


def build_graph(spark: SparkSession, table: DataFrame, source: str, ontology: str | Ontology, document: str | MappingDoc | None = None, base_uri: str | None = None, asks: list[tuple[str, str]] | None = None, shapes_turtle: str | None = None, validate: bool = True, repair=None, threshold: float = 0.7, go_on=None) -> Result:
    """Profile, plan, map, check, materialise, validate and ask.

    Without a ``document`` one is planned from the ontology. ``repair`` may turn a document
    that can't be read into another text; without it a MappingError is raised.

    Failed questions change the document: twice by what it lacks, then by a new plan from the
    ontology. A changed document counts if more questions pass. Nothing is changed once none
    fails, or ``threshold``'s share passes and ``go_on(passed, total)`` doesn't ask for more.
    """
    onto = read_ontology(ontology) if isinstance(ontology, str) else ontology
    took, start = {}, time.time()

    def lap(name: str) -> None:
        nonlocal start
        took[name], start = round(took.get(name, 0) + time.time() - start, 3), time.time()

    empty = profile.empty_columns(table)
    lap("profile")
    plan, attempts = None, 1
    if document is None:
        plan = plan_entities(onto, table.columns)
        doc = plan_mapping(plan, source + "~csv", onto)
    elif isinstance(document, str):
        while True:
            try:
                doc = parse(document)
                break
            except MappingError as e:
                if repair is None or attempts >= SYNTAX:
                    raise
                document, attempts = repair(document, str(e)), attempts + 1
    else:
        doc = document
    ctx = rules.Context(columns=table.columns, empty_columns=empty, ontology_prefixes=onto.prefixes, classes={onto.name(c) for c, *_ in onto.classes}, base_uri=base_uri)
    lap("plan")
    sources = {source: table, source.rsplit("/", 1)[-1]: table}
    shapes = None
    if validate:
        shapes = shacl.read_shapes(spark, shapes_turtle) if shapes_turtle else shacl.derive_shapes(spark, onto.triples)

    def made(doc: MappingDoc) -> DataFrame:
        return drop_literal_types(compile_mapping(doc, sources))[0].cache()

    def attempt(doc: MappingDoc) -> Result:
        doc, found, n = rules.repaired(rules.normalize(doc, ctx), ctx, LOGIC - 1)
        lap("check")
        triples, violations, ok, before = made(doc), None, None, []
        for _ in range(SHAPES if validate else 0):
            violations = shacl.validate(triples, shapes)
            groups = shacl.grouped(violations).select("component", "path").collect()
            ok, now = not groups, [g.path for g in groups]
            if ok or shacl.persists(before, now):
                break
            node = {onto.name(g.path) for g in groups if g.component == "NodeKindConstraintComponent"}
            own = {onto.name(p.uri) for p in onto.properties if p.kind == "object"}
            fixed = rules.literal_to_iri(doc.copy(), node & own, ctx)
            if fixed == doc:
                break
            triples.unpersist()
            doc, before, n = rules.add_prefixes(fixed, ctx), now, n + 1
            triples = made(doc)
        lap("validate")
        answers = questions.run_questions(asks if asks is not None else questions.questions_of(doc), triples, doc.prefixes)
        lap("questions")
        return Result(doc, triples, plan, found, ctx.notes, attempts + n, violations, ok, answers, took)

    def replanned() -> MappingDoc | None:
        return plan_mapping(plan_entities(onto, table.columns), source + "~csv", onto) if onto.classes else None

    passed = lambda r: sum(q["passed"] is True for q in r.questions)
    run, seen = attempt(doc), set()
    for tries in range(QUESTIONS):
        if questions.accept(run.questions, threshold, go_on):
            break
        seen.add(rules.fingerprint(run.document))
        failed = [q["sparql"] for q in run.questions if q["passed"] is False]
        other = rules.normalize(questions.repaired(run.document, failed, onto, table.columns), ctx) if tries < KEEPING else None
        if other is None or rules.fingerprint(other) in seen:
            other = replanned()
        if other is None or (f := rules.fingerprint(rules.normalize(other, ctx))) in seen:
            break
        seen.add(f)
        attempts = run.attempts + 1
        other = attempt(other)
        tried = other.attempts
        if passed(other) > passed(run):
            run, other = other, run
        other.triples.unpersist()
        run.attempts = tried
    return run


def evaluate(result: Result, table: DataFrame, gold: DataFrame | None = None, levels: tuple[int, ...] = (1, 2, 3, 4)) -> dict:
    """All metrics of a run as one flat record."""
    out: dict = {}
    if 1 in levels:
        out |= quality.health(dump(result.document), result.triples, True, True, result.attempts, sum(result.seconds.values()))
    if 2 in levels:
        out |= {"L2_skipped": gold is None}
        if gold is not None:
            out |= {f"L2_{k}": v for k, v in quality.compare_graphs(result.triples, gold).first().asDict().items()}
    if 3 in levels:
        named = quality.mapped_columns(table.columns, result.document.columns)
        values = quality.value_coverage(table, result.triples)
        hit = [r.column for r in values.where("found").collect()]
        out |= {"L3_skipped": False, "L3_columns_total": named["total"], "L3_columns_mapped_yarrrml": named["mapped"], "L3_column_coverage_by_yarrrml": named["coverage"], "L3_columns_missing_yarrrml": named["missing"]}
        out |= {"L3_columns_mapped_value": len(hit), "L3_column_coverage_by_value": round(len(hit) / max(1, named["total"]), 4), "L3_columns_missing_value": sorted(set(table.columns) - set(hit))}
    r = result.questions
    passed = sum(q["passed"] is True for q in r)
    return out | {"L4_cq_skipped": not r, "L4_cq_total": len(r), "L4_cq_passed": passed, "L4_cq_failed": sum(q["passed"] is False for q in r), "L4_cq_error": sum(q["passed"] is None for q in r), "L4_cq_coverage": round(passed / len(r), 4) if r else 0.0}


def save(result: Result, folder: str, metrics: dict | None = None) -> None:
    """Mapping, graph, report and metrics of a run in a folder."""
    p = Path(folder)
    p.mkdir(parents=True, exist_ok=True)
    (p / "final_mapping.yaml").write_text(dump(result.document))
    write_ntriples(result.triples, str(p / "knowledge_graph"))
    write_report(result.questions, str(p / "questions"))
    (p / "mapping.rml.ttl").write_text(to_rml(result.document))
    (p / "questions_asked.txt").write_text("".join(f"{q['cq']}\n" for q in result.questions if q["cq"]))
    if result.violations is not None:
        groups = [r.asDict() for r in shacl.grouped(result.violations).orderBy("component", "path").collect()]
        (p / "shacl_report.json").write_text(json.dumps({"conforms": result.conforms, "groups": groups}, indent=2))
    if result.plan:
        (p / "entity_plan.txt").write_text(result.plan.text())
    if metrics is not None:
        (p / "metrics.json").write_text(json.dumps(metrics, indent=2, default=str))


def report(metrics: dict, seconds: dict[str, float] | None = None) -> str:
    """Metrics by level, a line each, and each stage's share of the time."""
    lines = []
    for level in sorted({k.split("_")[0] for k in metrics}):
        lines += [f"{level}", *(f"  {k[len(level) + 1 :]:<40} {v}" for k, v in metrics.items() if k.startswith(level + "_"))]
    total = sum((seconds or {}).values())
    return "\n".join(lines + [f"  {k:<12} {'#' * min(10, int(10 * v / total)):<10} {v:.2f} s" for k, v in (seconds or {}).items() if total])


def run_matrix(runs: list[dict], one) -> list[dict]:
    """``one(**run)`` for each run; a run that fails leaves a row that says so."""
    out = []
    for r in runs:
        try:
            out.append({**r, **one(**r)})
        except Exception as e:
            out.append({**r, "L1_pipeline_success": False, "error": str(e)[:500]})
    return out


def table_of(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Records of any keys as one table; lists as JSON."""
    keys = sorted({k for r in records for k in r})
    text = lambda v: json.dumps(v) if isinstance(v, (list, dict)) else None if v is None else str(v)
    return spark.createDataFrame([tuple(text(r.get(k)) for k in keys) for r in records], ", ".join(f"`{k}` string" for k in keys))
