"""Scores of a graph: health, comparison with a gold graph, column coverage, questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.prefixes import RDF_TYPE
from trellis.functions.terms import last_segment, row_id, uri_tail


def prf(tp: Column, fp: Column, fn: Column, digits: int = 4) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; 0 where there is nothing to divide by."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return tuple(F.bround(x, digits) for x in (p, r, f))


def normalized(triples: DataFrame) -> DataFrame:
    """row, p, kind, o: subjects and IRI objects by their row's id, literals without datatype."""
    o = F.when(F.col("o_kind") == "lit", F.col("o")).otherwise(row_id(F.col("o")))
    return triples.select(row_id(F.col("s")).alias("row"), "p", F.when(F.col("o_kind") == "lit", "lit").otherwise("iri").alias("kind"), o.alias("o")).distinct()


def _sides(gen: DataFrame, gold: DataFrame) -> DataFrame:
    """How often each row stands on either side: both tables in one aggregation."""
    cols = gen.columns
    both = gen.select("*", F.lit(1).alias("g"), F.lit(0).alias("h")).unionByName(gold.select("*", F.lit(0).alias("g"), F.lit(1).alias("h")))
    return both.groupBy(*cols).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def compare_sets(gen: DataFrame, gold: DataFrame, prefix: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of two sets of rows, named with a prefix; one row."""
    s = _sides(gen, gold).agg(F.count_if((F.col("g") > 0) & (F.col("h") > 0)).alias("tp"), F.count_if((F.col("g") > 0) & (F.col("h") == 0)).alias("fp"), F.count_if((F.col("g") == 0) & (F.col("h") > 0)).alias("fn"))
    return _named(s, prefix)


def compare_bags(gen: DataFrame, gold: DataFrame, prefix: str) -> DataFrame:
    """The same of two tables with repetitions: a row counts as often as both have it."""
    g, h = F.col("g"), F.col("h")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return _named(_sides(gen, gold).agg(z(F.least(g, h)).alias("tp"), z(g - F.least(g, h)).alias("fp"), z(h - F.least(g, h)).alias("fn")), prefix)


def _named(s: DataFrame, prefix: str) -> DataFrame:
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select(*(c.alias(f"{prefix}_{n}") for n, c in (("tp", F.col("tp")), ("fp", F.col("fp")), ("fn", F.col("fn")), ("precision", p), ("recall", r), ("f1", f))))


def type_mismatches(gen: DataFrame, gold: DataFrame) -> DataFrame:
    """p, gen_kinds, gold_kinds for predicates of both graphs whose objects are of other kinds."""
    of = lambda t, n: normalized(t).groupBy("p").agg(F.array_join(F.array_sort(F.collect_set("kind")), "/").alias(n))
    return of(gen, "gen_kinds").join(of(gold, "gold_kinds"), "p").where("gen_kinds <> gold_kinds")


def predicates(t: DataFrame) -> DataFrame:
    return t.select("p").distinct()


def classes(t: DataFrame) -> DataFrame:
    return t.where(F.col("p") == RDF_TYPE).select("o").distinct()


def subject_ids(t: DataFrame) -> DataFrame:
    return t.select(last_segment(F.col("s")).alias("id")).distinct()


def compare_graphs(gen: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: triples, predicates and classes of a graph against the gold one, with what is missing and what is too much."""
    missing = lambda a, b, n: predicates(a).join(predicates(b), "p", "left_anti").agg(F.array_sort(F.collect_list(uri_tail(F.col("p")))).alias(n))
    parts = [
        compare_sets(normalized(gen), normalized(gold), "norm_triple"),
        compare_sets(predicates(gen), predicates(gold), "predicate"),
        compare_sets(classes(gen), classes(gold), "class"),
        gen.distinct().agg(F.count("*").alias("total_generated")),
        gold.distinct().agg(F.count("*").alias("total_gold")),
        missing(gold, gen, "predicates_missing"),
        missing(gen, gold, "predicates_extra"),
        type_mismatches(gen, gold).agg(F.count("*").alias("object_type_mismatches")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))  # one row each
    return out


def external_scores(gen: DataFrame, gold: DataFrame) -> dict[str, DataFrame]:
    """Nine comparisons: exact triples and subjects, subjects by id, classes, predicates, literals and IRIs with repetitions, distinct classes, distinct pairs of predicate and object."""
    key = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]
    typed, lit = F.col("p") == RDF_TYPE, F.col("o_kind") == "lit"
    pick = lambda f: (f(gen), f(gold))
    return {
        "triples": compare_sets(*pick(lambda t: t.select(*(F.coalesce(c, F.lit("")).alias(c) for c in key)).distinct()), "triples"),
        "subjects_exact": compare_sets(*pick(lambda t: t.select("s").distinct()), "subjects_exact"),
        "subjects_fuzzy": compare_sets(*pick(subject_ids), "subjects_fuzzy"),
        "classes": compare_bags(*pick(lambda t: t.where(typed).select("o")), "classes"),
        "classes_unique": compare_sets(*pick(classes), "classes_unique"),
        "predicates": compare_bags(*pick(lambda t: t.select("p")), "predicates"),
        "predicate_objects": compare_sets(*pick(lambda t: t.select("p", "o").distinct()), "predicate_objects"),
        "literals": compare_bags(*pick(lambda t: t.where(lit).select("o")), "literals"),
        "uris": compare_bags(*pick(lambda t: t.where(~lit & ~typed).select("o")), "uris"),
    }


def external_average(scores: dict[str, DataFrame]) -> DataFrame:
    """average_f1: the mean of the comparisons' F1, each of them rounded already; one row."""
    f1s = reduce(DataFrame.unionByName, (d.select(F.col(f"{name}_f1").alias("f1")) for name, d in scores.items()))
    return f1s.agg(F.bround(F.avg("f1"), 4).alias("average_f1"))


def health(document_text: str, triples: DataFrame | None, parsed: bool, compiled: bool, retries: int = 0, seconds: float | None = None) -> dict:
    """What came about at all."""
    n = triples.distinct().count() if triples is not None else 0
    out = {"L1_yarrrml_produced": bool(document_text.strip()), "L1_yarrrml_syntactic_valid": parsed, "L1_yarrrml_translatable": compiled, "L1_rml_materializable": triples is not None, "L1_pipeline_success": n > 0, "L1_retry_count": retries, "L1_total_triples": n}
    return out | ({"L1_total_latency_sec": round(seconds, 2)} if seconds is not None else {})


def mapped_columns(columns: list[str], used: set[str]) -> dict:
    """Share of columns that the mapping names."""
    hit = [c for c in columns if c in used]
    return {"total": len(columns), "mapped": len(hit), "coverage": round(len(hit) / len(columns), 4) if columns else 0.0, "missing": sorted(set(columns) - set(hit))}


def value_coverage(rows: DataFrame, triples: DataFrame, order: list[str] | None = None, float_compat: bool = False) -> DataFrame:
    """column, value, found: whether each column's value in the first row is an object of the graph.

    ``float_compat`` spells whole numbers of columns with gaps in the first five rows as
    ``2020.0``, as a reader with inferred types would.
    """
    head = (rows.orderBy(*order) if order else rows).limit(5)
    first = (head.orderBy(*order) if order else head).limit(1)
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in rows.columns))
    v = first.select(F.inline(parts)).where("value IS NOT NULL AND value <> '' AND lower(value) <> 'nan'")
    if float_compat:
        gaps = head.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rows.columns))
        gap = gaps.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_null")) for c in rows.columns))))
        v = v.join(gap, "column").select("column", F.when((F.col("n_null") > 0) & F.col("value").rlike(r"^-?\d+$"), F.concat("value", F.lit(".0"))).otherwise(F.col("value")).alias("value"))
    objects = triples.select(F.col("o").alias("value")).distinct()
    return v.join(objects.withColumn("found", F.lit(True)), "value", "left").select("column", "value", F.coalesce("found", F.lit(False)).alias("found"))


def question_coverage(results: DataFrame) -> DataFrame:
    """One row: total, passed, failed, error, coverage; an error is no pass."""
    a = results.agg(F.count("*").alias("cq_total"), F.count_if(F.col("passed")).alias("cq_passed"), F.count_if(~F.col("passed")).alias("cq_failed"), F.count_if(F.col("passed").isNull()).alias("cq_error"))
    return a.withColumn("cq_coverage", F.when(F.col("cq_total") > 0, F.bround(F.col("cq_passed") / F.col("cq_total"), 4)).otherwise(F.lit(0.0)))
