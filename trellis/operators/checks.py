"""Checks of mapping documents on their relational form, for many documents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.prefixes import IMPLICIT
from trellis.functions.terms import column_refs, source_name, subject_base


def missing_prefixes(po: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Prefixes in use that aren't declared."""
    names = po.select(F.explode(F.array_compact(F.array("predicate", F.when(F.col("kind").isin("type", "iri", "const_iri"), F.col("object_template")), "datatype"))).alias("name"))
    used = names.select(F.regexp_extract("name", r"^([A-Za-z_][\w-]*):(?!//)", 1).alias("prefix")).where(~F.col("prefix").isin("", *sorted(IMPLICIT))).distinct()
    return used.join(prefixes.select("prefix"), "prefix", "left_anti")


def duplicate_predicates(po: DataFrame) -> DataFrame:
    """mapping, predicate, n_columns, columns where several entries take several columns."""
    e = po.where("kind <> 'type'").select("mapping", "predicate", "ord", F.explode("columns").alias("column"))
    g = e.groupBy("mapping", "predicate").agg(F.count_distinct("ord").alias("n_entries"), F.array_sort(F.collect_set("column")).alias("columns"))
    return g.where((F.col("n_entries") > 1) & (F.size("columns") > 1)).select("mapping", "predicate", F.size("columns").alias("n_columns"), F.array_join("columns", ",").alias("columns"))


def redundancies(po: DataFrame) -> DataFrame:
    """predicate, column, n_mappings where mappings of one class state the same."""
    classes = po.where("kind = 'type'").groupBy("mapping").agg(F.min("object_template").alias("class"))
    e = po.where("kind = 'literal'").select("mapping", "predicate", F.explode("columns").alias("column")).join(classes, "mapping", "left")
    g = e.groupBy("predicate", "column").agg(F.count_distinct("mapping").alias("n_mappings"), F.count_distinct(F.coalesce("class", F.lit(""))).alias("n_classes"))
    return g.where("n_mappings > 1 AND n_classes < n_mappings").select("predicate", "column", "n_mappings")


def islands(mappings: DataFrame, po: DataFrame) -> DataFrame:
    """Mappings without a link to or from another; none are reported of one mapping or one source."""
    base = mappings.select("name", subject_base(F.col("subject_template")).alias("target")).distinct()
    to = po.where("kind IN ('iri', 'join')").select("mapping", subject_base(F.col("object_template")).alias("target"), "object_template")
    by_base, by_name = to.join(base, "target"), to.join(base.select("name").distinct(), F.col("object_template") == F.col("name"))
    pairs = by_base.select("mapping", "name").unionByName(by_name.select("mapping", "name")).where("mapping <> name")
    linked = pairs.select(F.explode(F.array("mapping", "name")).alias("name")).distinct()
    many = mappings.agg((F.count_distinct("name") > 1).alias("a"), (F.count_distinct(source_name(F.col("source"))) > 1).alias("b")).where("a AND b")
    return mappings.select("name").distinct().join(linked, "name", "left_anti").join(F.broadcast(many), F.lit(True), "left_semi")


def uncovered_columns(columns: DataFrame, mappings: DataFrame, po: DataFrame) -> DataFrame:
    """Columns that no mapping uses; those marked is_empty or is_conflict may stay unused."""
    used = po.select(F.explode("columns").alias("column")).union(mappings.select(F.explode(column_refs(F.col("subject_template"))))).distinct()
    return columns.where("NOT is_empty AND NOT is_conflict").join(used, "column", "left_anti").select("column")


def invalid_classes(po: DataFrame, classes: DataFrame) -> DataFrame:
    """mapping, class for classes that aren't in the ontology."""
    return po.where("kind = 'type'").select("mapping", F.col("object_template").alias("class")).join(classes, "class", "left_anti")


def primary_mapping(po: DataFrame) -> DataFrame:
    """The mapping with most literals; of several the one with the least name."""
    g = po.where("kind = 'literal'").groupBy("mapping").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "mapping").limit(1)


def column_distribution(po: DataFrame) -> DataFrame:
    """mapping, columns: what each mapping takes."""
    return po.select("mapping", F.explode("columns").alias("column")).groupBy("mapping").agg(F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns"))
