"""N-Triples as tables: read by built-in functions line by line, written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.prefixes import XSD

LINE = r'^\s*(?:<([^<>"{}|^`\\\s]*)>|_:(\S+))\s+<([^<>"{}|^`\\\s]*)>\s+(?:<([^<>"{}|^`\\\s]*)>|_:(\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^<>\s]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'


def _unescaped(c: Column) -> Column:
    """Escapes of strings resolved; a backslash pair is kept apart first so that it isn't read twice."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\'", "'"), ("\\b", "\b"), ("\\f", "\f")):
        c = F.replace(c, F.lit(a), F.lit(b))
    points = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\\u([0-9A-Fa-f]{4})"), 1))
    four = F.aggregate(points, c, lambda a, x: F.replace(a, F.concat(F.lit("\\u"), x), F.decode(F.unhex(x), "UTF-16BE")))
    eight = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\\U([0-9A-Fa-f]{8})"), 1))
    c = F.when(F.contains(c, F.lit("\\u")), four).otherwise(c)
    c = F.when(F.contains(c, F.lit("\\U")), F.aggregate(eight, c, lambda a, x: F.replace(a, F.concat(F.lit("\\U"), x), F.decode(F.unhex(x), "UTF-32")))).otherwise(c)
    return F.replace(c, F.lit("\x00"), F.lit("\\"))


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of lines; comments, blank and broken lines make none. xsd:string counts as no datatype."""
    v = F.col(column)
    part = lambda i: F.nullif(F.regexp_extract(v, LINE, i), F.lit(""))
    return lines.where(v.rlike(LINE)).select(
        F.coalesce(part(1), part(2)).alias("s"),
        F.when(part(1).isNotNull(), "iri").otherwise("bnode").alias("s_kind"),
        part(3).alias("p"),
        F.coalesce(part(4), part(5), _unescaped(F.regexp_extract(v, LINE, 6))).alias("o"),
        F.when(part(4).isNotNull(), "iri").when(part(5).isNotNull(), "bnode").otherwise("lit").alias("o_kind"),
        F.nullif(part(7), F.lit(XSD + "string")).alias("o_datatype"),
        part(8).alias("o_lang"),
    )


def read_ntriples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A graph: the distinct triples of files or folders."""
    return parse(spark.read.text(path)).dropDuplicates()


def line(escape: bool = True) -> Column:
    """One N-Triples line from the columns of a triple table."""
    o = F.col("o")
    if escape:
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            o = F.replace(o, F.lit(a), F.lit(b))
    node = lambda c, k: F.when(F.col(k) == "iri", F.concat(F.lit("<"), F.col(c), F.lit(">"))).otherwise(F.concat(F.lit("_:"), F.col(c)))
    suffix = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).otherwise("")
    literal = F.concat(F.lit('"'), o, F.lit('"'), suffix)
    return F.concat(node("s", "s_kind"), F.lit(" <"), F.col("p"), F.lit("> "), F.when(F.col("o_kind") == "lit", literal).otherwise(node("o", "o_kind")), F.lit(" ."))


def write_ntriples(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Always writes; nothing old stays."""
    triples.select(line().alias("value")).write.mode(mode).text(path)
