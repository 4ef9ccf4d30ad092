"""Column profiles: one pass over a table for all its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.terms import key_name, lexical


def _values(df: DataFrame) -> DataFrame:
    """Every column's lexical form."""
    return df.select(*(lexical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column, ordinal, n_rows, n_null, n_distinct, is_unique, is_empty, a row for each column.

    A column is unique if it has as many values as the table rows, so a null makes it not;
    it is empty if no value has more than white space. ``approximate`` counts distinct
    values by sketch, without the exchange of an exact count.
    """
    v = _values(df)
    count = F.approx_count_distinct if approximate else F.count_distinct
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(v.columns):
        col = F.col(f"`{c}`")
        aggs += [count(col).alias(f"d{i}"), F.count(col).alias(f"c{i}"), F.coalesce(F.bool_or(F.trim(col) != ""), F.lit(False)).alias(f"s{i}")]
    one = v.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{i}")).alias("n_null"), F.col(f"d{i}").alias("n_distinct"), (F.col(f"d{i}") == F.col("n")).alias("is_unique"), (~F.col(f"s{i}")).alias("is_empty")) for i, c in enumerate(v.columns)))
    return one.select(F.inline(rows))


def cardinality(df: DataFrame, sample: int | None = 500) -> DataFrame:
    """Columns by number of values in the first rows, with level: low below max(5, a tenth of the rows), high from half on, else mid."""
    p = profile(df.limit(sample) if sample else df)
    level = F.when(F.col("n_distinct") < F.greatest(F.lit(5), 0.1 * F.col("n_rows")), "low").when(F.col("n_distinct") >= 0.5 * F.col("n_rows"), "high").otherwise("mid")
    return p.select("column", "ordinal", "n_distinct", level.alias("level")).orderBy(F.desc("n_distinct"), "ordinal")


def key_candidates(df: DataFrame) -> DataFrame:
    """Unique columns, those named like keys first."""
    return profile(df).where("is_unique").select("column", "ordinal", key_name(F.col("column")).alias("named_like_key")).orderBy(F.desc("named_like_key"), "ordinal")


def composite_key(df: DataFrame, n: int = 3) -> list[str]:
    """The columns with most values, for a key where none is unique."""
    return [r.column for r in cardinality(df).limit(n).collect()]


def empty_columns(df: DataFrame) -> set[str]:
    return {r.column for r in profile(df).where("is_empty").select("column").collect()}


def coordinate_groups(columns: DataFrame) -> DataFrame:
    """group, lat, long: columns that belong together by what stands before their last part; the bare pair has an empty group."""
    c = F.lower("column")
    lat, long = r"^(?:(.*)_)?(lat|latitude)$", r"^(?:(.*)_)?(lon|long|longitude)$"
    group = F.regexp_replace(F.col("column"), r"(?i)_?(latitude|lat|longitude|long|lon)$", "")
    g = columns.select("column", group.alias("group"), c.rlike(lat).alias("is_lat"), c.rlike(long).alias("is_long")).where("is_lat OR is_long")
    return g.groupBy("group").agg(F.min(F.when(F.col("is_lat"), F.col("column"))).alias("lat"), F.min(F.when(F.col("is_long"), F.col("column"))).alias("long"))
