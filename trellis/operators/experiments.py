"""Logs of experiments: summaries by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.sources.tables import union_all


def summarise(logs: DataFrame, keys: list[str], flags: list[str] = (), measures: list[str] = (), digits: int = 4) -> DataFrame:
    """Runs by group (a null key is a group of its own): each flag's rate, sum and count; each measure's mean, sample deviation, least and most."""
    aggs = [F.count("*").alias("n_runs")]
    for c in flags:
        v = F.col(c).cast("double")
        aggs += [F.bround(F.avg(v), digits).alias(f"{c}_mean"), F.sum(v).alias(f"{c}_sum"), F.count(v).alias(f"{c}_count")]
    for c in measures:
        v = F.col(c).cast("double")
        aggs += [F.bround(F.avg(v), digits).alias(f"{c}_mean"), F.bround(F.stddev_samp(v), digits).alias(f"{c}_std"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    return logs.groupBy(*keys).agg(*aggs)


def not_skipped(logs: DataFrame, column: str) -> DataFrame:
    """Runs in which a level wasn't skipped."""
    return logs.where(~F.coalesce(F.col(column).cast("boolean"), F.lit(True)))


__all__ = ["not_skipped", "summarise", "union_all"]
