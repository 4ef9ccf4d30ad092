"""Transitive closure, and tables that are staged between rounds."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local session may do without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trellis-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/graph-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once in the shared folder and read again: nothing before it runs twice."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(one: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """a, b: pairs that one or more steps of ``one`` (a, b) join; with ``start`` (a) only from there.

    After round k all ways of up to 2^k steps are known, and ``power`` has those of 2^k
    steps. A round appends that power to what is known and keeps what is new, so it ends
    after the logarithm of the longest way's steps. What a round adds is a table of its
    own, read by the next ones; known pairs aren't joined with each other.
    """
    power = staged(one.select("a", "b").distinct())
    first = power if start is None else staged(power.join(start.distinct(), "a", "left_semi"))
    deltas = [first]
    while True:
        known = reduce(DataFrame.unionByName, deltas)
        step = power.withColumnRenamed("a", "m")
        longer = known.withColumnRenamed("b", "m").join(step, "m").select("a", "b").distinct()
        new = staged(longer.join(known, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return known
        deltas.append(new)
        power = staged(power.withColumnRenamed("b", "m").join(step, "m").select("a", "b").distinct())


__all__ = ["closure", "shared_folder", "staged"]
