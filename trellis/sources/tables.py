"""Tables, text lists and logs in; reports out."""

from __future__ import annotations

import difflib
import json
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: RDF formats by file extension.
FORMATS = {".ttl": "turtle", ".owl": "xml", ".rdf": "xml", ".xml": "xml", ".nt": "ntriples", ".n3": "n3", ".jsonld": "json-ld", ".json": "json-ld", ".nq": "nquads", ".trig": "trig"}


def rdf_format(path: str) -> str:
    return FORMATS.get(Path(path).suffix.lower(), "turtle")


def read_csv(spark: SparkSession, path: str | list[str], null_values: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header, all columns as strings; ``null_values`` are null besides empty cells."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.replace({v: None for v in null_values}) if null_values else df


def columns(spark: SparkSession, path: str) -> list[str]:
    """The header alone."""
    return read_csv(spark, path).columns


def sample(df: DataFrame, n: int = 3) -> list[dict]:
    """First rows as dictionaries; a table's sample has three."""
    return [r.asDict() for r in df.limit(n).collect()]


def schema_summary(df: DataFrame) -> dict:
    return {"columns": df.columns, "sample": sample(df)}


def read_questions(text: str) -> list[str]:
    """One question a line; blank lines and lines with # at their start don't count."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


def read_asks(text: str) -> list[str]:
    """ASK queries of a file, divided by blank lines; a block's prefixes may stand before ASK."""
    blocks = [b.strip() for b in re.split(r"\n\s*\n", text)]
    return [b for b in blocks if re.match(r"(?is)(?:\s*(?:prefix|base)\s[^\n]*\n)*\s*ask\b", b)]


def read_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Experiment logs of any columns as one table; a column that a log lacks is null there."""
    logs = [spark.read.option("header", True).option("inferSchema", True).csv(p) for p in paths]
    return union_all(logs)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_log(df: DataFrame, path: str) -> None:
    """Columns in alphabetical order; lists and structs as JSON."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    df.select(*((F.to_json(c).alias(c) if c in nested else F.col(c)) for c in sorted(df.columns))).write.mode("overwrite").option("header", True).csv(path)


def write_report(results: list[dict], stem: str) -> None:
    """Check results as JSON and as text."""
    mark = {True: "PASS", False: "FAIL", None: "ERROR"}
    lines = [f"Checks: {len(results)}"]
    for i, r in enumerate(results, 1):
        lines += ["", f"[{i}] {mark[r['passed']]}  [{r.get('source', '')}]", f"  {r['cq']}", *("    " + x for x in r["sparql"].splitlines())]
        if r.get("diagnosis"):
            lines.append(f"  {r['diagnosis']}")
    Path(f"{stem}.json").write_text(json.dumps(results, indent=2, ensure_ascii=False))
    Path(f"{stem}.txt").write_text("\n".join(lines) + "\n")


def text_diff(before: str, after: str) -> str:
    """Unified difference of two mapping versions."""
    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), "before", "after"))
