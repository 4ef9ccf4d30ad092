"""``python -m trellis TABLE.csv ONTOLOGY.ttl``: builds a graph, checks it and writes all to a folder."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from trellis.operators.questions import merged
from trellis.pipeline import build_graph, evaluate, report, save
from trellis.sources.ntriples import read_ntriples
from trellis.sources.tables import read_asks, read_csv, read_questions


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="trellis", description=__doc__)
    a.add_argument("table")
    a.add_argument("ontology")
    a.add_argument("--out", default="out")
    a.add_argument("--mapping", help="a mapping document instead of a planned one")
    a.add_argument("--base-uri")
    a.add_argument("--gold", help="N-Triples to compare with")
    a.add_argument("--eval", action="store_true", help="write metrics")
    a.add_argument("--sparql", help="an ASK query, or @FILE of them")
    a.add_argument("--cqs", help="@FILE of questions; kept in the report, answered by the mapping's own queries")
    a.add_argument("--shapes", help="SHACL shapes instead of derived ones")
    a.add_argument("--no-shacl", action="store_true")
    o = a.parse_args(argv)
    spark = SparkSession.builder.appName("trellis").getOrCreate()
    table = read_csv(spark, o.table)
    text = lambda p: Path(p).read_text() if p else None
    asks = None
    if o.sparql:
        asks = [("", q) for q in (read_asks(text(o.sparql[1:])) if o.sparql.startswith("@") else [o.sparql])]
    own = read_questions(text(o.cqs[1:])) if o.cqs and o.cqs.startswith("@") else [o.cqs] if o.cqs else []
    r = build_graph(spark, table, Path(o.table).name, text(o.ontology), text(o.mapping), o.base_uri, asks, text(o.shapes), not o.no_shacl)
    wanted = merged(own, [q["cq"] for q in r.questions])
    metrics = evaluate(r, table, read_ntriples(spark, o.gold) if o.gold else None) if o.eval or o.gold else None
    save(r, o.out, metrics)
    if metrics:
        print(report(metrics, r.seconds))
    print(json.dumps({"triples": r.triples.count(), "conforms": r.conforms, "passed": sum(q["passed"] is True for q in r.questions), "asked": len(r.questions), "questions": len(wanted)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
