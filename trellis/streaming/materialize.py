"""Incremental materialisation: rows as they arrive become triples, each once within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trellis.functions.terms import COLUMNS
from trellis.plans.mapping import MappingDoc
from trellis.plans.materialize import compile_mapping


def stream_triples(doc: MappingDoc, source: str, rows: DataFrame, time_column: str, delay: str = "10 minutes") -> DataFrame:
    """Triples of a streaming table, with the event's time; state is kept for the delay only."""
    from trellis.plans.materialize import _iri, _object, _predicate, _row

    marked = rows.withWatermark(time_column, delay)
    structs = []
    for m in doc.mappings.values():
        if any(s.split("~")[0].rsplit("/", 1)[-1].rsplit(".", 1)[0] == source for s in m.sources):
            s = _iri(marked, m.subject, doc.prefixes)
            for x in m.po:
                o, kind, datatype = _object(marked, x, doc.prefixes)
                structs.append(_row(s, _predicate(x, doc.prefixes), o, kind, datatype, x.lang))
    t = marked.select(F.col(time_column).alias("event_time"), F.explode(F.array(*structs)).alias("t")).select("event_time", "t.*")
    return t.where("s IS NOT NULL AND o IS NOT NULL").dropDuplicatesWithinWatermark(COLUMNS)


def start(doc: MappingDoc, source: str, rows: DataFrame, time_column: str, path: str, checkpoint: str, delay: str = "10 minutes") -> StreamingQuery:
    """Appends the triples to a Parquet folder, each batch once."""
    t = stream_triples(doc, source, rows, time_column, delay)
    return t.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


__all__ = ["compile_mapping", "start", "stream_triples"]
