"""A triple store: triples written once, with a folder for each predicate and buckets by subject.

Filters on a predicate read its folder only, and patterns about one subject meet bucket by
bucket, without an exchange. How many triples each predicate has is stored beside them and
orders the joins of a query. Several queries share a store.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.terms import COLUMNS, TRIPLE
from trellis.plans import shacl, sparql
from trellis.plans.closure import shared_folder, staged

#: Folders of predicates: no more than these, and no name longer than file systems take.
MOST_PREDICATES, LONGEST_NAME = 2_000, 200
#: A bucket is hot with so many times the rows of an even one, if it has this many rows at least.
HOT, HOT_ROWS = 8, 1_000_000
META = "folders boolean, buckets int, p string, n long"


@dataclass
class TripleStore:
    """A store at ``path``. ``buckets`` is 0 where a subject is too frequent to be one task's; then joins exchange rows.

    ``counts`` is None where there are more predicates than have folders.
    """

    spark: SparkSession
    path: str
    folders: bool
    buckets: int
    counts: dict[str, int] | None

    @cached_property
    def triples(self) -> DataFrame:
        """All triples, each once."""
        data = f"{self.path}/triples"
        if not self.buckets:
            return self.spark.read.schema(TRIPLE).parquet(data).select(*COLUMNS)
        name = f"trellis_{uuid.uuid4().hex}"
        by = "PARTITIONED BY (p)" if self.folders else ""
        self.spark.sql(f"CREATE TABLE {name} ({TRIPLE}) USING parquet {by} CLUSTERED BY (s) SORTED BY (s) INTO {self.buckets} BUCKETS LOCATION '{data}'")
        if self.folders:
            self.spark.catalog.recoverPartitions(name)
        return self.spark.table(name).select(*COLUMNS)

    def run(self, query: str, prefixes: dict[str, str] | None = None, **options) -> DataFrame:
        """``sparql.run`` over the store, rare predicates first."""
        return sparql.run(query, self.triples, prefixes, counts=self.counts, **options)

    def validate(self, shapes: DataFrame) -> DataFrame:
        """``shacl.validate`` over the store."""
        return shacl.validate(self.triples, shapes, self.counts)


def write_store(triples: DataFrame, path: str | None = None, buckets: int | None = None, hot_rows: int = HOT_ROWS) -> TripleStore:
    """Writes a set of triples to ``path``, by default below ``spark.checkpoint.dir``.

    Equal triples are kept once. Triples without subject, predicate or object are none. An
    empty table makes a store without triples. There are as many buckets as shuffle partitions unless
    ``buckets`` says otherwise. Where a bucket has ``hot_rows`` rows or more and ``HOT`` times
    its share, as one subject has many of all triples, rows are dealt by ranges of whole
    triples instead, which cut such a subject; the store then has no buckets.
    """
    spark = triples.sparkSession
    path = (path or shared_folder(spark)).rstrip("/")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()
    rows = staged(triples.select(*COLUMNS).where(whole).dropDuplicates())
    # The bucket of a row is Spark's own: its Murmur3 hash of the subject, modulo their number.
    cells = rows.groupBy("p", F.pmod(F.hash("s"), F.lit(n)).alias("bucket")).agg(F.count("*").alias("n"))
    # Few rows reach the driver: the largest buckets decide, and predicates are counted up to a bound.
    largest = cells.groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    found = cells.groupBy("p").agg(F.sum("n").alias("n")).limit(MOST_PREDICATES + 1).collect()
    known = len(found) <= MOST_PREDICATES
    folders = 0 < len(found) <= MOST_PREDICATES and all(0 < len(quote(r.p, safe="")) <= LONGEST_NAME for r in found)
    hot = (largest["most"] or 0) >= hot_rows and largest["most"] * n >= HOT * largest["all"]
    if hot:
        writer = rows.repartitionByRange(n, "p", "s", "o").sortWithinPartitions("p", "s").write
    else:
        writer = rows.repartition(n, "s").write.bucketBy(n, "s").sortBy("s")
    if folders:
        writer = writer.partitionBy("p")
    data = f"{path}/triples"
    if hot:
        writer.parquet(data)
    else:
        # Only a table can have buckets; its files are what counts, and ``triples`` names them again.
        name = f"trellis_{uuid.uuid4().hex}"
        writer.option("path", data).format("parquet").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")
    meta = [(folders, 0 if hot else n, r.p, r.n) for r in found] if known and found else [(folders, 0 if hot else n, None, 0 if known else None)]
    spark.createDataFrame(meta, META).coalesce(1).write.parquet(f"{path}/meta")
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> TripleStore:
    """The store that ``write_store`` left at ``path``, in this application or an earlier one."""
    rows = spark.read.schema(META).parquet(f"{path.rstrip('/')}/meta").collect()
    known = all(r.n is not None for r in rows)
    return TripleStore(spark, path.rstrip("/"), rows[0].folders, rows[0].buckets, {r.p: r.n for r in rows if r.p is not None} if known else None)


__all__ = ["TripleStore", "open_store", "write_store"]
