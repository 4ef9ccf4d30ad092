"""Near duplicates by the exact share of their shingles; SimHash trees and MinHash only propose what is compared.

A text is the set of its shingles' hashes, and texts with equal sets are one node. The
BK-trees of ``simhash`` propose nodes whose fingerprints are within their radius. Such a
radius ends well above a share of 0.8, so nodes that agree on a band of minima (``BANDS``
bands of ``ROWS``: a pair that shares 0.8 is missed once in 360 times, one that shares 0.85
once in 26 000) are candidates as well. The connected groups of candidates are then
compared by the sets themselves, so what links shares ``share`` or more. Each candidate's
set reaches its group once.

A group is compared in one task, each pair that isn't linked already. One of more than
``LARGE`` nodes or ``BYTES`` is compared in rounds that deal it over many tasks: some
nodes lead, and are compared with all of the group; nodes of one linked component needn't
be compared with each other, so it is done when all that haven't led are in one. A dense
group takes a few rounds of few leaders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.runtime import lean, ship, slices, staged, struct_of
from trellis.llm.simhash import RADIUS, components, hashes, links, majority

BANDS, ROWS = 32, 8
#: Nodes and bytes of sets that one task compares, leaders of a first round, members of a part and leaders of a chunk.
LARGE, BYTES, LEADERS, PART = 300, 8 << 20, 64, 64
_draw = np.random.default_rng(42)
XOR = _draw.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]
ODD = _draw.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None] | np.uint32(1)


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(hashes(text, shingle))


def bands(s: np.ndarray) -> list[int]:
    """A key for each band of minima, none for an empty set."""
    if not len(s):
        return []
    h, least = (s >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 2048):
        least = np.minimum(least, ((h[None, i : i + 2048] ^ XOR) * ODD).min(1))
    b = least.tobytes()
    return [xxhash.xxh64_intdigest(b[4 * ROWS * i : 4 * ROWS * (i + 1)], i) for i in range(BANDS)]


def shares(a: np.ndarray, b: np.ndarray, share: float) -> bool:
    """Whether two sets have ``share`` or more of their union in common."""
    if min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    j = np.searchsorted(a, b)
    both = int((a[np.minimum(j, len(a) - 1)] == b).sum())
    return both >= share * (len(a) + len(b) - both)


def _long(x) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())


def _rows(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """The rows as structs ``row``, with ``id``, ``at`` (a number of their own), ``node``, ``bands`` and ``fp``, the SimHash of the distinct shingles."""
    place = docs.columns.index(text_col)
    given = docs.select(struct_of(docs.columns).alias("row"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("at"))

    def run(batches):
        for b in slices(batches):
            sets = [shingles(t.encode() if isinstance(t, str) else t, shingle) for t in b.column(0).field(place).to_pylist()]
            keys = pa.array([np.array(bands(s), np.uint64).view(np.int64) for s in sets], pa.list_(pa.int64()))
            nodes = _long([xxhash.xxh64_intdigest(s.tobytes()) for s in sets])
            fps = _long([majority(s) for s in sets])
            yield pa.record_batch([*b.columns, nodes, keys, fps], names=["row", "id", "at", "node", "bands", "fp"])

    return given.mapInArrow(lean(run), T.StructType([*given.schema, T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())]))


def proposed(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links between nodes of one ``fp``, and between the least nodes of fingerprints that the trees link."""
    fps = staged(nodes.sparkSession, nodes.groupBy("fp").agg(F.min("node").alias("least")), "near-fingerprints")
    trees = links(fps.select(F.col("least").alias("node"), "fp"), radius)
    same = nodes.join(fps, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return trees.select("a", "b").unionByName(same)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """comp, node, set from comp, node, text."""

    def run(batches):
        for b in slices(batches):
            sets = [shingles(t, shingle).tobytes() for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["comp", "node", "set"])

    return texts.select("comp", "node", F.col("text").cast("binary")).mapInArrow(lean(run), "comp long, node long, set binary")


def _find(parent: dict, x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent.setdefault(parent[x], parent[x])
    return x


def _link(parent: dict, a: int, b: int) -> None:
    a, b = _find(parent, a), _find(parent, b)
    parent[max(a, b)] = min(a, b)


def _within(sets: DataFrame, share: float) -> DataFrame:
    """node, root of groups that one task compares."""

    def solved(nodes: list, own: list):
        parent: dict[int, int] = {}
        for i, n in enumerate(nodes):
            for j in range(i):
                if _find(parent, n) != _find(parent, nodes[j]) and shares(own[i], own[j], share):
                    _link(parent, n, nodes[j])
        return pa.record_batch([pa.array(nodes, pa.int64()), pa.array([_find(parent, n) for n in nodes], pa.int64())], names=["node", "root"])

    def run(batches):
        key, nodes, own = None, [], []
        for b in slices(batches):
            for c, n, s in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != key:
                    if nodes:
                        yield solved(nodes, own)
                    key, nodes, own = c, [], []
                nodes.append(n)
                own.append(np.frombuffer(s, np.uint64))
        if nodes:
            yield solved(nodes, own)

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.select("comp", "node", "set").repartition(n, "comp").sortWithinPartitions("comp", "node").mapInArrow(lean(run), "node long, root long")


def _led(dealt: DataFrame, share: float) -> DataFrame:
    """a, b: components that a leader and a member of a part link."""

    def run(batches):
        key, lead, parent = None, [], {}
        for b in slices(batches):
            out = set()
            for *k, member, root, s in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if k != key:
                    key, lead, parent = k, [], {}
                s = np.frombuffer(s, np.uint64)
                if not member:
                    lead.append((root, s))
                    continue
                for r, o in lead:
                    if _find(parent, r) != _find(parent, root) and shares(o, s, share):
                        _link(parent, r, root)
                        out.add((min(r, root), max(r, root)))
            yield pa.record_batch([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = ["comp", "part", "chunk", "member", "root", "set"]
    return dealt.select(*row).repartition(n, "comp", "part", "chunk").sortWithinPartitions("comp", "part", "chunk", "member").mapInArrow(lean(run), "a long, b long").distinct()


def _in_rounds(sets: DataFrame, share: float) -> DataFrame:
    """node, root of groups that are too large for one task.

    A round's facts have one row for each such group; whether they are broadcast is left to
    Spark, which knows the size of what is staged.
    """
    spark, turn = sets.sparkSession, 0
    state = sets.select("comp", "node", "n", F.col("node").alias("root"), F.lit(False).alias("led"))
    while True:
        # All that haven't led and aren't in their group's largest component have to, at last; a first few join most of a dense group.
        open_ = state.where(~F.col("led")).groupBy("comp", "root").agg(F.count("*").alias("k"))
        main = staged(spark, open_.groupBy("comp").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("k")).select("comp", F.col("m.root").alias("main"), (F.col("k") - F.col("m.k")).alias("left")), "near-main")
        main = main.where(F.col("left") > 0)
        if main.isEmpty():
            return state.select("node", "root")
        every = F.greatest(F.lit(1), (F.col("left") / (LEADERS << turn)).cast("long"))
        chosen = ~F.col("led") & (F.col("root") != F.col("main")) & (F.pmod(F.xxhash64("node", F.lit(turn)), every) == 0)
        now = staged(spark, state.join(main, "comp").withColumn("leads", chosen), "near-round")
        count = now.where("leads").groupBy("comp").agg(F.ceil(F.count("*") / PART).alias("chunks"))
        now = now.join(count, "comp").withColumn("parts", F.ceil(F.col("n") / PART)).join(sets.select("node", "set"), "node")
        of = lambda what, many: F.pmod(F.xxhash64("node", F.lit(what)), F.col(many))
        each = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))
        row = ["comp", "part", "chunk", "member", "root", "set"]
        leaders = now.where("leads").withColumn("chunk", of("chunk", "chunks")).withColumn("part", each("parts")).withColumn("member", F.lit(False))
        members = now.withColumn("part", of("part", "parts")).withColumn("chunk", each("chunks")).withColumn("member", F.lit(True))
        edges = staged(spark, _led(leaders.select(*row).unionByName(members.select(*row)), share), "near-links")
        state = state.join(main, "comp", "left").withColumn("led", F.col("led") | F.coalesce(chosen, F.lit(False))).drop("main", "left")
        if not edges.isEmpty():
            to = components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
            state = state.join(to, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")
        state, turn = staged(spark, state, "near-state"), turn + 1


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, share: float = 0.8, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """The rows as structs ``row`` with ``at`` and ``node``, and for each node its ``component`` and ``first``: the least (no id, id, at) of its rows.

    Null and empty texts have no shingles and are one node; a text of fewer words than a
    shingle is one shingle. Repeated rows and null or repeated ids are rows of their own
    of one node; of those with one id the first read comes first. An empty table gives
    none. Further columns go along, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = staged(spark, _rows(docs, id_col, text_col, shingle), "near-rows")
    nodes = staged(spark, rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first"), F.min("at").alias("at"), F.min("fp").alias("fp")), "near-nodes")
    keyed = rows.select("node", F.explode("bands").alias("key"))
    shared = staged(spark, keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least"), "near-shared")
    banded = keyed.join(shared, "key").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    edges = staged(spark, banded.unionByName(proposed(nodes)).distinct(), "near-candidates")
    if edges.isEmpty():
        return rows, nodes.select("node", F.col("node").alias("component"), "first")
    groups = components(edges).select("node", F.col("root").alias("comp"))
    texts = rows.select("at", F.col("row")[text_col].alias("text")).join(groups.join(nodes.select("node", "at"), "node"), "at")
    sets = staged(spark, _sets(texts, shingle), "near-sets")
    size = staged(spark, sets.groupBy("comp").agg(F.count("*").alias("n"), F.sum(F.length("set")).alias("bytes")), "near-sizes").where((F.col("n") > large) | ((F.col("bytes") > BYTES) & (F.col("n") > 2))).select("comp", "n")
    roots = _within(sets.join(size, "comp", "left_anti"), share)
    if not size.isEmpty():
        roots = roots.unionByName(_in_rounds(staged(spark, sets.join(size, "comp"), "near-large"), share))
    roots = staged(spark, roots, "near-roots")
    return rows, nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"), "first")
