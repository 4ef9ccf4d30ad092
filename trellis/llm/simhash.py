"""SimHash near-duplicates, linked through BK-trees.

Each text gets a 64-bit fingerprint; two link at ``radius`` differing bits or fewer. Only
distinct fingerprints are compared. Two that link agree on at least ``m - radius`` of any
``m`` blocks of bits, so for each choice of that many blocks the fingerprints are dealt
into shards by the value of those bits, and each shard gets a BK-tree: a node's children
are keyed by their Hamming distance to it, and a search at distance ``d`` follows only
the edges ``d - radius`` to ``d + radius``. The number of blocks follows the number of
fingerprints, so that shards stay small; a shard that is hot all the same is dealt on by
more of the bits in which its values differ (again every pair that links meets somewhere).

Trees are not broadcast from the driver: they grow with the data, and no bound could be
given. Each one is built and searched in the task that holds its shard.

A search leaves out a subtree that is known to be wholly in the searcher's component
already, so a dense group of near copies costs about its size, not its square. What
leaves a shard is one link a node, to the least of its component there, never pairs;
shards with much the same members give the same links.
Components over all shards come from label propagation with pointer jumping.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.runtime import lean, ship, slices, staged, table

SEED, BITS, RADIUS, SHINGLE = 42, 64, 4, 4
#: Fingerprints aimed at in a shard, and the number beyond which a shard is dealt on.
SHARD, HOT = 64, 20_000


def majority(h: np.ndarray) -> int:
    """64 bits; bit i is 1 if it is in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles; of the whole sequence if it has fewer words, none without words."""
    words = text.lower().split() if text else []
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start, end, strict=True)], np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is 1 if it is in over half the shingles' hashes. No words: 0."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp: the fingerprint as a signed long."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            own = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(own.view(np.int64), pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(lean(run), f"id {kind}, fp long")


class BKTree:
    """Fingerprints of one shard with the components that links within it make."""

    def __init__(self, radius: int):
        self.radius = radius
        self.value: list[int] = []
        self.node: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.uniform: list[bool] = []

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, x: int, node: int | None = None) -> None:
        """Link x with all in reach, then hang it in its place."""
        self.node.append(x if node is None else node)
        me, radius, value, children, parent, uniform, find = len(self.value), self.radius, self.value, self.children, self.parent, self.uniform, self.find
        value.append(x)
        children.append({})
        parent.append(me)
        uniform.append(True)
        if not me:
            return
        todo = [0]
        while todo:
            n = todo.pop()
            root = find(n)
            if uniform[n] and root == find(me):
                continue
            d = (value[n] ^ x).bit_count()
            if d <= radius and root != (mine := find(me)):
                parent[max(root, mine)] = min(root, mine)
            for e, c in children[n].items():
                if d - radius <= e <= d + radius:
                    todo.append(c)
        n, mine, path = 0, find(me), []
        while True:
            path.append(n)
            d = (value[n] ^ x).bit_count()
            if d not in children[n]:
                children[n][d] = me
                break
            n = children[n][d]
        for n in path:
            if uniform[n] and find(n) != mine:
                uniform[n] = False

    def links(self) -> list[tuple[int, int]]:
        """Each component as links from its least node, which other shards with much the same members repeat."""
        members: dict[int, set[int]] = {}
        for i, x in enumerate(self.node):
            members.setdefault(self.find(i), set()).add(x)
        return [(least, x) for m in members.values() if len(m) > 1 for least in (min(m),) for x in m if x != least]


def _ranges(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal runs of the given bits."""
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def masks_for(n: int, radius: int) -> list[int]:
    """Masks of which every two values within the radius agree on one, for shards of about SHARD among n values."""
    for m in range(radius + 1, 2 * radius + 1):
        blocks = _ranges(list(range(BITS)), m)
        masks = [sum(c) for c in combinations(blocks, m - radius)]
        if n <= SHARD << min(x.bit_count() for x in masks):
            break
    return masks


def finer(radius: int) -> F.Column:
    """Masks with more bits than ``mask``: values that differ only in ``bits``, and in ``radius`` of them or fewer, agree on one of these."""
    cut = lambda i: f"cast(size(bits) * ({i}) div {radius + 1} as int)"
    run = f"slice(bits, {cut('i')} + 1, {cut('i + 1')} - {cut('i')})"
    return F.expr(f"transform(sequence(0, {radius}), i -> mask | aggregate({run}, 0L, (a, b) -> a | shiftleft(1L, b)))")


def links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """a, b: trees over the nodes that link within each shard, from rows of ``node`` and ``fp``, one for each ``fp``."""
    spark = fps.sparkSession
    masks = masks_for(fps.count(), radius)
    deal = lambda ms: F.explode(F.array(*(F.lit(_signed(m)) for m in ms))).alias("mask")
    value = F.col("fp").bitwiseAND(F.col("mask"))
    row = ["fp", "node"]
    dealt = fps.select(deal(masks), *row)
    # A shard's values differ in some bits only. Dealt on by those, each round makes it smaller; where no more than the radius vary, all are in reach.
    varying = F.expr(f"filter(sequence(0, {BITS - 1}), b -> shiftrightunsigned(bit_or(fp) ^ bit_and(fp), b) & 1L = 1L)")
    while True:
        shards = dealt.groupBy("mask", value.alias("value")).agg(F.count("*").alias("n"), varying.alias("bits"))
        full = staged(spark, shards.where((F.col("n") > hot) & (F.size("bits") > radius)).select("mask", "value", finer(radius).alias("masks")), "simhash-hot")
        if full.isEmpty():
            break
        valued = dealt.withColumn("value", value)
        on = valued.join(full, ["mask", "value"]).select(F.explode("masks").alias("mask"), *row).distinct()
        dealt = staged(spark, valued.join(full, ["mask", "value"], "left_anti").select("mask", *row).unionByName(on), "simhash-dealt")

    def run(batches):
        key, tree, a, b = None, None, [], []
        for batch in batches:
            for mask, fp, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (mask, fp & mask) != key:
                    if tree:
                        out = tree.links()
                        a += [x for x, _ in out]
                        b += [y for _, y in out]
                    key, tree = (mask, fp & mask), BKTree(radius)
                tree.add(fp & (1 << BITS) - 1, node)
            yield _pairs(a, b)
            a, b = [], []
        if tree:
            out = tree.links()
            yield _pairs([x for x, _ in out], [y for _, y in out])

    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "mask", value).sortWithinPartitions("mask", value, "fp").mapInArrow(lean(run), "a long, b long").distinct()


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.array(x, np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that each can reach. Rounds grow as the logarithm of the longest path."""
    spark = links.sparkSession
    both = staged(spark, links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hooked = labels.join(near, "node").select("node", F.least("root", "m").alias("up"), F.col("root").alias("was"))
        jumped = hooked.join(labels.select(F.col("node").alias("up"), F.col("root").alias("to")), "up").select("node", F.col("to").alias("root"), (F.col("to") != F.col("was")).alias("moved"))
        new = staged(spark, jumped, "labels")
        labels = new.select("node", "root")
        if new.where("moved").isEmpty():
            return labels


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the least id that links reach).

    Null and empty texts have fingerprint zero and link like others. A component's id is
    the least of its ids that aren't null; it is null if there is none. Repeated rows and
    ids stay rows of their own. An empty table gives none. Further columns are ignored.
    """
    spark = docs.sparkSession
    of = staged(spark, fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = staged(spark, of.groupBy("fp").agg(F.min("id").alias("first")).withColumn("root", F.col("fp")), "distinct-fingerprints")
    edges = staged(spark, links(fps.select(F.col("fp").alias("node"), "fp"), radius, hot), "tree-links")
    if not edges.isEmpty():
        to = components(edges).select(F.col("node").alias("fp"), F.col("root").alias("to"))
        fps = staged(spark, fps.join(to, "fp", "left").select("fp", "first", F.coalesce("to", "root").alias("root")), "rooted")
    # Written, so that both sides of the next join are dealt anew and a large component's rows can be split.
    least = staged(spark, fps.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    named = fps.select("fp", "root").join(least, "root").select("fp", "component_id")
    return of.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's query."""
    return cluster(table(spark, sf_dir, "documents"))
