"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of ``WINDOW`` consecutive words of a benchmark item, or the
whole item if it has fewer. The search looks at the last two words of the window it
stands on (the block): the shift table says how far the window may move on without
passing over an occurrence, and only at shift 0 are the patterns that end in that
block compared, word by word.

The benchmark is cut into files of at most ``block_words`` words. The documents are
read once, by one Python process a core: it holds one block's tables at a time, and where
there are several blocks, they take turns over ``GROUP_BYTES`` of documents. So memory
has a fixed bound however large the benchmark is, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.runtime import FILE_BYTES, column, filesystem, lean, new_folder, ship, slices, struct_of

WINDOW = 13
BLOCK_WORDS = 500_000
GROUP_BYTES = 64 << 20
#: Bytes of words are 0-9, a-z after folding A-Z, and all of 0x80 and above.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class WuManber:
    """Patterns of one length ``m`` over sequences of words."""

    def __init__(self, m: int, items: list[list[bytes]], at: list[tuple[int, int]]):
        self.m, self.items = m, items
        self.b = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict[tuple, int] = {}
        # Equal windows are one pattern, with all items it is in.
        self.owners: list[set[int]] = []
        self.buckets: dict[tuple, dict[bytes, list[tuple[int, int, int]]]] = {}
        known: dict[tuple, int] = {}
        for i, o in at:
            window = tuple(items[i][o : o + m])
            if window in known:
                self.owners[known[window]].add(i)
                continue
            known[window] = len(self.owners)
            self.owners.append({i})
            for end in range(b, m + 1):
                block = window[end - b : end]
                if self.shift.get(block, self.default) > m - end:
                    self.shift[block] = m - end
            self.buckets.setdefault(window[m - b :], {}).setdefault(window[0], []).append((known[window], i, o))

    def search(self, words: list[bytes], hit: bytearray, found: set[int]) -> None:
        seen: set[int] = set()
        m, b, default, shift, buckets = self.m, self.b, self.default, self.shift.get, self.buckets
        end, n, mark = m, len(words), b"\1" * m
        while end <= n:
            block = tuple(words[end - b : end])
            step = shift(block, default)
            if step:
                end += step
                continue
            start = end - m
            for k, i, o in buckets.get(block, {}).get(words[start], ()):
                if words[start:end] == self.items[i][o : o + m]:
                    hit[start:end] = mark
                    seen.add(k)
            end += 1
        found.update(*(self.owners[k] for k in seen))


class Matcher:
    """All patterns of one benchmark block: a search for each length."""

    def __init__(self, rows: list[tuple[str, bytes | None]], window: int):
        self.ids = [k for k, _ in rows]
        items = [words_of(t) for _, t in rows]
        at: dict[int, list[tuple[int, int]]] = {}
        for i, w in enumerate(items):
            m = min(window, len(w))
            if m:
                at.setdefault(m, []).extend((i, o) for o in range(len(w) - m + 1))
        self.searches = [WuManber(m, items, x) for m, x in sorted(at.items())]

    def search(self, words: list[bytes], hit: bytearray) -> set[str]:
        found: set[int] = set()
        for s in self.searches:
            s.search(words, hit, found)
        return {self.ids[i] for i in found}


def _pieces(batches, block_words: int, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items, a block at a time. One that is longer than a block comes in pieces, which overlap so that each window is in one."""
    size = max(block_words, window)
    block, n = [], 0
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = words_of(t)
            for at in range(0, max(1, len(w) - window + 1), size - window + 1):
                piece = w[at : at + size]
                if block and n + len(piece) > block_words:
                    yield block
                    block, n = [], 0
                block.append((k, b" ".join(piece)))
                n += len(piece)
    if block:
        yield block


def write_blocks(items: DataFrame, folder: str, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """Writes the items in files of at most ``block_words`` words each and gives their paths, in order.

    Spark's tasks cut and write; only the paths come to the driver. A task that runs again
    writes the same file under the same name. Items without an id or a text are left out.
    """
    ship(items.sparkSession)
    rows = items.where(column(id_col).isNotNull() & column(text_col).isNotNull()).select(column(id_col).cast("string").alias("id"), column(text_col).cast("binary").alias("text"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())

    def run(batches):
        from pyspark import TaskContext

        part, fs, root = TaskContext.get().partitionId(), *filesystem(folder)
        fs.create_dir(root, recursive=True)
        paths = []
        for k, block in enumerate(_pieces(batches, block_words, window)):
            name, own = f"{root}/block-{part:06d}-{k:06d}.arrow", f"{root}/.block-{part:06d}-{k:06d}.{TaskContext.get().taskAttemptId()}"
            t = pa.table({"id": pa.array([i for i, _ in block]), "text": pa.array([x for _, x in block], pa.binary())})
            with fs.open_output_stream(own) as sink, pa.ipc.new_file(sink, t.schema) as w:
                w.write_table(t)
            fs.move(own, name)
            paths.append(f"{folder}/block-{part:06d}-{k:06d}.arrow")
        yield pa.record_batch([pa.array(paths, pa.string())], names=["path"])

    files = max(1, min(size // FILE_BYTES, 2**31 - 1))
    return sorted(r.path for r in rows.coalesce(files).mapInArrow(run, "path string").collect())


_built: dict[tuple, Matcher] = {}


def _matcher(path: str, window: int) -> Matcher:
    """Built once in a worker; the last block's takes the place of the one before."""
    if (path, window) not in _built:
        _built.clear()
        fs, name = filesystem(path)
        with fs.open_input_file(name) as f:
            t = pa.ipc.open_file(f).read_all()
        _built[path, window] = Matcher(list(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)), window)
    return _built[path, window]


def _groups(batches, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of a few rows in groups of about ``size`` bytes."""
    group, n = [], 0
    for s in slices(batches):
        group.append(s)
        n += s.nbytes
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


def _spans(hit: bytearray) -> list[int]:
    """Start and end of each run of hit words, in turn."""
    out, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out += (at, end)
        at = hit.find(1, end)
    return out


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, n_words, hit_spans (start, end, start, end, ... in words) and item_ids (sorted as strings), and with ``carry`` a struct ``carried`` of those columns.

    A null or empty text has no words, so nothing occurs in it; an item without words
    or without an id is never found. Equal windows of several items count for each.
    Rows with a null or repeated id are rows of the result like any other. Texts and items
    of any length count whole. Without documents there are no rows, without items nothing
    occurs. Further columns of either table are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    paths = write_blocks(items, new_folder(spark, "benchmark"), item_col, item_text_col, window, block_words)
    # A text that is carried isn't sent a second time.
    place = carry.index(text_col) if text_col in carry else None
    rows = docs.select(column(id_col).alias("id"), *([column(text_col).alias("text")] if place is None else []), *([struct_of(carry).alias("carried")] if carry else []))

    def run(batches):
        # One block: its tables stay. Several: they take turns over some megabytes of documents each.
        for group in _groups(batches, GROUP_BYTES if len(paths) > 1 else 0):
            counts, hits, found = [], {}, {}
            for turn, path in enumerate(paths or [""]):
                matcher, k = _matcher(path, window) if path else None, 0
                for s in group:
                    texts = s.column(1) if place is None else s.column(1).field(place)
                    for text in texts.cast(pa.binary()).to_pylist():
                        words = words_of(text)
                        if not turn:
                            counts.append(len(words))
                        hit = hits.get(k) or bytearray(len(words))
                        if matcher and (ids := matcher.search(words, hit)):
                            hits[k], found[k] = hit, found.get(k, set()) | ids
                        k += 1
            at = 0
            for s in group:
                own = range(at, at + s.num_rows)
                at += s.num_rows
                spans = pa.array([_spans(hits[k]) if k in hits else [] for k in own], pa.list_(pa.int32()))
                ids = pa.array([sorted(found.get(k, ())) for k in own], pa.list_(pa.string()))
                carried = [s.column("carried")] if carry else []
                yield pa.record_batch([s.column(0), pa.array(counts[own.start : own.stop], pa.int64()), spans, ids, *carried], names=["id", "n_words", "hit_spans", "item_ids", "carried"][: 4 + len(carried)])

    kinds = [rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.IntegerType())), T.StructField("item_ids", T.ArrayType(T.StringType()))]
    return rows.mapInArrow(lean(run), T.StructType([*kinds, *([rows.schema["carried"]] if carry else [])])).withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """``occurrences`` with n_hit (hit words), n_items and contaminated: at least one word in 20 is hit."""
    o = occurrences(docs, items, **kw)
    n_hit = F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return o.withColumn("n_hit", n_hit).withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's query: every document against the whole benchmark."""
    from trellis.llm.runtime import table

    d = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
