"""Token-id files: patched frame-of-reference blocks with an index of block starts.

File: ``magic, blocks, index, footer``. A block holds up to ``BLOCK`` ids: their minimum is
subtracted and what is left packed at the width that ``SHARE`` of them need; the others
are exceptions, whose positions and high bits stand packed behind the block. The index
(Arrow) has the start of each block, and each document's id and number of tokens; the
footer says where it begins. So one block, or one document, is read without the rest.
"""

from __future__ import annotations

import io
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.bpe import Words, byte_level, together, vocabulary_path
from trellis.llm.runtime import filesystem, new_folder, plain_objects, ship, staged, table

MAGIC, BLOCK, SHARE = b"TPFOR1\r\n", 4096, 0.9
HEAD = struct.Struct("<IIBBBxI")
FOOT = struct.Struct("<QQ8s")


def pack(v: np.ndarray, width: int) -> bytes:
    """Unsigned numbers below 2**width, low bits first."""
    if not width or not len(v):
        return b""
    raw = np.ascontiguousarray(v, "<u2" if width <= 16 else "<u4").view(np.uint8).reshape(len(v), -1)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint32)
    padded = raw[: (n * width + 7) // 8] + bytes(8)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    at = np.arange(n, dtype=np.int64) * width
    return ((eight[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def encode_block(ids: np.ndarray, share: float = SHARE) -> bytes:
    low = int(ids.min())
    v = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.partition(v, k := min(len(v) - 1, int(share * len(v))))[k]).bit_length()
    out = np.flatnonzero(v >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    high = (v[out] >> np.uint32(width)).astype(np.uint32)
    at_width, high_width = (len(v) - 1).bit_length(), int(high.max()).bit_length() if len(high) else 0
    kept = v & np.uint32((1 << width) - 1)
    return HEAD.pack(low, len(v), width, at_width, high_width, len(out)) + pack(kept, width) + pack(out, at_width) + pack(high, high_width)


def decode_block(raw: bytes) -> np.ndarray:
    low, n, width, at_width, high_width, n_out = HEAD.unpack_from(raw)
    size = lambda k, w: (k * w + 7) // 8
    a = HEAD.size
    b = a + size(n, width)
    c = b + size(n_out, at_width)
    v = unpack(raw[a:b], n, width)
    if n_out:
        v[unpack(raw[b:c], n_out, at_width)] |= unpack(raw[c:], n_out, high_width) << np.uint32(width)
    return v + np.uint32(low)


class Writer:
    def __init__(self, sink, block: int = BLOCK):
        self.sink, self.block, self.at, self.rest, self.held = sink, block, len(MAGIC), [], 0
        self.starts: list[int] = []
        self.docs: list[tuple[pa.Array, pa.Array]] = []
        sink.write(MAGIC)

    def add(self, ids: pa.Array, lengths: list[int], tokens: np.ndarray) -> None:
        self.docs.append((ids, pa.array(lengths, pa.int64())))
        self.rest.append(tokens)
        self.held += len(tokens)
        if self.held >= self.block:
            self._write(self.held // self.block)

    def _write(self, full: int) -> None:
        flat = np.concatenate(self.rest)
        for i in range(0, full * self.block, self.block):
            self._put(flat[i : i + self.block])
        self.rest, self.held = [flat[full * self.block :]], len(flat) - full * self.block

    def _put(self, ids: np.ndarray) -> None:
        raw = encode_block(ids)
        self.starts.append(self.at)
        self.sink.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.rest))
        out = io.BytesIO()
        for t in (pa.table({"start": pa.array([*self.starts, self.at], pa.int64())}), pa.table({"id": pa.chunked_array([i for i, _ in self.docs]), "n": pa.chunked_array([n for _, n in self.docs])})):
            part = io.BytesIO()
            with pa.ipc.new_stream(part, t.schema) as w:
                w.write_table(t)
            out.write(struct.pack("<Q", part.tell()))
            out.write(part.getvalue())
        raw = zlib.compress(out.getvalue(), 1)
        self.sink.write(raw)
        self.sink.write(FOOT.pack(self.at, len(raw), MAGIC))


class Reader:
    """Of a file that can seek: documents in order, or ids from any place."""

    def __init__(self, source, size: int, block: int = BLOCK):
        self.source, self.block = source, block
        source.seek(size - FOOT.size)
        at, n, magic = FOOT.unpack(source.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        source.seek(at)
        raw = zlib.decompress(source.read(n))
        tables, i = [], 0
        while i < len(raw):
            (k,) = struct.unpack_from("<Q", raw, i)
            tables.append(pa.ipc.open_stream(raw[i + 8 : i + 8 + k]).read_all())
            i += 8 + k
        self.starts = tables[0]["start"].to_pylist()
        self.ids, self.lengths = tables[1]["id"], tables[1]["n"].to_numpy()

    def blocks(self, first: int = 0, last: int | None = None):
        for a, b in zip(self.starts[first:last], self.starts[first + 1 :], strict=False):
            self.source.seek(a)
            yield decode_block(self.source.read(b - a))

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th on; reads only their blocks."""
        a, b = start // self.block, -(-(start + n) // self.block)
        flat = np.concatenate([np.zeros(0, np.uint32), *self.blocks(a, b)])
        return flat[start - a * self.block : start - a * self.block + n]

    def documents(self):
        """Arrays of ids, document by document, holding a block beyond the document at most."""
        blocks, held = self.blocks(), np.zeros(0, np.uint32)
        for n in self.lengths:
            more, have = [held], len(held)
            while have < n:
                more.append(next(blocks))
                have += len(more[-1])
            held = np.concatenate(more) if len(more) > 1 else held
            yield held[:n]
            held = held[n:]


class Library:
    """The tokenizers library. Words that a worker hasn't met go to it together; texts with special tokens, and all texts of other kinds of tokenizer, as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.words = Words(self._run, self._each) if byte_level(json.load(f)) else None
        vocab = self.tok.get_vocab()
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        self.length[list(vocab.values())] = list(map(len, vocab))

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, words: list[str]) -> list[bytes]:
        """Words of letters stay words with a space before each, so they are one text, whose tokens are dealt back by their bytes."""
        ids = np.array(self.tok.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([1 + len(w if w.isascii() else w.encode()) for w in words])
        cuts, raw = [0, *(4 * (np.searchsorted(np.cumsum(self.length[ids]), ends) + 1)).tolist()], ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids one after the other; null is empty."""
        if self.words and not any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            return self.words.encode(texts)
        each = self._each([t or "" for t in texts.to_pylist()])
        return np.array([len(b) // 4 for b in each], np.int64), np.frombuffer(b"".join(each), "<u4")


_library: dict[str, Library] = {}


def library(path: str) -> Library:
    if path not in _library:
        _library[path] = Library(path)
    return _library[path]


def write_tokens(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Writes token files in ascending order of ids; returns part, path, n_docs, n_tokens, one row a file.

    Null ids come first. A null or empty text has the end id alone. A file's content
    follows from its rows alone, so a task that runs again writes the same file.
    """
    ship(docs.sparkSession)

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, own = f"{root}/part-{part:06d}.tpfor", f"{root}/.part-{part:06d}.{TaskContext.get().taskAttemptId()}"
        writer, n_docs, n_tokens, encode = None, 0, 0, library(path).encode
        with fs.open_output_stream(own) as sink:
            for b in batches:
                writer = writer or Writer(sink)
                for at, rows in together(b.column(1)):
                    with plain_objects():
                        n, ids = encode(b.column(1).slice(at, rows))
                    # The end id goes behind each document's own.
                    ends = np.cumsum(n + 1)
                    flat = np.full(int(ends[-1]), end_id, "<u4")
                    inner = np.ones(len(flat), bool)
                    inner[ends - 1] = False
                    flat[inner] = ids
                    writer.add(b.column(0).slice(at, rows), (n + 1).tolist(), flat)
                    n_docs, n_tokens = n_docs + rows, n_tokens + len(flat)
            if writer and n_docs:
                writer.close()
        if not n_docs:
            fs.delete_file(own)
            return
        fs.move(own, name)
        yield pa.record_batch([pa.array([part], pa.int64()), pa.array([f"{folder}/part-{part:06d}.tpfor"]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64("text")]
    files = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "part long, path string, n_docs long, n_tokens long")
    return staged(docs.sparkSession, files.repartition(1), "token-files", gather=False)


def read_tokens(files: DataFrame, id_type: str, keep: bool = True) -> DataFrame:
    """Per document of the files: id, start (ids before it in all files), n_tokens, ids_crc32, and with ``keep`` its ids."""
    ship(files.sparkSession)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = staged(files.sparkSession, files.select("part", "path", before.alias("base")), "token-bases")
    names = ["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    r = Reader(f, f.size())
                    start = base + np.concatenate([[0], np.cumsum(r.lengths)[:-1]]).astype(np.int64)
                    crc, ids = [], []
                    for d in r.documents():
                        crc.append(zlib.crc32(d.astype("<u4").tobytes()))
                        if keep:
                            ids.append(d.astype(np.int32))
                    cols = [r.ids.combine_chunks() if isinstance(r.ids, pa.ChunkedArray) else r.ids, pa.array(start), pa.array(r.lengths), pa.array(crc, pa.int64())]
                    yield from pa.Table.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * keep, names=names).to_batches(max_chunksize=10_000)

    n = max(1, based.count())
    return based.repartitionByRange(n, "part").mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep)


def op7_tokens(spark, sf_dir: str) -> DataFrame:
    """The contract's query: the files are written below the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    files = write_tokens(docs, vocabulary_path(), new_folder(spark, "tokens"))
    return read_tokens(files, docs.schema["doc_id"].dataType.simpleString(), keep=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
