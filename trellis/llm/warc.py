"""WARC archives with a two-level capture index.

Records are written in the order of their sort-friendly URL keys (host reversed), each a
gzip member of its own. Beside each archive lies its index: lines in the order of keys,
compressed in blocks, and after them a sparse directory with the first key and the place
of each block. A look-up searches the directory by halves, reads one block's range and
then the records' ranges.

What a revisit refers to comes from one small table of digests. It travels to the
writers through the same exchange as the pages, so page contents are moved once.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.runtime import filesystem, new_folder, ship, slices, staged, table

LINES, LEAST, DATE = 512, 1000, "2000-01-01T00:00:00Z"
FOOT, MAGIC = struct.Struct("<QQ8s"), b"TCDXI1\r\n"
#: Fixed value: the profile that marks a record as a revisit by equal payload digest (WARC 1.1).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: F.Column) -> F.Column:
    """Sort key: lower-case host reversed by commas, then port, path and query; scheme, www. and fragment go."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?:]*)", 1)), r"^www\d*\.", "")
    port = F.regexp_extract(rest, r"^[^/?]*?(:\d+)(?:[/?]|$)", 1)
    tail = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(tail == "", F.lit("/")).otherwise(tail))


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = lambda v: "".join(c if c >= " " else "%%%02X" % ord(c) for c in v)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields).encode() + b"\r\n"


def record(key: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record, compressed; the same input gives the same bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, k)}>"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(f"page:{key}")), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(f"page:{refers_to}")), ("X-Refers-To-Key", refers_to)]
    fields += [("X-Key", key), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return gzip.compress(_header(fields) + block + b"\r\n\r\n", 3, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one compressed record."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class IndexWriter:
    def __init__(self, sink, lines: int = LINES):
        self.sink, self.lines, self.held, self.at, self.directory = sink, lines, [], 0, []

    def add(self, key: str, offset: int, length: int, kind: str, digest: str) -> None:
        self.held.append(json.dumps([key, offset, length, kind, digest]))
        if len(self.held) == self.lines:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            raw = zlib.compress("\n".join(self.held).encode())
            self.directory.append([json.loads(self.held[0])[0], self.at, len(raw)])
            self.sink.write(raw)
            self.at += len(raw)
            self.held = []

    def close(self) -> None:
        self._flush()
        raw = zlib.compress(json.dumps(self.directory).encode())
        self.sink.write(raw + FOOT.pack(self.at, len(raw), MAGIC))


class Index:
    """One archive's index; only the directory is held."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOT.size)
        at, n, magic = FOOT.unpack(source.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a capture index")
        source.seek(at)
        self.directory = json.loads(zlib.decompress(source.read(n)))
        self.keys = [d[0] for d in self.directory]

    def block(self, k: int) -> list[list]:
        _, at, n = self.directory[k]
        self.source.seek(at)
        return [json.loads(x) for x in zlib.decompress(self.source.read(n)).decode().split("\n")]

    def find(self, key: str) -> list[list]:
        """Lines of a key. Equal keys may begin in the block before the first that starts with it."""
        k, out = max(0, bisect_left(self.keys, key) - 1), []
        while k < len(self.keys) and self.keys[k] <= key:
            out += [x for x in self.block(k) if x[0] == key]
            k += 1
        return out


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes archives and indexes; returns part, warc, index, first_key, last_key, n_records, one row an archive.

    Of records with equal payloads of at least ``least`` bytes the one with the largest id
    is the response. A null payload is empty, a null URL an empty one. Pages with a null
    id are responses. Of rows with the same id and payload, all are responses or none.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), surt(F.col(url_col)).alias("key"), body.alias("body"))
    slim = staged(spark, p.select("id", "key", F.octet_length("body").cast("long").alias("n"), F.sha1("body").alias("digest")).where(F.col("id").isNotNull() & (F.col("n") >= least)), "warc-digests")
    several = slim.groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("copies")).where("copies > 1").select("digest", "original")
    again = slim.join(several, "digest").where(F.col("id") != F.col("original"))
    marks = again.select("key", F.col("id").cast("string").alias("id"), F.lit(0).alias("page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"), F.col("digest"), F.col("original").cast("string").alias("original"))
    rows = p.select("key", F.col("id").cast("string").alias("id"), F.lit(1).alias("page"), "url", "body", F.sha1("body").alias("digest"), F.lit(None).cast("string").alias("original"))

    def run(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        names = {e: (f"{root}/part-{part:06d}.{e}", f"{root}/.part-{part:06d}.{e}.{attempt}") for e in ("warc.gz", "cdxi")}
        n, at, mark, first, last = 0, 0, None, "", ""
        with fs.open_output_stream(names["warc.gz"][1]) as archive, fs.open_output_stream(names["cdxi"][1]) as lines:
            index = IndexWriter(lines)
            for b in slices(batches):
                for key, i, page, url, payload, digest, original in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if not page:
                        mark = (key, i, digest, original)
                        continue
                    to = mark[3] if mark and mark[:3] == (key, i, digest) else None
                    raw = record("" if i is None else i, url or "", payload, digest, to)
                    archive.write(raw)
                    index.add(key, at, len(raw), "response" if to is None else "revisit", digest)
                    first, last, n, at = first if n else key, key, n + 1, at + len(raw)
            index.close()
        for final, own in names.values():
            fs.move(own, final) if n else fs.delete_file(own)
        if n:
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([f"{folder}/part-{part:06d}.warc.gz"]), pa.array([f"{folder}/part-{part:06d}.cdxi"]), pa.array([first]), pa.array([last]), pa.array([n], pa.int64())], names=["part", "warc", "index", "first_key", "last_key", "n_records"])

    files = marks.unionByName(rows).repartitionByRange("key", "id").sortWithinPartitions("key", "id", "digest", "page", "url").mapInArrow(run, "part long, warc string, index string, first_key string, last_key string, n_records long")
    return staged(spark, files.repartition(1), "warc-files", gather=False)


SCHEMA = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _of(raw: bytes, keep: bool) -> tuple:
    fields, http, payload = parse(raw)
    kind = fields["WARC-Type"]
    digest = hashlib.sha1(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    n = len(payload) if kind == "response" else int(http["Content-Length"])
    out = (fields["X-Key"] or None, fields["WARC-Target-URI"], n, digest, kind, fields.get("X-Refers-To-Key"))
    return (*out, payload if kind == "response" else None) if keep else out


def _batch(rows: list[tuple], keep: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names[: 6 + keep])


def read_warc(files: DataFrame, keep: bool = True) -> DataFrame:
    """Every record, each read from its range as the index gives it; ids as strings, with ``keep`` the payload of responses."""
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            for warc, index in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                fs, name = filesystem(warc)
                _, at = filesystem(index)
                with fs.open_input_file(name) as archive, fs.open_input_file(at) as f:
                    i = Index(f, f.size())
                    for k in range(len(i.directory)):
                        rows = []
                        for _, offset, length, _, _ in i.block(k):
                            archive.seek(offset)
                            rows.append(_of(archive.read(length), keep))
                        yield _batch(rows, keep)

    n = max(1, files.count())
    return files.repartitionByRange(n, "part").mapInArrow(run, SCHEMA + ", payload binary" * keep)


def lookup(files: DataFrame, urls: list[str]) -> DataFrame:
    """Records of a few URLs: archives by their key ranges, then directory, block and record ranges."""
    spark = files.sparkSession
    ship(spark)
    keys = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(surt(F.col("u")).alias("k")).distinct().collect()]
    wanted = files.where(F.exists(F.array(*map(F.lit, keys)), lambda k: (F.col("first_key") <= k) & (k <= F.col("last_key"))))

    def run(batches):
        for b in batches:
            for warc, index in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                fs, name = filesystem(warc)
                _, at = filesystem(index)
                with fs.open_input_file(name) as archive, fs.open_input_file(at) as f:
                    i, rows = Index(f, f.size()), []
                    for key in keys:
                        for _, offset, length, _, _ in i.find(key):
                            archive.seek(offset)
                            rows.append(_of(archive.read(length), True))
                    if rows:
                        yield _batch(rows, True)

    return wanted.mapInArrow(run, SCHEMA + ", payload binary")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """The contract's query: archives are written below the shared folder and read back."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    r = read_warc(write_warc(pages, new_folder(spark, "warc")), keep=False)
    return r.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
