import gzip
import hashlib

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from trellis.llm import warc as W
from trellis.llm.runtime import new_folder

HTML = "<html>" + "word " * 300 + "</html>"


def rows():
    out = [(i, f"http://www.Host{i % 3}.example.com:80/p/{i}?q=1#f", HTML if i % 4 == 0 else f"{HTML}{i}") for i in range(60)]
    out += [(100, None, None), (101, "http://a.b/", ""), (102, "http://a.b/", "short"), (103, "http://a.b/", "short"), (None, "http://a.b/", HTML), (104, "http://a.b/\nx", "é" * 600), (105, "ftp://user@z.org", "é" * 600), (7, rows_url(7), f"{HTML}7")]
    return out


def rows_url(i):
    return f"http://www.Host{i % 3}.example.com:80/p/{i}?q=1#f"


def test_round_trip(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("body", F.lit(2)).repartition(3)
    files = W.write_warc(pages, new_folder(spark, "t-warc"))
    got = W.read_warc(files).collect()
    assert len(got) == len(rows()) == sum(r.n_records for r in files.collect())
    last = {}
    for i, _, h in rows():
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            last[b] = max(last.get(b, -1), i)
    want = []
    for i, _, h in rows():
        b = (h or "").encode()
        to = last.get(b, i) if i is not None else None
        want.append((None if i is None else str(i), len(b), hashlib.sha1(b).hexdigest(), "response" if to == i else "revisit", None if to == i else str(to)))
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert all(bytes(r.payload) == dict((str(i), (h or "").encode()) for i, _, h in rows() if i is not None)[r.id] for r in got if r.record_type == "response" and r.id)


def test_archives_are_gzip_members_in_key_order(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    files = W.write_warc(pages, new_folder(spark, "t-warc")).orderBy("part").collect()
    assert all(a.last_key <= b.first_key for a, b in zip(files, files[1:], strict=False))
    fs, path = pafs.FileSystem.from_uri(files[0].warc)
    with fs.open_input_file(path) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_lookup(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    files = W.write_warc(pages, new_folder(spark, "t-warc"))
    got = W.lookup(files, [rows_url(5), "http://a.b/", "http://none.org/"]).collect()
    assert sorted(r.id or "" for r in got) == sorted(["5", "101", "102", "103", ""])


def test_index_finds_keys_over_block_borders():
    import io

    f = io.BytesIO()
    w = W.IndexWriter(f, lines=4)
    keys = sorted(f"k{i // 7:03d}" for i in range(100))
    for n, k in enumerate(keys):
        w.add(k, n, 1, "response", "d")
    w.close()
    i = W.Index(f, len(f.getvalue()))
    assert all([x[1] for x in i.find(k)] == [n for n, q in enumerate(keys) if q == k] for k in [*set(keys), "a", "k0005", "z"])


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_warc(W.write_warc(pages, new_folder(spark, "t-warc"))).count() == 0
