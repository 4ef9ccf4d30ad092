import zlib
from collections import defaultdict

import pytest

from tests.llm import data
from trellis.llm import shard as S


def _check(rows, texts, n):
    assert len(rows) == len(texts)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == want
    by = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    return by


def test_hard_cases(spark):
    rows = S.shard(data.table(spark), 4).collect()
    _check(rows, data.texts(), 4)
    group = defaultdict(set)
    of = defaultdict(set)
    for i, t in data.texts():
        of[i].add(t or "")
    for r in rows:
        group[r.text_crc32, r.size].add(r.shard)
    assert all(len(v) == 1 for v in group.values())


def test_balance_with_a_hot_group(spark):
    rows = [(i, "same text again " * 5) for i in range(400)] + [(1000 + i, f"own text {i} " * 6) for i in range(3000)]
    got = S.shard(data.table(spark, rows, False), 16).collect()
    _check(got, rows, 16)
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    mean = sum(size.values()) / 16
    assert len(size) == 16 and max(size.values()) < 1.05 * mean and min(size.values()) > 0.95 * mean


def test_group_over_a_shard_is_cut(spark):
    rows = [(i, "abc " * 20) for i in range(600)] + [(1000 + i, f"t{i} " * 20) for i in range(1200)]
    got = S.shard(data.table(spark, rows, False), 16).collect()
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    mean = sum(size.values()) / 16
    assert max(size.values()) < 1.05 * mean and min(size.values()) > 0.95 * mean


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (1, "a"), (1, "a")]])
def test_tiny(spark, rows):
    _check(S.shard(data.table(spark, rows, False), 16).collect(), rows, 16)


def test_packing_fills_by_room():
    where, room = S._pack([(1, 50), (2, 30), (3, 30), (4, 90)], 400, 4)
    assert sum(room) + 200 == 400 and len(where) == 4 and all(x >= 0 for x in room)
    where, room = S._pack([(1, 300)], 400, 4)
    assert where == {} and sum(room) == 400


def test_buckets_follow_the_rows():
    assert [S.bucket_bits(n) for n in (0, 10**6, 1 << 30, 1 << 31, 10**11, 10**15)] == [12, 12, 13, 14, 19, 20]


def test_laws_with_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BITS", 16)
    docs = data.table(spark)
    r = S.shard(docs, 4).collect()
    assert len(r) == docs.count()
    for k in {x.shard for x in r}:
        assert sorted(x.slot for x in r if x.shard == k) == list(range(sum(x.shard == k for x in r)))
    assert sum(x.size for x in r) == sum(len((t or "").encode()) + 1 for _, t in data.texts())
