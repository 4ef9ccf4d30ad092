import hashlib
import random
import re

import pytest

from tests.llm import data
from trellis.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for k, x in items:
            v = words(x)
            m = min(13, len(v))
            for o in range(len(v) - m + 1 if m else 0):
                for a in range(len(w) - m + 1):
                    if w[a : a + m] == v[o : o + m] and k is not None:
                        hit.update(range(a, a + m))
                        ids.add(str(k))
        out.append((i, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    r = random.Random(2)
    items = [(k, data.prose(r, 30)) for k in range(12)] + [(50, "Roll and rock"), (51, "a"), (52, ""), (53, None), (None, data.prose(r, 20)), (7, "river")]
    docs = data.texts()
    docs += [(200 + k, data.prose(r, 40) + " " + " ".join(x.split()[3:17]) + " " + data.prose(r, k * 30)) for k, x in items[:12]]
    docs += [(300, items[0][1].upper().replace(" ", " -- ")), (301, " ".join(items[1][1].split()[:12])), (302, items[2][1] + items[2][1]), (303, items[3][1] + " " + items[4][1])]
    return docs, items


@pytest.mark.parametrize("block", [500_000, 60, 17])
def test_against_brute_force(spark, block):
    docs, items = cases()
    got = D.decontaminate(data.table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got), key=repr) == brute(docs, items)


@pytest.mark.parametrize("size", [1, 20_000])
def test_blocks_take_turns(spark, size, monkeypatch):
    """Several blocks and several groups of documents; one Python process a task, however many blocks."""
    monkeypatch.setattr(D, "GROUP_BYTES", size)
    docs, items = cases()
    got = D.decontaminate(data.table(spark, docs).coalesce(1), spark.createDataFrame(items, "item_id long, text string"), block_words=40)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got.collect()), key=repr) == brute(docs, items)


def test_the_query(spark, tmp_path):
    docs, items = cases()
    data.table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    want = [(i, n, h, len(ids), sha(ids), c) for i, n, h, ids, c in brute(docs, items)]
    assert sorted(map(tuple, D.op10_decontaminate(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_words():
    t = "Ab-cÉ_9\x7fÀ x\x00y"
    assert [w.decode() for w in D.words_of(t.encode())] == words(t) == ["ab", "cÉ", "9", "À", "x", "y"]


def test_carried_and_empty(spark):
    docs, items = cases()
    table = data.table(spark, docs, False)
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = D.decontaminate(table, bench, carry=tuple(table.columns))
    assert kept.select("carried.*").columns == table.columns and kept.count() == len(docs)
    assert D.decontaminate(data.table(spark, [], False), bench).count() == 0
    assert D.decontaminate(table, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_search(seed):
    r = random.Random(seed)
    w = [bytes([r.choice(b"ab")]) for _ in range(400)]
    items = [[bytes([r.choice(b"ab")]) for _ in range(n)] for n in (1, 2, 3, 5, 8, 13)]
    for v in items:
        hit, found = bytearray(len(w)), set()
        D.WuManber(len(v), [v], [(0, 0)]).search(w, hit, found)
        want = {a + j for a in range(len(w) - len(v) + 1) if w[a : a + len(v)] == v for j in range(len(v))}
        assert {i for i, x in enumerate(hit) if x} == want and bool(found) == bool(want)
