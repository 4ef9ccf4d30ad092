"""Near duplicates against brute force over sets of shingles."""

import random

import pytest

from trellis.llm import neardup, stages
from trellis.llm.simhash import components


def edited(r, words, n):
    w = list(words)
    for i in r.sample(range(len(w)), n):
        w[i] = f"x{r.randint(0, 10**9)}"
    return w


def corpus(groups=40, large=90):
    r = random.Random(3)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{r.randint(0, 10**6)}" for _ in range(200)]
        # Edits that leave shares from 0.6 to 0.95.
        texts += [" ".join(edited(r, base, n)) for n in (0, 2, 4, 5, 7, 9)]
    base = [f"w{r.randint(0, 10**6)}" for _ in range(200)]
    return texts + [" ".join(edited(r, base, r.randint(0, 8))) for _ in range(large)]


def brute(texts, share=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= share * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}


@pytest.mark.parametrize("large", [neardup.LARGE, 20])
def test_exact_groups(spark, monkeypatch, large):
    texts = corpus()
    monkeypatch.setattr(neardup, "LEADERS", 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, nodes = neardup.cluster(docs, large=large)
    firsts = [r.f.id for r in nodes.groupBy("component").agg({"first": "min"}).toDF("c", "f").collect()]
    assert sorted(firsts) == sorted(brute(texts))


def test_trees_propose_what_is_within_the_radius(spark):
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(60)]
    fps += [x ^ sum(1 << b for b in r.sample(range(64), n)) for x in fps for n in (0, 2, 4, 5)] + [0, 0]
    rows = [(r.getrandbits(63), f - (1 << 64) if f >> 63 else f) for f in fps]
    edges = neardup.proposed(spark.createDataFrame(rows, "node long, fp long"))
    got = {x.node: x.root for x in components(edges).collect()}
    parent = {n: n for n, _ in rows}
    for i, (n, f) in enumerate(rows):
        for m, g in rows[:i]:
            if ((f ^ g) & (1 << 64) - 1).bit_count() <= 4:
                x, y = neardup._find(parent, n), neardup._find(parent, m)
                parent[max(x, y)] = min(x, y)
    want = {n: neardup._find(parent, n) for n, _ in rows}
    linked = {n for n in want if sum(v == want[n] for v in want.values()) > 1}
    assert got == {n: want[n] for n in linked}
    assert neardup.proposed(spark.createDataFrame([], "node long, fp long")).isEmpty()


def test_stage_keeps_what_shares_less(spark):
    texts = corpus(30, 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in stages.drop_near_duplicates(spark, docs, "").collect()} == brute(texts)
