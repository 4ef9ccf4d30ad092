import random
import re

import pytest
import xxhash

from tests.llm import data
from trellis.llm import simhash as S


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, near):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def clouds(seed):
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(200)}
    for c in [r.getrandbits(64) for _ in range(3)]:
        for _ in range(150):
            x = c
            for _ in range(r.randint(0, 6)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_tree_against_brute_force(seed):
    v = clouds(seed)
    random.Random(seed).shuffle(v)
    t = S.BKTree(4)
    for x in v:
        t.add(x)
    want = brute_components(v, lambda a, b: (a ^ b).bit_count() <= 4)
    assert [t.find(i) for i in range(len(v))] == want or {frozenset(i for i in range(len(v)) if t.find(i) == k) for k in {t.find(i) for i in range(len(v))}} == {frozenset(i for i in range(len(v)) if want[i] == k) for k in set(want)}
    assert len(t.links()) == len(v) - len(set(want))


@pytest.mark.parametrize("n", [10, 10**7, 10**9, 10**11])
@pytest.mark.parametrize("radius", [4, 6])
def test_masks_lose_no_pair(n, radius):
    masks, r = S.masks_for(n, radius), random.Random(n)
    for _ in range(500):
        d = sum(1 << b for b in r.sample(range(64), radius))
        assert any(not d & m for m in masks)


def test_finer_masks_lose_no_pair(spark):
    """Values that differ in few of some bits agree on one of the finer masks, each of which has more bits."""
    r = random.Random(3)
    bits = [sorted(r.sample(range(64), n)) for n in (5, 6, 9, 20, 64)]
    for row in spark.createDataFrame([(0, b) for b in bits], "mask long, bits array<int>").select("bits", S.finer(4).alias("masks")).collect():
        for _ in range(100):
            d = sum(1 << b for b in r.sample(row.bits, 4))
            assert any(not d & m for m in row.masks)
        assert len(row.masks) == 5 and all(row.masks) and sum(m & (1 << 64) - 1 for m in row.masks) == sum(1 << b for b in row.bits)


@pytest.mark.parametrize("hot", [20_000, 12])
def test_links_of_hot_shards(spark, hot):
    """All values of five bits, far apart from some others: shards dealt on to the last bits."""
    v = sorted({x << 7 for x in range(32)} | set(clouds(7)[::6]))
    signed = [x - (1 << 64) if x >> 63 else x for x in v]
    edges = S.links(spark.createDataFrame([(i, i) for i in signed], "node long, fp long"), hot=hot)
    roots = {r.node: r.root for r in S.components(edges).collect()}
    want = brute_components(v, lambda a, b: (a ^ b).bit_count() <= 4)
    same = lambda keys: {frozenset(i for i in range(len(v)) if keys[i] == k) for k in set(keys)}
    assert same([roots.get(i, i) for i in signed]) == same(want)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_clusters(spark, hot):
    rows = data.texts()
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.cluster(data.table(spark), hot=hot).collect()), key=repr)
    f = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(f, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {k: min((rows[i][0] for i in range(len(rows)) if root[i] == k and rows[i][0] is not None), default=None) for k in set(root)}
    assert got == sorted(((rows[i][0], format(f[i], "016x"), least[root[i]]) for i in range(len(rows))), key=repr)


def test_chain_over_shards(spark):
    """A chain in which each links to the next only, longer than any radius."""
    x, values = 0x0123456789ABCDEF, []
    for i in range(40):
        x ^= 0b1111 << (i * 13 % 60)
        values.append(x)
    v = [i - (1 << 64) if i >> 63 else i for i in values]
    edges = S.links(spark.createDataFrame([(i, i) for i in v], "node long, fp long"))
    roots = {r.node: r.root for r in S.components(edges).collect()}
    want = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    assert len({roots.get(i, i) for i in v}) == len(set(want))


def test_empty(spark):
    assert S.cluster(data.table(spark, [], False)).count() == 0
