import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm import data
from trellis.llm import variants as V


def edits(a, b):
    """Whether one inserted, deleted or replaced character joins the two."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs, least=6, often=5):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least
    return {w: k for w, k in n.items() if k >= often}


def brute(n):
    out, form = [], {}
    for w in n:
        near = sorted((-n[v], v) for v in n if edits(w, v))
        form[w] = (near[0][1] if near and -near[0][0] >= 5 * n[w] else None, len(near))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        f = form[w][0]
        out.append((w, f, root, n[w], form[w][1], n[f] if f else None))
    return sorted(out)


def vocabulary(seed, size, letters="ab", low=1, high=9):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(size)}
    return {w: 5 ** r.randint(0, 6) + r.randint(0, 3) for w in sorted(words)}


@pytest.mark.parametrize(("seed", "hot", "letters"), [(1, 1 << 16, "ab"), (2, 50, "ab"), (3, 0, "ab"), (4, 3, "aé"), (5, 20, "abcdefÿ")])
def test_against_brute_force(spark, seed, hot, letters):
    n = vocabulary(seed, 250, letters, 0 if seed < 4 else 1)
    got = V.variants(spark.createDataFrame(list(n.items()), "word string, n long"), hot=hot).collect()
    assert sorted(map(tuple, got)) == brute(n)


def test_hot_keys_are_cut(spark):
    """Many words share a start, an end, and both; every level gives each pair once."""
    r = random.Random(9)
    n = {f"common{r.choice('abcdef')}{r.choice('abcdef')}{r.choice('abc')}{r.choice('abcdef')}ending": r.randint(5, 900) for _ in range(350)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    pairs = [(p.x, p.y) for p in V.near_pairs(words, hot=100).collect()]
    assert len(pairs) == len(set(pairs))
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in n for b in n if a < b and edits(a, b)}


def documents():
    r = random.Random(4)
    stems = ["".join(r.choice("ein stau ver ége ñol".replace(" ", "")) for _ in range(r.randint(6, 12))) for _ in range(30)]
    docs = [(i, " ".join(r.choice(stems).capitalize() if r.random() < 0.3 else r.choice(stems) for _ in range(r.randint(0, 120))) + r.choice([".", "\n", "123", "Àÿ×÷"])) for i in range(300)]
    return [*docs, *data.texts(), (None, " ".join(stems)), (None, None), (7, docs[7][1]), (-1, stems[0].upper() + " x" * 400 + "y" * 3000)]


def test_the_query(spark, tmp_path):
    data.table(spark, documents()).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, V.op12_spelling(spark, str(tmp_path)).collect()))
    want = brute(brute_words(documents()))
    assert got == want and any(r[1] for r in want)


def test_empty_and_null(spark):
    none = data.table(spark, [], False)
    assert V.variants(V.word_counts(none, damage=199)).count() == 0
    assert V.word_counts(data.table(spark, [(1, None), (2, "")])).count() == 0
    words = spark.createDataFrame([(None, 5), ("aaaaaa", 5)], "word string, n long")
    assert [tuple(r) for r in V.variants(words).where("word IS NOT NULL").collect()] == [("aaaaaa", None, "aaaaaa", 5, 0, None)]


def test_long_words(spark):
    a = "word" * 2000
    n = {a: 10, a[:-1]: 100, a[1:]: 7, a[:4000] + "x" + a[4000:]: 600, a + "yy": 5}
    assert sorted(map(tuple, V.variants(spark.createDataFrame(list(n.items()), "word string, n long"), hot=0).collect())) == brute(n)
