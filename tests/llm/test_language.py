import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm import data
from trellis.llm import language as L

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or".split(), "fr": "le la eau oui que ç é ment tion ai au en re vi pa".split(), "de": "sch ein ung ver ü ä keit lich ge be zu au ie ch st".split()}


def corpus(n=240, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        out.append((i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60))), lang))
    return out


def letters_of(text):
    """Lower-cased letters and single spaces, one before and one after."""
    c = re.sub(" +", " ", "".join(x if x.isalpha() else " " for x in " " + text.lower() + " "))
    return "" if c == " " else c


def plain(texts):
    """Interpolated Kneser-Ney of order 4 with dictionaries: a function from context and letter to probability."""
    grams = {4: Counter(), 3: Counter(), 2: Counter(), 1: Counter()}
    for t in texts:
        c = "  " + letters_of(t)
        grams[4].update(c[i - 3 : i + 1] for i in range(3, len(c)))
    for o in (3, 2, 1):
        grams[o].update(g[1:] for g in grams[o + 1])

    def p(gram):
        o = len(gram)
        if not o:
            return 1 / (len(grams[1]) + 1)
        own = {g: n for g, n in grams[o].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        ones, twos = (sum(n == k for n in grams[o].values()) for k in (1, 2))
        d = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
        return max(own.get(gram, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p(gram[1:])

    return p


def key(gram):
    return sum(0 if x == " " else ord(x) << 16 * i for i, x in enumerate(reversed(gram)))


def all_grams(text, chunk=L.CHUNK):
    return np.concatenate([np.zeros(0, np.uint64), *L.grams(text, chunk)]).tolist()


def test_grams():
    text = "Ab,  c!9é"
    c = "  " + letters_of(text)
    assert all_grams(text) == [key(c[i - 3 : i + 1]) for i in range(3, len(c))]
    for none in ("12 !?", "", None):
        assert not all_grams(none)
    assert all_grams("😀𝐀") == [0xFFFF, 0xFFFF << 16]
    long = "the cat, sat; on a mat " * 50
    assert all(all_grams(long, k) == all_grams(long) for k in (1, 2, 3, 7, 100))


def test_like_plain_kneser_ney(spark):
    rows = [(i, t, g) for i, t, g in corpus(60) if g != "de"]
    m = L.probabilities(L.gram_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    t = L.Tables(m)
    assert m.languages == ["en", "fr"]
    ps = [plain([x for _, x, g in rows if g == lang]) for lang in m.languages]
    asked = ["then", " the", "  th", "zzzz", "theq", "éion", "aqaq", "   z", "on e", "ion "] + [letters_of(x)[3:7] for _, x, _ in rows[:20]]
    got = np.exp(t.log_probabilities(np.array([key(g) for g in asked], np.uint64)).astype(float))
    for g, row in zip(asked, got, strict=True):
        assert all(math.isclose(a, p(g), rel_tol=1e-4) for a, p in zip(row, ps, strict=True)), g
    # Over all next letters, seen and one unseen, each context's probabilities come to 1.
    for p in ps:
        for ctx in ("the", "on ", "   "):
            assert math.isclose(sum(p(ctx + x) for x in [*{c for _, t, _ in rows for c in letters_of(t)}, "\ufffe"]), 1, abs_tol=0.05)


def test_held_out_accuracy(spark):
    rows = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.train(docs.where("doc_id % 4 <> 0"))
    got = {r.doc_id: r for r in L.identify(docs.where("doc_id % 4 = 0").drop("lang"), m).collect()}
    right = sum(got[i].lang_pred == lang for i, _, lang in rows if i % 4 == 0)
    assert right >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got.values())


def test_hard_cases(spark):
    m = L.train(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    rows = L.identify(data.table(spark), m).collect()
    texts = data.texts()
    assert len(rows) == len(texts)
    letters = {i: any(c.isalpha() for c in t or "") for i, t in texts}
    assert all((r.lang_pred != "und") == letters[r.doc_id] for r in rows if r.doc_id not in (None, 5))
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    foreign = L.identify(spark.createDataFrame([(1, "xqzw jkvx qqzx wvkj " * 30)], "doc_id long, text string"), m).first()
    assert foreign.rejected


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([(1, None, "en"), (2, "abc", None)], "doc_id long, text string, lang string")
    assert L.train(none) is None
    assert [r.lang_pred for r in L.identify(none, None).collect()] == ["und", "und"]


def test_long_texts_in_pieces(spark):
    m = L.Tables(L.train(spark.createDataFrame([(1, "the cat sat on the mat", "en")], "doc_id long, text string, lang string")))
    t = "the cat sat " * 50_000
    ce, n = m.entropies([t, "", "the cat sat " * 10])
    assert abs(ce[0, 0] - ce[2, 0]) < 0.02 and n[1] == 0 and n[0] == len(t)


def test_the_query(spark, tmp_path):
    rows = corpus(400)
    spark.createDataFrame([*rows, (None, "the and of", "en"), (500, None, "en"), (501, "12", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.op8_language(spark, str(tmp_path)).collect()}
    assert len(got) == 403 and all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert got[500].lang_pred == got[501].lang_pred == "und" and sum(got[i].lang_pred == lang for i, _, lang in rows) > 390


def test_all_languages_and_counts(spark):
    # More than 64 languages, each with letters of its own, beside a million n-grams and more of a hot one.
    r = random.Random(5)
    own = {f"l{i:02d}": [chr(0xAC00 + 3 * i + j) for j in range(3)] for i in range(70)}
    small = [(i, "".join(r.choices(x, k=40)), lang) for i, (lang, x) in enumerate(own.items())]
    hot = [(100 + i, "".join(map(chr, r.choices(range(0x4E00, 0x9FA0), k=150_000))), "han") for i in range(8)]
    rows = spark.createDataFrame(small + hot, "doc_id long, text string, lang string")
    assert L.gram_counts(rows).where("lang = 'han'").count() > 1_000_000
    m = L.train(rows)
    assert m.languages == sorted([*own, "han"])
    assert {x.doc_id: x.lang_pred for x in L.identify(rows.where("doc_id < 100"), m).collect()} == {i: lang for i, _, lang in small}


def test_a_language_of_one_text_is_learned(spark):
    """All rows of a language would be held back, as they are copies of one text: they are learned instead."""
    from pyspark.sql import functions as F

    many = spark.range(200).select(F.concat(F.lit("le chat dort sur la chaise bleue numero "), F.col("id").cast("string")).alias("text"))
    back = many.where(F.pmod(F.xxhash64("text"), F.lit(L.HELD_BACK)) == 5).first().text
    english = ["the cat sleeps on the blue chair", "a stone lies by the river", "we read the paper in the morning"]
    rows = [(i, back, "fr") for i in range(60)] + [(100 + i, f"{english[i % 3]} {'and ' * (i % 7)}{english[i % 2]}", "en") for i in range(80)]
    m = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.languages == ["en", "fr"]
    got = L.identify(spark.createDataFrame([(1, "le chat dort", "x"), (2, "the cat sleeps", "x")], "doc_id long, text string, lang string"), m).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "fr", 2: "en"}
