import random
import zlib

from tests.llm import data
from trellis.llm import toxicity as X

BAD = "wretchling gobsnark dimwittle stinkroach".split()


def corpus(n=1200, seed=3):
    r = random.Random(seed)
    syll = "ri ver sto ne clou lam pa per en gi gar den sil win dow moun tain pep vio lin har bor can dle".split()
    out = []
    for i in range(n):
        w = ["".join(r.choice(syll) for _ in range(r.randint(1, 4))) for _ in range(r.randint(30, 120))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(max(2, len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(BAD)
        out.append((i, " ".join(w), toxic))
    return out


def test_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i % 4], "doc_id long, toxic int")
    m = X.train(docs, labels)
    got = {r.doc_id: r.score for r in X.score(docs.where("doc_id % 4 = 0"), m).collect()}
    caught = [got[i] >= 0.3 for i, _, k in rows if i % 4 == 0 and k]
    wrong = [got[i] >= 0.3 for i, _, k in rows if i % 4 == 0 and not k]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.03 * len(wrong)


def test_hard_cases(spark):
    m = X.fit([(t, k) for _, t, k in corpus(200)], 0.2)
    docs = data.table(spark)
    rows = X.score(docs, m).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    empty = m.score("")
    assert {r.score for r in rows if r.doc_id in (18, 19)} == {empty} and m.score(None) == empty
    kept = X.score(docs, m, carry=tuple(docs.columns))
    assert kept.columns == ["doc_id", "score", "carried"] and kept.select("carried.*").columns == docs.columns
    assert sorted(map(repr, kept.select("carried.*").collect())) == sorted(map(repr, docs.collect()))
    assert X.score(docs.limit(0), m).count() == 0


def test_repeated_ids_and_odd_labels(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2 + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows] * 3 + [(None, 1), (4, None), (6, 7)], "doc_id long, toxic int")
    once = X.train(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int"))
    assert X.train(docs, labels).score(rows[5][1]) == once.score(rows[5][1])
    assert X.train(docs.limit(0), labels).score("a") == 0.0


def test_whole_texts_are_learned(spark):
    """Toxic words far into a text count like those at its start."""
    rows = [(i, ("river stone " * 3000 if k else "") + t, k) for i, t, k in corpus(400)]
    assert X.fit([(t, k) for _, t, k in rows], 0.2).score("river stone " * 3000 + " ".join(BAD * 3)) >= 0.3


def test_the_query(spark, tmp_path):
    rows = corpus(800)
    spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (900, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in X.op9_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 802 and all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for i, r in got.items())


def test_one_class_or_none():
    assert X.fit([], 0.0).score("a") == 0.0
    assert X.fit([("some text here", 0)] * 5, 0.0).score("a") == 0.0
    assert X.fit([("some text here", 1)] * 5, 1.0).score("a") == 1.0


def test_model_travels():
    import pickle

    m = X.fit([(t, k) for _, t, k in corpus(200)], 0.2)
    t = corpus(10, 9)[0][1]
    assert pickle.loads(pickle.dumps(m)).score(t) == m.score(t)
