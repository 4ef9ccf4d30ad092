"""The pipeline's stages on a small corpus with planted cases, each against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_quality import brute as counts
from tests.llm.test_toxicity import BAD
from trellis.llm import bpe, toxicity


def corpus():
    r = random.Random(11)
    syll = "ri ver sto ne clou lam pa per en gi gar den sil win dow moun tain pep vio lin har bor can dle".split()
    stop = "the of and to in is".split()
    text = lambda n: " ".join(r.choice(stop) if r.random() < 0.25 else "".join(r.choice(syll) for _ in range(r.randint(1, 4))) for _ in range(n))
    docs = [(i, text(r.randint(40, 160))) for i in range(900)]
    toxic = {i for i in range(900) if i % 7 == 0}
    docs = [(i, " ".join(w if i not in toxic or k % 20 else r.choice(BAD) for k, w in enumerate(t.split()))) for i, t in docs]
    bench = [(k, text(40)) for k in range(5)]
    planted = {"copy": [], "near": [], "dirty": [], "junk": []}
    long = [d for d in docs if len(d[1].split()) > 120 and d[0] not in toxic][:5]
    planted["first"] = [i for i, _ in long]
    for k in range(5):
        planted["copy"].append((2000 + k, docs[101 + k][1]))
        w = long[k][1].split()
        planted["near"].append((2100 + k, " ".join([*w[: len(w) // 2], "other", *w[len(w) // 2 + 1 :]])))
        planted["dirty"].append((2200 + k, f"{text(20)} {bench[k][1]} {text(20)}"))
        planted["junk"].append((2300 + k, " ".join(f"{x}###" for x in text(40).split())))
    return docs + [d for k in ("copy", "near", "dirty", "junk") for d in planted[k]], toxic, bench, planted


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, toxic, bench, _ = corpus()
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(900)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs, toxic, bench, planted = corpus()
    before, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in C.STAGES:
        after = stage(spark, before, folder).cache()
        if name != "encoding":
            assert after.columns == before.columns
        seen[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r for r in after.collect()})
        before = after
    ids = lambda k: {i for i, _ in planted[k]}

    was, now = seen["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").where(~toxicity.held_out("doc_id")))
    assert set(now) == {i for i, t in was.items() if model.score(t) < 0.3}
    assert len(toxic & set(now)) <= 0.1 * len(toxic) and len(set(was) - toxic - set(now)) <= 0.03 * len(was)

    was, now = seen["quality"]
    assert set(was) - set(now) == {i for i, t in was.items() if counts(t)[5]} | (ids("junk") & set(was))

    was, now = seen["near_duplicates"]
    for k, first in ([(2000 + i, 101 + i) for i in range(5)] + [(2100 + i, planted["first"][i]) for i in range(5)]):
        if k in was and first in was:
            assert k not in now and first in now
    assert set(was) - set(now) <= ids("copy") | ids("near")

    was, now = seen["decontamination"]
    assert set(was) - set(now) == {x[0] for x in hits(list(was.items()), bench) if x[4]} and not ids("dirty") & set(now)

    was, now = seen["encoding"]
    a = bpe.load(bpe.vocabulary_path())
    assert {i: r.ids for i, r in now.items()} == {i: a.encode(t) for i, t in was.items()}


def test_run(spark, folder):
    r = C.run(spark, folder)
    assert r.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and r.count() > 500


CLASHES = "score n_words n_hit n_items contaminated hit_spans item_ids kept carried row at node bands _at id text_crc32 n_tokens ids component first".split() + ["a.b", "my col", "x:y", "a-b", "c`d", "text "]


def test_hard_rows(spark, folder):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (None, "the river and the stone " * 10, "en", "s", 1), (2, "x" * 5000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))):
        for name, stage in C.STAGES:
            got = stage(spark, given, folder)
            assert got.columns == given.columns if name != "encoding" else got.count() == 4
            assert stage(spark, given.limit(0), folder).count() == 0
            if name in ("toxicity", "decontamination"):
                assert sorted(map(repr, got.collect())) == sorted(map(repr, given.collect()))


def test_one_row_of_a_group_stays(spark, folder):
    text = "the river and the stone lamp in a garden of copper " * 3
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (7, None), (3, ""), (None, "other words that are here alone and no more of them"), (None, "other words that are here alone and no more of them"), (5, "one two"), (4, "one two"), (6, "one three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit("x")).withColumn("node", F.lit(1))
    got = dict(C.STAGES)["near_duplicates"](spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, text), (3, ""), (0, rows[7][1]), (4, "one two"), (6, "one three")])


def test_a_text_goes_to_a_worker_once(spark, folder, monkeypatch):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda d, f, schema, *a, **kw: seen.append((d.columns, str(schema))) or real(d, f, schema, *a, **kw))
    stages = dict(C.STAGES)
    for name in ("toxicity", "decontamination"):
        stages[name](spark, docs, folder)
        assert seen[-1][0] == ["id", "carried"]
    # Its answer has ids only, not the text again.
    stages["encoding"](spark, docs, folder)
    assert "ids array<int>" in seen[-1][1] and "decoded string" not in seen[-1][1]
