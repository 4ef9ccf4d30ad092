import re
from collections import Counter

from tests.llm import data
from trellis.llm import quality as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(win)
    rep = {i + j for i, x in enumerate(win) if n[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), base


def test_counts(spark):
    rows = Q.quality(data.table(spark)).collect()
    got = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows), key=repr)
    assert got == sorted(((i, brute(t)) for i, t in data.texts()), key=repr)
    assert not any(r.kept and r.base_failed for r in rows)


def test_rules(spark):
    clean = "The river runs by the old mill and the people of the town come to it in the evening with their lamps lit. " * 1
    rows = [(0, clean), (1, " ".join(f"{w}### $$$" for w in clean.split())), (2, clean.upper().replace(" ", "!! ")), (3, "\n".join(["again and again the same"] * 3 + [clean] * 2)), (4, None), (5, "")]
    got = {r.doc_id: r for r in Q.quality(data.table(spark, rows, False)).collect()}
    assert got[0].kept and got[0].failed_rules == []
    assert "symbols per word" in got[1].failed_rules and "share of stop words" in got[2].failed_rules
    assert got[3].base_failed and not got[4].kept and got[4].n_words == 0 and got[5].base_failed


def test_carried_columns_and_empty_table(spark):
    docs = data.table(spark)
    q = Q.quality(docs, carry=tuple(docs.columns))
    assert q.select("carried.*").columns == docs.columns and q.count() == docs.count()
    assert Q.quality(data.table(spark, [], False)).count() == 0


def test_one_projection(spark):
    plan = Q.quality(data.table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
