"""URL filter: rules by host and path; where none fits, words of the host and path in naive Bayes.

Names of hosts are words written together. Each distinct run of letters is split by the
Viterbi path under a unigram model, whose counts come from the visible words of all pages:
the substrings of a run are looked up by a join, so the dictionary has any size and is sent
nowhere. A multinomial naive Bayes model over the split host and the path then scores a URL.
It learns from the same URLs: those with a seed word of an unwanted kind are examples of
``block``, all others of ``allow``, so words that keep company with seeds count as well.
Tokens are hashed into ``BUCKETS`` numbers, which bounds the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.runtime import column, ship, slices, staged, table


@dataclass(frozen=True)
class Rule:
    """Fits the host and its subdomains where the URL's path begins with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

#: Words of kinds of sites that a training corpus goes without.
SEEDS = {
    "gambling": "bet bets betting casino casinos jackpot lottery poker roulette gambling bingo",
    "adult": "adult porn porno sex sexy xxx nude escort escorts fetish webcams camgirls hentai",
    "pharmacy": "pill pills pharmacy viagra cialis tramadol xanax steroids meds",
    "advertising": "ads adserver adclick popunder tracker trackers affiliate clickbait",
    "spam": "spam spammer malware phishing warez keygen torrents payday",
}
#: Words have at most so many letters, names of hosts at most so many between dots (as in DNS): longer runs aren't split.
WORD, LABEL = 24, 63
#: A seed counts as if it were at least one word in so many.
SEED_SHARE = 100_000
#: Hash buckets of tokens.
BUCKETS = 1 << 18
#: Tokens' worth of the overall distribution that each class is smoothed with.
SMOOTH = 50.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKENS = r"[a-z]+|[0-9]+|[^\x00-\x7F]+"


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; empty for null and for what has no ``://``."""
    get = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(get(1), UPPER, LOWER), get(2)


def longest_rule(host: Column, path: Column, rules: Iterable[Rule] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. Of equally long ones the first by text."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """word, n: words of letters a-z, up to ``WORD`` of them, in what all pages show, lower-cased."""
    shown = F.lower(F.regexp_replace(column(html_col), "<[^<>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(shown, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.where(F.col("word").rlike(f"^[a-z]{{1,{WORD}}}$")).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(name: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest words of a name. ``known``: counts by (start, length); other pieces are rarer by ten for each letter. Of equal ways the one with longer last words."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        top = (-math.inf, 0)
        for start in range(end):
            n = known.get((start, end - start))
            p = math.log10(n / total) if n else 1 - math.log10(total) - (end - start)
            if best[start][0] + p > top[0]:
                top = (best[start][0] + p, start)
        best.append(top)
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def split_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """name, words (array) for each row of ``names`` (name: a run of letters), split under the counts of ``words`` (word, n).

    A run of more than ``LABEL`` letters is one word. Without words, nothing is split.
    """
    spark = names.sparkSession
    ship(spark)
    seeds = [w for k in SEEDS.values() for w in k.split()]
    words = staged(spark, words, "url-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    least = max(1, total // SEED_SHARE)
    known = spark.createDataFrame([(w, 0) for w in seeds], "word string, n long")
    model = words.unionByName(known).groupBy("word").agg(F.max("n").alias("n")).select("word", F.when(F.col("word").isin(seeds), F.greatest("n", F.lit(least))).otherwise(F.col("n")).alias("n"))
    total += least * len(seeds)
    short = names.where(F.char_length("name") <= LABEL)
    starts = short.select("name", F.explode(F.sequence(F.lit(0), F.char_length("name") - 1)).alias("i"))
    pieces = starts.select("name", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(WORD), F.char_length("name") - F.col("i")))).alias("l"))
    pieces = pieces.withColumn("word", F.substring("name", F.col("i") + 1, F.col("l")))
    found = pieces.join(model.hint("merge"), "word").groupBy("name").agg(F.collect_list(F.struct("i", "l", "n")).alias("found"))
    given = names.select(F.col("name").alias("own")).join(found.hint("merge"), F.col("own") == F.col("name"), "left").select(F.col("own").alias("name"), "found")

    def run(batches):
        for b in slices(batches, 1024):
            out = [viterbi(t, {(x["i"], x["l"]): x["n"] for x in f or ()}, total) if len(t) <= LABEL else [t] for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return given.mapInArrow(run, "name string, words array<string>")


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """host, words: the host's tokens in order, runs of letters split, numbers as ``#``. ``hosts`` has each host once."""
    runs = staged(hosts.sparkSession, hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(TOKENS), F.lit(0))).alias("pos", "run")), "url-runs")
    letters = F.col("run").rlike("^[a-z]")
    split = split_names(runs.where(letters).select(F.col("run").alias("name")).distinct(), words)
    whole = F.when(F.col("run").rlike("^[0-9]"), "#").otherwise(F.col("run"))
    every = runs.join(split.hint("merge"), letters & (F.col("run") == F.col("name")), "left").select("host", "pos", F.coalesce("words", F.array(whole)).alias("words"))
    return every.groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"))


def path_tokens(path: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.translate(path, UPPER, LOWER), F.lit(TOKENS), F.lit(0)), lambda t: F.when(t.rlike("^[0-9]"), "#").otherwise(t))


@dataclass
class Bayes:
    """Log-ratio of block to allow for each bucket, and before any token."""

    ratio: np.ndarray
    prior: float

    def score(self, offsets: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.ratio[buckets])])
        return self.prior + sums[offsets[1:]] - sums[offsets[:-1]]


def learn(rows: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH) -> Bayes:
    """From rows with ``buckets`` (array of int) and ``seed`` (boolean). At most two numbers a bucket come to the driver."""
    n = dict.fromkeys((False, True), 0) | {r.seed: r.n for r in rows.groupBy("seed").agg(F.count("*").alias("n")).collect()}
    count = np.zeros((2, buckets))
    for r in rows.select("seed", F.explode("buckets").alias("b")).groupBy("seed", "b").agg(F.count("*").alias("n")).collect():
        count[int(r.seed), r.b] = r.n
    overall = count.sum(0) / max(1.0, count.sum())
    share = [(c + smooth * overall) / (c.sum() + smooth) for c in count]
    seen = overall > 0
    ratio = np.zeros(buckets)
    ratio[seen] = np.log(share[1][seen]) - np.log(share[0][seen])
    return Bayes(ratio, math.log((n[True] + 1) / (n[False] + 1)))


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", buckets: int = BUCKETS) -> DataFrame:
    """Per row: id, host, path, rule, verdict, words (the host's), score (log-odds of block under naive Bayes).

    The verdict is the longest rule's, else ``block`` if the score is above 0, else
    ``allow``. A null or empty URL, and one without ``://``, has no host, path or token, so
    no rule, and the score of none. URLs of any length count whole; runs of letters that are
    longer than a host's label can be stay one word. Rows with null or repeated ids are
    rows like any other, null pages show no words, an empty table gives none, and further
    columns are ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    host, path = parts(column(url_col))
    urls = pages.select(column(id_col).alias("id"), host.alias("host"), path.alias("path"))
    # Staged, so that the join below has an exchange of its own on both sides and can split a hot host.
    hosts = staged(spark, host_words(urls.select("host").distinct(), word_counts(pages, html_col)), "url-hosts")
    seeds = [w for k in SEEDS.values() for w in k.split()]
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.coalesce("words", F.array().cast("array<string>"))
    rows = urls.join(hosts.hint("merge"), "host", "left").select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), own.alias("words"), path_tokens(F.col("path")).alias("tokens"))
    numbered = lambda kind, c: F.transform(c, lambda t: F.pmod(F.xxhash64(F.concat(F.lit(kind), t)), F.lit(buckets)).cast("int"))
    seed = F.arrays_overlap(F.concat("words", "tokens"), F.array(*map(F.lit, seeds)))
    rows = rows.select("id", "host", "path", "rule", "ruled", "words", seed.alias("seed"), F.concat(numbered("host ", F.col("words")), numbered("path ", F.col("tokens"))).alias("buckets"))
    rows = staged(spark, rows, "url-rows")
    sent = spark.sparkContext.broadcast(learn(rows, buckets))

    def run(batches):
        for b in slices(batches, 4096):
            lists = b.column("buckets")
            offsets = np.asarray(lists.offsets)
            scores = sent.value.score(offsets - offsets[0], lists.flatten().to_numpy(zero_copy_only=False))
            yield pa.record_batch([*(b.column(k) for k in ("id", "host", "path", "rule", "ruled", "words")), pa.array(scores)], names=["id", "host", "path", "rule", "ruled", "words", "score"])

    kind = pages.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, ruled string, words array<string>, score double")
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "words", "score")


def op11_urls(spark, sf_dir: str) -> DataFrame:
    """The contract's query."""
    j = judge(table(spark, sf_dir, "pages"))
    return j.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("host_words"), "score")
