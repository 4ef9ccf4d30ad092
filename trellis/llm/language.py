"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 for each language, over lower-cased letters with all else as one
space. Counts come from every labelled row but 1 in 16, which calibrate the rejection.
N-grams are 64-bit keys (16 bits a character). All that makes counts into probabilities
is DataFrame operations over tables of n-grams; what comes out is written in the shared
folder: for each order the keys and log-probabilities of each language, and its back-off
weights. Python workers read these files into sorted arrays, with a row of all languages
beside each key and all interpolation done, so a character costs one binary search, and
only unseen n-grams go on to the next shorter context. The driver sees a few numbers a
language.

No n-gram and no language is left out, so a worker's memory grows with the distinct
n-grams times the languages: 8 bytes a key and 4 for each language.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.runtime import filesystem, ship, slices, staged, table, written

ORDER = 4
#: One labelled row in so many is held back for calibration, in languages of at least so many rows.
HELD_BACK, ROWS = 16, 50
CHUNK = 400_000
LETTER = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x10000)), np.bool_)


def _codes(text: str) -> np.ndarray:
    """Characters as 16-bit codes: lower-cased letters, 0 for all else; letters beyond the first plane are 0xFFFF."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    high = c > 0xFFFF
    if not high.any():
        return np.where(LETTER[c], c, 0).astype(np.uint64)
    far = c[high]
    own = {x: 0xFFFF if chr(x).isalpha() else 0 for x in np.unique(far).tolist()}
    c = c.copy()
    c[high] = [own[x] for x in far.tolist()]
    return np.where(high | LETTER[np.minimum(c, 0xFFFF)], c, 0).astype(np.uint64)


def grams(text: str | None, chunk: int = CHUNK):
    """Arrays of the n-grams that end at each letter and at each run of all else; none without a letter.

    The text begins and ends with a space. It is read in pieces, each with the characters before it.
    """
    before, letters = np.zeros(ORDER - 1, np.uint64), False
    for i in range(0, len(text or ""), chunk):
        c = _codes(text[i : i + chunk])
        c = c[(c != 0) | (np.concatenate([before[-1:], c[:-1]]) != 0)]
        letters = letters or bool(len(c))
        yield _keys(before, c)
        before = np.concatenate([before, c])[-ORDER + 1 :]
    if letters and before[-1]:
        yield _keys(before, np.zeros(1, np.uint64))


def _keys(before: np.ndarray, c: np.ndarray) -> np.ndarray:
    padded, k = np.concatenate([before, c]), np.zeros(len(c), np.uint64)
    for i in range(ORDER):
        k = (k << np.uint64(16)) | padded[i : i + len(k)]
    return k


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return k, np.bincount(at, np.concatenate([p[1] for p in parts]), len(k)).astype(np.int64)


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, n over all rows with both; each task hands on its own sums."""
    ship(docs.sparkSession)

    def run(batches):
        parts: dict[str, list] = {}
        held: dict[str, tuple[list, int]] = {}

        def flush(lang):
            ks, _ = held.pop(lang)
            parts.setdefault(lang, []).append(np.unique(np.concatenate(ks), return_counts=True))
            if len(parts[lang]) > 8:
                parts[lang] = [_sum(parts[lang])]

        for b in slices(batches, 1024):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k in grams(text):
                    ks, n = held.setdefault(lang, ([], 0))
                    ks.append(k)
                    held[lang] = (ks, n + len(k))
                    if held[lang][1] > CHUNK:
                        flush(lang)
        for lang in list(held):
            flush(lang)
        for lang, p in parts.items():
            k, n = _sum(p)
            for i in range(0, len(k), 100_000):
                part = k[i : i + 100_000]
                yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(n[i : i + 100_000])], names=["lang", "gram", "n"])

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Where the tables of languages' places, keys and values are: log-probabilities for order 4 to 1, log back-off weights for contexts of 3 to 1 characters."""

    languages: list[str]
    grams: list[str]
    contexts: list[str]
    unseen: list[float]
    #: Cross-entropy beyond which a text is in none of the languages.
    reject: float = np.inf


class Tables:
    """A model's tables as sorted arrays."""

    def __init__(self, model: Model):
        self.languages, self.unseen = model.languages, np.array(model.unseen, np.float32)
        contexts = [self._read(x) for x in model.contexts]
        self.contexts, self.weights = ([x[i] for x in contexts] for i in (0, 1))
        self.grams, self.logs = [], []
        for i, folder in reversed(list(enumerate(model.grams))):
            key, logs = self._read(folder, i)
            self.grams.insert(0, key)
            self.logs.insert(0, logs)

    def _read(self, folder: str, nth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys, and a row of values over the languages for each; what a language hasn't seen comes from its shorter context (0 for weights)."""
        fs, name = filesystem(folder)
        t = pq.read_table(name, filesystem=fs, columns=["place", "key", "v"])
        key = t["key"].to_numpy().view(np.uint64)
        every = np.unique(key)
        if nth is None:
            rows = np.zeros((len(every), len(self.languages)), np.float32)
        elif nth == ORDER - 1:
            rows = np.tile(self.unseen, (len(every), 1))
        else:
            # Here the list of tables begins with the next shorter order.
            short = np.searchsorted(self.grams[0], every & np.uint64((1 << 16 * (ORDER - 1 - nth)) - 1))
            rows = self.logs[0][short] + self.weights[nth][np.searchsorted(self.contexts[nth], every >> np.uint64(16))]
        rows[np.searchsorted(every, key), t["place"].to_numpy()] = t["v"].to_numpy()
        return every, rows

    def log_probabilities(self, k: np.ndarray) -> np.ndarray:
        out = np.zeros((len(k), len(self.languages)), np.float32)
        left, at = k, np.arange(len(k))
        for i in range(ORDER):
            own = left & np.uint64((1 << 16 * (ORDER - i)) - 1) if i else left
            j = np.minimum(np.searchsorted(self.grams[i], own), len(self.grams[i]) - 1)
            hit = self.grams[i][j] == own
            if hit.all():
                out[at] += self.logs[i][j]
                return out
            out[at[hit]] += self.logs[i][j[hit]]
            left, at = own[~hit], at[~hit]
            if i < ORDER - 1:
                ctx = left >> np.uint64(16)
                j = np.minimum(np.searchsorted(self.contexts[i], ctx), len(self.contexts[i]) - 1)
                seen = self.contexts[i][j] == ctx
                out[at[seen]] += self.weights[i][j[seen]]
        out[at] += self.unseen
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a character for each text and language, and each text's number of letters and spaces; 0 without a letter."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        ks, of, held = [], [], 0

        def flush():
            nonlocal ks, of, held
            logs = self.log_probabilities(np.concatenate(ks))
            at = np.cumsum([0, *map(len, ks[:-1])])
            np.add.at(total, of, np.add.reduceat(logs, at, axis=0, dtype=np.float64))
            np.add.at(n, of, [len(k) for k in ks])
            ks, of, held = [], [], 0

        for d, t in enumerate(texts):
            for k in grams(t):
                if len(k):
                    ks.append(k)
                    of.append(d)
                    held += len(k)
                    if held > CHUNK:
                        flush()
        if ks:
            flush()
        return -total / np.maximum(n, 1)[:, None], n


def _by_language(values: dict[str, float]) -> Column:
    """The number of the row's language."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("lang"))


def probabilities(counts: DataFrame) -> Model | None:
    """Tables of interpolated Kneser-Ney models from lang, gram, n: each order's counts are the kinds of characters before it, its discount comes from its ones and twos."""
    spark, mask = counts.sparkSession, lambda o: (1 << 16 * o) - 1
    levels = {ORDER: staged(spark, counts.select("lang", F.col("gram").alias("key"), "n"), "lang-4")}
    for o in range(ORDER - 1, 0, -1):
        levels[o] = staged(spark, levels[o + 1].groupBy("lang", F.col("key").bitwiseAND(F.lit(mask(o))).alias("key")).agg(F.count("*").alias("n")), f"lang-{o}")
    sums = [levels[o].groupBy("lang").agg(F.lit(o).alias("o"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"), F.count("*").alias("kinds"), F.sum("n").alias("mass")) for o in levels]
    stats = {(r.o, r.lang): r for r in reduce(DataFrame.unionByName, sums).collect()}
    languages = sorted({lang for _, lang in stats})
    if not languages:
        return None
    discount = {k: min(0.9, max(0.1, r.ones / (r.ones + 2 * r.twos))) if r.ones else 0.1 for k, r in stats.items()}
    unseen = [math.log(discount[1, x] * stats[1, x].kinds / stats[1, x].mass / (stats[1, x].kinds + 1)) for x in languages]
    place = _by_language({x: i for i, x in enumerate(languages)}).cast("short").alias("place")
    grams, contexts, lower = [], [], None
    for o in range(1, ORDER + 1):
        d = _by_language({x: discount[o, x] for x in languages})
        cur = levels[o].withColumn("ctx", F.shiftrightunsigned("key", 16))
        backs = cur.groupBy("lang", "ctx").agg(F.sum("n").alias("mass"), F.count("*").alias("kinds")).withColumn("lam", d * F.col("kinds") / F.col("mass"))
        # Tables of n-grams have no bound, so none of them is broadcast.
        p = cur.join(backs.hint("merge"), ["lang", "ctx"])
        if o == 1:
            p = p.withColumn("low", 1 / (F.col("kinds") + 1))
        else:
            p = p.withColumn("suffix", F.col("key").bitwiseAND(F.lit(mask(o - 1)))).join(lower.hint("merge"), ["lang", "suffix"])
        p = p.select("lang", "key", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("mass") + F.col("lam") * F.col("low")).alias("p"))
        if o < ORDER:
            p = staged(spark, p, f"lang-p{o}")
            lower = p.select("lang", F.col("key").alias("suffix"), F.col("p").alias("low"))
        grams.insert(0, written(spark, p.select(place, "key", F.log("p").cast("float").alias("v")), f"lang-grams{o}"))
        if o > 1:
            contexts.insert(0, written(spark, backs.select(place, F.col("ctx").alias("key"), F.log("lam").cast("float").alias("v")), f"lang-contexts{o}"))
    return Model(languages, grams, contexts, unseen)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """From all rows with text and language but those held back; None if there are none.

    Of languages with ``ROWS`` rows and more, the rows whose text's hash is 5 modulo
    ``HELD_BACK`` aren't learned from, unless these are more than one row in four (copies of
    one text, say): then all are. Rejection starts where 1 in 1000 of those lies, and
    twice their spread beyond. Null and repeated ids don't matter; a text with several
    languages counts for each.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    known = docs.where(text.isNotNull() & lang.isNotNull()).select(text.alias("text"), lang.cast("string").alias("lang"))
    back = F.pmod(F.xxhash64("text"), F.lit(HELD_BACK)) == 5
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(back).alias("back")).collect()
    back = back & F.col("lang").isin([r.lang for r in sizes if r.n >= ROWS and 4 * r.back <= r.n])
    model = probabilities(gram_counts(known.where(~back)))
    if model:
        seen = identify(known.where(back).withColumn("id", F.lit(0)), model, "id").where("lang_pred <> 'und'")
        r = seen.agg(F.percentile_approx("cross_entropy", 0.999, 10_000).alias("q"), F.stddev_pop("cross_entropy").alias("s")).first()
        model.reject = float(r.q + 2 * r.s) if r.q is not None else np.inf
    return model


_tables: dict[str, Tables] = {}


def tables(model: Model) -> Tables:
    """Read once in a worker."""
    key = model.grams[0]
    if key not in _tables:
        _tables.clear()
        _tables[key] = Tables(model)
    return _tables[key]


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (0 to 1), cross_entropy, rejected.

    ``und``, score 0, for null texts, texts without a letter and without a model. The
    score is the posterior of the best language given the entropies of up to 50
    characters' evidence; of equal languages the first by name is taken. Rejected texts
    keep their nearest language. Texts of any length are read whole, in pieces. Rows with
    null or repeated ids are rows like any other, an empty table gives none, and further
    columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in slices(batches, 1024):
            texts = b.column(1).to_pylist()
            lang, score, best, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if model:
                ce, n = tables(model).entropies(texts)
                pick, some = ce.argmin(1), n > 0
                best = np.where(some, ce.min(1), 0)
                z = (ce - ce.min(1, keepdims=True)) * np.minimum(n, 50)[:, None]
                score = np.where(some, 1 / np.exp(-z).sum(1), 0)
                lang = [model.languages[p] if s else "und" for p, s in zip(pick, some, strict=True)]
                rejected = some & (best > model.reject)
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(best, pa.float64()), pa.array(rejected)], names=["id", "lang_pred", "score", "cross_entropy", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean").withColumnRenamed("id", id_col)


def op8_language(spark, sf_dir: str) -> DataFrame:
    """The contract's query: learned from the rows that aren't held out. ``rejected`` says that the nearest language is none of the learned ones."""
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return identify(docs, train(docs.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
