"""Spelling variants: words that differ by one edit, by an even-partition pigeonhole join.

A word of length L is cut into two even segments. One edit leaves one of them as it is,
at the word's start or at its end: so the index holds both segments of each word by its
length, and a word of the same length or one longer probes it with its own start and its
own end, which for the longer word is shifted by one. What meets is compared.

The part that isn't matched is the region in which the edit stands. A key that many words
share is cut again by the same rule: its region has two halves, and one of them must be
equal too. That goes on until a key has few comparisons or a region of one character, so a
frequent syllable makes no large group. A pair is taken in one region only, the one that
holds the first place at which its words differ, so no pair is found twice and nothing has
to be made distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.runtime import column, staged, table

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words have at least so many code points, and occur at least so often.
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
TIMES = 5
#: The run whose crc32 this number divides loses a code point.
DAMAGE = 199
#: Comparisons of a key from which on its region is cut.
HOT = 1 << 16


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = None) -> DataFrame:
    """word, n: the distinct lower-cased runs of letters of all texts, and how often each occurs.

    Only A-Z are lower-cased. With ``damage``, a run loses a code point where that number
    divides the crc32 of ``id:run``; a null id is spelled as nothing there. Null and empty
    texts have no words, texts and words of any length count whole, rows with null or
    repeated ids are rows like any other, and further columns are ignored. Counts are summed
    in each task before they are shuffled.
    """
    runs = docs.select(column(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate(column(text_col), UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    word = F.col("run")
    if damage:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary"))
        at = (F.col("h") % F.char_length("run")).cast("int")
        runs = runs.where(F.char_length("run") >= min_length).withColumn("h", h)
        word = F.when(F.col("h") % damage == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _rows(names: tuple[str, ...], *rows: tuple[Column, ...]) -> Column:
    """Array of structs."""
    return F.array(*(F.struct(*(c.alias(k) for k, c in zip(names, r, strict=True))) for r in rows))


def _halves(start: Column, length: Column) -> Column:
    """The two halves of a region that begins at ``start``: array of (a, m). The first is the shorter."""
    half = F.floor(length / 2).cast("int")
    return _rows(("a", "m"), (start, half), (start + half, length - half))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (side, w, n, size, shift) and their region ``r``: a row with its key for each. ``size`` is the length of the index's words."""
    rows = rows.select("side", "w", "n", "size", "shift", F.col("r.a").alias("a"), F.col("r.m").alias("m")).where("m > 0")
    # What a word has before and after the region; a longer word's end is shifted by one.
    before, after = F.substring("w", F.lit(1), F.col("a")), F.substring("w", F.col("a") + F.col("m") + F.col("shift") + 1, F.col("size"))
    return rows.withColumn("key", F.xxhash64("size", "a", "m", before, after))


def _matches(rows: DataFrame) -> DataFrame:
    """Pairs one edit apart that meet at a key, each once: shorter word first, of equal lengths the lesser."""
    index = rows.where("side = 0").select("key", "size", "a", "m", F.col("w").alias("x"), F.col("n").alias("x_n"))
    probe = rows.where("side = 1").select("key", "shift", F.col("w").alias("y"), F.col("n").alias("y_n"))
    start, end = F.col("a"), F.col("a") + F.col("m")
    same = lambda k: F.substring("x", F.lit(1), k) == F.substring("y", F.lit(1), k)
    first = (end >= F.col("size")) | ~same(end)
    near = ((F.col("shift") == 1) | (F.col("x") < F.col("y"))) & same(start) & first & (F.levenshtein("x", "y", 1) == 1)
    return index.join(probe.hint("merge"), (index["key"] == probe["key"]) & near).select("x", "x_n", "y", "y_n")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """x, x_n, y, y_n: all unordered pairs of distinct words that one inserted, deleted or replaced code point joins.

    ``words`` (word, n) has each word once. Words of one code point and empty words pair
    like others; null words pair with none.
    """
    spark = words.sparkSession
    size = F.char_length("word")
    sides = _rows(("side", "size", "shift"), (F.lit(0), size, F.lit(0)), (F.lit(1), size, F.lit(0)), (F.lit(1), size - 1, F.lit(1)))
    rows = words.where("word IS NOT NULL").select(F.col("word").alias("w"), "n", F.explode(sides).alias("s")).select("w", "n", "s.*").where("size >= 0")
    # An empty region only where there is no other: the empty word beside words of one letter.
    whole = _rows(("a", "m"), (F.lit(0), F.greatest("size", F.lit(1))))
    rows = rows.withColumn("r", F.explode(F.when(F.col("size") < 2, whole).otherwise(_halves(F.lit(0), F.col("size")))))
    found = []
    while True:
        flat = staged(spark, _keyed(rows), "variant-keys")
        sizes = flat.groupBy("key", "m").agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
        large = staged(spark, sizes.where((F.col("m") > 1) & (F.col("x") * F.col("y") > hot)).select("key").distinct(), "variant-hot")
        if large.isEmpty():
            found.append(_matches(flat))
            return reduce(DataFrame.unionByName, found)
        found.append(_matches(flat.join(large, "key", "left_anti")))
        rows = flat.join(large, "key", "left_semi").withColumn("r", F.explode(_halves(F.col("a"), F.col("m"))))


def variants(words: DataFrame, times: int = TIMES, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n), which has each word once.

    ``form``: the near word that occurs most often (of equals the first in code-point order),
    if it does so ``times`` times as often as the word. ``root``: where forms lead from the
    word in the end. Forms occur ever more often, so they lead in no circle, and chains are
    as short as the logarithm of the largest count; they double in length each round.
    """
    spark = words.sparkSession
    words = staged(spark, words.select("word", F.col("n").cast("long").alias("n")), "variant-words")
    other = lambda w, n: F.struct((-F.col(n)).alias("neg"), F.col(w).alias("form"))
    both = _rows(("word", "other"), (F.col("x"), other("y", "y_n")), (F.col("y"), other("x", "x_n")))
    best = near_pairs(words, hot).select(F.inline(both)).groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    is_form = -F.col("best.neg") >= times * F.col("n")
    own = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.neg")).alias("form_n"))
    own = staged(spark, own, "variant-forms")
    steps = own.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        steps = staged(spark, steps, "variant-roots")
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = steps.join(ahead, "root")
        if longer.isEmpty():
            break
        steps = steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return own.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """The contract's query."""
    return variants(word_counts(table(spark, sf_dir, "documents"), damage=DAMAGE))
