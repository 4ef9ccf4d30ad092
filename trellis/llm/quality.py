"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.runtime import struct_of, table

WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of the corpus's four languages.
STOP_WORDS = {
    "en": "the of and to in is it that was for on are with as by at be this have from or an not but they which a",
    "fr": "le la les de des du et un une en dans que qui pour sur est au aux pas ne se avec par ce il elle on",
    "de": "der die das und in den von zu mit ist nicht ein eine auf für im dem sich auch es an als bei aus er sie",
    "es": "el la los las de del y en un una que por con para se es al su lo como más no a le sus o",
}


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; a null bound doesn't bind."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean word length", "mean_word_chars", 1.5, 20),
    Rule("symbols per word", "symbol_ratio", None, 0.3),
    Rule("share of stop words", "stop_word_ratio", 0.05, None),
    Rule("share of repeated lines", "dup_line_ratio", None, 0.5),
    Rule("share of lines that end in an ellipsis", "ellipsis_line_ratio", None, 0.5),
    Rule("share of words in repeated windows", "repeat_word_ratio", None, 0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column, n: Column, window: int) -> Column:
    """Number of words in windows that occur twice or more, from 64-bit window hashes."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.try_element_at(s, j)["h"] == x["h"], F.lit(False))
            return F.filter(s, lambda x, i: F.when(i > 0, same(x, i)).otherwise(F.lit(False)) | same(x, i + 2))

        at = F.sort_array(F.transform(let(pairs, repeats), lambda x: x["i"]))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n")), lambda a: a["n"])

    hashes = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n <= window, F.lit(0)).otherwise(found)


def measures(text: Column, window: int = WINDOW) -> Column:
    """Struct of counts of one text; words are runs of what isn't ASCII white space."""
    stop = sorted({v for words in STOP_WORDS.values() for w in words.split() for v in (w, w.capitalize(), w.upper())})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.filter(words, lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
            let(F.size(words), lambda n: _repeated(words, n, window)).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda s: s.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        )

    return F.struct(let(F.array_remove(F.split(text, SPACE), ""), of).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, counts, ratios, failed_rules, base_failed and kept, in one projection and no shuffle.

    Base rules: at least 20 words, and at most 30 % of them in repeated 8-word windows.
    A null or empty text has no words and fails. A ratio to nothing is 0. Null and
    repeated ids are rows like others; other columns than those in ``carry`` are ignored,
    whatever their names.
    """
    m = docs.select(F.col(id_col).alias("id"), struct_of(carry).alias("carried") if carry else F.lit(None).alias("carried"), measures(F.coalesce(F.col(text_col), F.lit(""))).alias("m"))
    # The generator keeps a filter on the verdict from being pushed below the measures, where each use of one would compute all anew.
    flat = m.select("id", "carried", F.explode(F.array("m")).alias("m")).select("id", "carried", "m.w.*", "m.l.*", "m.n_symbols")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    ratios = {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
    }
    broken = lambda r: F.lit(False) if r.low is None and r.high is None else (ratios[r.metric] < r.low if r.low is not None else F.lit(False)) | (ratios[r.metric] > r.high if r.high is not None else F.lit(False))
    failed = F.array_compact(F.array(*(F.when(broken(r), F.lit(r.name)) for r in rules)))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = flat.select("*", *(c.alias(k) for k, c in ratios.items()), failed.alias("failed_rules"), base.alias("base_failed"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).withColumnRenamed("id", id_col)
    return out if carry else out.drop("carried")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's query."""
    q = quality(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
