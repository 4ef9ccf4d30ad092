"""Small tables with the hard cases: nulls, empty and long texts, ties, repeats, odd characters, clashing columns."""

import random

WORDS = "the of and river stone cloud lamp paper engine garden silver window mountain pepper violin harbor candle forest market signal bridge thunder copper meadow lantern".split()
RESERVED = "size crc h bucket shard slot fp fp2 node score row kept m w l id".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(5)
    base = [prose(r, 60) for _ in range(12)]
    words = base[0].split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (3, 30, 57)]
    odd = [None, "", " \n\t", "a", "É中文 😀 ﬁ\x1c\x85end", "x" * 3000, ("rock and roll " * 3000), "line one\nline one\n\nline one\n", "<|endoftext|> tail <|endoftext|>", "don't  stop 'til   12½ ²\r\n", "### $$$ %%% || <>"]
    all_texts = [*base, base[1], base[1], base[1], *near, *odd, prose(r, 4000)]
    rows: list[tuple[int | None, str | None]] = list(enumerate(all_texts))
    return [*rows, (None, base[2]), (None, None), (5, base[5]), (5, base[6])]


def table(spark, rows=None, extra: bool = True):
    """documents; with ``extra`` columns whose names clash with what operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(texts() if rows is None else rows, "doc_id long, text string")
    df = df.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(RESERVED))) if extra else df
