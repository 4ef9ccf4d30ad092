"""Toxicity by compression distance: two zstandard dictionaries and their difference.

The ordinary dictionary is trained on ordinary text. The toxic one is the same content
and what zstandard's trainer makes of the toxic text's own windows: words that begin as
words of several toxic texts do and hardly any ordinary one does. So both dictionaries
match ordinary text alike, and a window's difference of compressed lengths says how much
of it only toxic text explains. A window is one word, compressed behind a few carriers
(ordinary phrases, the same for all), which pay for a frame's fixed costs; compressed
lengths of a word alone are too coarse to compare.

Thresholds are calibrated on labelled rows that the dictionaries haven't seen: each
difference's log-likelihood ratio between toxic and ordinary text, added up over a
document, and a logistic curve from that sum to the score.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.runtime import Memory, lean, ship, slices, struct_of, table

#: Bound of what a model is fitted on: labelled rows of each class, with their whole texts.
ROWS = 3000
#: Windows of eight words that the ordinary dictionary is trained on: evenly taken from those rows if they have more.
RUNS = 100_000
LEVEL, CARRIERS, SHARED, MEMORY = 12, 3, 4, 200_000
#: Each view: encoding of the windows, bytes of the ordinary and of the toxic dictionary, whether toxic samples keep whole words.
VIEWS = (("utf-8", 32_768, 4096, False), ("utf-16-le", 32_768, 8192, True))


PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words; all of ASCII but letters and digits is space."""
    if not text:
        return []
    return (text.decode("utf-8", "replace") if isinstance(text, bytes) else text).lower().encode().translate(PLAIN).split()


def _starts(word: bytes) -> set[bytes]:
    return {b" " + word[:n] for n in range(4, 9) if len(word) >= n}


def _dictionary(size: int, samples: list[bytes], **kw) -> bytes:
    """Trained content; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **kw).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class View:
    """A pair of dictionaries over one encoding, and its differences' log-likelihood ratios."""

    encoding: str
    ordinary: bytes
    toxic: bytes
    carriers: list[bytes]
    ratio: dict[int, float] = field(default_factory=dict)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __post_init__(self):
        self.__setstate__(self.__dict__)

    def __setstate__(self, state):
        self.__dict__.update(state)
        of = lambda b: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        self._a, self._b = of(self.ordinary), of(self.ordinary + self.toxic)
        self._base = -sum(map(self._saved, self.carriers))
        self._width = len(self.encode(b"a"))
        n = SHARED * self._width
        self._grams = {self.toxic[i : i + n] for i in range(len(self.toxic) - n + 1)}

    def encode(self, text: bytes) -> bytes:
        return text if self.encoding == "utf-8" else text.decode("utf-8", "replace").encode(self.encoding)

    def _saved(self, window: bytes) -> int:
        x = self.encode(window + b" ")
        return len(self._a.compress(x)) - len(self._b.compress(x))

    def difference(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves on a word, over all carriers; none on one that shares no ``SHARED`` characters with it."""
        x, n = self.encode(b" " + word + b" "), SHARED * self._width
        if self._grams.isdisjoint([x[i : i + n] for i in range(0, len(x) - n + 1, self._width)]):
            return 0
        return self._base + sum(self._saved(c + b" " + word) for c in self.carriers)


@dataclass
class Model:
    """Without toxic or ordinary rows there are no views, and every score is 0 or 1."""

    views: list[View] = field(default_factory=list)
    ratio: dict[int, float] = field(default_factory=dict)
    slope: float = 0.0
    offset: float = -math.inf

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memory"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def __post_init__(self):
        self.memory = Memory(lambda w: self.ratio.get(self.strongest(w), 0.0), MEMORY)

    def strongest(self, word: bytes) -> int:
        """The largest ratio of any view, in halves."""
        return round(2 * max(v.ratio.get(v.difference(word), 0.0) for v in self.views))

    def evidence(self, words: list[bytes]) -> float:
        """Sum of log-likelihood ratios. Words seen before aren't compressed again."""
        memory = self.memory
        return sum([memory[w] for w in words])

    def score(self, text: str | bytes | None) -> float:
        if not self.views:
            return 1.0 if self.offset == math.inf else 0.0
        x = self.slope * self.evidence(words_of(text)) + self.offset
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _logistic(x: list[float], y: list[int], w: list[float]) -> tuple[float, float]:
    """Slope and offset by Newton's method, slightly regularised; the slope stays positive."""
    a, b = 1.0, math.log(sum(v for v, k in zip(w, y, strict=True) if k) / sum(v for v, k in zip(w, y, strict=True) if not k))
    for _ in range(50):
        ga, gb, haa, hab, hbb = -1e-3 * a, 0.0, 1e-3, 0.0, 1e-9
        for v, k, m in zip(x, y, w, strict=True):
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, a * v + b))))
            q = m * p * (1 - p)
            ga, gb = ga + m * (k - p) * v, gb + m * (k - p)
            haa, hab, hbb = haa + q * v * v, hab + q * v, hbb + q
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(1e-3, a + max(-1.0, min(1.0, da))), b + max(-1.0, min(1.0, db))
        if abs(da) + abs(db) < 1e-6:
            break
    return a, b


def fit(rows: list[tuple[str, int]], share: float) -> Model:
    """A model from texts with labels 0 and 1, and the share of label 1 among all labelled rows.

    Every other row of each class trains the dictionaries, the rest calibrates.
    """
    by = [[words_of(t) for t, k in rows if k == c and t] for c in (0, 1)]
    by = [[w for w in docs if w] for docs in by]
    if min(map(len, by)) < 2:
        return Model(offset=math.inf if len(by[1]) and not len(by[0]) else -math.inf)
    ordinary, toxic = by[0][::2], by[1][::2]
    seen, own = (Counter(s for docs in part for s in {s for w in docs for s in _starts(w)}) for part in (ordinary, toxic))
    novel = {s for s, n in own.items() if n >= min(4, len(toxic)) and n * (len(ordinary) + 1) >= 20 * (seen[s] + 1) * len(toxic)} or {s for s, n in own.items() if n > 1 and not seen[s]}
    found = [(w, max(x, key=lambda s: (len(s), s))) for docs in toxic for w in docs if (x := novel & _starts(w))]
    runs = [b" " + b" ".join(docs[i : i + 8]) + b" " for docs in ordinary for i in range(0, len(docs), 8)]
    carriers = [r.strip() for r in runs if 40 <= len(r) <= 60][:: max(1, len(runs) // 50)][:CARRIERS] or [runs[0].strip()]
    m = Model()
    for encoding, size, own_size, whole in VIEWS:
        v = View(encoding, b"", b"", [])
        samples = [v.encode(b" " + w + b" " if whole else s) for w, s in found] + [v.encode(s) for s in sorted(novel) for _ in range(own[s] if whole else 0)]
        ordinary_bytes = _dictionary(size, [v.encode(r) for r in runs[:: 1 + len(runs) // RUNS]])
        m.views.append(View(encoding, ordinary_bytes, _dictionary(own_size, samples, k=32, d=6) if samples else b"", carriers))

    rest = [part[1::2] for part in by]
    count = lambda docs, of: Counter(of(w) for x in docs for w in x)
    for v in m.views:
        v.ratio = _ratios(*(count(x, cache(v.difference)) for x in rest))
    strongest = cache(m.strongest)
    m.ratio = _ratios(*(count(x, strongest) for x in rest))
    x = [sum(m.ratio[strongest(w)] for w in d) for docs in rest for d in docs]
    n0, n1 = map(len, rest)
    m.slope, m.offset = _logistic(x, [0] * n0 + [1] * n1, [(1 - share) * len(x) / n0] * n0 + [share * len(x) / n1] * n1)
    return m


def _ratios(c0: Counter, c1: Counter) -> dict[int, float]:
    """Log of the share among toxic windows over that among ordinary ones, with one window more of each kind."""
    n0, n1, kinds = sum(c0.values()), sum(c1.values()), {*c0, *c1}
    return {v: math.log((c1[v] + 1) / (n1 + len(kinds)) / ((c0[v] + 1) / (n0 + len(kinds)))) for v in kinds}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS) -> Model:
    """Fits on at most ``rows`` labelled rows of each class, those with the least hash of id; counts all labels for the share.

    Labels other than 0 and 1, and those without an id, are left out. An id counts once: with
    label 1 if it has both, and with the least of its texts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    count = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pick = lambda c: known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = pick(0).unionByName(pick(1))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    got = own.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")).collect()
    got = sorted(got, key=lambda r: (r.label, str(r.id)))
    return fit([(r.text, r.label) for r in got], count.get(1, 0) / max(1, sum(count.values())))


_models: dict[str, Model] = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, score (0 to 1), and with ``carry`` a struct ``carried`` of those columns.

    Null and empty texts get the score of no evidence; texts of any length are read whole.
    Null and repeated ids are rows like others, and an empty table gives none. Columns that
    aren't carried are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(model)
    # A text that is carried isn't sent a second time.
    place = carry.index(text_col) if text_col in carry else None
    rows = docs.select(F.col(id_col).alias("id"), *([F.col(text_col).alias("text")] if place is None else []), *([struct_of(carry).alias("carried")] if carry else []))

    def run(batches):
        if key not in _models:
            _models.clear()
            _models[key] = sent.value
        m = _models[key]
        for b in slices(batches):
            texts = b.column(1) if place is None else b.column(1).field(place)
            scores = pa.array([m.score(t) for t in texts.to_pylist()], pa.float64())
            carried = [b.column("carried")] if carry else []
            yield pa.record_batch([b.column(0), scores, *carried], names=["id", "score", "carried"][: 2 + len(carried)])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType()), *([rows.schema["carried"]] if carry else [])])
    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def held_out(key) -> F.Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's query."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id")))
    s = score(docs, model)
    return s.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
