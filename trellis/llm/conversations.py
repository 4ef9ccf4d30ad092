"""Conversation repair: cheapest edits that give alternating roles, by dynamic programming over a trie.

A row's role and fault are one sign, a conversation's rows in order a signature. Equal
signatures are repaired once. Distinct ones are sorted and walked as a prefix trie: a layer
of the dynamic programme belongs to a prefix, so what two signatures begin with is computed
once, and where a signature ends its answer is read off the last layer.

The states are those of the pattern ``(s?(ua)+)?``: at the start, after a system row, after
a user row, after an assistant row. A layer holds, for each state to begin in and each to
end in, the cheapest edits, of equal cost the ASCII-least. Two such edits of the same rows
between the same states never begin one with the other (more insertions cost more), so
least edits followed by least edits are least again. A long conversation can therefore be
cut into segments that are repaired apart and joined: no task holds more than a segment's
rows, however large a share of all rows one conversation has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.runtime import column, ship, staged, table

BLANK = r"^[\x20\x09-\x0D]*$"
ENDED = r"[.!?][\x20\x09-\x0D]*$"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Rows, and bytes of texts, of a segment.
ROWS, BYTES = 512, 1 << 20
#: Characters of role and text by which rows of one turn are ordered.
SHOWN = 64
#: What each state takes next: the role's initial and the state after it. 0: start, 1: after s, 2: after u, 3: after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
OTHER = {"u": "user", "a": "assistant"}

Edits = tuple[int, str]
Layer = list[list[Edits | None]]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text with planted faults, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space there and in roles and texts.

    0: the row goes. 1: its text is empty. 2: its text has no ``.``, ``!`` or ``?``. 3: the
    row comes twice. 4: its role is user.
    """
    spelled = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    d = rows.select(column(conv).alias("conv_id"), column(turn).alias("turn"), spelled(role).alias("role"), spelled(text).alias("text"), (F.crc32(F.concat(spelled(conv), F.lit(":"), spelled(turn)).cast("binary")) % 20).alias("d"))
    d = d.where("d <> 0").withColumn("twice", F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    new_text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"))


# The dynamic programme


def _better(a: Edits | None, b: Edits) -> bool:
    return a is None or b < a


def _insert(layer: Layer) -> Layer:
    """With insertions after what the layer holds, as far as they make it cheaper."""
    for best in layer:
        moved = True
        while moved:
            moved = False
            for s, e in enumerate(best):
                if e:
                    for r, t in NEXT[s].items():
                        new = (e[0] + INSERT, e[1] + "I")
                        if r != "s" and _better(best[t], new):
                            best[t], moved = new, True
    return layer


def first_layer() -> Layer:
    return _insert([[(0, "") if s == t else None for t in range(4)] for s in range(4)])


def next_layer(layer: Layer, sign: str) -> Layer:
    """After one row. Its sign: D if it has to go, else its role's initial (s, u, a, or x for any other), in upper case if it is truncated."""
    out: Layer = []
    role, more = sign.lower(), TRUNCATED * sign.isupper()
    for best in layer:
        new: list[Edits | None] = [None] * 4
        for s, e in enumerate(best):
            if e is None:
                continue
            moves = [(s, DELETE, "D")]
            if sign != "D":
                moves += [(t, more, "K") for r, t in NEXT[s].items() if r == role]
                moves += [(t, more + REROLE, "R") for r, t in NEXT[s].items() if r != "s"]
            for t, cost, edit in moves:
                if _better(new[t], (e[0] + cost, e[1] + edit)):
                    new[t] = (e[0] + cost, e[1] + edit)
        out.append(new)
    return _insert(out)


def solve(signatures: Iterator[str]) -> Iterator[Layer]:
    """The last layer of each signature. They come sorted, so the path of the one before is the trie's branch to share."""
    path, layers = "", [first_layer()]
    for signature in signatures:
        same = next((i for i, (a, b) in enumerate(zip(path, signature, strict=False)) if a != b), min(len(path), len(signature)))
        del layers[same + 1 :]
        for sign in signature[same:]:
            layers.append(next_layer(layers[-1], sign))
        path = signature
        yield layers[-1]


# Rows to segments


def _flagged(rows: DataFrame) -> DataFrame:
    """Rows with ``at`` (a number of their own), ``initial`` and ``fault`` (blank, duplicate, truncated or null).

    A row is a duplicate if one with its role and text is earlier in its conversation. The
    earliest is found by an aggregation, summed in each task first; no task gathers a
    conversation, nor the rows of one text.
    """
    rows = staged(rows.sparkSession, rows, "conv-rows").withColumn("at", F.monotonically_increasing_id())
    rows = rows.select("*", F.substring("role", 1, 1).alias("initial"), F.col("text").rlike(BLANK).alias("blank"), F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("said"))
    order = F.struct("turn", "at")
    firsts = rows.where(~F.col("blank")).groupBy("conv_id", "said").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.xxhash64("conv_id").alias("c"), F.col("conv_id").alias("conv"), F.col("said").alias("same"), "first")
    met = (F.xxhash64("conv_id") == F.col("c")) & F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("said") == F.col("same"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < order, "duplicate").when(~F.col("text").rlike(ENDED), "truncated")
    return rows.join(firsts.hint("merge"), met, "left").select("conv_id", "turn", "role", "text", "said", "at", "initial", fault.alias("fault"))


def _sign() -> Column:
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)


def _segments(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Segments of the conversations, in order of ``seg``: their rows as lists, their signature, and what counts of them need.

    Rows are dealt by ranges of what they are ordered by, so a large conversation, and many
    equal rows, are spread over tasks. The keys of one turn's rows are short.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, SHOWN), F.substring("text", 1, SHOWN), F.col("said"), F.col("at")]
    given = rows.select("conv_id", "turn", "role", "text", "said", "at", "initial", F.coalesce("fault", F.lit("")).alias("fault"), _sign().alias("sign"))
    given = given.repartitionByRange(*order).sortWithinPartitions(*order)
    kind, turn_kind = given.schema["conv_id"].dataType, given.schema["turn"].dataType
    fields = [("seg", T.LongType()), ("conv_id", kind), ("signature", T.StringType()), ("roles", T.ArrayType(T.StringType())), ("texts", T.ArrayType(T.StringType())), ("first", T.StringType()), ("last", T.StringType()), ("illegal", T.LongType())]
    fields += [(k, T.LongType()) for k in ("blank", "duplicate", "truncated", "turns")] + [("least", turn_kind), ("most", turn_kind)]
    schema = T.StructType([T.StructField(k, t) for k, t in fields])

    def run(batches):
        from pyspark import TaskContext

        from pyspark.sql.pandas.types import to_arrow_schema

        part, k, arrow = TaskContext.get().partitionId(), 0, to_arrow_schema(schema)

        def closed(conv, held):
            nonlocal k
            turns, roles, texts, initials, faults, signs = zip(*held, strict=True)
            own = [t for t in turns if t is not None]
            pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            row = [(part << 32) + k, conv, "".join(signs), list(roles), list(texts), initials[0], initials[-1], pairs, *map(faults.count, ("blank", "duplicate", "truncated")), len(set(own)), min(own, default=None), max(own, default=None)]
            k += 1
            return row

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        conv, held, size, out, out_size = None, [], 0, [], 0
        for b in batches:
            names = ("conv_id", "turn", "role", "text", "initial", "fault", "sign")
            for i in range(0, b.num_rows, 1024):
                cols = [b.column(n).slice(i, 1024).to_pylist() for n in names]
                for c, *rest in zip(*cols, strict=True):
                    if held and (c != conv or len(held) >= most_rows or size >= most_bytes):
                        out.append(closed(conv, held))
                        held, out_size, size = [], out_size + size, 0
                        if len(out) >= 512 or out_size >= 4 * most_bytes:
                            yield batch(out)
                            out, out_size = [], 0
                    conv = c
                    held.append(tuple(rest))
                    size += len(rest[2])
        if held:
            out.append(closed(conv, held))
        if out:
            yield batch(out)

    return staged(rows.sparkSession, given.mapInArrow(run, schema), "conv-segments", gather=False)


def _answers(segments: DataFrame) -> DataFrame:
    """signature, costs, edits (16 each: a state to begin in, a state to end in; cost -1 if there is no way) of the distinct signatures."""
    signs = segments.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")

    def run(batches):
        def texts():
            for b in batches:
                yield from b.column(0).to_pylist()

        given, rows = [], []

        def tee():
            for t in texts():
                given.append(t)
                yield t

        for layer in solve(tee()):
            rows.append([x for best in layer for x in best])
            if len(rows) >= 256:
                yield batch(given, rows)
                given.clear()
                rows.clear()
        if rows:
            yield batch(given, rows)

    def batch(given, rows):
        costs = pa.array([[x[0] if x else -1 for x in r] for r in rows], pa.list_(pa.int64()))
        return pa.record_batch([pa.array(given, pa.string()), costs, pa.array([[x[1] if x else "" for x in r] for r in rows], pa.list_(pa.string()))], names=["signature", "costs", "edits"])

    return signs.mapInArrow(run, "signature string, costs array<long>, edits array<string>")


# Segments to conversations


class _Fold:
    """One conversation's segments, in order: the cheapest edits to each state, and counts over the segments' borders.

    An entry is (cost, pieces, segment's edits so far): pieces are a chain of tuples (chain
    before, state to begin in, edits), so nothing is copied while the ways share a past.
    """

    def __init__(self):
        self.ways: list = [(0, None), None, None, None]
        self.segments: list[int] = []
        self.counts = [0, 0, 0, 0]
        self.last, self.turns, self.least, self.most = None, 0, None, None

    @staticmethod
    def text(chain) -> str:
        parts = []
        while chain:
            chain, _, edits = chain
            parts.append(edits)
        return "".join(reversed(parts))

    def _least(self, ways):
        """Of ways of equal cost the ASCII-least; texts are made only where there are several."""
        least = min(w[0] for w in ways)
        ways = [w for w in ways if w[0] == least]
        return ways[0] if len(ways) == 1 else min(ways, key=lambda w: self.text(w[1]))

    def add(self, seg, costs, edits, first, last, counts, turns, least, most):
        new: list = [None] * 4
        for t in range(4):
            ways = [(w[0] + costs[4 * s + t], (w[1], s, edits[4 * s + t])) for s, w in enumerate(self.ways) if w and costs[4 * s + t] >= 0]
            if ways:
                new[t] = self._least(ways)
        self.ways = new
        self.segments.append(seg)
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if self.last is not None:
            self.counts[3] += self.last + first not in ("su", "ua", "au")
        self.last = last
        if least is not None:
            self.turns += turns - (self.most == least)
            self.least, self.most = least if self.least is None else self.least, most

    def end(self):
        cost, chain = self._least([self.ways[t] for t in ENDS if self.ways[t]])
        pieces, at = [], chain
        while at:
            at, state, edits = at
            pieces.append((state, edits))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return cost, list(zip(self.segments, reversed(pieces), strict=True)), gaps


def repair(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations (conv_id, turn, role, text), each taken by turn, nulls first; of one turn
    by the first ``SHOWN`` characters of role and text, then by a hash of both.

    First a table of conversations: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit. Second the repaired rows: conv_id, seg, place (both in order), edit, role,
    text. Rows that are deleted aren't in it.

    A row's first fault counts: blank, said before (role and text), or without an end mark.
    Blank and repeated rows have to go (2 each); others stay, get another role (1) or go;
    a missing row of user or assistant, without text, can come in anywhere (5); a row that
    stays truncated costs 5. Null conv_ids are one conversation; null roles and texts count
    as one space; equal rows are repeats. Texts of any length are kept whole. An empty table
    gives none. Further columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    segments = _segments(_flagged(rows), most_rows, most_bytes)
    solved = segments.drop("roles", "texts").join(_answers(segments).hint("merge"), "signature")
    # Without texts, one row for each segment: a conversation's segments are folded in one task, a few hundred rows at a time.
    numbers = solved.select("conv_id", "seg", "costs", "edits", "first", "last", F.array("blank", "duplicate", "truncated", "illegal").alias("counts"), "turns", "least", "most")
    numbers = numbers.repartition(F.xxhash64("conv_id")).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seg")
    fields = [segments.schema["conv_id"], *(T.StructField(k, T.LongType()) for k in ("seg", "state")), T.StructField("edits", T.StringType()), *(T.StructField(k, T.LongType()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))]
    schema = T.StructType(fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        def ended(conv, fold):
            cost, pieces, gaps = fold.end()
            yield [conv, None, None, "".join(e for _, (_, e) in pieces), gaps, *fold.counts, cost]
            for seg, (state, edits) in pieces:
                yield [conv, seg, state, edits, *[None] * 6]

        conv, fold, out = None, None, []
        for b in batches:
            for i in range(0, b.num_rows, 256):
                for c, *rest in zip(*(x.to_pylist() for x in b.slice(i, 256).columns), strict=True):
                    if fold and c != conv:
                        out += ended(conv, fold)
                        fold = None
                    conv, fold = c, fold or _Fold()
                    fold.add(*rest)
                    if len(out) >= 1024:
                        yield batch(out)
                        out = []
        if fold:
            out += ended(conv, fold)
        if out:
            yield batch(out)

    folded = staged(spark, numbers.mapInArrow(run, schema), "conv-edits")
    report = folded.where("seg IS NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.col("edits").alias("audit"))
    pieces = folded.where("seg IS NOT NULL").select("seg", "state", "edits")
    return report, _repaired(segments.select("seg", "conv_id", "roles", "texts").join(pieces.hint("merge"), "seg"))


def _repaired(segments: DataFrame) -> DataFrame:
    """The segments' rows under their edits."""
    schema = T.StructType([segments.schema["conv_id"], T.StructField("seg", T.LongType()), T.StructField("place", T.IntegerType()), *(T.StructField(k, T.StringType()) for k in ("edit", "role", "text"))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            for i in range(b.num_rows):
                seg, conv, roles, texts, state, edits = (x[0].as_py() for x in b.slice(i, 1).columns)
                out, at = [], 0
                for edit in edits:
                    role, text = ("", "") if edit == "I" else (roles[at], texts[at])
                    at += edit != "I"
                    if edit == "D":
                        continue
                    if edit != "K":
                        # Only one role of user and assistant can follow.
                        role = OTHER["a" if "a" in NEXT[state] else "u"]
                    state = NEXT[state][role[0]]
                    out.append((conv, seg, len(out), edit, role, text))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return segments.select("seg", "conv_id", "roles", "texts", "state", "edits").mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 of the repaired ``role:text`` lines of each conversation that has any.

    A hash goes through its text in order, so a conversation is read by one task; it holds
    a few rows at a time.
    """
    ship(repaired.sparkSession)
    rows = repaired.select("conv_id", "seg", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    rows = rows.repartition(F.xxhash64("conv_id")).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seg", "place")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("sha256", T.StringType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        conv, h, out = None, None, []
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                for c, line in zip(b.column(0).slice(i, 1024).to_pylist(), b.column(3).slice(i, 1024).to_pylist(), strict=True):
                    if h and c == conv:
                        h.update(b"\n")
                    else:
                        if h:
                            out.append((conv, h.hexdigest()))
                        conv, h = c, hashlib.sha256()
                    h.update(line.encode())
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []
        if h:
            out.append((conv, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    """The contract's query: all conversations after planted damage, also those that it leaves without rows."""
    given = table(spark, sf_dir, "conversations")
    report, repaired = repair(damaged(given))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = lambda *names: [F.lit(None).cast("string" if k in ("audit", "sha256") else "long").alias(k) for k in names]
    ids = given.select("conv_id").distinct().select("conv_id", *none(*numbers, "audit", "sha256"))
    rows = ids.unionByName(report.select("*", *none("sha256"))).unionByName(digests(repaired).select("conv_id", *none(*numbers, "audit"), "sha256"))
    zero, empty = F.lit(0).cast("long"), F.lit(hashlib.sha256().hexdigest())
    merged = rows.groupBy("conv_id").agg(*(F.coalesce(F.max(k), zero).alias(k) for k in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha256"), empty).alias("repaired_sha256"))
    return merged
