"""Terms and their values as columns.

A term is a string in its N-Triples spelling. A number is a struct: its class ``c`` (0
integer, 1 decimal, 2 float, 3 double), and the value as ``i`` decimal(38,0), ``x``
decimal(38,18) and ``f`` double, as far as it fits. Two numbers meet in the larger of
their classes: integers and decimals are compared and summed exactly. Products and
quotients of decimals have a double's precision. Times are compared as instants; one
without a zone is in UTC.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions.prefixes import WELL_KNOWN, XSD

LIT = r'(?s)^"(.*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?$'
INTEGERS = [XSD + k for k in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")]
NUMERIC = [*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double"]
TIMES = [XSD + "dateTime", XSD + "dateTimeStamp", XSD + "date"]
ZONE = r"(Z|[+-]\d\d:\d\d)$"
INT, DEC = "decimal(38,0)", "decimal(38,18)"


def node(value: str, kind: str) -> Column:
    return F.when(F.col(kind) == "iri", F.concat(F.lit("<"), F.col(value), F.lit(">"))).when(F.col(kind) == "bnode", F.concat(F.lit("_:"), F.col(value)))


def object_term() -> Column:
    suffix = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).otherwise("")
    return F.coalesce(node("o", "o_kind"), F.concat(F.lit('"'), F.col("o"), F.lit('"'), suffix))


def value_of(t: Column) -> Column:
    """Lexical form: a literal's text, an IRI without brackets."""
    return F.when(F.startswith(t, F.lit('"')), F.regexp_extract(t, LIT, 1)).when(F.startswith(t, F.lit("<")), F.substring(t, 2, F.length(t) - 2)).otherwise(t)


def datatype_of(t: Column) -> Column:
    d, lang = F.regexp_extract(t, LIT, 2), F.regexp_extract(t, LIT, 3)
    return F.when(F.startswith(t, F.lit('"')), F.when(lang != "", F.lit(WELL_KNOWN["rdf"] + "langString")).when(d == "", F.lit(XSD + "string")).otherwise(d))


def plain(text: Column) -> Column:
    """A literal without datatype."""
    return F.concat(F.lit('"'), text, F.lit('"'))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and named once, so that nested expressions grow no faster than their text."""
    return F.transform(F.array(value), body)[0]


def _with(body: Callable[..., Column], *values: Column) -> Column:
    return let(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))), lambda s: body(*(s[f"v{i}"] for i in range(len(values)))))


# Numbers


def _number(c: Column, i: Column, x: Column, f: Column) -> Column:
    n = F.struct(c.cast("int").alias("c"), i.try_cast(INT).alias("i"), x.try_cast(DEC).alias("x"), f.cast("double").alias("f"))
    return let(n, lambda n: F.when(n["c"].isNotNull() & n["f"].isNotNull() & ((n["c"] != 0) | n["i"].isNotNull()), n))


def integer(v: Column) -> Column:
    return _with(lambda v: _number(F.lit(0), v, v, v), v)


def double(v: Column) -> Column:
    return _number(F.lit(3), F.lit(None), F.lit(None), v)


def parsed(text: Column, datatype: Column) -> Column:
    def of(t: Column, d: Column) -> Column:
        c = F.when(d.isin(INTEGERS), 0).when(d == XSD + "decimal", 1).when(d == XSD + "float", 2).when(d == XSD + "double", 3)
        return F.when(d.isin(NUMERIC), _number(c, t, t, t.try_cast("double")))

    return _with(of, text, datatype)


def lexical(n: Column) -> Column:
    decimal = lambda n: F.regexp_replace(n["x"].cast("string"), r"\.?0+$", "")
    return let(n, lambda n: F.when(n["c"] == 0, n["i"].cast("string")).when((n["c"] == 1) & n["x"].isNotNull(), decimal(n)).otherwise(n["f"].cast("string")))


def number_term(n: Column) -> Column:
    kind = lambda n: F.when(n["c"] == 0, "integer").when(n["c"] == 1, "decimal").when(n["c"] == 2, "float").otherwise("double")
    return let(n, lambda n: F.concat(F.lit('"'), lexical(n), F.lit(f'"^^<{XSD}'), kind(n), F.lit(">")))


def arithmetic(op: str, a: Column, b: Column) -> Column:
    exact = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}.get(op)

    def of(a: Column, b: Column) -> Column:
        f = {"+": lambda: a["f"] + b["f"], "-": lambda: a["f"] - b["f"], "*": lambda: a["f"] * b["f"], "/": lambda: F.try_divide(a["f"], b["f"])}[op]()
        c = F.greatest(a["c"], b["c"])
        if exact is None:
            # A quotient of integers is a decimal; by zero there is none.
            return _with(lambda c, f: F.when(c.isNotNull(), _number(F.greatest(c, F.lit(1)), F.lit(None), f, f)), c, f)
        i = exact(a["i"], b["i"])
        x = exact(a["x"], b["x"]).try_cast(DEC) if op != "*" else f.try_cast(DEC)
        number = lambda c, i, x, f: F.when(a.isNotNull() & b.isNotNull(), _number(c, i, F.when(c == 0, i.try_cast(DEC)).otherwise(x), f))
        return _with(number, c, i, x, f)

    return _with(of, a, b)


def each(n: Column, f: Callable[[Column], Column]) -> Column:
    """A function of one number that keeps its class."""
    return let(n, lambda n: _number(n["c"], f(n["i"]), f(n["x"]), f(n["f"])))


def rounded(n: Column) -> Column:
    """To the nearest whole number, halves upwards."""
    half = lambda v, kind: F.floor(v + F.lit("0.5").cast(kind))
    return let(n, lambda n: _number(n["c"], n["i"], half(n["x"], "decimal(2,1)"), half(n["f"], "double")))


COMPARE = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}


def compare_numbers(op: str, a: Column, b: Column) -> Column:
    f = COMPARE[op]

    def of(a: Column, b: Column) -> Column:
        exact = (a["c"] <= 1) & (b["c"] <= 1) & a["x"].isNotNull() & b["x"].isNotNull()
        return F.when((a["c"] == 0) & (b["c"] == 0), f(a["i"], b["i"])).when(exact, f(a["x"], b["x"])).otherwise(f(a["f"], b["f"]))

    return _with(of, a, b)


def total(v: Column, n: Column, distinct: bool) -> Column:
    """Sum of numbers ``n`` of values ``v``; of none 0, of any that is no number unbound."""
    add = F.sum_distinct if distinct else F.try_sum
    f = F.sum_distinct(n["f"]) if distinct else F.sum(n["f"])
    zero = F.lit(0)
    of = lambda bad, k, c, i, x, f: F.when(bad > 0, None).when(k == 0, integer(zero)).otherwise(_number(c, i, x, f))
    return _with(of, F.count_if(v.isNotNull() & n.isNull()), F.count(n["f"]), F.max(n["c"]), add(n["i"]), add(n["x"]), f)


def mean(v: Column, n: Column, distinct: bool) -> Column:
    """Average; of no number integer 0, of any that is no number unbound."""
    f = F.try_divide(F.sum_distinct(n["f"]), F.count_distinct(n["f"])) if distinct else F.avg(n["f"])
    x = f if distinct else F.try_divide(F.try_sum(n["x"]), F.count(n["f"]))
    of = lambda bad, k, c, x, f: F.when(bad > 0, None).when(k == 0, integer(F.lit(0))).otherwise(_number(F.greatest(c, F.lit(1)), F.lit(None), x, f))
    return _with(of, F.count_if(v.isNotNull() & n.isNull()), F.count(n["f"]), F.max(n["c"]), x, f)


# Values


@dataclass
class Value:
    """An expression's column: ``term`` (N-Triples spelling), ``number`` (struct), ``count`` (long), ``text`` or ``bool``. ``constant``: the term, if it is one."""

    column: Column
    kind: str
    constant: str | None = None

    def number(self) -> Column:
        if self.kind == "number":
            return self.column
        if self.kind == "count":
            return integer(self.column)
        if self.kind == "term":
            return parsed(value_of(self.column), datatype_of(self.column))
        return double(self.column.try_cast("double")) if self.kind == "text" else double(F.lit(None).cast("double"))

    def whole(self) -> Column:
        """As an int, for places and lengths in texts."""
        return F.floor(self.number()["f"]).cast("int")

    def instant(self) -> Column:
        if self.kind != "term":
            return F.lit(None).cast("timestamp")

        def of(d: Column, v: Column, zone: Column) -> Column:
            zone = F.when(zone == "", "Z").otherwise(zone)
            text = F.when(d == XSD + "date", F.concat(F.substring(v, 1, 10), F.lit("T00:00:00"), zone)).otherwise(F.concat(F.regexp_replace(v, ZONE, ""), zone))
            return F.when(d.isin(TIMES), text.try_cast("timestamp"))

        return _with(of, datatype_of(self.column), value_of(self.column), F.regexp_extract(value_of(self.column), ZONE, 1))

    def may_be(self, datatypes: list[str]) -> bool:
        """Whether its datatype can be one of those: always, unless it is a constant."""
        return self.constant is None or any(self.constant.endswith(f"^^<{d}>") for d in datatypes)

    def text(self) -> Column:
        return value_of(self.column) if self.kind == "term" else lexical(self.column) if self.kind == "number" else self.column.cast("string")

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.column
        if self.kind in ("number", "count"):
            return self.number()["f"] != 0
        if self.kind == "text":
            return self.column != ""
        d, v = datatype_of(self.column), value_of(self.column)
        return F.when(d == XSD + "boolean", v.isin("true", "1")).when(d.isin(NUMERIC), v.try_cast("double") != 0).when(d == XSD + "string", v != "")

    def term(self) -> Column:
        if self.kind == "term":
            return self.column
        if self.kind in ("number", "count"):
            return number_term(self.number())
        return F.concat(F.lit('"'), self.column.cast("string"), F.lit(f'"^^<{XSD}boolean>' if self.kind == "bool" else '"'))

    def keys(self) -> list[Column]:
        """What orders values: numbers and times by what they are, all else by text."""
        if self.kind in ("text", "bool"):
            return [self.column]
        n = self.number()
        return [n["f"], n["i"], n["x"], *([self.instant()] if self.kind == "term" else []), self.text()]


def compare(op: str, a: Value, b: Value) -> Column:
    f = COMPARE[op]
    if a.kind == "bool" or b.kind == "bool":
        return f(a.truth(), b.truth())
    if a.kind in ("number", "count") or b.kind in ("number", "count"):
        return compare_numbers(op, a.number(), b.number())
    terms = a.kind == b.kind == "term"
    text = f(a.column, b.column) if op in ("=", "!=") and terms else f(a.text(), b.text())
    if terms and a.may_be(TIMES) and b.may_be(TIMES):
        met = lambda s, t, d, e, other: F.when(s.isNotNull() & t.isNotNull() & (d == e), f(s, t)).otherwise(other)
        text = _with(met, a.instant(), b.instant(), datatype_of(a.column), datatype_of(b.column), text)
    if terms and not (a.may_be(NUMERIC) and b.may_be(NUMERIC)):
        # One is no number: equal terms are equal, and a number is neither before nor after what is none.
        other = b if a.constant is not None and not a.may_be(NUMERIC) else a
        return text if op in ("=", "!=") else F.when(~F.coalesce(datatype_of(other.column).isin(NUMERIC), F.lit(False)), text)
    one = F.lit({"=": False, "!=": True}.get(op)).cast("boolean")
    met = lambda m, n, other: F.when(m.isNotNull() & n.isNotNull(), compare_numbers(op, m, n)).when(m.isNotNull() | n.isNotNull(), one).otherwise(other)
    return _with(met, a.number(), b.number(), text)


def least_or_most(v: Value, f: Callable[[Column, Column], Column]) -> Column:
    """The term with the least or largest keys; unbound ones don't count."""
    keys = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(v.keys())))
    return f(v.term(), F.when(v.column.isNotNull(), keys))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))
