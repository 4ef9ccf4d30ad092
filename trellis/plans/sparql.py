"""SPARQL: text to syntax tree to DataFrame.

A solution table has a column for each variable, holding the term in its N-Triples
spelling, so equality of terms is equality of strings, and joins need nothing else.
Constants of a pattern become filters on the triple table's own columns and reach its
scan. Patterns that share variables are joined; those with the most constants go first.
Which variables may be unbound is known for each table: only those cost more than an
equality in a join.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.prefixes import IMPLICIT, RDF_TYPE, WELL_KNOWN, XSD
from trellis.functions.terms import COLUMNS
from trellis.plans.closure import closure, staged
from trellis.plans.values import COMPARE, DEC, INTEGERS, LIT, NUMERIC, ZONE, Value, all_of, arithmetic, compare, datatype_of, each, integer, least_or_most, lexical, mean, node, object_term, parsed, plain, rounded, total, value_of
from trellis.sources.turtle import unescape

TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<string>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<var>[?$]\w+)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|(?P<bnode>_:\w+)|(?P<name>[A-Za-z_][\w-]*(?:\.[\w-]+)*:(?:[\w%-]|\.(?=[\w%-]))*|:(?:[\w%-]|\.(?=[\w%-]))*)
    |(?P<word>[A-Za-z_]\w*)|(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}().;,\[\]=<>!+*/|^?-])""",
    re.X | re.S,
)
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class SparqlSyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    """A term in N-Triples spelling."""

    text: str


@dataclass(frozen=True)
class Path:
    """op: iri, ^, /, |, +, *, ? or ! (parts: predicates that may not be there forwards, and backwards; None: that way isn't taken)."""

    op: str
    parts: tuple


@dataclass
class Group:
    parts: list = field(default_factory=list)


@dataclass
class Query:
    form: str
    where: Group
    select: list = field(default_factory=list)
    distinct: bool = False
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    template: list = field(default_factory=list)


def column_of(name: str) -> str:
    """A variable's column. Spark doesn't tell cases apart, and the engine's own columns begin with other letters."""
    return "v" + "".join(c if c.isascii() and (c.islower() or c.isdigit()) else "__" if c == "_" else f"_{c.lower()}" if c.isascii() else f"_{ord(c)}_" for c in name)


def name_of(column: str) -> str:
    """The variable whose column it is."""
    return re.sub(r"_(?:(_)|([a-z])|(\d+)_)", lambda m: m[1] or (m[2] or "").upper() or chr(int(m[3])), column[1:])


def variable(token: str) -> Var:
    return Var(column_of(token[1:]))


def literal(value: str, datatype: str | None = None, lang: str | None = None) -> str:
    return f'"{value}"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype and datatype != XSD + "string" else "")


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, unknown_prefix: str | None = None):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SparqlSyntaxError(f"at {at}: {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.n, self.unknown = 0, 0, unknown_prefix
        self.prefixes = {k: WELL_KNOWN[k] for k in IMPLICIT} | (prefixes or {})

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][1]

    def kind(self) -> str:
        return self.tokens[self.at][0]

    def word(self) -> str:
        return self.peek().upper() if self.kind() == "word" else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def accept(self, *texts: str) -> str | None:
        if self.kind() != "string" and self.peek().upper() in texts:
            return self.take().upper()
        return None

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise SparqlSyntaxError(f"{text} is missing before {self.peek()!r}")

    def iri(self, text: str) -> str:
        if text.startswith("<"):
            return text[1:-1]
        head, _, local = text.partition(":")
        if head not in self.prefixes:
            if self.unknown in self.prefixes:
                return self.prefixes[self.unknown] + local
            raise SparqlSyntaxError(f"prefix {head}: isn't declared")
        return self.prefixes[head] + local

    def fresh(self) -> Var:
        self.n += 1
        return Var(f"f{self.n}")

    def query(self) -> Query:
        while w := self.accept("PREFIX", "BASE"):
            if w == "PREFIX":
                name = self.take()
                self.prefixes[name.rstrip(":")] = self.take()[1:-1]
            else:
                self.take()
        q = self.body()
        if self.kind() != "end":
            raise SparqlSyntaxError(f"nothing may follow, but there is {self.peek()!r}")
        return q

    def body(self) -> Query:
        form = self.accept("ASK", "SELECT", "CONSTRUCT", "DESCRIBE")
        if not form:
            raise SparqlSyntaxError(f"ASK, SELECT, CONSTRUCT or DESCRIBE is missing before {self.peek()!r}")
        q = Query(form, Group())
        if form == "CONSTRUCT":
            short = self.accept("WHERE")
            q.template = [x[1:] for x in self.group().parts if x[0] == "triple"]
            if short:
                q.where = Group([("triple", *t) for t in q.template])
        if form == "DESCRIBE":
            while not self.accept("*") and self.kind() in ("var", "iri", "name"):
                q.select.append(self.term())
            if self.kind() == "end":
                return q
        if form == "SELECT":
            q.distinct = bool(self.accept("DISTINCT", "REDUCED"))
            if self.accept("*"):
                q.select = ["*"]
            while self.kind() == "var" or self.peek() == "(":
                if self.accept("("):
                    e = self.expression()
                    self.expect("AS")
                    q.select.append((variable(self.take()).name, e))
                    self.expect(")")
                else:
                    q.select.append((variable(self.peek()).name, variable(self.take())))
            if not q.select:
                raise SparqlSyntaxError("SELECT has no variable")
        if form != "CONSTRUCT" or not short:
            self.accept("WHERE")
            q.where = self.group()
        while w := self.accept("GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET"):
            if w in ("GROUP", "ORDER"):
                self.expect("BY")
            if w == "GROUP":
                while self.kind() == "var" or self.peek() == "(":
                    if self.accept("("):
                        e = self.expression()
                        name = variable(self.take()).name if self.accept("AS") else self.fresh().name
                        self.expect(")")
                        q.group.append((name, e))
                    else:
                        q.group.append((variable(self.peek()).name, variable(self.take())))
            elif w == "HAVING":
                while self.peek() == "(":
                    q.having.append(self.primary())
            elif w == "ORDER":
                while self.kind() == "var" or self.peek() == "(" or self.word() in ("ASC", "DESC"):
                    down = self.accept("ASC", "DESC") == "DESC"
                    q.order.append((self.primary(), down))
            elif w == "LIMIT":
                q.limit = int(self.take())
            else:
                q.offset = int(self.take())
        return q

    def group(self) -> Group:
        self.expect("{")
        g = Group()
        if self.word() == "SELECT":
            g.parts.append(("select", self.body()))
            self.expect("}")
            return g
        while not self.accept("}"):
            w = self.word()
            if w == "FILTER":
                self.take()
                g.parts.append(("filter", self.primary()))
            elif w == "OPTIONAL":
                self.take()
                g.parts.append(("optional", self.group()))
            elif w == "MINUS":
                self.take()
                g.parts.append(("minus", self.group()))
            elif w == "BIND":
                self.take()
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                g.parts.append(("bind", variable(self.take()).name, e))
                self.expect(")")
            elif w == "VALUES":
                self.take()
                g.parts.append(self.values())
            elif self.peek() == "{":
                arms = [self.group()]
                while self.accept("UNION"):
                    arms.append(self.group())
                g.parts.append(("union", arms))
            else:
                self.triples(g)
            self.accept(".")
            if self.kind() == "end":
                raise SparqlSyntaxError("} is missing")
        return g

    def values(self) -> tuple:
        many = bool(self.accept("("))
        names = []
        while self.kind() == "var":
            names.append(variable(self.take()).name)
        if many:
            self.expect(")")
        self.expect("{")
        rows = []
        while not self.accept("}"):
            if many:
                self.expect("(")
            row = [None if self.accept("UNDEF") else self.term().text for _ in names]
            if many:
                self.expect(")")
            rows.append(tuple(row))
        return "values", names, rows

    def term(self):
        kind, text = self.kind(), self.take()
        if kind == "var":
            return variable(text)
        if kind in ("iri", "name"):
            return Const(f"<{self.iri(text)}>")
        if kind == "bnode":
            return Var("b" + column_of(text[2:]))
        if kind == "string":
            n = 3 if text[:3] in ('"' * 3, "'" * 3) else 1
            value = unescape(text[n:-n])
            if self.kind() == "lang":
                return Const(literal(value, None, self.take()[1:]))
            if self.accept("^^"):
                return Const(literal(value, self.iri(self.take())))
            return Const(literal(value))
        if text in ("-", "+") and self.kind() == "number":
            text, kind = text + self.take(), "number"
        if kind == "number":
            return Const(literal(text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer")))
        if text.lower() in ("true", "false"):
            return Const(literal(text.lower(), XSD + "boolean"))
        if text == "[":
            self.expect("]")
            return self.fresh()
        raise SparqlSyntaxError(f"no term: {text!r}")

    def node(self, g: Group):
        """A term; what brackets say of a blank node, and the parts of a list, become triples."""
        if self.peek() == "[" and self.peek(1) != "]":
            self.take()
            own = self.fresh()
            self.properties(g, own)
            self.expect("]")
            return own
        if self.accept("("):
            rdf, items = WELL_KNOWN["rdf"], []
            while not self.accept(")"):
                items.append(self.node(g))
                if self.kind() == "end":
                    raise SparqlSyntaxError(") is missing")
            rest = Const(f"<{rdf}nil>")
            for item in reversed(items):
                own = self.fresh()
                g.parts += [("triple", own, Path("iri", (rdf + "first",)), item), ("triple", own, Path("iri", (rdf + "rest",)), rest)]
                rest = own
            return rest
        return self.term()

    def path(self):
        arms = [self.sequence()]
        while self.accept("|"):
            arms.append(self.sequence())
        return arms[0] if len(arms) == 1 else Path("|", tuple(arms))

    def sequence(self):
        steps = [self.step()]
        while self.accept("/"):
            steps.append(self.step())
        return steps[0] if len(steps) == 1 else Path("/", tuple(steps))

    def step(self):
        back = bool(self.accept("^"))
        if self.accept("!"):
            p = self.complement()
        elif self.accept("("):
            p = self.path()
            self.expect(")")
        elif self.kind() == "word" and self.peek() == "a":
            self.take()
            p = Path("iri", (RDF_TYPE,))
        elif self.kind() in ("iri", "name"):
            p = Path("iri", (self.iri(self.take()),))
        else:
            raise SparqlSyntaxError(f"no predicate: {self.peek()!r}")
        if self.peek() in ("+", "*", "?"):
            p = Path(self.take(), (p,))
        return Path("^", (p,)) if back else p

    def complement(self) -> Path:
        """What follows ``!``: one predicate, or several in parentheses, each maybe with ``^``."""
        there, back = [], []
        many = bool(self.accept("("))
        while not (many and self.accept(")")):
            into = back if self.accept("^") else there
            if self.kind() == "word" and self.peek() == "a":
                self.take()
                into.append(RDF_TYPE)
            elif self.kind() in ("iri", "name"):
                into.append(self.iri(self.take()))
            else:
                raise SparqlSyntaxError(f"no predicate: {self.peek()!r}")
            if not many:
                break
            self.accept("|")
        return Path("!", (tuple(there) if there or not back else None, tuple(back) if back else None))

    def triples(self, g: Group) -> None:
        alone = self.peek() == "[" and self.peek(1) != "]"
        s = self.node(g)
        if not alone or self.peek() not in (".", "}"):
            self.properties(g, s)

    def properties(self, g: Group, s) -> None:
        while True:
            p = variable(self.take()) if self.kind() == "var" else self.path()
            while True:
                g.parts.append(("triple", s, p, self.node(g)))
                if not self.accept(","):
                    break
            more = False
            while self.accept(";"):
                more = True
            if not more or self.peek() in (".", "}", "]"):
                return

    def expression(self):
        e = self.conjunction()
        while self.accept("||"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.comparison()
        while self.accept("&&"):
            e = ("and", e, self.comparison())
        return e

    def comparison(self):
        e = self.sum()
        if op := self.accept("=", "!=", "<", ">", "<=", ">="):
            return (op, e, self.sum())
        no = bool(self.word() == "NOT" and self.peek(1).upper() == "IN" and self.take())
        if self.accept("IN"):
            self.expect("(")
            items = []
            while not self.accept(")"):
                items.append(self.expression())
                self.accept(",")
            e = reduce(lambda a, b: ("or", a, b), [("=", e, i) for i in items]) if items else ("false",)
            return ("not", e) if no else e
        return e

    def sum(self):
        e = self.product()
        while op := self.accept("+", "-"):
            e = (op, e, self.product())
        return e

    def product(self):
        e = self.unary()
        while op := self.accept("*", "/"):
            e = (op, e, self.unary())
        return e

    def unary(self):
        if self.accept("!"):
            return ("not", self.unary())
        if self.accept("-"):
            return ("negative", self.unary())
        return self.primary()

    def primary(self):
        if self.accept("("):
            e = self.expression()
            self.expect(")")
            return e
        w = self.word()
        if w in ("EXISTS", "NOT") and (w == "EXISTS" or self.peek(1).upper() == "EXISTS"):
            if self.take().upper() == "NOT":
                self.take()
                return ("not_exists", self.group())
            return ("exists", self.group())
        if self.kind() in ("word", "name", "iri") and self.peek(1) == "(" and self.peek().lower() not in ("true", "false"):
            name = self.take()
            name = name.upper() if self.tokens[self.at - 1][0] == "word" else self.iri(name)
            self.expect("(")
            distinct, args, separator = bool(self.accept("DISTINCT")), [], " "
            while not self.accept(")"):
                if self.accept("*"):
                    args.append("*")
                elif self.accept("SEPARATOR"):
                    self.expect("=")
                    separator = unescape(self.take()[1:-1])
                else:
                    args.append(self.expression())
                self.accept(",", ";")
                if self.kind() == "end":
                    raise SparqlSyntaxError(") is missing")
            return ("call", name, tuple(args), distinct, separator)
        return self.term()


def parse(text: str, prefixes: dict[str, str] | None = None, unknown_prefix: str | None = None) -> Query:
    """Syntax tree of a query; ``unknown_prefix`` stands in for prefixes that aren't declared. Raises SparqlSyntaxError."""
    return Parser(text, prefixes, unknown_prefix).query()


# Solutions


@dataclass
class Table:
    """Solutions: a column for each variable, and which of them may be unbound."""

    df: DataFrame
    maybe: frozenset = frozenset()

    @property
    def columns(self) -> list[str]:
        return self.df.columns


def _variables(x) -> set[str]:
    """All variables that a part of a query names."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, Group):
        return set().union(*map(_variables, x.parts))
    if isinstance(x, Query):
        return {n for n, _ in x.select if n != "*"} if x.select and x.select != ["*"] else _variables(x.where)
    if isinstance(x, Path):
        return set()
    if isinstance(x, (tuple, list)):
        own = {x[1]} if len(x) == 3 and x[0] == "bind" else set(x[1]) if len(x) == 3 and x[0] == "values" else set()
        return own.union(*(_variables(y) for y in x if isinstance(y, (Var, Group, Query, tuple, list)) and not (x[:1] == ("values",) and y is x[2])))
    return set()


def _loose_names(g: Group) -> set[str]:
    """Variables that expressions of a group name and that no triple pattern of the same group binds."""
    out, bound = set(), set().union(*(_variables(p) for p in g.parts if p[0] == "triple"))
    for p in g.parts:
        if p[0] in ("filter", "bind"):
            out |= _variables(p[-1])
        elif p[0] == "union":
            out = out.union(*(_loose_names(a) for a in p[1]))
        elif p[0] in ("optional", "minus"):
            out |= _loose_names(p[1])
    return out - bound


class Builder:
    """``counts``: how many triples each predicate has, if that is known; small ones are joined first."""

    def __init__(self, triples: DataFrame, counts: dict[str, int] | None = None, numbers=None):
        self.triples, self.counts = triples, counts or {}
        self.spark = triples.sparkSession
        self.numbers = numbers or itertools.count(1)
        self.kinds: dict[str, str] = {}

    # patterns

    def fresh(self) -> str:
        return f"g{next(self.numbers)}"

    def match(self, s, p, o) -> DataFrame:
        df, out, same = self.triples, {}, []
        for x, c, col in ((s, "s", lambda: node("s", "s_kind")), (p, "p", lambda: F.concat(F.lit("<"), F.col("p"), F.lit(">"))), (o, "o", object_term)):
            if isinstance(x, Var):
                if x.name in out:
                    same.append((x.name, col()))
                else:
                    out[x.name] = col()
            elif isinstance(x, Path):
                df = df.where(F.col("p") == x.parts[0])
            else:
                df = df.where(_equals(c, x.text))
        for name, col in same:
            df = df.where(out[name] == col)
        return df.select(*(c.alias(k) for k, c in out.items()), *([] if out else [F.lit(1).alias(self.fresh())]))

    def pattern(self, s, p, o) -> DataFrame:
        if isinstance(p, Var) or p.op == "iri":
            return self.match(s, p, o)
        a, b = self.fresh(), self.fresh()
        ends = [x.text if isinstance(x, Const) else None for x in (s, o)]
        pairs = self.pairs(p, *ends).toDF(a, b)
        for text, y in zip(ends, (a, b), strict=True):
            if text is not None:
                pairs = pairs.where(F.col(y) == text)
        if isinstance(s, Var) and s == o:
            return pairs.where(F.col(a) == F.col(b)).select(F.col(a).alias(s.name)).distinct()
        cols = [F.col(y).alias(x.name) for x, y in ((s, a), (o, b)) if isinstance(x, Var)]
        return pairs.select(*cols) if cols else pairs.select(F.lit(1).alias(self.fresh()))

    def pairs(self, p: Path, start: str | None = None, end: str | None = None) -> DataFrame:
        """Start and end of a path, at least all those from ``start`` and to ``end``, if they are given."""
        swapped = lambda d: d.select(F.col("b").alias("a"), F.col("a").alias("b"))
        if p.op == "iri":
            return self.match(Var("a"), p, Var("b"))
        if p.op == "^":
            return swapped(self.pairs(p.parts[0], end, start))
        if p.op == "|":
            return reduce(DataFrame.unionByName, (self.pairs(x, start, end) for x in p.parts))
        if p.op == "!":
            # All other predicates forwards, and all others backwards, as far as either is asked for.
            every = self.triples.select(F.col("p"), node("s", "s_kind").alias("a"), object_term().alias("b"))
            ways = [every.where(~F.col("p").isin(list(names))).select(*(("a", "b") if k == 0 else (F.col("b").alias("a"), F.col("a").alias("b")))) for k, names in enumerate(p.parts) if names is not None]
            return reduce(DataFrame.unionByName, ways)
        if p.op == "/":
            last = len(p.parts) - 1
            steps = [self.pairs(x, start if i == 0 else None, end if i == last else None) for i, x in enumerate(p.parts)]
            return reduce(lambda x, y: x.withColumnRenamed("b", "m").join(y.withColumnRenamed("a", "m"), "m").select("a", "b"), steps)
        one = self.pairs(p.parts[0], *((start, end) if p.op == "?" else (None, None))).select("a", "b").distinct()
        if p.op != "?":
            at = self.constant(start if start is not None else end) if start is not None or end is not None else None
            # From a given start, or from a given end against the arrows.
            one = closure(one, at) if start is not None or end is None else swapped(closure(swapped(one), at))
        if p.op == "+":
            return one
        # No step at all joins a given term with itself, be it in the graph or not, else each term of the graph.
        ends = self.constant(start if start is not None else end) if start is not None or end is not None else self.triples.select(node("s", "s_kind").alias("a")).union(self.triples.select(object_term().alias("a"))).distinct()
        return one.unionByName(ends.select("a", F.col("a").alias("b"))).distinct()

    def constant(self, text: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(text).alias("a"))

    # joins

    def join(self, a: Table | None, b: Table, how: str = "inner", on: Column | None = None, minus: bool = False) -> Table:
        """Join of compatible solutions: shared variables are equal wherever both are bound."""
        if a is None:
            return b
        shared = [c for c in a.columns if c in b.columns]
        loose = [c for c in shared if c in a.maybe | b.maybe]
        both = frozenset(c for c in a.maybe if c not in b.columns or c in b.maybe) | frozenset(c for c in b.maybe if c not in a.columns or c in a.maybe)
        maybe = both if how == "inner" else a.maybe | (frozenset(b.columns) - frozenset(a.columns)) if how == "left" else a.maybe
        if not shared:
            if minus:
                return a
            return Table(a.df.crossJoin(b.df) if how == "inner" and on is None else a.df.join(b.df, on if on is not None else F.lit(True), how), maybe)
        if not loose and on is None:
            return Table(a.df.join(b.df, shared, {"left": "left", "inner": "inner"}.get(how, how)), maybe)
        return Table(self._compatible(a, b, shared, loose, how, on, minus), maybe)

    def _compatible(self, a: Table, b: Table, shared: list[str], loose: list[str], how: str, on: Column | None, minus: bool) -> DataFrame:
        """Rows meet by the variables that are bound on both sides.

        A row's mask says which of the loose variables it binds. Each side comes once for
        each mask that the other may have, with the values that both masks bind as keys, so
        two rows meet in one place at most and all conditions are equalities.
        """
        bit = {c: 1 << i for i, c in enumerate(loose)}
        masks = lambda t: [m for m in range(1 << len(loose)) if all(m & bit[c] or c in t.maybe for c in loose)]
        mask = lambda t: reduce(lambda x, y: x + y, (F.when(F.col(c).isNotNull(), bit[c]).otherwise(0) if c in t.maybe else F.lit(bit[c]) for c in loose), F.lit(0))
        n = len(shared)

        def side(t: Table, df: DataFrame, others: list[int], own_first: bool, rename: dict[str, str]) -> tuple[DataFrame, list[str]]:
            own, other = self.fresh(), self.fresh()
            df = df.select("*", mask(t).alias(own))
            df = df.withColumn(other, F.explode(F.array(*map(F.lit, others))) if len(others) > 1 else F.lit(others[0]))
            met = F.col(own).bitwiseAND(F.col(other))
            if minus and n == len(loose) and not own_first:
                # Solutions that have no bound variable in common take nothing away.
                df = df.where(met != 0)
            keys = [self.fresh() for _ in shared]
            values = [F.when(met.bitwiseAND(F.lit(bit[c])) != 0, F.col(c)).otherwise("") if c in bit else F.col(c) for c in shared]
            df = df.select(*(F.col(c).alias(rename.get(c, c)) for c in t.columns), own, other, *(v.alias(k) for k, v in zip(keys, values, strict=True)))
            return df, [*keys, own, other] if own_first else [*keys, other, own]

        names = {c: self.fresh() for c in shared}

        def met(left: DataFrame, right: DataFrame, right_masks: list[int], kind: str) -> DataFrame:
            x, kx = side(a, left, right_masks, True, {})
            y, ky = side(b, right, masks(a), False, names)
            cond = all_of([F.col(i) == F.col(j) for i, j in zip(kx, ky, strict=True)])
            j = x.join(y, cond if on is None else cond & on, kind)
            if kind == "left_anti":
                return j.select(*a.columns)
            return j.select(*(F.coalesce(F.col(c), F.col(names[c])).alias(c) if c in names else F.col(c) for c in a.columns), *(c for c in b.columns if c not in names))

        every = masks(b)
        if how == "inner" or len(every) == 1:
            return met(a.df, b.df, every, how)
        # Not met by any mask of the other side: one after the other.
        rest = reduce(lambda d, m: met(d, b.df.where(mask(b) == m), [m], "left_anti"), every, a.df)
        if how == "left_anti":
            return rest
        return met(a.df, b.df, every, "inner").unionByName(rest, allowMissingColumns=True)

    def connected(self, patterns: list) -> list[list]:
        """Patterns in groups that share variables."""
        groups: list[tuple[set, list]] = []
        for t in patterns:
            own = {x.name for x in (t[0], t[2], t[1]) if isinstance(x, Var)}
            near = [g for g in groups if g[0] & own]
            groups = [g for g in groups if not g[0] & own] + [(own.union(*(g[0] for g in near)), [x for g in near for x in g[1]] + [t])]
        return [g[1] for g in groups]

    def bgp(self, patterns: list) -> Table:
        """Joins of patterns, those with most constants or fewest triples first, and then what shares variables with them."""
        left, out, bound = list(patterns), None, set()
        weight = lambda t: sum(not isinstance(x, Var) for x in t)
        variables = lambda t: {x.name for x in (t[0], t[1], t[2]) if isinstance(x, Var)}
        size = lambda t: self.counts.get(t[1].parts[0], 0) if isinstance(t[1], Path) and t[1].op == "iri" else max(self.counts.values(), default=0)
        while left:
            best = max(left, key=lambda t: (bool(variables(t) & bound) or not bound, isinstance(t[0], Const) or isinstance(t[2], Const), weight(t), -size(t)))
            left.remove(best)
            out = self.join(out, Table(self.pattern(*best)))
            bound |= variables(best)
        return out

    # groups

    def group(self, g: Group, start: Table | None = None) -> Table:
        """Solutions of a group; with ``start`` those compatible with its rows, whose variables filters see."""
        out = start
        filters, patterns = [], []

        def flush() -> None:
            nonlocal out, patterns
            if patterns:
                out = self.join(out, self.bgp(patterns))
                patterns = []

        for part in g.parts:
            if part[0] == "triple":
                patterns.append(part[1:])
                continue
            if part[0] == "filter":
                filters.append(part[1])
                continue
            flush()
            if part[0] == "optional":
                before = self.empty() if out is None else out
                own = [x[1] for x in part[1].parts if x[0] == "filter"]
                inner = self.group(Group([x for x in part[1].parts if x[0] != "filter"]))
                # A filter of an optional part sees both sides; it is part of the join's condition.
                on = None
                if own:
                    hidden = {c: self.fresh() for c in inner.columns if c not in before.columns}
                    scope = {c: F.col(c) for c in before.columns} | {c: F.col(k) for c, k in hidden.items()}
                    on = all_of([self.eval(f, scope).truth() for f in own])
                    inner = Table(inner.df.select(*(F.col(c).alias(hidden.get(c, c)) for c in inner.columns)), frozenset(hidden.get(c, c) for c in inner.maybe))
                    if not set(inner.columns) & set(before.columns):
                        out = Table(before.df.join(inner.df, on, "left"), before.maybe | frozenset(inner.columns))
                    else:
                        out = self.join(before, inner, "left", on)
                    back = {k: c for c, k in hidden.items()}
                    out = Table(out.df.select(*(F.col(c).alias(back.get(c, c)) for c in out.columns)), frozenset(back.get(c, c) for c in out.maybe))
                else:
                    out = self.join(before, inner, "left")
            elif part[0] == "minus":
                if out is not None:
                    other = self.group(part[1])
                    named = [c for c in other.columns if c in out.columns]
                    if named:
                        out = self.join(out, Table(other.df.select(*named).distinct(), other.maybe & frozenset(named)), "left_anti", minus=True)
            elif part[0] == "union":
                arms = [self.group(a, start) for a in part[1]]
                every = set.intersection(*(set(a.columns) for a in arms))
                u = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (a.df for a in arms))
                out = self.join(out, Table(u, frozenset(set(u.columns) - every).union(*(a.maybe for a in arms))))
            elif part[0] == "bind":
                base, e = self.lift(self.empty() if out is None else out, part[2])
                column = self.eval(e, {c: F.col(c) for c in base.columns}).term()
                sure = isinstance(e, Const) or (isinstance(e, Var) and e.name in base.columns and e.name not in base.maybe) or (isinstance(e, tuple) and e[0] == "call" and e[1] in ("BOUND", "ISIRI", "ISLITERAL", "ISBLANK"))
                out = Table(base.df.withColumn(part[1], column), base.maybe if sure else base.maybe | {part[1]})
            elif part[0] == "values":
                rows = self.spark.createDataFrame(part[2], ", ".join(f"{n} string" for n in part[1]))
                out = self.join(out, Table(rows, frozenset(n for i, n in enumerate(part[1]) if any(r[i] is None for r in part[2]))))
            elif part[0] == "select":
                out = self.join(out, self.sub(part[1]))
        flush()
        out = self.empty() if out is None else out
        for f in filters:
            out = self.filter(out, f)
        return out

    def sub(self, q: Query) -> Table:
        """Solutions of a SELECT inside a group."""
        inner = Builder(self.triples, self.counts, self.numbers)
        terms, _, _, maybe = inner.select(q)
        return Table(terms, maybe)

    def empty(self) -> Table:
        return Table(self.spark.range(1).select(F.lit(1).alias(self.fresh())))

    # filters

    def filter(self, t: Table, f) -> Table:
        if isinstance(f, tuple) and f[0] == "and":
            return self.filter(self.filter(t, f[1]), f[2])
        if isinstance(f, tuple) and f[0] in ("exists", "not_exists"):
            keys, found = self.found(t, f[1])
            how = "left_semi" if f[0] == "exists" else "left_anti"
            cond = all_of([k == F.col(c) for k, c in zip(keys, found.columns, strict=True)]) if keys else F.lit(True)
            return Table(t.df.join(found, cond, how), t.maybe)
        t, f = self.lift(t, f)
        return Table(t.df.where(self.eval(f, {c: F.col(c) for c in t.columns}).truth()), t.maybe)

    def found(self, t: Table, g: Group) -> tuple[list[Column], DataFrame]:
        """Keys of ``t`` for which the group has a solution: columns over ``t``, and the table of those found, once each.

        Where an expression inside names variables of ``t``, or some may be unbound, the
        distinct values of all that the group names go into it, and what comes out of it
        says for which of them there is a solution.
        """
        named = [c for c in t.columns if c in _variables(g)]
        plain_group = not (_loose_names(g) & set(named)) and not set(named) & t.maybe
        if plain_group:
            other = self.group(g)
            shared = [c for c in named if c in other.columns]
            if not shared:
                return [], other.df.limit(1).select(F.lit(1).alias(self.fresh()))
            if not set(shared) & other.maybe:
                return [F.col(c) for c in shared], other.df.select(*(F.col(c).alias(self.fresh()) for c in shared)).distinct()
        if not named:
            return [], self.group(g).df.limit(1).select(F.lit(1).alias(self.fresh()))
        # No term is empty, so that stands for what is unbound.
        key, own = F.array(*(F.coalesce(F.col(c), F.lit("")) for c in named)), self.fresh()
        seeds = Table(t.df.select(*named, key.alias(own)).distinct(), t.maybe & frozenset(named))
        return [key], self.group(g, seeds).df.select(F.col(own).alias(self.fresh())).distinct()

    def lift(self, t: Table, e) -> tuple[Table, object]:
        """With a column for each EXISTS in an expression, which takes its place."""
        if not isinstance(e, tuple):
            return t, e
        if e[0] in ("exists", "not_exists"):
            keys, found = self.found(t, e[1])
            flag = self.fresh()
            if keys:
                cond = all_of([k == F.col(c) for k, c in zip(keys, found.columns, strict=True)])
                df = t.df.join(found.withColumn(flag, F.lit(True)), cond, "left").select(*t.columns, F.coalesce(flag, F.lit(False)).alias(flag))
            else:
                df = t.df.crossJoin(found.agg((F.count(F.lit(1)) > 0).alias(flag)))
            return Table(df, t.maybe), ("column", flag) if e[0] == "exists" else ("not", ("column", flag))
        out = []
        for x in e:
            if isinstance(x, tuple):
                t, x = self.lift(t, x)  # noqa: PLW2901
            out.append(x)
        return t, tuple(out)

    # expressions

    def eval(self, e, scope: dict[str, Column]) -> Value:
        if isinstance(e, Var):
            return Value(scope.get(e.name, F.lit(None).cast("string")), self.kinds.get(e.name, "term"))
        if isinstance(e, Const):
            return Value(F.lit(e.text), "term", e.text)
        op = e[0]
        if op == "column":
            return Value(F.col(e[1]), "bool")
        if op in ("or", "and"):
            a, b = (self.eval(x, scope).truth() for x in e[1:3])
            return Value(a | b if op == "or" else a & b, "bool")
        if op == "not":
            return Value(~self.eval(e[1], scope).truth(), "bool")
        if op == "false":
            return Value(F.lit(False), "bool")
        if op == "negative":
            return Value(each(self.eval(e[1], scope).number(), lambda c: -c), "number")
        if op in COMPARE:
            return Value(compare(op, self.eval(e[1], scope), self.eval(e[2], scope)), "bool")
        if op in ("+", "-", "*", "/"):
            return Value(arithmetic(op, *(self.eval(x, scope).number() for x in e[1:3])), "number")
        if op == "call":
            return self.call(e[1], e[2], scope)
        raise SparqlSyntaxError(f"{op} can't stand here")

    def call(self, name: str, args: tuple, scope: dict[str, Column]) -> Value:
        if name == "BOUND":
            return Value(self.eval(args[0], scope).column.isNotNull(), "bool")
        v = [self.eval(a, scope) for a in args]
        t = [x.text for x in v]
        flags = {"i": "(?i)", "s": "(?s)", "m": "(?m)", "x": "(?x)"}

        def pattern() -> Column:
            mode = "".join(flags.get(c, "") for c in args[2 if name == "REGEX" else 3].text.strip('"')) if len(args) > (2 if name == "REGEX" else 3) else ""
            return F.concat(F.lit(mode), t[1]())

        def part(regex: str, group: int = 1) -> Column:
            return integer(F.regexp_extract(t[0](), regex, group).try_cast("int"))

        def encoded() -> Column:
            # Bytes other than unreserved ASCII characters as %XX, by way of a form's encoding.
            return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), (("+", "%20"), ("*", "%2A"), ("%7E", "~")), F.url_encode(t[0]()))

        # A logical error of one side isn't one of a whole IF or COALESCE.
        forms = {
            "STR": lambda: (t[0](), "text"),
            "LANG": lambda: (F.regexp_extract(v[0].column, LIT, 3), "text"),
            "DATATYPE": lambda: (F.concat(F.lit("<"), datatype_of(plain(v[0].column) if v[0].kind == "text" else v[0].term()), F.lit(">")), "term"),
            "IRI": lambda: (F.concat(F.lit("<"), t[0](), F.lit(">")), "term"),
            "URI": lambda: (F.concat(F.lit("<"), t[0](), F.lit(">")), "term"),
            "STRDT": lambda: (F.concat(plain(t[0]()), F.lit("^^<"), t[1](), F.lit(">")), "term"),
            "STRLANG": lambda: (F.concat(plain(t[0]()), F.lit("@"), t[1]()), "term"),
            "ISIRI": lambda: (F.startswith(v[0].term(), F.lit("<")), "bool"),
            "ISURI": lambda: (F.startswith(v[0].term(), F.lit("<")), "bool"),
            "ISLITERAL": lambda: (F.startswith(v[0].term(), F.lit('"')), "bool"),
            "ISBLANK": lambda: (F.startswith(v[0].term(), F.lit("_:")), "bool"),
            "ISNUMERIC": lambda: (v[0].number().isNotNull(), "bool"),
            "SAMETERM": lambda: (v[0].term() == v[1].term(), "bool"),
            "REGEX": lambda: (F.regexp(t[0](), pattern()), "bool"),
            "REPLACE": lambda: (F.regexp_replace(t[0](), pattern(), t[2]()), "text"),
            "CONTAINS": lambda: (F.contains(t[0](), t[1]()), "bool"),
            "STRSTARTS": lambda: (F.startswith(t[0](), t[1]()), "bool"),
            "STRENDS": lambda: (F.endswith(t[0](), t[1]()), "bool"),
            "STRBEFORE": lambda: (F.when(F.contains(t[0](), t[1]()), F.substring(t[0](), F.lit(1), F.instr(t[0](), t[1]()) - 1)).otherwise(""), "text"),
            "STRAFTER": lambda: (F.when(F.contains(t[0](), t[1]()), F.substring(t[0](), F.instr(t[0](), t[1]()) + F.length(t[1]()), F.length(t[0]()))).otherwise(""), "text"),
            "STRLEN": lambda: (integer(F.char_length(t[0]())), "number"),
            "SUBSTR": lambda: (F.substring(t[0](), v[1].whole(), v[2].whole() if len(v) > 2 else F.length(t[0]())), "text"),
            "UCASE": lambda: (F.upper(t[0]()), "text"),
            "LCASE": lambda: (F.lower(t[0]()), "text"),
            "CONCAT": lambda: (F.concat(*(x() for x in t)), "text"),
            "ENCODE_FOR_URI": lambda: (encoded(), "text"),
            "MD5": lambda: (F.md5(t[0]().cast("binary")), "text"),
            "SHA1": lambda: (F.sha1(t[0]().cast("binary")), "text"),
            "ABS": lambda: (each(v[0].number(), F.abs), "number"),
            "ROUND": lambda: (rounded(v[0].number()), "number"),
            "CEIL": lambda: (each(v[0].number(), F.ceil), "number"),
            "FLOOR": lambda: (each(v[0].number(), F.floor), "number"),
            "YEAR": lambda: (part(r"^(-?\d{4,})-"), "number"),
            "MONTH": lambda: (part(r"^-?\d{4,}-(\d\d)"), "number"),
            "DAY": lambda: (part(r"^-?\d{4,}-\d\d-(\d\d)"), "number"),
            "HOURS": lambda: (part(r"T(\d\d):"), "number"),
            "MINUTES": lambda: (part(r"T\d\d:(\d\d)"), "number"),
            "SECONDS": lambda: (parsed(F.regexp_extract(t[0](), r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1), F.lit(XSD + "decimal")), "number"),
            "TZ": lambda: (F.regexp_extract(t[0](), ZONE, 1), "text"),
            "IF": lambda: (F.when(v[0].truth(), v[1].term()).when(~v[0].truth(), v[2].term()), "term"),
            "COALESCE": lambda: (F.coalesce(*(x.term() for x in v)), "term"),
            "LANGMATCHES": lambda: (F.when(t[1]() == "*", t[0]() != "").otherwise((F.lower(t[0]()) == F.lower(t[1]())) | F.startswith(F.lower(t[0]()), F.concat(F.lower(t[1]()), F.lit("-")))), "bool"),
        }
        forms |= {f"SHA{n}": lambda n=n: (F.sha2(t[0]().cast("binary"), n), "text") for n in (256, 384, 512)}
        if name in forms:
            return Value(*forms[name]())
        if name.startswith(XSD):
            kind = name[len(XSD) :]
            if kind in ("string",):
                return Value(t[0](), "text")
            if kind == "boolean":
                return Value(F.when(t[0]().isin("true", "1"), True).when(t[0]().isin("false", "0"), False), "bool")
            if name in INTEGERS:
                # Numbers are cut towards zero.
                x = F.coalesce(v[0].number()["x"], t[0]().try_cast(DEC))
                return Value(integer(F.coalesce(v[0].number()["i"], F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)))), "number")
            if name in NUMERIC:
                return Value(parsed(t[0](), F.lit(name)), "number")
            return Value(F.concat(F.lit('"'), t[0](), F.lit(f'"^^<{name}>')), "term")
        raise SparqlSyntaxError(f"there is no function {name}")

    # queries

    def aggregate(self, e, scope: dict[str, Column]) -> Value:
        """An expression over groups; aggregates in it become aggregate columns."""
        if isinstance(e, tuple) and e[0] == "call" and e[1] in AGGREGATES:
            _, name, args, distinct, separator = e
            if name == "COUNT" and args[0] == "*":
                cols = [c for k, c in scope.items() if k.startswith("v")]
                return Value(F.count_distinct(F.struct(*cols)) if distinct and cols else F.count(F.lit(1)), "count")
            v = self.eval(args[0], scope)
            if name == "COUNT":
                return Value(F.count_distinct(v.term()) if distinct else F.count(v.column), "count")
            if name in ("SUM", "AVG"):
                return Value((total if name == "SUM" else mean)(v.column, v.number(), distinct), "number")
            if name in ("MIN", "MAX"):
                return Value(least_or_most(v, F.min_by if name == "MIN" else F.max_by), "term")
            if name == "SAMPLE":
                return Value(F.min(v.term()), "term")
            items = F.collect_set(v.text()) if distinct else F.collect_list(v.text())
            return Value(F.array_join(F.array_sort(items), separator), "text")
        if isinstance(e, tuple) and _has_aggregate(e):
            parts = [self.aggregate(x, scope) if isinstance(x, (tuple, Var, Const)) else x for x in (e[2] if e[0] == "call" else e[1:])]
            names = {self.fresh(): p for p in parts}
            keep = dict(self.kinds)
            self.kinds = keep | {n: p.kind for n, p in names.items()}
            own = tuple(map(Var, names))
            out = self.eval((*e[:2], own, *e[3:]) if e[0] == "call" else (e[0], *own), {n: p.column for n, p in names.items()})
            self.kinds = keep
            return out
        return self.eval(e, scope)

    def select(self, q: Query) -> tuple[DataFrame, DataFrame, dict[str, str], frozenset]:
        """Solutions of a SELECT: as terms, as they are, each column's kind, and what may be unbound."""
        t = self.group(q.where)
        visible = [c for c in t.columns if c.startswith("v")]
        select = [(c, Var(c)) for c in visible] if q.select == ["*"] else q.select
        kinds: dict[str, str] = {}
        if q.group or any(_has_aggregate(e) for _, e in select) or q.having:
            df = t.df
            base = df.select("*", *(self.eval(e, {c: F.col(c) for c in df.columns}).term().alias(n) for n, e in q.group if not (isinstance(e, Var) and e.name == n and n in df.columns)))
            keys = [n for n, _ in q.group]
            scope = {c: F.col(c) for c in base.columns}
            cols, outs = [], []
            for n, e in select:
                v = self.aggregate(e, scope)
                if isinstance(e, Var) and e.name in keys:
                    outs.append((n, F.col(e.name), "term"))
                elif not _has_aggregate(e):
                    own_value = self.eval(e, {k: F.col(k) for k in keys})
                    outs.append((n, own_value.column, own_value.kind))
                else:
                    own = self.fresh()
                    cols.append(v.column.alias(own))
                    outs.append((n, F.col(own), v.kind))
            having = []
            for h in q.having:
                own = self.fresh()
                cols.append(self.aggregate(h, scope).truth().alias(own))
                having.append(own)
            orders = []
            for e, down in q.order:
                if _has_aggregate(e):
                    own = self.fresh()
                    v = self.aggregate(e, scope)
                    cols.append(v.column.alias(own))
                    orders.append((own, v.kind, down))
                else:
                    orders.append((e, None, down))
            grouped = base.groupBy(*keys).agg(*(cols or [F.count(F.lit(1)).alias(self.fresh())]))
            for h in having:
                grouped = grouped.where(F.col(h))
            df = grouped.select("*", *(c.alias(n) for n, c, _ in outs if n not in grouped.columns))
            kinds = {n: k for n, _, k in outs}
            maybe = frozenset(n for n, e in select if not (isinstance(e, Var) and e.name in t.columns and e.name not in t.maybe) and kinds[n] != "count")
        else:
            orders = [(e, None, down) for e, down in q.order]
            maybe = set(t.maybe)
            for n, e in select:
                if not (isinstance(e, Var) and e.name == n):
                    t, e = self.lift(t, e)  # noqa: PLW2901
                    v = self.eval(e, {c: F.col(c) for c in t.columns})
                    t = Table(t.df.withColumn(n, v.column), t.maybe | {n})
                    maybe.add(n)
                    kinds[n] = v.kind
                    self.kinds[n] = v.kind
                elif n not in t.columns:
                    t = Table(t.df.withColumn(n, F.lit(None).cast("string")), t.maybe)
                    maybe.add(n)
            df, maybe = t.df, frozenset(maybe)
        names = [n for n, _ in select]
        sort = []
        for e, kind, down in orders:
            if isinstance(e, str):
                v = Value(F.col(e), kind)
            else:
                keep = dict(self.kinds)
                self.kinds = keep | kinds
                v = self.eval(e, {c: F.col(c) for c in df.columns})
                self.kinds = keep
            for c in v.keys():
                sort.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        if q.distinct:
            df = df.select(*names, *(c for c in df.columns if c not in names and any(isinstance(e, str) and e == c for e, _, _ in orders))).dropDuplicates(names)
        if sort or q.limit is not None or q.offset:
            ties = [F.col(n).asc_nulls_first() for n in names]
            df = df.orderBy(*sort, *ties)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        terms = df.select(*(F.col(n) if kinds.get(n, "term") == "term" else Value(F.col(n), kinds[n]).term().alias(n) for n in names))
        return terms, df.select(*names), kinds, maybe & frozenset(names)

    # graphs

    def construct(self, q: Query) -> DataFrame:
        """Triples of a template, once each. A blank node of the template is one for each solution."""
        t = self.group(q.where)
        cols = sorted(c for c in t.columns if c.startswith("v"))
        t = Table(t.df.select(*cols).distinct() if cols else t.df.limit(1), t.maybe)
        own = F.md5(F.concat_ws("\x01", *(F.coalesce(F.col(c), F.lit("")) for c in cols)).cast("binary"))

        def term(x) -> Column:
            if isinstance(x, Path):
                return F.lit(f"<{x.parts[0]}>")
            if isinstance(x, Const):
                return F.lit(x.text)
            if not x.name.startswith("v"):
                return F.concat(F.lit("_:c"), own, F.lit(x.name))
            return F.col(x.name) if x.name in t.columns else F.lit(None).cast("string")

        rows = []
        for x in q.template:
            if isinstance(x[1], Path) and x[1].op != "iri":
                raise SparqlSyntaxError("a template has no paths")
            s, p, o = map(term, x)
            rows.append(F.struct(s.alias("s"), p.alias("p"), o.alias("o")))
        if not rows:
            raise SparqlSyntaxError("the template is empty")
        return as_triples(t.df.select(F.inline(F.array(*rows))))

    def describe(self, q: Query) -> DataFrame:
        """All triples of the resources, and of the blank nodes that these lead to."""
        resources = [self.constant(x.text) for x in q.select if isinstance(x, Const)]
        if q.where.parts:
            t = self.group(q.where)
            asked = [x.name for x in q.select if isinstance(x, Var)] or ([] if q.select else [c for c in t.columns if c.startswith("v")])
            resources += [t.df.select(F.col(c).alias("a")).where(F.col(c).isNotNull()) for c in asked if c in t.columns]
        if not resources:
            raise SparqlSyntaxError("DESCRIBE names nothing")
        named = self.triples.select("*", node("s", "s_kind").alias("a"))
        todo, seen = staged(reduce(DataFrame.union, resources).distinct()), []
        while not todo.isEmpty():
            seen.append(todo)
            done = reduce(DataFrame.union, seen)
            more = named.join(todo, "a", "left_semi").where("o_kind = 'bnode'").select(F.concat(F.lit("_:"), "o").alias("a")).distinct()
            todo = staged(more.join(done, "a", "left_anti"))
        found = reduce(DataFrame.union, seen) if seen else todo
        return named.join(found, "a", "left_semi").select(*COLUMNS).distinct()


def as_triples(terms: DataFrame) -> DataFrame:
    """Rows of terms s, p, o as triples, without those that RDF doesn't have."""
    kind = lambda c: F.when(F.startswith(F.col(c), F.lit("<")), "iri").when(F.startswith(F.col(c), F.lit("_:")), "bnode").otherwise("lit")
    value = lambda c: F.when(F.startswith(F.col(c), F.lit("_:")), F.substring(F.col(c), F.lit(3), F.length(c))).otherwise(value_of(F.col(c)))
    d, lang = F.regexp_extract("o", LIT, 2), F.regexp_extract("o", LIT, 3)
    literal_only = lambda c: F.when((kind("o") == "lit") & (c != ""), c)
    right = terms.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()).where((kind("s") != "lit") & (kind("p") == "iri"))
    return right.select(value("s").alias("s"), kind("s").alias("s_kind"), value("p").alias("p"), value("o").alias("o"), kind("o").alias("o_kind"), literal_only(d).alias("o_datatype"), literal_only(lang).alias("o_lang")).distinct()


def _has_aggregate(e) -> bool:
    return isinstance(e, tuple) and ((e[0] == "call" and e[1] in AGGREGATES) or any(_has_aggregate(x) for x in (e[2] if e[0] == "call" else e[1:]) if isinstance(x, tuple)))


def _equals(c: str, term: str) -> Column:
    """A filter on the triple table's columns for a constant term."""
    if term.startswith("<"):
        f = F.col(c) == term[1:-1]
        return f if c == "p" else f & (F.col(f"{c}_kind") == "iri")
    m = re.match(LIT, term)
    f = (F.col("o") == m[1]) & (F.col("o_kind") == "lit")
    f = f & (F.col("o_datatype") == m[2] if m[2] else F.col("o_datatype").isNull())
    return f & (F.col("o_lang") == m[3] if m[3] else F.col("o_lang").isNull()) if c == "o" else F.lit(False)


def run(query: str | Query, triples: DataFrame, prefixes: dict[str, str] | None = None, unknown_prefix: str | None = None, exact: bool = False, counts: dict[str, int] | None = None) -> DataFrame:
    """Result table. ASK: one row with ``ask``. CONSTRUCT and DESCRIBE: triples.

    SELECT: a column for each variable, terms by their lexical form, counts as long, other
    computed numbers as double, or with ``exact`` by their lexical form too.
    """
    q = parse(query, prefixes, unknown_prefix) if isinstance(query, str) else query
    b = Builder(triples, counts)
    if q.form == "CONSTRUCT":
        return b.construct(q)
    if q.form == "DESCRIBE":
        return b.describe(q)
    if q.form == "ASK":
        parts = b.connected([x[1:] for x in q.where.parts]) if q.where.parts and all(x[0] == "triple" for x in q.where.parts) else []
        # Patterns that share no variable are asked for on their own: one solution of each will do.
        some = [b.bgp(p).df.limit(1).select(F.lit(1).alias("one")) for p in parts] or [b.group(q.where).df.limit(1).select(F.lit(1).alias("one"))]
        return reduce(DataFrame.unionByName, some).agg((F.count(F.lit(1)) == len(some)).alias("ask"))
    _, raw, kinds, _ = b.select(q)
    number = lambda n: lexical(F.col(n)) if exact else F.col(n)["f"]
    shown = {"term": lambda n: value_of(F.col(n)), "number": number}
    return raw.select(*(shown.get(kinds.get(n, "term"), F.col)(n).alias(n) for n in raw.columns)).toDF(*map(name_of, raw.columns))


def ask(query: str, triples: DataFrame, prefixes: dict[str, str] | None = None, unknown_prefix: str | None = None) -> bool | None:
    """True or false; None for a query that can't be read or planned, or that has no such answer."""
    try:
        q = parse(query, prefixes, unknown_prefix)
        return bool(run(q, triples).first()[0]) if q.form in ("ASK", "SELECT") else None
    except (SparqlSyntaxError, AnalysisException):
        return None
