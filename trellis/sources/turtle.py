"""A Turtle reader for ontologies and shapes. They are metadata, so it runs on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from trellis.functions.prefixes import RDF, RDF_TYPE, XSD, expand

TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<directive>@prefix\b|@base\b|(?i:prefix|base)(?=\s))|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d*(?:[eE][+-]?\d+)|\d*\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?))|(?P<bnode>_:[\w.-]*\w)|(?P<name>[A-Za-z_][\w-]*(?:\.[\w-]+)*:(?:[\w%:-]|\.(?=[\w%:-])|\\.)*|:(?:[\w%:-]|\.(?=[\w%:-])|\\.)*)
    |(?P<word>a\b|true\b|false\b)|(?P<mark>[.;,()\[\]])""",
    re.X | re.S,
)
#: Escapes of strings.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


@dataclass(frozen=True)
class Term:
    value: str
    kind: str = "iri"
    datatype: str | None = None
    lang: str | None = None


class TurtleError(ValueError):
    pass


def unescape(s: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), s, flags=re.S)


def _tokens(text: str):
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"at {at}: {text[at : at + 30]!r}")
        if m.lastgroup != "space":
            yield m.lastgroup, m[0]
        at = m.end()
    yield "end", ""


class Reader:
    def __init__(self, text: str):
        self.tokens = list(_tokens(text))
        self.at, self.n = 0, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.triples: list[tuple[Term, str, Term]] = []

    def next(self, *want: str) -> tuple[str, str]:
        t = self.tokens[self.at]
        if want and t[1] not in want and t[0] not in want:
            raise TurtleError(f"{want[0]} is missing before {t[1]!r}")
        self.at += 1
        return t

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            return text[1:-1] if "://" in text or not self.base else self.base + text[1:-1]
        head = text.partition(":")[0]
        if head not in self.prefixes and head not in ("rdf", "rdfs", "xsd", "owl"):
            raise TurtleError(f"prefix {head}: isn't declared")
        return expand(text.replace("\\", ""), {"owl": "http://www.w3.org/2002/07/owl#"} | self.prefixes) if head else self.prefixes[""] + text[1:]

    def blank(self) -> Term:
        self.n += 1
        return Term(f"b{self.n}", "bnode")

    def term(self) -> Term:
        kind, text = self.next()
        if kind in ("iri", "name"):
            return Term(self.iri(kind, text))
        if kind == "bnode":
            return Term(text[2:], "bnode")
        if text == "[":
            own = self.blank()
            if self.peek()[1] != "]":
                self.properties(own)
            self.next("]")
            return own
        if text == "(":
            return self.list()
        if kind in ("string", "long"):
            n = 3 if kind == "long" else 1
            value = unescape(text[n:-n])
            if self.peek()[0] == "lang":
                return Term(value, "lit", None, self.next()[1][1:])
            if self.peek()[0] == "type":
                self.next()
                d = self.iri(*self.next("iri", "name"))
                return Term(value, "lit", None if d == XSD + "string" else d)
            return Term(value, "lit")
        if kind == "number":
            return Term(text, "lit", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if text in ("true", "false"):
            return Term(text, "lit", XSD + "boolean")
        raise TurtleError(f"no term: {text!r}")

    def list(self) -> Term:
        items = []
        while self.peek()[1] != ")":
            items.append(self.term())
        self.next(")")
        rest = Term(RDF + "nil")
        for x in reversed(items):
            own = self.blank()
            self.triples += [(own, RDF + "first", x), (own, RDF + "rest", rest)]
            rest = own
        return rest

    def properties(self, s: Term) -> None:
        while True:
            kind, text = self.next()
            p = RDF_TYPE if text == "a" else self.iri(kind, text) if kind in ("iri", "name") else None
            if p is None:
                raise TurtleError(f"no predicate: {text!r}")
            while True:
                self.triples.append((s, p, self.term()))
                if self.peek()[1] != ",":
                    break
                self.next()
            while self.peek()[1] == ";":
                self.next()
            if self.tokens[self.at - 1][1] != ";" or self.peek()[1] in (".", "]", ""):
                return

    def run(self) -> Reader:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "directive":
                self.next()
                if text.lstrip("@").lower() == "prefix":
                    name = self.next("name")[1]
                    self.prefixes[name.rstrip(":")] = self.next("iri")[1][1:-1]
                else:
                    self.base = self.next("iri")[1][1:-1]
                if text[0] == "@":
                    self.next(".")
                continue
            bracket = text == "["
            s = self.term()
            if not (bracket and self.peek()[1] == "."):
                self.properties(s)
            self.next(".")
        return self


def parse_turtle(text: str) -> tuple[list[tuple[Term, str, Term]], dict[str, str]]:
    """Triples and prefixes of a document."""
    r = Reader(text).run()
    return list(dict.fromkeys(r.triples)), r.prefixes


def triples_frame(spark, triples: list[tuple[Term, str, Term]]):
    """The triples as a table of the engine's form."""
    from trellis.functions.terms import TRIPLE

    return spark.createDataFrame([(s.value, s.kind, p, o.value, o.kind, o.datatype, o.lang) for s, p, o in triples], TRIPLE)
