"""BPE encoding and decoding by a token automaton.

The automaton reads tokens; it accepts exactly the token sequences that BPE makes. It
starts as one state that accepts everything. Each merge ``(u, v) -> w``, in order of
rank, adds a gadget:

* the state that ``u`` leads to is split from what it was shared with and loses its
  arc ``v`` (``u v`` would have been merged);
* every state with a path ``u v`` gets an arc ``w`` to where that path led; if ``u`` is
  ``v``, the state that has just lost its arc isn't one of them, so pairs are taken from
  the left.

Every arc of a token leads to the same state, so states are named by tokens. State
``w`` begins as the state of ``v`` at that moment, before the cut: it is kept as a
reference to ``v`` and the rank until which cuts of ``v`` hold for it too. So the tables
are small: for each token its two parts, its rank and whether its arc exists at all;
for each merge one cut. Whether a state has an arc follows from them by table look-ups
and is remembered.

A text's path is unique and each prefix of it is the path of that prefix, so over bytes
the automaton is made deterministic: a state says which token the path so far ends with,
at this byte and at each earlier one that a token can still begin after. Its transition
table is compiled from the tree of labels, entry by entry as words ask for them, and
encoding a word is one look-up a byte. The arcs' labels are the tokens' bytes; decoding
emits them.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.runtime import lean, plain_objects, ship, table

#: The byte-level pre-split; alternatives that begin with different characters may stand in any order.
SPLIT = regex.compile(r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _latin() -> re.Pattern:
    """The same for texts of characters below U+0250, with the classes spelled out."""
    kind = lambda k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k)
    l, n, s = kind("L"), kind("N"), r"\t-\r \x85\xa0"
    return re.compile(rf" ?[{l}]+| ?[{n}]+|'(?:[stmd]|re|ve|ll)| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+")


LATIN, BEYOND = _latin(), re.compile("[^\\0-\u024f]")
_agreed: set[str] = set()
_other: set[str] = set()


def split(text: str) -> list[str]:
    """Words of a text. Characters that ``regex`` and the tokenizers library class differently (their Unicode versions differ) are left to the library."""
    try:
        text.encode("latin-1")
        return LATIN.findall(text)
    except UnicodeEncodeError:
        if not BEYOND.search(text):
            return LATIN.findall(text)
    if new := {c for c in text if c > "\u024f"} - _agreed:
        from tokenizers.pre_tokenizers import ByteLevel

        own = ByteLevel(add_prefix_space=False)
        cut = lambda s: [s[i:j] for _, (i, j) in own.pre_tokenize_str(s)]
        for c in new - _other:
            (_agreed if SPLIT.findall(probe := f"a{c}b 1{c}!") == cut(probe) else _other).add(c)
        if new & _other:
            return cut(text)
    return SPLIT.findall(text)


#: Bytes of words and their ids that a worker remembers before they are the old ones, of which those in use come back.
REMEMBERED = 64 << 20
#: Longer words aren't remembered.
LONG = 200
#: Bytes of texts that are cut into words together.
TOGETHER = 8 << 20
#: The same two where the automaton encodes, whose byte table takes memory besides.
OWN_REMEMBERED, OWN_TOGETHER = 24 << 20, 2 << 20
_WHITE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: A space after which the pre-split can go on with white space that began before it.
RUN = f"{_WHITE} (?:{_WHITE}|$)"
#: What stands for a comma or full stop that is a word of its own. Texts that hold these characters themselves aren't cut at spaces.
MARKS = {"\1": ",", "\2": "."}
MARK = "[\\x01\\x02]"
#: A comma or full stop before a space that isn't a word of its own.
ODD = "[^0-9A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}][.,] |^[.,] "


class Words:
    """What encoding gave for words met before, by the words without their leading space.

    Texts are cut at their spaces: but for runs of white space over a space, the pre-split
    never reaches over one. What stands between two spaces is mostly one word; what isn't
    is pre-split each time. Distinct words of some megabytes of text are looked up once, and
    those not met before are encoded together: ``run`` takes words of letters without
    their leading spaces, ``each`` any words as they are.
    """

    def __init__(self, run: Callable[[list[str]], list[bytes]], each: Callable[[list[str]], list[bytes]], size: int = REMEMBERED):
        self.run, self.each, self.size, self.held = run, each, size, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _learn(self, letters: list[str], others: list[str]) -> dict[str, bytes]:
        """Words that follow a space, of letters and others, that aren't among the young."""
        old = self.old
        got = {w: old[w] for w in (*letters, *others) if w in old}
        new = [w for w in letters if w not in got] if got else letters
        got.update(zip(new, self.run(new) if new else (), strict=True))
        if rest := [w for w in others if w not in got]:
            got.update(zip(rest, self.each([" " + w for w in rest]), strict=True))
        keep = got if max(map(len, got), default=0) <= LONG else {w: b for w, b in got.items() if len(w) <= LONG}
        self.young.update(keep)
        self.held += 160 * len(keep) + sum(map(len, keep)) + sum(map(len, keep.values()))
        return got

    def _ids(self, chunks: list[str], heads: list[list[str]]) -> list[bytes]:
        """Of chunks that follow a space, and of sequences of words."""
        if self.held > self.size:
            self.old, self.young, self.held = self.young, {}, 0
        if not self.marks:
            self.marks = dict(zip(MARKS, self.each([*MARKS.values()]), strict=True))
        young, out = self.young, list(map(self.young.get, chunks))
        # Among the chunks these are marks only; words of a sequence that look the same are words.
        for mark, own in self.marks.items():
            if mark in chunks:
                out[chunks.index(mark)] = own
        letters, parts = [], {}
        one = lambda w: w.isalpha() and (w.isascii() or not BEYOND.search(w))
        for c in [c for c, g in zip(chunks, out, strict=True) if g is None]:
            if one(c):
                letters.append(c)
            else:
                parts[c] = split(" " + c)
        words = {w for p in (*parts.values(), *heads) for w in p}
        new = {w[1:] for w in words if w[0] == " "}.difference(young, letters)
        more = [w for w in new if one(w)]
        extra = self._learn(letters + more, list(new.difference(more)))
        bare = [w for w in words if w[0] != " "]
        of = dict(zip(bare, self.each(bare) if bare else (), strict=True))
        of.update([(w, extra[w[1:]] if w[1:] in extra else young[w[1:]]) for w in words if w[0] == " "])
        extra.update([(c, b"".join(map(of.__getitem__, p))) for c, p in parts.items() if len(p) != 1])
        return [extra[c] if g is None else g for c, g in zip(chunks, out, strict=True)] + [b"".join(map(of.__getitem__, p)) for p in heads]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids one after the other; null is empty."""
        texts = pc.fill_null(texts, "")
        runs = pc.or_(pc.match_substring_regex(texts, RUN), pc.match_substring_regex(texts, MARK))
        odd = pc.or_(runs, pc.match_substring_regex(texts, ODD))
        marked = pc.replace_substring(pc.replace_substring(texts, ", ", " \1 "), ". ", " \2 ")
        lists = pc.split_pattern(pc.if_else(runs, "", pc.if_else(odd, texts, marked)), " ")
        # The first chunk of a text follows no space; a text with runs of white space is one sequence of words.
        at, flat = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py(), lists.flatten()
        heads = [split(t if r else h) for t, r, h in zip(pc.if_else(runs, texts, None).to_pylist(), runs.to_pylist(), flat.take(pa.array(at)).to_pylist(), strict=True)]
        follows = np.ones(len(flat), bool)
        follows[at] = False
        own = flat.filter(pa.array(follows)).dictionary_encode()
        chunks = own.dictionary.to_pylist()
        ids = self._ids(chunks, heads)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        index = np.empty(len(flat), np.int64)
        index[follows] = own.indices.to_numpy()
        index[at] = np.arange(len(chunks), len(ids))
        each = size[index]
        n = np.add.reduceat(each, at) if len(at) else np.zeros(0, np.int64)
        start = np.cumsum(size) - size
        place = np.repeat(start[index] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return n, np.frombuffer(b"".join(ids), "<i4")[place]


def together(texts: pa.Array, size: int = TOGETHER):
    """Starts and lengths of runs of texts of about so many bytes."""
    ends, a = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield a, b - a
        a = b


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: States of the byte table that a worker holds before it begins anew.
STATES = 120_000


class Automaton:
    START = -1

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int] | None = None):
        """labels: bytes of each token; merges: (u, v, w) in order of rank."""
        self.ids = {b: i for i, b in labels.items()}
        self.special = special or {}
        size = max([*labels, *self.special.values()], default=-1) + 1
        self.labels: list[bytes] = [labels.get(i, b"") for i in range(size)]
        for s, i in self.special.items():
            self.labels[i] = s.encode()
        self.numbers = [b"%d," % i for i in range(size)]
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.cut: dict[tuple[int, int], int] = {}
        self.reached = [len(b) == 1 for b in self.labels]
        self.known: dict[tuple[int, int], bool] = {}
        for k, (u, v, w) in enumerate(merges):
            self._gadget(k, u, v, w)
        self.known.clear()
        self.size = list(map(len, self.labels))
        self._compile()
        each = lambda words: [struct.pack(f"<{len(p)}i", *p) for p in map(self.path, map(str.encode, words))]
        self.words = Words(lambda words: each([" " + w for w in words]), each, OWN_REMEMBERED)

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        if not (self.reached[u] and self.reached[v]) or self.rank[w] >= 0:
            raise ValueError(f"merge {k}: a part is made later, or the token is made twice")
        there = self._arc(u, v, k)
        self.cut[u, v] = k
        if there:
            self.left[w], self.right[w], self.rank[w], self.reached[w] = u, v, k, True
        else:
            raise ValueError(f"merge {k} can never apply")

    def _arc(self, state: int, token: int, until: int) -> bool:
        """Whether the state of the token ``state`` has the arc ``token`` once the merges below ``until`` are in."""
        rank = self.rank[token]
        if rank >= until:
            return False
        if rank >= 0 and not self._arc(state, self.left[token], rank + (self.left[token] == self.right[token])):
            return False
        at, bound = state, until
        while at != self.START:
            if self.cut.get((at, token), bound) < bound:
                return False
            bound = min(bound, self.rank[at]) if self.rank[at] >= 0 else bound
            at = self.right[at]
        return True

    def follows(self, state: int, token: int) -> bool:
        if state == self.START:
            return True
        key = (state, token)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            got = self.known[key] = self._arc(state, token, len(self.cut))
        return got

    def _compile(self) -> None:
        """The labels as one tree of bytes: where a byte leads, and where the longest shorter suffix stands."""
        self.goto: dict[int, int] = {}
        self.ends, self.depth, self.fail = [-1], [0], [0]
        for label, token in self.ids.items():
            at = 0
            for b in label:
                to = self.goto.get(at << 8 | b)
                if to is None:
                    to = self.goto[at << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[at] + 1)
                    self.fail.append(0)
                at = to
            self.ends[at] = token
        edges = [[] for _ in range(max(self.depth) + 1)]
        for key, to in self.goto.items():
            edges[self.depth[to]].append((key, to))
        for level in edges[2:]:
            for key, to in level:
                self.fail[to] = self._step(self.fail[key >> 8], key & 255)
        # The next shorter suffix that is a token.
        self.shorter = [-1] * len(self.ends)
        for level in edges[2:]:
            for _, to in level:
                f = self.fail[to]
                self.shorter[to] = f if self.ends[f] >= 0 else self.shorter[f]
        self._restart()

    def _step(self, node: int, byte: int) -> int:
        while True:
            to = self.goto.get(node << 8 | byte)
            if to is not None:
                return to
            if not node:
                raise ValueError(f"no token has the byte {byte}")
            node = self.fail[node]

    def _restart(self) -> None:
        first = (0, (self.START,))
        self.table: dict[int, int] = {}
        self.states, self.at, self.token = {first: 0}, [first], [self.START]

    def _extend(self, state: int, byte: int) -> int:
        """A new entry of the byte table.

        A state is a node of the tree, which is the longest suffix that a token can go on
        from, and the tokens that paths end with at each place within it.
        """
        node, ends = self.at[state]
        node = self._step(node, byte)
        at = node
        while at >= 0:
            t = self.ends[at]
            if t >= 0 and self.follows(ends[-self.depth[at]], t):
                break
            at = self.shorter[at]
        else:
            raise ValueError(f"no path goes on with the byte {byte}")
        key = (node, (*ends, t)[-self.depth[node] - 1 :])
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.at)
            self.at.append(key)
            self.token.append(t)
        self.table[state << 8 | byte] = to
        return to

    def path(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word: a step of the byte table for each byte, and back over the tokens' lengths."""
        if len(self.at) > STATES:
            self._restart()
        state, table, on = 0, self.table.get, []
        for b in word:
            to = table(state << 8 | b)
            state = self._extend(state, b) if to is None else to
            on.append(state)
        out, n, token, size = [], len(word), self.token, self.size
        while n:
            t = token[on[n - 1]]
            out.append(t)
            n -= size[t]
        return out[::-1]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids one after the other; null is empty."""
        if not any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            return self.words.encode(texts)
        # The strings of special tokens are cut out, and stand for themselves.
        mark = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pieces = [mark.split(t or "") for t in texts.to_pylist()]
        n, ids = self.words.encode(pa.array([None if p in self.special else p for ps in pieces for p in ps], pa.string()))
        cuts = np.cumsum(n) - n
        parts = [np.array([self.special[p]], "<i4") if p in self.special else ids[a : a + k] for p, a, k in zip([p for ps in pieces for p in ps], cuts.tolist(), n.tolist(), strict=True)]
        at = np.cumsum([0, *map(len, pieces)])[:-1]
        return np.add.reduceat(np.array(list(map(len, parts))), at) if len(at) else n, np.concatenate([np.zeros(0, "<i4"), *parts])

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[1].tolist()

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs; bytes that are no UTF-8 become U+FFFD. An unknown id raises IndexError."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def byte_level(vocabulary: dict) -> bool:
    """Whether a tokenizer file's words are cut by ``split`` and each goes to its model on its own."""
    own = vocabulary.get("pre_tokenizer") or {}
    return vocabulary["model"].get("type") == "BPE" and own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space") and not vocabulary.get("normalizer")


def read(vocabulary: dict) -> Automaton:
    """From a tokenizer file of the kind BPE with byte-level letters."""
    model, letter = vocabulary["model"], byte_letters()
    if not byte_level(vocabulary) or model.get("ignore_merges"):
        raise ValueError("a byte-level BPE vocabulary without a normalizer is needed")
    label = lambda t: bytes(letter[c] for c in t)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {t["content"]: t["id"] for t in vocabulary.get("added_tokens", [])}
    labels = {i: label(t) for t, i in model["vocab"].items() if t not in special}
    return Automaton(labels, [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs], special)


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        return read(json.load(f))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, texts: bool = True) -> DataFrame:
    """Per document: id, n_tokens, and with ``keep`` ids (array<int>) and, but for ``texts`` false, decoded (string).

    ids_sha256 and decoded_sha256 come with every row; a null text counts as empty and
    has no ids. The path of the vocabulary must be there on every executor. Rows with
    null or repeated ids are rows like any other; further columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep + ", decoded string" * (keep and texts)

    def run(batches):
        automaton = load(path)
        for batch in batches:
            for at, rows in together(batch.column(1), OWN_TOGETHER):
                part = batch.slice(at, rows)
                with plain_objects():
                    n, flat = automaton.encode_all(part.column(1))
                ends = np.cumsum([0, *n])
                a, b, decoded = [], [], []
                for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                    ids = flat[i:j].tolist()
                    back = automaton.decode(ids)
                    a.append(hashlib.sha256(b"".join(map(automaton.numbers.__getitem__, ids))[:-1]).hexdigest())
                    b.append(hashlib.sha256(back.encode()).hexdigest())
                    if keep and texts:
                        decoded.append(back)
                out = [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if keep:
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                if keep and texts:
                    out.append(pa.array(decoded, pa.string()))
                yield pa.record_batch(out, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's query."""
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), keep=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
