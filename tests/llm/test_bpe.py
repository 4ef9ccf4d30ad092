import hashlib
import random
import subprocess
import sys

import pytest
from tokenizers import Tokenizer

from tests.llm import data
from trellis.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def automaton():
    return bpe.load(bpe.vocabulary_path())


def naive(word, ranks):
    parts = list(word)
    while True:
        best = min((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks) if any(p in ranks for p in zip(parts, parts[1:], strict=False)) else None
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(30))
def test_gadgets_against_merging(seed):
    """Random proper vocabularies over three letters, self-merges included."""
    r = random.Random(seed)
    tokens, merges = ["a", "b", "c"], []
    for _ in range(40):
        word = "".join(r.choice("abc") for _ in range(12))
        parts = naive(word, {m: k for k, m in enumerate(merges)})
        if len(parts) > 1:
            i = r.randrange(len(parts) - 1)
            m = (parts[i], parts[i + 1])
            if m not in merges and m[0] + m[1] not in tokens:
                merges.append(m)
                tokens.append(m[0] + m[1])
    ids = {t: i for i, t in enumerate(tokens)}
    a = bpe.Automaton({i: t.encode() for t, i in ids.items()}, [(ids[u], ids[v], ids[u + v]) for u, v in merges])
    ranks = {m: k for k, m in enumerate(merges)}
    for _ in range(300):
        w = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
        assert [tokens[i] for i in a.path(w.encode())] == naive(w, ranks)


def test_improper_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Automaton({0: b"a", 1: b"b", 2: b"ab", 3: b"aab"}, [(0, 2, 3), (0, 1, 2)])


def test_like_the_library(library, automaton):
    r = random.Random(1)
    texts = [t for _, t in data.texts() if t]
    texts += ["".join(r.choice("  aabb'stredl\n\t 019.,!? é中文́ \x1c\x85ſK²½Ⅷ𝟘😀-_<|endoftext|>") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(r.choice("  ab,. " + "".join(map(chr, range(32)))) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += [t[:4] + "<|endoftext|>" + t[4:] for t in texts[-200:]]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert automaton.encode(t) == ids
        assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character_splits_alike(library):
    for c in [*range(0, 0x3000), *range(0xA000, 0xB000), *range(0x10000, 0x12000), *range(0x1D000, 0x1F000), 0x558, 0x88F, 0x3FC3B]:
        s = f"a{chr(c)}b 1{chr(c)}!"
        assert bpe.split(s) == [s[i:j] for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(s)]


def test_documents(spark, library):
    rows = bpe.encode_documents(data.table(spark), bpe.vocabulary_path()).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in data.texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or ""), tuple(ids), t or ""))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in rows), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(data.table(spark, [], False), bpe.vocabulary_path()).count() == 0


CONTROLS = ["a \x01 b", "hello \x01", "a \x02 b", "a, b. c", "\x01", "\x02 \x01, x", " \x01\x02 ", "x, \x01 , y"]


def control_texts():
    """Texts with all of U+0000 to U+001F between words, commas and full stops, and the same ones without."""
    r = random.Random(3)
    signs = [chr(c) for c in range(32)] + [",", ".", " ", "  ", "a", "word", "é"]
    return CONTROLS + [" ".join(r.choice(signs) for _ in range(r.randint(1, 12))) + r.choice(["", ", ", ". "]) for _ in range(3000)]


def test_control_characters(spark, library, tmp_path):
    """Marks stand for commas and full stops; the characters that they are written with remain themselves."""
    rows = list(enumerate(control_texts()))
    got = {r.doc_id: (tuple(r.ids), r.decoded) for r in bpe.encode_documents(data.table(spark, rows, False), bpe.vocabulary_path()).collect()}
    assert got == {i: (tuple(library.encode(t, add_special_tokens=False).ids), t) for i, t in rows}


def test_the_query(spark, library, tmp_path):
    rows = [*data.texts(), *((1000 + i, t) for i, t in enumerate(CONTROLS))]
    data.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op4_bpe(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_memory_of_a_worker():
    """6 MB of words that are all new, as a worker encodes them: what is held beside the loaded vocabulary has a bound."""
    code = """
import random, re
import pyarrow as pa
from trellis.llm import bpe
high = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
a, r = bpe.load(bpe.vocabulary_path()), random.Random(3)
texts = pa.array([" ".join("".join(r.choices("abcdefghilmnoprstu", k=8)) for _ in range(600)) for _ in range(1100)])
before = high()
for at, n in bpe.together(texts, *[getattr(bpe, "OWN_TOGETHER", bpe.TOGETHER)]):
    with bpe.plain_objects():
        a.encode_all(texts.slice(at, n))
print(high() - before)
"""
    mb = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert mb < 380, mb
