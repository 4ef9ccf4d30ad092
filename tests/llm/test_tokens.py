import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm import data
from tests.llm.test_bpe import control_texts
from trellis.llm import bpe
from trellis.llm import tokens as T
from trellis.llm.runtime import new_folder


@pytest.mark.parametrize("n", [1, 2, 7, 4095, 4096])
@pytest.mark.parametrize("most", [0, 1, 300, 50_256, 65_535, 2**20, 2**32 - 1])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_blocks(n, most, share):
    r = np.random.default_rng(n + most)
    ids = (r.integers(0, most + 1, n, dtype=np.uint64) >> r.integers(0, 20, n).astype(np.uint64)).astype(np.uint32)
    assert (T.decode_block(T.encode_block(ids, share)) == ids).all()


def test_files_read_from_anywhere():
    r = np.random.default_rng(0)
    lengths = [0, 1, 5000, 3, 9000, 0, 20]
    ids = r.integers(0, 50_000, sum(lengths), dtype=np.uint32)
    f = io.BytesIO()
    w = T.Writer(f)
    at = 0
    for k, n in enumerate(lengths):
        w.add(pa.array([k]), [n], ids[at : at + n])
        at += n
    w.close()
    rd = T.Reader(f, len(f.getvalue()))
    assert (np.concatenate(list(rd.documents())) == ids).all() and rd.lengths.tolist() == lengths
    for a, n in ((0, 1), (4095, 2), (4096, 4096), (len(ids) - 1, 1), (100, 0)):
        assert (rd.span(a, n) == ids[a : a + n]).all()


def test_documents(spark):
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    rows = [(i, t) for i, t in data.texts() if i is not None and i != 5] + [(-3, "before all")]
    files = T.write_tokens(data.table(spark, rows), bpe.vocabulary_path(), new_folder(spark, "t-tokens"))
    got = {r.id: r for r in T.read_tokens(files, "bigint").collect()}
    at = 0
    for i, t in sorted(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_hard_ids(spark):
    files = T.write_tokens(data.table(spark), bpe.vocabulary_path(), new_folder(spark, "t-tokens"))
    assert T.read_tokens(files, "bigint", keep=False).count() == len(data.texts())
    none = T.write_tokens(data.table(spark, [], False), bpe.vocabulary_path(), new_folder(spark, "t-tokens"))
    assert T.read_tokens(none, "bigint").count() == 0


def test_hard_ids_hold_their_content(spark):
    """Null and repeated ids: each row's own ids are in the files."""
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    files = T.write_tokens(data.table(spark), bpe.vocabulary_path(), new_folder(spark, "t-tokens"))
    want = [(i, tuple(lib.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in data.texts()]
    assert sorted(((r.id, tuple(r.ids)) for r in T.read_tokens(files, "bigint").collect()), key=repr) == sorted(want, key=repr)


def test_the_query_on_control_characters(spark, tmp_path):
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    rows = list(enumerate([*control_texts(), None, ""]))
    data.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    at, want = 0, []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, T.op7_tokens(spark, str(tmp_path)).collect())) == want
