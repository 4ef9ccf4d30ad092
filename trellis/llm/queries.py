"""Queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

import zlib

from trellis.llm.bpe import op4_bpe
from trellis.llm.conversations import op13_conversations
from trellis.llm.decontaminate import op10_decontaminate
from trellis.llm.language import op8_language
from trellis.llm.licenses import op6_licenses
from trellis.llm.licenses import oracle as licenses_sql
from trellis.llm.quality import RULES, STOP_WORDS, op2_quality
from trellis.llm.shard import op1_shard
from trellis.llm.simhash import op3_simhash
from trellis.llm.tokens import op7_tokens
from trellis.llm.toxicity import op9_toxicity
from trellis.llm.urls import op11_urls
from trellis.llm.variants import op12_spelling
from trellis.llm.warc import op5_warc

QUERIES = {
    "op1_shard": op1_shard,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_licenses": op6_licenses,
    "op7_tokens": op7_tokens,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op11_urls": op11_urls,
    "op12_spelling": op12_spelling,
    "op13_conversations": op13_conversations,
}

_STOP = ", ".join(sorted({"'" + v + "'" for words in STOP_WORDS.values() for w in words.split() for v in (w, w.capitalize(), w.upper())}))
_BOUNDS = {r.metric: (r.low, r.high) for r in RULES}
_RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis", "n_lines"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
}
_PASSES = " AND ".join(f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END) {op} {bound}" for m, (a, b) in _RATIOS.items() for op, bound in zip((">=", "<="), _BOUNDS[m], strict=True) if bound is not None)

OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
k AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS k FROM w WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM k) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) AS t(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop,
  len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_PASSES} AS kept FROM b
"""

_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_WINDOWS = "unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS k"

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
bk AS (SELECT DISTINCT item_id, m, k FROM (SELECT item_id, m, {_WINDOWS} FROM b)),
dk AS (SELECT doc_id, m, {_WINDOWS} FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m),
hits AS (SELECT dk.doc_id, dk.i, dk.m, bk.item_id FROM dk JOIN bk ON dk.m = bk.m AND dk.k = bk.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, i, m, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
  coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""

# DuckDB has no crc32: byte by byte, with what Python's gives for one byte as the table.
_STEP = [zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)]


def _crc32(text: str) -> str:
    bytes_of = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({bytes_of}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


# Words are compared in one byte a letter: levenshtein() compares bytes.
_HIGH = "".join(map(chr, range(0xC0, 0x100)))
_LOW = "".join(chr(c) for c in range(0x21, 0x80) if not 0x61 <= c <= 0x7A and c != 0x27)[:64]

OP12 = f"""
WITH RECURSIVE crc AS (SELECT {_STEP}::BIGINT[] AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
h AS (SELECT run, c, {_crc32("id || ':' || run")} AS h FROM (SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL), crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n, translate(word, '{_HIGH}', '{_LOW}') AS k, length(word) AS len FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM v a JOIN v b ON b.len BETWEEN a.len - 1 AND a.len + 1 AND levenshtein(a.k, b.k) = 1),
best AS (SELECT word, count(*) AS n_near, min({{'neg': -other_n, 'form': other}}) AS o FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -o.neg >= 5 * v.n THEN o.form END AS form, CASE WHEN -o.neg >= 5 * v.n THEN -o.neg END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
chain AS (SELECT word, coalesce(form, word) AS at, form IS NULL AS done FROM f UNION ALL SELECT c.word, coalesce(f.form, f.word), f.form IS NULL FROM chain c JOIN f ON f.word = c.at WHERE NOT c.done)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND chain.done
"""

ORACLE_SQL: dict[str, str] = {
    "op2_quality": OP2,
    "op5_warc": OP5,
    "op6_licenses": licenses_sql(),
    "op10_decontaminate": OP10,
    "op12_spelling": OP12,
}
