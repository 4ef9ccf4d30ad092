"""Licence scans by sentence rules, with DataFrame operations only.

A text's lines are cut into sentences and normalised; a sentence that is known gets its
identifier by one hash join with the table of known sentences, which is a fixed part of
the rules. The identifiers in the order of a text are then matched against ordered
rules: a rule fires where its identifiers follow each other in that order, with at most
its gap of other sentences between two of them; one fold over a text's identifiers goes
through all rules at once. A known sentence may be wrapped: pieces that only line ends
part are also looked up joined, comment marks aside. A sentence may have a hole for a
holder's name, and a line of ``SPDX-License-Identifier:`` is a sentence for each licence
that its expression names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.quality import let
from trellis.llm.runtime import table

#: Sentences of public licence texts and notices, as their identifiers.
SENTENCES = {
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "by-nc-4": "Licensed under CC BY-NC 4.0.",
    "by-4": "Licensed under CC BY 4.0.",
    "by-sa-4": "Licensed under CC BY-SA 4.0.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache2-short": "Licensed under the Apache License, Version 2.0.",
    "apache2-long": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "all-rights": "All rights reserved.",
}


@dataclass(frozen=True)
class Rule:
    license: str
    sentences: tuple[str, ...]
    gap: int = 2
    #: The last sentence doesn't count where this one follows it within the gap.
    unless: str | None = None


#: In order: where several fire, all are reported, in this order.
RULES = (
    Rule("Apache-2.0", ("apache2-long", "apache2-copy", "apache2-as-is", "apache2-see")),
    Rule("Apache-2.0", ("apache2-short",)),
    Rule("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    Rule("MIT", ("mit-released",)),
    Rule("MIT", ("mit-licensed",)),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), unless="bsd-endorse"),
    Rule("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    Rule("GPL-3.0-only", ("gpl3-work",)),
    Rule("CC-BY-NC-4.0", ("by-nc-4",)),
    Rule("CC-BY-4.0", ("by-4",)),
    Rule("CC-BY-SA-4.0", ("by-sa-4",)),
    Rule("LicenseRef-all-rights-reserved", ("all-rights",)),
)
#: Fixed values beyond what the SQL knows: further sentences of public licence texts and notices.
MORE = {
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache2-copy-s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "apache2-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "gpl2-freedom": "The licenses for most software are designed to take away your freedom to share and change it.",
    "gpl3-copyleft": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "lgpl3-incorporates": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "agpl3-copyleft": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "mpl2-contributor": '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl2-copy-s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl21-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "boost-short": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "by-nd-4": "Licensed under CC BY-ND 4.0.",
    "by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0.",
    "by-nc-nd-4": "Licensed under CC BY-NC-ND 4.0.",
    "by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "by-sa-4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "by-nc-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}
#: Identifiers that a line of ``SPDX-License-Identifier:`` may name.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 Unlicense WTFPL Zlib".split()
MORE |= {f"spdx-{x}": f"SPDX-License-Identifier {x}" for x in SPDX}
#: Sentences that may stand between a licence's title and the first of its text: who holds the copyright, and headings.
PREAMBLE = 12
MORE_RULES = (
    Rule("Apache-2.0", ("apache2-long", "apache2-copy-s", "apache2-as-is", "apache2-see")),
    Rule("Apache-2.0", ("apache2-title", "apache2-terms"), PREAMBLE),
    Rule("GPL-2.0-only", ("gpl2-title", "gpl2-freedom"), PREAMBLE),
    Rule("GPL-3.0-only", ("gpl3-title", "gpl3-copyleft"), PREAMBLE),
    Rule("LGPL-2.1-only", ("lgpl21-title", "gpl2-freedom"), PREAMBLE),
    Rule("LGPL-3.0-only", ("lgpl3-title", "lgpl3-incorporates"), PREAMBLE),
    Rule("AGPL-3.0-only", ("agpl3-title", "agpl3-copyleft"), PREAMBLE),
    Rule("MPL-2.0", ("mpl2-title", "mpl2-contributor"), PREAMBLE),
    Rule("ISC", ("isc-grant", "isc-as-is")),
    Rule("0BSD", ("0bsd-grant", "isc-as-is")),
    Rule("MPL-2.0", ("mpl2-copy",)),
    Rule("MPL-2.0", ("mpl2-copy-s",)),
    Rule("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    Rule("LGPL-2.1-or-later", ("lgpl21-free", "lgpl21-hope")),
    Rule("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope")),
    Rule("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope")),
    Rule("Unlicense", ("unlicense-domain", "unlicense-anyone")),
    Rule("CC0-1.0", ("cc0-dedicated",)),
    Rule("BSL-1.0", ("boost-short",)),
    Rule("Zlib", ("zlib-as-is", "zlib-liable")),
    Rule("EPL-2.0", ("epl2-terms",)),
    Rule("CC-BY-ND-4.0", ("by-nd-4",)),
    Rule("CC-BY-NC-SA-4.0", ("by-nc-sa-4",)),
    Rule("CC-BY-NC-ND-4.0", ("by-nc-nd-4",)),
    Rule("CC-BY-4.0", ("by-4-work",)),
    Rule("CC-BY-SA-4.0", ("by-sa-4-work",)),
    Rule("CC-BY-NC-4.0", ("by-nc-4-work",)),
    *(Rule(x, (f"spdx-{x}",)) for x in SPDX),
)
_bsd2 = [r.license for r in RULES].index("BSD-2-Clause")
ALL_RULES = (*RULES[:_bsd2], Rule("BSD-3-Clause", (*RULES[_bsd2].sentences, "bsd-endorse")), *RULES[_bsd2:], *MORE_RULES)
#: A sentence ends at a line's end, or at one of these marks before white space.
END = r"(?<=[.!?:;])[\x20\x09-\x0D]+|\n"
#: The clause with a hole: whose name it is, in at most 300 characters, doesn't matter.
HOLDER = r"(?i)\bneither[^a-z0-9]+the[^a-z0-9]+names?[^a-z0-9]+of[^a-z0-9][\s\S]{1,300}?[^a-z0-9]nor[^a-z0-9]+the[^a-z0-9]+names?[^a-z0-9]+of[^a-z0-9]+(?:its|their|the|any)[^a-z0-9]+contributors(?![a-z0-9])"
ANY_HOLDER = "Neither the name of the copyright holder nor the names of its contributors"
#: An SPDX expression behind its tag: names, AND, OR, WITH and an exception's name, brackets.
TAG = "SPDX-License-Identifier "
EXPRESSION = TAG + r"([\x20(]*[\w.+-]+(?:[\x20]*\))*(?:[\x20]+(?i:AND|OR|WITH)[\x20]+[\x20(]*[\w.+-]+(?:[\x20]*\))*)*)"
#: Words that open a line of comment.
COMMENT = r"(?i)^[^a-z0-9]*(?:rem|dnl)(?:\s|$)"


def normal(sentence: Column) -> Column:
    """Lower-cased ASCII letters and digits, all else as single spaces."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " "))


def _sentences_of(text: str) -> list[str]:
    """The same cut and normal form for the rules' own sentences."""
    import re

    parts = re.split(END, text)
    return [n for p in parts if (n := re.sub(r"[^a-z0-9]+", " ", p.lower()).strip(" "))]


def _fired(hits: Column, rules: tuple[Rule, ...], expand: dict[str, list[str]]) -> Column:
    """The licences of the rules whose identifiers follow each other in (pos, end, id, plain) structs sorted by place.

    Goes over the structs once, with the latest place where each step of each rule ends, if
    the steps before it do; a later end is never worse, as gaps only bind to the next step.
    """
    far, steps, ends = -1_000_000_000, [], []
    for r in rules:
        names = [x for n in r.sentences for x in expand[n]]
        steps += [F.struct(F.lit(n).alias("id"), F.lit(r.gap + 1).alias("reach"), F.lit(i == 0).alias("first"), F.lit(r.unless is not None and i == len(names) - 1).alias("plain")) for i, n in enumerate(names)]
        ends.append(F.struct(F.lit(len(steps) - 1).alias("at"), F.lit(r.license).alias("license")))

    def step(a: Column, x: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            before = F.get(a, i - 1)
            can = s["first"] | ((x["pos"] > before) & (x["pos"] - before <= s["reach"]))
            return F.when((s["id"] == x["id"]) & (x["plain"] | ~s["plain"]) & can, x["end"]).otherwise(F.get(a, i))

        return F.transform(F.array(*steps), one)

    last = F.aggregate(hits, F.array_repeat(F.lit(far), len(steps)), step)
    return let(last, lambda a: F.array_distinct(F.transform(F.filter(F.array(*ends), lambda e: F.get(a, e["at"]) > far), lambda e: e["license"])))


def _names(piece: Column) -> Column:
    """A piece for each licence that the piece's SPDX expression names; names without ``-only`` or ``-or-later`` get them."""
    expression = F.regexp_replace(F.regexp_extract(piece, EXPRESSION, 1), r"(?i)[\x20]WITH[\x20]+[\w.+-]+", "")
    names = F.filter(F.regexp_extract_all(expression, F.lit(r"([\w.+-]+)"), 1), lambda x: ~F.upper(x).isin("AND", "OR"))
    gnu = r"(?i)^([AL]?GPL-[0-9.]+)"
    return F.transform(names, lambda x: F.concat(F.lit(TAG), F.regexp_replace(F.regexp_replace(x, gnu + "$", "$1-only"), gnu + r"\+$", "$1-or-later")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """Per row: id, n_known (known sentences), sentence_ids (in order), licenses (in the rules' order), licensed.

    Known sentences are looked up in a map literal, so there is no shuffle. A null or
    empty text knows none. A known text that is itself several sentences has several
    entries, its identifier numbered. Rows with null or repeated ids are rows like any
    other; further columns are ignored; an empty table gives no rows. Long texts are read
    whole, in one row's memory.
    """
    known: dict[str, str] = {}
    expand: dict[str, list[str]] = {}
    for name, text in (sentences or {**SENTENCES, **MORE}).items():
        parts = _sentences_of(text)
        expand[name] = [known.setdefault(p, f"{name}.{i + 1}" if len(parts) > 1 else name) for i, p in enumerate(parts)]
    of = F.create_map(*(F.lit(v) for kv in known.items() for v in kv))

    # Pieces without a letter or digit, as of comment marks alone, part nothing.
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"SPDX-License-Identifier:[\x20\t]*", TAG)
    text = F.regexp_replace(text, HOLDER, ANY_HOLDER)
    pieces = F.filter(F.split(text, END), lambda s: s.rlike("[A-Za-z0-9]"))
    named = F.flatten(F.transform(pieces, lambda s: F.when(s.rlike(EXPRESSION), _names(s)).otherwise(F.array(s))))
    cut = F.when(text.contains(TAG), named).otherwise(pieces)
    # Only sentences with a word of a known one, and no shorter than the shortest, are looked up.
    hint, least = _hint(known), min(map(len, known))
    most, words = max(map(len, known)), max(len(k.split()) for k in known)
    opens = r"(?i)^[^a-z0-9]*(?:(?:rem|dnl)\s[^a-z0-9]*)?(?:" + "|".join(sorted({k.split()[0] for k in known})) + r")(?![a-z0-9])"
    bare = lambda s: normal(F.regexp_replace(s, COMMENT, ""))
    ended = lambda s: s.rlike(r"[.!?:;]\s*$")
    begins = F.array(*(F.lit(k) for k in known))

    def wrapped(c: Column, s: Column, i: Column) -> Column:
        """The longest known sentence that begins with piece i and goes on in the next: its identifier, and how many pieces on it ends."""
        start = F.struct(bare(s).alias("t"), F.lit(True).alias("open"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("id"), F.lit(0).alias("at"))

        def step(a: Column, x: Column) -> Column:
            longer = F.trim(F.concat(a["t"], F.lit(" "), bare(x)))
            new = let(longer, lambda t: let(F.struct(t.alias("t"), F.try_element_at(of, t).alias("id")), lambda y: F.struct(
                y["t"].alias("t"), (~ended(x) & (F.length(y["t"]) < most)).alias("open"), (a["k"] + 1).alias("k"),
                F.coalesce(y["id"], a["id"]).alias("id"), F.when(y["id"].isNotNull(), a["k"] + 1).otherwise(a["at"]).alias("at"))))
            return F.when(a["open"], new).otherwise(a)

        can = ~ended(s) & s.rlike(opens) & let(bare(s), lambda t: F.exists(begins, lambda k: k.startswith(F.concat(t, F.lit(" ")))))
        return F.when(can, F.aggregate(F.slice(c, i + 2, words), start, step, lambda a: F.struct(a["id"].alias("id"), a["at"].alias("at"))))

    def entry(c: Column, s: Column, i: Column) -> Column:
        own = F.when((F.length(s) >= least) & s.rlike(hint), F.coalesce(F.try_element_at(of, normal(s)), F.try_element_at(of, bare(s))))
        return let(wrapped(c, s, i), lambda w: F.struct(i.alias("pos"), (i + F.coalesce(w["at"], F.lit(0))).alias("end"), F.coalesce(w["id"], own).alias("id")))

    hits = let(cut, lambda c: F.filter(F.transform(c, lambda s, i: entry(c, s, i)), lambda x: x["id"].isNotNull()))

    def found(p: Column) -> Column:
        """The rules' licences, once it is known after which sentences another one stands that some rule doesn't bear."""

        def plain(x: Column) -> Column:
            ok = F.lit(True)
            for r in rules:
                if r.unless:
                    follows = F.exists(p, lambda y: y["id"].isin(expand[r.unless]) & (y["pos"] > x["end"]) & (y["pos"] - x["end"] <= r.gap + 1))  # noqa: B023
                    ok = ok & ~((x["id"] == expand[r.sentences[-1]][-1]) & follows)
            return ok

        marked = F.transform(p, lambda x: F.struct(x["pos"].alias("pos"), x["end"].alias("end"), x["id"].alias("id"), plain(x).alias("plain")))
        return F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(_fired(marked, rules, expand))

    out = docs.select(F.col(id_col).alias("_id"), hits.alias("p"))
    out = out.select("_id", F.size("p").cast("long").alias("n_known"), F.transform("p", lambda x: x["id"]).alias("sentence_ids"), let(F.col("p"), found).alias("licenses"))
    return out.select(F.col("_id").alias(id_col), "n_known", "sentence_ids", "licenses", (F.size("licenses") > 0).alias("licensed"))


def _hint(known: dict[str, str]) -> str:
    """A pattern that every known sentence contains: the words that cover them all, most frequent first."""
    left, words = set(known), []
    while left:
        best = max(sorted({w for k in left for w in k.split() if len(w) > 4} or {w for k in left for w in k.split()}), key=lambda w: sum(w in k.split() for k in left))
        words.append(best)
        left = {k for k in left if best not in k.split()}
    return "(?iu)" + "|".join(words)


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences of every document: one row a document, lists joined by commas."""
    s = scan(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_known", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "licensed")


def oracle() -> str:
    """DuckDB SQL for ``op6_licenses``; the one-sentence rules, which are all that fire there, and the ordered ones by joins on place."""
    known: dict[str, str] = {}
    expand: dict[str, list[str]] = {}
    for name, text in SENTENCES.items():
        parts = _sentences_of(text)
        expand[name] = [known.setdefault(p, f"{name}.{i + 1}" if len(parts) > 1 else name) for i, p in enumerate(parts)]
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known.items())
    arms = []
    for i, r in enumerate(RULES):
        names = [x for n in r.sentences for x in expand[n]]
        joins = " ".join(f"JOIN hits h{j} ON h{j}.doc_id = h0.doc_id AND h{j}.id = {quote(n)} AND h{j}.pos > h{j - 1}.pos AND h{j}.pos - h{j - 1}.pos <= {r.gap + 1}" for j, n in enumerate(names) if j)
        arms.append(f"SELECT DISTINCT h0.doc_id, {i} AS nth, {quote(r.license)} AS license FROM hits h0 {joins} WHERE h0.id = {quote(names[0])}")
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
cut AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?:;])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: s <> '') AS parts FROM documents),
rows_of AS (SELECT doc_id, unnest(parts) AS s, unnest(range(len(parts))) AS pos FROM cut WHERE len(parts) > 0),
hits AS (SELECT r.doc_id, r.pos, k.id FROM rows_of r JOIN known k ON trim(regexp_replace(lower(r.s), '[^a-z0-9]+', ' ', 'g')) = k.sentence),
fired AS ({" UNION ALL ".join(arms)}),
one AS (SELECT doc_id, license, min(nth) AS nth FROM fired GROUP BY doc_id, license),
lic AS (SELECT doc_id, string_agg(license, ',' ORDER BY nth) AS licenses FROM one GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS sentence_ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(i.n, 0) AS n_known, coalesce(i.sentence_ids, '') AS sentence_ids, coalesce(l.licenses, '') AS licenses, l.licenses IS NOT NULL AS licensed
FROM documents d LEFT JOIN ids i ON i.doc_id = d.doc_id LEFT JOIN lic l ON l.doc_id = d.doc_id
"""
