from tests.llm import data
from trellis.llm import licenses as L


def test_rules(spark):
    s = L.SENTENCES
    mit = f"Copyright 2020\n\n{s['mit-grant']}\n\n{s['mit-notice']}\n{s['mit-as-is']}"
    rows = [
        (0, "Some words.\nReleased under the MIT License."),
        (1, mit),
        (2, f"{s['mit-as-is']}\n{s['mit-notice']}\n{s['mit-grant']}"),
        (3, f"{s['mit-grant']} One. Two. Three. Four. {s['mit-notice']} {s['mit-as-is']}"),
        (4, "LICENSED   UNDER the apache license, version 2.0.\nlicensed under cc by-nc 4.0."),
        (5, "It was released under the MIT License."),
        (6, None),
        (7, ""),
        (8, "\n".join(s[k] for k in ("apache2-long", "apache2-copy", "apache2-as-is", "apache2-see"))),
    ]
    got = {r.doc_id: r for r in L.scan(data.table(spark, rows, False)).collect()}
    assert got[0].licenses == ["MIT"] and got[0].sentence_ids == ["mit-released"]
    assert got[1].licenses == ["MIT"] and got[2].licenses == [] and got[2].n_known >= 3 and got[3].licenses == []
    assert got[4].licenses == ["Apache-2.0", "CC-BY-NC-4.0"] and not got[5].licensed
    assert not got[6].licensed and got[6].n_known == 0 and got[7].sentence_ids == [] and got[8].licenses == ["Apache-2.0"]


def test_whole_table(spark):
    docs = data.table(spark)
    s = L.scan(docs)
    assert s.count() == docs.count() and s.where("licensed").count() == 0
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert L.scan(data.table(spark, [], False)).count() == 0


def test_wrapped_and_third_clause(spark):
    import textwrap

    s = {**L.SENTENCES, **L.MORE}
    apache = [f"{s['apache2-long']} You may obtain a copy of the License at", "    http://www.apache.org/licenses/LICENSE-2.0", f"{s['apache2-as-is']} {s['apache2-see']}"]
    mit = ["MIT License", s["mit-grant"], s["mit-notice"], s["mit-as-is"]]
    two = [s["bsd-grant"], f"1. {s['bsd-source']}", f"2. {s['bsd-binary']}"]
    three = [*two, f"3. {s['bsd-endorse']}"]
    gpl = [s["gpl-free"], s["gpl-hope"]]
    wrap = lambda ps, mark, width: f"\n{mark.rstrip()}\n".join("\n".join(mark + x for x in textwrap.wrap(p, width, break_long_words=False)) for p in ps)
    rows, want = [], []
    for ps, license in ((apache, "Apache-2.0"), (mit, "MIT"), (two, "BSD-2-Clause"), (three, "BSD-3-Clause"), (gpl, "GPL-3.0-or-later")):
        for mark, width in (("", 72), (" * ", 70), ("# ", 40), ("// ", 60), ("dnl ", 65)):
            rows.append((len(rows), wrap(ps, mark, width)))
            want.append([license])
    rows += [(len(rows), "\n".join(three)), (len(rows) + 1, "Licensed under the Apache License.\nVersion 2.0."), (len(rows) + 2, "Released under\nthe MIT License.\n")]
    want += [["BSD-3-Clause"], [], ["MIT"]]
    got = {r.doc_id: r.licenses for r in L.scan(data.table(spark, rows, False)).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_every_rule_fires(spark):
    """Each rule's sentences as a text, on one line each and wrapped behind comment marks, give its licence alone; SPDX lines give theirs."""
    import textwrap

    s = {**L.SENTENCES, **L.MORE}
    rules = [r for r in L.ALL_RULES if not r.sentences[0].startswith("spdx-")]
    rows, want = [], []
    for r in rules:
        lines = [s[n] for n in r.sentences]
        wrapped = "\n *\n".join("\n".join(" * " + x for x in textwrap.wrap(p, 70, break_long_words=False, break_on_hyphens=False)) for p in lines)
        rows += [(len(rows), "\n".join(lines)), (len(rows) + 1, wrapped)]
        want += [[r.license]] * 2
    for x in L.SPDX:
        rows.append((len(rows), f"#!/bin/sh\n# SPDX-License-Identifier: {x}\nsome words"))
        want.append([x])
    got = {r.doc_id: r.licenses for r in L.scan(data.table(spark, rows, False)).collect()}
    assert {i: g for i, g in got.items() if g != want[i]} == {}
    assert len({r.license for r in L.ALL_RULES}) >= 30


def test_any_holder(spark):
    """BSD's third clause names whom it likes, also over line ends and with full stops in the name."""
    import textwrap

    s = {**L.SENTENCES, **L.MORE}
    two = [s["bsd-grant"], f"1. {s['bsd-source']}", f"2. {s['bsd-binary']}"]
    rows, want = [], []
    for name in ("Foo Inc.", "the University of California, Berkeley", "Google Inc. and its affiliates", "the copyright holders", "X"):
        third = "3. " + s["bsd-endorse"].replace("the copyright holder", name)
        for mark, width in (("", 1000), (" * ", 60), ("# ", 44)):
            wrap = lambda p: "\n".join(mark + x for x in textwrap.wrap(p, width, break_on_hyphens=False))  # noqa: B023, E731
            rows.append((len(rows), "\n\n".join(map(wrap, [*two, third]))))
            want.append(["BSD-3-Clause"])
    rows.append((len(rows), "\n".join(two) + "\nNeither the name of the rose nor that of the thorn."))
    want.append(["BSD-2-Clause"])
    got = {r.doc_id: r.licenses for r in L.scan(data.table(spark, rows, False)).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_spdx_expressions(spark):
    cases = {
        "GPL-2.0": ["GPL-2.0-only"],
        "GPL-2.0+": ["GPL-2.0-or-later"],
        "LGPL-2.1+": ["LGPL-2.1-or-later"],
        "AGPL-3.0": ["AGPL-3.0-only"],
        "(MIT OR Apache-2.0)": ["Apache-2.0", "MIT"],
        "Apache-2.0 WITH LLVM-exception": ["Apache-2.0"],
        "MIT AND (BSD-3-Clause OR GPL-2.0-or-later WITH Classpath-exception-2.0)": ["BSD-3-Clause", "GPL-2.0-or-later", "MIT"],
        "mit or zlib */": ["MIT", "Zlib"],
        "Never-1.0": [],
        "": [],
    }
    rows = [(i, f"// SPDX-License-Identifier: {x}\nint main;") for i, x in enumerate(cases)]
    got = {r.doc_id: r for r in L.scan(data.table(spark, rows, False)).collect()}
    assert [sorted(got[i].licenses) for i in range(len(rows))] == list(cases.values())
    assert got[4].n_known == 2 and got[8].n_known == 0


def test_headers_of_whole_texts(spark):
    """How whole licence texts begin; and the notice of Apache with https."""
    s = {**L.SENTENCES, **L.MORE}
    fsf = " Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n"
    rows = [
        (0, f"                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n{fsf}                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n"),
        (1, f"                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n{fsf}                            Preamble\n\n  The licenses for most software are designed to take away your\nfreedom to share and change it.  By contrast,\n"),
        (2, f"                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n{fsf}\n  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below.\n"),
        (3, 'Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. "Contributor"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.\n'),
        (4, "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"),
        (5, "\n".join(s[k] for k in ("apache2-long", "apache2-copy-s", "apache2-as-is", "apache2-see"))),
        (6, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + "A sentence.\n" * 20 + s["gpl3-copyleft"]),
    ]
    got = {r.doc_id: r.licenses for r in L.scan(data.table(spark, rows, False)).collect()}
    assert [got[i] for i in range(7)] == [["GPL-3.0-only"], ["GPL-2.0-only"], ["LGPL-3.0-only"], ["MPL-2.0"], ["Apache-2.0"], ["Apache-2.0"], []]
