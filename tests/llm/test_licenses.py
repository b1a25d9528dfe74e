from pathlib import Path

import pytest

from corpusloom.llm import licenses

BODY = licenses.KNOWN[0][1]


def test_variants(spark, docs_of):
    variants = {
        1: BODY, 2: BODY.upper(), 3: "Copyright (c) 2021 Somebody <a@b.c>\r\n\r\n" + BODY.replace("\n", "\r\n"), 4: "MIT License\n\nCopyright © 1999-2024 X, Y and Z\nAll rights reserved.\n\n" + BODY.replace("sublicense", "sublicence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT"),
        5: BODY.replace(",", " , ").replace(" ", "  "), 6: BODY + " and more", 7: BODY.replace("copyright notice", "notice"), 8: None, 9: "", 10: "...", 11: "Some text.\n  released under the MIT licence!!  \nEnd", 12: "Released under the MIT License. Really.",
        13: "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License.",
    }
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(docs_of(list(variants.items()))).collect()}
    assert {k for k, v in got.items() if v[0]} == {1, 2, 3, 4, 5} and {got[k][0] for k in (1, 2, 3, 4, 5)} == {"MIT"}
    assert got[11][1] == "MIT" and got[13][1] == "CC-BY-NC-4.0,MIT"
    assert all(got[k] == (None, "") for k in (6, 7, 8, 9, 10, 12))


def test_every_known_text_is_found(spark, docs_of):
    rows = list(enumerate(t for _, t in licenses.KNOWN))
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs_of(rows + [(3, rows[3][1])])).collect()}
    assert got == {k: licenses.KNOWN[k][0] for k, _ in rows}


def test_own_list_and_plan(spark, docs_of):
    own = licenses.scan(docs_of([(1, "my terms"), (None, "MY, terms.")]), known=(("own", "My terms"), ("b-own", "my terms")))
    assert [r["license"] for r in own.collect()] == ["b-own", "b-own"]
    assert "Python" not in own._jdf.queryExecution().executedPlan().toString()
    assert licenses.scan(docs_of([(1, "x")]).filter("doc_id < 0")).count() == 0


def test_wrapped_lines_and_long_texts(spark, docs_of):
    """Line breaks within a licence don't count, also within a phrase of several words; a text of many lines has its notices."""
    bsd = next(t for n, t in licenses.KNOWN if n == "BSD-3-Clause")
    wrapped = bsd.replace("copyright holder nor", "copyright\nowner nor").replace("source and", "source\r\nand")
    long = "\n".join(["a line of no licence & more"] * 200_000 + ["SPDX-License-Identifier: Zlib"])
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(docs_of([(1, wrapped), (2, long)])).collect()}
    assert got == {1: ("BSD-3-Clause", ""), 2: (None, "Zlib")}


def test_known_table_may_be_a_data_frame(spark, docs_of):
    table = licenses.known_digests(spark, tuple((f"own-{k}", f"terms number {k}") for k in range(3000)))
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(docs_of([(1, "Terms, number 7"), (2, "x\nterms number 2999\nTERMS NUMBER 11")]), table).collect()}
    assert got == {1: ("own-7", "own-7"), 2: (None, "own-11,own-2999")}


def test_stretches_within_other_texts(spark, docs_of):
    """Wrapped at 60 columns behind comment signs, program text around them; twice; one within another; cut short."""
    import textwrap

    text = lambda name, words: next(t for n, t in licenses.KNOWN if n == name and len(t.split()) > words)
    apache, bsd = text("Apache-2.0", 40), text("BSD-3-Clause", 40)
    sign = lambda t, c: "\n".join(f"{c} {line}" for part in t.split("\n") for line in textwrap.wrap(part, 60) or [""])
    head = "#!/usr/bin/env python\n# Copyright 2019 The Authors. All Rights Reserved.\n#\n"
    rows = {
        1: head + sign(apache, "#") + "\n\nimport os\nprint('x')\n", 2: "/*\n * Copyright (c) 2020, X\n *\n" + sign(bsd, " *") + "\n */\nint main() { return 0; }", 3: sign(apache, "//") + "\nx\n" + sign(apache, "#") + "\n" + sign(BODY, "--"),
        4: head + sign(" ".join(apache.split()[:-1]), "#") + "\n", 5: "Licensed under the Apache License, Version 2.0 (the\n" + apache, 6: "see licensed under the apache license, version 2.0", 7: None, 8: "x" + apache,
    }
    got = {r["doc_id"]: (r["license"], r["contained"]) for r in licenses.scan(docs_of(list(rows.items()))).collect()}
    assert got[1] == (None, "Apache-2.0") and got[2] == (None, "BSD-3-Clause") and got[3] == (None, "Apache-2.0,MIT") and got[5] == (None, "Apache-2.0")
    assert [got[k] for k in (4, 6, 7, 8)] == [(None, "")] * 4


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no texts to compare with")
def test_long_licences(spark, docs_of):
    files = ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0"]
    texts = [Path("/usr/share/common-licenses", f).read_text(errors="replace") for f in files]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs_of(list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(5)] == ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"]
