"""Licence scan against plain Python."""

import random
import re
import textwrap

from pyspark.sql import functions as F

from cuadro.llm import license_scan as L


def canon(t):
    out = []
    for line in t.split("\n"):
        low = line.lower()
        if re.match(r"[\W_]*(copyright|\(c\)|©)", low):
            continue
        for a, b in L.SPELLINGS:
            low = low.replace(a, b)
        out.append(" ".join("version" if w == "ver" else w for w in re.sub(r"[\W_]+", " ", low).split()))
    return " ".join(x for x in out if x)


def entire_texts(t):
    lines = [x for x in t.split("\n") if canon(x)]
    blocks, open_ = [], []
    for line in [*t.split("\n"), ""]:
        if re.fullmatch(r"[ \t\r]*", line):
            blocks.append("\n".join(open_))
            open_ = []
        else:
            open_.append(line)
    blocks = [x for x in blocks if canon(x)]
    return [t] + (blocks if len(blocks) > 1 else []) + (lines if len(lines) > 1 else [])


TEXTS = [None, "", "...", "Released under the MIT License.", "  RELEASED under the MIT LICENCE!!", "prose\nReleased under the MIT License.\nmore",
         "Copyright (c) 2020 Someone\nReleased under the\nMIT License", "a\n\nLicensed under the Apache License,\nVersion 2.0\n\nb",
         "Not released under the MIT License.", "released under the mit license\nreleased under the mit license", "All rights reserved.",
         "x " * 20000 + "\nLicensed under CC BY-NC 4.0.", "Released under the MIT License.\n\n", "\n \t\nReleased under the\nMIT Licence\n\n\nend"]


def test_matches(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "z"), (None, TEXTS[3], None)],
                                 "doc_id long, text string, licenses string")
    forms = {}
    for name, body in L.KNOWN:
        forms.setdefault(canon(body), set()).add(name)
    rows = L.per_document(docs, L.known_licenses(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        t = (TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[3]) or ""
        hits = [forms[canon(u)] for u in entire_texts(t) if canon(u) in forms]
        assert r.n_matches == len(hits)
        assert r.licenses == ",".join(sorted(set().union(*hits))) if hits else r.licenses == ""
        assert r.whole_license == (min(forms[canon(t)]) if canon(t) in forms else None)
    by = {r.doc_id: r for r in rows}
    assert by[6].whole_license == "MIT" and by[7].licenses == "Apache-2.0" and by[8].n_matches == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License")], "doc_id long, text string")
    assert L.per_document(docs.limit(0), L.known_licenses(spark)).count() == 0
    none = L.known_licenses(spark, [("x", "...")])
    assert [tuple(r) for r in L.per_document(docs, none).collect()] == [(1, None, 0, "")]


def brute_runs(t, forms):
    """Every run of two or more lines with words, but not the document or one block, whose form is known."""
    lines, block = [], 0
    for line in t.split("\n"):
        block += bool(re.fullmatch(r"[ \t\r]*", line))
        if canon(line):
            lines.append((canon(line), block))
    whole = [[i for i, x in enumerate(lines) if x[1] == b] for b in {x[1] for x in lines}] + [list(range(len(lines)))]
    return [forms[f] for i in range(len(lines)) for j in range(i + 1, len(lines))
            if (f := " ".join(x[0] for x in lines[i:j + 1])) in forms and list(range(i, j + 1)) not in whole]


def test_runs_of_lines_against_every_run(spark):
    known = [("A", "one two three four five"), ("B", "one two three\n\nfour"), ("C", "one two"), ("D", "x " * 30), ("E", "two three four five")]
    forms = {}
    for name, body in known:
        forms.setdefault(canon(body), set()).add(name)
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["one", "one two", "two three", "two\nthree", "four", "five", "", "four five", "x x x", "x " * 9])
                       for _ in range(rng.randint(1, 25))) for _ in range(300)]
    texts += ["one\ntwo three\n\nfour five\nend", "end\n" + "x\n" * 40, texts[0]]
    rows = L.per_document(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                          L.known_licenses(spark, known)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        hits = [forms[canon(u)] for u in entire_texts(t) if canon(u) in forms] + brute_runs(t, forms)
        assert r.n_matches == len(hits), t
        assert r.licenses == ",".join(sorted(set().union(*hits))), t


def rewrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width, initial_indent="# ", subsequent_indent="# ") for p in re.split(r"\n\s*\n", text))


def test_full_texts_in_documents_of_any_wrapping(spark):
    names = [(p[0], p[1]) for p in L.PARTS]
    bodies = L.full_texts()
    docs = [(i, b) for i, (_, b) in enumerate(bodies)]
    docs += [(1000 + i, f"Some file.\n\nCopyright (c) 2021 Jane Doe\n\n{b}\n\nint main;\n") for i, (_, b) in enumerate(bodies)]
    again = {n: b for n, b in bodies if n in ("MIT", "BSD-2-Clause", "ISC", "Unlicense")}
    docs += [(2000 + 100 * w + i, "package x\n" + rewrapped(b, w) + "\nimport y") for w in (40, 66) for i, b in enumerate(again.values())]
    got = {r.doc_id: r for r in L.per_document(spark.createDataFrame(docs, "doc_id long, text string"), L.known_licenses(spark)).collect()}
    for i, (name, _) in enumerate(names):
        assert got[i].whole_license == name
        assert got[1000 + i].whole_license is None and name in got[1000 + i].licenses.split(","), (name, i)
    for w in (40, 66):
        for i, name in enumerate(again):
            assert name in got[2000 + 100 * w + i].licenses.split(","), (name, w)


def test_only_statements_of_copyright_are_dropped(spark):
    drop = ["Copyright (c) 2020 Someone", "(C) 1999-2001 X", "© Me", "# Copyright: 2020, Y", "Copyright Jane Doe", "COPYRIGHT ACME Inc.",
            "copyright by them", "Copyright [yyyy] [name]", "(c) Jane Doe", "Copyright (C) The Authors"]
    keep = ["(c) You must retain, in the Source form", "copyright notice, this list", "COPYRIGHT HOLDERS AND CONTRIBUTORS",
            "copyright license to reproduce", "Copyright License. Subject to the terms", "copyrighted by", "\"Copyright\" also means"]
    rows = [(i, t) for i, t in enumerate(drop + keep)]
    form = {r.i: r.f for r in spark.createDataFrame(rows, "i int, text string").select("i", L.canonical(F.col("text")).alias("f")).collect()}
    for i, t in rows:
        assert (form[i] == "") == (t in drop), t


def test_punctuation_never_changes_a_word(spark):
    known = L.known_licenses(spark, [("X", "Free for any purpose whatsoever."), ("Y", "However, the server never fails ver. 2 ver. ver. ver. 3")])
    texts = ["Free for any purpose whatsoever", "free for any purpose, whatsoever!", "FREE for any purpose whatsoever...",
             "however the server. never. fails version 2, VER version; ver 3", "However the serversion never fails ver 2 ver ver ver 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.whole_license for r in L.per_document(docs, known).collect()}
    assert found == {0: "X", 1: "X", 2: "X", 3: "Y", 4: None}
