"""Licence scan by canonical digest lookup.

A text is brought to a canonical form line by line (lower case, copyright statements dropped,
equivalent spellings unified, everything but letters and digits one blank); the form of a longer
text is that of its lines, joined by blanks. The digest of the whole form is joined to the digests
of known licence texts: notices, and the licences in ``licenses/`` whole and in their usual parts.
Scanned as entire texts: the document, each block of lines between empty lines, each line, and each
run of lines, also over empty lines, that has as many words as a known text and its first words;
blocks, lines and runs only where the document has several with words.

Everything is a DataFrame expression; the known texts are a small table that Spark joins as it
likes. Defined results: a null or wordless text matches nothing; rows are kept one for one (also
repeated rows); a known text whose canonical form is empty matches nothing; several known texts
with one form are all reported; empty tables give no matches; other columns are not read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuadro.session import materialise

#: Fixed values: (identifier, notice as it is usually written).
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "This work is licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Released under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "This work is dedicated to the public domain"),
    ("LicenseRef-all-rights-reserved", "All rights reserved"),
]

#: Known parts of the files in ``licenses/``: identifier, file, first words and last words (none: to the end), title put before.
_TERMS = "END OF TERMS AND CONDITIONS"
_GRANT, _BSD = "Permission is hereby granted", "Redistribution and use"
PARTS = [
    ("MIT", "MIT", "", "", ""), ("MIT", "MIT", _GRANT, "", ""), ("MIT", "MIT", _GRANT, "", "The MIT License"),
    ("MIT", "MIT", _GRANT, "", "The MIT License (MIT)"),
    *[(name, file, _BSD, "", title) for name, file in (
        ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("BSD-3-Clause", "BSD-3-Clause-Regents"))
      for title in ("", "All rights reserved.", f"{name} License")],
    ("ISC", "ISC", "", "", ""), ("ISC", "ISC", "Permission to use", "", ""),
    ("Apache-2.0", "Apache-2.0", "", "", ""), ("Apache-2.0", "Apache-2.0", "", _TERMS, ""),
    ("Apache-2.0", "Apache-2.0", "", "additional liability.", ""),
    ("Apache-2.0", "Apache-2.0", "Licensed under the Apache License", "", ""),
    *[part for n in ("2", "3") for part in (
        (f"GPL-{n}.0", f"GPL-{n}", "", "", ""), (f"GPL-{n}.0", f"GPL-{n}", "", _TERMS, ""),
        (f"GPL-{n}.0", f"GPL-{n}", "Everyone is permitted", "", ""), (f"GPL-{n}.0", f"GPL-{n}", "Everyone is permitted", _TERMS, ""),
        (f"GPL-{n}.0", f"GPL-{n}", "This program is free software", "GNU General Public License for more details.", ""))],
    ("GPL-3.0", "GPL-3", "This program is free software", "see <https://www.gnu.org/licenses/>.", ""),
    ("LGPL-2.1", "LGPL-2.1", "", "", ""), ("LGPL-2.1", "LGPL-2.1", "", _TERMS, ""),
    ("LGPL-2.1", "LGPL-2.1", "Everyone is permitted", "", ""), ("LGPL-2.1", "LGPL-2.1", "Everyone is permitted", _TERMS, ""),
    ("LGPL-3.0", "LGPL-3", "", "", ""), ("LGPL-3.0", "LGPL-3", "Everyone is permitted", "", ""),
    ("MPL-2.0", "MPL-2.0", "", "", ""), ("MPL-2.0", "MPL-2.0", "This Source Code Form is subject", "mozilla.org/MPL/2.0/.", ""),
    ("CC0-1.0", "CC0-1.0", "", "", ""), ("CC0-1.0", "CC0-1.0", "CC0 1.0 Universal", "", ""),
    ("Unlicense", "Unlicense", "", "", ""),
]

#: Spellings that count as the same, applied in this order to lower-case text.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("https://", "http://"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("&", " and "),
]
#: Words that count as the same, in a form that holds words and single blanks only.
WORDS = [("ver", "version")]
_YEAR = r"\b(?:19|20)\d\d\b"
_BODY = (r"(?i:licen[sc]es?|laws?|acts?|notices?|holders?|owners?|statements?|rights?|and|or|in|is|of|on|to|the|protections?|"
         r"treat(?:y|ies)|interests?|infringements?|disclaimers?|permissions?|status)\b")
#: A statement of copyright, not a sentence of a licence that a line break or an item "(c)" lets begin so: a mark, a year or a holder.
COPYRIGHT = (r"^[^\p{L}\p{N}©]*(?:©|(?i:\(c\))\s*(?:(?i:copyright\b|by\b)|[<\[{]|.*" + _YEAR + r"|\p{Lu}\S*(?:\s+\p{Lu}\S*){1,4}\s*$)"
             r"|(?i:copyright)\b[:\s]*(?:(?i:\(c\)|©|by\b)|[<\[{]|.*" + _YEAR + r")"
             r"|(?:Copyright|copyright|COPYRIGHT)[:\s]\s*(?!" + _BODY + r")\p{Lu})")
EMPTY_LINE = r"^[ \t\r]*$"
BREAK = "\u0002"                  # stands for an empty line among forms, which hold letters, digits and blanks only
BROADCAST_ROWS = 100_000
HEAD, FIRST = 12, 4               # first words of a known text that a run is compared with, and that it is joined by
FIRST_WORDS = 1_000               # so many different first words of known texts are looked up before that join


def _line(text: Column) -> Column:
    """Canonical form of one line."""
    t = F.lower(text)
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    form = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in WORDS * 2:                        # neighbours share a blank: twice reaches both
        form = F.replace(form, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.when(text.rlike(COPYRIGHT), F.lit("")).otherwise(F.trim(form))


def _joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: (x != "") & (x != BREAK)), " ")


def _marked(text: Column) -> Column:
    """The forms of a text's lines; empty lines are marked."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(EMPTY_LINE), F.lit(BREAK)).otherwise(_line(x)))


def _words(form: Column) -> Column:
    return F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit(""))) + 1


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    return _joined(_marked(text))


def digest(form: Column) -> Column:
    """Digest of a canonical form; null for an empty one, so that it joins to nothing."""
    return F.when(form != "", F.sha2(form, 256))


def full_texts() -> list[tuple[str, str]]:
    """(identifier, text) of PARTS."""
    out = []
    for name, file, first, last, title in PARTS:
        text = (Path(__file__).with_name("licenses") / f"{file}.txt").read_text(encoding="utf-8")
        text = text[text.rindex(first) if first else 0:]
        out.append((name, f"{title}\n{text[:text.index(last) + len(last)] if last else text}"))
    return out


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, digest, n_words, head: the first words), each once."""
    rows = spark.createDataFrame(KNOWN + full_texts() if known is None else known, "license string, body string")
    forms = rows.select("license", canonical(F.col("body")).alias("form")).where("form <> ''")
    return forms.select("license", digest(F.col("form")).alias("digest"), _words(F.col("form")).alias("n_words"),
                        F.substring_index("form", " ", HEAD).alias("head")).distinct()


def units(docs: DataFrame, key: str) -> DataFrame:
    """(key, kind, number, digest) of every entire text with words: document, block, line."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select(key, _marked(text).alias("lines"))
    blocks = F.transform(F.split(F.array_join("lines", "\n"), BREAK), lambda b: _joined(F.split(b, "\n")))
    forms = marked.select(key, _joined(F.col("lines")).alias("document"), F.filter(blocks, lambda b: b != "").alias("blocks"),
                          F.filter("lines", lambda x: (x != "") & (x != BREAK)).alias("lines"))

    def numbered(kind: str, c: Column) -> Column:
        return F.transform(c, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), x.alias("form")))

    none = F.array().cast("array<struct<kind:string,number:int,form:string>>")
    rows = forms.select(key, F.explode(F.concat(
        numbered("document", F.array("document")),
        F.when(F.size("blocks") > 1, numbered("block", F.col("blocks"))).otherwise(none),
        F.when(F.size("lines") > 1, numbered("line", F.col("lines"))).otherwise(none))).alias("u"))
    return rows.select(key, "u.kind", "u.number", digest(F.col("u.form")).alias("digest")).where("digest is not null")


def _lines(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys and ``lines``, an array of (form, block) of the lines with words."""
    marked = docs.select(*keys, _marked(F.col("text")).alias("lines"))
    blocks = F.transform(F.split(F.array_join("lines", "\n"), BREAK), lambda b: F.filter(F.split(b, "\n"), lambda x: x != ""))
    return marked.select(*keys, F.flatten(F.transform(F.filter(blocks, lambda b: F.size(b) > 0), lambda b, i: F.transform(
        b, lambda x: F.struct(x.alias("form"), i.alias("block"))))).alias("lines"))


def starts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(text_key, spots): per text, where a run may begin: array of (at: its first line, n_words).

    The key is a hash of the text, so equal texts share a row; ``runs`` decides by digest.
    """
    texts = known.select("n_words", F.col("head").alias("known_head"),
                         F.substring_index("head", " ", FIRST).alias("first")).distinct()
    n, sizes, words = texts.agg(F.count("*"), F.collect_set(F.least("n_words", F.lit(FIRST))),  # FIRST sizes at most
                                F.slice(F.collect_set(F.substring_index("first", " ", 1)), 1, FIRST_WORDS + 1)).first()
    lines = docs.where("text is not null").select(F.xxhash64("text").alias("text_key"), F.filter(
        _marked(F.col("text")), lambda x: (x != "") & (x != BREAK)).alias("lines"))
    begins = (lambda i: F.substring_index(F.get("lines", i), " ", 1).isin(words)) if len(words) <= FIRST_WORDS else (lambda i: F.lit(True))
    at = F.filter(F.sequence(F.lit(0), F.size("lines") - 2), begins)
    tops = lambda i: F.transform(F.slice("lines", i + 1, HEAD), lambda x: F.substring_index(x, " ", HEAD))
    heads = lines.where(F.size("lines") > 1).select("text_key", F.explode(F.transform(at, lambda i: F.struct(
        i.alias("at"), _words(F.get("lines", i)).alias("words"),
        F.substring_index(F.array_join(tops(i), " "), " ", HEAD).alias("head")))).alias("h"))
    firsts = F.array_distinct(F.array(*[F.substring_index("h.head", " ", n) for n in sorted(sizes) or [FIRST]]))
    if n <= BROADCAST_ROWS:
        texts = F.broadcast(texts)
    found = heads.select("text_key", "h.*", F.explode(firsts).alias("first")).join(texts, "first").where(
        (F.col("words") < F.col("n_words")) & F.startswith(F.concat("head", F.lit(" ")), F.concat("known_head", F.lit(" "))))
    return found.groupBy("text_key").agg(F.collect_set(F.struct("at", "n_words")).alias("spots"))


def runs(docs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, number, words, digest) of every run of two or more lines that may be a known text.

    ``number`` is the first line. Runs that are the document or one block are left to ``units``.
    """
    spots = materialise(starts(docs, known), "license-starts")
    if spots.count() <= BROADCAST_ROWS:
        spots = F.broadcast(spots)
    joined = _lines(docs.select(key, "text", F.xxhash64("text").alias("text_key")).join(spots, "text_key"), key, "spots")

    def counted(s: Column) -> Column:
        """Lines from the first one on until the words are reached."""
        none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
        return F.reduce(F.slice("lines", s.at + 1, s.n_words), none, lambda n, x: F.when(n.words >= s.n_words, n).otherwise(
            F.struct((n.words + _words(x.form)).alias("words"), (n.lines + 1).alias("lines"))))

    each = joined.select(key, "lines", F.transform("spots", lambda s: F.struct(
        s.at.alias("at"), s.n_words.alias("n_words"), counted(s).alias("n"))).alias("spots"))
    line = F.col("lines")
    block = lambda i: F.get(line, i).block
    end = lambda s: s.at + s.n.lines - 1
    is_block = lambda s: ((block(s.at) == block(end(s))) & ~block(s.at - 1).eqNullSafe(block(s.at))
                          & ~block(end(s) + 1).eqNullSafe(block(s.at)))
    is_document = lambda s: (s.at == 0) & (s.n.lines == F.size(line))
    kept = F.filter("spots", lambda s: (s.n.words == s.n_words) & ~is_block(s) & ~is_document(s))
    forms = F.transform(kept, lambda s: F.struct(s.at.alias("number"), s.n_words.alias("words"), digest(
        F.array_join(F.slice(line, s.at + 1, s.n.lines)["form"], " ")).alias("digest")))
    return each.select(key, F.explode(forms).alias("r")).select(key, "r.*")


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches: key, kind, number, words (of a run, else 0), license.

    The known texts are counted; a short list goes to every task.
    """
    known = materialise(known, "license-known")
    digests = known.select("license", "digest")
    if known.count() <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    every = units(docs, key).withColumn("words", F.lit(0)).unionByName(runs(docs, known, key).withColumn("kind", F.lit("run")))
    return every.join(digests, "digest").select(key, "kind", "number", "words", "license")


def per_document(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per row: doc_id, whole_license (of the entire document, the smallest name), n_matches, licenses.

    ``n_matches`` counts matching document, block, line and run texts; ``licenses`` lists the different
    identifiers in order, comma-joined (empty: none).
    """
    keyed = docs.select(F.col("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
    found = scan(keyed, known, "_row").groupBy("_row").agg(
        F.min(F.when(F.col("kind") == "document", F.col("license"))).alias("whole_license"),
        F.count_distinct("kind", "number", "words").alias("n_matches"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))
    return keyed.select("doc_id", "_row").join(found, "_row", "left").select(
        "doc_id", "whole_license", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce("licenses", F.lit("")).alias("licenses"))
