"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs, digits, schemes and
identifier cues. At each anchor a small deterministic parser expands to the left and right and
validates the candidate. No regex runs over the text.

Base kinds (offsets in code points, end exclusive), leftmost and non-overlapping per kind, a
candidate that fails its check is dropped without another try:

* ``email``: local part ``[A-Za-z0-9._%+-]+``, at-sign, labels ``[A-Za-z0-9-]+`` joined by dots, two at least;
* ``ip``: four runs of digits joined by dots, none over 255;
* ``card``: digits with at most one space or hyphen between two of them, 16 to 19 digits that pass Luhn;
* ``phone``: plus, digit, ``[ ().0-9-]+``, digit; 8 to 15 digits.

Kinds the method adds: ``url`` (scheme, host, rest), ``iban`` (mod 97 after a cue or at two
capitals and two digits) and ``account`` (an identifier of 6 to 34 letters and digits with at
least 5 digits after a cue such as "account" or "SSN").

Defined results: a null text counts as empty (no spans); rows are kept one for one; an empty
table gives an empty result; other columns of the input are not read by ``find``.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadro.llm.common import groups, id_text

Span = tuple[str, int, int]
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL = ALNUM | frozenset("-._~:/?#[]@!$&'()*+,;=%")
PATH = re.compile("[/?#]")

# Schemes and cue words looked for, in lower case; capitalised and upper-case forms are added.
SCHEMES = ("http://", "https://", "ftp://", "sftp://")
CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "kontonummer", "cuenta", "compte")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for ch in "@+0123456789":
        a.add_word(ch, (ch if ch in "@+" else "digit", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for w in words:
            for form in {w, w.capitalize(), w.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _run(text: str, at: int, chars: frozenset, end: int | None = None) -> int:
    """End of the run of ``chars`` that starts at ``at``."""
    stop = len(text) if end is None else end
    while at < stop and text[at] in chars:
        at += 1
    return at


def email_at(text: str, sign: int, floor: int) -> tuple[int, int] | None:
    start = sign
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == sign:
        return None
    end = _run(text, sign + 1, LABEL)
    labels = end > sign + 1
    more = False
    while labels and end < len(text) and text[end] == ".":
        nxt = _run(text, end + 1, LABEL)
        if nxt == end + 1:
            break
        end, more = nxt, True
    return (start, end) if more else None


def ips_in(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Quads of a chain of digit runs joined by single dots, and the end of the chain."""
    runs = []
    while True:
        end = _run(text, at, DIGITS)
        runs.append((at, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            at = end + 1
            continue
        break
    quads = [runs[i:i + 4] for i in range(0, len(runs) - 3, 4)]
    good = [(q[0][0], q[3][1]) for q in quads if all(_small(text[a:b]) for a, b in q)]
    return good, runs[-1][1]


def _small(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def card_at(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """The chain of digits with single separators that starts here: (span if valid, end)."""
    n, end, digits = len(text), at + 1, [text[at]]
    while end < n:
        if text[end] in DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    good = 16 <= len(digits) <= 19 and luhn("".join(digits))
    return ((at, end) if good else None), end


def phone_at(text: str, plus: int) -> tuple[tuple[int, int] | None, int]:
    """(span if valid, where the next phone may start)."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None, plus + 1
    end = _run(text, plus + 2, PHONE)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end - plus < 4:                       # plus, digit, one character of the class, digit
        return None, plus + 1
    n = sum(ch in DIGITS for ch in text[plus:end])
    return ((plus, end) if 8 <= n <= 15 else None), end


def url_end(text: str, at: int) -> tuple[int, int]:
    """(end of the URL characters from ``at``, that end without closing punctuation)."""
    run = end = _run(text, at, URL)
    while end > at and text[end - 1] in ".,;:!?'()[]":
        end -= 1
    return run, end


def url_at(text: str, start: int, after_scheme: int, end: int) -> tuple[int, int] | None:
    """The URL whose scheme ends at ``after_scheme`` and whose last character is before ``end``."""
    if end <= after_scheme:
        return None
    path = PATH.search(text, after_scheme, end)
    host = text[after_scheme:path.start() if path else end].rpartition("@")[2].partition(":")[0]
    labels = host.split(".")
    if len(labels) < 2 and host != "localhost" or not all(labels):
        return None
    return start, end


def iban_valid(code: str) -> bool:
    if not 15 <= len(code) <= 34 or not (set(code[:2]) <= UPPER and set(code[2:4]) <= DIGITS):
        return False
    if not set(code) <= UPPER | DIGITS:
        return False
    return int("".join(str(int(ch, 36)) for ch in code[4:] + code[:4])) % 97 == 1


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    """Groups of capitals and digits with single spaces between; the longest valid reading wins."""
    ends, code, i = [], [], at
    while i < len(text) and len(code) < 34:
        if text[i] in UPPER or text[i] in DIGITS:
            code.append(text[i])
            i += 1
            if len(code) >= 15:
                ends.append((i, len(code)))
        elif text[i] == " " and code and i + 1 < len(text) and (text[i + 1] in UPPER or text[i + 1] in DIGITS):
            i += 1
        else:
            break
    for end, n in reversed(ends):
        if (end == len(text) or text[end] not in ALNUM) and iban_valid("".join(code[:n])):
            return at, end
    return None


def account_after(text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends at ``at``: a few joining characters, then the value."""
    i = at
    while i < len(text) and i - at < 4 and text[i] in " :=#.-":
        i += 1
    if i == at or i >= len(text) or text[i] not in ALNUM:
        return None
    end = i
    while end < len(text) and (text[end] in ALNUM or text[end] == "-" and end + 1 < len(text) and text[end + 1] in ALNUM):
        end += 1
    value = text[i:end].replace("-", "")
    digits = sum(ch in DIGITS for ch in value)
    return (i, end) if 6 <= len(value) <= 34 and digits >= 5 else None


def spans_of(text: str | None) -> list[Span]:
    """All spans of a text in order of kind and start."""
    if not text:
        return []
    found: list[Span] = []
    email_floor = chain_end = card_end = phone_end = url_run = url_stop = 0
    for last, (kind, size) in automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= chain_end:                                     # first digit of a chain of dotted runs
                quads, chain_end = ips_in(text, at)
                found += [("ip", a, b) for a, b in quads]
            if at >= card_end:
                span, card_end = card_at(text, at)
                if span:
                    found.append(("card", *span))
            if at >= 3 and text[at - 1] in UPPER and text[at - 2] in UPPER and text[at - 3] not in ALNUM or \
                    at == 2 and text[0] in UPPER and text[1] in UPPER:
                span = iban_at(text, at - 2)
                if span:
                    found.append(("iban", *span))
        elif kind == "@":
            span = email_at(text, at, email_floor)
            if span:
                found.append(("email", *span))
                email_floor = span[1]
        elif kind == "+":
            if at >= phone_end:
                span, phone_end = phone_at(text, at)
                if span:
                    found.append(("phone", *span))
        elif kind == "scheme":
            if last + 1 >= url_run:                                 # a scheme inside a run shares its end
                url_run, url_stop = url_end(text, last + 1)
            if not (at and text[at - 1] in ALNUM):
                span = url_at(text, at, last + 1, url_stop)
                if span:
                    found.append(("url", *span))
        elif not (at and text[at - 1] in ALNUM):
            span = account_after(text, last + 1)
            if span:
                found.append(("account", *span))
    found = list(dict.fromkeys(found))
    found.sort(key=lambda s: (ORDER[s[0]], s[1], s[2]))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with every maximal stretch of spans replaced by the kind of its first span."""
    if not spans:
        return text
    out, at = [], 0
    ordered = sorted(spans, key=lambda s: (s[1], -s[2]))
    i = 0
    while i < len(ordered):
        kind, start, end = ordered[i]
        while i + 1 < len(ordered) and ordered[i + 1][1] < end:
            i += 1
            end = max(end, ordered[i][2])
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
        i += 1
    return "".join(out) + text[at:]


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    schema = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in BASE]
                       + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches):
        for rows in groups(batches):
            cols: list[list] = [[] for _ in schema]
            for doc_id, text in rows:
                spans = spans_of(text)
                base = [s for s in spans if s[0] in BASE]
                values = [doc_id, *(sum(s[0] == k for s in base) for k in BASE),
                          hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)]
                for c, v in zip(cols, values):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return id_text(docs).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with personal data in the text replaced by ``<KIND>``; all other columns are kept."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [masked(t, spans_of(t)) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
