"""Personal data: the base spans against plain regular expressions, and the added kinds."""

import hashlib
import random
import re
import time

from cuadro.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"[^0-9]", "", m[0])
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        if 16 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def base(text):
    return [s for s in pii.spans_of(text) if s[0] in pii.BASE]


FIXED = ["", "a@b.c", "a@b.c@d.e", "@b.c", "x@@b.c d@e..f", "a.b+c%d@x-y.z-.w.", "1.2.3.4.5.6.7.8.9", "999.1.1.1.5.6.7",
         "0001.02.003.255", "4111 1111-1111 1111", "4111  1111 1111 1111", "41111111111111111111111", "+1 (743) 555-3824",
         "+1", "+12", "+1 2", "+1() . 5", "+123456789012345678", "++12345678", "+1 5 +1 2345678", "é 4111111111111111 é",
         "a@1.2.3.4", "²³@x.y", "1. 2.3.4.5", "1..2.3.4", "00000000000000000000.1.1.1"]


def test_base_equals_regex_on_fixed_cases():
    for text in FIXED:
        assert base(text) == brute(text), text


def test_base_equals_regex_on_random_text():
    rng = random.Random(3)
    pool = list("@@..++-- ()0123456789aZ_%é\n") + ["4111111111111111", "1.2.3.4", "a@b.c", "+1 555 123 4567", "255", "256", "٣"]
    for _ in range(20000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert base(text) == brute(text), repr(text)


def test_added_kinds():
    text = ("see https://user:pw@example.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, Account #: 12345-678 "
            "ssn 078-05-1120 xaccount 1234567 http://nohost and GB82WEST12345698765432.")
    got = [(k, text[a:b]) for k, a, b in pii.spans_of(text) if k in pii.ADDED]
    assert got == [("url", "https://user:pw@example.org/a?b=1"), ("iban", "DE89 3704 0044 0532 0130 00"),
                   ("iban", "GB82WEST12345698765432"), ("account", "12345-678"), ("account", "078-05-1120")]


def test_find_frame(spark):
    texts = FIXED + [None, "a@b.cd " * 5000]
    docs = spark.createDataFrame([(i, t, 7, t) for i, t in enumerate(texts)] + [(0, FIXED[0], 7, None)],
                                 "doc_id long, text string, n_email int, spans string")
    rows = pii.find(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert r.spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in want))
    assert pii.find(docs.limit(0)).count() == 0


def test_mask_keeps_the_other_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd now", "x"), (2, None, None), (3, "4111111111111111", "y")],
                                 "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert rows[1].text == "mail <EMAIL> now" and rows[1].spans == "x"
    assert rows[2].text is None and rows[3].text == "<CARD>"
    assert not [k for k, *_ in pii.spans_of(rows[1].text) if k in pii.BASE]


def test_urls_equal_a_scan_of_every_scheme():
    def urls(text):
        out = []
        for m in re.finditer("https?://", text):
            end = m.end()
            while end < len(text) and text[end] in pii.URL:
                end += 1
            while end > m.end() and text[end - 1] in ".,;:!?'()[]":
                end -= 1
            host = re.split("[/?#]", text[m.end():end])[0].rpartition("@")[2].partition(":")[0]
            labels = host.split(".")
            if (len(labels) > 1 or host == "localhost") and all(labels) and not (m.start() and text[m.start() - 1] in pii.ALNUM):
                out.append(("url", m.start(), end))
        return out
    rng = random.Random(9)
    pieces = ["http://", "https://", "a.b", "x", ".", "/", "?", "#", " ", "@", ":8", "é", ")", "=", "localhost", ",", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert [s for s in pii.spans_of(text) if s[0] == "url"] == urls(text), text


def test_long_runs_of_anchors_take_linear_time():
    for unit in ("http://", "http://a.b/", "http://.", "https://x@", "www.", "@", "+1", "1.1.", "a@b."):
        text = unit * (1_000_000 // len(unit))
        began = time.process_time()
        pii.spans_of(text)
        assert time.process_time() - began < 20, unit
