"""Secret scan: candidates against plain Python, and what the forest keeps."""

import random
import re

import pytest

from cuadro.llm import secret_scan as S

rng = random.Random(8)
SHAPE = re.compile(S.SHAPE)


def brute(text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    out = []
    for i, w in enumerate(words):
        m = SHAPE.match(w) if len(w) >= 16 else None
        if m:
            near = " ".join([*words[max(0, i - 3):i], m[1] or ""]).lower()
            if re.search("[0-9]", m[2]) or any(c in near for c in S.CUES):
                out.append((i, m[2], near))
    return out


def hexes(n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def texts():
    out = [None, "", " \n", "short", " token = x", "secretword " + "a" * 30, "Ünïcode" * 5]
    for i in range(150):
        kind = i % 5
        filler = " ".join(rng.choice(["the", "on", "Haus", "été", "value,"]) for _ in range(rng.randint(1, 12)))
        body = {0: f'token = "{hexes(40)}"', 1: f"api_key={hexes(32)}", 2: "".join(rng.choice("0123456789") for _ in range(16)),
                3: 'token = "your-example-token-here-1"', 4: f"see /home/data/file/{rng.randint(1, 99)}/config.path"}[kind]
        out.append(f"{filler} {body} {filler}")
    out.append("w " * 15000 + f'secret: "{hexes(40)}".')
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "z") for i, t in enumerate(texts())] + [(None, texts()[7], "z"), (3, "short", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, core string")


def test_candidates(docs):
    for r in S.findings(docs.where("doc_id is not null")).collect():
        want = brute(docs.where(f"doc_id = {r.doc_id}").first().text) if r.doc_id < 12 else None
        if want is not None:
            assert [(c.word, c.core, c.near) for c in r.found] == want
    n = sum(len(r.found) for r in S.findings(docs).collect())
    assert n == sum(len(brute(r.text)) for r in docs.collect())


def test_forest_keeps_secrets_and_drops_false_positives(docs):
    rng.seed(8)
    got = {r.doc_id: r for r in S.scan(docs).collect() if r.doc_id is not None}
    assert len(got) == len(texts())
    for i in range(7, 157):
        assert got[i].n_secrets == (1 if (i - 7) % 5 in (0, 1) else 0), i
    assert got[157].n_secrets == 1 and got[157].secrets == "15001:40"
    assert got[0].n_candidates == 0 and got[3].secrets == ""


def test_no_labels_of_both_kinds_and_empty_table(spark, docs):
    one = spark.createDataFrame([(1, f'token = "{hexes(40)}"'), (2, "plain")], "doc_id long, text string")
    assert sorted(tuple(r) for r in S.scan(one).collect()) == [(1, 1, 1, "2:40"), (2, 0, 0, "")]
    assert S.scan(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(docs):
    found = S.features(S.findings(docs).selectExpr("doc_id", "explode(found) as c").select("doc_id", "c.*"))
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())


def random_secret(n, symbols=""):
    return "a1" + "".join(rng.choice("abcdefXYZ0123456789" + symbols) for _ in range(n - 2))


def test_every_secret_of_its_purpose_is_a_candidate(spark):
    """Texts made from secrets, not from the expressions that find them."""
    long = ['{"token":"%s","x":1}', '{\\"token\\":\\"%s\\"}', "?token=%s&page=2", "token=%s,next", "A=%s;B=%s;", "(see:%s)", "x,%s,y", "%s@host",
            "curl 'https://h.io/a?k=%s&b=%s'", "/some/long/path/of/words/file.token=%s", "Ü%s!"]
    cued = ["password=%s", 'password="%s"', "password: %s", "db.password = %s", "DB_PASSWORD=%s;next", '{"pwd":"%s","u":"me"}', "?secret=%s&x=1",
            "--password %s", "Bearer %s", "dbPassword:%s", '"apiKey" : "%s"', "secret => %s", "a/long/path/to/the/file.token=%s"]
    url = ["postgres://user:%s@host/db", "x=amqp://me:%s@h:5672,redis://:%s@r"]
    want, rows = {}, []

    def put(shape, make):
        given = tuple(make() for _ in range(shape.count("%s")))
        want[len(rows)] = given
        rows.append((len(rows), f"the text {shape % given} goes on"))

    for _ in range(5):
        for shape in long:
            put(shape, lambda: random_secret(40))
        for shape in cued:
            for n in (4, 8, 15, 30):
                put(shape, lambda n=n: random_secret(n, "!$%^*#@"))
        for shape in url:
            for n in (4, 9, 19):
                put(shape, lambda n=n: random_secret(n, "!$*"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in S.findings(docs).collect():
        cores = [c.core for c in r.found]
        assert all(cores.count(x) == 1 for x in want[r.doc_id]), (rows[r.doc_id], cores)


def test_plain_text_and_long_runs(spark):
    texts = ["The monkey ate: nothing at 12:30, see key points (2020).", "a token of thanks", "token " + "key" * 40000 + "=x", "x" * 100000 + "=abc"]
    got = [[c.core for c in r.found] for r in S.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert got[0] == [] and got[1] == [] and len(got) == 4
