"""Quality rules as a short-circuit cascade.

A rule is a SQL condition over per-document measures that says "reject". The cascade estimates
each rule's cost and rejection rate on a sample, orders the rules by rejections per unit of cost,
and evaluates them as one CASE expression: the first rule that rejects ends the evaluation of
that row, and the measures a rule needs are computed only when the rule is reached. Which rule
comes first never changes the verdict, only the time.

Everything is a DataFrame expression. Measures of a text (a null text has no words and lines):

* words: runs of characters outside space and \\x09-\\x0D; ``n_words``, ``word_chars`` (their code points);
* ``n_symbols``: characters of ``#*$%&|<>``;
* ``n_dup_lines``: \\n-separated lines with a word, equal to an earlier line;
* ``n_repeat_words``: words inside a 5-word window that occurs twice or more in the text. Windows
  are compared by a 64-bit hash of their words, within one document.

Defined results: rows are kept one for one; an empty table gives an empty result; rules see only
the measures, so other columns of the input cannot clash.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuadro.session import materialise

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 2000               # rows on which cost and selectivity are estimated


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A SQL condition over measures; true rejects the document."""

    name: str
    reject: str
    needs: tuple[str, ...]


BASE_RULES = (
    Rule("too_short", "n_words < 10", ("n_words",)),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", ("n_words", "n_repeat_words")),
)
#: What the method judges beside the base rules.
RULES = (
    Rule("symbols", "20 * n_symbols > word_chars", ("n_symbols", "word_chars")),
    Rule("short_words", "word_chars < 2 * n_words", ("n_words", "word_chars")),
    Rule("long_words", "word_chars > 20 * n_words", ("n_words", "word_chars")),
    Rule("dup_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines", ("n_lines", "n_dup_lines")),
)


def _prepared(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and ``_text``; no other name of the input survives."""
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))


def _with(df: DataFrame, measure: str, wanted: Column) -> DataFrame:
    """Add a measure where ``wanted`` holds, null elsewhere; a branch not wanted is not evaluated.

    Arrays that several expressions read are columns of their own, so they are built once a row.
    """
    if measure in df.columns:
        return df
    only = lambda c: F.when(wanted, c)
    if measure == "n_words":
        trimmed = F.btrim("_text", F.lit(SPACE))
        df = df.withColumn("_words", only(F.when(trimmed == "", F.array().cast("array<string>"))
                                          .otherwise(F.split(trimmed, "[ \\t-\\r]+"))))
        return df.withColumn("n_words", F.array_size("_words").cast("long"))
    if measure == "word_chars":
        return df.withColumn(measure, only(F.length(F.translate("_text", SPACE, "")).cast("long")))
    if measure == "n_symbols":
        return df.withColumn(measure, only((F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long")))
    if measure in ("n_lines", "n_dup_lines"):
        df = df.withColumn("_lines", only(F.filter(F.split("_text", "\n"), lambda line: line.rlike("[^ \\t-\\r]"))))
        return df.withColumn("n_lines", F.array_size("_lines").cast("long")) \
            .withColumn("n_dup_lines", (F.array_size("_lines") - F.array_size(F.array_distinct("_lines"))).cast("long"))
    if measure == "n_repeat_words":
        df = _with(df, "n_words", wanted)
        w = F.col("_words")
        starts = F.sequence(F.lit(0), F.array_size(w) - WINDOW)
        df = df.withColumn("_windows", F.when(F.array_size(w) >= WINDOW, F.transform(
            starts, lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))))
        has_twin = wanted & (F.array_size(F.array_distinct("_windows")) < F.array_size("_windows"))
        df = df.withColumn("_sorted", F.when(has_twin, F.array_sort(F.transform(
            "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        s, last = F.col("_sorted"), F.array_size("_sorted") - 1
        twins = F.filter(s, lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))].h == x.h))
                         | ((j < last) & (s[F.least(j + 1, last)].h == x.h)))
        df = df.withColumn("_twins", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.transform(twins, lambda x: x.i))))
        covered = F.aggregate(
            "_twins", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, i: F.struct((i + WINDOW).alias("end"),
                                    (acc.n + i + WINDOW - F.greatest(i, acc.end)).alias("n")), lambda acc: acc.n)
        return df.withColumn(measure, only(F.coalesce(covered, F.lit(0)).cast("long")))
    raise ValueError(f"unknown measure {measure}")


def measure(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id and all measures of every row."""
    df = _prepared(docs, [id_col])
    for m in MEASURES:
        df = _with(df, m, F.lit(True))
    return df.select(id_col, *MEASURES)


def first_rows(docs: DataFrame, rows: int) -> DataFrame:
    """Some ``rows`` texts. Of a Parquet table only its first file is opened, however large the table."""
    files = docs.inputFiles()
    if files and files[0].endswith(".parquet"):
        docs = docs.sparkSession.read.schema(docs.schema).parquet(files[0])
    return docs.select("text").limit(rows)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """{rule: (seconds, rejection rate)} on ``first_rows``.

    The sample is written once, so each timing starts from the same small table; the time of
    reading it alone is taken off.
    """
    sample = materialise(first_rows(docs, rows), "quality-sample")

    def run(df: DataFrame, reject: str) -> tuple[float, float]:
        best, rate = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            rate = df.agg(F.avg(F.expr(f"if({reject}, 1.0D, 0.0D)")).alias("x"), F.sum(F.length("_text"))).first().x or 0.0
            best = min(best, time.perf_counter() - began)
        return best, float(rate)

    prepared = _prepared(sample, [])
    bare, _ = run(prepared, "false")
    found = {}
    for rule in rules:
        df = prepared
        for m in rule.needs:
            df = _with(df, m, F.lit(True))
        seconds, rate = run(df, rule.reject)
        found[rule.name] = max(seconds - bare, 1e-4), rate
    return found


def ordered(rules: tuple[Rule, ...], estimates: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejections per cost, the best first; ties by name."""
    return sorted(rules, key=lambda r: (-estimates[r.name][1] / estimates[r.name][0], r.name))


def cascade(docs: DataFrame, rules: list[Rule], keep: list[str], always: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, the measures in ``always``, and ``rejected_by`` (null: passed every rule).

    A rule, and the measures only it needs, are evaluated for rows that no earlier rule rejected.
    """
    if clash := {k for k in keep if k in MEASURES or k.startswith("_")}:
        raise ValueError(f"kept columns named like measures: {sorted(clash)}")
    df = _prepared(docs, keep)
    for m in always:
        df = _with(df, m, F.lit(True))
    df = df.withColumn("_by", F.lit(None).cast("string"))
    for rule in rules:
        passing = F.col("_by").isNull()
        for m in rule.needs:
            df = _with(df, m, passing)
        df = df.withColumn("_by", F.when(passing, F.expr(f"if({rule.reject}, '{rule.name}', null)")).otherwise(F.col("_by")))
    return df.select(*keep, *always, F.col("_by").alias("rejected_by"))
