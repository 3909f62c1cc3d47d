"""Secret scan: candidates, features, and a random forest that removes false positives.

Candidates are all cores in a word: 16 or more of ``A-Za-z0-9+/_~.-`` (then at most two ``=``) that
hold a digit or stand behind a cue word such as "token"; a value of 4 or more characters, symbols
too, that is assigned to a name with a cue or follows a cue; and the password of a URL
``scheme://user:password@host``. The forest sees the candidate's
length, its character classes and the transitions between them, how much of it a dictionary
covers, marks of paths, and the neighbouring words. It is trained from labelled findings.

DataFrame and SQL functions only; the forest is Spark ML's. ``TRAIN_ROWS`` bounds the labelled
sample: a fixed fraction of the findings by hash, about this many rows.

Defined results: a null text has no candidates; rows are kept one for one; with labels of one kind
only (or none) the label rule itself decides and unlabelled findings are no secrets; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuadro.session import materialise

TRAIN_ROWS = 20_000
SPACE = "[ \\t-\\r]+"
# The form of a word that is one candidate. Inline name, then the core; quotes, brackets, = and : may stand between, punctuation may follow.
SHAPE = r"""^(?:(\S*?)[=:"'`(<\[{]+)?([A-Za-z0-9+/_~.\-]{16,}={0,2})[^A-Za-z0-9]*$"""

#: Words before a secret, words of examples, and words a made-up value may contain.
CUES = ["token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access_key", "credential", "auth",
        "bearer", "private"]
EXAMPLES = ["example", "sample", "dummy", "placeholder", "changeme", "your", "fake", "test", "xxxx", "redacted"]
DICTIONARY = ["example", "sample", "dummy", "placeholder", "change", "your", "fake", "test", "token", "secret", "password",
              "here", "value", "user", "name", "admin", "data", "file", "path", "home", "local", "config", "default", "http",
              "www", "com", "org", "the", "and", "for", "with", "tion", "ing", "ment", "ung", "keit", "heit", "ción", "ation"]
_CUE = "(?i:" + "|".join(CUES) + ")"
_SIGN = r"""["'`\\\])]*(?:[=:]+>?)[\\(<\[{]*"""
_VALUE = r"""(?:["'`]([^\s"'`]{4,}?)\\?["'`]|["'`]*([^\s"'`,;&{}()<>\[\]\\]{4,}))"""
_CORE = r"[A-Za-z0-9+/_~.\-]{16,}(?:={1,2}(?![A-Za-z0-9]))?"
# The password of a URL; a value assigned to a name with a cue; a long core, with or without a name. Parts of names are
# bounded, so that long runs cost linear time; what ends in a cue may have been taken as a long core.
WITHIN = (r"""([A-Za-z][A-Za-z0-9+.\-]{0,20}://[^\s:/@"'`]{0,200}):([^\s"'`/@]{4,})@"""
          + r"|(?:([\w.\-]{0,64}" + _CUE + r"[\w.\-]{0,64})|(?<=(" + _CUE + r")))" + _SIGN + _VALUE
          + r"|(?:([\w.\-]{0,64})" + _SIGN + r"""["'`]*)?(""" + _CORE + ")")
NAMES, CORES = (1, 3, 4, 7), (2, 5, 6, 8)
# The whole word is the value where the words before it end in a cue with a sign, or a cue alone.
BEHIND = r"""^["'`(<\[{]*""" + _VALUE + "|" + WITHIN
BEHIND_NAMES, BEHIND_CORES = tuple(n + 2 for n in NAMES), (1, 2, *(n + 2 for n in CORES))
NAMED = _CUE + r"""[\w.\-]*["'`\\\])]*[=:]+>?["'`(<\[{\\]*$"""
SIGN = r"^[=:]+>?$"
CUE_END = _CUE + r"""[\w.\-]*["'`\\\])]*$"""
CUE_ONLY = r"""^(?:["'`(]*|--?[\w\-]*)""" + _CUE + r"""["'`)]*$"""
FEATURES = ["f_length", "f_runs", "f_digits", "f_upper", "f_lower", "f_hex", "f_distinct", "f_vowels", "f_dictionary",
            "f_slashes", "f_dots", "f_url", "f_cue", "f_assigned", "f_quoted", "f_example", "f_number_before"]


def _any(words: list[str]) -> str:
    return "(" + "|".join(words) + ")"


def findings(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: the id and ``found``, an array of (word, core, near, raw); word counts from 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.split(text, SPACE).alias("_w"))
    w = F.col("_w")
    # A leading blank gives an empty first word; positions count from the first real one.
    lead = F.when(w[0] == "", 1).otherwise(0)
    low = lambda i: F.greatest(i, F.lit(0))
    before = lambda i, n: F.when(i >= n, w[low(i - n)]).otherwise("")

    def behind(i: Column) -> Column:
        one = before(i, 1)
        signed = one.rlike("[=:]") & (one.rlike(NAMED) | one.rlike(SIGN) & before(i, 2).rlike(CUE_END))
        return signed | one.rlike(CUE_ONLY) & w[i].rlike("[0-9]") & w[i].rlike("[A-Za-z]")

    def cut(word: Column, pattern: str, names: tuple[int, ...], cores: tuple[int, ...]) -> Column:
        """(name, core) of every match; one group of the names and of the cores has text at most."""
        def group(numbers: tuple[int, ...]) -> Column:
            out = F.regexp_extract_all(word, F.lit(pattern), F.lit(numbers[0]))
            for n in numbers[1:]:
                out = F.zip_with(out, F.regexp_extract_all(word, F.lit(pattern), F.lit(n)), lambda x, y: F.concat(x, y))
            return out
        return F.zip_with(group(names), group(cores), lambda x, y: F.struct(x.alias("name"), y.alias("core")))

    long = lambda x: (F.length(x) >= 16) | x.rlike("[=:]")
    at = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(
        i.alias("i"), ((F.length(w[i]) >= 4) & behind(i)).alias("behind")))
    df = df.withColumn("_at", F.filter(at, lambda a: a.behind | long(w[a.i]) & w[a.i].rlike(WITHIN)))

    def of_word(a: Column) -> Column:
        i = a.i
        cores = F.when(a.behind, cut(w[i], BEHIND, BEHIND_NAMES, BEHIND_CORES)).otherwise(cut(w[i], WITHIN, NAMES, CORES))
        return F.transform(cores, lambda c: F.struct(
            (i - lead).alias("word"), c.core.alias("core"),
            F.lower(F.concat_ws(" ", F.when(i > 2, w[low(i - 3)]), F.when(i > 1, w[low(i - 2)]), F.when(i > 0, w[low(i - 1)]),
                                c["name"])).alias("near"), w[i].alias("raw")))

    found = F.flatten(F.transform("_at", of_word))
    keep = lambda x: x.core.rlike("[0-9]") | x.near.rlike(_any(CUES)) | x.near.rlike("://[^ ]*$")
    return df.select("doc_id", F.filter(found, keep).alias("found"))


def features(found: DataFrame) -> DataFrame:
    """Adds the columns FEATURES to rows with core, near and raw."""
    core, n = F.col("core"), F.length("core")
    low = F.lower(core)

    def share(c: Column, drop: str) -> Column:
        return F.length(F.regexp_replace(c, drop, "")) / n

    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.withColumns({
        "f_length": n.cast("double"),
        "f_runs": F.length(F.regexp_replace(core, "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", "x")) / n,
        "f_digits": share(core, "[^0-9]"), "f_upper": share(core, "[^A-Z]"), "f_lower": share(core, "[^a-z]"),
        "f_hex": flag(core.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "f_distinct": F.size(F.array_distinct(F.split(core, ""))) / n,
        "f_vowels": share(low, "[^aeiou]"),
        "f_dictionary": 1 - share(low, _any(DICTIONARY)),
        "f_slashes": (n - F.length(F.replace(core, F.lit("/"), F.lit("")))).cast("double"),
        "f_dots": (n - F.length(F.replace(core, F.lit("."), F.lit("")))).cast("double"),
        "f_url": flag(F.col("raw").contains("://") | F.col("near").contains("://")),
        "f_cue": flag(F.col("near").rlike(_any(CUES))),
        "f_assigned": flag(F.col("near").rlike(r"[=:]\s*$") | F.col("raw").rlike(r"[=:]")),
        "f_quoted": flag(F.col("raw").rlike("[\"'`]")),
        "f_example": flag(low.rlike(_any(EXAMPLES)) | F.col("near").rlike(_any(EXAMPLES))),
        "f_number_before": flag(F.col("near").rlike(r"[0-9]\s*$")),
    })


def rule_label(found: DataFrame) -> DataFrame:
    """Labels by high-precision rules, for findings no person has labelled: 1, 0 or null.

    Secret: assigned behind a cue, letters and digits, no word of an example. No secret: digits
    only, or a word of an example, or mostly dictionary words.
    """
    mixed = F.col("core").rlike("[0-9]") & F.col("core").rlike("[A-Za-z]")
    bad = (F.col("f_digits") == 1) | (F.col("f_example") == 1) | (F.col("f_dictionary") > 0.6)
    return found.withColumn("label", F.when(bad, F.lit(0.0)).when(
        (F.col("f_cue") == 1) & (F.col("f_assigned") == 1) & mixed, F.lit(1.0)))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest from rows with FEATURES and ``label`` (nulls left out); None if one kind of label is missing."""
    known = labelled.where("label is not null")
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    kept = None
    for label, count in n.items():                                   # half of the sample for each label
        cut = min(1.0, rows / 2 / count)
        part = known.where((F.col("label") == label) & (F.pmod(F.xxhash64("core", "near"), F.lit(1_000_000)) < int(cut * 1_000_000)))
        kept = part if kept is None else kept.unionByName(part)
    sample = kept.select("label", *FEATURES).repartition(1).sortWithinPartitions("label", *FEATURES)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=30, maxDepth=6, seed=seed)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(sample))


def judge(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Adds ``probability`` that a finding is a secret."""
    if model is None:
        return found.withColumn("probability", F.coalesce("label", F.lit(0.0)))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(found).withColumnRenamed("_x", "x"))
    return scored.select(*found.columns, vector_to_array(scored.probability)[1].alias("p")).withColumnRenamed("p", "probability")


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, n_candidates, n_secrets, secrets (word:length of each, in order, comma-joined)."""
    per_doc = materialise(findings(docs).withColumn("row", F.monotonically_increasing_id()), "secret-findings")
    each = rule_label(features(per_doc.select("row", F.explode("found").alias("c")).select("row", "c.*")))
    judged = judge(each, train(each)).withColumn("is_secret", F.col("probability") >= threshold)
    spot = F.struct("word", F.length("core").alias("size"))
    by_row = judged.where("is_secret").groupBy("row").agg(F.sort_array(F.collect_list(spot)).alias("spots"))
    spots = F.transform("spots", lambda s: F.concat_ws(":", s.word, s.size))
    return per_doc.join(by_row, "row", "left").select(
        "doc_id", F.size("found").cast("long").alias("n_candidates"),
        F.coalesce(F.size("spots"), F.lit(0)).cast("long").alias("n_secrets"),
        F.coalesce(F.array_join(spots, ","), F.lit("")).alias("secrets"))
