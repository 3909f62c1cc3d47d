"""Registered queries of the training-data operators: one ``opN_<name>`` each."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuadro.llm import (bpe, decontam, ego_join, filter_audit, language_id, license_scan, lm, pii, quality, secret_scan, simhash,
                        source_divergence, suffix_dedup)
from cuadro.llm.common import documents, held_out, id_text
from cuadro.session import read_table

BPE_RANKS = os.environ.get("CUADRO_BPE_RANKS") or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.per_document(documents(spark, sf_dir), license_scan.known_licenses(spark))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    profiles = language_id.learn(docs.where(~held_out("doc_id", 4, 2)), F.col("lang"))
    return language_id.predict(docs, profiles).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"),
                                                      "lang_pred", "score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), BPE_RANKS)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(documents(spark, sf_dir))
    training = docs.where(~held_out("doc_id", 7, 2)).select("text")
    scored = lm.score(docs, training)
    return scored.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, bits=4)
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir)).drop("kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    order = quality.ordered(quality.RULES, quality.estimate(docs, quality.RULES))
    base = [f"coalesce({r.reject}, false)" for r in quality.BASE_RULES]
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.cascade(docs, [*quality.BASE_RULES, *order], ["doc_id"], quality.MEASURES)
    return judged.select("doc_id", *shown, F.expr(" or ".join(base)).alias("base_failed"),
                         F.col("rejected_by").isNull().alias("kept"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(documents(spark, sf_dir))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(read_table(spark, sf_dir, "embeddings"), ego_join.THRESHOLD)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_pii": op4_pii,
    "op5_lm_score": op5_lm_score,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_simhash": op8_simhash,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_divergence": op12_source_divergence,
    "op13_embedding_dedup": op13_embedding_dedup,
}

_WS = r"[ \t\n\x0b\f\r]"

#: Written by hand from the contracts; RE2 syntax.
ORACLE: dict[str, str] = {
    "op1_license_scan": r"""
with known(license, body) as (values
  ('Apache-2.0', 'licensed under the apache license version 2 0'),
  ('Apache-2.0', 'licensed under the apache license version 2 0 the license'),
  ('Apache-2.0', 'this work is licensed under the apache license version 2 0'),
  ('Apache-2.0', 'spdx license identifier apache 2 0'),
  ('MIT', 'released under the mit license'), ('MIT', 'licensed under the mit license'),
  ('MIT', 'this work is licensed under the mit license'), ('MIT', 'spdx license identifier mit'),
  ('GPL-3.0', 'this work is licensed under the gnu general public license version 3'),
  ('GPL-3.0', 'licensed under the gnu general public license version 3'),
  ('GPL-3.0', 'released under the gnu general public license version 3'),
  ('GPL-3.0', 'spdx license identifier gpl 3 0'),
  ('GPL-2.0', 'licensed under the gnu general public license version 2'),
  ('LGPL-3.0', 'licensed under the gnu lesser general public license version 3'),
  ('BSD-3-Clause', 'licensed under the bsd 3 clause license'), ('BSD-3-Clause', 'spdx license identifier bsd 3 clause'),
  ('MPL-2.0', 'licensed under the mozilla public license version 2 0'),
  ('CC-BY-4.0', 'this work is licensed under a creative commons attribution 4 0 international license'),
  ('CC-BY-4.0', 'this work is licensed under cc by 4 0'), ('CC-BY-4.0', 'licensed under cc by 4 0'),
  ('CC-BY-SA-4.0', 'licensed under cc by sa 4 0'),
  ('CC-BY-SA-4.0', 'this work is licensed under a creative commons attribution sharealike 4 0 international license'),
  ('CC-BY-NC-4.0', 'licensed under cc by nc 4 0'),
  ('CC-BY-NC-4.0', 'this work is licensed under a creative commons attribution noncommercial 4 0 international license'),
  ('CC0-1.0', 'this work is dedicated to the public domain'),
  ('LicenseRef-all-rights-reserved', 'all rights reserved')),
d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
l as (select rid, unnest(range(len(ls))) as n, unnest(ls) as raw from (select rid, string_split(t, chr(10)) as ls from d)),
spelt as (select rid, n, raw, lower(raw) as low, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(lower(raw),
  'licence', 'license'), 'licenced', 'licensed'), 'sub-license', 'sublicense'), 'non-commercial', 'noncommercial'),
  'https://', 'http://'), 'organisation', 'organization'), 'acknowledgement', 'acknowledgment'),
  'merchantibility', 'merchantability'), 'per cent', 'percent'), 'copyright owner', 'copyright holder'),
  '&', ' and ') as b from l),
line as (select rid, n, sum(case when regexp_full_match(raw, '[ \t\r]*') then 1 else 0 end) over (partition by rid order by n) as block,
         case when regexp_matches(low, '^[^\p{L}\p{N}]*(copyright|\(c\)|©)') then ''
         else trim(replace(replace(' ' || regexp_replace(b, '[^\p{L}\p{N}]+', ' ', 'g') || ' ', ' ver ', ' version '), ' ver ', ' version ')) end as f from spelt),
words as (select rid, n, block, f from line where f <> ''),
blocks as (select rid, block, string_agg(f, ' ' order by n) as f, count(*) over (partition by rid) as many from words group by rid, block),
form as (select rid, 'document' as kind, 0 as n, string_agg(f, ' ' order by n) as f from words group by rid
         union all select rid, 'block', block, f from blocks where many > 1
         union all select rid, 'line', n, f from (select *, count(*) over (partition by rid) as many from words) where many > 1),
hit as (select rid, kind, n, license from form join known on f = body and f <> ''),
agg as (select rid, min(case when kind = 'document' then license end) as whole_license,
        count(distinct kind || ':' || n) as n_matches,
        array_to_string(list_sort(list_distinct(list(license))), ',') as licenses from hit group by rid)
select doc_id, whole_license, coalesce(n_matches, 0) as n_matches, coalesce(licenses, '') as licenses
from d left join agg using (rid)""",
    "op10_quality_rules": rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, list_filter(string_split_regex(t, '{_WS}+'), lambda x: x <> '') as ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) as ls from d),
p as (select rid, unnest(ws) as x, unnest(range(len(ws))) as i from w),
g as (select rid, i, x || ' ' || lead(x, 1) over o || ' ' || lead(x, 2) over o || ' ' || lead(x, 3) over o || ' '
        || lead(x, 4) over o as gram from p window o as (partition by rid order by i)),
c as (select rid, i, count(*) over (partition by rid, gram) as n from g where gram is not null),
r as (select rid, count(distinct p) as n_repeat_words
      from (select rid, unnest(range(i, i + 5)) as p from c where n > 1) group by rid),
m as (select rid, doc_id, len(ws) as n_words, length(regexp_replace(t, '{_WS}', '', 'g')) as word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
      len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
      coalesce(n_repeat_words, 0) as n_repeat_words from w left join r using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 20 * n_symbols > word_chars or word_chars < 2 * n_words or word_chars > 20 * n_words
       or (n_lines >= 4 and 2 * n_dup_lines > n_lines)) as kept
from b""",
    "op11_filter_audit": rf"""
with recursive d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
w as (select *, list_filter(string_split_regex(t, '{_WS}+'), lambda x: x <> '') as ws,
      doc_id > min(doc_id) over (partition by t) as copy from d),
fails as (select doc_id, part,
      case when len(ws) < 50 then 'A' else '' end || case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 'B' else '' end
      || case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) then 'C' else '' end
      || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when copy then 'E' else '' end as f from w),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
          from labels group by doc_id),
cell as (select part, f, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
         from fails left join marks using (doc_id) group by part, f),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders(o) as (select '' union all select o || x from orders, letter where not contains(o, x)),
step as (select o, unnest(range(1, 6)) as s from orders where length(o) = 5),
judged as (select part, o, s, substr(o, s, 1) as x, f, n, good, toxic,
           list_min(list_transform(range(1, 6), lambda i: case when contains(f, substr(o, i, 1)) then i else 6 end)) as first
           from cell cross join step),
counts as (select part, o, s, x, sum(case when first > s then n else 0 end) as kept, sum(case when first = s then n else 0 end) as removed,
           sum(case when contains(f, x) and first < s then n else 0 end) as redundant, sum(case when f = x then n else 0 end) as unique_fails,
           sum(case when first = s then good else 0 end) as good_lost, sum(case when first = s then toxic else 0 end) as toxic_lost
           from judged group by part, o, s, x)
select part, o as filter_order, cast(s as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley
from counts""",
    "op12_source_divergence": r"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t from documents),
raw as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as r from d),
word as (select rid, lang, source, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from raw),
kept as (select lang, term, count(*) as total from word group by lang, term having count(distinct rid) >= 10),
used as (select lang, source, term, count(*) as n from word semi join kept using (lang, term) group by lang, source, term),
size as (select lang, source, sum(n) as n from used group by lang, source),
vocabulary as (select lang, count(*) as v, sum(total) as n from kept group by lang),
grp as (select lang, source, v, coalesce(s.n, 0) + 2 * v as den, l.n + 2 * v as lang_den
        from (select distinct lang, source from d) left join size s using (lang, source) left join vocabulary l using (lang)),
share as (select g.lang, g.source, k.term, u.n, 1 + (1000000000::hugeint * (coalesce(u.n, 0) + 2)) // g.den as p,
          1 + (1000000000::hugeint * (k.total + 2)) // g.lang_den as q
          from grp g join kept k on k.lang = g.lang left join used u on u.lang = g.lang and u.source = g.source and u.term = k.term),
far as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
        from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
part as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
         from grp a join grp b on a.lang = b.lang and a.source <> b.source
         left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source
         union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from share where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from part)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 10""",
    "op13_embedding_dedup": """
with recursive v as (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
good as (select rid, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
         where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
link as (select a.rid as x, b.rid as y from good a join good b on a.label = b.label and len(a.e) = len(b.e) and a.rid <> b.rid
         where a.norm > 0 and b.norm > 0
           and list_sum(list_transform(list_zip(a.e, b.e), lambda s: s[1] * s[2])) / (a.norm * b.norm) >= 0.98),
reach(x, y) as (select rid, rid from v union select r.x, l.y from reach r join link l on r.y = l.x),
low as (select x, min(vec_id) as component_id from reach join v on v.rid = y group by x),
degree as (select x, count(*) as n from link group by x)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id is not distinct from component_id as kept
from v join low on low.x = rid left join degree on degree.x = rid""",
}
