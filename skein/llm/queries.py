"""The opN_ queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, language_id, line_dedup, mixing, near_dedup, secrets, suffix_dedup, token_counts, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return secrets.scan_report(_table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every fiftieth."""
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after redaction, counted by edits."""
    return token_counts.report(_table(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that repeat an earlier line, or nearly."""
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_id.report(_table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_dedup.report(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings that start earlier, too."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every document in the mix, and whether it is kept."""
    return mixing.report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_neighbours": op2_neighbours,
    "op3_tokens": op3_tokens,
    "op4_lines": op4_lines,
    "op5_urls": op5_urls,
    "op6_languages": op6_languages,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_decontamination": op8_decontamination,
    "op9_repeats": op9_repeats,
    "op10_mixing": op10_mixing,
}

#: A-Z lower-cased, words as a list.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_lines": r"""
with t as (select doc_id, coalesce(text, '') as text, case when coalesce(text, '') = '' then [] else string_split(text, chr(10)) end as ls from documents),
l as (select *, row_number() over (order by doc_id, k) as r from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as k from t) x),
w as (select *, list_filter(string_split_regex(line, '[ \t\n\r\x0b\f]+'), lambda x: x <> '') as ws from l),
s as (select *, len(ws) as n, array_to_string(ws, ' ') as same, array_to_string(ws, '') as cs from w),
f as (select same, any_value(ws) as ws, any_value(n) as n, any_value(cs) as cs, min(r) as r from s group by same),
v as (select r, i, array_to_string(list_concat(ws[:i - 1], ws[i + 1:]), ' ') as d from (select r, ws, unnest(range(1, n + 1)) as i from f where n >= 8) y),
c as (select cs, r from f where n < 8 and length(cs) >= 20),
x as (select r, i, substring(cs, 1, i - 1) || substring(cs, i + 1) as d from (select r, cs, unnest(range(1, length(cs) + 1)) as i from c) y),
near as (select r from (select r, min(r) over (partition by i, d) as least from v) z where r > least
  union select greatest(f.r, v.r) from f join v on f.same = v.d and f.n >= 8
  union select r from (select r, min(r) over (partition by i, d) as least from x) z where r > least
  union select r from (select r, min(r) over (partition by cs) as least from c) z where r > least
  union select greatest(c.r, x.r) from c join x on c.cs = x.d),
gone as (select s.r from s join f on s.same = f.same where s.n >= 1 and (s.r > f.r or s.r in (select r from near)))
select t.doc_id, len(t.ls) as n_lines, count(gone.r) as n_dropped, coalesce(string_agg(l.line, chr(10) order by l.k) filter (where gone.r is null), '') as text
from t left join l on t.doc_id = l.doc_id left join gone on l.r = gone.r group by t.doc_id, t.ls""",
    "op8_decontamination": f"""
with i as (select item_id, ws, least(10, len(ws)) as n from (select item_id, {_WORDS} as ws from benchmark) x where len(ws) > 0),
win as (select distinct item_id, n, array_to_string(ws[p:p + n - 1], ' ') as win from (select *, unnest(range(1, len(ws) - n + 2)) as p from i) y),
d as (select doc_id, {_WORDS} as ws from documents),
dw as (select doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') as win from (select doc_id, ws, n, unnest(range(1, len(ws)::bigint - n + 2)) as p from d, (select distinct n from win) s) z),
hit as (select doc_id, dw.p, dw.n, item_id from dw join win on dw.n = win.n and dw.win = win.win),
words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hit) h group by 1),
items as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as ids from (select distinct doc_id, item_id::varchar as k from hit) g group by 1)
select d.doc_id, len(d.ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
}
