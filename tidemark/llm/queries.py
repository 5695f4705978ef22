"""The registered query of each corpus operator, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, minhash, mixing, quality_crf, quality_rules, token_counts, toxicity, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as gram from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
c as (select rid, i, count(*) over (partition by rid, gram) as n from g),
r as (select rid, count(distinct i + k) as repeated from c cross join (select unnest([0, 1, 2]) as k) where n > 1 group by 1),
f as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(repeated, 0)::bigint as n_repeat_words, len(ls) as n_lines, len(list_distinct(ws)) as kinds,
  length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) as upper, len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) as lettered,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) as bullets from w left join r using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or 10 * n_symbols > 3 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words
  or (n_dup_lines > 2 and 2 * n_dup_lines > n_lines) or 3 * upper > word_chars or 10 * kinds < n_words
  or 10 * lettered < 3 * n_words or (n_lines > 3 and 10 * bullets > 9 * n_lines)) as kept from b
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_removed").alias("n_removed"), "text")


OP2_SQL = line_dedup.LINE_DEDUP_SQL.format(docs="documents") + """
select r.doc_id, coalesce(n.n_lines, 0)::bigint as n_lines, coalesce(n.n_bad, 0)::bigint as n_removed, case when n.n_bad > 0 then n.clean else r.text end as text
from ld_rows r left join ld_new n using (ld_row)
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as shingle from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
e as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by 1, 2)
  join n p on p.doc_id = a join n q on q.doc_id = b where 100 * shared >= 85 * (p.n + q.n - shared)),
r(doc_id, seen) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.seen = e.a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least_id as component_id, d.doc_id = least_id as kept
from documents d left join n using (doc_id) join (select doc_id, min(seen) as least_id from r group by 1) using (doc_id)
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_crf.score_quality(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express: host, path and rule of every page."""
    rows = url_filter.parse(table(spark, sf_dir, "pages"), "page_id", "url", url_filter.RULES)
    return rows.select(F.col("id").alias("page_id"), "host", "path", "rule")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op4_decontaminate, op5_url_filter, op3_token_counts, op6_minhash, op7_warc, op8_mixing, op9_toxicity, op10_quality_crf, url_rules)}
SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op2_line_dedup": OP2_SQL, "op6_minhash": OP6_SQL, "op7_warc": warc.ROUND_TRIP_SQL, "url_rules": url_filter.RULES_SQL}
