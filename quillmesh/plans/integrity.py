"""Queries about references between pages, raw documents and the deletion log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import orphans
from ..session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.wiki_orphans(table(spark, d, "wiki_pages"), table(spark, d, "raw_docs"), table(spark, d, "deletion_log"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("page_id", "ref_kind", "target").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


_MICROS = """case when {0} is null then null when regexp_matches(trim({0}), '[Tt ][0-9]{{1,2}}:') then
 epoch_us(try_cast(case when regexp_matches(trim({0}), '([Zz]|[+-][0-9]{{1,2}}:?[0-9]{{0,2}})$') then trim({0}) else trim({0}) || 'Z' end as timestamptz))
 else epoch_us(try_cast(trim({0}) as timestamp)) end"""
_RAW = r"regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^\./', ''), '^raw/', '')"
_URL = r"""case when regexp_matches({0}, '^(?i)https?://') then lower(regexp_extract({0}, '^((?i:https?)://[^/?#]*)', 1))
 || regexp_replace(regexp_extract({0}, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/$', '') || regexp_extract({0}, '^(?i:https?)://[^/?#]*[^?#]*(.*)$', 1) else {0} end"""
_REFS = f"""gone as (
 select tbl, case when tbl = 'raw_docs' then {_RAW.format('path')} else path end p, max(deleted_at) g from deletion_log group by 1, 2),
alive as (
 select 'page' kind, x.path p, null u, x.born from (select path, {_MICROS.format('created')} born from wiki_pages) x
  left join gone on gone.tbl = 'wiki_pages' and gone.p = x.path where g is null or (born is not null and epoch_us(g) < born)
 union all
 select 'raw', x.p, x.u, x.born from (select {_RAW.format('path')} p, {_URL.format('source_url')} u, epoch_us(downloaded_at) born from raw_docs) x
  left join gone on gone.tbl = 'raw_docs' and gone.p = x.p where g is null or (born is not null and epoch_us(g) < born)),
keys as (
 select 'page' kind, regexp_replace(p, '\\.md$', '') k, born from alive where kind = 'page'
 union all select 'page', regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.md$', ''), born from alive where kind = 'page'
 union all select 'raw_path', p, born from alive where kind = 'raw'
 union all select 'raw_url', u, born from alive where kind = 'raw'),
since as (select kind, k, min(coalesce(born, -9000000000000000)) s from keys where k is not null group by 1, 2),
times as (select page_id, links, sources, coalesce({_MICROS.format('updated')}, {_MICROS.format('created')}) ref_at from wiki_pages),
refs as (
 select page_id, 'link' ref_kind, t target, 'page' kind, regexp_replace(t, '\\.md$', '') k, ref_at from (select page_id, ref_at, unnest(links) t from times) where t is not null
 union all
 select page_id, 'source', t, case when regexp_matches(t, '^(?i)https?://') then 'raw_url' else 'raw_path' end,
  case when regexp_matches(t, '^(?i)https?://') then {_URL.format('t')} else {_RAW.format('t')} end, ref_at
 from (select page_id, ref_at, unnest(sources) t from times) where t is not null),
lost as (select refs.* from refs left join since on since.kind = refs.kind and since.k = refs.k where s is null or (ref_at is not null and s > ref_at))"""

QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
ORACLE = {
    "p6_found": f"with {_REFS} select distinct page_id, ref_kind, target from lost",
    "p6_report": f"""with {_REFS} select ref_kind, strftime(date_trunc('month', make_timestamp(ref_at)), '%Y-%m-%d') period,
 count(*) n_refs, count(distinct k) n_targets, count(distinct page_id) n_pages from lost group by 1, 2""",
}
