"""Queries over pages: sections, windows, links, graph, catalogue, timeline, lint; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages as pg
from ..session import table

NOW = 1767225600000000  # 2026-01-01


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wiki_pages")


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    return pg.sections(pages(spark, d))


def page_toc(spark: SparkSession, d: str) -> DataFrame:
    return pg.toc(pg.sections(pages(spark, d)))


def page_section_read(spark: SparkSession, d: str) -> DataFrame:
    return pg.section_read(pg.sections(pages(spark, d)), "## how the")


def page_window(spark: SparkSession, d: str) -> DataFrame:
    return pg.line_window(pages(spark, d), 2, 5)


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.posexplode(pg.wiki_links(F.col("content"))).alias("pos", "link"))


def page_broken_links(spark: SparkSession, d: str) -> DataFrame:
    return pg.broken_links(pages(spark, d))


def page_orphans(spark: SparkSession, d: str) -> DataFrame:
    return pg.orphan_pages(pages(spark, d))


def page_edges(spark: SparkSession, d: str) -> DataFrame:
    return pg.link_edges(pages(spark, d))


def page_graph(spark: SparkSession, d: str) -> DataFrame:
    return pg.link_graph(pages(spark, d))


def page_directories(spark: SparkSession, d: str) -> DataFrame:
    return pg.directories(pages(spark, d))


def page_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return pg.catalogue(pages(spark, d))


def page_listing(spark: SparkSession, d: str) -> DataFrame:
    return pg.listing(pages(spark, d))


def page_timeline(spark: SparkSession, d: str) -> DataFrame:
    return pg.timeline(pages(spark, d))


def page_list(spark: SparkSession, d: str) -> DataFrame:
    return pg.list_pages(pages(spark, d), "concept", "ledger-close")


def page_glob(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_docs")
    path = F.col("path")
    return r.select("raw_id", *[pg.glob(path, g).alias(n) for n, g in (("pdf", "*.pdf"), ("office", "*.{docx, xlsx,PPTX}"), ("deep", "**/*.md"))])


def page_lint(spark: SparkSession, d: str) -> DataFrame:
    return pg.lint(pages(spark, d), NOW)


def page_lint_counts(spark: SparkSession, d: str) -> DataFrame:
    return pg.lint(pages(spark, d), NOW).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("n_pages"))


def page_fixed_titles(spark: SparkSession, d: str) -> DataFrame:
    return pg.fixed_titles(pages(spark, d))


def page_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Pages within two undirected steps of the page with the most links."""
    from ..operators import graph

    edges = pg.link_edges(pages(spark, d)).where("not broken")
    busiest = pg.link_graph(pages(spark, d)).where("not broken").orderBy(F.desc("degree"), "id").limit(1)
    return graph.neighbourhood(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")), busiest.select("id"), 2)


_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')"
_SLUG = r"regexp_replace(path, '\.md$', '')"
_SYS = "(path in ('index.md', 'log.md', 'timeline.md', 'evidence-report.md') or ends_with(path, '/index.md'))"
_LINES = r"""l0 as (select path, generate_subscripts(l, 1) n, unnest(l) line from (select path, string_split(content, chr(10)) l from wiki_pages where content is not null)
 union all select path, 0, null from wiki_pages where content is not null),
l1 as (select *, case when sum(case when n = 1 and trim(line) = '---' then 1 else 0 end) over (partition by path) = 1
 and n >= 1 and sum(case when trim(line) = '---' then 1 else 0 end) over (partition by path order by n) - case when trim(line) = '---' then 1 else 0 end < 2 then 1 else 0 end front from l0),
l2 as (select *, case when front = 0 and regexp_matches(line, '^(`{3,}|~{3,})') then 1 else 0 end fence from l1),
l3 as (select *, sum(fence) over (partition by path order by n) % 2 coded from l2),
l4 as (select *, case when front = 0 and coded = 0 and fence = 0 and regexp_matches(line, '^#{1,6}\s+') then 1 else 0 end head from l3),
l5 as (select *, sum(head) over (partition by path order by n) pos from l4),
sections as (select path, pos::int pos, coalesce(max(case when head = 1 then regexp_replace(line, '\s+$', '') end), '') heading,
 coalesce(max(case when head = 1 then length(regexp_extract(line, '^(#{1,6})', 1)) end), 0)::int "level", coalesce(string_agg(line, chr(10) order by n), '') content from l5 group by 1, 2)"""
_KEYS = f"keys as (select 'p:' || path k from wiki_pages union select 's:' || {_STEM} from wiki_pages)"
_UNRES = r"""not exists (select 1 from keys where k = 'p:' || regexp_replace({0}, '\.md$', '') || '.md') and not exists (select 1 from keys where k = 'p:' || {0})
 and not exists (select 1 from keys where k = 's:' || {0}) and not exists (select 1 from keys where k = 's:' || regexp_replace({0}, '\.md$', ''))"""
_REFS = "refs as (select path, unnest(links) link from wiki_pages)"
_BROKEN = f"{_KEYS}, {_REFS}, broken as (select path, link from refs where link is not null and {_UNRES.format('link')})"
_ORPH = f"""named as (select path, {_STEM} link from wiki_pages where not {_SYS} union select path, {_SLUG} from wiki_pages where not {_SYS}),
orph as (select path from wiki_pages where not {_SYS} and path not in (select n.path from named n join (select path src, unnest(links) link from wiki_pages) l on l.link = n.link and l.src <> n.path))"""
_EDGES = rf"""base as (select {_STEM} b, min({_SLUG}) s from wiki_pages group by 1 having count(*) = 1), slugs as (select distinct {_SLUG} s from wiki_pages),
er as (select {_SLUG} source, link, regexp_replace(link, '\.md$', '') bare from (select path, unnest(links) link from wiki_pages) where link is not null),
ee as (select source, link, coalesce(slugs.s, base.s) t from er left join slugs on slugs.s = bare left join base on base.b = bare),
edges as (select source, coalesce(t, '__broken__:' || link) target, t is null broken from ee where source <> coalesce(t, '__broken__:' || link))"""
_GRAPH = f"""{_EDGES}, nodes as (select {_SLUG} id, path, title, type, case when contains(path, '/') then split_part(path, '/', 1) else '' end topic, false broken from wiki_pages
 union all select distinct target, substr(target, 12), substr(target, 12), 'broken', '', true from edges where broken),
graph as (select n.*, coalesce(i.c, 0) in_degree, coalesce(o.c, 0) out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) degree, coalesce(i.c, 0) = 0 and not n.broken orphan from nodes n
 left join (select target, count(*) c from edges group by 1) i on i.target = n.id left join (select source, count(*) c from edges group by 1) o on o.source = n.id)"""
_MICROS = """case when regexp_matches(trim({0}), '[Tt ][0-9]{{1,2}}:') then
 epoch_us(try_cast(case when regexp_matches(trim({0}), '([Zz]|[+-][0-9]{{1,2}}:?[0-9]{{0,2}})$') then trim({0}) else trim({0}) || 'Z' end as timestamptz)) else epoch_us(try_cast(trim({0}) as timestamp)) end""".format("updated")
_DAY = "case when updated is not null then ' _(' || substr(updated, 1, 10) || ')_' else '' end"
_LINT = f"""{_BROKEN}, {_ORPH}, der as (select path, src from (select path, unnest(derived_from) src from wiki_pages where type = 'synthesis') where src is not null),
age as (select path, floor(({NOW} - ({_MICROS})) / 86400000000.0)::bigint age from wiki_pages),
lint as (select 'warning' severity, path page, 'No front matter' message, 'Give the page a title, type, tags and sources' suggestion, true auto_fixable, 'structure' category from wiki_pages where coalesce(cardinality(frontmatter), 0) = 0
 union all select 'warning', path, 'The title is empty or only the file name', 'Write a title into the front matter', false, 'structure' from wiki_pages where title is null or title = '' or title = {_STEM}
 union all select 'warning', path, 'No page links here', 'Link [[' || {_SLUG} || ']] where it belongs', true, 'orphan' from orph
 union all select 'error', path, 'Broken link: [[' || link || ']]', 'Create ' || link || '.md or fix the link', false, 'broken-link' from broken
 union all select 'info', path, 'The page names no source', 'Name the raw documents behind it', false, 'missing-source' from wiki_pages where not {_SYS} and coalesce(len(sources), 0) = 0 and type is not null and type not in ('', 'index', 'log', 'timeline')
 union all select 'error', path, 'Derived from a page that is gone: ' || src, 'Look for what replaced it', false, 'integrity' from der where {_UNRES.format('src')}
 union all select 'info', path, 'Last updated days ago: ' || age, 'Read it again', false, 'stale' from age where age > 30)"""

QUERIES = {
    f.__name__: f
    for f in (
        page_sections, page_toc, page_section_read, page_window, page_links, page_broken_links, page_orphans, page_edges, page_graph, page_directories, page_catalogue, page_listing, page_timeline,
        page_list, page_glob, page_lint, page_lint_counts, page_fixed_titles, page_neighbourhood,
    )
}
ORACLE = {
    "page_sections": f"with {_LINES} select * from sections",
    "page_toc": f"""with {_LINES}, h as (select *, min("level") over (partition by path) m from sections where heading <> '') select path, string_agg(repeat('  ', "level" - m) || heading, chr(10) order by pos) toc from h group by 1""",
    "page_section_read": rf"""with {_LINES}, hit as (select path, min(pos) p from sections where contains(trim(regexp_replace(lower(heading), '^#{{1,6}}\s*', '')), 'how the') group by 1),
 t as (select h.path, h.p, s."level" lv, s.heading th from hit h join sections s on s.path = h.path and s.pos = h.p),
 e as (select t.*, (select min(s.pos) from sections s where s.path = t.path and s.pos > t.p and s."level" <= t.lv and s.heading <> '') stop from t),
 c as (select e.path, th heading, string_agg(s.content, chr(10) order by s.pos) content from e join sections s on s.path = e.path and s.pos >= e.p and (stop is null or s.pos < stop) group by 1, 2)
 select path, heading, content, len(string_split(content, chr(10)))::int total_lines from c""",
    "page_window": """with l as (select path, string_split(content, chr(10)) l from wiki_pages where content is not null)
 select path, array_to_string(l[3:7], chr(10)) content, 2::int "offset", len(l[3:7])::int lines_returned, len(l)::int total_lines, len(l) > 7 truncated, case when len(l) > 7 then 7 end::int next_offset from l""",
    "page_links": r"""with x as (select page_id, regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1) l from wiki_pages) select page_id, (generate_subscripts(l, 1) - 1)::int pos, trim(split_part(unnest(l), '|', 1)) link from x""",
    "page_broken_links": f"with {_BROKEN} select * from broken",
    "page_orphans": f"with {_ORPH} select path from orph",
    "page_edges": f"with {_EDGES} select * from edges",
    "page_graph": f"with {_GRAPH} select * from graph",
    "page_directories": "with p as (select string_split(path, '/') p from wiki_pages), d as (select array_to_string(p[:i], '/') dir, i from p, unnest(range(1, len(p))) t(i)) select distinct dir, i::int depth from d",
    "page_catalogue": f"with p as (select string_split(path, '/') p from wiki_pages where not {_SYS}), d as (select case when i = 0 then '' else array_to_string(p[:i], '/') end dir from p, unnest(range(0, len(p))) t(i)) select dir, count(*) n_pages from d group by 1",
    "page_listing": f"""select case when contains(path, '/') then split_part(path, '/', 1) else '' end topic, coalesce(type, 'uncategorized') "type", count(*) n_pages,
 string_agg('- [[' || {_STEM} || ']] — ' || coalesce(title, '') || {_DAY}, chr(10) order by path) listing from wiki_pages where not {_SYS} group by 1, 2""",
    "page_timeline": f"""select substr(coalesce(created, updated, 'unknown'), 1, 10) "date", count(*) n, string_agg('- **[' || coalesce(type, 'note') || ']** [[' || {_SLUG} || ']] — ' || coalesce(title, ''), chr(10) order by path) entries from wiki_pages where not {_SYS} group by 1""",
    "page_list": "select path, title, type from wiki_pages where type = 'concept' and list_contains(tags, 'ledger-close')",
    "page_glob": r"select raw_id, ends_with(lower(path), '.pdf') pdf, regexp_matches(lower(path), '[^/]\.(docx|xlsx|pptx)$') office, ends_with(lower(path), '.md') deep from raw_docs",
    "page_lint": f"with {_LINT} select * from lint",
    "page_lint_counts": f"with {_LINT} select category, severity, count(*) n, count(distinct page) n_pages from lint group by 1, 2",
    "page_fixed_titles": f"""select path, array_to_string(list_transform(string_split(replace({_STEM}, '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') title from wiki_pages where coalesce(cardinality(frontmatter), 0) = 0""",
    "page_neighbourhood": f"""with {_GRAPH}, b as (select id from graph where not broken order by degree desc, id limit 1), u as (select source s, target t from edges where not broken union select target, source from edges where not broken),
 one as (select distinct t id from u where s in (select id from b)), two as (select distinct t id from u where s in (select id from one)),
 a as (select id, 0 depth from b union all select id, 1 from one union all select id, 2 from two) select id, min(depth)::int depth from a group by 1""",
}
