"""Queries over raw documents, extraction results and claims, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as cl
from ..operators import extract as ex
from ..operators import raw as rw
from ..session import table
from .wiki import _LINES


def raw_versions(spark: SparkSession, d: str) -> DataFrame:
    return rw.versions(table(spark, d, "raw_docs"))


def raw_next_versions(spark: SparkSession, d: str) -> DataFrame:
    return rw.next_versions(table(spark, d, "raw_docs"))


def raw_mime(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_docs").select("raw_id", rw.mime_of(F.col("path")).alias("mime"))


def raw_uncovered(spark: SparkSession, d: str) -> DataFrame:
    return rw.uncovered(table(spark, d, "raw_docs"), table(spark, d, "wiki_pages")).select("raw_id", "path")


def raw_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rw.coverage(table(spark, d, "raw_docs"), table(spark, d, "wiki_pages")).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


def raw_coverage_tag(spark: SparkSession, d: str) -> DataFrame:
    return rw.coverage(table(spark, d, "raw_docs"), table(spark, d, "wiki_pages"), "wiki-care").withColumn("coverage_ratio", F.round("coverage_ratio", 6))


def raw_uncovered_largest(spark: SparkSession, d: str) -> DataFrame:
    return rw.uncovered_page(table(spark, d, "raw_docs"), table(spark, d, "wiki_pages"), "largest", 50)


def raw_state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(files, cache): the bodies with a sidecar hash of which every seventh is wrong, every fifth missing, every third cached."""
    r = table(spark, d, "raw_docs").where("body is not null")
    n = F.col("raw_id")
    good = F.sha2(F.col("body").cast("binary"), 256)
    files = r.select(
        F.col("raw_id").cast("string").alias("path"), F.col("body").cast("binary").alias("content"), F.lit(1.0).alias("mtime"), F.col("size"),
        F.when(n % 5 != 0, 2.0).alias("meta_mtime"), F.when(n % 7 == 0, F.lit("0")).otherwise(good).alias("sha256"),
    )
    cache = r.where("raw_id % 3 = 0").select(F.col("raw_id").cast("string").alias("path"), F.lit(1.0).alias("file_mtime"), F.col("size").alias("file_size"), F.lit(2.0).alias("meta_mtime"), F.lit("ok").alias("status"))
    return files, cache


def raw_verify(spark: SparkSession, d: str) -> DataFrame:
    """Integrity of the bodies against their sidecar hashes."""
    return rw.verify(*raw_state(spark, d))


def raw_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_docs").where("body is not null").select("raw_id", F.sha2("body", 256).alias("sha"), F.length("body").cast("long").alias("n"))


def raw_line_read(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_docs")
    return rw.line_read(r.select(F.col("raw_id").cast("string").alias("path"), "body"), 1, 3)


def raw_text_read(spark: SparkSession, d: str) -> DataFrame:
    return rw.text_read(table(spark, d, "raw_docs"), 300)


def extract_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wiki_pages").select("page_id", F.sha2(ex.html_text(F.col("content")), 256).alias("sha"))


def extract_ranges(spark: SparkSession, d: str) -> DataFrame:
    ranges = ["1-3,7-10", "2", "5-2", "x,3-", " 4 - 6 ,9", "0,1", "30-40", "2,2-3", ""]
    text = F.element_at(F.array(*map(F.lit, ranges)), (F.col("page") % len(ranges) + 1).cast("int"))
    return table(spark, d, "segments").where("page is not null").select("seg_id", ex.page_range(text, F.col("page") + 4).alias("pages"))


def extract_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ex.chunks(table(spark, d, "segments"), 10)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    c = ex.chunks(table(spark, d, "segments"), 10)
    return ex.packs(c.withColumn("topic", F.substring_index("file", "/", 1)), 40)


def extract_packs(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def extract_pack_report(spark: SparkSession, d: str) -> DataFrame:
    return ex.pack_report(_packed(spark, d))


def extract_flat(spark: SparkSession, d: str) -> DataFrame:
    return ex.flat_text(table(spark, d, "segments")).select("file", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("n"))


def extract_topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_docs").select("raw_id", ex.topic_slug(F.col("path")).alias("topic"))


def extract_semantic(spark: SparkSession, d: str) -> DataFrame:
    return ex.semantic_segments(table(spark, d, "wiki_pages"))


def claim_dates(spark: SparkSession, d: str) -> DataFrame:
    return cl.date_claims(table(spark, d, "wiki_pages"))


def claim_numbers(spark: SparkSession, d: str) -> DataFrame:
    return cl.number_claims(table(spark, d, "wiki_pages"))


def _step_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of this corpus that repeat over pages: the number a program stands with."""
    pages = table(spark, d, "wiki_pages")
    found = pages.select(F.col("path").alias("page"), F.posexplode(F.regexp_extract_all("content", F.lit(r"the \w+ of step \d+"), F.lit(0))).alias("pos", "excerpt"))
    raw = F.regexp_extract("excerpt", r"(\d+)$", 1)
    return found.select("page", F.col("pos").cast("int").alias("pos"), F.regexp_replace("excerpt", r"\d+$", "n").alias("key"), "excerpt", raw.cast("double").alias("value"), raw.alias("raw_value"))


def claim_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return cl.contradictions(_step_claims(spark, d), table(spark, d, "wiki_pages"))


def claim_contradictions_all(spark: SparkSession, d: str) -> DataFrame:
    """Contradictions of all date and number claims."""
    pages = table(spark, d, "wiki_pages")
    return cl.contradictions(cl.all_claims(pages), pages)


def page_types(spark: SparkSession, d: str) -> DataFrame:
    return cl.classify(table(spark, d, "wiki_pages").withColumn("type", F.when(F.col("page_id") % 2 == 0, F.col("type"))))


def page_enriched(spark: SparkSession, d: str) -> DataFrame:
    return cl.enriched(table(spark, d, "wiki_pages").withColumn("type", F.when(F.col("page_id") % 2 == 0, F.col("type"))))


def page_routes(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import pages as pg

    pages = table(spark, d, "wiki_pages")
    return cl.route(pages, pg.directories(pages))


def page_write_kinds(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "wiki_pages")
    return cl.classify_writes(pages, pages.where("page_id % 2 = 0"))


def page_auto_links(spark: SparkSession, d: str) -> DataFrame:
    return cl.auto_links(table(spark, d, "wiki_pages")).select("path", "links_added", F.sha2("content", 256).alias("sha"))


_RAW = r"regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^\./', ''), '^raw/', '')"
_URL = r"""case when regexp_matches({0}, '^(?i)https?://') then lower(regexp_extract({0}, '^((?i:https?)://[^/?#]*)', 1))
 || regexp_replace(regexp_extract({0}, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/$', '') || regexp_extract({0}, '^(?i:https?)://[^/?#]*[^?#]*(.*)$', 1) else {0} end"""
_VERS = r"""p as (select distinct path, regexp_extract(path, '[^/](\.[^./]*)$', 1) ext from raw_docs where path is not null), b as (select *, substr(path, 1, length(path) - length(ext)) base from p),
n as (select *, regexp_extract(base, '^.+_v(\d+)$', 1) v from b),
v as (select path, case when v <> '' then regexp_extract(base, '^(.+)_v\d+$', 1) else base end root, ext, case when v <> '' then v::int else 1 end "version" from n)"""
_COV = rf"""keys as (select case when regexp_matches(t, '^(?i)https?://') then 'u:' || {_URL.format('t')} else 'p:' || {_RAW.format('t')} end k from (select regexp_replace(unnest(sources), '^\s+|\s+$', '', 'g') t from wiki_pages)
 union select 'p:' || x from (select regexp_replace(unnest(regexp_extract_all(content, '\braw/(\S+)', 1)), '[.,;:!?)\]`"''*]+$', '') x from wiki_pages) where x <> ''),
cov as (select * from raw_docs where not starts_with({_RAW.format('path')}, 'parsed/')),
unc as (select * from cov where 'p:' || {_RAW.format('path')} not in (select k from keys where k is not null) and (source_url is null or 'u:' || {_URL.format('trim(source_url)')} not in (select k from keys where k is not null)))"""
_CHUNK = r"""l as (select seg_id, file, seg_no, column_headers h, string_split(text, chr(10)) l from segments where text is not null),
c as (select seg_id, file, seg_no, h, i::int chunk_no, array_to_string(l[i * 10 + 1: i * 10 + 10], chr(10)) body from l, unnest(range(0, ((len(l) - 1) // 10) + 1)) t(i)),
chunk as (select seg_id, file, seg_no, chunk_no, case when chunk_no > 0 and coalesce(h, '') <> '' then h || chr(10) || body else body end text from c),
chunks as (select *, len(string_split(text, chr(10)))::int n_lines from chunk)"""
_PACK = f"""{_CHUNK}, o as (select *, split_part(file, '/', 1) topic, row_number() over (partition by split_part(file, '/', 1) order by file, seg_no, seg_id, chunk_no) rn from chunks),
walk as (select file, rn, topic, seg_id, chunk_no, 1 pack_no, n_lines used from o where rn = 1 union all
 select o.file, o.rn, o.topic, o.seg_id, o.chunk_no, case when used + n_lines > 40 and used > 0 then pack_no + 1 else pack_no end, case when used + n_lines > 40 and used > 0 then n_lines else used + n_lines end from walk join o on o.topic = walk.topic and o.rn = walk.rn + 1)"""


def _score(words: list[str]) -> str:
    return "2 * len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(t, w)))"


_NUM = cl.NUMBER_CLAIM.replace("(?![a-z0-9_])", r"\b")
_TYPES = list(cl.TYPE_WORDS)
_CLASS = f"""w as (select *, case when page_id % 2 = 0 then type end ty, lower(coalesce(title, '')) || ' ' || lower(coalesce(content, '')) t, lower(coalesce(content, '')) b from wiki_pages),
s as (select *, (length(b) - length(replace(b, '```', ''))) / 3 / 2 f, length(b) - length(replace(b, '|', '')) p from w),
k as (select *, [{', '.join(_score(v) + (" + case when f >= 1 then 2 else 0 end + case when f >= 3 then 3 else 0 end" if n == 'code' else " + case when p > 15 then 3 else 0 end" if n == 'comparison' else '') for n, v in cl.TYPE_WORDS.items())}] sc from s),
m as (select *, list_max(sc) best, list_distinct([]::varchar[]) e, [{', '.join(f"struct_pack(k := '{a}', v := '{b}')" for a, b in cl.TAG_WORDS.items())}] tt from k),
d as (select *, list_transform(list_filter(tt, lambda x: contains(t, x.k)), lambda x: x.v) dup from m),
g as (select *, list_transform(list_filter(range(1, len(dup) + 1), lambda i: list_position(dup, dup[i]) = i), lambda i: dup[i]) found, coalesce(ty, '') not in ('', 'note') known, coalesce(tags, []) own from d),
cls as (select path, ty, own, case when known then ty when best > 0 then (['{"', '".join(_TYPES)}'])[list_position(sc, best)] else 'note' end "type",
 case when known then 1.0 when best > 0 then least(best / 10, 1.0) else 0.3 end confidence, case when known and len(own) > 0 then own else found end tags from g)"""

QUERIES = {
    f.__name__: f
    for f in (
        raw_versions, raw_next_versions, raw_mime, raw_uncovered, raw_coverage, raw_coverage_tag, raw_uncovered_largest, raw_verify, raw_hash, raw_line_read, raw_text_read, extract_html, extract_ranges,
        extract_chunks, extract_packs, extract_pack_report, extract_flat, extract_topics, extract_semantic, claim_dates, claim_numbers, claim_contradictions, claim_contradictions_all, page_types, page_enriched, page_routes,
        page_write_kinds, page_auto_links,
    )
}
_SYS = "(path in ('index.md', 'log.md', 'timeline.md', 'evidence-report.md') or ends_with(path, '/index.md'))"
ORACLE = {
    "raw_versions": f"with {_VERS} select *, row_number() over (partition by root, ext order by \"version\" desc, path desc) = 1 latest from v",
    "raw_next_versions": f"with {_VERS} select root, ext, root || '_v' || (max(\"version\") + 1) || ext next_path from v group by root, ext",
    "raw_mime": f"with m(e, t) as (values {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)})' for k, v in rw.MIME.items())}) select raw_id, coalesce(t, '{rw.OTHER_MIME}') mime from raw_docs left join m on e = regexp_extract(lower(path), '[^/]\\.([^./]*)$', 1)",
    "raw_uncovered": f"with {_COV} select raw_id, path from unc",
    "raw_coverage": f"with {_COV}, n as (select (select count(*) from cov) t, (select count(*) from unc) u) select t total_raw, t - u covered_raw, u uncovered_raw, round(case when t > 0 then (t - u) / t else 1 end, 6) coverage_ratio from n",
    "raw_coverage_tag": f"with {_COV}, n as (select (select count(*) from cov where list_contains(tags, 'wiki-care')) t, (select count(*) from unc where list_contains(tags, 'wiki-care')) u) select t total_raw, t - u covered_raw, u uncovered_raw, round(case when t > 0 then (t - u) / t else 1 end, 6) coverage_ratio from n",
    "raw_uncovered_largest": f"with {_COV} select raw_id, path, size, mime_type, downloaded_at, source_url from unc order by size desc nulls last, raw_id limit 50",
    "raw_verify": """select raw_id::varchar path, case when raw_id % 5 = 0 then 'missing-meta' when raw_id % 3 = 0 then 'ok' when raw_id % 7 = 0 then 'corrupted' else 'ok' end status,
 raw_id % 5 <> 0 and not (raw_id % 3 = 0 and size is not null) hashed from raw_docs where body is not null""",
    "raw_hash": "select raw_id, sha256(body) sha, length(body) n from raw_docs where body is not null",
    "raw_line_read": """with l as (select raw_id::varchar path, string_split(body, chr(10)) l from raw_docs where body is not null)
 select path, array_to_string(l[2:4], chr(10)) content, 1::int "offset", len(l[2:4])::int lines_returned, len(l)::int total_lines, len(l) > 4 truncated, case when len(l) > 4 then 4 end::int next_offset from l""",
    "raw_text_read": "select raw_id, substr(body, 1, 300) content, length(body) > 300 truncated from raw_docs where body is not null",
    "extract_html": r"""select page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) sha from wiki_pages""",
    "extract_chunks": f"with {_CHUNK} select seg_id, file, seg_no, chunk_no, text, n_lines from chunks",
    "extract_packs": f"with recursive {_PACK} select topic, file, seg_id, chunk_no, pack_no from walk",
    "extract_pack_report": f"with recursive {_PACK} select topic, pack_no, count(*) chunks, count(distinct seg_id) segments, count(distinct file) files from walk group by 1, 2",
    "extract_flat": """with p as (select file, seg_no, seg_id, case when sheet is not null then '--- Sheet: ' || sheet || ' ---' || chr(10) || text when slide is not null then '--- Slide ' || slide || ' ---' || chr(10) || text else text end p from segments where text is not null),
 t as (select file, string_agg(p, chr(10) || chr(10) order by seg_no, seg_id) t from p where p is not null group by 1) select file, sha256(t) sha, length(t) n from t""",
    "extract_topics": r"""select raw_id, case when path is not null and path <> '' and not contains(path, '..') and not starts_with(path, '/') and not starts_with(path, chr(92)) then
 regexp_replace(regexp_replace(regexp_replace(path, '[^a-zA-Z0-9_\-/]', '-', 'g'), '/{2,}', '/', 'g'), '^/|/$', '', 'g') end topic from raw_docs""",
    "extract_ranges": r"""with t as (select seg_id, page + 4 total, (['1-3,7-10', '2', '5-2', 'x,3-', ' 4 - 6 ,9', '0,1', '30-40', '2,2-3', ''])[page % 9 + 1] txt from segments where page is not null),
 p as (select *, list_filter(string_split(txt, ','), lambda p: regexp_matches(p, '^\s*\d{1,9}(\s*-\s*\d{1,9})?\s*$')) ps from t)
 select seg_id, list_sort(list_distinct(flatten(list_transform(ps, lambda p: range(greatest(1, regexp_extract(p, '^\s*(\d+)', 1)::int) - 1,
 least(total, case when regexp_extract(p, '-\s*(\d+)\s*$', 1) <> '' then regexp_extract(p, '-\s*(\d+)\s*$', 1)::int else regexp_extract(p, '^\s*(\d+)', 1)::int end))))))::int[] pages from p""",
    "extract_semantic": f"""with {_LINES}, f as (select *, count(*) over (partition by path) n from sections where trim(content) <> '')
 select path, pos part, content text from f where n > 1 union all select path, 0, content from wiki_pages where content is not null and path not in (select path from f where n > 1)""",
    "claim_dates": rf"""with x as (select path page, regexp_extract_all(content, '{cl.DATE_CLAIM}') l from wiki_pages where not {_SYS}), e as (select page, (generate_subscripts(l, 1) - 1)::int pos, unnest(l) excerpt from x)
 select page, pos, trim(lower(regexp_replace(excerpt, '\d{{4}}(?:-\d{{2}}-\d{{2}})?', 'YEAR', 'g'))) "key", excerpt, substr(regexp_extract(excerpt, '\d{{4}}(?:-\d{{2}}-\d{{2}})?'), 1, 4)::double "value", regexp_extract(excerpt, '\d{{4}}(?:-\d{{2}}-\d{{2}})?') raw_value from e""",
    "claim_numbers": rf"""with x as (select path page, content c, string_split_regex(content, '{_NUM}') g, regexp_extract_all(content, '{_NUM}', 0) h from wiki_pages where content is not null and not {_SYS}),
 y as (select page, c, g, h, unnest(range(1, len(h) + 1)) i from x), z as (select page, c, i, h[i] h, coalesce(list_sum(list_transform(g[:i], lambda t: length(t))), 0)::bigint + coalesce(list_sum(list_transform(h[:i - 1], lambda t: length(t))), 0)::bigint s from y),
 e as (select page, i, h, regexp_replace(replace(c[greatest(s - 30, 0) + 1 : s + length(h) + 30], chr(10), ' '), '^{cl.BLANKS}+|{cl.BLANKS}+$', '', 'g') excerpt from z),
 u as (select *, regexp_extract(h, '{_NUM}', 1) raw_value, lower(regexp_extract(h, '{_NUM}', 2)) u from e)
 select page, (i - 1)::int pos, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(excerpt, '(?i)\bms\b', 's', 'g'), '(?i)\b(?:million|billion)\b', 'count', 'g'), '\bk\b', 'count', 'g'), '\d+\.?\d*', 'N', 'g'))[:60] "key", excerpt,
 case u when 'ms' then raw_value::double / 1000 when 'million' then raw_value::double * 1e6 when 'billion' then raw_value::double * 1e9 when 'k' then raw_value::double * 1e3 else raw_value::double end "value", raw_value from u""",
    "claim_contradictions": r"""with x as (select path page, regexp_extract_all(content, 'the \w+ of step \d+') l from wiki_pages), e as (select page, generate_subscripts(l, 1) pos, unnest(l) excerpt from x),
 c as (select page, pos, regexp_replace(excerpt, '\d+$', 'n') k, excerpt, regexp_extract(excerpt, '(\d+)$', 1)::double v from e),
 f as (select * from c qualify row_number() over (partition by k, page order by pos) = 1),
 o as (select f.*, coalesce(tags, []) tags, coalesce(links, []) links, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1') st, regexp_replace(path, '\.md$', '') sl from f join wiki_pages w on w.path = f.page)
 select regexp_replace(a.k, '(?i)\bn\b', '?', 'g') claim, a.page page_a, a.excerpt excerpt_a, b.page page_b, b.excerpt excerpt_b, case when abs(a.v - b.v) > 10 then 'error' else 'warning' end severity
 from o a join o b on a.k = b.k and a.page < b.page and a.v <> b.v where list_has_any(a.tags, b.tags) or list_has_any(a.links, [b.st, b.sl]) or list_has_any(b.links, [a.st, a.sl])""",
    "page_types": f'with {_CLASS} select path, "type", confidence, tags from cls',
    "page_enriched": f"""with {_CLASS}, u as (select *, list_concat(own, tags) a from cls) select path, case when coalesce(ty, '') in ('', 'note') then "type" else ty end "type",
 case when coalesce(ty, '') in ('', 'note') then list_transform(list_filter(range(1, len(a) + 1), lambda i: list_position(a, a[i]) = i), lambda i: a[i]) else own end tags from u""",
    "page_write_kinds": f"""select w.path, case when coalesce(w.frontmatter['synthesis'], '') = 'true' or coalesce(w.type, '') = 'synthesis' then 'synthesis' when coalesce(len(w.sources), 0) > 0 then 'grounded'
 when coalesce(w.frontmatter['legacyUnsupported'], '') = 'true' then 'legacy' else 'unsupported' end kind from wiki_pages w where not {_SYS.replace('path', 'w.path')}""",
    "page_routes": r"""with p as (select string_split(path, '/') p from wiki_pages), d as (select distinct array_to_string(p[:i], '/') dir, i from p, unnest(range(1, len(p))) t(i)), n as (select dir, i, lower(regexp_extract(dir, '([^/]*)$', 1)) nm from d),
 s as (select path, lower(unnest(tags)) s from wiki_pages where not contains(path, '/') union select path, unnest(regexp_split_to_array(lower(title), '[\s\-_]+')) from wiki_pages where not contains(path, '/')),
 b as (select path, min(struct_pack(d := -i, dir := dir)) b from s join n on contains(s, nm) or contains(nm, s) where s <> '' group by 1) select w.path, case when b is null then w.path else b.dir || '/' || w.path end routed from wiki_pages w left join b using (path)""",
}
_PAIRED = r"""c as (select page, pos, "key" k, excerpt, "value" v from dates union all select page, pos, "key", excerpt, "value" from numbers), f as (select * from c qualify row_number() over (partition by k, page order by pos) = 1),
 o as (select f.*, coalesce(tags, []) tags, coalesce(links, []) links, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1') st, regexp_replace(path, '\.md$', '') sl from f join wiki_pages w on w.path = f.page)
 select regexp_replace(a.k, '(?i)\bn\b', '?', 'g') claim, a.page page_a, a.excerpt excerpt_a, b.page page_b, b.excerpt excerpt_b, case when abs(a.v - b.v) > 10 then 'error' else 'warning' end severity
 from o a join o b on a.k = b.k and a.page < b.page and a.v <> b.v where list_has_any(a.tags, b.tags) or list_has_any(a.links, [b.st, b.sl]) or list_has_any(b.links, [a.st, a.sl])"""
ORACLE["claim_contradictions_all"] = f"with dates as ({ORACLE['claim_dates']}), numbers as ({ORACLE['claim_numbers']}), {_PAIRED}"
