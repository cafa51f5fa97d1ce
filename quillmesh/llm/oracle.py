"""SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_TERM = r"""regexp_replace(lower(translate(t, '{wide}', '{plain}')), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')""".format(
    wide="".join(map(chr, range(0xFF01, 0xFF5F))) + "　￠￡￢￤￥￦", plain="".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " ¢£¬¦¥₩"
)
_COUNTS = f"""rows as (select distinct * from search_docs),
numbered as (select row_number() over () r, page_id, title_terms, tag_terms, body_terms from rows),
terms as (select r, page_id, {_TERM} term from (
 select r, page_id, unnest(title_terms) t from numbered union all select r, page_id, unnest(tag_terms) from numbered
 union all select r, page_id, unnest(body_terms) from numbered) where t is not null),
tf as (select r, page_id, term, count(*) tf from terms where term <> '' group by 1, 2, 3),
per as (select term, count(*) df, sum(tf)::bigint gf, sum(tf * ln(tf)) tlt from tf group by 1)"""
_SHINGLES = r"""w as (select page_id, regexp_extract_all(lower(title || ' ' || content), '[\p{L}\p{N}]+') ws from wiki_pages where title is not null and content is not null),
s as (select distinct page_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) g from w where len(ws) >= 8),
n as (select page_id, count(*) n from s group by 1)"""

#: The definition row by row: a list of what was accepted so far, and per row the earlier rows that it would repeat.
_ACCEPTED = r"""r as (select raw_id, batch_no, size, nullif(regexp_replace(trim(lower(sha256)), '^sha256:\s*', ''), '') h, body,
 size || ':' || regexp_replace(regexp_replace(trim(path), '^\./', ''), '^raw/', '') place, row_number() over (order by batch_no nulls first, raw_id) o from raw_docs where size <> 0 or size is null),
w as (select o, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') ws from r where body is not null),
g as (select distinct o, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) g from w where len(ws) >= 8),
n as (select o, count(*) n from g group by 1),
c as (select a.o x, b.o y, count(*) k from g a join g b on a.g = b.g and a.o < b.o group by 1, 2),
e as (select x, y from c join n p on p.o = x join n q on q.o = y where k >= 0.6 * (p.n + q.n - k)
 union select a.o, b.o from r a join r b on a.h = b.h and a.o < b.o
 union select a.o, b.o from r a join r b on a.place = b.place and a.o < b.o where b.h is null and coalesce(trim(b.body), '') = ''),
l as (select y, list(x order by x) xs, row_number() over (order by y) i from e group by 1),
walk as (select 0::bigint i, []::bigint[] dup, null::bigint hit union all
 select l.i, case when k is null then dup else list_append(dup, l.y) end, k from
 (select l.i, l.y, dup, (list_filter(l.xs, lambda x: not list_contains(dup, x)))[1] k from walk join l on l.i = walk.i + 1) l),
found as (select p.raw_id accepted_id, q.raw_id, q.batch_no from walk join l using (i) join r p on p.o = walk.hit join r q on q.o = l.y)"""

ORACLE = {
    "p2_found": f"with recursive {_ACCEPTED} select accepted_id, raw_id from found",
    "p2_at_once": f"with recursive {_ACCEPTED} select accepted_id, raw_id from found",
    "p2_by_batch": f"with recursive {_ACCEPTED} select r.batch_no, r.raw_id, f.accepted_id from r left join found f using (raw_id)",
    "p1_found": f"""with {_SHINGLES}, c as (select a.page_id x, b.page_id y, count(*) k from s a join s b on a.g = b.g and a.page_id < b.page_id group by 1, 2)
 select x page_id_a, y page_id_b from c join n p on p.page_id = x join n q on q.page_id = y where k >= 0.6 * (p.n + q.n - k)""",
    "p3_found": f"with {_COUNTS} select distinct page_id, term from tf join per using (term) where tf >= 4 and df <= 3",
    "p3_weights": f"""with {_COUNTS}, n as (select count(distinct r) n from tf)
 select page_id, term, tf, df, gf, round(ln(1 + tf) * greatest(0.0, case when n > 1 then 1 - (ln(gf) - tlt / gf) / ln(n) else 1 end), 6) weight
 from tf join per using (term), n""",
    "p5_found": """select seg_id from segments left join split_limits l on l.format = regexp_extract(lower(file), '\\.([^./]+)$', 1),
 (select max(max_chars) m from split_limits where format = 'other') o where length(text) > coalesce(l.max_chars, o.m)""",
}
