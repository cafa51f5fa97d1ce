"""Queries of ranked retrieval over the wiki pages, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search as se
from ..session import checkpoint_dir, spread, table

ASKED = ["ledger archive", "cutover plan recovery", "config repo", "overview of the settlement", "premum ledgr", "journal", "scheduler outage report", "inventory inventory", "nothingmatchesthis", "ci deploy"]


def asked(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED))
    return spark.sql(f"select * from values {values} as t(qid, query)")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return se.documents(spread(table(spark, d, "wiki_pages")))


_BUILT: dict[tuple, str] = {}


def index(spark: SparkSession, d: str) -> se.Index:
    """The stored index of the pages: built when first asked for, and again when the files have changed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/wiki_pages.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path))
    key = (spark.sparkContext.applicationId, d, tuple(found))
    if key in _BUILT:
        return se.open_index(spark, _BUILT[key])
    folder = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    made = se.build_index(spread(table(spark, d, "wiki_pages")), folder)
    _BUILT[key] = folder
    return made


def search_tokens(spark: SparkSession, d: str) -> DataFrame:
    return se.postings(docs(spark, d))


def search_frequency(spark: SparkSession, d: str) -> DataFrame:
    return se.document_frequency(se.postings(docs(spark, d)))


def search_lengths(spark: SparkSession, d: str) -> DataFrame:
    c = se.corpus(docs(spark, d))
    return c.select("n", *[F.round(f"avg_{f}", 6).alias(f"avg_{f}") for f in se.FIELDS])


def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return se.bm25(se.postings(x), x, se.query_terms(asked(spark))).select("qid", "path", F.round("bm25", 6).alias("bm25"))


def search_candidates(spark: SparkSession, d: str) -> DataFrame:
    return se.candidates(se.postings(docs(spark, d)), se.query_terms(asked(spark)))


def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return se.search(index(spark, d), asked(spark)).drop("section")


def search_sections(spark: SparkSession, d: str) -> DataFrame:
    return se.search(index(spark, d), asked(spark)).select("qid", "path", "section")


def search_envelope(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark)
    return se.envelope(se.search(index(spark, d), q), q).withColumn("ratio", F.round("ratio", 6))


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    x = index(spark, d)
    return se.post_filter(se.search(x, asked(spark), 15), x.docs, 5, "concept", None)


def search_reads(spark: SparkSession, d: str) -> DataFrame:
    return se.reads(se.search(index(spark, d), asked(spark)), 3)


def search_inline(spark: SparkSession, d: str) -> DataFrame:
    x = index(spark, d)
    return se.inline_budget(se.search(x, asked(spark)).join(x.docs.select("path", "body"), "path"), 3000)


def search_downgrade(spark: SparkSession, d: str) -> DataFrame:
    """Confidence after reading the first page of each query."""
    pages = table(spark, d, "wiki_pages")
    q = asked(spark)
    found = se.search(index(spark, d), q)
    env = se.envelope(found, q).select("qid", "confidence")
    has = F.coalesce(F.size("sources") > 0, F.lit(False))
    legacy = F.coalesce(F.try_element_at("frontmatter", F.lit("status")) == "draft", F.lit(False))
    first = found.where("rank = 1").join(pages.select("path", has.alias("has"), F.coalesce(F.col("type") == "synthesis", F.lit(False)).alias("syn"), legacy.alias("legacy")), "path")
    return env.join(first, "qid").select("qid", "path", "confidence", se.downgrade(F.col("confidence"), F.col("has"), F.col("syn"), F.col("legacy")).alias("after_read"))


def search_gap(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark).select("qid", se.gap_slug(F.col("query")).alias("slug"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector against all, the five nearest."""
    v = vectors(spark, d)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    near = q.join(v, F.col("q_id") != F.col("vec_id")).select("q_id", "vec_id", F.round(se.cosine(F.col("q"), F.col("embedding")), 4).alias("cosine"))
    order = W.partitionBy("q_id").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where("rank <= 5")


def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Lexical results of 3k re-ranked by vectors: a page has the vector of its page_id, a query that of its qid."""
    lexical = se.search(index(spark, d), asked(spark), 15).select("qid", "path", "score")
    v = vectors(spark, d)
    of = table(spark, d, "wiki_pages").join(v, F.col("page_id") == F.col("vec_id")).select("path", "embedding")
    return se.rerank(lexical, of, v.select(F.col("vec_id").cast("int").alias("qid"), "embedding"), 5)


def text_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wiki_pages").select("page_id", tx.slugify(F.col("title")).alias("slug"), tx.stem(F.col("path")).alias("stem"))


_TOK = r"list_filter(string_split(trim(regexp_replace(regexp_replace(translate(lower({0}), '{wide}', '{narrow}'), '[_\-/.,:;!?''\"()\[\]{{}}<>|\\@#$%^&*+=~`]+', ' ', 'g'), '{blanks}', ' ', 'g')), ' '), lambda x: x <> '')".replace(
    "{wide}", tx.WIDE
).replace("{narrow}", tx.NARROW.replace("'", "''")).replace("{blanks}", tx.BLANKS.replace("{", "{{").replace("}", "}}"))


def tok(expr: str) -> str:
    return _TOK.replace("{{", "{").replace("}}", "}").replace("{0}", expr)


_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')"
_SYN = ", ".join(f"('{k}', '{w}')" for k, v in tx.SYNONYMS.items() for w in sorted({w for s in v for w in s.split()}))
_ASKED = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED))
_W = "case field when 'title' then 4.0 when 'tags' then 3.0 when 'slug' then 3.0 when 'frontmatter' then 1.5 else 1.0 end"
BASE = f"""asked(qid, query) as (values {_ASKED}), syn(k, w) as (values {_SYN}),
docs as (select path, coalesce(title, '') title, {_STEM} slug, type, tags, coalesce(content, '') body,
 {tok("coalesce(title, '')")} title_terms, {tok("coalesce(array_to_string(tags, ' '), '')")} tags_terms, {tok(_STEM)} slug_terms,
 {tok("coalesce(array_to_string(list_transform(list_filter(map_entries(frontmatter), lambda e: e.key not in ('title','type','tags','created','updated','sources','derived_from')), lambda e: e.value), ' '), '')")} frontmatter_terms,
 {tok("coalesce(content, '')")} body_terms from wiki_pages),
raw as (select path, 'title' field, unnest(title_terms) term from docs union all select path, 'tags', unnest(tags_terms) from docs union all select path, 'slug', unnest(slug_terms) from docs
 union all select path, 'frontmatter', unnest(frontmatter_terms) from docs union all select path, 'body', unnest(body_terms) from docs),
post as (select path, field, term, count(*) tf from raw group by all),
df as (select term, count(distinct path) df from post group by 1),
qt as (select qid, {tok("query")} terms from asked),
ex as (select qid, term, bool_or(orig) original from (select qid, unnest(terms) term, true orig from qt union all select q.qid, w, false from (select qid, unnest(terms) t from qt) q join syn on k = t) group by 1, 2),
one as (select count(*) n, sum(len(title_terms)) / count(*) a1, sum(len(tags_terms)) / count(*) a2, sum(len(slug_terms)) / count(*) a3, sum(len(frontmatter_terms)) / count(*) a4, sum(len(body_terms)) / count(*) a5 from docs),
lens as (select path, field, count(*) l from raw group by 1, 2),
bm as (select qid, path, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / case field when 'title' then a1 when 'tags' then a2 when 'slug' then a3 when 'frontmatter' then a4 else a5 end))
 * {_W} * case when original then 1.0 else 0.4 end) bm25 from post join ex using (term) join df using (term) join lens using (path, field), one group by 1, 2),
qs as (select distinct qid, unnest(terms) q from qt), k as (select *, case when length(q) < 4 then 0 when length(q) <= 7 then 1 else 2 end k from qs),
ct as (select qid, term from ex union select qid, term from k, (select distinct term from post) where length(q) >= 2 and ((starts_with(term, q) and term <> q) or (k > 0 and abs(length(term) - length(q)) <= k and levenshtein(term, q) <= k))),
cand as (select distinct qid, path from post join ct using (term)),
bon as (select c.qid, d.*, qt.terms, coalesce(bm25, 0) bm25, array_to_string(qt.terms, ' ') phrase from cand c join docs d using (path) join qt on qt.qid = c.qid left join bm on bm.qid = c.qid and bm.path = c.path),
sc as (select qid, path, title, body, terms, floor((bm25 + case when contains(lower(title), phrase) then 8 else 0 end + case when contains(lower(slug), replace(phrase, ' ', '-')) then 6 else 0 end + case when contains(lower(body), phrase) then 3 else 0 end
 + case when len(terms) > 1 then 3 * (list_has_all(title_terms, terms)::int + list_has_all(tags_terms, terms)::int + list_has_all(slug_terms, terms)::int + list_has_all(frontmatter_terms, terms)::int + list_has_all(body_terms, terms)::int) else 0 end
 + case when type = 'synthesis' and list_has_any(terms, ['overview', 'summary', 'compare', 'comparison', 'difference', 'vs']) then 2 else 0 end
 + {' + '.join(f"len(list_filter(terms, lambda t: length(t) >= 2 and len(list_filter({f}_terms, lambda x: starts_with(x, t) and x <> t)) > 0)) * {w * 0.5}" for f, w in (('title', 4.0), ('tags', 3.0), ('slug', 3.0)))}
 + {' + '.join(f"len(list_filter(terms, lambda t: length(t) >= 4 and len(list_filter({f}_terms, lambda x: x <> t and not starts_with(x, t) and levenshtein(t, x) <= case when length(t) <= 7 then 1 else 2 end)) > 0)) * {w * 0.3}" for f, w in (('title', 4.0), ('tags', 3.0), ('slug', 3.0)))}
 ) * 100 + 0.5) / 100 score from bon),
rk as (select *, row_number() over (partition by qid order by score desc, path) rank from sc where score > 0)"""
_HIT = """hits as (select *, list_min(list_filter(list_transform(range(1, len(terms) + 1), lambda i: struct_pack(pos := instr(lower(body), terms[i]) - 1, i := i, n := length(terms[i]))), lambda p: p.pos >= 0)) h from rk where rank <= 10)"""
_SNIP = r"""case when length(body) = 0 then title when h is null then regexp_replace(substr(body, 1, 150), '^\s+|\s+$', '', 'g') || case when length(body) > 150 then '...' else '' end
 else case when h.pos > 60 then '...' else '' end || trim(regexp_replace(substr(body, greatest(0, h.pos - 60) + 1, least(length(body), h.pos + h.n + 90) - greatest(0, h.pos - 60)), '^\s+|\s+$', '', 'g')) || case when h.pos + h.n + 90 < length(body) then '...' else '' end end"""
_ENV = """env as (select qid, max(score) filter (rank = 1) top1, max(score) filter (rank = 2) top2, list(path order by rank) filter (rank <= 3) paths from rk where rank <= 10 group by 1),
envelope as (select a.qid, top1, case when top1 >= 2 and top2 > 0 then round(top1 / top2, 6) end ratio, case when top1 is null or top1 < 2 then 'absent' when top2 is null or top2 <= 0 or top1 / top2 >= 2 then 'strong' else 'weak' end confidence, top1 is null or top1 < 2 abstain,
 case when top1 is null then 'no-results' when top1 < 2 then 'below-floor' end abstain_reason, case when top1 >= 2 then paths else [] end provenance from asked a left join env using (qid))"""
_COS = "list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))"

QUERIES = {
    f.__name__: f
    for f in (
        search_topk, search_tokens, search_frequency, search_lengths, search_bm25, search_candidates, search_sections, search_envelope, search_filtered, search_reads, search_inline, search_downgrade,
        search_gap, vector_cosine, search_hybrid, text_slugs,
    )
}
ORACLE = {
    "search_topk": f"with {BASE}, {_HIT} select qid, rank::int rank, path, score, {_SNIP} snippet from hits",
    "search_tokens": f"with {BASE} select * from post",
    "search_frequency": f"with {BASE} select * from df",
    "search_lengths": f"with {BASE} select n, round(a1, 6) avg_title, round(a2, 6) avg_tags, round(a3, 6) avg_slug, round(a4, 6) avg_frontmatter, round(a5, 6) avg_body from one",
    "search_bm25": f"with {BASE} select qid, path, round(bm25, 6) bm25 from bm",
    "search_candidates": f"with {BASE} select qid, path from cand",
    "search_envelope": f"with {BASE}, {_ENV} select * from envelope",
    "search_filtered": f"with {BASE}, f as (select qid, path, score, row_number() over (partition by qid order by rank) rank from rk join docs using (path) where rank <= 15 and docs.type = 'concept') select qid, rank::int rank, path, score from f where rank <= 5",
    "search_reads": f'with {BASE}, p as (select qid, list(path order by rank) p from rk where rank <= 10 group by 1) select qid, p[1:3] "read", p[4:] next_reads from p',
    "search_downgrade": f"""with {BASE}, {_ENV}, t as (select e.qid, k.path, e.confidence, case e.confidence when 'strong' then 2 when 'weak' then 1 else 0 end
 - case when coalesce(len(w.sources), 0) = 0 and coalesce(w.type, '') <> 'synthesis' then 1 else 0 end - case when coalesce(w.frontmatter['status'], '') = 'draft' then 1 else 0 end tier
 from envelope e join rk k on k.qid = e.qid and k.rank = 1 join wiki_pages w on w.path = k.path)
 select qid, path, confidence, case when tier >= 2 then 'strong' when tier = 1 then 'weak' else 'absent' end after_read from t""",
    "search_gap": f"with {BASE} select qid, regexp_replace(substr(regexp_replace(lower(query), '[^a-z0-9]+', '-', 'g'), 1, 50), '^-+|-+$', '', 'g') slug from asked",
    "vector_cosine": f"""with n as (select a.vec_id q_id, b.vec_id, round({_COS}, 4) cosine from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
 r as (select *, (row_number() over (partition by q_id order by cosine desc, vec_id))::int rank from n) select * from r where rank <= 5""",
    "search_hybrid": f"""with {BASE}, l as (select qid, path, score, max(score) over (partition by qid) m from rk where rank <= 15),
 v as (select l.*, coalesce((select {_COS} from embeddings a, embeddings b, wiki_pages w where a.vec_id = l.qid and w.path = l.path and b.vec_id = w.page_id), 0) c from l),
 s as (select qid, path, floor((case when m > 0 then score / m else 0 end * 0.6 + c * 0.4) * 10000 + 0.5) / 10000 score from v),
 r as (select qid, (row_number() over (partition by qid order by score desc, path))::int rank, path, score from s) select * from r where rank <= 5""",
    "text_slugs": f"select page_id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) slug, {_STEM} stem from wiki_pages",
}
