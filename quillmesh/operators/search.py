"""Ranked retrieval: fielded BM25 with synonyms, prefixes, fuzzy terms, bonuses and re-ranking.

Queries come in batches `(qid, query)`; one job answers all of them. An index holds the
postings (term, path, field, tf, length of the field), the vocabulary with document frequencies, the
documents and one row about the corpus; stored, the postings lie in buckets by term, so queries
probe them without a shuffle. Query terms are matched with the distinct vocabulary once:
prefixes meet on the first two characters, fuzzy terms on length, each with the exact test as a
residual; scores and bonuses then follow from the postings of matched terms alone. Bodies are read
only for documents that could still reach the best `limit`. Nothing is hinted to broadcast:
a small query set is broadcast by its size, a large one is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import expand, fuzzy_distance, normalize, round2, stem, tokens
from ..session import cut

#: Weights and constants of the ranking (fixed values).
WEIGHTS = {"title": 4.0, "tags": 3.0, "slug": 3.0, "frontmatter": 1.5, "body": 1.0}
K1, B, EXPANDED = 1.2, 0.75, 0.4
OVERVIEW = ("overview", "summary", "compare", "comparison", "difference", "vs")
OWN_KEYS = ("title", "type", "tags", "created", "updated", "sources", "derived_from")
FLOOR, STRONG = 2.0, 2.0
#: What a phrase in the body is worth.
BODY = 3.0
FIELDS = tuple(WEIGHTS)
SIGNAL = ("title", "tags", "slug")


def field_texts() -> dict[str, Column]:
    """The text of each field of a page; null where there is none."""
    rest = F.map_values(F.map_filter("frontmatter", lambda k, _: ~k.isin(*OWN_KEYS)))
    tags = F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), " ")
    return {"title": F.col("title"), "tags": tags, "slug": stem(F.col("path")), "frontmatter": F.array_join(rest, " "), "body": F.col("content")}


def documents(pages: DataFrame) -> DataFrame:
    """path, title, slug, type, tags, body, updated and an array of terms per field; nulls count as empty."""
    empty = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    text = field_texts()
    return pages.select(
        "path", F.coalesce("title", F.lit("")).alias("title"), text["slug"].alias("slug"), "type", empty.alias("tags"), F.coalesce("content", F.lit("")).alias("body"), "updated",
        *[tokens(text[f]).alias(f"{f}_terms") for f in FIELDS],
    )


def postings(docs: DataFrame) -> DataFrame:
    """(path, field, term, tf)."""
    by_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_terms").alias("terms")) for f in FIELDS]))
    return docs.select("path", by_field.alias("f")).select("path", "f.field", F.explode("f.terms").alias("term")).groupBy("path", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    """(path, field, len) of every field, empty ones too."""
    by_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(f"{f}_terms").cast("long").alias("len")) for f in FIELDS]))
    return docs.select("path", by_field.alias("f")).select("path", "f.field", "f.len")


def document_frequency(posted: DataFrame) -> DataFrame:
    """(term, df): documents that hold the term in any field."""
    return posted.select("path", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus(docs: DataFrame) -> DataFrame:
    """One row: n and the mean length of each field over all documents."""
    return docs.agg(F.count(F.lit(1)).alias("n"), *[(F.sum(F.size(f"{f}_terms")) / F.count(F.lit(1))).alias(f"avg_{f}") for f in FIELDS])


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, terms (with repeats), expanded (distinct, with synonyms); queries without terms drop out."""
    q = queries.select("qid", tokens(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    return q.withColumn("expanded", expand(F.col("terms")))


def bm25(posted: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, path, bm25): weighted sum over the query's expanded terms."""
    wanted = terms.select("qid", F.explode("expanded").alias("term"), "terms").select("qid", "term", F.array_contains("terms", F.col("term")).alias("original"))
    hit = posted.join(wanted.select("term").distinct(), "term", "left_semi")
    frequency = document_frequency(hit)
    one = corpus(docs)
    size = lengths(docs)
    weight, mean = F.lit(0.0), F.lit(None).cast("double")
    for f, w in WEIGHTS.items():
        weight = F.when(F.col("field") == f, w).otherwise(weight)
        mean = F.when(F.col("field") == f, F.col(f"avg_{f}")).otherwise(mean)
    rows = hit.join(frequency, "term").join(size, ["path", "field"]).join(wanted, "term").join(F.broadcast(one), F.lit(True))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * (F.col("len") / mean)))
    return rows.groupBy("qid", "path").agg(F.sum(idf * norm * weight * F.when(F.col("original"), 1.0).otherwise(EXPANDED)).alias("bm25"))


def candidate_terms(posted: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, term): vocabulary terms that let a document in: expanded, prefixed or within the edit distance."""
    vocabulary = posted.select("term").distinct()
    exact = terms.select("qid", F.explode("expanded").alias("term"))
    single = terms.select("qid", F.explode(F.array_distinct("terms")).alias("q")).where(F.length("q") >= 2)
    prefixed = (
        vocabulary.withColumn("head", F.substring("term", 1, 2))
        .join(single.withColumn("head", F.substring("q", 1, 2)), "head")
        .where(F.col("term").startswith(F.col("q")) & (F.col("term") != F.col("q")))
        .select("qid", "term")
    )
    k = fuzzy_distance(F.col("q"))
    banded = single.withColumn("k", k).where("k > 0").withColumn("len", F.explode(F.sequence(F.length("q") - F.col("k"), F.length("q") + F.col("k"))))
    near = (
        vocabulary.withColumn("len", F.length("term"))
        .join(banded, "len")
        .where(F.when(F.col("k") == 1, F.levenshtein("term", "q", 1)).otherwise(F.levenshtein("term", "q", 2)) >= 0)
        .select("qid", "term")
    )
    return exact.unionByName(prefixed).unionByName(near).distinct()


def candidates(posted: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, path) of the documents that are scored at all."""
    return posted.select("path", "term").join(candidate_terms(posted, terms), "term").select("qid", "path").distinct()


@dataclass
class Index:
    """What queries read: `postings` (term, path, field, tf, len), `vocabulary` (term, df), `docs` (as `documents`, without terms), `corpus` (one row)."""

    postings: DataFrame
    vocabulary: DataFrame
    docs: DataFrame
    corpus: DataFrame


DOCS = ("path", "title", "slug", "type", "tags", "body", "updated")


def index_of(docs: DataFrame) -> Index:
    """An index that is computed whenever it is read."""
    by_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_terms").alias("terms")) for f in FIELDS]))
    each = docs.select("path", by_field.alias("f")).select("path", "f.field", F.size("f.terms").alias("len"), F.explode("f.terms").alias("term"))
    posted = each.groupBy("term", "path", "field").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    return Index(posted, document_frequency(posted), docs.select(*DOCS), corpus(docs))


def build_index(pages: DataFrame, folder: str, buckets: int | None = None) -> Index:
    """Write the index of `pages` to an empty shared folder; it is opened again by `open_index`."""
    spark = pages.sparkSession
    buckets = buckets or spark.sparkContext.defaultParallelism
    made = index_of(documents(pages))
    parts = spark.createDataFrame([(buckets,)], "buckets int")
    parts.coalesce(1).write.parquet(f"{folder}/layout")
    name = _tables(spark, folder, buckets)
    made.postings.select("path", "field", F.col("tf").cast("int").alias("tf"), F.col("len").cast("int").alias("len"), "term").repartition(buckets, "term").write.insertInto(f"{name}_postings")
    made.docs.write.parquet(f"{folder}/docs")
    made.corpus.coalesce(1).write.parquet(f"{folder}/corpus")
    document_frequency(spark.table(f"{name}_postings")).write.parquet(f"{folder}/vocabulary")
    return open_index(spark, folder)


def _tables(spark: SparkSession, folder: str, buckets: int) -> str:
    name = f"index_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"
    schema = "path string, field string, tf int, len int, term string"
    spark.sql(f"create table if not exists {name}_postings ({schema}) using parquet clustered by (term) sorted by (term) into {buckets} buckets location '{folder}/postings'")
    return name


def open_index(spark: SparkSession, folder: str) -> Index:
    """A stored index."""
    name = _tables(spark, folder, spark.read.parquet(f"{folder}/layout").first()[0])
    return Index(spark.table(f"{name}_postings"), *[spark.read.parquet(f"{folder}/{t}") for t in ("vocabulary", "docs", "corpus")])


def matches(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, term, df, kind, q, times): vocabulary terms for each query; kinds are own and synonym, prefix and near with the query term `q` and how often it stands in the query."""
    exact = terms.select("qid", F.explode("expanded").alias("term"), "terms")
    own = exact.select("qid", "term", F.when(F.array_contains("terms", F.col("term")), "own").otherwise("synonym").alias("kind"), F.col("term").alias("q"), F.lit(1).alias("times"))
    single = terms.select("qid", F.explode("terms").alias("q")).groupBy("qid", "q").agg(F.count(F.lit(1)).cast("int").alias("times")).where(F.length("q") >= 2)
    prefixed = (
        vocabulary.withColumn("head", F.substring("term", 1, 2))
        .join(single.withColumn("head", F.substring("q", 1, 2)), "head")
        .where(F.col("term").startswith(F.col("q")) & (F.col("term") != F.col("q")))
        .select("qid", "term", "df", F.lit("prefix").alias("kind"), "q", "times")
    )
    k = fuzzy_distance(F.col("q"))
    banded = single.withColumn("k", k).where("k > 0").withColumn("len", F.explode(F.sequence(F.length("q") - F.col("k"), F.length("q") + F.col("k"))))
    near = (
        vocabulary.withColumn("len", F.length("term"))
        .join(banded, "len")
        .where(F.when(F.col("k") == 1, F.levenshtein("term", "q", 1)).otherwise(F.levenshtein("term", "q", 2)) >= 0)
        .select("qid", "term", "df", F.lit("near").alias("kind"), "q", "times")
    )
    return own.join(vocabulary, "term").select("qid", "term", "df", "kind", "q", "times").unionByName(prefixed).unionByName(near)


def scored(index: Index, terms: DataFrame) -> DataFrame:
    """(qid, path, base): the score of every candidate from its postings: BM25, fields that hold all query terms, prefixes and near terms."""
    hit = index.postings.join(matches(index.vocabulary, terms), "term").join(F.broadcast(index.corpus), F.lit(True))  # one row
    weight, mean = F.lit(0.0), F.lit(None).cast("double")
    for f, w in WEIGHTS.items():
        weight = F.when(F.col("field") == f, w).otherwise(weight)
        mean = F.when(F.col("field") == f, F.col(f"avg_{f}")).otherwise(mean)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * (F.col("len") / mean)))
    part = idf * norm * weight * F.when(F.col("kind") == "own", 1.0).when(F.col("kind") == "synonym", EXPANDED)
    loose = lambda kind, but: F.collect_set(F.when((F.col("kind") == kind) & F.col("field").isin(*SIGNAL) & but, F.struct("q", "times")))  # noqa: E731  # at most one per query term
    other = (F.col("term") != F.col("q")) & ~F.col("term").startswith(F.col("q"))
    by_field = hit.groupBy("qid", "path", "field").agg(
        F.sum(part).alias("bm25"), F.count_if(F.col("kind") == "own").alias("own"), loose("prefix", F.lit(True)).alias("prefix"), loose("near", other).alias("near"), F.max(weight).alias("w")
    )
    times = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["times"])
    whole = by_field.join(terms.select("qid", F.size(F.array_distinct("terms")).alias("distinct"), F.size("terms").alias("many")), "qid")
    all_of = F.when((F.col("many") > 1) & (F.col("own") == F.col("distinct")), 3.0).otherwise(0.0)
    gain = all_of + times(F.col("prefix")) * (F.col("w") * 0.5) + times(F.col("near")) * (F.col("w") * 0.3)
    return whole.groupBy("qid", "path").agg((F.coalesce(F.sum("bm25"), F.lit(0.0)) + F.sum(gain)).alias("base"))


def search(index: Index | DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(qid, rank, path, score, snippet, section) of the best `limit` documents of each query.

    `index` may be the frame of `documents`, which is then indexed on the way. Ties are
    broken by path. Documents outside the candidate gate never appear, however
    large their bonuses would be. An empty query or corpus gives no rows.
    """
    index = index if isinstance(index, Index) else index_of(index)
    terms = query_terms(queries)
    asked = terms.select("qid", "terms", F.array_join("terms", " ").alias("phrase"))
    overview = F.arrays_overlap("terms", F.array(*map(F.lit, OVERVIEW)))
    named = (
        F.when(F.lower("title").contains(F.col("phrase")), 8.0).otherwise(0.0)
        + F.when(F.lower("slug").contains(F.replace("phrase", F.lit(" "), F.lit("-"))), 6.0).otherwise(0.0)
        + F.when((F.col("type") == "synthesis") & overview, 2.0).otherwise(0.0)
    )
    rows = scored(index, terms).join(index.docs.select("path", "title", "slug", "type"), "path").join(asked, "qid")
    rows = cut(rows.select("qid", "path", "phrase", (F.col("base") + named).alias("base")))  # read twice; as narrow as a row of scores
    # a body adds at most BODY: who is further behind the last of the best cannot get among them
    best = W.partitionBy("qid").orderBy(F.desc("base"), "path")
    leaders = rows.select("qid", "path", "base").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limit)
    bound = leaders.groupBy("qid").agg(F.min("base").alias("_least"), F.count(F.lit(1)).alias("_many")).where(F.col("_many") == limit).drop("_many")
    near = rows.join(bound, "qid", "left").where(F.col("_least").isNull() | (F.col("base") + BODY + 0.01 >= F.col("_least")))
    said = near.join(index.docs.select("path", F.col("body").alias("_body")), "path")
    score = round2(F.col("base") + F.when(F.lower("_body").contains(F.col("phrase")), BODY).otherwise(0.0))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "path")
    # the sign of the score is tested behind the rank, so it is computed once
    top = said.select("qid", "path", score.alias("score")).withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= limit) & (F.col("score") > 0))
    shown = top.join(index.docs.select("path", "title", "body"), "path").join(terms.select("qid", "terms"), "qid")
    at = hit_position(F.lower("body"), F.col("terms"))
    return shown.select("qid", "rank", "path", "score", snippet(at).alias("snippet"), F.when(at["pos"].isNotNull(), section_at(F.col("body"), at["pos"])).alias("section"))


def hit_position(low: Column, terms: Column) -> Column:
    """struct(pos from 0, len) of the earliest occurrence of any term, the earlier term first; null fields if none."""
    places = F.transform(terms, lambda t, i: F.struct((F.instr(low, t) - 1).alias("pos"), i.alias("i"), F.length(t).alias("len")))
    return F.array_min(F.filter(places, lambda p: p["pos"] >= 0))


def snippet(at: Column) -> Column:
    """Sixty characters before the hit to ninety behind it, with marks of omission; the first 150 without a hit."""
    body = F.col("body")
    start, end = F.greatest(F.lit(0), at["pos"] - 60), F.least(F.length(body), at["pos"] + at["len"] + 90)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.trim(F.regexp_replace(F.substr(body, start + 1, end - start), r"^\s+|\s+$", "")), F.when(end < F.length(body), "...").otherwise(""))
    first = F.concat(F.regexp_replace(F.substring(body, 1, 150), r"^\s+|\s+$", ""), F.when(F.length(body) > 150, "...").otherwise(""))
    return F.when(F.length(body) == 0, F.col("title")).when(at.isNull(), first).otherwise(cut)


def section_at(body: Column, pos: Column) -> Column:
    """The last heading before `pos` outside code fences, null if there is none."""
    start = F.struct(F.lit(False).alias("code"), F.lit(None).cast("string").alias("head"))

    def step(a: Column, line: Column) -> Column:
        fence = line.rlike(r"^(`{3,}|~{3,})")
        head = F.when(~a["code"] & ~fence & F.rtrim(line).rlike(r"^#{1,6}\s"), F.regexp_replace(line, r"\s+$", "")).otherwise(a["head"])
        return F.struct(F.when(fence, ~a["code"]).otherwise(a["code"]).alias("code"), head.alias("head"))

    return F.aggregate(F.split(F.substr(body, F.lit(1), pos), "\n"), start, step)["head"]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for other lengths, empty arrays and zero norms."""
    zero = F.lit(0.0).cast("double")
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)
    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), total(a, b) / norm).otherwise(zero)


def rerank(lexical: DataFrame, vectors: DataFrame, query_vectors: DataFrame, limit: int = 10, bm25_weight: float = 0.6, vector_weight: float = 0.4) -> DataFrame:
    """(qid, rank, path, score): 0.6 bm25/max + 0.4 cosine over `lexical` (qid, path, score); documents without vector count 0."""
    top = lexical.join(query_vectors.select("qid", F.col("embedding").alias("_q")), "qid", "left").join(vectors.select("path", F.col("embedding").alias("_v")), "path", "left")
    most = F.max("score").over(W.partitionBy("qid"))
    near = F.coalesce(cosine(F.col("_q"), F.col("_v")), F.lit(0.0))
    lex = F.when(most > 0, F.col("score") / most).otherwise(0.0)
    mixed = top.withColumn("mixed", F.floor((lex * bm25_weight + near * vector_weight) * 10000 + 0.5) / 10000)
    order = W.partitionBy("qid").orderBy(F.desc("mixed"), "path")
    return mixed.select("qid", F.row_number().over(order).alias("rank"), "path", F.col("mixed").alias("score")).where(F.col("rank") <= limit)


def envelope(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: top1, ratio of the two best, confidence, abstain, reason and the three first paths as provenance."""
    second = F.lead("score").over(W.partitionBy("qid").orderBy("rank"))
    first = results.withColumn("_second", second).where("rank = 1").select("qid", F.col("score").alias("top1"), F.col("_second").alias("top2"))
    cited = results.where("rank <= 3").groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))
    e = queries.select("qid").join(first, "qid", "left").join(cited, "qid", "left")
    weak = F.col("top1") < FLOOR
    ratio = F.when(F.col("top2") > 0, F.col("top1") / F.col("top2"))
    confidence = F.when(F.col("top1").isNull() | weak, "absent").when(ratio.isNull() | (ratio >= STRONG), "strong").otherwise("weak")
    absent = confidence == "absent"
    reason = F.when(F.col("top1").isNull(), "no-results").when(weak, "below-floor")
    nothing = F.array().cast("array<string>")
    return e.select(
        "qid", "top1", F.when(~absent, ratio).alias("ratio"), confidence.alias("confidence"), absent.alias("abstain"), reason.alias("abstain_reason"), F.when(absent, nothing).otherwise(F.col("paths")).alias("provenance")
    )


def downgrade(confidence: Column, has_sources: Column, synthesis: Column, legacy: Column) -> Column:
    """One tier less for a page without sources and synthesis mark, one more for a legacy mark."""
    tier = F.when(confidence == "strong", 2).when(confidence == "weak", 1).otherwise(0)
    left = tier - F.when(~has_sources & ~synthesis, 1).otherwise(0) - F.when(legacy, 1).otherwise(0)
    return F.when(left >= 2, "strong").when(left == 1, "weak").otherwise("absent")


def post_filter(results: DataFrame, docs: DataFrame, limit: int, type_: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Type and any-of tags after ranking: 3 x `limit` results are ranked, then filtered, then cut; it may under-fill."""
    kept = results.where(F.col("rank") <= 3 * limit).join(docs.select("path", "type", "tags"), "path")
    if type_ is not None:
        kept = kept.where(F.col("type") == type_)
    if tags:
        kept = kept.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    again = F.row_number().over(W.partitionBy("qid").orderBy("rank"))
    return kept.withColumn("rank", again).where(F.col("rank") <= limit).select("qid", "rank", "path", "score")


def reads(results: DataFrame, n: int) -> DataFrame:
    """Per query the first `n` distinct paths to read and the remaining ones."""
    paths = F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"])
    return results.groupBy("qid").agg(F.array_distinct(paths).alias("_p")).select("qid", F.slice("_p", 1, n).alias("read"), F.slice("_p", n + 1, 1_000_000).alias("next_reads"))


def inline_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """(qid, path, inlined): in rank order a body goes in if it still fits; one too large takes nothing from the budget."""
    items = F.sort_array(F.collect_list(F.struct("rank", "path", F.length("body").alias("n"))))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("taken"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["n"] <= budget
        return F.struct(F.when(fits, a["used"] + x["n"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["taken"], F.array(x["path"]))).otherwise(a["taken"]).alias("taken"))

    folded = ranked.groupBy("qid").agg(items.alias("items")).withColumn("taken", F.aggregate("items", start, step)["taken"])  # at most `limit` items a query
    return folded.select("qid", "taken", F.explode("items").alias("x")).select("qid", F.col("x.path").alias("path"), F.array_contains("taken", F.col("x.path")).alias("inlined"))


def gap_slug(query: Column) -> Column:
    """A page name for a query without results: its normal form in dashes, at most fifty characters."""
    return F.regexp_replace(F.substring(F.regexp_replace(normalize(query), r"[^a-z0-9]+", "-"), 1, 50), r"^-+|-+$", "")


def embed(pages: DataFrame, encoder: Callable[[list[str]], list[list[float]]], model: str, most_chars: int = 2000) -> DataFrame:
    """(path, model, embedding) by a given encoder of texts: title, tags and the first `most_chars` of the body, which is what such models read; vectors have length 1."""

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        for b in batches:
            v = np.asarray(encoder(b["text"].tolist()), float)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.DataFrame({"path": b["path"], "model": model, "embedding": list((v / np.where(n > 0, n, 1)).astype("float32"))})

    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    text = F.substring(F.concat_ws("\n", "title", tags, "content"), 1, most_chars)
    return pages.select("path", text.alias("text")).mapInPandas(run, "path string, model string, embedding array<float>")
