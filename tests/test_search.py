import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text as tx
from quillmesh.operators import search as se

PAGE = "path string, title string, type string, tags array<string>, content string, frontmatter map<string,string>, updated string, extra int, field string"
CORPUS = [
    ("concept-yolo.md", "YOLO Object Detection", "concept", ["yolo", "detection"], "Real-time object detection in one pass.", {}, None),
    ("person-redmon.md", "Joseph Redmon", "person", ["researcher"], "He created YOLO; computer vision work.", {}, None),
    ("synthesis-detectors.md", "Object Detection Overview", "synthesis", ["detection", "comparison"], "It compares three detectors.", {}, None),
    ("concept-bert.md", "BERT Language Model", "concept", ["nlp", "transformer"], "A bidirectional transformer.", {"owner": "team"}, None),
    ("how-to-deploy.md", "Deployment Guide", "how-to", ["deployment", "production"], "# Steps\n\n```\n# not a heading\n```\nSteps to deploy a release.", None, None),
    ("x/concatenate.md", None, None, None, "concatenate the files", None, None),
    ("x/empty.md", "", None, [], None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return se.documents(spark.createDataFrame([(*r, 1, "f") for r in CORPUS], PAGE)).cache()


def ask(spark, docs, *queries, limit=10):
    q = spark.createDataFrame(list(enumerate(queries)), "qid int, query string")
    out = {i: [] for i in range(len(queries))}
    for r in se.search(docs, q, limit).orderBy("qid", "rank").collect():
        out[r.qid].append(r)
    return out


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(tx.tokens(F.col("t")).alias("x")).first().x


def test_tokens(spark):
    assert tokens(spark, "Hello World") == ["hello", "world"]
    assert tokens(spark, "foo-bar_baz.qux") == ["foo", "bar", "baz", "qux"]
    assert tokens(spark, "") == tokens(spark, "   ") == tokens(spark, None) == []
    assert tokens(spark, "ＡＢＣ　x") == ["abc", "x"]
    assert sorted(tokens(spark, "数据库 api")) == sorted(["api", "数据库", "数据", "据库"])
    assert tokens(spark, "数据 数据库") == ["数据", "数据库", "据库"]


def test_ranking_relations(spark, docs):
    got = ask(spark, docs, "YOLO", "detection", "detection overview", "deploy", "cat", "constructor", "   ")
    paths = {i: [r.path for r in v] for i, v in got.items()}
    assert paths[0][0] == "concept-yolo.md" and "person-redmon.md" in paths[0]
    assert paths[1].index("concept-yolo.md") < len(paths[1]) and paths[1][0] in ("concept-yolo.md", "synthesis-detectors.md")
    assert paths[2][0] == "synthesis-detectors.md"
    assert paths[3][0] == "how-to-deploy.md"
    # three letters tolerate no edit, but a longer word may begin with them
    assert paths[4] == ["x/concatenate.md"] or paths[4] == []
    assert paths[5] == [] and paths[6] == []


def test_gate_needs_a_term(spark, docs):
    # a raw substring inside a word lets no document in
    assert ask(spark, docs, "caten")[0] == [] or ask(spark, docs, "caten")[0][0].path != "x/concatenate.md"
    assert ask(spark, docs, "ncat")[0] == []


def test_ties_by_path_and_repeated_terms(spark, docs):
    a, b = ask(spark, docs, "detection", "detection detection").values()
    assert [r.path for r in a] == sorted([r.path for r in a], key=lambda p: (-next(x.score for x in a if x.path == p), p))
    assert [r.path for r in b] == [r.path for r in a]


def test_snippet_and_section(spark, docs):
    r = ask(spark, docs, "release")[0][0]
    assert r.path == "how-to-deploy.md" and "release" in r.snippet and r.section == "# Steps"


def test_rounding_and_bounds(spark):
    row = spark.range(1).select(tx.round2(F.lit(1.005)).alias("a"), F.levenshtein(F.lit("abc"), F.lit("abcdef"), 2).alias("b")).first()
    assert row.a == 1.0 and row.b == -1


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0], [0.0])]
    got = [r.c for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(se.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_envelope_and_downgrade(spark):
    res = spark.createDataFrame([(0, 1, "a", 10.0), (0, 2, "b", 4.0), (1, 1, "a", 5.0), (1, 2, "b", 4.0), (2, 1, "c", 1.5), (3, 1, "d", 7.0)], "qid int, rank int, path string, score double")
    q = spark.createDataFrame([(i, "x") for i in range(5)], "qid int, query string")
    e = {r.qid: r for r in se.envelope(res, q).collect()}
    assert [e[i].confidence for i in range(5)] == ["strong", "weak", "absent", "strong", "absent"]
    assert e[2].abstain_reason == "below-floor" and e[2].provenance == [] and e[4].abstain_reason == "no-results" and e[0].provenance == ["a", "b"] and e[3].ratio is None
    t, f = F.lit(True), F.lit(False)
    row = spark.range(1).select(se.downgrade(F.lit("strong"), f, f, f), se.downgrade(F.lit("strong"), f, f, t), se.downgrade(F.lit("weak"), f, t, f), se.downgrade(F.lit("weak"), t, f, t)).first()
    assert list(row) == ["weak", "absent", "weak", "absent"]


def test_inline_budget_skips_what_is_too_large(spark):
    rows = [(0, 1, "a", "x" * 5), (0, 2, "b", "x" * 20), (0, 3, "c", "x" * 5)]
    got = {r.path: r.inlined for r in se.inline_budget(spark.createDataFrame(rows, "qid int, rank int, path string, body string"), 10).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_hybrid(spark):
    lex = spark.createDataFrame([(0, "a", 10.0), (0, "b", 5.0), (0, "c", 1.0)], "qid int, path string, score double")
    v = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0])], "path string, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, embedding array<double>")
    assert [(r.path, r.score) for r in se.rerank(lex, v, q, 3).orderBy("rank").collect()] == [("b", 0.7), ("a", 0.6), ("c", 0.06)]


def test_no_nested_loop_over_the_vocabulary(spark, docs):
    q = spark.createDataFrame([(0, "detection")], "qid int, query string")
    plan = se.candidates(se.postings(docs), se.query_terms(q))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_corpus(spark, docs):
    q = spark.createDataFrame([(0, "detection")], "qid int, query string")
    assert se.search(docs.limit(0), q).count() == 0


def test_stored_index_gives_the_same_and_is_probed_in_buckets(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 1, "f") for r in CORPUS], PAGE)
    q = spark.createDataFrame([(1, "yolo detection"), (2, "compter vision"), (3, "zzz")], "qid int, query string")
    stored = se.build_index(pages, f"{tmp_path}/index", 2)
    want = sorted(map(repr, se.search(se.documents(pages), q).collect()))
    assert sorted(map(repr, se.search(stored, q).collect())) == want and want
    assert sorted(map(repr, se.search(se.open_index(spark, f"{tmp_path}/index"), q).collect())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = stored.postings.join(spark.createDataFrame([("yolo",)], "term string"), "term")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_bodies_are_read_only_where_they_can_matter(spark):
    rows = [(f"p{i:02}.md", "Alpha Beta" if i < 20 else f"other {i}", "note", [], "alpha beta here" if i in (3, 25) else "beta something alpha", {}, None) for i in range(40)]
    pages = spark.createDataFrame([(*r, 1, "f") for r in rows], PAGE)
    q = spark.createDataFrame([(1, "alpha beta")], "qid int, query string")
    everything = se.search(se.documents(pages), q, 40).where("rank <= 5").select("path", "score").collect()
    assert se.search(se.documents(pages), q, 5).select("path", "score").collect() == everything and everything[0].path == "p03.md"
