from pyspark.sql import functions as F

from quillmesh.operators import claims as cl
from quillmesh.operators import graph as gr
from quillmesh.operators import pages as pg

PAGE = "path string, title string, type string, tags array<string>, sources array<string>, content string, frontmatter map<string,string>, links array<string>, created string, updated string, derived_from array<string>"


def page(path, content="", title="T", links=None, tags=None, type_="concept", **k):
    return (path, title, type_, tags, k.get("sources"), content, k.get("front", {"a": "b"}), links, k.get("created"), k.get("updated"), k.get("derived"))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), PAGE)


def test_sections(spark):
    text = "---\ntitle: x\n---\nintro\n# A\na\n```\n# no\n```\n## B\nb\n# C"
    got = [(r.pos, r.heading, r.level, r.content) for r in pg.sections(frame(spark, page("p.md", text), page("q.md", None), page("r.md", "# Only"))).orderBy("path", "pos").collect()]
    assert got[:4] == [(0, "", 0, "---\ntitle: x\n---\nintro"), (1, "# A", 1, "# A\na\n```\n# no\n```"), (2, "## B", 2, "## B\nb"), (3, "# C", 1, "# C")]
    assert got[4:] == [(0, "", 0, ""), (1, "# Only", 1, "# Only")]
    of = pg.sections(frame(spark, page("p.md", text)))
    r = pg.section_read(of, "a").first()
    assert r.heading == "# A" and r.content.endswith("## B\nb") and r.total_lines == 7
    assert pg.toc(of).first().toc == "# A\n  ## B\n# C"


def test_line_window(spark):
    r = pg.line_window(frame(spark, page("p.md", "\n".join(map(str, range(10))))), 3, 4).first()
    assert (r.content, r.lines_returned, r.total_lines, r.truncated, r.next_offset) == ("3\n4\n5\n6", 4, 10, True, 7)
    assert pg.line_window(frame(spark, page("p.md", "x")), -5, 9000).first().next_offset is None


def test_links_resolve_and_ghosts(spark):
    rows = frame(spark, page("foo.md", links=["topic/baz", "baz", "dup", "foo", "gone", "gone"]), page("topic/baz.md", links=["foo.md"]), page("a/dup.md"), page("b/dup.md"))
    edges = sorted((r.source, r.target) for r in pg.link_edges(rows).collect())
    assert edges == [("foo", "__broken__:dup"), ("foo", "__broken__:gone"), ("foo", "__broken__:gone"), ("foo", "topic/baz"), ("foo", "topic/baz"), ("topic/baz", "foo")]
    g = {r.id: r for r in pg.link_graph(rows).collect()}
    assert g["foo"].degree == 6 and g["__broken__:gone"].in_degree == 2 and g["a/dup"].orphan and not g["__broken__:dup"].orphan
    # lint counts any page of that name
    assert sorted(r.link for r in pg.broken_links(rows).collect()) == ["gone", "gone"]
    plan = pg.broken_links(rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_orphans_lint_and_indexes(spark):
    rows = frame(
        spark, page("a.md", links=["b"], title="a", front=None), page("b.md", links=["b"], type_="synthesis", derived=["a", "nope"]), page("index.md", links=["c"]), page("c.md", sources=["x"], updated="2020-01-01"), page("old/index.md"),
    )
    assert [r.path for r in pg.orphan_pages(rows).collect()] == ["a.md"]
    issues = {(r.page, r.category) for r in pg.lint(rows, 1_700_000_000_000_000).collect()}
    assert {("a.md", "structure"), ("a.md", "orphan"), ("b.md", "integrity"), ("c.md", "stale"), ("a.md", "missing-source")} <= issues and ("index.md", "orphan") not in issues
    assert [r.path for r in pg.stale_indexes(rows).collect()] == ["old/index.md"]
    assert [r.title for r in pg.fixed_titles(frame(spark, page("x/my-new page.md", front=None))).collect()] == ["My New Page"]


def test_glob(spark):
    df = spark.createDataFrame([("a/B.PDF",), ("c.html",), ("d.css",), (".pdf",)], "p string")
    got = [[r[0] for r in df.where(pg.glob(F.col("p"), g)).collect()] for g in ("*.pdf", "*.{html, CSS}", "**/*.pdf", "c.html")]
    assert got == [["a/B.PDF", ".pdf"], ["c.html", "d.css"], ["a/B.PDF", ".pdf"], ["c.html"]]


def test_claims(spark):
    rows = frame(
        spark, page("a.md", "It was released in March 2021. Latency is 1000 ms here.", tags=["t"]), page("b.md", "Released in 2021-03-15 and released in march 2035. Latency is 1 s here.", tags=["t"]),
        page("c.md", "It was released in March 2030.", tags=["u"]), page("index.md", "released in 1990"),
    )
    dates = sorted((r.page, r.key, r.value) for r in cl.date_claims(rows).collect())
    assert dates == [("a.md", "released in march year", 2021.0), ("b.md", "released in march year", 2035.0), ("b.md", "released in year", 2021.0), ("c.md", "released in march year", 2030.0)]
    found = cl.contradictions(cl.date_claims(rows), rows).collect()
    assert [(r.page_a, r.page_b, r.severity) for r in found] == [("a.md", "b.md", "error")]
    numbers = {(r.page, r.value) for r in cl.number_claims(rows).collect()}
    assert ("a.md", 1.0) in numbers and ("b.md", 1.0) in numbers


def test_severity_bounds(spark):
    claims = spark.createDataFrame([("a.md", 0, "k", "x", 0.0, "0"), ("b.md", 0, "k", "y", 10.0, "10"), ("b.md", 1, "k", "z", 99.0, "99"), ("c.md", 0, "k", "w", 10.01, "10.01")], cl.CLAIMS)
    rows = frame(spark, *[page(f"{x}.md", tags=["t"]) for x in "abc"])
    got = sorted((r.page_a, r.page_b, r.severity) for r in cl.contradictions(claims, rows).collect())
    assert got == [("a.md", "b.md", "warning"), ("a.md", "c.md", "error"), ("b.md", "c.md", "warning")]


def test_auto_links(spark):
    rows = frame(spark, page("ml.md", title="Deep Learning"), page("net.md", title="Learning"), page("x.md", "`Deep Learning` and deep learning, Learning; Learnings [[Learning]] Deep Learning", title="abc"))
    got = {r.path: r for r in cl.auto_links(rows).collect()}
    assert got["x.md"].content == "`Deep Learning` and [[ml|deep learning]], [[net|Learning]]; Learnings [[Learning]] Deep Learning" and got["x.md"].links_added == 2
    again = {r.path: r.content for r in cl.auto_links(rows, most_titles=1).collect()}
    assert again == {p: r.content for p, r in got.items()}  # blocks of titles change nothing
    odd = frame(spark, page("ml.md", title="Deep Learning"), page("y.md", "İstanbul has Deep Learning", title="abc"))
    assert {r.path: r.content for r in cl.auto_links(odd).collect()}["y.md"] == "İstanbul has [[ml|Deep Learning]]"


def test_fixed_words():
    assert sum(map(len, cl.TYPE_WORDS.values())) == 107 and len(cl.TAG_WORDS) == 55 and cl.TAG_WORDS["机器学习"] == "machine-learning"


def test_numbers_at_every_edge(spark):
    text = "5ms\n7 K, 1.5 million x 3s é 4sé 9sec 2 %" + "z" * 40 + "8fps"
    got = [(r.pos, r.raw_value, r.value, r.key) for r in cl.number_claims(frame(spark, page("a.md", text), page("b.md", None), page("c.md", ""), page("index.md", "5%"))).orderBy("pos").collect()]
    assert [(g[1], g[2]) for g in got] == [("5", 0.005), ("7", 7000.0), ("1.5", 1.5e6), ("3", 3.0), ("4", 4.0), ("2", 2.0), ("8", 8.0)]
    assert got[0][3].startswith("nms n k, n count x ns é nsé") and got[-1][3] == "z" * 30 + "nfps"


def test_graph(spark):
    e = spark.createDataFrame([(0, "a", "b", "k"), (1, "b", "c", "k"), (2, "c", "a", "k"), (3, "a", "c", "k"), (4, "d", "a", "k")], "ord long, src string, dst string, kind string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.depth for r in gr.reach(e, start).collect()} == {"a": 0, "b": 1, "c": 1}
    levels = gr.impact(e, start, 1)
    assert {r.id: r.depth for r in levels.collect()} == {"a": 0, "c": 1, "d": 1}
    assert sorted((r.src, r.dst) for r in gr.impact_edges(e, levels).collect()) == [("c", "a"), ("d", "a")]
    assert {r.id: (r.depth, r.ord) for r in gr.first_edges(e, start).collect()} == {"a": (0, None), "b": (1, 0), "c": (1, 3)}
    v = spark.createDataFrame([("program:A", "program", "A"), ("copybook:A", "copybook", "A"), ("program:B", "program", "B")], "id string, kind string, label string")
    want = spark.createDataFrame([("program:A",), ("b",), ("A",), ("zz",)], "name string")
    got = {r.name: (r.id, r.ambiguous) for r in gr.resolve_node(v, want).collect()}
    assert got == {"program:A": ("program:A", False), "b": ("program:B", False), "A": (None, True), "zz": (None, False)}
    chain = spark.createDataFrame([("a", "b"), ("x", "x")], "src string, dst string")
    assert sorted(r.id for r in gr.cascade_orphans(spark.createDataFrame([("a",), ("b",), ("x",), ("y",)], "id string"), chain).collect()) == ["a", "b"]


def test_lint_all_has_contradictions_raw_integrity_and_suggestions(spark):
    from quillmesh.operators import lint as li

    rows = frame(
        spark, page("a.md", "released in 2019", links=["b", "step-wrong"], tags=["t"]), page("b.md", "released in 2021", links=["a"], tags=["t"]), page("step-count.md", "the step count"),
    )
    files = spark.createDataFrame([("x", b"x", 1.0, 1, 1.0, "0"), ("y", b"y", 1.0, 1, None, None)], "path string, content binary, mtime double, size long, meta_mtime double, sha256 string")
    cache = spark.createDataFrame([], "path string, file_mtime double, file_size long, meta_mtime double, status string")
    got = {(r.severity, r.page, r.category): r for r in li.lint_all(rows, files, cache, 1_700_000_000_000_000).collect()}
    assert {("warning", "a.md", "contradiction"), ("error", "raw/x", "integrity"), ("warning", "raw/y", "integrity")} <= got.keys()
    assert got["warning", "a.md", "contradiction"].message == "Contradiction with [[b]]: released in year"
    assert got["error", "a.md", "broken-link"].suggestion.startswith("Did you mean: step-count.md")
