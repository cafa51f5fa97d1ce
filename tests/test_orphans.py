from datetime import datetime

from quillmesh.operators.orphans import orphan_references, wiki_orphans

PAGE = "page_id long, path string, links array<string>, sources array<string>, created string, updated string, born int, at string, key string"
RAW = "path string, source_url string, downloaded_at timestamp, size long"
LOG = "tbl string, path string, deleted_at timestamp"


def page(i, path, links=None, sources=None, created=None, updated=None):
    return (i, path, links, sources, created, updated, 1, "x", "y")


def run(spark, pages, raws=(), log=()):
    frames = spark.createDataFrame(list(pages), PAGE), spark.createDataFrame(list(raws), RAW), spark.createDataFrame(list(log), LOG)
    return sorted((r.page_id, r.ref_kind, r.target) for r in wiki_orphans(*frames).select("page_id", "ref_kind", "target").distinct().collect())


def test_links_match_path_or_last_part_with_case(spark):
    links = ["a/x", "x.md", "X", "y", None, "", "a/x.md"]
    assert run(spark, [page(1, "a/x.md", links)]) == [(1, "link", ""), (1, "link", "X"), (1, "link", "y")]


def test_sources_by_url_and_path(spark):
    raws = [("./raw/f/a.pdf ", "HTTPS://Host.Example/P/", datetime(2024, 1, 1), 5)]
    sources = ["f/a.pdf", "raw/f/a.pdf", "https://host.example/P", "https://host.example/p", "f/b.pdf"]
    assert run(spark, [page(1, "x.md", None, sources, updated="2024-02-01")], raws) == [(1, "source", "f/b.pdf"), (1, "source", "https://host.example/p")]


def test_later_deleted_and_timeless(spark):
    pages = [
        page(1, "p1.md", ["p2", "p3", "p4"], created="2024-01-05T00:00:00+09:00"),
        page(2, "p2.md", None, created="2024-01-04T15:00:01Z"),
        page(3, "p3.md", None, created=None),
        page(4, "p4.md", None, created="2023-01-01"),
        page(5, "p5.md", ["p2", "p4"], created="no time"),
    ]
    log = [("wiki_pages", "p4.md", datetime(2022, 1, 1)), ("wiki_pages", "p3.md", datetime(2020, 1, 1)), ("wiki_pages", "p4.md", datetime(2022, 1, 1))]
    assert run(spark, pages, log=log) == [(1, "link", "p2"), (1, "link", "p3")]


def test_empty_tables_and_hot_keys(spark):
    assert run(spark, []) == []
    children = spark.range(30_000).selectExpr("id page_id", "'page' parent_table", "if(id % 3 = 0, concat('k', id), if(id % 3 = 1, 'hot', 'gone')) key", "10L at", "id extra")
    parents = spark.createDataFrame([("page", "hot", 5), ("page", "gone", 11), ("page", "k3", None)], "parent_table string, key string, born long")
    lost = orphan_references(children, parents, hot_share=0.001)
    assert lost.columns == children.columns
    assert lost.where("key = 'hot'").count() == 0 and lost.where("key = 'gone'").count() == 10_000 and lost.count() == 19_999
