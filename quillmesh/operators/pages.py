"""Pages: sections, line windows, link resolution, link graph, catalogue, timeline, lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import iso_micros
from ..functions.text import lines, stem, title_case

SYSTEM = ("index.md", "log.md", "timeline.md", "evidence-report.md")
DAY = 86_400_000_000


def is_system(path: Column) -> Column:
    return path.isin(*SYSTEM) | path.endswith("/index.md")


def slug_of(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def _texts(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


# ---- sections and windows --------------------------------------------------------


def sections(pages: DataFrame, text: str = "content") -> DataFrame:
    """(path, pos, heading, level, content): section 0 is what precedes the first heading.

    Headings in code fences and in a leading front-matter block do not count. Null texts
    have no sections; an empty text has one empty section.
    """
    rows = pages.where(F.col(text).isNotNull()).select("path", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), lines(F.col(text)))).alias("n", "line"))
    so_far = W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    dashes = F.coalesce((F.trim("line") == "---").cast("int"), F.lit(0))
    opened = F.max(F.when(F.col("n") == 1, dashes).otherwise(0)).over(so_far)
    front = (opened == 1) & (F.sum(dashes).over(so_far) - dashes < 2) & (F.col("n") >= 1)
    rows = rows.withColumn("front", front)
    fence = F.coalesce((~F.col("front") & F.col("line").rlike(r"^(`{3,}|~{3,})")).cast("int"), F.lit(0))
    coded = F.sum(fence).over(so_far) % 2 == 1
    head = ~F.col("front") & ~coded & (fence == 0) & F.col("line").rlike(r"^#{1,6}\s+")
    rows = rows.withColumn("head", F.coalesce(head, F.lit(False)))
    rows = rows.withColumn("pos", F.sum(F.col("head").cast("int")).over(so_far))
    title = F.max(F.when(F.col("head"), F.regexp_replace("line", r"\s+$", "")))
    marks = F.length(F.regexp_extract(title, r"^(#{1,6})", 1))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("path", "pos").agg(F.coalesce(title, F.lit("")).alias("heading"), F.coalesce(marks, F.lit(0)).cast("int").alias("level"), joined.alias("content")).withColumn("pos", F.col("pos").cast("int"))


def toc(of: DataFrame) -> DataFrame:
    """(path, toc): headings indented from the shallowest level; pages without headings drop out."""
    heads = of.where("heading <> ''").withColumn("least", F.min("level").over(W.partitionBy("path")))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - F.col("least")), F.col("heading"))
    return heads.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("toc"))


def _bare_heading(heading: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(heading), r"^#{1,6}\s*", ""))


def section_read(of: DataFrame, wanted: str) -> DataFrame:
    """(path, heading, content, total_lines) of the first section whose heading holds `wanted`, with its deeper sections."""
    needle = F.lit(wanted.lower().lstrip("#").strip())
    hit = of.where(_bare_heading(F.col("heading")).contains(needle)).groupBy("path").agg(F.min(F.struct("pos", "level", "heading")).alias("t"))
    near = of.join(hit, "path")
    end = near.where((F.col("pos") > F.col("t.pos")) & (F.col("level") <= F.col("t.level")) & (F.col("heading") != "")).groupBy("path").agg(F.min("pos").alias("stop"))
    inside = near.join(end, "path", "left").where((F.col("pos") >= F.col("t.pos")) & (F.col("stop").isNull() | (F.col("pos") < F.col("stop"))))
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")
    out = inside.groupBy("path").agg(F.first("t.heading").alias("heading"), content.alias("content"))
    return out.withColumn("total_lines", F.size(lines(F.col("content"))))


def line_window(pages: DataFrame, offset: int = 0, limit: int = 200, text: str = "content") -> DataFrame:
    """(path, content, offset, lines_returned, total_lines, truncated, next_offset); `limit` lies within 1..500."""
    offset, limit = max(0, offset), min(500, max(1, limit))
    rows = pages.where(F.col(text).isNotNull()).select("path", lines(F.col(text)).alias("all"))
    part = F.slice("all", offset + 1, limit)
    more = F.size("all") > offset + limit
    return rows.select(
        "path", F.array_join(part, "\n").alias("content"), F.lit(offset).alias("offset"), F.size(part).alias("lines_returned"), F.size("all").alias("total_lines"), more.alias("truncated"),
        F.when(more, F.lit(offset + limit)).alias("next_offset"),
    )


# ---- links ------------------------------------------------------------------------


def wiki_links(text: Column) -> Column:
    """What double brackets name, in order, without labels."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.trim(F.split(x, r"\|")[0]))


def _page_keys(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode(F.array(F.concat(F.lit("p:"), "path"), F.concat(F.lit("s:"), stem(F.col("path"))))).alias("key")).distinct()


def unresolved(refs: DataFrame, pages: DataFrame, target: str) -> DataFrame:
    """The rows of `refs` whose `target` is no path, path without `.md`, or basename of a page."""
    t = F.col(target)
    bare = F.regexp_replace(t, r"\.md$", "")
    keys = F.array(F.concat(F.lit("p:"), bare, F.lit(".md")), F.concat(F.lit("p:"), t), F.concat(F.lit("s:"), t), F.concat(F.lit("s:"), bare))
    names = refs.select(t.alias("_t"), keys.alias("_k")).distinct().select("_t", F.explode("_k").alias("key"))
    known = names.join(_page_keys(pages), "key", "left_semi").select(F.col("_t").alias(target)).distinct()
    return refs.join(known, target, "left_anti")


def broken_links(pages: DataFrame) -> DataFrame:
    """(path, link) of every link mention without a page."""
    refs = pages.select("path", F.explode("links").alias("link")).where("link is not null")
    return unresolved(refs, pages, "link").select("path", "link")


def orphan_pages(pages: DataFrame) -> DataFrame:
    """(path) of the pages that no other page links by slug or full slug; system pages do not count as orphans."""
    links = pages.select(F.col("path").alias("src"), F.explode("links").alias("link")).distinct()
    named = pages.where(~is_system(F.col("path"))).select("path", F.explode(F.array_distinct(F.array(stem(F.col("path")), slug_of(F.col("path"))))).alias("link"))
    linked = named.join(links, "link").where("src <> path").select("path").distinct()
    return pages.where(~is_system(F.col("path"))).select("path").join(linked, "path", "left_anti")


def link_edges(pages: DataFrame) -> DataFrame:
    """(source, target, broken) of every link mention: exact slug, else a unique basename, else a ghost; no self-loops."""
    slugs = pages.select(slug_of(F.col("path")).alias("bare")).distinct().withColumn("by_slug", F.col("bare"))
    base = pages.select(stem(F.col("path")).alias("bare"), slug_of(F.col("path")).alias("s")).groupBy("bare").agg(F.min("s").alias("by_base"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    refs = pages.select(slug_of(F.col("path")).alias("source"), F.explode("links").alias("link")).where("link is not null").withColumn("bare", F.regexp_replace("link", r"\.md$", ""))
    found = refs.join(slugs, "bare", "left").join(base, "bare", "left")
    target = F.coalesce("by_slug", "by_base")
    edges = found.select("source", F.coalesce(target, F.concat(F.lit("__broken__:"), "link")).alias("target"), target.isNull().alias("broken"))
    return edges.where("source <> target")


def link_graph(pages: DataFrame) -> DataFrame:
    """One row per page and ghost: id, path, title, type, topic, in_degree, out_degree, degree, orphan, broken."""
    edges = link_edges(pages)
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("target").alias("id"), F.col("broken")).agg(F.count(F.lit(1)).alias("in_degree"))
    topic = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("")
    nodes = pages.select(slug_of(F.col("path")).alias("id"), "path", "title", "type", topic.alias("topic"), F.lit(False).alias("broken"))
    name = F.substring(F.col("id"), 12, 1_000_000)
    ghosts = into.where("broken").select("id", name.alias("path"), name.alias("title"), F.lit("broken").alias("type"), F.lit("").alias("topic"), "broken")
    whole = nodes.unionByName(ghosts).join(into.drop("broken"), "id", "left").join(out, "id", "left").fillna(0, ["in_degree", "out_degree"])
    return whole.withColumn("degree", F.col("in_degree") + F.col("out_degree")).withColumn("orphan", (F.col("in_degree") == 0) & ~F.col("broken"))


# ---- catalogue and timeline ---------------------------------------------------------


def directories(pages: DataFrame) -> DataFrame:
    """(dir, depth) of every directory on the way to a page."""
    parts = F.split("path", "/")
    paths = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    return pages.select(F.explode(paths).alias("dir")).distinct().withColumn("depth", F.size(F.split("dir", "/")))


def catalogue(pages: DataFrame) -> DataFrame:
    """(dir, n_pages): pages in and below each directory; the empty name is the root."""
    content = pages.where(~is_system(F.col("path")))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return content.select(F.explode(above).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("n_pages"))


def listing(pages: DataFrame) -> DataFrame:
    """(topic, type, n_pages, listing) of the pages right in a top directory: ordered catalogue text of each type."""
    content = pages.where(~is_system(F.col("path")))
    topic = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("")
    day = F.when(F.col("updated").isNotNull(), F.concat(F.lit(" _("), F.substring("updated", 1, 10), F.lit(")_"))).otherwise("")
    line = F.concat(F.lit("- [["), stem(F.col("path")), F.lit("]] — "), F.coalesce("title", F.lit("")), day)
    rows = content.select(topic.alias("topic"), F.coalesce("type", F.lit("uncategorized")).alias("type"), "path", line.alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("topic", "type").agg(F.count(F.lit(1)).alias("n_pages"), text.alias("listing"))


def timeline(pages: DataFrame) -> DataFrame:
    """(date, n, entries): pages by day of creation, else update, else `unknown`."""
    day = F.substring(F.coalesce("created", "updated", F.lit("unknown")), 1, 10)
    line = F.concat(F.lit("- **["), F.coalesce("type", F.lit("note")), F.lit("]** [["), slug_of(F.col("path")), F.lit("]] — "), F.coalesce("title", F.lit("")))
    rows = pages.where(~is_system(F.col("path"))).select(day.alias("date"), "path", line.alias("line"))
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("entries"))


def stale_indexes(pages: DataFrame) -> DataFrame:
    """(path) of directory indexes whose directory holds no page any more."""
    have = pages.where(F.col("path").endswith("/index.md")).select("path")
    want = directories(pages.where(~is_system(F.col("path")))).select(F.concat("dir", F.lit("/index.md")).alias("path"))
    return have.join(want, "path", "left_anti")


# ---- filters -------------------------------------------------------------------------


def list_pages(pages: DataFrame, type_: str | None = None, tag: str | None = None) -> DataFrame:
    out = pages
    if type_ is not None:
        out = out.where(F.col("type") == type_)
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    return out.select("path", "title", "type")


def glob(path: Column, pattern: str) -> Column:
    """`*.ext`, `*.{a,b}` and `**/` in front compare extensions without case, anything else the whole path."""
    low = F.lower(path)
    if pattern.endswith("}") and ".{" in pattern:
        wanted = [e.strip().lower() for e in pattern[pattern.rindex(".{") + 2 : -1].split(",")]
        return F.regexp_extract(F.substring_index(low, "/", -1), r"(?<=.)\.([^.]*)$", 1).isin(*wanted)
    if pattern.startswith("*."):
        return low.endswith(pattern[1:].lower())
    if pattern.startswith("**/"):
        return glob(path, pattern[3:])
    return path == pattern


# ---- lint ----------------------------------------------------------------------------


def issue(rows: DataFrame, severity: Column | str, category: str, message: Column | str, suggestion: Column | str, fixable: bool = False) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(text(severity).alias("severity"), "page", text(message).alias("message"), text(suggestion).alias("suggestion"), F.lit(fixable).alias("auto_fixable"), F.lit(category).alias("category"))


def lint(pages: DataFrame, now_micros: int, stale_days: int = 30) -> DataFrame:
    """The seven rules of single pages as one table of issues: severity, page, message, suggestion, auto_fixable, category.

    `lint.lint_all` adds contradictions, raw integrity and the pages a broken link may have meant.
    """
    p = pages.withColumn("page", F.col("path"))
    plain = ~is_system(F.col("path"))
    missing = p.where(F.coalesce(F.size("frontmatter"), F.lit(0)) <= 0)
    untitled = p.where(F.col("title").isNull() | (F.col("title") == "") | (F.col("title") == stem(F.col("path"))))
    orphans = orphan_pages(pages).withColumn("page", F.col("path"))
    broken = broken_links(pages).withColumn("page", F.col("path"))
    unsourced = p.where(plain & (F.size(_texts("sources")) == 0) & F.col("type").isNotNull() & ~F.col("type").isin("", "index", "log", "timeline"))
    derived = p.where("type = 'synthesis'").select("path", F.explode("derived_from").alias("src")).where("src is not null")
    lost = unresolved(derived, pages, "src").withColumn("page", F.col("path"))
    age = F.floor((F.lit(now_micros) - iso_micros(F.col("updated"))) / DAY)
    stale = p.withColumn("age", age).where(F.col("age") > stale_days)
    parts = [
        issue(missing, "warning", "structure", "No front matter", "Give the page a title, type, tags and sources", True),
        issue(untitled, "warning", "structure", "The title is empty or only the file name", "Write a title into the front matter"),
        issue(orphans, "warning", "orphan", "No page links here", F.concat(F.lit("Link [["), slug_of(F.col("page")), F.lit("]] where it belongs")), True),
        issue(broken, "error", "broken-link", F.concat(F.lit("Broken link: [["), "link", F.lit("]]")), F.concat(F.lit("Create "), "link", F.lit(".md or fix the link"))),
        issue(unsourced, "info", "missing-source", "The page names no source", "Name the raw documents behind it"),
        issue(lost, "error", "integrity", F.concat(F.lit("Derived from a page that is gone: "), "src"), "Look for what replaced it"),
        issue(stale, "info", "stale", F.concat(F.lit("Last updated days ago: "), F.col("age").cast("string")), "Read it again"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fixed_titles(pages: DataFrame) -> DataFrame:
    """(path, title) for pages without front matter: the file name in title case."""
    return pages.where(F.coalesce(F.size("frontmatter"), F.lit(0)) <= 0).select("path", title_case(F.replace(stem(F.col("path")), F.lit("-"), F.lit(" "))).alias("title"))
