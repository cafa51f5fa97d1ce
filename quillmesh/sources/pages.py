"""File sources and sinks: pages with front matter, raw files with sidecars, event logs, office formats, settings."""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import wiki_links

PAGE = "path string, title string, type string, tags array<string>, sources array<string>, content string, frontmatter map<string,string>, created string, updated string, derived_from array<string>"


def _relative(root: str) -> Column:
    """The path below `root`; dot files and dot folders have a part that starts with a dot."""
    base = Path(root).resolve().as_posix().rstrip("/") + "/"
    full = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"^file:/*", "/")
    return F.substring(full, len(base) + 1, 100_000)


def _hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def page_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw) of every `.md` file below `root` but dot files."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return raw.select(_relative(root).alias("path"), F.col("value").alias("raw")).where(~_hidden(F.col("path")))


def parse_page(path: str, raw: str) -> dict:
    """One page: front matter by YAML, lists of strings, title from the file name if there is none. Broken YAML counts as none."""
    import yaml

    head, body = {}, raw
    if m := re.match(r"---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\Z)", raw, re.S):
        try:
            head, body = yaml.safe_load(m.group(1)) or {}, raw[m.end() :]
        except yaml.YAMLError:
            head, body = {}, raw
        head = head if isinstance(head, dict) else {}
    text = lambda v: v if isinstance(v, str) else v.isoformat() if hasattr(v, "isoformat") else json.dumps(v, ensure_ascii=False)
    listed = lambda v: [text(x) for x in v if x is not None] if isinstance(v, list) else []
    one = lambda k: None if head.get(k) is None else text(head[k])
    stem = re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1])
    return {
        "path": path, "title": one("title") or stem, "type": one("type"), "tags": listed(head.get("tags")), "sources": listed(head.get("sources")), "content": body,
        "frontmatter": {str(k): text(v) for k, v in head.items() if v is not None}, "created": one("created"), "updated": one("updated"), "derived_from": listed(head.get("derived_from")),
    }


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages below `root` with their links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([parse_page(p, r) for p, r in zip(b["path"], b["raw"])], columns=[c.split()[0] for c in PAGE.split(", ")])

    return page_files(spark, root).mapInPandas(run, PAGE).withColumn("links", wiki_links(F.col("content")))


def write_pages(pages: DataFrame, root: str) -> int:
    """Write pages as Markdown files with front matter; executors write their own rows, the driver gets a count."""
    target = str(Path(root).resolve())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            for r in b.to_dict("records"):
                head = {k: v for k, v in dict(r["frontmatter"] or {}).items()} | {k: r[k] for k in ("title", "type", "created", "updated") if r[k]}
                head |= {k: list(r[k]) for k in ("tags", "sources", "derived_from") if r[k] is not None and len(r[k])}
                file = safe_path(target, r["path"])
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_text("---\n" + yaml.safe_dump(head, sort_keys=False, allow_unicode=True) + "---\n" + (r["content"] or "").rstrip() + "\n", encoding="utf-8")
            yield pd.DataFrame({"n": [len(b)]})

    columns = [c.split()[0] for c in PAGE.split(", ")]
    return pages.select(*columns).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def safe_path(root: str, path: str) -> Path:
    """`path` below `root`; an absolute path or one that climbs out is refused."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if "\0" in path or not (full == base or base in full.parents):
        raise ValueError(f"path leaves its folder: {path!r}")
    return full


def allowed_source(path: str, allowed: list[str]) -> bool:
    full = Path(path).resolve()
    return any(full == Path(d).resolve() or Path(d).resolve() in full.parents for d in allowed)


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size, content) of every file below `root` but sidecars and dot files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    out = files.select(_relative(root).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return out.where(~_hidden(F.col("path")) & ~F.col("path").endswith(".meta.yaml"))


def count_files(spark: SparkSession, root: str) -> int:
    """Files below `root` without reading them."""
    return raw_files(spark, root).select("path").count()


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(path, meta) of the sidecars below `root`: path of the raw file, meta map<string,string>."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.yaml").text(root, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            rows = []
            for p, t in zip(b["path"], b["raw"]):
                try:
                    meta = yaml.safe_load(t) or {}
                except yaml.YAMLError:
                    meta = {}
                rows.append((p.removesuffix(".meta.yaml"), {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in meta.items()} if isinstance(meta, dict) else {}))
            yield pd.DataFrame(rows, columns=["path", "meta"])

    return raw.select(_relative(root).alias("path"), F.col("value").alias("raw")).mapInPandas(run, "path string, meta map<string,string>")


def raw_list(spark: SparkSession, root: str) -> DataFrame:
    """Raw documents with their sidecar, or with what the file itself tells where there is none."""
    from ..operators.raw import mime_of

    files, meta = raw_files(spark, root), sidecars(spark, root)
    of = lambda k: F.try_element_at("meta", F.lit(k))
    joined = files.join(meta, "path", "left")
    return joined.select(
        "path", of("sourceUrl").alias("source_url"), F.coalesce(of("downloadedAt"), F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("downloaded_at"),
        F.coalesce(of("sha256"), F.sha2("content", 256)).alias("sha256"), F.coalesce(of("size").try_cast("long"), "size").alias("size"), F.coalesce(of("mimeType"), mime_of(F.col("path"))).alias("mime_type"),
        F.col("meta").isNotNull().alias("has_meta"),
    )


EVENTS = "timestamp string, kind string, page string, abstain_reason string, top1_score double, top1_top2_ratio double, confidence string"


def read_events(spark: SparkSession, path: str, now: int, days: int = 30, schema: str = EVENTS) -> DataFrame:
    """Events of a JSON-lines log not older than `days`; malformed and undated lines drop out."""
    from ..functions.paths import iso_micros

    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    at = iso_micros(F.col("timestamp"))
    return rows.withColumn("ts", F.timestamp_micros(at)).where(at >= now - days * 86_400_000_000)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_artifact(df: DataFrame, path: str) -> None:
    """An artifact that a later run replaces."""
    df.write.mode("overwrite").json(path)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """(path, model, embedding), one partition per model."""
    vectors.write.mode("overwrite").partitionBy("model").parquet(path)


def load_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Vectors of one model; those of other models are never read."""
    return spark.read.parquet(path).where(F.col("model") == model)


# ---- office formats ----------------------------------------------------------------------

SEGMENTS = "file string, seg_no int, page int, sheet string, slide int, text string, column_headers string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    """Raw text of a document: paragraphs parted by an empty line, tabs and breaks kept."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        out.append("".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in p.iter()))
    return "\n\n".join(out)


def xlsx_sheets(data: bytes) -> list[tuple[str, str]]:
    """(sheet, CSV) of a workbook in its order; empty sheets drop out."""
    import csv

    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = rels[s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]
        rows = []
        for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{_S}c"):
                letters = re.match(r"[A-Z]*", c.get("r") or "").group()
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                v = c.find(f"{_S}v")
                kind = c.get("t")
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else "" if v is None else shared[int(v.text)] if kind == "s" else v.text or ""
            rows.append([cells.get(i, "") for i in range(max(cells) + 1)] if cells else [])
        buffer = io.StringIO()
        csv.writer(buffer, lineterminator="\n").writerows(rows)
        if text := buffer.getvalue().strip():
            out.append((s.get("name"), text))
    return out


def pptx_slides(data: bytes) -> list[tuple[int, str]]:
    """(number, text) of the slides in order of number; slides without text drop out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    found = sorted((int(m.group(1)), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    made = [(k, " ".join(re.sub(r"<[^>]+>", " ", z.read(n).decode("utf-8", "replace")).split())) for k, n in found]
    return [(k, t) for k, t in made if t]


def segments_of(file: str, data: bytes, pdf=None) -> list[tuple]:  # noqa: ANN001
    """Segments of one file: (page, sheet, slide, text, column_headers). `pdf` turns bytes into page texts; without it a PDF is an error."""
    ext = file.rsplit(".", 1)[-1].lower()
    if ext == "docx":
        return [(None, None, None, docx_text(data), None)]
    if ext == "xlsx":
        return [(None, n, None, t, t.split("\n", 1)[0] if "\n" in t else None) for n, t in xlsx_sheets(data)]
    if ext == "pptx":
        return [(None, None, k, t, None) for k, t in pptx_slides(data)]
    if ext == "pdf":
        if pdf is None:
            raise ValueError("no PDF extractor given")
        return [(i, None, None, t, None) for i, t in enumerate(pdf(data), 1)]
    text = data.decode("utf-8", "replace")
    if ext in ("html", "htm"):
        text = re.sub(r"<(script|style).*?</\1>", "", text, flags=re.S | re.I)
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"<[^>]+>", "\n", text)).strip()
    return [(None, None, None, text, None)]


def extract(files: DataFrame, pdf=None) -> DataFrame:  # noqa: ANN001
    """Segments of raw files (path, content); a file that cannot be read gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    rows += [(path, i, *s, None) for i, s in enumerate(segments_of(path, bytes(data), pdf), 1)]
                except Exception as e:  # noqa: BLE001 - one bad file must not end the batch
                    rows.append((path, 0, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])
            for c in ("seg_no", "page", "slide"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(run, SEGMENTS)


# ---- URLs and settings ---------------------------------------------------------------------


def arxiv_pdf(url: Column) -> Column:
    """An abstract page of the preprint server as its PDF; other URLs as they are."""
    return F.regexp_replace(url, r"^(https?://(?:www\.)?arxiv\.org)/abs/([^?#]+?)(?:\.pdf)?/?(?:[?#].*)?$", "$1/pdf/$2.pdf")


def confluence_parts(url: Column) -> Column:
    """struct(host, space, page_id) of a page URL; null parts where it has none."""
    none = lambda x: F.when(x != "", x)
    page = F.coalesce(none(F.regexp_extract(url, r"/pages/(\d+)", 1)), none(F.regexp_extract(url, r"[?&]pageId=(\d+)", 1)))
    return F.struct(none(F.regexp_extract(url, r"^https?://([^/?#]+)", 1)).alias("host"), none(F.regexp_extract(url, r"/(?:spaces|display)/([^/?#]+)", 1)).alias("space"), page.alias("page_id"))


def jira_parts(url: Column) -> Column:
    """struct(host, issue) of an issue URL."""
    none = lambda x: F.when(x != "", x)
    return F.struct(none(F.regexp_extract(url, r"^https?://([^/?#]+)", 1)).alias("host"), F.upper(none(F.regexp_extract(url, r"(?i)/(?:browse|issues)/([A-Z][A-Z0-9]*-\d+)", 1))).alias("issue"))


def adf_text(node: object) -> str:
    """Plain text of a rich-text tree: text nodes joined, blocks and breaks as line ends."""
    if isinstance(node, list):
        return "".join(adf_text(x) for x in node)
    if not isinstance(node, dict):
        return ""
    if node.get("type") == "text":
        return str(node.get("text", ""))
    inner = adf_text(node.get("content") or [])
    return "\n" if node.get("type") == "hardBreak" else inner + "\n" if node.get("type") in ("paragraph", "heading", "listItem", "codeBlock", "blockquote") else inner


@dataclass(frozen=True)
class Settings:
    """Where things lie and what lint checks; values given here win over environment, file and defaults."""

    workspace: str
    wiki_dir: str
    raw_dir: str
    stale_days: int = 30
    reject_unsupported: bool = False
    allowed_source_dirs: tuple[str, ...] = ()
    extra_system_callees: tuple[str, ...] = field(default=())


def load_settings(workspace: str | None = None, env: dict[str, str] | None = None, **given: object) -> Settings:
    """Settings of a workspace: arguments, then environment, then `quillmesh.yaml`, then defaults; lists of `quillmesh.local.yaml` are appended."""
    import yaml

    env = dict(os.environ) if env is None else env
    root = Path(workspace or env.get("QUILLMESH_WORKSPACE") or ".").resolve()
    read = lambda n: (yaml.safe_load((root / n).read_text()) or {}) if (root / n).exists() else {}
    file, local = read("quillmesh.yaml"), read("quillmesh.local.yaml")
    pick = lambda k, d: given.get(k, env.get(f"QUILLMESH_{k.upper()}", local.get(k, file.get(k, d))))
    both = lambda k: tuple(given.get(k) or [*(file.get(k) or []), *(local.get(k) or [])])
    flag = pick("reject_unsupported", False)
    return Settings(
        str(root), str(root / str(pick("wiki_dir", "wiki"))), str(root / str(pick("raw_dir", "raw"))), int(pick("stale_days", 30)), flag if isinstance(flag, bool) else str(flag).lower() in ("1", "true", "yes", "on"),
        both("allowed_source_dirs") or (str(root),), both("extra_system_callees"),
    )


def init_workspace(root: str) -> Settings:
    """Create the folders of a workspace; existing ones stay as they are."""
    s = load_settings(root)
    for d in (s.wiki_dir, s.raw_dir):
        Path(d).mkdir(parents=True, exist_ok=True)
    return s
