"""Raw documents: versions, types, coverage by pages, integrity by hash with a cache, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import is_url, raw_path, url_key

#: Media types by extension (fixed values).
MIME = {
    "md": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "ts": "text/javascript", "csv": "text/csv", "xml": "text/xml",
    "json": "application/json", "yaml": "text/yaml", "yml": "text/yaml", "toml": "text/plain", "ini": "text/plain", "log": "text/plain", "sh": "text/x-shellscript", "py": "text/x-python",
    "java": "text/x-java", "c": "text/x-c", "cpp": "text/x-c++", "rs": "text/x-rust", "go": "text/x-go", "rb": "text/x-ruby", "sql": "application/sql", "r": "text/plain", "cbl": "text/x-cobol",
    "cob": "text/x-cobol", "cpy": "text/x-cobol", "jcl": "text/plain", "pli": "text/plain", "pdf": "application/pdf", "rtf": "application/rtf", "epub": "application/epub+zip",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "ppt": "application/vnd.ms-powerpoint", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "avif": "image/avif", "bmp": "image/bmp", "ico": "image/x-icon", "tiff": "image/tiff", "tif": "image/tiff", "mp3": "audio/mpeg",
    "wav": "audio/wav", "ogg": "audio/ogg", "flac": "audio/flac", "aac": "audio/aac", "m4a": "audio/mp4", "mp4": "video/mp4", "webm": "video/webm", "mkv": "video/x-matroska",
    "mov": "video/quicktime", "avi": "video/x-msvideo", "zip": "application/zip", "gz": "application/gzip", "tar": "application/x-tar", "7z": "application/x-7z-compressed",
    "rar": "application/x-rar-compressed", "bz2": "application/x-bzip2", "wasm": "application/wasm", "sqlite": "application/x-sqlite3", "db": "application/x-sqlite3",
    "parquet": "application/octet-stream", "arrow": "application/octet-stream",
}
OTHER_MIME = "application/octet-stream"


def extension(path: Column) -> Column:
    """The lower-case extension of the last path part without its dot; empty if there is none."""
    return F.regexp_extract(F.lower(F.substring_index(path, "/", -1)), r"(?<=.)\.([^.]*)$", 1)


def mime_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(OTHER_MIME))


def versions(files: DataFrame) -> DataFrame:
    """(path, root, ext, version, latest): `x.ext` is version 1, `x_vN.ext` version N; null paths drop out."""
    ext = F.regexp_extract("path", r"(?<=[^/])(\.[^./]*)$", 1)
    base = F.expr("substring(path, 1, length(path) - length(ext))")
    of = files.where("path is not null").select("path", ext.alias("ext")).distinct().withColumn("base", base)
    number = F.regexp_extract("base", r"^.+_v(\d+)$", 1)
    root = F.when(number != "", F.regexp_extract("base", r"^(.+)_v\d+$", 1)).otherwise(F.col("base"))
    parsed = of.select("path", root.alias("root"), "ext", F.when(number != "", number.cast("int")).otherwise(1).alias("version"))
    order = W.partitionBy("root", "ext").orderBy(F.desc("version"), F.desc("path"))
    return parsed.withColumn("latest", F.row_number().over(order) == 1)


def next_versions(files: DataFrame) -> DataFrame:
    """(root, ext, next_path): the first free version name of each root."""
    return versions(files).groupBy("root", "ext").agg((F.max("version") + 1).alias("n")).select("root", "ext", F.concat("root", F.lit("_v"), F.col("n").cast("string"), "ext").alias("next_path"))


def page_references(pages: DataFrame) -> DataFrame:
    """(key): what pages name as raw path (`p:`) or URL (`u:`), in their sources and as raw/... in their text."""
    trimmed = F.regexp_replace(F.col("src"), r"^\s+|\s+$", "")
    named = pages.select(F.explode("sources").alias("src")).where("src is not null")
    of_sources = named.select(F.when(is_url(trimmed), F.concat(F.lit("u:"), url_key(trimmed))).otherwise(F.concat(F.lit("p:"), raw_path(F.col("src")))).alias("key"))
    inline = F.transform(F.regexp_extract_all("content", F.lit(r"\braw/(\S+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"[.,;:!?)\]`\"'*]+$", ""))
    of_text = pages.where(F.col("content").contains("raw/")).select(F.explode(inline).alias("x")).where("x <> ''").select(F.concat(F.lit("p:"), "x").alias("key"))
    return of_sources.union(of_text).distinct()


def uncovered(raws: DataFrame, pages: DataFrame, tag: str | None = None) -> DataFrame:
    """The raw documents that no page names by path or URL; `parsed/` ones are left out. Two anti joins, no OR."""
    of = coverable(raws, tag)
    keys = page_references(pages)
    by_path = of.join(keys.select(F.col("key").alias("_p")), F.concat(F.lit("p:"), raw_path(F.col("path"))) == F.col("_p"), "left_anti")
    return by_path.join(keys.select(F.col("key").alias("_u")), F.concat(F.lit("u:"), url_key(F.trim("source_url"))) == F.col("_u"), "left_anti")


def coverable(raws: DataFrame, tag: str | None = None) -> DataFrame:
    of = raws.where(~raw_path(F.col("path")).startswith("parsed/"))
    return of.where(F.array_contains("tags", tag)) if tag is not None else of


def coverage(raws: DataFrame, pages: DataFrame, tag: str | None = None) -> DataFrame:
    """One row: total_raw, covered_raw, uncovered_raw, coverage_ratio (1 if there is nothing to cover)."""
    total = coverable(raws, tag).agg(F.count(F.lit(1)).alias("total_raw"))
    open_ = uncovered(raws, pages, tag).agg(F.count(F.lit(1)).alias("uncovered_raw"))
    both = total.join(open_)  # one row each
    covered = F.col("total_raw") - F.col("uncovered_raw")
    return both.select("total_raw", covered.alias("covered_raw"), "uncovered_raw", F.when(F.col("total_raw") > 0, covered / F.col("total_raw")).otherwise(F.lit(1.0)).alias("coverage_ratio"))


def uncovered_page(raws: DataFrame, pages: DataFrame, sort: str = "newest", limit: int = 50) -> DataFrame:
    """The first `limit` uncovered documents: newest, oldest or largest first, then by raw_id."""
    order = {"newest": F.desc_nulls_last("downloaded_at"), "oldest": F.asc_nulls_last("downloaded_at"), "largest": F.desc_nulls_last("size")}[sort]
    return uncovered(raws, pages).orderBy(order, "raw_id").limit(limit).select("raw_id", "path", "size", "mime_type", "downloaded_at", "source_url")


def verify(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, status, hashed): ok, corrupted or missing-meta; hashes only what the cache does not know unchanged.

    `files`: path, content (binary), mtime, size, meta_mtime and sha256 (null without
    sidecar). `cache`: path, file_mtime, file_size, meta_mtime, status. The content of a
    cached file never reaches the hash, as it joins only after the split.
    """
    known = cache.select("path", F.col("file_mtime").alias("_m"), F.col("file_size").alias("_s"), F.col("meta_mtime").alias("_mm"), F.col("status").alias("_status"))
    of = files.join(known, "path", "left")
    hit = (F.col("_m") == F.col("mtime")) & (F.col("_s") == F.col("size")) & (F.col("_mm") == F.col("meta_mtime"))
    fresh = F.when(F.sha2(F.col("content"), 256) == F.lower("sha256"), "ok").otherwise("corrupted")
    missing = F.col("meta_mtime").isNull()
    status = F.when(missing, "missing-meta").when(hit, F.col("_status")).otherwise(fresh)
    return of.select("path", status.alias("status"), (~missing & ~F.coalesce(hit, F.lit(False))).alias("hashed"))


def add(catalog: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, refused): `new` (path, content, ...) with sha256, size and mime_type; a known path is refused, as raws never change."""
    first = new.withColumn("_rn", F.row_number().over(W.partitionBy("path").orderBy(F.sha2("content", 256)))).where("_rn = 1").drop("_rn")
    named = first.withColumn("sha256", F.sha2("content", 256)).withColumn("size", F.length("content").cast("long")).withColumn("mime_type", mime_of(F.col("path")))
    return named.join(catalog.select("path"), "path", "left_anti"), named.join(catalog.select("path"), "path", "left_semi").select("path")


def upsert_pages(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Pages after a write: the new row wins, `created` is kept from the old one, `updated` becomes `now`."""
    before = old.select("path", F.col("created").alias("_created"))
    written = new.join(before, "path", "left").withColumn("created", F.coalesce("created", "_created", now)).withColumn("updated", now).drop("_created")
    return old.join(new.select("path"), "path", "left_anti").unionByName(written)


def delete_pages(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """Pages without the named ones; system pages stay."""
    from .pages import is_system

    return pages.join(paths.where(~is_system(F.col("path"))).select("path"), "path", "left_anti")


def line_read(raws: DataFrame, offset: int = 0, limit: int = 200) -> DataFrame:
    """A line window over the extracted text; without a window a read is cut at 10,000 characters."""
    from .pages import line_window

    return line_window(raws, offset, limit, "body")


def text_read(raws: DataFrame, most: int = 10_000) -> DataFrame:
    return raws.where("body is not null").select("raw_id", F.substring("body", 1, most).alias("content"), (F.length("body") > most).alias("truncated"))


def image_blocks(files: DataFrame, most: int = 10 * 1024 * 1024) -> DataFrame:
    """(path, data, mime_type) of raster images up to `most` bytes, in base64."""
    kind = mime_of(F.col("path"))
    return files.where(kind.startswith("image/") & (kind != "image/svg+xml") & (F.length("content") <= most)).select("path", F.base64("content").alias("data"), kind.alias("mime_type"))
