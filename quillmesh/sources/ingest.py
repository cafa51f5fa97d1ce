"""Batch ingest of a folder: filter, import once, extract, chunk, pack; errors beside the results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import chunks, packs
from ..operators.pages import glob, sections
from ..operators.raw import extension, mime_of
from .pages import allowed_source, extract, raw_files

OFFICE = ("pdf", "docx", "xlsx", "pptx", "html", "htm")


@dataclass(frozen=True)
class Ingest:
    """What an ingest brings: files new to the catalog, known ones, chunks with their packs, and errors."""

    added: DataFrame
    known: DataFrame
    chunks: DataFrame
    packs: DataFrame
    errors: DataFrame


def ingest(spark: SparkSession, root: str, catalog: DataFrame, topic: str, allowed: list[str], pattern: str | None = None, pack_lines: int = 500, chunk_lines: int = 100, pdf=None) -> Ingest:  # noqa: ANN001
    """Ingest the files below `root` that match `pattern`. `catalog` (path) holds what was imported before.

    Text files are cut at headings if they have more than one section that is not blank;
    other formats by their pages, sheets and slides; then into chunks of `chunk_lines`.
    """
    if not allowed_source(root, allowed):
        raise ValueError(f"folder is not allowed: {root!r}")
    pack_lines = max(50, pack_lines)
    chunk_lines = min(max(10, chunk_lines), pack_lines)
    files = raw_files(spark, root).withColumn("source", F.col("path")).withColumn("path", F.concat(F.lit(f"{topic}/"), "path"))
    if pattern is not None:
        files = files.where(glob(F.col("source"), pattern))
    office = extension(F.col("path")).isin(*OFFICE)
    kind = mime_of(F.col("path"))
    plain = ~office & (kind.startswith("text/") | kind.isin("application/json", "application/xml", "application/sql", "application/x-yaml"))
    extracted = extract(files.where(office), pdf)
    text = files.where(plain).select("path", F.col("content").cast("string").alias("content"))
    of_text = sections(text).where(F.trim("content") != "").select(F.col("path").alias("file"), (F.col("pos") + 1).alias("seg_no"), F.col("content").alias("text"), F.lit(None).cast("string").alias("column_headers"))
    segments = extracted.where("error is null").select("file", "seg_no", "text", "column_headers").unionByName(of_text).withColumn("seg_id", F.xxhash64("file", "seg_no"))
    made = chunks(segments, chunk_lines).withColumn("topic", F.lit(topic))
    errors = extracted.where("error is not null").select("file", F.lit("extract").alias("stage"), "error")
    return Ingest(files.join(catalog.select("path"), "path", "left_anti"), files.join(catalog.select("path"), "path", "left_semi"), made, packs(made, pack_lines), errors)
