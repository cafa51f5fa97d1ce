"""Queries of the training-data operators over the test tables, and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import batches, distinctive, encoding, encodings, markup, mixing, neardup, splitting

PAGE_SIMILARITY, PAGE_WIDTH = 0.6, 3


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "wiki_pages")
    return pages.select(F.col("page_id").alias("id"), F.concat("title", F.lit(" "), "content").alias("text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    member, links = neardup.near_duplicates(page_texts(spark, d), PAGE_SIMILARITY, PAGE_WIDTH)
    return neardup.all_pairs(member, links).toDF("page_id_a", "page_id_b")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(page_texts(spark, d), PAGE_SIMILARITY, PAGE_WIDTH).withColumnRenamed("id", "page_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Loads of four batches, each probing the stored history."""
    return batches.duplicates(table(spark, d, "raw_docs"), batches.new_folder(spark), batches_per_load=4)


def p2_at_once(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p2_found from one load of all batches."""
    return batches.duplicates_at_once(table(spark, d, "raw_docs"), batches.new_folder(spark))


def p2_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """What became of every row: its batch, and the accepted row it repeats, if any; rows of size 0 are left out."""
    raw = table(spark, d, "raw_docs")
    return batches.decisions(raw, batches.new_folder(spark)).join(raw.select("raw_id", "batch_no"), "raw_id").select("batch_no", "raw_id", "accepted_id")


def _weights(spark: SparkSession, d: str) -> DataFrame:
    counts = distinctive.term_counts(table(spark, d, "search_docs"), "page_id", ["title_terms", "tag_terms", "body_terms"])
    return distinctive.log_entropy(cut(counts), "page_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive(_weights(spark, d), "page_id")


def p3_weights(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).withColumn("weight", F.round("weight", 6))


def _markup_records(spark: SparkSession, d: str) -> DataFrame:
    """Every text that may hold markup: tbl, page_id, host (first directory of the path), text."""
    host = F.regexp_extract(F.col("path"), r"^([^/]*)/", 1).alias("host")
    parts = [table(spark, d, t).select(F.lit(t).alias("tbl"), "page_id", host, F.col(c).alias("text")) for t, c in (("wiki_pages", "content"), ("search_docs", "body"))]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    held = [markup.held_markups(table(spark, d, t).select(F.lit(t).alias("tbl"), "page_id", c), "page_id", c, ["tbl"]) for t, c in (("wiki_pages", "content"), ("search_docs", "body"))]
    return held[0].unionByName(held[1]).distinct()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_texts(_markup_records(spark, d), "page_id", "text", ["tbl", "host"])


def p4_wrappers(spark: SparkSession, d: str) -> DataFrame:
    return markup.wrappers(p4_clean(spark, d).where("clean is not null").select("host", "blocks"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_segments(table(spark, d, "segments"), table(spark, d, "split_limits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(_pieces(spark, d))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_targets")).withColumn("reached_share", F.round("reached_share", 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.garbled(table(spark, d, "documents")).select("doc_id").distinct()


def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repaired(table(spark, d, "documents")).withColumn("posterior", F.round("posterior", 4))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_at_once, p2_by_batch, p3_found, p3_weights, p4_found, p4_clean, p4_wrappers, p5_found, p5_pieces, p7_ids, p8_mix, p8_shares, p9_found, p9_repaired)
}
