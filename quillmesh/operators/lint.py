"""All nine lint rules: those of single pages, contradictions between pages, and raw integrity; broken links with suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem
from ..session import cut, spread
from .claims import all_claims, contradictions
from .pages import broken_links, issue, lint
from .ranking import best
from .raw import verify


def suggested(pages: DataFrame, most: int = 3) -> DataFrame:
    """(link, rank, path, score): the pages that a broken link may have meant."""
    links = broken_links(pages).select(F.col("link").alias("qid"), F.replace(F.regexp_replace("link", r"\.md$", ""), F.lit("-"), F.lit(" ")).alias("query")).distinct()
    return best(pages, links, most).select(F.col("qid").alias("link"), "rank", "path", "score")


def lint_all(pages: DataFrame, files: DataFrame, cache: DataFrame, now_micros: int, stale_days: int = 30) -> DataFrame:
    """The issues of `lint`, of contradictions and of raw files; `files` and `cache` as for `raw.verify`.

    Suggestions and contradictions are cut off first: as one plan with the rest they fill the driver.
    """
    pages = spread(pages)
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"])
    meant = cut(suggested(pages).groupBy("link").agg(F.array_join(ranked, ", ").alias("near")))
    broken = broken_links(pages).withColumn("page", F.col("path")).join(meant, "link", "left")
    create = F.concat(F.lit("Create "), "link", F.lit(".md or fix the link"))
    near = F.when(F.col("near").isNull(), create).otherwise(F.concat(F.lit("Did you mean: "), "near", F.lit("? Or create "), "link", F.lit(".md")))
    clash = cut(contradictions(cut(all_claims(pages)), pages)).withColumn("page", F.col("page_a"))
    quoted = F.concat(F.lit('"'), "excerpt_a", F.lit('" vs "'), "excerpt_b", F.lit('" — review and resolve'))
    raws = verify(files, cache).withColumn("page", F.concat(F.lit("raw/"), "path"))
    parts = [
        issue(broken, "error", "broken-link", F.concat(F.lit("Broken link: [["), "link", F.lit("]]")), near),
        issue(clash, F.col("severity"), "contradiction", F.concat(F.lit("Contradiction with [["), stem(F.col("page_b")), F.lit("]]: "), "claim"), quoted),
        issue(raws.where("status = 'corrupted'"), "error", "integrity", "Raw file corrupted: SHA-256 mismatch", "Re-download the original source"),
        issue(raws.where("status = 'missing-meta'"), "warning", "integrity", "Raw file has no metadata sidecar (.meta.yaml)", "Register the file", True),
    ]
    out = lint(pages, now_micros, stale_days).where("category <> 'broken-link'")
    for part in parts:
        out = out.unionByName(part)
    return out
