"""Queries over the package inventory, suggestions for broken links, synthesis contexts and stream windows, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lint as li
from ..operators import package as pk
from ..operators import pages as pg
from ..session import checkpoint_dir, spread, table
from ..streaming import streams as st
from .provenance import raw_state
from .wiki import _BROKEN, NOW

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def package_inventory(spark: SparkSession, d: str) -> DataFrame:
    return pk.inventory(table(spark, d, "wiki_pages"), table(spark, d, "raw_docs"), NOW)


def package_conformance(spark: SparkSession, d: str) -> DataFrame:
    return pk.conformance(package_inventory(spark, d), {"evidence_policy": {"allow_unsupported_pages": "reject"}, "source_policy": {"require_sha256": True}})


def lint_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """The three pages that a broken link may have meant."""
    return li.suggested(spread(table(spark, d, "wiki_pages")))


def page_lint_all(spark: SparkSession, d: str) -> DataFrame:
    """All nine rules."""
    return li.lint_all(table(spark, d, "wiki_pages"), *raw_state(spark, d), NOW)


def synthesis_context(spark: SparkSession, d: str) -> DataFrame:
    """Pages, titles and the union of tags that each synthesis page draws together through its derived pages."""
    pages = table(spark, d, "wiki_pages")
    parts = pages.where("type = 'synthesis'").select(F.col("path").alias("page"), F.explode("derived_from").alias("src"))
    named = pages.select("path", pg.slug_of(F.col("path")).alias("src"), "title", "tags")
    found = parts.withColumn("src", pg.slug_of(F.col("src"))).join(named, "src")
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>"))))))
    return found.groupBy("page").agg(F.count(F.lit(1)).alias("n_pages"), tags.alias("tags"))


def events_windows(spark: SparkSession, d: str) -> DataFrame:
    return st.weekly_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same windows through a stream that reads the events once; a row per window and type, so the result is small."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"

    def keep(counts: DataFrame, _: int) -> None:
        counts.write.mode("overwrite").parquet(f"{folder}/counts")  # the whole result of the mode, written by the executors

    query = st.weekly_counts(events).writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/counts").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


_SYS = "(path in ('index.md', 'log.md', 'timeline.md', 'evidence-report.md') or ends_with(path, '/index.md'))"
_MICROS = """case when regexp_matches(trim(updated), '[Tt ][0-9]{1,2}:') then
 epoch_us(try_cast(case when regexp_matches(trim(updated), '([Zz]|[+-][0-9]{1,2}:?[0-9]{0,2})$') then trim(updated) else trim(updated) || 'Z' end as timestamptz)) else epoch_us(try_cast(trim(updated) as timestamp)) end"""
_INV = f"""{_BROKEN}, w as (select *, {_SYS} sys, coalesce(len(sources), 0) > 0 src, coalesce(frontmatter['synthesis'], '') = 'true' or coalesce(type, '') = 'synthesis' syn, coalesce({NOW} - ({_MICROS}) > {90 * pk.DAY}, false) old from wiki_pages),
inv as (select count(*) pages, count(*) filter (sys) system_pages, count(*) filter (not sys and src) sourced, count(*) filter (not sys and syn) synthesis, count(*) filter (not sys and not src and not syn) unsupported,
 count(*) filter (not sys and old) stale, (select count(*) from raw_docs) raws, (select count(*) from raw_docs where sha256 is null) raws_without_hash, (select count(*) from broken) broken_links from w)"""
_WINDOWS = "select strftime(make_timestamp(epoch_us(ts) // 604800000000 * 604800000000), '%Y-%m-%d') \"start\", event_type, count(*) n from events group by 1, 2"

QUERIES = {f.__name__: f for f in (package_inventory, package_conformance, lint_suggestions, page_lint_all, synthesis_context, events_windows, stream_windows)}
ORACLE = {
    "package_inventory": f"with {_INV} select * from inv",
    "package_conformance": f"with {_INV}, c as (select 'error' severity, 'unsupported' kind, unsupported n from inv union all select 'warning', 'broken_links', broken_links from inv union all select 'error', 'raws_without_hash', raws_without_hash from inv union all select 'info', 'stale', stale from inv) select * from c where n > 0",
    "synthesis_context": r"""with p as (select path page, regexp_replace(unnest(derived_from), '\.md$', '') s from wiki_pages where type = 'synthesis'), f as (select page, tags from p join wiki_pages w on regexp_replace(w.path, '\.md$', '') = p.s)
 select page, count(*) n_pages, coalesce(list_sort(list_distinct(flatten(list(coalesce(tags, []))))), []) tags from f group by 1""",
    "events_windows": _WINDOWS,
    "stream_windows": _WINDOWS,
}
