"""References to records that do not exist.

Parent and child keys go, tagged, into one long form `(parent_table, key, ...)`. One
aggregation per `(parent_table, key)` finds whether the key has a live parent and since
when; only that one row per key meets the single references again. Popular keys (a link
target that a third of all rows name) are pre-aggregated on the map side, and the join
back sends references of hot keys through a broadcast of at most `hot_keys_at_most` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_url, iso_micros, last_part, raw_path, stamp_micros, strip_md, url_key

#: Keys that hold more than this share of all references are joined by broadcast; there are at most 1/share of them.
HOT_SHARE = 0.001


def live_parents(records: DataFrame, deletions: DataFrame) -> DataFrame:
    """`(parent_table, path, ..., born)` without deleted records.

    `records`: parent_table, path, born (micros or null) and key columns. `deletions`:
    parent_table, path, gone (micros). A record is deleted by a deletion at or after
    `born`, or by any deletion if `born` is null. A null path is never deleted.
    """
    last = deletions.where(F.col("gone").isNotNull()).groupBy("parent_table", "path").agg(F.max("gone").alias("last_gone"))
    joined = records.distinct().join(last, ["parent_table", "path"], "left")
    dead = F.col("last_gone").isNotNull() & (F.col("born").isNull() | (F.col("last_gone") >= F.col("born")))
    return joined.where(~dead).drop("last_gone")


def orphan_references(children: DataFrame, parents: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """The rows of `children` whose key has no parent that was alive at the child's time.

    `children`: parent_table, key, at (micros or null) and any other columns except
    `_since`, `_n`. `parents`: parent_table, key, born (micros or null), live ones only.
    A parent with null `born` was always there; a child with null `at` sees every parent.
    Null and empty keys match nothing and are orphans; repeated rows stay repeated.
    """
    always = F.lit(-(2**62))
    long_form = parents.select("parent_table", "key", F.coalesce("born", always).alias("_since"), F.lit(0).alias("_child")).unionByName(
        children.select("parent_table", "key", F.lit(None).cast("long").alias("_since"), F.lit(1).alias("_child"))
    )
    verdict = (
        long_form.where(F.col("key").isNotNull())
        .groupBy("parent_table", "key")
        .agg(F.min("_since").alias("_since"), F.sum("_child").alias("_n"))
        .where((F.col("_n") > 0) & F.col("_since").isNotNull())
    )
    total = children.agg(F.count(F.lit(1)).alias("_total"))
    hot = verdict.join(F.broadcast(total), F.col("_n") > F.greatest(F.col("_total") * hot_share, F.lit(10_000))).select(
        "parent_table", "key", F.col("_since").alias("_hot_since")
    )
    # hot keys are at most 1/hot_share rows: each holds more than that share of the references
    tagged = children.join(F.broadcast(hot), ["parent_table", "key"], "left")
    cold = verdict.select("parent_table", "key", "_since")
    salted_null = F.when(F.col("_hot_since").isNull(), F.col("key"))  # hot rows need no partner and must not meet in one task
    rest = (
        tagged.withColumn("_join_key", F.coalesce(salted_null, F.concat(F.lit("\u0000"), F.hash(*children.columns).cast("string"))))
        .join(cold.withColumnRenamed("key", "_join_key"), ["parent_table", "_join_key"], "left")
        .withColumn("_since", F.coalesce("_hot_since", "_since"))
    )
    seen = F.col("_since").isNotNull() & (F.col("at").isNull() | (F.col("_since") <= F.col("at")))
    return rest.where(~seen).select(*children.columns)


def orphan_report(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Per field and period (of the child's time, null without time) the number of references, keys and records."""
    at = F.date_trunc(period, F.timestamp_micros("at"))
    keyed = orphans.withColumn("period", F.date_format(at, "yyyy-MM-dd"))
    return keyed.groupBy("ref_kind", "period").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("key").alias("n_targets"), F.countDistinct("page_id").alias("n_pages")
    )


def wiki_references(pages: DataFrame) -> DataFrame:
    """`links` and `sources` of pages as references: page_id, ref_kind, target, parent_table, key, at."""
    at = F.coalesce(iso_micros(F.col("updated")), iso_micros(F.col("created"))).alias("at")
    links = pages.select("page_id", at, F.explode("links").alias("target")).select(
        "page_id", F.lit("link").alias("ref_kind"), "target", F.lit("page").alias("parent_table"), strip_md(F.col("target")).alias("key"), "at"
    )
    sources = pages.select("page_id", at, F.explode("sources").alias("target"))
    url = is_url(F.col("target"))
    sources = sources.select(
        "page_id",
        F.lit("source").alias("ref_kind"),
        "target",
        F.when(url, F.lit("raw_url")).otherwise(F.lit("raw_path")).alias("parent_table"),
        F.when(url, url_key(F.col("target"))).otherwise(raw_path(F.col("target"))).alias("key"),
        "at",
    )
    return links.unionByName(sources).where(F.col("target").isNotNull())


def wiki_parents(pages: DataFrame, raw_docs: DataFrame, deletions: DataFrame) -> DataFrame:
    """Live pages and raw documents under every key by which they can be named: parent_table, key, born."""
    page = pages.select(F.lit("wiki_pages").alias("parent_table"), "path", F.lit(None).cast("string").alias("url"), iso_micros(F.col("created")).alias("born"))
    raw = raw_docs.select(
        F.lit("raw_docs").alias("parent_table"), raw_path(F.col("path")).alias("path"), url_key(F.col("source_url")).alias("url"), stamp_micros(F.col("downloaded_at")).alias("born")
    )
    gone = deletions.select(
        F.col("tbl").alias("parent_table"),
        F.when(F.col("tbl") == "raw_docs", raw_path(F.col("path"))).otherwise(F.col("path")).alias("path"),
        stamp_micros(F.col("deleted_at")).alias("gone"),
    )
    alive = live_parents(page.unionByName(raw), gone)
    wiki = F.col("parent_table") == "wiki_pages"
    path_key = F.array(F.struct(F.lit("page").alias("t"), strip_md(F.col("path")).alias("k")), F.struct(F.lit("page").alias("t"), strip_md(last_part(F.col("path"))).alias("k")))
    raw_key = F.array(F.struct(F.lit("raw_path").alias("t"), F.col("path").alias("k")), F.struct(F.lit("raw_url").alias("t"), F.col("url").alias("k")))
    return (
        alive.select("born", F.explode(F.when(wiki, path_key).otherwise(raw_key)).alias("x"))
        .select(F.col("x.t").alias("parent_table"), F.col("x.k").alias("key"), "born")
        .where(F.col("key").isNotNull())
    )


def wiki_orphans(pages: DataFrame, raw_docs: DataFrame, deletions: DataFrame) -> DataFrame:
    """References of pages that no living, earlier record answers; one row per reference.

    Null, empty or missing link lists give no reference. A page without times sees every
    record. Repeated references stay repeated here; callers take `distinct` for cases.
    """
    return orphan_references(wiki_references(pages), wiki_parents(pages, raw_docs, deletions))
