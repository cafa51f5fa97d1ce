"""Event telemetry: windows, weekly buckets aligned to now, ratios, histograms, gates, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import stamp_micros

DAY = 86_400_000_000
WEEK = 7 * DAY
RETENTION_DAYS, RETENTION_BYTES = 30, 10 * 1024 * 1024
#: Gates of the readiness check (fixed values).
LEAST_WRITES, MOST_WEEKLY_RATIO, MOST_ABSTAIN_RATIO, LEAST_SEARCHES = 50, 0.05, 0.30, 10
BLOCKED = ("unsupported", "rejected")


def within(events: DataFrame, now: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Events not older than `days` before `now` (microseconds); events without time drop out."""
    return events.where(stamp_micros(F.col("ts")) >= now - days * DAY)


def weekly(events: DataFrame, now: int, weeks: int = 4) -> DataFrame:
    """(week_no, week_start, total_writes, unsupported_or_rejected) of the trailing weeks `[start, end)`, empty ones with zeros."""
    back = F.ceil((F.lit(now) - stamp_micros(F.col("ts"))) / WEEK).cast("int") - 1
    counted = (
        events.where(stamp_micros(F.col("ts")) < now)
        .withColumn("week_no", back)
        .where(F.col("week_no").between(0, weeks - 1))
        .groupBy("week_no")
        .agg(F.count(F.lit(1)).alias("total_writes"), F.count_if(F.col("kind").isin(*BLOCKED)).alias("unsupported_or_rejected"))
    )
    spine = events.sparkSession.range(weeks).select(F.col("id").cast("int").alias("week_no"))
    start = F.date_format(F.timestamp_micros(F.lit(now) - (F.col("week_no") + 1) * F.lit(WEEK)), "yyyy-MM-dd")
    return spine.join(counted, "week_no", "left").fillna(0).select("week_no", start.alias("week_start"), "total_writes", "unsupported_or_rejected")


def search_trust(searches: DataFrame) -> DataFrame:
    """One row: searches, abstentions and their ratio, median of the best score, histogram of the ratio of the two best."""
    r = F.col("top1_top2_ratio")
    return searches.agg(
        F.count(F.lit(1)).alias("total_searches"),
        F.count_if(F.col("abstain_reason").isNotNull()).alias("abstain_count"),
        F.try_divide(F.count_if(F.col("abstain_reason").isNotNull()), F.count(F.lit(1))).alias("abstain_ratio"),
        F.median("top1_score").alias("median_top1"),
        F.count_if(r < 1.5).alias("lt15"),
        F.count_if((r >= 1.5) & (r < 2)).alias("lt20"),
        F.count_if((r >= 2) & (r < 3)).alias("lt30"),
        F.count_if(r >= 3).alias("ge30"),
    )


def last_week(events: DataFrame, now: int) -> DataFrame:
    """One row over the last seven days: total, unsupported and rejected writes and the ratio of the latter two, null without writes."""
    recent = events.where(stamp_micros(F.col("ts")) >= now - WEEK)
    count = F.count(F.lit(1))
    return recent.agg(
        count.alias("total_writes"), F.count_if(F.col("kind") == "unsupported").alias("unsupported_writes"), F.count_if(F.col("kind") == "rejected").alias("rejected_writes"),
        F.try_divide(F.count_if(F.col("kind").isin(*BLOCKED)), count).alias("would_reject_ratio"),
    )


def readiness(weeks: DataFrame, trust: DataFrame) -> DataFrame:
    """One row: the gates and their joint status."""
    ratio = F.try_divide("unsupported_or_rejected", "total_writes")
    w = weeks.agg(F.sum("total_writes").alias("writes"), F.bool_and(F.coalesce(ratio < MOST_WEEKLY_RATIO, F.lit(True))).alias("weekly_passing"))
    both = w.join(trust.select("total_searches", "abstain_ratio"))  # one row each
    enough = F.col("writes") >= LEAST_WRITES
    applicable = (F.col("total_searches") >= LEAST_SEARCHES) & F.col("abstain_ratio").isNotNull()
    abstain = ~applicable | (F.col("abstain_ratio") <= MOST_ABSTAIN_RATIO)
    status = F.when(~enough, "insufficient-data").when(F.col("weekly_passing") & abstain, "ready").otherwise("not-ready")
    return both.select("writes", enough.alias("writes_passing"), "weekly_passing", applicable.alias("abstain_applicable"), abstain.alias("abstain_passing"), status.alias("status"))


def transitions(events: DataFrame, key: str, state: Column) -> DataFrame:
    """The events at which `state` becomes true, per key in order of time."""
    order = W.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("_s", state).withColumn("_before", F.coalesce(F.lag("_s").over(order), F.lit(False))).where(F.col("_s") & ~F.col("_before")).drop("_s", "_before")


def rotate(events: DataFrame, now: int, size: Column, most_bytes: int = RETENTION_BYTES, days: int = RETENTION_DAYS) -> DataFrame:
    """The newest events that fit: first by age, then by a running sum of sizes (plus one byte each) from the newest.

    The running sum goes day by day: whole days are summed first, and only the day on
    which the limit falls is ordered event by event, so no task holds all events.
    """
    kept = within(events, now, days).withColumn("_bytes", (size + 1).cast("long")).withColumn("_day", F.floor(stamp_micros(F.col("ts")) / DAY))
    by_day = kept.groupBy("_day").agg(F.sum("_bytes").alias("_sum"))
    newer = by_day.withColumn("_newer", F.coalesce(F.sum("_sum").over(W.orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_day", "_newer")
    inside = W.partitionBy("_day").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = kept.join(F.broadcast(newer), "_day")  # at most `days` + 1 rows
    return whole.withColumn("_run", F.sum("_bytes").over(inside) + F.col("_newer")).where(F.col("_run") <= most_bytes).drop("_bytes", "_day", "_newer", "_run")


def page_classes(pages: DataFrame) -> DataFrame:
    """(class, n) of the content pages: synthesis, grounded, unsupported, legacy or other, the first that holds."""
    from .pages import is_system

    mark = lambda k: F.coalesce(F.try_element_at("frontmatter", F.lit(k)) == "true", F.lit(False))
    kind = (
        F.when(mark("synthesis") | (F.col("type") == "synthesis"), "synthesis").when(F.size(F.coalesce("sources", F.array().cast("array<string>"))) > 0, "grounded")
        .when(mark("unsupported"), "unsupported").when(mark("legacyUnsupported"), "legacy").otherwise("other")
    )
    return pages.where(~is_system(F.col("path"))).groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(family, tp, fp, fn, precision, recall, f1) of keyed rows (family, key), and a row `all` for their sum; 0/0 is 1."""
    e = expected.select("family", "key").distinct().withColumn("_e", F.lit(1))
    a = actual.select("family", "key").distinct().withColumn("_a", F.lit(1))
    both = e.join(a, ["family", "key"], "full")
    tp, fp, fn = F.count_if(F.col("_e").isNotNull() & F.col("_a").isNotNull()), F.count_if(F.col("_e").isNull()), F.count_if(F.col("_a").isNull())
    sums = both.groupBy("family").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    total = sums.agg(F.lit("all").alias("family"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    one = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(1.0))
    c = F.col
    out = sums.unionByName(total).withColumn("precision", one(c("tp"), c("tp") + c("fp"))).withColumn("recall", one(c("tp"), c("tp") + c("fn")))
    return out.withColumn("f1", F.when(c("precision") + c("recall") > 0, 2 * c("precision") * c("recall") / (c("precision") + c("recall"))).otherwise(F.lit(0.0)))


def sparkline(counts: Column) -> Column:
    """Bars of eight heights for an array of counts, the largest full."""
    bars = F.array(*[F.lit(b) for b in "▁▂▃▄▅▆▇█"])
    most = F.array_max(counts)
    return F.array_join(F.transform(counts, lambda x: F.when(most > 0, F.element_at(bars, F.floor(x * 7 / most + 0.5).cast("int") + 1)).otherwise(F.lit("▁"))), "")
