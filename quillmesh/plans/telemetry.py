"""Queries over event logs and over the graph of foreign keys, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import telemetry as te
from ..session import table
from .wiki import _EDGES

NOW = 1706572800000000  # 2024-01-30
DAY = te.DAY


def writes(spark: SparkSession, d: str) -> DataFrame:
    """The event stream as a log of writes: errors are unsupported, purchases rejected ones."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "unsupported").when(F.col("event_type") == "purchase", "rejected").otherwise(F.col("event_type"))
    return e.withColumn("kind", kind)


def searches(spark: SparkSession, d: str) -> DataFrame:
    """The event stream as a log of searches: the value is the best score, k of props gives the ratio."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select("ts", F.when(F.col("event_type") == "error", "below-floor").alias("abstain_reason"), F.col("value").alias("top1_score"), F.when(k % 5 != 0, k / 20).alias("top1_top2_ratio"))


def events_in_window(spark: SparkSession, d: str) -> DataFrame:
    return te.within(table(spark, d, "events"), NOW, 7).select("event_id")


def events_weekly(spark: SparkSession, d: str) -> DataFrame:
    return te.weekly(writes(spark, d), NOW)


def events_trust(spark: SparkSession, d: str) -> DataFrame:
    return te.search_trust(searches(spark, d)).withColumn("abstain_ratio", F.round("abstain_ratio", 6)).withColumn("median_top1", F.round("median_top1", 6))


def events_last_week(spark: SparkSession, d: str) -> DataFrame:
    return te.last_week(writes(spark, d), NOW).withColumn("would_reject_ratio", F.round("would_reject_ratio", 6))


def events_readiness(spark: SparkSession, d: str) -> DataFrame:
    return te.readiness(te.weekly(writes(spark, d), NOW), te.search_trust(searches(spark, d)))


def events_transitions(spark: SparkSession, d: str) -> DataFrame:
    return te.transitions(table(spark, d, "events"), "user_id", F.col("event_type") == "error").select("event_id", "user_id")


def events_rotated(spark: SparkSession, d: str) -> DataFrame:
    return te.rotate(table(spark, d, "events"), NOW, F.length("props"), 40_000).select("event_id")


def events_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of a rule against the links that pages hold: a page cites a source file of its own tag."""
    pages = table(spark, d, "wiki_pages")
    expected = pages.select(F.coalesce("type", F.lit("none")).alias("family"), F.explode("sources").alias("s"), F.col("path")).select("family", F.concat_ws(" ", "path", "s").alias("key"))
    actual = pages.select(F.coalesce("type", F.lit("none")).alias("family"), "path", "tags", F.explode("sources").alias("s")).where(F.exists("tags", lambda t: F.contains(F.col("s"), t))).select("family", F.concat_ws(" ", "path", "s").alias("key"))
    out = te.scores(expected, actual)
    return out.select("family", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def page_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return te.page_classes(table(spark, d, "wiki_pages"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, kind): customers and suppliers on nations, nations on regions, orders on customers."""
    t = lambda n: table(spark, d, n)
    e = lambda df, a, ka, b, kb: df.select(F.concat(F.lit(f"{a}:"), ka).alias("src"), F.concat(F.lit(f"{b}:"), kb).alias("dst"), F.lit(f"{a}-{b}").alias("kind"))
    parts = [e(t("nation"), "nation", "n_nationkey", "region", "n_regionkey"), e(t("customer"), "customer", "c_custkey", "nation", "c_nationkey"), e(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey"), e(t("orders"), "orders", "o_orderkey", "customer", "o_custkey")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _start(spark: SparkSession) -> DataFrame:
    return spark.sql("select 'region:1' id")


def graph_impact(spark: SparkSession, d: str) -> DataFrame:
    return gr.impact(edges(spark, d), _start(spark), 3)


def graph_impact_edges(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return gr.impact_edges(e, gr.impact(e, _start(spark), 2)).select("id", "depth", "dst", "kind")


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = gr.neighbours(edges(spark, d).where("kind <> 'orders-customer'"))
    return n.select("id", F.size("dependencies").alias("n_dependencies"), F.size("dependents").alias("n_dependents"), F.try_element_at("dependents", F.lit(1)).alias("first_dependent"))


def graph_neighbours_all(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours over all edges, orders included."""
    return gr.neighbour_counts(edges(spark, d))


def graph_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Link graph of the pages without those that have no neighbour."""
    from ..operators import pages as pg

    pages = table(spark, d, "wiki_pages")
    links = pg.link_edges(pages).where("not broken").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return gr.cascade_orphans(pages.select(pg.slug_of(F.col("path")).alias("id")), links)


def graph_writer_reader(spark: SparkSession, d: str) -> DataFrame:
    """Writers and readers of one table with other programs: suppliers write a part, customers of its orders read it; counted per nation pair."""
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    writes_ = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("part"), F.col("s_nationkey").alias("w")).distinct()
    reads = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("l_partkey").alias("part"), F.col("c_nationkey").alias("r")).distinct()
    return writes_.join(reads, "part").where("w <> r").groupBy("w", "r").agg(F.count(F.lit(1)).alias("n_tables"))


_T = "epoch_us(ts)"
_W = "writes as (select *, case event_type when 'error' then 'unsupported' when 'purchase' then 'rejected' else event_type end kind from events)"
_WEEK = f"""{_W}, weeks as (select w::int week_no, strftime(make_timestamp({NOW} - (w + 1) * {te.WEEK}), '%Y-%m-%d') week_start, count(event_id) total_writes, count(event_id) filter (kind in ('unsupported', 'rejected')) unsupported_or_rejected
 from range(4) t(w) left join writes on {_T} < {NOW} - w * {te.WEEK} and {_T} >= {NOW} - (w + 1) * {te.WEEK} group by w)"""
_S = "s as (select case when event_type = 'error' then 'below-floor' end a, value t, (props->>'$.k')::double k from events), ss as (select a, t, case when k % 5 <> 0 then k / 20 end r from s)"
_TRUST = """trust as (select count(*) total_searches, count(a) abstain_count, round(count(a) / nullif(count(*), 0), 6) abstain_ratio, round(median(t), 6) median_top1,
 count(*) filter (r < 1.5) lt15, count(*) filter (r >= 1.5 and r < 2) lt20, count(*) filter (r >= 2 and r < 3) lt30, count(*) filter (r >= 3) ge30 from ss)"""
_E = """e as (select 'nation:' || n_nationkey s, 'region:' || n_regionkey t, 'nation-region' kind from nation union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'customer-nation' from customer
 union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'supplier-nation' from supplier union all select 'orders:' || o_orderkey, 'customer:' || o_custkey, 'orders-customer' from orders)"""
_IMP = f"{_E}, w as (select 'region:1' id, 0 depth union select e.s, depth + 1 from w join e on e.t = w.id where depth < 3), lv as (select id, min(depth)::int depth from w group by 1)"

QUERIES = {
    f.__name__: f
    for f in (
        events_in_window, events_weekly, events_trust, events_last_week, events_readiness, events_transitions, events_rotated, events_scores, page_class_counts, graph_impact, graph_impact_edges,
        graph_neighbours, graph_neighbours_all, graph_cascade, graph_writer_reader,
    )
}
ORACLE = {
    "events_in_window": f"select event_id from events where {_T} >= {NOW - 7 * DAY}",
    "events_weekly": f"with {_WEEK} select * from weeks",
    "events_trust": f"with {_S}, {_TRUST} select * from trust",
    "events_last_week": f"""with {_W} select count(*) total_writes, count(*) filter (kind = 'unsupported') unsupported_writes, count(*) filter (kind = 'rejected') rejected_writes,
 round(count(*) filter (kind in ('unsupported', 'rejected')) / nullif(count(*), 0), 6) would_reject_ratio from writes where {_T} >= {NOW - te.WEEK}""",
    "events_readiness": f"""with {_WEEK}, {_S}, {_TRUST}, g as (select sum(total_writes)::bigint writes, bool_and(coalesce(unsupported_or_rejected / nullif(total_writes, 0) < 0.05, true)) wp from weeks),
 j as (select *, total_searches >= 10 and abstain_ratio is not null ap from g, trust), k as (select *, not ap or abstain_ratio <= 0.3 sp from j)
 select writes, writes >= 50 writes_passing, wp weekly_passing, ap abstain_applicable, sp abstain_passing, case when writes < 50 then 'insufficient-data' when wp and sp then 'ready' else 'not-ready' end status from k""",
    "events_transitions": "with x as (select *, lag(event_type = 'error') over (partition by user_id order by ts, event_id) b from events) select event_id, user_id from x where event_type = 'error' and not coalesce(b, false)",
    "events_rotated": f"with x as (select event_id, sum(length(props) + 1) over (order by ts desc, event_id desc) s from events where {_T} >= {NOW - 30 * DAY}) select event_id from x where s <= 40000",
    "events_scores": """with p as (select coalesce(type, 'none') family, path, tags, unnest(sources) s from wiki_pages), e as (select distinct family, path || ' ' || s k from p where s is not null),
 a as (select distinct family, path || ' ' || s k from p where s is not null and len(list_filter(tags, lambda t: contains(s, t))) > 0), j as (select coalesce(e.family, a.family) family, e.k e, a.k a from e full join a on e.family = a.family and e.k = a.k),
 c as (select family, count(*) filter (e is not null and a is not null) tp, count(*) filter (e is null) fp, count(*) filter (a is null) fn from j group by 1),
 u as (select * from c union all select 'all', sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint from c),
 q as (select *, case when tp + fp > 0 then tp / (tp + fp) else 1 end p, case when tp + fn > 0 then tp / (tp + fn) else 1 end r from u)
 select family, tp, fp, fn, round(p, 6) "precision", round(r, 6) recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) f1 from q""",
    "page_class_counts": """select case when coalesce(frontmatter['synthesis'], '') = 'true' or coalesce(type, '') = 'synthesis' then 'synthesis' when coalesce(len(sources), 0) > 0 then 'grounded' when coalesce(frontmatter['unsupported'], '') = 'true' then 'unsupported'
 when coalesce(frontmatter['legacyUnsupported'], '') = 'true' then 'legacy' else 'other' end "class", count(*) n from wiki_pages where not (path in ('index.md', 'log.md', 'timeline.md', 'evidence-report.md') or ends_with(path, '/index.md')) group by 1""",
    "graph_impact": f"with recursive {_IMP} select id, depth from lv",
    "graph_impact_edges": f"with recursive {_IMP} select distinct a.id, a.depth, e.t dst, kind from lv a join e on e.s = a.id join lv b on b.id = e.t and b.depth = a.depth - 1 where a.depth <= 2",
    "graph_neighbours": f"""with {_E}, x as (select * from e where kind <> 'orders-customer'), o as (select s id, list_sort(list_distinct(list(t))) l from x group by 1), i as (select t id, list_sort(list_distinct(list(s))) l from x group by 1)
 select coalesce(o.id, i.id) id, coalesce(len(o.l), 0)::int n_dependencies, coalesce(len(i.l), 0)::int n_dependents, i.l[1] first_dependent from o full join i on o.id = i.id""",
    "graph_neighbours_all": f"""with {_E}, x as (select distinct s, t from e), o as (select s id, count(*) n from x group by 1), i as (select t id, count(*) n, min(s) f from x group by 1)
 select coalesce(o.id, i.id) id, coalesce(o.n, 0)::int n_dependencies, coalesce(i.n, 0)::int n_dependents, f first_dependent from o full join i on o.id = i.id""",
    "graph_cascade": f"with {_EDGES} select source id from edges where not broken union select target from edges where not broken",
    "graph_writer_reader": """with w as (select distinct l_partkey part, s_nationkey w from lineitem join supplier on l_suppkey = s_suppkey), r as (select distinct l_partkey part, c_nationkey r from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)
 select w, r, count(*) n_tables from w join r using (part) where w <> r group by 1, 2""",
}
