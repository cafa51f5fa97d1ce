"""Graph traversal by frontier: impact, neighbourhoods, first edges, fixpoints, node resolution.

A step joins the frontier to the edges on the source and keeps the vertices not seen
before by an anti join; each level is cut with a checkpoint, so plans do not grow and a
lost executor costs one level. A hub's edges are spread by adaptive skew handling, as the
frontier is a small side of distinct vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def reach(edges: DataFrame, start: DataFrame, depth: int = 10) -> DataFrame:
    """(id, depth) of the vertices reached from `start` (id) along (src, dst) within `depth` steps (1..50), start at 0."""
    depth = min(50, max(1, depth))
    steps = edges.select("src", "dst").distinct()
    seen = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        found = frontier.join(steps, frontier["id"] == steps["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def impact(edges: DataFrame, start: DataFrame, depth: int = 10) -> DataFrame:
    """(id, depth) of what depends on `start`, against the direction of the edges."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, depth)


def impact_edges(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(id, depth, src, dst, kind): the edges by which each reached vertex depends on the level before it."""
    at = levels.select(F.col("id").alias("src"), F.col("depth"))
    before = levels.select(F.col("id").alias("dst"), (F.col("depth") + 1).alias("depth"))
    return edges.join(at, "src").join(before, ["dst", "depth"]).select(F.col("src").alias("id"), "depth", "src", "dst", "kind")


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """(id, depth) within `hops` undirected steps."""
    return reach(edges.select("src", "dst").union(edges.select("dst", "src")), start, hops)


def first_edges(edges: DataFrame, start: DataFrame, depth: int = 10) -> DataFrame:
    """(id, depth, src, ord): of the edges that first reach a vertex only the one with the least (frontier order, edge order)."""
    steps = edges.select("src", "dst", "ord")
    start_row = start.select("id").distinct()
    none = [F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["src"].dataType).alias("src"), F.lit(None).cast("long").alias("ord"), F.array().cast("array<bigint>").alias("rank")]
    seen = cut(start_row.select("id", *none))
    frontier = seen
    for level in range(1, min(50, max(1, depth)) + 1):
        # the order of a vertex in its frontier is the list of edge numbers on the way to it
        hit = frontier.select(F.col("id").alias("src"), F.col("rank").alias("_r")).join(steps, "src").select(F.col("dst").alias("id"), "src", F.col("ord").cast("long").alias("ord"), "_r")
        best = hit.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("_r", "ord", "src")).alias("b"))
        frontier = cut(best.select("id", F.lit(level).alias("depth"), "b.src", "b.ord", F.concat("b._r", F.array("b.ord")).alias("rank")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select("id", "depth", "src", "ord")


def cascade_orphans(vertices: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """The vertices (id) that keep a neighbour when vertices without one are hidden until nothing changes."""
    kept = cut(vertices.select("id").distinct())
    count = kept.count()
    for _ in range(most_rounds):
        inside = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst")
        kept = cut(kept.join(inside.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi"))
        new = kept.count()
        if new == count:
            return kept
        count = new
    raise RuntimeError("hiding did not settle")


def resolve_node(vertices: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, id, ambiguous) by exact id, else by a unique label, else by kind:LABEL; null id if there is none or more than one."""
    exact = wanted.join(vertices.select(F.col("id").alias("name"), F.col("id").alias("_exact")), "name", "left")
    label = vertices.select(F.upper(F.col("label")).alias("_l"), "id").groupBy("_l").agg(F.min("id").alias("_by_label"), F.count(F.lit(1)).alias("_n"))
    found = exact.withColumn("_l", F.upper("name")).join(label, "_l", "left")
    kinds = vertices.select(F.lower(F.concat("kind", F.lit(":"), "label")).alias("_k"), F.col("id").alias("_by_kind")).groupBy("_k").agg(F.min("_by_kind").alias("_by_kind"))
    found = found.withColumn("_k", F.lower("name")).join(kinds, "_k", "left")
    by_label = F.when(F.col("_n") == 1, F.col("_by_label"))
    return found.select("name", F.coalesce("_exact", by_label, "_by_kind").alias("id"), (F.col("_exact").isNull() & F.coalesce(F.col("_n") > 1, F.lit(False))).alias("ambiguous"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, dependencies, dependents): sorted distinct ends of the edges of each vertex."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("dependencies"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("dependents"))
    none = F.array().cast("array<string>")
    return out.join(into, "id", "full").select("id", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents"))




def neighbour_counts(edges: DataFrame) -> DataFrame:
    """(id, n_dependencies, n_dependents, first_dependent) of each vertex; as `neighbours`, but no list of a hub is ever held."""
    pairs = edges.select("src", "dst").distinct()
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.count("dst").cast("int").alias("n_dependencies"))
    into = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("src").cast("int").alias("n_dependents"), F.min("src").alias("first_dependent"))
    return out.join(into, "id", "full").select("id", F.coalesce("n_dependencies", F.lit(0)).alias("n_dependencies"), F.coalesce("n_dependents", F.lit(0)).alias("n_dependents"), "first_dependent")


def weakest_links(via: DataFrame) -> DataFrame:
    """(id, depth, n_edges, certain): of the edges by which a vertex is reached, whether all are deterministic. `via` has a confidence."""
    sure = F.col("confidence") == "deterministic"
    return via.groupBy("id", "depth").agg(F.count(F.lit(1)).alias("n_edges"), F.bool_and(sure).alias("certain"))


def overview(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(topic, name, n): vertices by kind and state, edges by kind, edges by confidence."""
    state = F.when(F.col("resolved"), "resolved").otherwise("unresolved")
    parts = [
        vertices.groupBy(F.lit("vertices").alias("topic"), F.concat_ws(" ", "kind", state).alias("name")),
        edges.groupBy(F.lit("edges").alias("topic"), F.col("kind").alias("name")),
        edges.groupBy(F.lit("confidence").alias("topic"), F.col("confidence").alias("name")),
    ]
    counted = [p.agg(F.count(F.lit(1)).alias("n")) for p in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
