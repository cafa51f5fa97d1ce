"""Field lineage between programs: shared copybooks, inferred pairs, CALL boundaries, DB2 tables.

Everything after the fact tables is joins and aggregations. Self joins are equi joins on
the name or the shape of a field with the other conditions as residuals; groups of the
CALL boundary descend level by level through positions, so children are compared only
under a matched pair of parents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from . import facts as ft

#: Runtime services that are no programs of the corpus (fixed values).
SYSTEM_CALLEES = (
    "MQCONN", "MQDISC", "MQOPEN", "MQCLOSE", "MQGET", "MQPUT", "MQPUT1", "MQINQ", "MQSET", "MQBEGIN", "MQCMIT", "MQBACK", "MQSUB",
    "CSQBCON", "CSQBDIS", "CSQBOPN", "CSQBCLS", "CSQBGET", "CSQBPUT", "CSQBPUT1", "CEE3ABD", "CEEDATE", "CEEDATM", "CEEDAYS", "CEELOCT", "CEEMSG", "CEEGTST",
)
WRITE_OPS, READ_OPS = ("INSERT", "UPDATE", "DELETE", "MERGE"), ("SELECT", "FETCH")


# ---- copybooks ---------------------------------------------------------------------


def replacing_pairs(words: Column) -> Column:
    """array<struct<old,new>> of `old BY new` among the words after REPLACING, without pseudo-text marks."""
    bare = F.filter(F.transform(words, lambda x: F.regexp_replace(x, r"^==(.+)==$", "$1")), lambda x: ~x.isin("=", "=="))
    name = r"^[A-Z][A-Z0-9-]*$"
    at = F.filter(F.sequence(F.lit(2), F.greatest(F.size(bare) - 1, F.lit(2))), lambda i: F.coalesce(F.try_element_at(bare, i) == "BY", F.lit(False)))
    pairs = F.transform(at, lambda i: F.struct(F.try_element_at(bare, i - 1).alias("old"), F.try_element_at(bare, i + 1).alias("new")))
    return F.filter(pairs, lambda p: F.coalesce(p["old"].rlike(name) & p["new"].rlike(name), F.lit(False)))


def renamed(name: Column, pairs: Column) -> Column:
    """The name after the first pair that has it as old name; the name itself if there is none."""
    return F.coalesce(F.try_element_at(F.transform(F.filter(pairs, lambda p: p["old"] == F.upper(name)), lambda p: p["new"]), F.lit(1)), name)


def copybook_files(all_: DataFrame) -> DataFrame:
    """(copybook, file) of parsed copybooks; names that two files share are left out."""
    books = all_.where("fact = 'unit'").where(ft.is_copybook(F.col("file"))).select(ft.stem(F.col("file")).alias("copybook"), "file")
    return books.groupBy("copybook").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def programs(all_: DataFrame) -> DataFrame:
    """(program, file) of the sources that are no copybooks."""
    return ft.units(all_).where("not copybook").select(F.col("unit").alias("program"), "file")


def cohorts(all_: DataFrame) -> DataFrame:
    """(copybook, cohort, pairs, programs, exact, unclear): the programs that copy a copybook with one REPLACING text.

    Of several COPYs of one copybook in a program the last counts. `unclear` marks a text without readable pairs.
    """
    uses = ft.copies(all_).join(programs(all_), "file").withColumn("copybook", ft.stem(F.col("copybook"))).join(copybook_files(all_).select("copybook"), "copybook")
    last = uses.withColumn("_rn", F.row_number().over(W.partitionBy("copybook", "program", "file").orderBy(F.desc("ord")))).where("_rn = 1")
    grouped = last.groupBy("copybook", F.to_json("replacing").alias("cohort"), "replacing").agg(F.sort_array(F.collect_set("program")).alias("programs"), F.count(F.lit(1)).alias("n"))
    pairs = replacing_pairs(F.col("replacing"))
    return grouped.select("copybook", "cohort", pairs.alias("pairs"), "programs", "n", (F.size("replacing") == 0).alias("exact"), ((F.size("replacing") > 0) & (F.size(pairs) == 0)).alias("unclear"))


def copybook_fields(all_: DataFrame) -> DataFrame:
    """Data items of the copybooks that have a name of their own."""
    return ft.data_items(all_).join(copybook_files(all_), "file")


def deterministic(all_: DataFrame) -> DataFrame:
    """(field, copybook, qualified, programs, linkage): fields of a copybook that two or more programs copy alike."""
    shared = cohorts(all_).where("n >= 2 and not unclear")
    rows = copybook_fields(all_).join(shared, "copybook")
    qualified = F.array_join(F.transform(F.split("qualified", r"\."), lambda s: renamed(s, F.col("pairs"))), ".")
    linkage = F.when(F.size("pairs") > 0, "deterministic-via-replacing").otherwise("deterministic")
    return rows.select(renamed(F.col("field"), F.col("pairs")).alias("field"), "copybook", qualified.alias("qualified"), "programs", linkage.alias("linkage"))


def _suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"^[^.]*\.", "")


def _parent_suffix(name: Column) -> Column:
    return F.when(name.contains("."), F.regexp_replace(name, r"^[^.]*\.", "")).when(name.isNotNull(), F.lit(""))


def parent_context(left: Column, right: Column) -> Column:
    """exact, suffix, top-level or none, of two qualified parent names (null for a root) without their records."""
    a, b = _parent_suffix(left), _parent_suffix(right)
    return (
        F.when(a.isNull() & b.isNull(), "top-level").when(a.isNull() | b.isNull(), "none").when((a == b) & (a == ""), "top-level").when(a == b, "exact")
        .when((a != "") & (b != "") & (a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))), "suffix").otherwise("none")
    )


def _sides(rows: DataFrame, keys: list[str]) -> DataFrame:
    kept = ["copybook", "field", "qualified", "parent", "siblings", "level", "picture", "usage", "programs"]
    side = lambda n: rows.select(*keys, *[F.col(c).alias(f"{c}_{n}") for c in kept])
    return side("l").join(side("r"), keys).where(F.col("copybook_l") < F.col("copybook_r"))


def _competing(pairs: DataFrame) -> DataFrame:
    """`pairs` with the number of other pairs that the busier of the two ends has."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("copybook_l").alias("c"), F.col("qualified_l").alias("q")), F.struct(F.col("copybook_r").alias("c"), F.col("qualified_r").alias("q")))).alias("e"))
    n = ends.groupBy("e.c", "e.q").agg(F.count(F.lit(1)).alias("n"))
    left, right = n.toDF("copybook_l", "qualified_l", "n_l"), n.toDF("copybook_r", "qualified_r", "n_r")
    return pairs.join(left, ["copybook_l", "qualified_l"]).join(right, ["copybook_r", "qualified_r"]).withColumn("competing", F.greatest("n_l", "n_r") - 1).drop("n_l", "n_r")


INFERRED = ["field_l", "field_r", "copybook_l", "copybook_r", "qualified_l", "qualified_r", "programs_l", "programs_r", "parent_context", "shared_siblings", "competing"]


def inferred(all_: DataFrame) -> DataFrame:
    """Pairs of equally named fields of two copybooks with equal shape and context; tier `high`, or `ambiguous` where an end has other pairs.

    Fields whose leaf a cohort renames do not count for it, nor FILLER, nor fields without picture and usage.
    """
    usable = copybook_fields(all_).where("(picture is not null or usage is not null) and upper(field) <> 'FILLER'").join(cohorts(all_).where("not unclear"), "copybook")
    kept = usable.where(renamed(F.col("field"), F.col("pairs")) == F.col("field"))
    first = kept.groupBy("copybook", "field", "qualified").agg(F.min("ord").alias("ord"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("programs")))).alias("programs"))
    items = copybook_fields(all_).select("copybook", "field", "qualified", "ord", "parent", "siblings", "level", "picture", "usage")
    rows = items.join(first, ["copybook", "field", "qualified", "ord"]).withColumn("name", F.upper("field"))
    context = parent_context(F.col("parent_l"), F.col("parent_r"))
    shared = F.array_sort(F.array_distinct(F.array_intersect("siblings_l", "siblings_r")))
    pairs = (
        _sides(rows, ["name"])
        .where((F.col("picture_l") == F.col("picture_r")) & (F.coalesce("usage_l", F.lit("")) == F.coalesce("usage_r", F.lit(""))) & (F.col("level_l") == F.col("level_r")))
        .where(_suffix(F.col("qualified_l")) == _suffix(F.col("qualified_r")))
        .withColumn("parent_context", context)
        .withColumn("shared_siblings", shared)
        .where((F.col("parent_context") == "exact") | (F.col("parent_context").isin("top-level", "suffix") & (F.size("shared_siblings") > 0)))
    )
    return _competing(pairs).withColumn("tier", F.when(F.col("competing") == 0, "high").otherwise("ambiguous")).select(*INFERRED, "tier")


def semantic(all_: DataFrame) -> DataFrame:
    """Pairs of differently named fields of one shape under one parent with two shared siblings and no competing pair."""
    plain = cohorts(all_).where(F.size("pairs") == 0)
    one = plain.withColumn("_rn", F.row_number().over(W.partitionBy("copybook").orderBy(F.desc("exact"), "cohort"))).where("_rn = 1").select("copybook", "programs")
    rows = copybook_fields(all_).where("picture is not null and usage is not null").join(one, "copybook").withColumn("shape", F.concat_ws("|", "picture", "usage", "level"))
    pairs = (
        _sides(rows, ["shape"])
        .where(F.upper("field_l") != F.upper("field_r"))
        .withColumn("parent_context", parent_context(F.col("parent_l"), F.col("parent_r")))
        .where("parent_context = 'exact'")
        .withColumn("shared_siblings", F.array_sort(F.array_distinct(F.array_intersect("siblings_l", "siblings_r"))))
        .where(F.size("shared_siblings") >= 2)
    )
    return _competing(pairs).where("competing = 0").withColumn("tier", F.lit("semantic")).select(*INFERRED, "tier")


def empty_copybooks(all_: DataFrame) -> DataFrame:
    """(kind, file) of copybooks without data items."""
    books = all_.where("fact = 'unit'").where(ft.is_copybook(F.col("file"))).select("file")
    return books.join(all_.where("fact = 'data'").select("file"), "file", "left_anti").select(F.lit("parsed-zero-data-items").alias("kind"), "file")


# ---- CALL boundaries ------------------------------------------------------------------


def resolved_calls(all_: DataFrame) -> DataFrame:
    """CALLs with arguments: program, target after constant propagation, whether it was resolved, args.

    A variable stands for a program if every write to it moves one and the same literal,
    and its VALUE, if any, agrees; or if it is never written and has a VALUE.
    """
    assigned = all_.where("fact = 'assign'").select("file", F.upper("name").alias("variable"), ft.attr("literal").alias("literal"))
    moves = assigned.groupBy("file", "variable").agg(F.count_if(F.col("literal").isNull()).alias("unknown"), F.countDistinct("literal").alias("literals"), F.min("literal").alias("moved"))
    value = F.regexp_extract("value", r"""^["'](.*)["']$""", 1)
    initial = ft.data_items(all_).where(F.col("value").rlike(r"""^["'].*["']$""")).select("file", F.upper("field").alias("variable"), value.alias("initial"), F.when(F.col("area") == "linkage", 1).otherwise(0).alias("p"), "ord")
    initial = initial.groupBy("file", "variable").agg(F.min(F.struct("p", "ord", "initial"))["initial"].alias("initial"))
    c = ft.calls(all_).where(F.size("args") > 0).join(programs(all_), "file").withColumn("variable", F.upper("target"))
    both = c.join(moves, ["file", "variable"], "left").join(initial, ["file", "variable"], "left")
    by_move = F.when((F.col("unknown") == 0) & (F.col("literals") == 1) & (F.col("initial").isNull() | (F.col("initial") == F.col("moved"))), F.col("moved"))
    constant = F.when(F.col("literals").isNull(), F.col("initial")).otherwise(by_move)
    dynamic = F.col("kind") == "identifier"
    return both.select(
        "file", "ord", "line", "program", "args", "kind", F.when(dynamic, F.coalesce(constant, "target")).otherwise(F.col("target")).alias("target"), (dynamic & constant.isNotNull()).alias("propagated")
    )


def call_boundaries(all_: DataFrame, extra_system: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(entries, diagnostics) of CALL ... USING against the callee's LINKAGE records, by position and then by structure."""
    calls = resolved_calls(all_)
    callee = programs(all_).groupBy(F.upper("program").alias("key")).agg(F.max(F.struct("file", "program")).alias("callee"))
    found = cut(calls.withColumn("key", F.upper("target")).join(callee, "key", "left"))
    data = ft.data_items(all_)
    kind = F.when((F.col("kind") == "identifier") & ~F.col("propagated"), "dynamic-call").when(F.col("key").isin(*SYSTEM_CALLEES, *[x.upper() for x in extra_system]), "system-call").otherwise("unresolved-callee")
    missing = found.where("callee is null").select(kind.alias("kind"), F.col("program").alias("caller"), "target", "line")
    roots = data.where("parent_item is null")
    linkage = roots.where("area = 'linkage'").select(F.col("file").alias("callee_file"), "child", "field", "item")
    records = linkage.groupBy("callee_file").agg(F.sort_array(F.collect_list(F.struct("child", "field", "item"))).alias("records"))
    known = found.where("callee is not null").withColumn("callee_file", F.col("callee.file")).join(records, "callee_file", "left")
    every = F.coalesce("records", F.array().cast("array<struct<child:int,field:string,item:string>>"))
    commarea = F.filter(every, lambda r: F.upper(r["field"]) == "DFHCOMMAREA")
    known = known.withColumn("records", F.when((F.size("args") == 1) & (F.size(every) != 1) & (F.size(commarea) > 0), commarea).otherwise(every))
    uneven = known.where(F.size("records") != F.size("args")).select(F.lit("arity-mismatch").alias("kind"), F.col("program").alias("caller"), "target", "line")
    sites = known.where(F.size("records") == F.size("args"))
    # arguments: own top-level items first, then those of copied copybooks in order of COPY and file
    position = sites.select("file", "ord", "line", "program", "target", "callee_file", F.col("callee.program").alias("callee_program"), F.posexplode(F.arrays_zip("args", "records")).alias("position", "x"))
    position = position.select("*", F.upper("x.args").alias("arg"), F.col("x.records.item").alias("callee_item")).drop("x")
    own = roots.where("area <> 'linkage'").select("file", F.upper("field").alias("arg"), F.lit(0).alias("p1"), "ord", F.col("file").alias("caller_file"), F.col("item").alias("caller_item"))
    books = all_.where("fact = 'unit'").where(ft.is_copybook(F.col("file"))).select(F.col("file").alias("caller_file"), ft.stem(F.col("file")).alias("copybook"))
    copied = (
        ft.copies(all_).select("file", F.col("ord").alias("p1"), ft.stem(F.col("copybook")).alias("copybook")).join(books, "copybook")
        .join(roots.select(F.col("file").alias("caller_file"), F.upper("field").alias("arg"), "ord", F.col("item").alias("caller_item")), "caller_file")
        .select("file", "arg", F.col("p1") + 1, "ord", "caller_file", "caller_item")
    )
    choice = own.union(copied).groupBy("file", "arg").agg(F.min(F.struct("p1", "caller_file", "ord", "caller_item")).alias("c"))
    placed = position.join(choice, ["file", "arg"], "left")
    absent = placed.where("c is null").select(F.lit("caller-arg-not-top-level").alias("kind"), F.col("program").alias("caller"), "target", "line")
    side = lambda n: data.select(F.col("file").alias(f"{n}_file"), F.col("item").alias(f"{n}_item"), *[F.col(c).alias(f"{c}_{n}") for c in ("field", "qualified", "level", "picture", "is_group", "children")])
    pair_columns = ["program", "callee_program", "target", "line", "position", "caller_file", "caller_item", "callee_file", "callee_item"]
    level = placed.where("c is not null").select(*[F.col("c.caller_file").alias(x) if x == "caller_file" else F.col("c.caller_item").alias(x) if x == "caller_item" else F.col(x) for x in pair_columns])
    kids = data.where("parent_item is not null").select("file", "parent_item", "child", "item")
    entries, clashes, top = [], None, True
    while True:
        seen = cut(_compared(level.join(side("caller"), ["caller_file", "caller_item"]).join(side("callee"), ["callee_file", "callee_item"]), top))
        if top:
            clashes = seen.where("shape is null").select(F.lit("shape-mismatch").alias("kind"), F.col("program").alias("caller"), "target", "line")
        good = seen.where("shape is not null")
        entries.append(good)
        below = good.where("shape = 'both-group'").select(*pair_columns)
        a = kids.select(F.col("file").alias("caller_file"), F.col("parent_item").alias("caller_item"), "child", F.col("item").alias("_a"))
        b = kids.select(F.col("file").alias("callee_file"), F.col("parent_item").alias("callee_item"), "child", F.col("item").alias("_b"))
        level = below.join(a, ["caller_file", "caller_item"]).join(b, ["callee_file", "callee_item", "child"]).withColumn("caller_item", F.col("_a")).withColumn("callee_item", F.col("_b")).select(*pair_columns)
        top = False
        if below.isEmpty():
            break
    out = reduce(DataFrame.unionByName, entries)
    result = out.select(
        F.col("program").alias("caller"), F.col("callee_program").alias("callee"), "position", F.col("field_caller").alias("caller_field"), F.col("field_callee").alias("callee_field"),
        F.col("qualified_caller").alias("caller_qualified"), F.col("qualified_callee").alias("callee_qualified"), "shape", "same_level", "same_name", "confidence", "line",
    )
    return result, reduce(DataFrame.unionByName, [missing, uneven, absent, clashes])


def _compared(pairs: DataFrame, top: bool) -> DataFrame:
    """Shape, level and name of two items: groups match groups, scalars those of one picture."""
    groups = F.col("is_group_caller") & F.col("is_group_callee")
    scalars = ~F.col("is_group_caller") & ~F.col("is_group_callee") & (F.col("picture_caller") == F.col("picture_callee"))
    shape = F.when(groups, "both-group").when(scalars, "scalar-match")
    bare = lambda c: F.regexp_replace(F.upper(c), r"^[A-Z]{1,4}-", "")
    same = (F.upper("field_caller") == F.upper("field_callee")) | ((bare("field_caller") == bare("field_callee")) & (bare("field_caller") != ""))
    sure = F.lit(True) if top else same
    return pairs.select("*", shape.alias("shape"), (F.col("level_caller") == F.col("level_callee")).alias("same_level"), same.alias("same_name"), F.when(sure, "deterministic").otherwise("high").alias("confidence"))


# ---- DB2 tables ------------------------------------------------------------------------


def host_bindings(all_: DataFrame) -> DataFrame:
    """(program, file, line, operation, side, table, variable, column): one row per host variable, table and bound column (null if unbound)."""
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    pair = ArrayType(StructType([StructField("variable", StringType()), StructField("column", StringType())]))

    @F.pandas_udf(pair)
    def bound(op, text, n):  # noqa: ANN001, ANN202
        import pandas as pd

        from .reading import column_bindings, host_variables

        out = []
        for o, t, k in zip(op, text, n):
            named = column_bindings(o, t) if k == 1 else []
            by: dict[str, list[str]] = {}
            for c, v in named:
                if c not in by.setdefault(v, []):
                    by[v].append(c)
            out.append([{"variable": v, "column": c} for v in host_variables(t) for c in by.get(v, [None])])
        return pd.Series(out)

    s = ft.sql_statements(all_).join(programs(all_), "file").where(F.size("tables") > 0)
    side = F.when(F.col("operation").isin(*WRITE_OPS), "write").when(F.col("operation").isin(*READ_OPS), "read")
    rows = s.select("program", "file", "line", "operation", side.alias("side"), F.explode("tables").alias("table"), bound("operation", "text", F.size("tables")).alias("b"))
    return rows.select("program", "file", "line", "operation", "side", "table", F.explode_outer("b").alias("x")).select("program", "file", "line", "operation", "side", "table", "x.variable", "x.column")


def resolve_host_variables(all_: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, variable, picture, origin, old_name): the first of working storage, linkage, copybook, renamed copybook field."""
    data = ft.data_items(all_).withColumn("variable", F.upper("field"))
    asked = wanted.select("file", "variable").where("variable is not null").distinct()
    rank = F.when(F.col("area") == "linkage", 2).otherwise(1)
    own = asked.join(data.select("file", "variable", "picture", rank.alias("p"), "ord"), ["file", "variable"]).select("file", "variable", "p", F.lit(0).alias("c"), F.lit("").alias("b"), "ord", "picture", F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("old_name"))
    books = all_.where("fact = 'unit'").where(ft.is_copybook(F.col("file"))).select(F.col("file").alias("b"), ft.stem(F.col("file")).alias("copybook"))
    used = ft.copies(all_).select("file", F.col("ord").alias("c"), ft.stem(F.col("copybook")).alias("copybook"), replacing_pairs(F.col("replacing")).alias("pairs")).join(books, "copybook")
    fields = data.select(F.col("file").alias("b"), F.col("variable").alias("_f"), "ord", "picture")
    both = asked.join(used, "file")
    direct = both.join(fields, ["b"]).where("variable = _f").select("file", "variable", F.lit(3).alias("p"), "c", "b", "ord", "picture", F.col("copybook").alias("origin"), F.lit(None).cast("string").alias("old_name"))
    old = F.try_element_at(F.transform(F.filter("pairs", lambda x: x["new"] == F.col("variable")), lambda x: x["old"]), F.lit(1))
    changed = both.withColumn("_f", old).where("_f is not null").join(fields, ["b", "_f"]).select("file", "variable", F.lit(4).alias("p"), "c", "b", "ord", "picture", F.col("copybook").alias("origin"), F.col("_f").alias("old_name"))
    best = own.union(direct).union(changed).groupBy("file", "variable").agg(F.min(F.struct("p", "c", "b", "ord", "picture", "origin", "old_name")).alias("x"))
    return best.select("file", "variable", "x.picture", "x.origin", "x.old_name", F.col("x.p").alias("rank"))


def db2_lineage(all_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, column_pairs, diagnostics) of programs that write and others that read one table."""
    rows = cut(host_bindings(all_))
    known = resolve_host_variables(all_, rows)
    rows_known = rows.join(known.select("file", "variable", F.lit(True).alias("known")), ["file", "variable"], "left")
    sided = rows_known.where("side is not null")
    use = sided.groupBy("table", "side", "program").agg(F.sort_array(F.collect_set("operation")).alias("operations"), F.sort_array(F.collect_set("variable")).alias("variables"))
    w = use.where("side = 'write'").select("table", F.col("program").alias("writer"), F.col("operations").alias("writer_ops"), F.col("variables").alias("writer_variables"))
    r = use.where("side = 'read'").select("table", F.col("program").alias("reader"), F.col("operations").alias("reader_ops"), F.col("variables").alias("reader_variables"))
    pairs = w.join(r, "table").where("writer <> reader")
    bound = sided.where("column is not null and known").select("table", "side", "program", "column", "variable").distinct()
    wc = bound.where("side = 'write'").select("table", "column", F.col("program").alias("writer"), F.col("variable").alias("writer_variable"))
    rc = bound.where("side = 'read'").select("table", "column", F.col("program").alias("reader"), F.col("variable").alias("reader_variable"))
    columns = wc.join(rc, ["table", "column"]).where("writer <> reader")
    null = F.lit(None).cast("string")
    loops = w.join(r, "table").where("writer = reader").select(F.lit("self-loop").alias("kind"), F.col("writer").alias("program"), "table", null.alias("detail"))
    odd = rows.where("side is null").select("program", "operation", "line").distinct().select(F.lit("non-classifiable-op").alias("kind"), "program", null.alias("table"), F.col("operation").alias("detail"))
    sides = use.groupBy("table").agg(F.bool_or(F.col("side") == "write").alias("w"), F.bool_or(F.col("side") == "read").alias("r"))
    only = sides.where("not (w and r)").select(F.when(F.col("w"), "writer-only").otherwise("reader-only").alias("kind"), null.alias("program"), "table", null.alias("detail"))
    lost = rows_known.where("side is not null and variable is not null and known is null").select("program", "variable").distinct().select(F.lit("host-var-unresolved").alias("kind"), "program", null.alias("table"), F.col("variable").alias("detail"))
    return pairs, columns, reduce(DataFrame.unionByName, [loops, odd, only, lost])


# ---- the whole ----------------------------------------------------------------------------


def knowledge_graph(all_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): programs, copybooks and datasets, with CALLS, COPIES and READS_WRITES; unparsed ends are unresolved."""
    unit = all_.where("fact = 'unit'").select("file", F.concat(F.when(ft.is_copybook(F.col("file")), F.lit("copybook:")).otherwise(F.lit("program:")), "name").alias("src"))
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    dynamic = ~F.col("target").rlike(r"(?i)^[A-Z0-9][-A-Z0-9]*$") | F.col("target").startswith("WS-")
    calls = ft.calls(all_).select("file", "line", node("program", F.col("target")).alias("dst"), F.lit("CALLS").alias("kind"), F.when(dynamic, "inferred-high").otherwise("deterministic").alias("confidence"))
    copy = ft.copies(all_).select("file", "line", node("copybook", F.col("copybook")).alias("dst"), F.lit("COPIES").alias("kind"), F.lit("deterministic").alias("confidence"))
    file = ft.of(all_, "file").select("file", "line", node("dataset", F.col("name")).alias("dst"), F.lit("READS_WRITES").alias("kind"), F.lit("deterministic").alias("confidence"))
    edges = calls.unionByName(copy).unionByName(file).join(unit, "file").select("src", "dst", "kind", "confidence", "file", "line")
    ends = unit.select(F.col("src").alias("id"), F.lit(True).alias("resolved")).unionByName(edges.select(F.col("dst").alias("id"), (F.col("kind") == "READS_WRITES").alias("resolved")))
    vertices = ends.groupBy("id").agg(F.max("resolved").alias("resolved")).withColumn("kind", F.substring_index("id", ":", 1)).withColumn("label", F.expr("substring(id, instr(id, ':') + 1)"))
    return vertices, edges


def lineage_rows(all_: DataFrame) -> DataFrame:
    """(family, confidence, left_program, left_field, right_program, right_field): all families in one form."""
    null = F.lit(None).cast("string")
    det = deterministic(all_).select(F.lit("deterministic").alias("family"), F.lit("strong").alias("confidence"), null.alias("left_program"), F.concat_ws(".", "copybook", "qualified").alias("left_field"), F.array_join("programs", ",").alias("right_program"), F.col("field").alias("right_field"))
    inf = inferred(all_).unionByName(semantic(all_)).select(F.concat(F.lit("inferred-"), "tier").alias("family"), F.when(F.col("tier") == "high", "strong").otherwise("weak").alias("confidence"), F.array_join("programs_l", ",").alias("left_program"), F.concat_ws(".", "copybook_l", "qualified_l").alias("left_field"), F.array_join("programs_r", ",").alias("right_program"), F.concat_ws(".", "copybook_r", "qualified_r").alias("right_field"))
    call = call_boundaries(all_)[0].select(F.lit("call-bound").alias("family"), F.when(F.col("confidence") == "deterministic", "strong").otherwise("weak").alias("confidence"), F.col("caller").alias("left_program"), F.col("caller_qualified").alias("left_field"), F.col("callee").alias("right_program"), F.col("callee_qualified").alias("right_field"))
    db2 = db2_lineage(all_)[1].select(F.lit("db2").alias("family"), F.lit("strong").alias("confidence"), F.col("writer").alias("left_program"), F.concat_ws(" ", "table", "column", "writer_variable").alias("left_field"), F.col("reader").alias("right_program"), F.col("reader_variable").alias("right_field"))
    return det.unionByName(inf).unionByName(call).unionByName(db2)


def lineage_query(rows: DataFrame, field: str | None = None, program: str | None = None, qualified: str | None = None, copybook: str | None = None, table: str | None = None) -> DataFrame:
    """Rows in which one and the same end meets every condition that is given, without regard to case.

    `field` is the last name of an end, `qualified` its whole name within the record,
    `copybook` the copybook and `table` the table that its name begins with.
    """
    def end(n: str) -> Column:
        name = F.upper(F.coalesce(f"{n}_field", F.lit("")))
        in_table = (F.col("family") == "db2") & name.contains(" ")
        bare = F.when(in_table, F.element_at(F.split(name, " "), -1)).otherwise(name)
        own = F.col("family").isin("deterministic", "inferred-high", "inferred-ambiguous", "inferred-semantic")
        ok = F.lit(True)
        if field is not None:
            ok = ok & (F.element_at(F.split(bare, r"\."), -1) == field.upper())
        if qualified is not None:
            ok = ok & ((bare == qualified.upper()) | (own & (F.expr(f"substring({n}_field, instr({n}_field, '.') + 1)") != "") & (F.upper(F.expr(f"substring({n}_field, instr({n}_field, '.') + 1)")) == qualified.upper())))
        if copybook is not None:
            ok = ok & own & (F.substring_index(name, ".", 1) == copybook.upper())
        if table is not None:
            ok = ok & in_table & (F.substring_index(name, " ", 1) == table.upper())
        if program is not None:
            programs = F.transform(F.split(F.coalesce(f"{n}_program", F.lit("")), ","), F.upper)
            ok = ok & F.array_contains(programs, program.upper())
        return F.coalesce(ok, F.lit(False))

    return rows.where(end("left") | end("right"))


def in_order(rows: DataFrame) -> DataFrame:
    """Lineage rows in one order, by family and both ends; a sort over all tasks, for the sink only."""
    return rows.orderBy("family", *[F.col(c).asc_nulls_first() for c in ("left_field", "left_program", "right_field", "right_program", "confidence")])


def dataflow_edges(flows: DataFrame, source: str | None = None, target: str | None = None) -> DataFrame:
    """`flows` (src, dst, ...) from and to given fields; names are compared in upper case and whole."""
    for c, wanted in (("src", source), ("dst", target)):
        if wanted is not None:
            flows = flows.where(F.col(c) == wanted.upper())
    return flows


def procedure_lookup(procedures: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, name, kind, found, ambiguous) for `wanted` (file, name, kind or null) among `procedures` (file, name, kind): names are compared in lower case, a null kind takes any."""
    of = procedures.select(F.col("file"), F.lower("name").alias("_name"), F.lower("kind").alias("_kind")).distinct()
    asked = wanted.select("file", "name", "kind").distinct()
    met = asked.withColumn("_name", F.lower("name")).join(of, ["file", "_name"]).where(F.col("kind").isNull() | (F.lower("kind") == F.col("_kind")))
    counted = met.groupBy("file", "name", F.coalesce("kind", F.lit("")).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min("_kind").alias("_one"))
    both = asked.withColumn("_k", F.coalesce("kind", F.lit(""))).join(counted, ["file", "name", "_k"], "left")
    return both.select("file", "name", "kind", F.when(F.col("_n") == 1, F.col("_one")).alias("found"), F.coalesce(F.col("_n") > 1, F.lit(False)).alias("ambiguous"))


def top_exclusions(found: DataFrame, most: int = 3) -> DataFrame:
    """(family, excluded, reasons) of `diagnostics`: how much was left out per family and the `most` commonest reasons, ties by name."""
    ranked = found.where("n > 0").withColumn("_r", F.row_number().over(W.partitionBy("family").orderBy(F.desc("n"), "kind")))
    text = F.when(F.col("_r") <= most, F.struct("_r", F.concat("kind", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t")))
    return ranked.groupBy("family").agg(F.sum("n").alias("excluded"), F.array_join(F.transform(F.sort_array(F.collect_list(text)), lambda x: x["t"]), ", ").alias("reasons"))


def coverage_table(all_: DataFrame, most: int = 3) -> DataFrame:
    """(family, indexed, yielding, excluded, reasons): `coverage` beside what was left out of each family and why."""
    family = F.when(F.col("family") == "call", "call-bound").when(F.col("family") == "field", "deterministic").otherwise(F.col("family"))
    return coverage(all_).join(top_exclusions(diagnostics(all_).withColumn("family", family), most), "family", "left").fillna(0, ["excluded"]).fillna("", ["reasons"])


def procedure_flow(all_: DataFrame, file: str) -> DataFrame:
    """(src, dst) of PERFORMs in one file, targets that are sections lifted to all their paragraphs."""
    mine = all_.where(F.col("file") == file)
    inside = ft.of(mine, "paragraph").select(F.col("owner").alias("target"), F.col("name").alias("dst"))
    edges = ft.performs(mine).select(F.col("paragraph").alias("src"), "target")
    lifted = edges.join(inside, "target").select("src", "dst")
    return edges.select("src", F.col("target").alias("dst")).union(lifted).distinct()


def keys_of(all_: DataFrame) -> DataFrame:
    """(family, key) of every lineage entry in the canonical form of golden manifests."""
    call = call_boundaries(all_)[0]
    columns = db2_lineage(all_)
    det = deterministic(all_).select(F.lit("deterministic").alias("family"), F.concat_ws("|", "field", "copybook", F.array_join("programs", ","), "linkage").alias("key"))
    both = inferred(all_).unionByName(semantic(all_))
    family = F.when(F.col("tier") == "high", "inferredHigh").when(F.col("tier") == "ambiguous", "inferredAmbiguous").otherwise("inferredSemantic")
    inf = both.select(family.alias("family"), F.concat_ws("|", "field_l", F.array_join(F.array("copybook_l", "copybook_r"), ",")).alias("key"))
    bound = call.select(F.lit("callBound").alias("family"), F.concat_ws("|", "caller", "callee", F.col("position").cast("string"), "caller_field", "callee_field", "confidence").alias("key"))
    by = columns[1].groupBy("table", "writer", "reader").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "column", "writer_variable", "reader_variable"))), ",").alias("c"))
    db2 = columns[0].join(by, ["table", "writer", "reader"], "left").select(F.lit("db2").alias("family"), F.concat_ws("|", "table", "writer", "reader", F.coalesce("c", F.lit(""))).alias("key"))
    return det.unionByName(inf).unionByName(bound).unionByName(db2)


def coverage(all_: DataFrame) -> DataFrame:
    """(family, indexed, yielding): how many sources could take part in a family and how many do."""
    one = lambda family, indexed, yielding: indexed.agg(F.lit(family).alias("family"), F.count(F.lit(1)).alias("indexed")).join(yielding.agg(F.count(F.lit(1)).alias("yielding")))  # noqa: E731 - one row each
    books = copybook_files(all_).select("copybook")
    both = inferred(all_).select(F.explode(F.array("copybook_l", "copybook_r")).alias("copybook")).distinct()
    callers = ft.calls(all_).where(F.size("args") > 0).select("file").distinct()
    tables = ft.sql_statements(all_).select(F.explode("tables").alias("table")).distinct()
    parts = [
        one("deterministic", books, deterministic(all_).select("copybook").distinct()), one("inferred", books, both), one("call-bound", callers, call_boundaries(all_)[0].select("caller").distinct()),
        one("db2", tables, db2_lineage(all_)[0].select("table").distinct()),
    ]
    return reduce(DataFrame.unionByName, parts)


def diagnostics(all_: DataFrame) -> DataFrame:
    """(family, kind, n) of everything that kept lineage from being drawn, the commonest first per family; kinds that do not occur have 0."""
    kinds = {"call": ("unresolved-callee", "dynamic-call", "system-call", "arity-mismatch", "shape-mismatch", "caller-arg-not-top-level"), "db2": ("self-loop", "non-classifiable-op", "writer-only", "reader-only", "host-var-unresolved"), "field": ("parsed-zero-data-items",)}
    spine = all_.sparkSession.createDataFrame([(f, k) for f, ks in kinds.items() for k in ks], "family string, kind string")
    found = [call_boundaries(all_)[1].select(F.lit("call").alias("family"), "kind"), db2_lineage(all_)[2].select(F.lit("db2").alias("family"), "kind"), empty_copybooks(all_).select(F.lit("field").alias("family"), "kind")]
    counted = reduce(DataFrame.unionByName, found).groupBy("family", "kind").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counted, ["family", "kind"], "left").fillna(0, ["n"])
