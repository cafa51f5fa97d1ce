"""Fact tables of COBOL sources as DataFrames; one Python pass, then plain projections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "file string, fact string, ord int, line int, name string, owner string, attrs map<string,string>, items array<string>"


def facts(sources: DataFrame) -> DataFrame:
    """`sources` (file, text) to facts; see `reading.FACTS`. Files with one name are read each on their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .reading import read_source

        for batch in batches:
            rows = [(f, *fact) for f, t in zip(batch["file"], batch["text"]) for fact in read_source(f, t)]
            yield pd.DataFrame(rows, columns=["file", "fact", "ord", "line", "name", "owner", "attrs", "items"])

    return sources.select("file", "text").where("text is not null and file is not null").mapInPandas(run, SCHEMA)


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def of(all_: DataFrame, kind: str) -> DataFrame:
    return all_.where(F.col("fact") == kind)


def stem(file: Column) -> Column:
    """The upper-case file name without directory and source extension: the name COPY uses."""
    return F.upper(F.regexp_replace(F.substring_index(file, "/", -1), r"(?i)\.(cpy|cbl|cob)$", ""))


def is_copybook(file: Column) -> Column:
    return F.lower(file).endswith(".cpy")


def units(all_: DataFrame) -> DataFrame:
    """(file, unit, copybook)."""
    return of(all_, "unit").select("file", F.col("name").alias("unit"), is_copybook(F.col("file")).alias("copybook"))


def data_items(all_: DataFrame) -> DataFrame:
    return of(all_, "data").select(
        "file", "ord", "line", F.col("name").alias("field"), F.col("owner").alias("parent"), F.col("items").alias("siblings"), attr("level").cast("int").alias("level"), attr("qualified").alias("qualified"),
        attr("child").cast("int").alias("child"), F.upper(attr("picture")).alias("picture"), F.upper(attr("usage")).alias("usage"), attr("value").alias("value"), attr("redefines").alias("redefines"),
        attr("occurs").cast("int").alias("occurs"), (attr("group") == "true").alias("is_group"), attr("children").cast("int").alias("children"), attr("area").alias("area"), attr("item").alias("item"),
        attr("parent_item").alias("parent_item"),
    )


def copies(all_: DataFrame) -> DataFrame:
    return of(all_, "copy").select("file", "ord", "line", F.col("name").alias("copybook"), F.col("items").alias("replacing"))


def calls(all_: DataFrame) -> DataFrame:
    return of(all_, "call").select("file", "ord", "line", F.col("name").alias("target"), attr("kind").alias("kind"), F.col("owner").alias("paragraph"), attr("section").alias("section"), F.col("items").alias("args"))


def performs(all_: DataFrame) -> DataFrame:
    return of(all_, "perform").select("file", "ord", "line", F.col("name").alias("target"), F.col("owner").alias("paragraph"), attr("section").alias("section"), attr("thru").alias("thru"))


def sql_statements(all_: DataFrame) -> DataFrame:
    return of(all_, "sql").select("file", "ord", "line", F.upper("name").alias("operation"), F.col("items").alias("tables"), attr("text").alias("text"))


def flows(all_: DataFrame) -> DataFrame:
    """Data flow edges (file, ord, line, source, target, via, paragraph, section)."""
    return of(all_, "flow").select("file", "ord", "line", F.col("name").alias("source"), attr("to").alias("target"), attr("via").alias("via"), F.col("owner").alias("paragraph"), attr("section").alias("section"))


def uses(all_: DataFrame, variable: str | None = None) -> DataFrame:
    """Reads and writes of variables, or of one variable."""
    rows = of(all_, "use")
    if variable is not None:
        rows = rows.where(F.col("name") == variable.upper())
    return rows.select("file", "line", F.col("name").alias("variable"), attr("qualified").alias("qualified"), attr("access").alias("access"), attr("verb").alias("verb"), F.col("owner").alias("paragraph"), attr("section").alias("section"))


def relations(all_: DataFrame) -> DataFrame:
    """The language-neutral form: (file, type, source, target, line, via)."""
    unit = units(all_).select("file", "unit")
    parts = [
        calls(all_).select("file", F.lit("call").alias("type"), "paragraph", "target", "line", F.lit(None).cast("string").alias("via")),
        performs(all_).select("file", F.lit("perform").alias("type"), "paragraph", "target", "line", F.col("thru").alias("via")),
        copies(all_).select("file", F.lit("copy").alias("type"), F.lit(None).cast("string").alias("paragraph"), F.col("copybook").alias("target"), "line", F.lit(None).cast("string").alias("via")),
        of(all_, "access").select("file", F.lit("file").alias("type"), F.col("owner").alias("paragraph"), F.col("name").alias("target"), "line", attr("operation").alias("via")),
        of(all_, "cics").select("file", F.lit("cics").alias("type"), F.col("owner").alias("paragraph"), F.coalesce(attr("program"), attr("transaction"), attr("map"), attr("file")).alias("target"), "line", F.col("name").alias("via")),
        of(all_, "sql").select("file", F.lit("sql").alias("type"), F.col("owner").alias("paragraph"), F.explode("items").alias("target"), "line", F.col("name").alias("via")),
        flows(all_).select("file", F.lit("flow").alias("type"), F.col("source").alias("paragraph"), "target", "line", "via"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(unit, "file").select("file", "type", F.coalesce("paragraph", "unit").alias("source"), "target", "line", "via")


def summary(all_: DataFrame) -> DataFrame:
    """(file, counts): how many facts of each kind a file has."""
    per = all_.groupBy("file", "fact").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("fact", "n")))).alias("counts"))


def section_rollup(all_: DataFrame) -> DataFrame:
    """(file, section, n, callers, targets): PERFORMs of each section with the distinct ends."""
    return performs(all_).groupBy("file", "section").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("paragraph")).alias("callers"), F.sort_array(F.collect_set("target")).alias("targets"))
