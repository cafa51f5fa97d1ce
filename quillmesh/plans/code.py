"""Queries over source code: the listings among the documents as COBOL sources, and lineage over a small set of programs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cobol import facts as ft
from ..cobol import lineage as ln
from ..cobol import reading as rd
from ..operators import graph as gr
from ..session import cut, spread, table


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Listings of the documents and COBOL files of the raw documents."""
    doc = table(spark, d, "documents").where(F.regexp_replace(F.lower(F.trim("source")), "_", "-") == "cobol-listing").select(F.format_string("doc-%d.cbl", "doc_id").alias("file"), "text")
    raw = table(spark, d, "raw_docs").where(F.lower("path").rlike(r"\.(cbl|cpy)$")).select(F.concat(F.lit("raw-"), F.col("raw_id").cast("string"), F.lit("-"), F.substring_index("path", "/", -1)).alias("file"), F.col("body").alias("text"))
    seg = table(spark, d, "segments").where(F.lower("file").rlike(r"\.(cbl|cpy)$")).select(F.concat(F.lit("seg-"), F.col("seg_id").cast("string"), F.lit("-"), F.substring_index("file", "/", -1)).alias("file"), "text")
    return doc.unionByName(raw).unionByName(seg)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    # a listing without divisions is procedure text: it gets the headers it lacks, in the same columns
    head = "       IDENTIFICATION DIVISION.\n       PROCEDURE DIVISION.\n"
    named = F.regexp_replace("text", r"(?i)(PROGRAM-ID\.[ ]+[A-Z0-9-]+\.)", "$1\n       PROCEDURE DIVISION.")
    text = F.when(F.col("text").rlike("(?i)PROCEDURE +DIVISION"), F.col("text")).when(F.col("text").rlike(r"(?i)PROGRAM-ID\.[ ]+[A-Z0-9-]+\."), named).otherwise(F.concat(F.lit(head), "text"))
    return ft.facts(sources(spark, d).withColumn("text", text))


def code_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("file", "fact", "ord", "line", "name", "owner")


def code_calls(spark: SparkSession, d: str) -> DataFrame:
    return ft.calls(_facts(spark, d))


def code_performs(spark: SparkSession, d: str) -> DataFrame:
    return ft.performs(_facts(spark, d))


def code_uses(spark: SparkSession, d: str) -> DataFrame:
    return ft.uses(_facts(spark, d))


def code_flows(spark: SparkSession, d: str) -> DataFrame:
    return ft.flows(_facts(spark, d))


def code_relations(spark: SparkSession, d: str) -> DataFrame:
    return ft.relations(_facts(spark, d))


def code_summary(spark: SparkSession, d: str) -> DataFrame:
    return ft.summary(_facts(spark, d)).select("file", F.size("counts").alias("kinds"), F.try_element_at("counts", F.lit("use")).alias("uses"))


def code_callees(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the listings by plain pattern: how often each literal program is called, and from how many files."""
    calls = ft.calls(_facts(spark, d)).where("kind = 'literal'")
    return calls.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


def code_graph(spark: SparkSession, d: str) -> DataFrame:
    return ln.knowledge_graph(_facts(spark, d))[0]


def code_impact(spark: SparkSession, d: str) -> DataFrame:
    """What depends on the most called program."""
    all_ = cut(_facts(spark, d))
    edges = ln.knowledge_graph(all_)[1]
    top = edges.where("kind = 'CALLS'").groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(1)
    return gr.impact(edges, top.select(F.col("dst").alias("id")), 10)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _sql_tables(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else rd.sql_tables(t))


def sql_table_names(spark: SparkSession, d: str) -> DataFrame:
    """Tables that the reader of SQL statements finds in a text made of every row of the part table."""
    p = table(spark, d, "part")
    text = F.concat(F.lit("SELECT A INTO :B FROM "), F.regexp_replace(F.upper("p_brand"), "[^A-Z0-9]", "_"), F.lit(" JOIN T"), F.col("p_size").cast("string"), F.lit(" ON X = Y"))
    return spread(p.select("p_partkey", text.alias("text"))).select("p_partkey", _sql_tables("text").alias("tables"))


#: Statement forms, with {0} the brand and {1} the size as names.
SQL_FORMS = (
    "SELECT A INTO :B FROM {0} JOIN T{1} ON X = Y", "UPDATE {0} SET A = :B WHERE C IN (SELECT C FROM T{1})", "INSERT INTO S . {0} (A) SELECT A FROM T{1}", "merge into {0} using T{1} on A = B", "DELETE FROM S.{0}", "OPEN C{1}",
)


def sql_table_names_all(spark: SparkSession, d: str) -> DataFrame:
    """Tables that the reader of SQL statements finds in every statement form made of every row of the part table."""
    name, size = F.regexp_replace(F.upper("p_brand"), "[^A-Z0-9]", "_"), F.col("p_size").cast("string")
    forms = F.array(*[F.replace(F.replace(F.lit(f), F.lit("{0}"), name), F.lit("{1}"), size) for f in SQL_FORMS])
    rows = spread(table(spark, d, "part").select("p_partkey", F.posexplode(forms).alias("form", "text")))
    return rows.select("p_partkey", "form", _sql_tables("text").alias("tables"))


_FORMS = ", ".join(f"({i}, '{f}')" for i, f in enumerate(SQL_FORMS))
QUERIES = {
    f.__name__: f for f in (code_facts, code_calls, code_performs, code_uses, code_flows, code_relations, code_summary, code_callees, code_graph, code_impact, sql_table_names, sql_table_names_all)
}
ORACLE = {
    "code_callees": r"""with s as (select 'doc-' || doc_id || '.cbl' file, text from documents where replace(lower(trim(source)), '_', '-') = 'cobol-listing' and text is not null
 union all select 'raw-' || raw_id, body from raw_docs where regexp_matches(lower(path), '\.(cbl|cpy)$') and body is not null union all select 'seg-' || seg_id, text from segments where regexp_matches(lower(file), '\.(cbl|cpy)$') and text is not null),
 l as (select file, unnest(string_split(replace(text, chr(13), ''), chr(10))) line from s), c as (select file, unnest(regexp_extract_all(string_split(line, '*>')[1], '\bCALL ' || chr(39) || '([^' || chr(39) || ']*)' || chr(39), 1)) target from l where substr(line, 7, 1) not in ('*', '/', 'D', 'd'))
 select target, count(*) n, count(distinct file) files from c group by 1""",
    "sql_table_names": r"""with t as (select p_partkey, 'SELECT A INTO :B FROM ' || regexp_replace(upper(p_brand), '[^A-Z0-9]', '_', 'g') || ' JOIN T' || p_size || ' ON X = Y' t from part)
 select p_partkey, list_sort(list_distinct(regexp_extract_all(t, '\b(?:FROM|JOIN|UPDATE|(?:INSERT|MERGE)\s+INTO)\s+([A-Z0-9][A-Z0-9_.-]*)', 1))) tables from t""",
    "sql_table_names_all": rf"""with f(form, t) as (values {_FORMS}), t as (select p_partkey, form::int form, upper(replace(replace(t, '{{0}}', regexp_replace(upper(p_brand), '[^A-Z0-9]', '_', 'g')), '{{1}}', p_size::varchar)) t from part, f)
 select p_partkey, form, list_sort(list_distinct(regexp_extract_all(regexp_replace(t, '([A-Z0-9_-])\s*\.\s*([A-Z0-9_-])', '\1.\2', 'g'), '\b(?:FROM|JOIN|UPDATE|(?:INSERT|MERGE)\s+INTO)\s+([A-Z0-9][A-Z0-9_.-]*)', 1))) tables from t""",
}
