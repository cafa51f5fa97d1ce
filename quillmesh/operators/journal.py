"""Operation log, entity templates, stale artifacts and evidence of deterministic answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lines, stem

ENTRY = "time string, operation string, page string, summary string"


def log_lines(entries: DataFrame) -> DataFrame:
    """(line) of `entries` (time timestamp, operation, page, summary) as rows of the log's table, to the minute; null fields are empty.

    A line end or bar within a field would begin a new row or cell; it becomes a blank.
    """
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\r\n|]", " ")
    at = F.date_format("time", "yyyy-MM-dd HH:mm")
    return entries.select(F.concat(F.lit("| "), at, F.lit(" UTC | "), cell("operation"), F.lit(" | "), cell("page"), F.lit(" | "), cell("summary"), F.lit(" |")).alias("line"))


def append_log(entries: DataFrame, folder: str) -> None:
    """Append `entries` to the log in `folder`, a text file per task; nothing is read or written again."""
    log_lines(entries).write.mode("append").text(folder)


def log_entries(logs: DataFrame) -> DataFrame:
    """(path, pos, time, operation, page, summary) of log texts (path, text): rows of the table but its head and rule.

    Blank cells do not count; a row of three has no page and shows a dash, shorter rows are passed over.
    """
    rows = logs.select("path", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    rows = rows.where(F.col("line").startswith("|") & ~F.col("line").startswith("| Time") & ~F.col("line").startswith("|---"))
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")
    told = rows.withColumn("c", cells).where(F.size("c") >= 3)
    four = F.size("c") >= 4
    return told.select("path", "pos", F.col("c")[0].alias("time"), F.col("c")[1].alias("operation"), F.when(four, F.col("c")[2]).otherwise("—").alias("page"), F.when(four, F.get("c", F.lit(3))).otherwise(F.col("c")[2]).alias("summary"))


def log_tail(entries: DataFrame, limit: int = 20) -> DataFrame:
    """The last `limit` entries of each log, in their order."""
    back = F.row_number().over(W.partitionBy("path").orderBy(F.desc("pos")))
    return entries.withColumn("_back", back).where(F.col("_back") <= limit).drop("_back")


def templates(files: DataFrame) -> DataFrame:
    """(name, description, template) of template files (path, text): the name is the file's, the description what its front matter says, or the name."""
    front = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    said = F.trim(F.regexp_replace(F.regexp_extract(front, r"(?m)^description:[ \t]*(.*)$", 1), r"""^\s*["']|["']\s*$""", ""))
    name = stem(F.col("path"))
    return files.where(F.col("path").endswith(".md")).select(name.alias("name"), F.when(said != "", said).otherwise(name).alias("description"), F.col("text").alias("template"))


def stale_artifacts(previous: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """The rows of `previous` whose `key` the current run no longer makes: what is to be removed. Null keys are never removed."""
    return previous.where(F.col(key).isNotNull()).join(current.select(key).distinct(), key, "left_anti")


def deterministic_evidence(found: Column, told: Column, missing: Column, cited: Column) -> Column:
    """struct(confidence, basis, abstain, rationale, provenance) of an answer read from parsed sources: strong where something was found, else absent and abstaining."""
    return F.struct(
        F.when(found, "strong").otherwise("absent").alias("confidence"), F.lit("deterministic").alias("basis"), (~found).alias("abstain"), F.when(found, told).otherwise(missing).alias("rationale"), cited.alias("provenance")
    )
