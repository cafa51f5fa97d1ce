"""How distinctive a term is per record: log-entropy weights.

Two aggregations: term counts per record, then per term its record frequency, total
frequency and the entropy of its spread over the records. The weight of a term in a
record is ln(1 + tf) * (1 - H / ln N), H = ln gf - sum(tf ln tf) / gf, N the number of
records that hold any term; with N = 1 the second factor is 1.

The second aggregation combines on the map side, so common terms do not meet in one task
row by row. Its join back to the records takes the commonest terms by broadcast: those
in more than 1/HOT_PARTS of all records, of which there are at most HOT_PARTS times the
mean record length; the rest meets in a shuffled join of even groups.

Defined results: null lists and null terms count nothing, a term that is empty after
cleaning neither. Repeated whole rows count once; ties share the same weight. Input
columns other than the id and the lists only decide which rows are repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 100
#: Full-width forms of the ASCII signs, of the blank and of the currency signs (fixed values).
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　￠￡￢￤￥￦"
_PLAIN = "".join(map(chr, range(0x21, 0x7F))) + " ¢£¬¦¥₩"


def clean_term(term: Column) -> Column:
    """Ordinary width, lower case, no other signs than letters and digits at either end."""
    return F.regexp_replace(F.lower(F.translate(term, _WIDE, _PLAIN)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def term_counts(records: DataFrame, id_col: str, lists: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """id, `_record` (tells different rows of one id apart), term, tf.

    `keep` names the columns that make a row a repeat of another (all of them if empty).
    A map column is compared by its entries.
    """
    columns = [F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in records.dtypes if not keep or c in keep]
    one = records.withColumn("_record", F.xxhash64(*columns)).select(id_col, "_record", *lists)
    one = one.dropDuplicates([id_col, "_record"])
    empty = F.array().cast("array<string>")
    terms = F.concat(*[F.coalesce(F.col(c), empty) for c in lists])
    # term frequencies of a record are counted within its row: no shuffle of single terms
    counted = one.select(id_col, "_record", F.filter(F.transform(terms, clean_term), lambda x: x.isNotNull() & (x != "")).alias("_terms"))
    return counted.select(id_col, "_record", F.explode("_terms").alias("term")).groupBy(id_col, "_record", "term").agg(F.count(F.lit(1)).alias("tf"))


def log_entropy(counts: DataFrame, id_col: str) -> DataFrame:
    """id, term, tf, df, gf, weight; one row per record and term."""
    tf = F.col("tf").cast("double")
    spread = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("gf"), F.sum(tf * F.log(tf)).alias("_tlt"))
    size = counts.select(id_col, "_record").distinct().agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(spread.join(F.broadcast(size), F.col("df") * HOT_PARTS > F.col("_n")).drop("_n"))
    known = counts.join(hot.select("term", F.struct("df", "gf", "_tlt").alias("_hot")), "term", "left")
    warm = known.where("_hot is not null").select(*counts.columns, "_hot.df", "_hot.gf", "_hot._tlt")
    cold = known.where("_hot is null").select(*counts.columns).join(spread, "term")
    entropy = F.log("gf") - F.col("_tlt") / F.col("gf")
    share = F.when(F.col("_n") > 1, 1 - entropy / F.log("_n")).otherwise(1.0)
    return (
        warm.unionByName(cold)
        .join(F.broadcast(size), F.lit(True))
        .select(id_col, "term", "tf", "df", "gf", (F.log1p(tf) * F.greatest(share, F.lit(0.0))).alias("weight"))
    )


def distinctive(weighted: DataFrame, id_col: str, least_tf: int = 4, most_df: int = 3) -> DataFrame:
    """Terms frequent in their record and rare in the collection."""
    return weighted.where((F.col("tf") >= least_tf) & (F.col("df") <= most_df)).select(id_col, "term").distinct()
