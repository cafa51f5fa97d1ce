"""Extraction results: HTML to text, page ranges, line chunks, heading chunks, packs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from ..session import cut


def html_text(html: Column) -> Column:
    """Without scripts and styles, each tag a line end, at most one empty line in a row, nothing around."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def page_range(wanted: Column, total: Column) -> Column:
    """Zero-based pages of `1-3,7-10`, sorted, within 1..total; parts that are no range are passed over."""
    parts = F.filter(F.split(wanted, ","), lambda p: p.rlike(r"^\s*\d{1,9}(\s*-\s*\d{1,9})?\s*$"))

    def one(p: Column) -> Column:
        low = F.greatest(F.lit(1), F.regexp_extract(p, r"^\s*(\d+)", 1).cast("int"))
        last = F.regexp_extract(p, r"-\s*(\d+)\s*$", 1)
        high = F.least(total, F.when(last != "", last.cast("int")).otherwise(F.regexp_extract(p, r"^\s*(\d+)", 1).cast("int")))
        return F.when(low <= high, F.sequence(low - 1, high - 1)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))


def chunks(segments: DataFrame, most_lines: int) -> DataFrame:
    """(seg_id, file, seg_no, chunk_no, text, n_lines): blocks of `most_lines` lines; later blocks repeat the column headers."""
    all_ = lines(F.col("text"))
    rows = segments.where("text is not null").select("seg_id", "file", "seg_no", "column_headers", all_.alias("all"))
    starts = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / most_lines).cast("int"))
    parts = F.transform(starts, lambda i: F.slice("all", i * most_lines + 1, F.lit(most_lines)))
    each = rows.select("seg_id", "file", "seg_no", "column_headers", F.posexplode(parts).alias("chunk_no", "part"))
    body = F.array_join("part", "\n")
    head = (F.col("chunk_no") > 0) & F.col("column_headers").isNotNull() & (F.col("column_headers") != "")
    text = F.when(head, F.concat("column_headers", F.lit("\n"), body)).otherwise(body)
    return each.select("seg_id", "file", "seg_no", "chunk_no", text.alias("text"), F.size(lines(text)).alias("n_lines"))


def packs(chunked: DataFrame, most_lines: int, order: Sequence[str] = ("file", "seg_no", "seg_id", "chunk_no")) -> DataFrame:
    """(topic, file, seg_id, chunk_no, pack_no): in order of file, segment and chunk a topic's pack is closed before it would grow beyond `most_lines`.

    A pack may span files of its topic. The count of a pack depends on all chunks before it,
    so the sizes (texts stay behind) are sorted into ranges over all tasks, and each range
    first tells, for every number of lines that may be left open before it, how many packs
    it closes and what it leaves open: at most `most_lines` + 1 numbers per range and topic.
    These are chained per topic, and each range then numbers its chunks from what it was left.
    A topic of any size is thus many tasks. `chunked`: topic, `order` and n_lines; ties in
    the order are the caller's to avoid.
    """
    columns = ["topic", *order]
    ranged = chunked.select(*columns, F.greatest(F.col("n_lines"), F.lit(0)).cast("int").alias("n_lines")).repartitionByRange(*columns).sortWithinPartitions(*columns)
    ranged = cut(ranged.withColumn("_range", F.spark_partition_id()))
    cap = most_lines + 1  # more open lines than a pack may have close it before any further line

    def effect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        topic, state, key, begun = None, None, None, False
        for b in batches:
            out = []
            for t, r, n in zip(b["topic"], b["_range"], b["n_lines"]):
                if not begun or t != topic:
                    if begun:
                        out.append((*key, state[0].tolist(), state[1].tolist()))
                    topic, key, begun = t, (t, int(r)), True
                    state = np.arange(cap + 1), np.zeros(cap + 1, np.int64)
                used, closed = state
                full = (used > 0) & (used + n > most_lines)
                state = np.minimum(np.where(full, n, used + n), cap), closed + full
            yield pd.DataFrame(out, columns=["topic", "_range", "used", "closed"])
        if begun:
            yield pd.DataFrame([(*key, state[0].tolist(), state[1].tolist())], columns=["topic", "_range", "used", "closed"])

    effects = ranged.select("topic", "_range", "n_lines").mapInPandas(effect, "topic string, _range int, used array<int>, closed array<bigint>")
    chain = F.sort_array(F.collect_list(F.struct("_range", "used", "closed")))  # as many as there are ranges with the topic
    begin = F.struct(F.lit(0).alias("used"), F.lit(1).cast("bigint").alias("pack"), F.array().cast("array<struct<_range:int,used:int,pack:bigint>>").alias("out"))
    step = lambda a, x: F.struct(x["used"][a["used"]].alias("used"), (a["pack"] + x["closed"][a["used"]]).alias("pack"), F.concat(a["out"], F.array(F.struct(x["_range"], a["used"], a["pack"]))).alias("out"))
    starts = effects.groupBy("topic").agg(chain.alias("x")).select("topic", F.explode(F.aggregate("x", begin, step)["out"]).alias("s")).select("topic", "s.*")
    shared = ranged.sparkSession.sparkContext.broadcast({(r["topic"], r["_range"]): (r["used"], r["pack"]) for r in starts.collect()})  # ranges and topics, no chunks

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        topic, used, pack, begun = None, 0, 1, False
        for b in batches:
            numbers = []
            for t, r, n in zip(b["topic"], b["_range"], b["n_lines"]):
                if not begun or t != topic:
                    topic, begun = t, True
                    used, pack = shared.value[t, int(r)]
                if used > 0 and used + n > most_lines:
                    used, pack = 0, pack + 1
                used = min(used + n, cap)
                numbers.append(pack)
            yield b.drop(columns=["_range", "n_lines"]).assign(pack_no=numbers)

    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema}
    return ranged.mapInPandas(number, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", pack_no int").drop(*[c for c in order if c == "seg_no"])


def pack_report(packed: DataFrame) -> DataFrame:
    """(topic, pack_no, chunks, segments, files)."""
    return packed.groupBy("topic", "pack_no").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("seg_id").alias("segments"), F.countDistinct("file").alias("files"))


def flat_text(segments: DataFrame) -> DataFrame:
    """(file, text): segments in order with the separators of sheets and slides."""
    part = F.when(F.col("sheet").isNotNull(), F.concat(F.lit("--- Sheet: "), "sheet", F.lit(" ---\n"), "text")).when(F.col("slide").isNotNull(), F.concat(F.lit("--- Slide "), F.col("slide").cast("string"), F.lit(" ---\n"), "text")).otherwise(F.col("text"))
    rows = segments.where("text is not null").select("file", "seg_no", "seg_id", part.alias("part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "seg_id", "part"))), lambda x: x["part"]), "\n\n")
    return rows.groupBy("file").agg(joined.alias("text"))


def topic_slug(topic: Column) -> Column:
    """A topic as a safe path; null for empty ones and those that would leave the folder."""
    bad = topic.isNull() | (topic == "") | topic.contains("..") | topic.startswith("/") | topic.startswith("\\")
    return F.when(~bad, F.regexp_replace(F.regexp_replace(F.regexp_replace(topic, r"[^a-zA-Z0-9_\-/]", "-"), r"/{2,}", "/"), r"^/|/$", ""))


def semantic_segments(pages: DataFrame) -> DataFrame:
    """(path, part, text): by headings if a text has more than one non-blank section, else whole."""
    from pyspark.sql import Window as W

    from .pages import sections

    full = sections(pages).where(F.trim("content") != "").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("path")))
    split = full.where("n > 1").select("path", F.col("pos").alias("part"), F.col("content").alias("text"))
    rest = pages.where("content is not null").select("path", F.lit(0).alias("part"), F.col("content").alias("text")).join(split.select("path").distinct(), "path", "left_anti")
    return split.unionByName(rest)
