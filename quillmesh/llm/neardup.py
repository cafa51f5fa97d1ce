"""Near-duplicate records: MinHash bands, signature check, exact check, components.

1. One Python pass over the texts gives per record a class key (its shingle set), band
   keys of `BANDS x ROWS` universal hash minima and a one-byte-per-hash signature.
   Records of one class are copies; only the first of each class goes on, so a group of
   copies of any size costs one row.
2. Class representatives that share a band key are candidates. Single-member buckets drop
   out before the join; buckets beyond `BLOCK` members are spread over block pairs, so
   no task gets a whole large bucket. Nothing is capped.
3. Signatures discard candidates far below the threshold (six standard deviations), the
   shingle sets of the rest are compared exactly.
4. Groups are connected components by alternating large-star and small-star steps, each
   cut with a checkpoint, until nothing changes.

A pair at the threshold 0.6 shares no band with probability (1 - 0.6^3)^48 < 1e-5.

Defined results: null texts and texts of fewer than eight words have no class and no
partner (`class_id` is their own id in `groups`). Empty tables give empty results;
repeated ids are not expected, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .shingles import MIN_WORDS, Shingler, mix

ROWS, BANDS = 3, 48
BLOCK = 256


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def fingerprints(texts: DataFrame, width: int = 3, min_words: int = MIN_WORDS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """`texts` (id, text) to (id, class_key binary, n int, bands array<long>, sig binary); short texts drop out."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (a, b) = Shingler(width, min_words), _hashes(rows * bands)
        salt = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            ids, keys, sizes, band_keys, sigs = [], [], [], [], []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingler(text)
                if s is None:
                    continue
                minima = np.full(rows * bands, np.iinfo(np.uint64).max, np.uint64)
                for part in range(0, len(s), 4096):
                    h = (s[part : part + 4096, None] * a + b) >> np.uint64(20)
                    np.minimum(minima, h.min(axis=0), out=minima)
                by_band = minima.reshape(bands, rows)
                acc = salt
                for k in range(rows):
                    acc = mix(acc * np.uint64(31) + by_band[:, k])
                ids.append(id_)
                keys.append(xxhash.xxh128_digest(s.tobytes()))
                sizes.append(len(s))
                band_keys.append(acc.view(np.int64))
                sigs.append((mix(minima) & np.uint64(255)).astype(np.uint8).tobytes())
            flat = np.concatenate(band_keys) if band_keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), lists, pa.array(sigs, pa.binary())],
                ["id", "class_key", "n", "bands", "sig"],
            )

    return spread(texts.select("id", "text")).where("text is not null").mapInArrow(run, f"id {id_type}, class_key binary, n int, bands array<bigint>, sig binary")


def shingle_sets(texts: DataFrame, width: int = 3, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, shingles array<long>) of the texts that have a set."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width, min_words)
        for batch in batches:
            made = [(i, s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (s := shingler(t)) is not None]
            offsets = np.zeros(len(made) + 1, np.int32)
            np.cumsum([len(s) for _, s in made], out=offsets[1:])
            flat = np.concatenate([s for _, s in made]).view(np.int64) if made else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in made], batch.column(0).type), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
                ["id", "shingles"],
            )

    return texts.select("id", "text").where("text is not null").mapInArrow(run, f"id {id_type}, shingles array<bigint>")


def candidate_pairs(banded: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, of rows (id, bands) that share a band key."""
    return pairs_within(banded.select("id", F.explode("bands").alias("key")), block).distinct()


def pairs_within(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b, of the rows (key, id) of each key, once per key.

    The members of a key fall into blocks; each pair of blocks is a group of its own, so no
    task gets a whole large key.
    """
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    placed = keyed.join(counts, "key").withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("own", F.pmod(F.hash("id"), F.col("blocks")))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = placed.select(
        "key", "id", "own", F.explode(F.transform(others, lambda o: F.struct(F.least(F.col("own"), o).alias("x"), F.greatest(F.col("own"), o).alias("y")))).alias("cell")
    ).select("key", "id", "own", "cell.x", "cell.y")
    left, right = cells.alias("l"), cells.alias("r")
    # within a cell of two blocks only pairs across them, within a diagonal cell every pair once
    across = (F.col("l.x") == F.col("l.y")) | (F.col("l.own") != F.col("r.own"))
    same = (F.col("l.key") == F.col("r.key")) & (F.col("l.x") == F.col("r.x")) & (F.col("l.y") == F.col("r.y"))
    return left.join(right, same & (F.col("l.id") < F.col("r.id")) & across).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def _agreement(x: Column, y: Column) -> Column:
    @F.pandas_udf("float")
    def share(p, q):  # noqa: ANN001, ANN202
        import pandas as pd

        if not len(p):
            return pd.Series([], dtype="float32")
        u = np.frombuffer(b"".join(p), np.uint8).reshape(len(p), -1)
        v = np.frombuffer(b"".join(q), np.uint8).reshape(len(q), -1)
        return pd.Series((u == v).mean(axis=1), dtype="float32")

    return share(x, y)


def similar_pairs(texts: DataFrame, prints: DataFrame, threshold: float, width: int = 3, min_words: int = MIN_WORDS, slack: float | None = None) -> DataFrame:
    """(a, b, similarity) of the rows of `prints` (one per class) with an exact similarity of at least `threshold`."""
    hashes = ROWS * BANDS
    slack = 6 * (threshold * (1 - threshold) / hashes) ** 0.5 if slack is None else slack
    sig = prints.select("id", "n", "sig")
    pairs = (
        candidate_pairs(prints)
        .join(sig.toDF("a", "na", "sa"), "a")
        .join(sig.toDF("b", "nb", "sb"), "b")
        .where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
        .where(_agreement(F.col("sa"), F.col("sb")) >= threshold - slack)
        .select("a", "b")
    )
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = shingle_sets(texts.join(wanted, "id", "left_semi"), width, min_words)
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    similarity = common / (F.size("xa") + F.size("xb") - common)
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def classes(prints: DataFrame) -> DataFrame:
    """(id, class_id): records with the same shingle set share the least id."""
    first = prints.groupBy("class_key").agg(F.min("id").alias("class_id"))
    return prints.select("id", "class_key").join(first, "class_key").select("id", "class_id")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of the vertices of `edges` (a, b) by alternating large-star and small-star."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lesser neighbours go to the least of them
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(moved.select("e.u", "e.v").where("u > v").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
        state = seen
    raise RuntimeError("components did not settle")


def near_duplicates(texts: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Membership (id, class_id) and links between class representatives (a, b, similarity)."""
    prints = cut(fingerprints(texts, width, min_words))
    member = classes(prints)
    firsts = prints.join(member.where("id = class_id").select("id"), "id", "left_semi")
    return member, similar_pairs(texts, firsts, threshold, width, min_words)


def groups(texts: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per text: id, class_id (of exact copies), group_id (of linked classes), n_links (linked classes)."""
    member, links = near_duplicates(texts, threshold, width, min_words)
    links = cut(links)
    grouped = components(links).toDF("class_id", "_component")
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("_links"))
    known = member.join(degree.join(grouped, "class_id"), "class_id", "left")
    return (
        texts.select("id")
        .join(known, "id", "left")
        .select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("_component", "class_id", "id").alias("group_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))
    )


def all_pairs(member: DataFrame, links: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every pair (id_a < id_b) of different records in one class or in linked classes: where the result must list pairs.

    Classes of more than `block` members are dealt into parts on both sides of a link, so
    a class that holds a third of all records is many groups.
    """
    copies = pairs_within(member.select(F.col("class_id").alias("key"), "id"), block).toDF("id_a", "id_b")
    parts = member.groupBy("class_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    placed = member.join(parts, "class_id").select("id", "class_id", F.pmod(F.hash("id"), F.col("parts")).alias("part"))
    each = links.select("a", "b")
    for end in ("a", "b"):
        of = parts.select(F.col("class_id").alias(end), F.col("parts").alias(f"_{end}"))
        each = each.join(of, end).withColumn(f"part_{end}", F.explode(F.sequence(F.lit(0), F.col(f"_{end}") - 1))).drop(f"_{end}")
    linked = (
        each.join(placed.toDF("p", "a", "part_a"), ["a", "part_a"])
        .join(placed.toDF("q", "b", "part_b"), ["b", "part_b"])
        .select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    )
    return copies.union(linked)
