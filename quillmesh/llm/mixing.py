"""Mixing sources to target shares of tokens, by balanced sampling with the cube method.

Every document of a source gets the same expected number of copies, m = goal / tokens of
the source: floor(m) copies surely, and one more with probability m - floor(m). The cube
method turns these probabilities into a choice that keeps the number of documents and the
number of tokens: three undecided documents at a time move along the null vector of the
two constraints until one of them is decided. This flight runs in blocks of bounded size;
at most two documents per block stay undecided and fly on in blocks of blocks, and the
last two of a source land on the nearest token total. A source that holds a third of all
rows is many blocks.

The total is the largest at which every source with documents can reach its share within
`max_repeats`, or `total` if that is given; then a source that cannot reach its share
gives all it may. Targets of sources without documents are spread over the others in
proportion, and reported as not reached.

Defined results: null and empty texts have no tokens and are never chosen. Sources are
compared without blanks around, in lower case and with `-` for `_`; null sources and
sources without a target are not chosen. Repeated texts are documents of their own, as
are repeated ids. A target of zero, null or less chooses nothing. Equal sizes move in
pairs. The choice depends only on the ids and `seed`, not on the partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .encoding import TOKENIZER, encode

BLOCK = 20_000


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), "_", "-")


def sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) with sources in one spelling."""
    keyed = documents.select(F.struct("doc_id", source_key(F.col("source")).alias("source")).alias("_key"), "text")
    return encode(keyed, "_key", "text", tokenizer, lengths_only=True).select("_key.doc_id", "_key.source", F.col("n_tokens").cast("long").alias("n_tokens"))


def plan(totals: pd.DataFrame, targets: pd.DataFrame, total: float | None = None) -> pd.DataFrame:
    """Per source: goal (tokens), sure copies and the probability of one more. `totals`: source, docs, tokens."""
    t = targets.copy()
    t["source"] = t["source"].str.strip().str.lower().str.replace("_", "-")
    t = t.groupby("source", as_index=False).agg(target_share=("target_share", "sum"), max_repeats=("max_repeats", "max"))
    t = t.merge(totals, on="source", how="left").fillna({"docs": 0, "tokens": 0, "target_share": 0.0, "max_repeats": 0})
    usable = (t["tokens"] > 0) & (t["target_share"] > 0) & (t["max_repeats"] > 0)
    share = np.where(usable, t["target_share"], 0.0)
    share = share / share.sum() if share.sum() > 0 else share
    most = t["max_repeats"] * t["tokens"]
    if total is None:
        total = float((most[usable] / share[usable]).min()) if usable.any() else 0.0
    t["goal"] = np.minimum(share * total, most)
    copies = np.where(usable, t["goal"] / t["tokens"].where(usable, 1), 0.0)
    copies = np.where(np.abs(copies - np.round(copies)) < 1e-9, np.round(copies), copies)
    t["sure"] = np.floor(copies).astype(int)
    t["extra"] = copies - t["sure"]
    return t


def flight(probability: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: 0 or 1 for all but at most two, with the same sum and the same sum of sizes."""
    p = probability.astype(float).tolist()
    x = size.astype(float).tolist()
    waiting = [i for i, v in enumerate(p) if 0 < v < 1]
    coins = iter(rng.random(len(waiting) + 3).tolist())
    window: list[int] = []
    at = 0
    while True:
        while len(window) < 3 and at < len(waiting):
            window.append(waiting[at])
            at += 1
        if len(window) == 3:
            a, b, c = window
            u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
        elif len(window) == 2 and x[window[0]] == x[window[1]]:
            u = (1.0, -1.0)
        else:
            break
        ahead = back = float("inf")
        for i, d in zip(window, u):
            if d > 0:
                ahead, back = min(ahead, (1 - p[i]) / d), min(back, p[i] / d)
            elif d < 0:
                ahead, back = min(ahead, p[i] / -d), min(back, (1 - p[i]) / -d)
        step = ahead if next(coins) * (ahead + back) < back else -back
        for i, d in zip(window, u):
            v = p[i] + step * d
            p[i] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
        left = [i for i in window if 0 < p[i] < 1]
        if len(left) == len(window):  # rounding kept all inside: the one nearest to a bound is decided
            i = min(left, key=lambda i: min(p[i], 1 - p[i]))
            p[i] = round(p[i])
            left.remove(i)
        window = left
    return np.array(p)


def land(probability: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The undecided ones (few) by the subset nearest to the expected size; ties take the fewer documents."""
    p = probability.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        want = float((p[open_] * size[open_]).sum())
        best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(open_) if m >> k & 1) - want), bin(m).count("1"), m))
        for k, i in enumerate(open_):
            p[i] = best >> k & 1
    return p


def balanced(rows: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """`rows` (source, doc_id, n_tokens, p) with every p decided to 0 or 1, balanced per source."""

    def fly(last: bool):  # noqa: ANN202
        def one(group: pd.DataFrame) -> pd.DataFrame:
            g = group.sort_values(["doc_id", "n_tokens", "p"], kind="stable").reset_index(drop=True)
            rng = np.random.default_rng([seed, int(g["_block"].iloc[0]), len(g)])
            order = rng.permutation(len(g))
            p, x = g["p"].to_numpy(float), g["n_tokens"].to_numpy(float)
            done = flight(p[order], x[order], rng)
            out = np.empty_like(p)
            out[order] = land(done, x[order]) if last else done
            g["p"] = out
            return g

        return one

    schema = rows.select("source", "doc_id", "n_tokens", "p", F.lit(0).cast("long").alias("_block")).schema
    counts = {r["source"]: r["n"] for r in rows.where("p > 0 and p < 1").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as targets
    blocks = max([1, *(-(-n // block) for n in counts.values())])
    decided, now = rows.where("p = 0 or p = 1"), rows.where("p > 0 and p < 1")
    while True:
        # a block of a level holds about `block` rows: documents at first, then at most two of each block before
        placed = now.withColumn("_block", F.pmod(F.xxhash64("source", "doc_id"), F.lit(blocks)))
        now = cut(placed.groupBy("source", "_block").applyInPandas(fly(blocks == 1), schema).drop("_block"))
        decided = decided.unionByName(now.where("p = 0 or p = 1"))
        if blocks == 1:
            return decided
        now = now.where("p > 0 and p < 1")
        blocks = -(-2 * blocks // block)


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, tokenizer: str = TOKENIZER, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the chosen documents, copies at least 1.

    `targets`: source, target_share, max_repeats; one row per source, so they and their
    totals are small enough for the driver.
    """
    wanted = F.broadcast(targets.select(source_key(F.col("source")).alias("source")).distinct())
    sized = cut(sizes(documents, tokenizer).where("n_tokens > 0").join(wanted, "source"))
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")).toPandas()
    planned = plan(totals, targets.select("source", "target_share", "max_repeats").toPandas(), total)
    spark = documents.sparkSession
    goals = spark.createDataFrame([(r.source, int(r.sure), float(r.extra)) for r in planned.itertuples()], "source string, sure int, p double")
    rows = sized.join(F.broadcast(goals), "source").select("source", "doc_id", "n_tokens", "p", "sure")
    picked = balanced(rows.select("source", "doc_id", "n_tokens", "p"), block, seed)
    return (
        picked.join(F.broadcast(goals.select("source", "sure")), "source")
        .select("doc_id", "source", "n_tokens", (F.col("sure") + F.col("p").cast("int")).alias("copies"))
        .where("copies > 0")
    )


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: target_share, tokens, documents, copies, most copies of one document, reached_share."""
    of = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies")
    )
    asked = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    whole = of.agg(F.sum("tokens").alias("_all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (
        asked.join(of, "source", "left")
        .join(F.broadcast(whole), F.lit(True))
        .select("source", "target_share", "max_repeats", zero("tokens"), zero("documents"), zero("copies"), zero("most_copies"), F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"))
    )
