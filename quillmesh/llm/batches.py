"""Duplicates of new loads against all accepted history, by a stored table of pivot distances.

Documents are shingle sets under the metric |A xor B|; the Jaccard similarity t is reached
exactly if |A xor B| <= (1-t)/(1+t) (|A|+|B|). The fixed pivots are the empty set and one
singleton {h} per shingle hash h. The distance to the empty pivot is n = |A|; to {h} it is
n - 1 if h lies in A, else n + 1. Only distances below n are stored, those to pivots inside
the set, of these the first n - ceil(t n) + 1 in a fixed order of all pivots. Two sets within the bound
share one of them (prefix filtering, a bound on counts), their n lie in a range of each
other (the triangle inequality at the empty pivot), and the places of the shared pivots
bound how much they can have in common. Each stored distance carries a sketch of its set, 128 bits
that every shingle flips one of: two sketches differ in no more bits than their sets do in shingles, so
pairs whose sketches are too far apart end within the join, before anything of them is shuffled. A sketch of 512 bits by class
ends most of the others, larger sets above all, before texts are sent. The true distance is
computed for what is left, from the texts. Dense pivots (a few documents under the Jaccard distance) prune nothing here; see README.

History is a folder of tables that are written in buckets: `pivots` by pivot, `sets` by class,
`keys` by key. A load only probes them: its own rows go to the buckets, the history is
neither shuffled nor sorted anew, and the sets of the history are read for candidates only.
Rows carry the number of their load; a load that failed leaves rows that nobody reads.
`sets` has the text of a class, which takes a fraction of the bytes of its shingles. `pivots` has the distances of
all classes that a load brings, also of those it does not accept: these are in no row of `sets`, so no pair with them counts.

Disk: a load's own tables (`scratch`) are packed files that end with the load, and its shuffles end
with the action that made them. A text is shuffled once, to the bucket of its class, and a distance once, to that of its pivot.

The order of pivots is rare-first by a sketch of counters over the load that opens it, of a
fixed size however large the corpus. When the history has grown by `GROWTH` since, the next
load opens a new order: its rows are stored under the new one and probe under each (at most
log of the growth), so pivots that became common later do not pile up. Pivots that are
common in the sketch are split: their stored distances are dealt over parts, and a probe looks into
each part.

Rows with the same hash, set and place act as one: the first stands for all, so a group of
copies of any size is one row. Within a load acceptance is sequential by definition; it is decided in
rounds over keys (hash, set, similar set, place), one aggregated row per key.

Defined results: rows with size 0 are left out; a null size is not 0. Null and empty
hashes match nothing. A row without hash and without body is compared by path and size (both must
be known). A body that is short has no similarity but still is a body. Ties do not occur, as the order
(batch_no, raw_id) is total; null batch numbers come first. Loads must come in that order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import raw_path, sha_key
from ..session import checkpoint_dir, cut, spread
from .shingles import MIN_WORDS, Shingler, mix

THRESHOLD = 0.6
WIDTH = 3
#: Counters of the sketch behind an order of pivots; stored distances of a common pivot that one part takes.
COUNTERS, PART = 1 << 18, 4096
#: A new order is opened when the history has grown by this factor since the last.
GROWTH = 4

TABLES = {
    "pivots": ("pivot", "pivot bigint, cls bigint, n int, pos int, bits1 bigint, bits2 bigint, load int"),
    "sets": ("cls", "cls bigint, cls2 bigint, id bigint, body string, wide array<bigint>, load int"),
    "keys": ("k1", "k1 bigint, k2 bigint, id bigint, load int"),
}
#: Tables of one load alone.
PROBES = "pivot bigint, cls bigint, n int, pos int, bits1 bigint, bits2 bigint, store tinyint"
ROWS = "raw_id bigint, ord struct<b:int,r:bigint>, h1 bigint, h2 bigint, p1 bigint, p2 bigint, loose boolean, body string, c1 bigint, c2 bigint, wide array<bigint>, s1 bigint, s2 bigint, place bigint"
BITS = ("bits1", "bits2")
#: Bits of the sketch by class.
WIDE = 512
#: Ends the shuffle files of an action with the action.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _pair(tag: str, value: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits that stand for `value`, null if it is null."""
    return [F.when(value.isNotNull(), F.xxhash64(F.lit(f"{tag}{i}"), value)).alias(n) for i, n in enumerate(names)]


def arrivals(raw_docs: DataFrame) -> DataFrame:
    """raw_id, ord (total order of arrival), h1/h2 (hash), p1/p2 (path and size), loose (only its place can tell), body."""
    rows = raw_docs.where(F.coalesce(F.col("size") != 0, F.lit(True)))
    sha = sha_key(F.col("sha256"))
    place = F.concat(F.col("size").cast("string"), F.lit(":"), raw_path(F.col("path")))
    no_body = F.coalesce(F.trim(F.col("body")), F.lit("")) == ""
    return rows.select(
        "raw_id",
        F.struct(F.coalesce("batch_no", F.lit(-(2**31))).alias("b"), F.col("raw_id").alias("r")).alias("ord"),
        *_pair("h", sha, ("h1", "h2")),
        *_pair("p", place, ("p1", "p2")),
        (sha.isNull() & no_body).alias("loose"),
        "body",
    )


def with_classes(rows: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS) -> DataFrame:
    """`rows` with c1/c2 (class: 128 bits of the shingle set of `body`) and wide (its sketch); null, as the body then is, for short bodies."""
    kept = [c for c in rows.columns if c != "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width, min_words)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            sets = [shingler(t) for t in texts]
            marks = [None if s is None else np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64).tolist() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(kept))],
                    pa.array([None if s is None else t for s, t in zip(sets, texts)], pa.string()),
                    *[pa.array([m and m[k] for m in marks], pa.int64()) for k in (0, 1)],
                    pa.array([None if s is None else set_bits(s, WIDE) for s in sets], pa.list_(pa.int64())),
                ],
                [*kept, "body", "c1", "c2", "wide"],
            )

    known = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return spread(rows.select(*kept, "body")).mapInArrow(run, f"{known}, body string, c1 bigint, c2 bigint, wide array<bigint>")


def classes(rows: DataFrame) -> DataFrame:
    """(cls, cls2, body, wide): one row per class of `rows`, without a shuffle if these lie in buckets of `place`."""
    return rows.where("c1 is not null").groupBy(F.col("place").alias("cls")).agg(F.min("c2").alias("cls2"), F.first("body").alias("body"), F.first("wide").alias("wide"))


def sketch(sets: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS) -> np.ndarray:
    """How common pivots are by slot, less the median of all slots; the driver gets `COUNTERS` sums at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(width, min_words), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, shingler(text) & np.uint64(COUNTERS - 1), 1)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(counts[slots], pa.int64())], ["slot", "n"])

    found = sets.select("body").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found["slot"]] = found["n"]
    return np.maximum(counts - int(np.median(counts)), 0).astype(np.uint32)


def set_bits(shingles: np.ndarray, bits: int = 64 * len(BITS)) -> np.ndarray:
    """So many bits of a set (a power of two), of which every shingle flips one."""
    flips = np.bincount((shingles >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def pivot_rows(sets: DataFrame, orders: list[tuple[int, np.ndarray]], threshold: float = THRESHOLD, part: int = PART, width: int = WIDTH, min_words: int = MIN_WORDS) -> DataFrame:
    """(PROBES): the first pivots of each of `sets` (cls, body, new) under every order; `store` marks the rows to keep in the history.

    `pivot` is a hash of shingle, order and part. A pivot with more than `part` counts in
    the sketch has parts: a class is stored in one of them and probes them all.
    """
    shared = sets.sparkSession.sparkContext.broadcast(orders)  # one sketch per order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width, min_words)
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for cls, body, new in zip(*[c.to_pylist() for c in batch.columns]):
                h = shingler(body)
                n = len(h)
                bits = set_bits(h)
                need = n - int(np.ceil(n * threshold - 1e-9)) + 1
                for k, (number, weights) in enumerate(shared.value):
                    w = weights[h & np.uint64(COUNTERS - 1)]
                    first = np.lexsort((h, w))[:need]
                    parts = 1 + w[first].astype(np.int64) // part
                    pos = np.repeat(np.arange(need, dtype=np.int32), parts)
                    each = np.arange(len(pos)) - np.repeat(np.cumsum(parts) - parts, parts)
                    pivot = mix(h[first][pos] + np.uint64(number * 0x9E3779B97F4A7C15 % 2**64) + each.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                    store = (cls % parts[pos] == each) & (new and k == len(shared.value) - 1)
                    out.append((pivot.view(np.int64), np.full(len(pos), cls, np.int64), np.full(len(pos), n, np.int32), pos, *[np.full(len(pos), b, np.int64) for b in bits], store.astype(np.int8)))
            types = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int8)
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in types]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in PROBES.split(", ")])

    return sets.select("cls", "body", "new").mapInArrow(run, PROBES)


def candidates(probes: DataFrame, stored: DataFrame, threshold: float, inner: bool) -> DataFrame:
    """(a, b, na, nb, pa, pb) per shared pivot of a probing class a and a stored class b that size, places and, if both have them, sketches leave possible; once per pair if `inner`."""
    bits = [c for c in BITS if c in probes.columns and c in stored.columns]
    side = lambda rows, x: rows.select("pivot", F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), *[F.col(c).alias(f"{x}_{c}") for c in bits])
    apart = (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    near = F.abs(F.col("na") - F.col("nb")) <= apart
    most = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    near &= most >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9
    if bits:
        near &= sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in bits) <= apart
    other = F.col("a") < F.col("b") if inner else F.col("a") != F.col("b")
    return side(probes, "a").join(side(stored, "b"), "pivot").where(other & near).select("a", "b", "na", "nb", "pa", "pb")


def possible(shared: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b, old) with na, nb whose places leave room for enough in common: shared pivots so far plus the shorter rest behind the last."""
    pairs = shared.groupBy("a", "b", "old").agg(F.count(F.lit(1)).alias("c"), *[F.max(x).alias(x) for x in ("pa", "pb", "na", "nb")])
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    return pairs.where(F.col("c") + rest >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9).select("a", "b", "old", "na", "nb")


def similar(pairs: DataFrame, threshold: float, width: int = WIDTH, min_words: int = MIN_WORDS) -> DataFrame:
    """`pairs` without the texts xa and xb, where the similarity of these reaches `threshold`."""
    kept = [c for c in pairs.columns if c not in ("xa", "xb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, a = Shingler(width, min_words), None, None
        for batch in batches:
            yes = []
            for xa, xb in zip(*[batch.column(len(kept) + k).to_pylist() for k in (0, 1)]):
                last, a = (last, a) if xa == last else (xa, shingler(xa))
                b = shingler(xb)
                common = len(np.intersect1d(a, b, assume_unique=True))
                yes.append(common >= (len(a) + len(b) - common) * threshold - 1e-9)
            yield batch.select(list(range(len(kept)))).filter(pa.array(yes, pa.bool_()))

    known = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*kept).schema)
    return pairs.select(*kept, "xa", "xb").mapInArrow(run, known)


def _keys(rows: DataFrame, *columns: str, heard: bool) -> DataFrame:
    """One row per key: `columns`, k1, k2. `heard`: the keys that can make a row a duplicate, else those that it shows to others."""
    key = lambda a, b, when: F.when(F.col(a).isNotNull() & when, F.struct(F.col(a).alias("k1"), F.col(b).alias("k2")))
    yes = F.lit(True)
    keys = F.array_compact(F.array(key("h1", "h2", yes), key("c1", "c2", yes), key("p1", "p2", F.col("loose") if heard else yes)))
    return rows.select(*columns, F.explode(keys).alias("k")).select(*columns, "k.k1", "k.k2")


def _least(rows: DataFrame, links: DataFrame, by_key: DataFrame, marks: list[str]) -> DataFrame:
    """`rows` with the least `marks` of `by_key` over all keys that each row hears, similar classes included."""
    near = links.join(by_key, (F.col("b") == F.col("k1")) & (F.col("b2") == F.col("k2"))).groupBy("a").agg(*[F.min(m).alias(f"_{m}") for m in marks])
    own = _keys(rows, "raw_id", heard=True).join(by_key, ["k1", "k2"]).groupBy("raw_id").agg(*[F.min(m).alias(m) for m in marks])
    both = rows.join(own, "raw_id", "left").join(near, rows["c1"] == near["a"], "left")
    return both.select(*rows.columns, *[F.least(m, f"_{m}").alias(m) for m in marks])


REP = ("raw_id", "ord", "h1", "h2", "p1", "p2", "loose", "c1", "c2", "s1", "s2")


def settle(reps: DataFrame, links: DataFrame, most_rounds: int = 500, keep: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, (raw_id, first)) for `reps` (columns REP): `first` is the accepted row that each other one duplicates.

    A row is accepted once no earlier undecided row can make it a duplicate, and is out
    once an earlier accepted one does. `links` (a, b, b2): similar classes, both ways. `keep` stores a round.
    """
    columns = list(REP)
    state = reps.select(*columns, F.lit(False).alias("taken"))
    out = None
    for _ in range(most_rounds):
        by_key = _keys(state, "ord", "taken", heard=False).groupBy("k1", "k2").agg(F.min(F.when(~F.col("taken"), F.col("ord"))).alias("open"), F.min(F.when(F.col("taken"), F.col("ord"))).alias("kept"))
        seen = _least(state.where("not taken"), links, by_key, ["open", "kept"])
        dropped = F.coalesce(F.col("kept") < F.col("ord"), F.lit(False))
        taken = ~dropped & F.coalesce(F.col("open") >= F.col("ord"), F.lit(True))
        now = keep(seen.select(*columns, taken.alias("taken"), dropped.alias("dropped")))
        left = now.agg(F.count_if("dropped"), F.count_if(~F.col("taken") & ~F.col("dropped"))).first()
        if left[0]:
            gone = now.where("dropped").select(*columns)
            out = gone if out is None else out.unionByName(gone)
        state = state.where("taken").unionByName(now.where("not dropped").drop("dropped"))
        if not left[1]:
            break
    else:
        raise RuntimeError("acceptance did not settle")
    accepted = state.select(*columns)
    if out is None:
        return accepted, accepted.limit(0).select("raw_id", F.col("raw_id").alias("first"))
    by_key = _keys(accepted, "ord", heard=False).groupBy("k1", "k2").agg(F.min("ord").alias("kept"))
    return accepted, _least(out, links, by_key, ["kept"]).select("raw_id", F.col("kept.r").alias("first"))


@dataclass
class History:
    """Accepted rows, their keys, sets and pivot distances as bucketed tables in one shared folder.

    `buckets` counts when the history is begun (the cores of the session by default) and
    is kept in the folder.
    """

    spark: SparkSession
    folder: str
    threshold: float = THRESHOLD
    width: int = WIDTH
    buckets: int | None = None
    part: int = PART

    def __post_init__(self) -> None:
        marks = self._marks()
        self.started = {int(m.split(".")[0]) for m in marks if m.endswith(".open")}
        self.done = {int(p[0]): int(p[2]) for m in marks if (p := m.split("."))[1] == "done"}
        known = [int(m.split(".")[1]) for m in marks if m.startswith("buckets.")]
        self.buckets = known[0] if known else self.buckets or self.spark.sparkContext.defaultParallelism
        if not known:
            self._mark(f"buckets.{self.buckets}")
        self.orders = [] if not self._exists("orders") else [(r.load, r.accepted, np.frombuffer(r.weights, np.uint32)) for r in self.spark.read.parquet(f"{self.folder}/orders").orderBy("load").collect()]
        name = uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex
        self.names = {t: f"history_{name}_{t}" for t in TABLES}
        for t, (by, schema) in TABLES.items():
            self.spark.sql(f"create table if not exists {self.names[t]} ({schema}) using parquet options (compression 'zstd') clustered by ({by}) sorted by ({by}) into {self.buckets} buckets location '{self.folder}/{t}'")

    def _path(self, name: str) -> tuple:  # type: ignore[type-arg]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        files, path = self._path(name)
        return files.exists(path)

    def _marks(self) -> list[str]:
        """Empty files that say how many buckets there are, which loads were begun, and which were done with how many rows accepted."""
        files, path = self._path("loads")
        return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

    def _mark(self, name: str) -> None:
        files, path = self._path(f"loads/{name}")
        files.create(path, False).close()

    @property
    def accepted(self) -> int:
        return sum(self.done.values())

    def table(self, name: str) -> DataFrame:
        """A table of the history without the rows of loads that failed."""
        failed = self.started - self.done.keys()
        rows = self.spark.table(self.names[name])
        return rows.where(~F.col("load").isin(*failed)) if failed else rows

    def _append(self, name: str, rows: DataFrame, load: int) -> None:
        by, schema = TABLES[name]
        columns = [c.split()[0] for c in schema.split(", ")][:-1]
        rows.select(*columns, F.lit(load).alias("load")).repartition(self.buckets, by).write.insertInto(self.names[name])

    def _drop(self, name: str) -> None:
        files, path = self._path(name)
        files.delete(path, True)

    def _keep(self, rows: DataFrame, name: str) -> DataFrame:
        """`rows` as written to the packed files of a folder."""
        path = f"{self.folder}/{name}"
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _scratch(self, rows: DataFrame) -> DataFrame:
        """`rows` as written for this load only."""
        return self._keep(rows, f"scratch/{uuid.uuid4().hex}")

    @contextmanager
    def _own_tables(self, **tables: tuple[str, str]) -> Iterator[dict[str, str]]:
        """Bucketed tables (by, schema) for this load only; these, all of `scratch` and the shuffles end with it."""
        before = self.spark.conf.get(RELEASE, None)
        names = {t: f"{self.names['keys']}_{t}" for t in tables}
        self._drop("scratch")  # of a load that failed
        self.spark.conf.set(RELEASE, "true")
        try:
            for t, (by, schema) in tables.items():
                self.spark.sql(f"drop table if exists {names[t]}")
                self.spark.sql(f"create table {names[t]} ({schema}) using parquet options (compression 'zstd') clustered by ({by}) into {self.buckets} buckets location '{self.folder}/scratch/{t}'")
            yield names
        finally:
            for name in names.values():
                self.spark.sql(f"drop table if exists {name}")
            self._drop("scratch")
            if before is None:
                self.spark.conf.unset(RELEASE)
            else:
                self.spark.conf.set(RELEASE, before)

    def _open_order(self, rows: DataFrame, load: int) -> None:
        if self.orders and (not self.accepted or self.accepted < GROWTH * max(1, self.orders[-1][1])):
            return
        sets = classes(rows)
        weights = sketch(sets, self.width)
        size = max(self.accepted + rows.where("c1 is not null").count(), 1)  # the load that opens an order is in its sketch
        self.spark.createDataFrame([(load, size, bytearray(weights.tobytes()))], "load int, accepted bigint, weights binary").coalesce(1).write.mode("append").parquet(f"{self.folder}/orders")
        self.orders.append((load, size, weights))

    def add(self, raw_docs: DataFrame) -> DataFrame:
        """Decide one load (one batch or many) and append what it brings; returns (raw_id, accepted_id or null)."""
        load = 1 + max(self.started, default=0)
        self._mark(f"{load}.open")
        self.started.add(load)
        with self._own_tables(rows=("place", ROWS), probes=("pivot", PROBES)) as names:
            return self._decide(raw_docs, load, names)

    def _decide(self, raw_docs: DataFrame, load: int, names: dict[str, str]) -> DataFrame:
        sign = lambda seed: F.xxhash64(F.lit(seed), "h1", "h2", "c1", "c2", F.when(F.col("loose"), F.col("p1")), F.when(F.col("loose"), F.col("p2")), F.when(F.coalesce("h1", "c1", F.when(F.col("loose"), F.col("p1"))).isNull(), F.col("raw_id")))
        made = with_classes(arrivals(raw_docs), self.width).withColumns({"s1": sign(1), "s2": sign(2), "place": F.coalesce("c1", F.xxhash64("raw_id"))})
        made.select(*[f.split()[0] for f in ROWS.split(", ")]).repartition(self.buckets, "place").write.insertInto(names["rows"])
        rows = self.spark.table(names["rows"])
        old = self.accepted > 0
        self._open_order(rows, load)
        sets = classes(rows).withColumn("new", F.lit(True))
        if old:  # a class that the history has is not stored again
            sets = sets.drop("new").join(self.table("sets").select("cls", F.lit(False).alias("new")), "cls", "left").withColumn("new", F.coalesce("new", F.lit(True)))
        pivot_rows(sets, [(number, w) for number, _, w in self.orders], self.threshold, self.part, self.width).repartition(self.buckets, "pivot").write.insertInto(names["probes"])
        probes = self.spark.table(names["probes"])
        links = self._scratch(self._links(rows, probes, old))
        reps = rows.groupBy("s1", "s2").agg(F.min(F.struct("ord", "raw_id", "h1", "h2", "p1", "p2", "loose", "c1", "c2")).alias("x")).select("x.*", "s1", "s2").select(*REP)
        known = self._scratch(self._known(reps, links) if old else reps.withColumn("known", F.lit(None).cast("bigint")))
        both = links.where("not old").select("a", "a2", "b", "b2")
        both = both.select("a", "b", "b2").union(both.select("b", "a", "a2"))
        accepted, repeats = settle(known.where("known is null"), both, keep=self._scratch)
        accepted = self._scratch(accepted)
        decided = known.join(repeats, "raw_id", "left").select("s1", "s2", F.col("raw_id").alias("rep"), F.coalesce("known", "first").alias("first"))
        out = rows.select("raw_id", "s1", "s2").join(decided, ["s1", "s2"])
        out = self._keep(out.select("raw_id", F.coalesce("first", F.when(F.col("raw_id") != F.col("rep"), F.col("rep"))).alias("accepted_id")), f"decided/{load}")
        self._append("keys", _keys(accepted.withColumn("id", F.col("raw_id")), "id", heard=False), load)
        fresh = accepted.where("c1 is not null").select(F.col("c1").alias("cls"), F.col("raw_id").alias("id"))  # one row per class, as equal sets are duplicates
        self._append("sets", classes(rows).join(fresh, "cls"), load)
        self._append("pivots", probes.where("store = 1"), load)
        self.done[load] = accepted.count()
        self._mark(f"{load}.done.{self.done[load]}")
        return out

    def _links(self, rows: DataFrame, probes: DataFrame, old: bool) -> DataFrame:
        """(a, a2, b, b2, id, old) of the classes within the distance: a of the load, b of the load or (`old`) of the history, where `id` has it."""
        shared = candidates(probes, probes.where("store = 1"), self.threshold, True).withColumn("old", F.lit(False))
        if old:
            # of the classes that the history has, the load stores none: they meet their like there
            shared = shared.unionByName(candidates(probes, self.table("pivots"), self.threshold, False).withColumn("old", F.lit(True)))
        pairs = self._scratch(possible(shared, self.threshold))
        ends = [classes(rows).withColumn("id", F.lit(None).cast("bigint"))] + [self.table("sets")] * old

        def both(pairs: DataFrame, named: dict[str, str]) -> DataFrame:
            """`pairs` with columns of the classes at either end, under their name and the end's: `named` of a column of `ends`."""
            side = lambda rows, x: rows.select(F.col("cls").alias(x), *[F.col(c).alias(n + x) for c, n in named.items()])
            half = pairs.join(side(ends[0], "a"), "a")
            met = [half.where(~F.col("old") if k == 0 else F.col("old")).join(side(end, "b"), "b") for k, end in enumerate(ends)]
            return met[0] if len(met) == 1 else met[0].unionByName(met[1])

        differing = F.aggregate(F.zip_with("xa", "xb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        close = both(pairs, {"wide": "x"}).where(differing <= (F.col("na") + F.col("nb")) * ((1 - self.threshold) / (1 + self.threshold)) + 1e-9)
        found = both(self._scratch(close.select("a", "b", "old")), {"cls2": "cls2", "id": "id", "body": "x"})
        found = found.withColumnsRenamed({"cls2a": "a2", "cls2b": "b2", "idb": "id"}).drop("ida")
        return similar(found, self.threshold, self.width).select("a", "a2", "b", "b2", "id", "old")

    def _known(self, reps: DataFrame, links: DataFrame) -> DataFrame:
        """`reps` with `known`: the least accepted id of the history that each duplicates, or null."""
        own = _keys(reps, "raw_id", heard=True).join(self.table("keys").select("k1", "k2", "id"), ["k1", "k2"]).groupBy("raw_id").agg(F.min("id").alias("_own"))
        near = links.where("old").groupBy("a").agg(F.min("id").alias("_near"))
        both = reps.join(own, "raw_id", "left").join(near, reps["c1"] == near["a"], "left")
        return both.select(*REP, F.least("_own", "_near").alias("known"))


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for a history beside the checkpoints, shared by all executors."""
    return f"{checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"


def decisions(raw_docs: DataFrame, folder: str, batches_per_load: int = 1, **options: object) -> DataFrame:
    """(raw_id, accepted_id or null), load after load of so many batches: each sees the ones before only through the stored history."""
    history = History(raw_docs.sparkSession, folder, **options)
    numbers = [r[0] for r in raw_docs.select("batch_no").distinct().orderBy("batch_no").collect()]  # one number per batch
    out = None
    for first in range(0, len(numbers), batches_per_load):
        taken = F.lit(False)
        for number in numbers[first : first + batches_per_load]:
            taken = taken | F.col("batch_no").eqNullSafe(number)
        found = history.add(raw_docs.where(taken))
        out = found if out is None else out.union(found)
    return history.add(raw_docs) if out is None else out


def duplicates(raw_docs: DataFrame, folder: str, batches_per_load: int = 1, **options: object) -> DataFrame:
    """(accepted_id, raw_id) of every duplicate of `raw_docs`, load after load through the history in `folder`."""
    return decisions(raw_docs, folder, batches_per_load, **options).where("accepted_id is not null").select("accepted_id", "raw_id")


def duplicates_at_once(raw_docs: DataFrame, folder: str, **options: object) -> DataFrame:
    """The same rows, with all batches decided as one load."""
    return History(raw_docs.sparkSession, folder, **options).add(raw_docs).where("accepted_id is not null").select("accepted_id", "raw_id")
