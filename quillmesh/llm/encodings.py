"""Garbled text from a wrong character encoding: detection and repair by EM.

The latent variable of a record is the chain (codec it was read with, codec it was
written in), or none. Observations are its spans: blank-delimited runs with a character
outside ASCII. Undoing a chain on a span gives a candidate; the evidence is the ratio of
the likelihoods of candidate and span under a character trigram model. The prior of each
chain is held per source and field, so weak evidence of single records pools. The share
of a record's spans that are garbled is latent too, so any number of correct spans cannot
outvote a garbled sentence among them; the model is fitted at one middle share.

E-step: posterior of every chain per record. M-step: expected trigram counts of the
intended text and expected chains per source and field, until these settle. Spans are taken from whole texts,
once, and checkpointed; each pass reads them in Arrow batches, scores the distinct spans of a
worker once for all records, sums its counts per task and meets in one aggregation over a fixed number of buckets. The driver gets at most
`MODEL_BUCKETS` counts and `PRIOR_BUCKETS` x chains expectations, whatever the corpus.

A record is garbled if the posterior of "none" falls below one half. Replacement characters
and C1 controls, which no intended text holds, speak for every chain alike and for one of their own, "lost",
whose original is past restoring. Encodings whose bytes are all
ASCII (UTF-7, ISO-2022-JP) leave no span and are not found.

Defined results: null, empty, blank and pure ASCII texts are never cases and are given
back as they are. Repeated rows weigh as often as they occur. Sources differing in case,
blanks or `_` for `-` pool together; a null source is a source of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .shingles import mix

MODEL_BUCKETS, PRIOR_BUCKETS = 1 << 20, 256
#: Passes of EM end when the expected chains move by less than this share of all records, or after so many.
SETTLED, MOST_ROUNDS = 0.002, 8
#: Rounds in which only the priors are learnt.
PRIORS_FIRST = 2
#: Shares of garbled spans a garbled record may have, equally likely beforehand: which one holds is latent per record and chain.
SHARES = np.array([0.003, 0.015, 0.06, 0.25, 0.5, 0.9])
#: While the model is fitted only records garbled by about half teach it: at low shares a few correct words could turn into their garbled form round by round.
FIT_SHARES = np.array([0.5])
#: Prior weight of "none" and of all chains together, as pseudo records of each source and field.
PRIOR_CLEAN, PRIOR_CHAINS = 12.0, 0.6
#: Log odds of a span with a replacement character or C1 control under "lost" against none: no intended text holds them.
LOST_ODDS = 12.0
#: How far a span that is valid UTF-8 throughout is trusted before there is a model.
DOUBT = 0.003
#: Expected counts travel as whole numbers of this fraction, so that their sum does not depend on the order of tasks.
UNIT = 1 << 16
#: Distinct spans whose candidates a worker keeps from pass to pass, and records that it judges at once; matters of speed only.
KNOWN_SPANS, AT_ONCE = 200_000, 512
#: A candidate must be more likely than its span by this factor (in logs) to stand in the repaired text.
MARGIN = 1.0

_SPAN = re.compile(r"[^ \t\r\n\f\v]*[^\x00-\x7f][^ \t\r\n\f\v]*")
_WRECK = re.compile("[�\x80-\x84\x86-\x9f]")
#: Codecs as fixed values: (read with, written in). `western` is cp1252 with the bytes it lacks as C1 controls.
_UTF8_READ_AS = ("western", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_2", "koi8_r", "cp866", "cp1253", "cp1254", "iso8859_15", "cp852", "iso8859_5", "mac_cyrillic", "cp1257", "cp932", "gbk")
_BYTES = (
    ("western", "cp437"), ("western", "cp850"), ("western", "mac_roman"), ("western", "cp1250"), ("western", "iso8859_2"), ("western", "cp852"), ("western", "cp1251"), ("western", "koi8_r"),
    ("western", "cp866"), ("western", "iso8859_5"), ("western", "cp932"), ("western", "euc_jp"), ("western", "big5"), ("western", "gbk"), ("mac_roman", "western"), ("mac_roman", "cp437"), ("cp437", "western"), ("cp437", "mac_roman"), ("cp437", "cp866"), ("cp437", "cp932"), ("cp850", "western"), ("cp850", "cp1250"),
    ("cp1250", "western"), ("cp1250", "cp852"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("iso8859_2", "western"), ("cp852", "cp1250"), ("cp852", "western"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1251", "western"), ("cp1251", "mac_cyrillic"), ("cp1251", "iso8859_5"), ("koi8_r", "cp1251"), ("koi8_r", "cp866"),
    ("cp866", "cp1251"), ("cp866", "koi8_r"), ("mac_cyrillic", "cp1251"), ("iso8859_5", "cp1251"), ("mac_roman", "cp932"), ("cp1253", "western"), ("cp1254", "western"), ("western", "cp1254"), ("western", "cp1257"),
)
CHAINS = tuple((r, "utf_8", 1) for r in _UTF8_READ_AS) + (("western", "utf_8", 2), ("mac_roman", "utf_8", 2), ("cp1250", "utf_8", 2), ("cp1251", "utf_8", 2), ("cp437", "utf_8", 2)) + tuple((r, w, 1) for r, w in _BYTES)
NAMES = ("none", *(f"{w} read as {r}" + " twice" * (n == 2) for r, w, n in CHAINS), "lost")
LOST = len(CHAINS) + 1
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_WIDE_CODECS = ("cp932", "euc_jp", "gbk", "big5")


@lru_cache(maxsize=64)
def _table(codec: str) -> str:
    """The 256 characters of a one-byte codec; NUL where it has none."""
    if codec == "western":
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))
    return "".join(bytes([b]).decode(codec, "ignore") or "\0" for b in range(256))


@lru_cache(maxsize=64)
def _bytes_of(codec: str) -> dict[str, int]:
    known = {c: b for b, c in enumerate(_table(codec)) if c != "\0" or not b}
    if codec in ("western", "cp1250", "iso8859_2", "iso8859_15", "cp1251", "cp1253", "cp1254", "cp1257"):
        for b in range(0x80, 0xA0):  # undefined bytes often come through as C1 controls
            known.setdefault(chr(b), b)
    return known


_RUN = re.compile(r"[^\x00-\x7f]+")


def undo(span: str, chain: tuple[str, str, int]) -> str:
    """The span with the chain undone wherever its characters have bytes that make sense."""
    read, written, times = chain
    for _ in range(times):
        if read in _WIDE_CODECS:
            done = _RUN.sub(lambda m: _wide(m.group(), read), span)
        elif written == "utf_8":
            done = _utf8(span, _bytes_of(read))
        elif written in _WIDE_CODECS:
            done = _to_wide(span, _bytes_of(read), written)
        else:
            back, table = _bytes_of(read), _table(written)
            done = _RUN.sub(lambda m: _bytewise(m.group(), back, table), span)
        if done == span:
            return span if times == 1 or _ == 0 else done
        span, previous = done, span
    return span


def _bytewise(run: str, back: dict[str, int], table: str) -> str:
    out = []
    for c in run:
        b = back.get(c)
        if b is None or (new := table[b]) == "\0":
            return run
        out.append(new)
    return "".join(out)


def _utf8(span: str, back: dict[str, int]) -> str:
    """Every valid multi-byte sequence among the characters' bytes becomes its character."""
    get = back.get
    raw = bytes([0 if (b := get(c)) is None else b for c in span])
    if not _SEQUENCE.search(raw):
        return span
    out, at = [], 0
    for m in _SEQUENCE.finditer(raw):
        out.append(span[at : m.start()])
        out.append(m.group().decode())
        at = m.end()
    out.append(span[at:])
    return "".join(out)


def _all_utf8(span: str, read: str) -> bool:
    """Whether the bytes of the whole span are valid UTF-8."""
    if read in _WIDE_CODECS:
        return all(_wide(run, read) != run for run in _RUN.findall(span))
    back = _bytes_of(read)
    raw = [back.get(c) for c in span]
    try:
        return None not in raw and bool(bytes(raw).decode("utf_8"))
    except UnicodeError:
        return False


def _wide(run: str, read: str) -> str:
    try:
        return run.encode(read).decode("utf_8")
    except (UnicodeError, ValueError):
        return run


def _to_wide(span: str, back: dict[str, int], written: str) -> str:
    """Whole-span decoding, as second bytes may lie in ASCII; only for spans full of high bytes."""
    raw = bytearray()
    for c in span:
        b = ord(c) if c < "\x80" else back.get(c)
        if b is None:
            return span
        raw.append(b)
    if sum(b >= 0x80 for b in raw) * 2 < len(raw):
        return span
    try:
        new = bytes(raw).decode(written)
    except UnicodeError:
        return span
    return new if sum(c >= "　" for c in new) * 2 >= len(new) else span


#: Chains by what a span must have for them to change it: two characters outside ASCII in a row, half of its characters outside ASCII, or nothing.
_PAIRED = frozenset(i for i, (r, w, _) in enumerate(CHAINS, 1) if w == "utf_8" and r not in _WIDE_CODECS)
_DENSE = frozenset(i for i, (r, w, _) in enumerate(CHAINS, 1) if w in _WIDE_CODECS and r not in _WIDE_CODECS)
_TWO = re.compile(r"[^\x00-\x7f]{2}")


def candidates(span: str) -> tuple[tuple[int, str], ...]:
    """(number of the chain, candidate) of every chain that changes the span; equal candidates keep their first chain."""
    seen, out = {span}, []
    foreign = "".join(_RUN.findall(span))
    paired, dense = _TWO.search(span) is not None, 2 * len(foreign) >= len(span)
    unknown: set[str] = set()  # readers that lack every character
    for i, chain in enumerate(CHAINS, 1):
        if (i in _PAIRED and not paired) or (i in _DENSE and not dense) or chain[0] in unknown:
            continue
        new = undo(span, chain)
        if new not in seen:
            seen.add(new)
            out.append((i, new))
        elif new == span and chain[0] not in _WIDE_CODECS and not any(c in _bytes_of(chain[0]) for c in foreign):
            unknown.add(chain[0])
    return tuple(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    return (mix(x) & np.uint64(MODEL_BUCKETS - 1)).astype(np.int32)


def slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (trigram, its context, bigram, its context) at each character near one outside ASCII, and how many rows each text has.

    Digits count alike; two starts stand before a text and an end behind it.
    """
    codes = np.frombuffer("".join(f"\2\2{t}\3" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.where((codes >= 48) & (codes <= 57), np.uint64(48), codes)
    sizes = np.array([len(t) + 3 for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)[2:]
    x, y, z = codes[:-2], codes[1:-1], codes[2:]
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(codes), bool)
    inside[starts] = inside[starts + 1] = False
    keep = inside[2:] & ((x > 127) | (y > 127) | (z > 127))
    x, y, z, of = x[keep], y[keep], z[keep], of[keep]
    pair = x * np.uint64(1_000_003) + y
    rows = np.stack([_mixed(pair * np.uint64(1_000_033) + z + np.uint64(1 << 40)), _mixed(pair + np.uint64(1 << 50)), _mixed(y * np.uint64(7_000_003) + z + np.uint64(1 << 52)), _mixed(y + np.uint64(1 << 54))], axis=1)
    return rows, np.bincount(of, minlength=len(texts))


class Spans:
    """Distinct spans of a worker with their candidates and bucket numbers in flat arrays."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.own, self.first, self.wreck, self.doubted = (np.zeros(0, np.int64) for _ in range(4))
        self.first = np.zeros(1, np.int64)
        self.chain, self.text_of, self.bare = (np.zeros(0, np.int64) for _ in range(3))  # `bare` candidates have no text of their own
        self.texts: list[str] = []
        self.rows, self.ends = np.zeros((0, 4), np.int32), np.zeros(1, np.int64)

    def number(self, found: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(record, span) numbers of every span of `found`; only distinct ones become Python texts."""
        flat = found.flatten().dictionary_encode()
        at, distinct = self.at, flat.dictionary.to_pylist()
        if new := [s for s in distinct if s not in at]:
            self._add(new)
        numbers = np.array([at[s] for s in distinct], np.int64)
        return np.repeat(np.arange(len(found)), found.value_lengths().to_numpy()), numbers[flat.indices.to_numpy()]

    def _add(self, new: list[str]) -> None:
        texts, own, chain, text_of, bare, count, wreck, doubted = [], [], [], [], [], [], [], []
        base = len(self.texts)
        for s in new:
            self.at[s] = len(self.at)
            own.append(base + len(texts))
            texts.append(s)
            lost = _WRECK.search(s) is not None
            changed = candidates(s)
            for i, t in changed:
                chain.append(i)
                text_of.append(base + len(texts))
                texts.append(t)
            of = {i for i, _ in changed}
            more = [i for i in range(1, LOST + 1) if lost and i not in of]  # what is lost speaks for every chain
            chain += more
            text_of += [own[-1]] * len(more)
            bare += [False] * len(changed) + [True] * len(more)
            count.append(len(changed) + len(more))
            wreck.append(lost)
            doubted.append(any(CHAINS[i - 1][1] == "utf_8" and _all_utf8(s, CHAINS[i - 1][0]) for i, _ in changed))
        rows, sizes = slots(texts)
        self.texts += texts
        self.rows, self.ends = np.concatenate([self.rows, rows]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        join = lambda old, more: np.concatenate([old, np.array(more, np.int64)])
        self.own, self.chain, self.text_of, self.bare = join(self.own, own), join(self.chain, chain), join(self.text_of, text_of), join(self.bare, bare)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.array(count, np.int64))])
        self.wreck, self.doubted = join(self.wreck, wreck), join(self.doubted, doubted)

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """Expected counts by bucket for expected numbers of texts."""
        each = np.repeat(weights, np.diff(self.ends))
        return sum(np.bincount(self.rows[:, k], each, MODEL_BUCKETS) for k in range(4)) if len(self.rows) else np.zeros(MODEL_BUCKETS)


_KEPT: list[Spans] = []


def _spans_kept() -> Spans:
    """The spans of this worker, begun anew when they have grown too many."""
    if not _KEPT or len(_KEPT[0].at) > KNOWN_SPANS:
        _KEPT[:] = [Spans()]
    return _KEPT[0]


class Judge:
    """Posterior of the chains of records under a model of trigrams by expected counts in hashed buckets."""

    def __init__(self, counts: np.ndarray, prior: np.ndarray, shares: np.ndarray = SHARES):
        self.n, self.prior, self.shares = counts, np.log(prior), shares
        self.spans = _spans_kept()
        self.logs, self.ratio, self.terms = np.zeros(0), np.zeros(0), np.zeros((0, len(shares)))

    def _score(self) -> None:
        """Log likelihood of texts, and log ratio and evidence of candidates, that came since."""
        s, done = self.spans, len(self.logs)
        if done < len(s.texts):
            rows = s.rows[s.ends[done] : s.ends[-1]]
            n = self.n.astype(float)
            low = (n[rows[:, 2]] + 2e-3) / (n[rows[:, 3]] + 200.0)
            each = np.concatenate([[0.0], np.cumsum(np.log((n[rows[:, 0]] + 4.0 * low) / (n[rows[:, 1]] + 4.0)))])
            ends = s.ends[done:] - s.ends[done]
            self.logs = np.concatenate([self.logs, each[ends[1:]] - each[ends[:-1]]])
        have = len(self.ratio)
        if have < len(s.chain):
            of = np.repeat(np.arange(len(s.own)), np.diff(s.first))[have:]
            ratio = np.minimum(self.logs[s.text_of[have:]] - self.logs[s.own[of]], 60.0)
            ratio = np.where(s.wreck[of] > 0, np.maximum(ratio, LOST_ODDS), ratio)
            self.ratio = np.concatenate([self.ratio, ratio])
            self.terms = np.concatenate([self.terms, np.log(1 - self.shares + np.exp(ratio)[:, None] * self.shares)])

    def posterior(self, found: pa.ListArray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Per record and chain the probability and the log odds that a span is garbled; and (record, span) of every span with (span at, candidate) of every candidate."""
        n, s = len(NAMES), self.spans
        record, span = s.number(found)
        self._score()
        many = s.first[span + 1] - s.first[span]
        at = np.repeat(np.arange(len(span)), many)
        candidate = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + s.first[span][at]
        cell = record[at] * n + s.chain[candidate]
        score = np.stack([np.bincount(cell, self.terms[candidate, k], len(found) * n) for k in range(len(self.shares))], axis=1).reshape(len(found), n, -1)
        top = score.max(axis=2)
        by_share = np.exp(score - top[:, :, None])
        whole = top + np.log(by_share.mean(axis=2))
        logs = np.where(whole > 0, whole + self.prior[sources], -np.inf)
        logs[:, 0] = self.prior[sources, 0]
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        share = by_share @ self.shares / by_share.sum(axis=2)
        return p / p.sum(axis=1, keepdims=True), np.log(share / (1 - share)), (record, span, at, candidate)


def _source_bucket(field: str):  # noqa: ANN202
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(F.col("source"), F.lit("\u0000none")))), "_", "-")
    return F.pmod(F.xxhash64(F.lit(field), name), F.lit(PRIOR_BUCKETS)).cast("int")


def spans_of(records: DataFrame, id_col: str, text_col: str, field: str) -> DataFrame:
    """(id, bucket, spans) of the records that hold a character outside ASCII."""
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_SPAN.findall(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], [id_col, "bucket", "spans"])

    wanted = spread(records).where(F.col(text_col).rlike(r"[^\x00-\x7f]"))
    return wanted.select(id_col, _source_bucket(field).alias("bucket"), text_col).mapInArrow(run, f"`{id_col}` {kind}, bucket int, spans array<string>")


def _expect(spans: DataFrame, judge: tuple[np.ndarray, np.ndarray] | None, shares: np.ndarray = FIT_SHARES) -> tuple[np.ndarray, np.ndarray]:
    """One pass: expected counts of the model and expected chains per source and field."""
    shared = spans.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _spans_kept()
        by = None if shared.value is None else Judge(*shared.value, shares)
        texts = np.zeros(0)
        chains = np.zeros((PRIOR_BUCKETS, len(NAMES)))
        for batch in batches:
            sources, everything = batch.column(0).to_numpy(), batch.column(1)
            for start in range(0, len(everything), AT_ONCE):
                found = everything.slice(start, AT_ONCE)
                if by is None:
                    _, span = known.number(found)
                    texts = np.pad(texts, (0, len(known.texts) - len(texts)))
                    texts += np.bincount(known.own[span], np.where(known.wreck[span] > 0, 0.0, np.where(known.doubted[span] > 0, DOUBT, 1.0)), len(texts))
                    continue
                source = sources[start : start + AT_ONCE]
                p, odds, (record, span, at, candidate) = by.posterior(found, source)
                np.add.at(chains, source, p)
                texts = np.pad(texts, (0, len(known.texts) - len(texts)))
                chain = known.chain[candidate]
                share = p[record[at], chain]
                share = np.where(share > 1e-3, share / (1 + np.exp(-np.clip(by.ratio[candidate] + odds[record[at], chain], -60, 60))), 0.0)
                rest = np.maximum(1 - np.bincount(at, share, len(span)), 0.0) * (known.wreck[span] == 0)
                real = known.bare[candidate] == 0
                texts += np.bincount(known.text_of[candidate[real]], share[real], len(texts)) + np.bincount(known.own[span], rest, len(texts))
        counts = known.counts(np.pad(texts, (0, len(known.texts) - len(texts))))
        whole = np.rint(np.concatenate([counts, chains.ravel()]) * UNIT).astype(np.int64)
        where = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(whole[where], pa.int64())], ["slot", "weight"])

    sums = spans.select("bucket", "spans").mapInArrow(run, "slot long, weight long").groupBy("slot").agg(F.sum("weight").alias("weight")).toPandas()
    both = np.zeros(MODEL_BUCKETS + PRIOR_BUCKETS * len(NAMES))
    both[sums["slot"].to_numpy(np.int64)] = sums["weight"].to_numpy(float) / UNIT
    shared.unpersist()
    return both[:MODEL_BUCKETS].astype(np.float32), both[MODEL_BUCKETS:].reshape(PRIOR_BUCKETS, len(NAMES))


def _prior(expected: np.ndarray | None) -> np.ndarray:
    """Chains per source and field, smoothed by those of all sources together."""
    base = np.full(len(NAMES), PRIOR_CHAINS / len(CHAINS))
    base[0] = PRIOR_CLEAN
    if expected is None:
        return np.tile(base / base.sum(), (PRIOR_BUCKETS, 1))
    overall = expected.sum(axis=0) + base
    overall = overall / overall.sum()
    smoothed = expected + overall * (PRIOR_CLEAN + PRIOR_CHAINS)
    return smoothed / smoothed.sum(axis=1, keepdims=True)


def fit(spans: DataFrame, most_rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Model counts and priors of EM over all spans, when the expected chains have settled.

    The first rounds learn the priors alone: before these are known, doubtful spans would
    count as correct and teach the model their garbled form.
    """
    counts, _ = _expect(spans, None)
    prior, last = _prior(None), None
    for number in range(most_rounds):
        learnt, expected = _expect(spans, (counts, prior))
        counts = learnt if number >= PRIORS_FIRST else counts
        prior = _prior(expected)
        now = expected.sum(axis=0)
        if number > PRIORS_FIRST and np.abs(now - last).sum() <= SETTLED * max(now.sum(), 1.0):
            break
        last = now
    # records are judged with every share, so their priors are learnt with every share at last
    return counts, _prior(_expect(spans, (counts, prior), SHARES)[1])


def _best(p: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The likeliest chain that can be undone, or "lost" where no span speaks for it more than for that."""
    every = np.arange(len(p))
    real = p[:, 1:LOST].argmax(axis=1) + 1
    return np.where(p[every, real] * prior[:, LOST] > p[:, LOST] * prior[every, real] * (1 + 1e-9), real, LOST)


def judge_records(spans: DataFrame, fitted: tuple[np.ndarray, np.ndarray], id_col: str) -> DataFrame:
    """(id, bucket, chain, posterior) of the records that were read in a wrong encoding."""
    shared = spans.sparkSession.sparkContext.broadcast(fitted)
    kind = spans.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for batch in batches:
            sources, everything = batch.column(1).to_numpy(), batch.column(2)
            where, chain, garbled = [], [], []
            for start in range(0, len(everything), AT_ONCE):
                p, _, _ = judge.posterior(everything.slice(start, AT_ONCE), sources[start : start + AT_ONCE])
                bad = np.flatnonzero(p[:, 0] < 0.5)
                where += (bad + start).tolist()
                chain += [NAMES[i] for i in _best(p[bad], shared.value[1][sources[start : start + AT_ONCE][bad]])]
                garbled += (1 - p[bad, 0]).tolist()
            taken = pa.array(where, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(chain, pa.string()), pa.array(garbled, pa.float64())], [id_col, "bucket", "chain", "posterior"])

    return spans.select(id_col, "bucket", "spans").mapInArrow(run, f"`{id_col}` {kind}, bucket int, chain string, posterior double")


def garbled(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: str = "text") -> DataFrame:
    """(id, bucket, chain, posterior) of every garbled record of `records` (id, text, source); `bucket` is its source's."""
    spans = cut(spans_of(records, id_col, text_col, field))
    return judge_records(spans, fit(spans), id_col)


def repaired(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: str = "text") -> DataFrame:
    """(id, chain, posterior, restored, whole): the restored text, and whether nothing garbled is left in it."""
    spans = cut(spans_of(records, id_col, text_col, field))
    fitted = fit(spans)
    cases = judge_records(spans, fitted, id_col)
    shared = spans.sparkSession.sparkContext.broadcast(fitted)
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        number = {n: i for i, n in enumerate(NAMES)}
        for batch in batches:
            restored, whole = [], []
            chains, texts, sources = batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(1).to_numpy()
            for start in range(0, len(texts), AT_ONCE):
                part = texts[start : start + AT_ONCE]
                _, odds, (record, span, at, candidate) = judge.posterior(pa.array([_SPAN.findall(t) for t in part], pa.list_(pa.string())), sources[start : start + AT_ONCE])
                best = np.array([number[c] for c in chains[start : start + AT_ONCE]])
                least = np.maximum(MARGIN, -odds[np.arange(len(part)), best])
                chosen = (judge.spans.chain[candidate] == best[record[at]]) & (judge.ratio[candidate] > least[record[at]]) & (judge.spans.bare[candidate] == 0)
                new: dict[int, str] = {int(a): judge.spans.texts[judge.spans.text_of[c]] for a, c in zip(at[chosen], candidate[chosen])}
                place = iter(range(len(span)))
                for t in part:
                    restored.append(_SPAN.sub(lambda m: new.get(next(place), m.group()), t))
                    whole.append(not _WRECK.search(restored[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(restored, pa.string()), pa.array(whole, pa.bool_())], [id_col, "chain", "posterior", "restored", "whole"])

    joined = cases.join(records.select(id_col, text_col), id_col).select(id_col, "bucket", "chain", "posterior", text_col)
    return joined.mapInArrow(run, f"`{id_col}` {kind}, chain string, posterior double, restored string, whole boolean")
