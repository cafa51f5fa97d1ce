"""Encoding of texts with a byte-level BPE vocabulary by merge replay.

Each task encodes the distinct words of its rows at once: an inverted index from rank to
the positions of the pairs that this rank merges is replayed in rank order; a merge
touches only its two neighbours. Words are independent of each other, so a task's share
of the corpus gives the same ids as the whole, and no text is ever shuffled. A bounded
memory of known words spares repeated replay within a worker.

Defined ids: null and empty texts have the empty list. Strings of special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import spread

#: The public split pattern of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words that a worker remembers, and code points of text that it handles at once.
KNOWN_WORDS, CHUNK_CHARS = 400_000, 4_000_000


def load_ranks(path: str) -> bytes:
    """The rank file as it lies there; it is a fixed vocabulary of about 1 MB."""
    with open(path, "rb") as f:
        return f.read()


class MergeReplay:
    """Ids of many words at once, for one rank file."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.of_bytes = np.full((256, 256), -1, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.of_bytes[token[0], token[1]] = rank
        self.pairs: dict[tuple[int, int], int] = {}

    def rank(self, a: int, b: int) -> int:
        r = self.pairs.get((a, b))
        if r is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            r = self.pairs[(a, b)] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        n = len(flat)
        token = self.byte_ids[flat].tolist()
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        last = np.zeros(n, bool)
        last[ends - 1] = True
        for e in ends.tolist():
            after[e - 1] = -1
            if e < n:
                ahead[e] = -1
        # the inverted index: rank -> left positions
        first = np.full(n, -1, np.int64)
        if n > 1:
            first[:-1] = self.of_bytes[flat[:-1], flat[1:]]
        first[last] = -1
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        index: dict[int, list[int]] = {}
        if len(order):
            found, starts = np.unique(first[order], return_index=True)
            index = {int(r): p.tolist() for r, p in zip(found, np.split(order, starts[1:]))}
        heap = list(index)
        heapq.heapify(heap)
        rank = self.rank
        while heap:
            now = heapq.heappop(heap)
            places = index.pop(now, None)
            if places is None:
                continue
            places.sort()
            for p in places:
                q = after[p]
                if q < 0 or token[p] < 0 or rank(token[p], token[q]) != now:
                    continue
                token[p], token[q] = now, -1
                r = after[p] = after[q]
                if r >= 0:
                    ahead[r] = p
                    new = rank(now, token[r])
                    if new >= 0:
                        if (old := index.get(new)) is None:
                            index[new] = [p]
                            heapq.heappush(heap, new)
                        else:
                            old.append(p)
                o = ahead[p]
                if o >= 0:
                    new = rank(token[o], now)
                    if new >= 0:
                        if (old := index.get(new)) is None:
                            index[new] = [o]
                            heapq.heappush(heap, new)
                        else:
                            old.append(o)
        out, start = [], 0
        for e in ends.tolist():
            out.append([t for t in token[start:e] if t >= 0])
            start = e
        return out


class Encoder:
    """Ids of whole texts; see the module for null and empty ones."""

    def __init__(self, rank_file: bytes):
        self.replay = MergeReplay(rank_file)
        self.split = regex.compile(SPLIT)
        self.known: dict[str, list[int]] = {}

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        words = [self.split.findall(t) if t else [] for t in texts]
        new = list({w for ws in words for w in ws} - self.known.keys())
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = list({w for ws in words for w in ws})
        self.known.update(zip(new, self.replay([w.encode("utf-8", "surrogatepass") for w in new])))
        known = self.known
        return [[i for w in ws for i in known[w]] for ws in words]


@lru_cache(maxsize=2)
def _encoder(rank_file: bytes) -> Encoder:
    return Encoder(rank_file)


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, lengths_only: bool = False) -> DataFrame:
    """`id_col` and `ids` (array<int>), or `n_tokens` (int) if `lengths_only`; one row per input row.

    The driver reads the rank file, so executors need no copy of it. Other columns are dropped.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            ids = []
            for part in _chunks(batch.column(1).to_pylist()):
                ids += [len(x) for x in encoder(part)] if lengths_only else [np.array(x, np.int32) for x in encoder(part)]
            if lengths_only:
                second: pa.Array = pa.array(ids, pa.int32())
            else:
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                second = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), second], [id_col, "n_tokens" if lengths_only else "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    result = "n_tokens int" if lengths_only else "ids array<int>"
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, {result}")
