"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue, and decoding.

A pre-token is a linked list of byte pieces. Every neighbouring pair that the vocabulary knows waits
in a bucket of its merge rank; a two-level bitmap over the buckets gives the lowest occupied rank
by find-first-set. A pair taken from the queue is merged if it still stands there with that rank;
stale entries are skipped. Each merge costs a few word operations, however long the pre-token is, so
a pre-token of n bytes takes O(n log n) (the logarithm from the order of positions in a bucket).

All pre-tokens of a batch that are not known yet go through one queue, as one list with breaks between them. A bucket is
taken whole: while buckets are large, its pairs are merged by array operations, later one by one. Where a merge may bring up
a pair of lower rank, only the first pair of each pre-token is taken at a time, so that the order within a pre-token
is the same as if it had a queue of its own. Pre-tokens seen are numbered, and their ids remembered, a bounded number of
them; results don't depend on it.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes;
repeated rows are encoded one by one; lone surrogates become U+FFFD, as the library does it. Other
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stationflow.llm.batches import in_small_batches
from stationflow.llm.cutting import well_formed

BLOCK = 1 << 18  # ids decoded at a time
SHIFT = 32  # a pair of ids as one number
LARGE = 24  # positions of a bucket from which arrays are quicker than one by one
SMALL_ONES = 200
KNOWN_WORDS = 400_000  # pre-tokens remembered before all are forgotten; some 200 bytes each
GROUP = 8 << 20  # characters whose unknown pre-tokens are merged together


class RankQueue:
    """Positions by merge rank; gives the lowest rank and, within it, the leftmost position first.

    A word of the lower bitmap covers 256 ranks; the upper bitmap has a bit per word. Who keeps the buckets
    himself uses the bitmaps alone: ``mark``, ``lowest`` and ``drop``.
    """

    def __init__(self, ranks: int):
        words = (ranks >> 8) + 1
        self.buckets: dict[int, list[int]] = {}
        self.bit = [1 << i for i in range(max(words, 256))]
        self.words = [0] * words
        self.top = 0  # words that are not zero

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.mark(rank)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        rank = self.lowest()
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.drop(rank)
        return rank, bucket[0]

    def mark(self, rank: int) -> None:
        word = rank >> 8
        if not self.words[word]:
            self.top |= self.bit[word]
        self.words[word] |= self.bit[rank & 255]

    def lowest(self) -> int:
        """Find-first-set in the upper, then in the lower bitmap."""
        top = self.top
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        return (word << 8) + (bits & -bits).bit_length() - 1

    def drop(self, rank: int) -> None:
        word = rank >> 8
        self.words[word] &= ~self.bit[rank & 255]
        if not self.words[word]:
            self.top &= ~self.bit[word]


def _distinct(parts: list) -> np.ndarray:
    """All positions, in order, each once."""
    if len(parts) == 1:
        return np.asarray(parts[0])  # pushed in order, each once
    at = np.sort(np.concatenate(parts))
    return at[np.r_[True, at[1:] != at[:-1]]]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions of the stretches that begin at ``starts``, one stretch after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class _Numbers(dict):
    """A number for every key, in the order in which keys are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class ByteBpe:
    """Encodes pre-tokens by ranks of byte strings (rank = id), and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self._forget()  # numbers of the pre-tokens seen, and where their ids stand in one long row
        pieces = sorted((i, b) for b, i in ranks.items())
        self.flat = np.frombuffer(b"".join(b for _, b in pieces), np.uint8)
        self.size = np.zeros(pieces[-1][0] + 1, np.int64)
        self.size[[i for i, _ in pieces]] = [len(b) for _, b in pieces]
        self.start = np.cumsum(self.size) - self.size
        self.queue = RankQueue(len(self.size))
        self.of_byte = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        # every way to put a piece together from two others: what a pair of neighbours merges to
        self.pairs: dict[int, int] = {}
        risky = set()  # pieces that can take part in a merge of lower rank than their own
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    self.pairs[left << SHIFT | right] = rank
                    risky.update(r for r in (left, right) if r > rank)
        self.risky = risky
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of neighbouring pieces, -1 where the vocabulary has no such pair."""
        keys = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1) if len(self.pair_keys) else np.full(len(keys), -1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self.merge_all([piece])[0].tolist()

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens, one after the other, and how many each has."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        counts = np.array([len(p) > 0 for p in pieces], np.int64)
        left = np.flatnonzero((whole < 0) & (counts > 0))
        rest = [pieces[k] for k in left.tolist()]
        if rest:
            made, counts[left] = self._merged(rest)
        ids, starts = np.zeros(int(counts.sum()), "<u4"), np.cumsum(counts) - counts
        ids[starts[whole >= 0]] = whole[whole >= 0]
        if rest:
            ids[_ranges(starts[left], counts[left])] = made
        return ids, counts

    def _merged(self, rest: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in rest])
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        symbol = self.of_byte[np.frombuffer(b"".join(rest), np.uint8)]
        owner = np.repeat(np.arange(len(rest)), lengths)
        # the part that starts at i ends where the next one starts; a break stands before each pre-token
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        waiting = np.full(n, -1)  # rank with which the pair that starts here waits
        joined = np.flatnonzero(owner[1:] == owner[:-1])
        waiting[joined] = self._ranks_of(symbol[joined], symbol[joined + 1])
        buckets: dict[int, list] = {}
        queue = self.queue
        self._push(buckets, joined, waiting[joined])
        owner_of = np.append(owner, -1)  # nothing beyond the end
        small = 0
        while queue.top:  # by arrays, until buckets stay small
            rank = queue.lowest()
            held = buckets[rank]
            small = small + 1 if sum(map(len, held)) < LARGE else max(0, small - 8)
            if small > SMALL_ONES:
                break
            queue.drop(rank)
            del buckets[rank]
            at = _distinct(held)
            at = at[waiting[at] == rank]
            if not len(at):
                continue
            if rank in self.risky:
                first = np.unique(owner[at], return_index=True)[1]
                if len(first) < len(at):
                    self._push(buckets, np.delete(at, first), np.full(len(at) - len(first), rank))
                    at = at[first]
            at = self._apart(at, after)
            right = after[at]
            end = after[right]
            symbol[at], after[at], waiting[right] = rank, end, -1
            inner = end < n
            before[end[inner]] = at[inner]
            ahead = owner_of[end] == owner[at]
            waiting[at] = -1
            waiting[at[ahead]] = self._ranks_of(symbol[at[ahead]], symbol[end[ahead]])
            left = before[at]
            behind = (left >= 0) & (owner_of[left] == owner[at])
            back = left[behind]
            waiting[back] = self._ranks_of(symbol[back], symbol[at[behind]])
            touched = _distinct([at, back])
            self._push(buckets, touched, waiting[touched])
        if queue.top:
            symbol, after = self._one_by_one(symbol, after, before, waiting, owner_of, buckets, n)
        alive = np.zeros(n, bool)
        starts = ends - lengths
        # what is still a part: every place that some part ends at, and the starts of pre-tokens
        alive[starts] = True
        reached = starts
        while len(reached):
            reached = after[reached]
            reached = reached[reached < n]
            reached = reached[~alive[reached]]
            alive[reached] = True
        return symbol[alive].astype("<u4"), np.add.reduceat(alive, starts, dtype=np.int64)

    def _push(self, buckets: dict[int, list], at: np.ndarray, ranks: np.ndarray) -> None:
        """Positions into the buckets of their ranks; those of rank -1 don't wait."""
        kept = ranks >= 0
        at, ranks = at[kept], ranks[kept]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        firsts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else []
        for rank, part in zip(ranks[firsts].tolist(), np.split(at, firsts[1:])) if len(ranks) else ():
            held = buckets.get(rank)
            if held is None:
                buckets[rank] = [part]
                self.queue.mark(rank)
            else:
                held.append(part)

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of pairs that overlap, each one's right part being the left of the next, every second, from the left."""
        if len(at) < 2:
            return at
        follows = np.r_[False, after[at[:-1]] == at[1:]]
        place = np.arange(len(at))
        since = place - np.maximum.accumulate(np.where(follows, 0, place))
        return at[since % 2 == 0]

    def _one_by_one(self, symbol, after, before, waiting, owner, buckets, n):
        """The rest of the queue, whose buckets are small."""
        symbol, after, before, waiting, owner = (v.tolist() for v in (symbol, after, before, waiting, owner))
        get, queue, risky = self.pairs.get, self.queue, self.risky
        while queue.top:
            rank = queue.lowest()
            held = [int(i) for part in buckets.pop(rank) for i in part]
            queue.drop(rank)
            held.sort()
            kept, done = [], set()
            for i in held:
                if waiting[i] != rank:
                    continue  # stale: one of the two parts has changed since
                if rank in risky:
                    if owner[i] in done:
                        kept.append(i)
                        continue
                    done.add(owner[i])
                right = after[i]
                after[i] = end = after[right]
                waiting[right] = waiting[i] = -1
                symbol[i] = rank
                if end < n:
                    before[end] = i
                    if owner[end] == owner[i]:
                        new = get(rank << SHIFT | symbol[end])
                        if new is not None:
                            waiting[i] = new
                            self._wait(buckets, new, i)
                left = before[i]
                if left >= 0 and owner[left] == owner[i]:
                    new = get(symbol[left] << SHIFT | rank)
                    waiting[left] = -1 if new is None else new
                    if new is not None:
                        self._wait(buckets, new, left)
            for i in kept:
                self._wait(buckets, rank, i)
        return np.array(symbol), np.array(after)

    def _wait(self, buckets: dict[int, list], rank: int, position: int) -> None:
        held = buckets.get(rank)
        if held is None:
            buckets[rank] = [[position]]
            self.queue.mark(rank)
        else:
            held.append([position])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts, as little-endian unsigned 32-bit integers."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        before, number = len(self.known), self.known.__getitem__
        cut = []
        for text in texts:
            words = self.find(well_formed(text)) if text else ()
            cut.append(np.fromiter(map(number, words), np.int32, len(words)))
        new = [w.encode() for w in islice(self.known, before, None)]
        if new:
            ids, counts = self.merge_all(new)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.ids = np.concatenate([self.ids, ids])
        return [self.ids[_ranges(self.first[own], self.count[own])].tobytes() for own in cut]

    def _forget(self) -> None:
        self.known = _Numbers()
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids: each id's stretch of one long row of all pieces."""
        ids, out = np.frombuffer(packed, "<u4"), []
        for first in range(0, len(ids), BLOCK):
            block = ids[first:first + BLOCK]
            size = self.size[block]
            shift = np.repeat(self.start[block] - (np.cumsum(size) - size), size)
            out.append(self.flat[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file (a line each: base64 of the bytes, rank), once per process."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, file))}
    return ByteBpe(ranks, pattern)


def _in_groups(batches: Iterator[pd.Series]) -> Iterator[list[pd.Series]]:
    """Several batches at a time, of GROUP characters together: the larger the group, the larger the buckets."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(len(t) for t in batch if t)
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(text: Column, path: str, pattern: str) -> Column:
    """struct<ids, decoded>: the ids of each text as little-endian unsigned 32-bit integers, and the bytes they stand for."""

    @pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(path, pattern)
        for group in _in_groups(batches):
            ids = iter(bpe.encode_all([t for batch in group for t in batch]))
            for batch in group:
                own = list(islice(ids, len(batch)))
                yield pd.DataFrame({"ids": pd.Series(own, dtype=object),
                                    "decoded": pd.Series([bpe.decode(i) for i in own], dtype=object)})

    return both(text)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Binary column: the ids of each text as little-endian unsigned 32-bit integers."""

    @pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path, pattern)
        for batch in batches:
            yield pd.Series(bpe.encode_all(list(batch)), dtype=object)

    return ids(text)


def decode(packed: Column, path: str, pattern: str) -> Column:
    """Binary column: the bytes that the ids stand for."""

    @pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        bpe = load(path, pattern)
        return pd.Series([bpe.decode(i) if i else b"" for i in ids], dtype=object)

    return decoded(packed)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with packed ids in ``ids`` and the bytes they decode to in ``decoded``."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded")]
    return docs.select(*kept, encoded(F.col("text"), path, pattern).alias("__both")).select(*kept, "__both.ids", "__both.decoded")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per document."""
    rows = encode_documents(in_small_batches(docs.select("doc_id", "text")), path, pattern)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
