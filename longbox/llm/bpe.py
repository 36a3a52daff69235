"""Byte-level BPE encoding and decoding of issue descriptions.

Two tiers give the ids of a pre-token. A minimal perfect hash over the
vocabulary answers for pre-tokens that are whole tokens, one probe each and
vectorised over the new pre-tokens of a text. All others are merged from
their bytes: neighbouring parts are linked, and a heap gives the pair of lowest
rank next; short pre-tokens have a row each in one array of heaps, which numpy
pops and pushes together. Pre-tokens met before come from a bounded memo.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longbox.llm.memo import Memo, portions

# Bits for the start of a part in an entry of a heap, and for an id in a pair.
START, PART = 40, 32
NONE = np.iinfo(np.int64).max
# Pre-tokens of up to so many bytes are merged so many together.
SHORT, TOGETHER = 64, 4096
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(pair[0]): int(pair[1]) for pair in pairs if pair}


def _hashes(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words, categorize=False)


class PerfectHash:
    """Minimal perfect hash of strings: n keys on n slots, one probe a lookup.

    Keys fall into small buckets; the largest bucket first, each gets the first
    displacement that sends its keys to free slots. Buckets of one key name
    their slot directly, as the negative number -1 - slot.
    """

    BUCKET = 4
    TRIES = 256

    def __init__(self, keys: list[str], values: list[int]):
        n = len(keys)
        words = np.array(keys, dtype=object)
        self.displacement = np.zeros(n // self.BUCKET + 1, np.int64)
        self.keys, self.values = np.empty(n, object), np.full(n, -1, np.int64)
        if not n:
            return
        hashes = _hashes(words)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys have the same 64-bit hash")
        home = self._home(hashes)
        order = np.argsort(home, kind="stable")
        buckets = np.split(order, np.flatnonzero(np.diff(home[order])) + 1)
        free, slots = np.ones(n, bool), np.empty(n, np.int64)
        buckets.sort(key=len, reverse=True)
        for members in buckets:
            if len(members) == 1:
                break
            first = 1
            while True:
                tries = np.arange(first, first + self.TRIES)
                at = self._slots(hashes[members][None, :], tries[:, None], n)
                ranked = np.sort(at, axis=1)
                good = free[at].all(axis=1) & (np.diff(ranked, axis=1) > 0).all(axis=1)
                if good.any():
                    break
                first += self.TRIES
            chosen = at[good.argmax()]
            free[chosen], slots[members] = False, chosen
            self.displacement[home[members[0]]] = tries[good.argmax()]
        left = iter(np.flatnonzero(free))
        for members in buckets:
            if len(members) == 1:
                slots[members[0]] = next(left)
                self.displacement[home[members[0]]] = -1 - slots[members[0]]
        self.keys[slots], self.values[slots] = words, np.array(values)

    def _home(self, hashes):
        return ((hashes >> _HALF) % np.uint64(len(self.displacement))).astype(np.int64)

    @staticmethod
    def _slots(hashes, displacement, n):
        mixed = (hashes ^ (displacement.astype(np.uint64) * _STEP)) * _MIX
        return ((mixed ^ (mixed >> _HALF)) % np.uint64(n)).astype(np.int64)

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Value of each word, -1 for words that are no key."""
        if not len(self.keys) or not len(words):
            return np.full(len(words), -1, np.int64)
        hashes = _hashes(words)
        moved = self.displacement[self._home(hashes)]
        at = np.where(moved < 0, -1 - moved, self._slots(hashes, moved, len(self.keys)))
        return np.where(self.keys[at] == words, self.values[at], -1)


class PairRanks:
    """Rank of each pair of tokens that joined are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [
            (left << PART | right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        # The last entry is no pair, so that every search ends at one.
        self.keys = np.append(pairs[:, 0], NONE)
        self.ranks = np.append(pairs[:, 1], NONE)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair or ``NONE``; an id of -1 is no token."""
        keys = np.where((left >= 0) & (right >= 0), left << PART | right, NONE)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)


class Heaps:
    """Heaps of integers, one a row, popped and pushed in many rows at a time."""

    def __init__(self, rows: np.ndarray, capacity: int):
        """``rows`` hold the first entries, ``NONE`` for none."""
        n, width = rows.shape
        self.size = (rows < NONE).sum(axis=1)
        # Node k has children 2k and 2k + 1; a sorted row is a heap.
        self.stride = 2 * capacity + 2
        nodes = np.full((n, self.stride), NONE)
        nodes[:, 1 : width + 1] = np.sort(rows, axis=1)
        self.nodes = nodes.ravel()

    def pop(self, rows: np.ndarray) -> np.ndarray:
        """The least entry of each of ``rows``, none of which is empty."""
        nodes, base = self.nodes, rows * self.stride
        top, end = nodes[base + 1], base + self.size[rows]
        moving = nodes[end]
        nodes[end] = NONE
        self.size[rows] -= 1
        filled = self.size[rows] > 0
        base, moving = base[filled], moving[filled]
        place = np.ones(len(base), np.int64)
        while len(base):
            child = 2 * place
            left, right = nodes[base + child], nodes[base + child + 1]
            child += right < left
            least = np.minimum(left, right)
            down = least < moving
            nodes[base + place] = np.where(down, least, moving)
            base, place, moving = base[down], child[down], moving[down]
        return top

    def push(self, rows: np.ndarray, entries: np.ndarray):
        self.size[rows] += 1
        nodes, base, place = self.nodes, rows * self.stride, self.size[rows]
        while len(base):
            parent = place >> 1
            above = np.where(parent > 0, nodes[base + parent], -1)
            up = above > entries
            nodes[base + place] = np.where(up, above, entries)
            base, place, entries = base[up], parent[up], entries[up]


class Merger:
    """Merges of pre-tokens from their bytes; ``ranks`` are ids as well."""

    def __init__(self, ranks: dict[bytes, int], pairs: PairRanks):
        self.ranks, self.pairs = ranks, pairs
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def merge_one(self, piece: bytes) -> bytes:
        """Packed ids of ``piece``: the pair of lowest rank, leftmost first, until none is left."""
        n = len(piece)
        # after[i]: start of the part that follows the part at i; rank_at[i]: rank of both.
        after, before = list(range(1, n + 2)), list(range(-1, n))
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        firsts = self.pairs.find(ids[:-1], ids[1:])
        rank_at, ids = [*firsts.tolist(), NONE], ids.tolist()
        heap = [(rank << START) | i for i, rank in enumerate(rank_at) if rank < NONE]
        heapq.heapify(heap)

        def put(start: int, stop: int):
            rank_at[start] = rank = self.ranks.get(piece[start:stop], NONE)
            if rank < NONE:
                heapq.heappush(heap, (rank << START) | start)

        merged = set()
        while heap:
            top = heapq.heappop(heap)
            start, rank = top & (1 << START) - 1, top >> START
            if rank_at[start] != rank:
                continue  # one of the two parts has changed meanwhile
            middle = after[start]
            stop = after[middle]
            ids[start], after[start], rank_at[middle], rank_at[start] = rank, stop, NONE, NONE
            merged.add(middle)
            if stop < n:
                before[stop] = start
                put(start, after[stop])
            if start:
                put(before[start], stop)
        return np.array([x for i, x in enumerate(ids) if i not in merged], "<i4").tobytes()

    def merge_many(self, words: list[bytes], width: int) -> list[bytes]:
        """The same for words of at most ``width`` bytes, one merge of each at a time."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        place = np.arange(width)
        alive = place < lengths[:, None]
        # Column ``width`` stands for "no part".
        stride = width + 1
        ids = np.full((n, stride), -1)
        ids[:, :-1][alive] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[np.arange(n), lengths - 1] = width
        before = np.tile(np.concatenate([[width], np.arange(width)]), (n, 1)).ravel()
        rank_at = np.full((n, stride), NONE)
        rank_at[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        entries = np.where(rank_at < NONE, rank_at * stride + np.arange(stride), NONE)
        # A merge takes one entry and adds two at most.
        heaps = Heaps(entries, 2 * width)
        alive, ids, after, rank_at = alive.ravel(), ids.ravel(), after.ravel(), rank_at.ravel()
        rows = np.flatnonzero(heaps.size)
        while len(rows):
            top = heaps.pop(rows)
            rank, start = top // stride, top % stride
            valid = rank_at[rows * stride + start] == rank
            some, rank, start = rows[valid], rank[valid], start[valid]
            base = some * stride
            middle = after[base + start]
            stop, left = after[base + middle], before[base + start]
            ids[base + start], after[base + start], before[base + stop] = rank, stop, start
            alive[some * width + middle] = False
            rank_at[base + middle] = NONE
            for at, a, b in ((start, rank, ids[base + stop]), (left, ids[base + left], rank)):
                new = self.pairs.find(a, b)
                # Nothing in front: what is noted for "no part" is never asked for.
                rank_at[base + at] = new
                there = (new < NONE) & (at < width)
                heaps.push(some[there], new[there] * stride + at[there])
            rows = rows[heaps.size[rows] > 0]
        alive = alive.reshape(n, width)
        packed = ids.reshape(n, stride)[:, :-1][alive].astype("<i4").tobytes()
        stops = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word; none is empty."""
        out = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_size.setdefault((len(word) - 1).bit_length(), []).append(i)
        for size, members in by_size.items():
            if 1 << size > SHORT:
                for i in members:
                    out[i] = self.merge_one(words[i])
                continue
            for first in range(0, len(members), TOGETHER):
                some = members[first : first + TOGETHER]
                for i, packed in zip(some, self.merge_many([words[i] for i in some], 1 << size)):
                    out[i] = packed
        return out


class Encoder:
    """Packed ids of texts from those of their pre-tokens, each asked for once."""

    def __init__(self, pattern: str, packed_of: Callable[[list[str]], Iterable[bytes]]):
        self.split, self.memo = regex.compile(pattern).findall, Memo(packed_of)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        return self.memo.packed(list(map(self.split, texts)))


class Vocabulary:
    """Ranks, their perfect hash and the split pattern, as sent to the executors.

    Its size is that of the vocabulary file, whatever the input; memos are filled
    per worker.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        bare = [bytes([b]) for b in range(256) if bytes([b]) not in self.ranks]
        if bare:
            raise ValueError(f"no token for {len(bare)} single bytes")
        texts, values = [], []
        for token, rank in self.ranks.items():
            try:
                texts.append(token.decode("utf-8"))
            except UnicodeDecodeError:
                continue  # never a whole pre-token
            values.append(rank)
        self.whole = PerfectHash(texts, values)
        self.pattern, self.pairs = pattern, PairRanks(self.ranks)
        self._start()

    def _start(self):
        self.encoder, self.merger = Encoder(self.pattern, self._packed), Merger(self.ranks, self.pairs)
        tokens = {rank: token for token, rank in self.ranks.items()}
        self.sizes = np.zeros(max(tokens) + 1, np.int64)
        self.sizes[list(tokens)] = list(map(len, tokens.values()))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(tokens[rank] for rank in sorted(tokens)), np.uint8)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("ranks", "pairs", "whole", "pattern")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _packed(self, words: list[str]) -> Iterator[bytes]:
        """Ids of distinct pre-tokens: whole tokens by the hash, others merged."""
        found = self.whole.lookup(np.array(words, dtype=object))
        merged = iter(self.merger.merge([words[i].encode() for i in np.flatnonzero(found < 0)]))
        whole = found.astype("<i4").tobytes()
        for i, rank in enumerate(found.tolist()):
            yield whole[4 * i : 4 * i + 4] if rank >= 0 else next(merged)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes (u8) of all ``ids``; one that is no token is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id is no token")
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        places = np.repeat(self.starts[ids] - before, sizes)
        places += np.arange(len(places))
        return self.blob[places]


def vocabulary(spark: SparkSession, path: str, pattern: str):
    """The vocabulary as a broadcast variable, built once on the driver."""
    return spark.sparkContext.broadcast(Vocabulary(path, pattern))


def encode(text: Column, vocabulary) -> Column:
    """Token ids (array of int) of each text; a null text counts as empty."""

    @F.arrow_udf("array<int>")
    def tokens(texts: pa.Array) -> pa.Array:
        words = vocabulary.value
        packed = [x for some in portions(texts.to_pylist()) for x in words.encode(some)]
        stops = np.cumsum([0] + [len(x) // 4 for x in packed], dtype=np.int32)
        return pa.ListArray.from_arrays(stops, pa.array(np.frombuffer(b"".join(packed), np.int32)))

    return tokens(text)


def decode(tokens: Column, vocabulary) -> Column:
    """Bytes (binary) of each list of ids; null gives null, an unknown id an error."""

    @F.arrow_udf("binary")
    def texts(lists: pa.Array) -> pa.Array:
        table = vocabulary.value
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        ids = lists.flatten().to_numpy()
        last = np.cumsum(np.where(valid, lists.value_lengths().fill_null(0).to_numpy(), 0), dtype=np.int64)
        stops = np.concatenate([[0], np.cumsum(table.sizes[ids])])[np.concatenate([[0], last])].tolist()
        whole = table.decode(ids).tobytes()
        return pa.array([whole[a:b] for a, b in zip(stops[:-1], stops[1:])], pa.binary(), mask=~valid)

    return texts(tokens)


def encode_descriptions(issues: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, tokens) of ``issues``: id, description.

    ``path`` names a rank file that driver and executors share the content of
    (it is read on the driver), ``pattern`` the expression that splits a text
    into pre-tokens. One row per issue, repeated ids included. Null and empty
    descriptions give an empty list; an empty table gives no rows; texts of any
    length are encoded whole. Other columns, whatever their names, are ignored.
    """
    words = vocabulary(issues.sparkSession, path, pattern)
    return issues.select("id", encode(F.col("description"), words).alias("tokens"))


def decode_descriptions(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (id, tokens) with ``decoded``, the bytes its tokens stand for."""
    words = vocabulary(encoded.sparkSession, path, pattern)
    return encoded.select("id", "tokens", decode(F.col("tokens"), words).alias("decoded"))
