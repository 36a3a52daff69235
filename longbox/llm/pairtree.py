"""Byte-pair encoding and decoding of issue descriptions over segment trees.

The pairs of neighbouring parts of a pre-token are the leaves of a segment
tree, each with the rank of its merge. Its root is the leftmost pair of lowest
rank; after a merge three leaves change, and with them their ancestors only,
until no pair at the root can be merged. Short pre-tokens of one size are a
forest that numpy merges together, one step of each at a time; long ones have a
tree of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longbox.llm.memo import Memo, by_pretokens, portions

# Pre-tokens of up to so many bytes are merged in forests, of so many rows each.
SHORT, FOREST = 64, 4096
NONE = np.iinfo(np.int64).max
PART = 32


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, all others for the letters
    from 256 on, in ascending order.
    """
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_spec(path: str) -> dict:
    """A tokenizer file, refused if it asks for more than byte-level merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k in ("normalizer", "post_processor") if spec.get(k)]
    odd += [k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if t[k]]
    if odd or model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"not a plain byte-level vocabulary: {odd or split}")
    return spec


class PairRanks:
    """Merges of a vocabulary: rank and result of each pair of ids."""

    def __init__(self, pairs: np.ndarray, results: np.ndarray, byte_ids: np.ndarray):
        keys = (pairs[:, 0] << PART) | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.results, self.byte_ids = results, byte_ids
        self.rank_of: dict[int, int] | None = None

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` if it is not merged; an id of -1 is no part."""
        keys = (left << PART) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_forest(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Packed ids of words of at most ``leaves`` (a power of two) bytes."""
        n, end = len(words), leaves
        lengths = np.fromiter(map(len, words), np.int64, n)
        place = np.arange(leaves)
        alive = place < lengths[:, None]
        # The last column stands for "no part".
        ids = np.full((n, leaves + 1), -1)
        ids[:, :-1][alive] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, leaves + 2), (n, 1))
        after[np.arange(n), lengths - 1] = end
        before = np.tile(np.concatenate([[end], np.arange(leaves)]), (n, 1))
        ranks = self.lookup(ids[:, :-1], ids[:, 1:])
        # Rank before place, so the least is the leftmost of lowest rank; node 0 is not used.
        tree = np.full((n, 2 * leaves), NONE)
        tree[:, leaves:] = np.where(ranks < NONE, ranks * leaves + place, NONE)
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        shape = alive.shape[1]
        alive, ids, after, before, tree = alive.ravel(), ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            root = tree[rows * (2 * leaves) + 1]
            open_ = root < NONE
            rows, root = rows[open_], root[open_]
            if not len(rows):
                break
            base, top = rows * (leaves + 1), rows * (2 * leaves)
            rank, left = root // leaves, root % leaves
            right = after[base + left]
            beyond, ahead = after[base + right], before[base + left]
            made = self.results[rank]
            ids[base + left], after[base + left] = made, beyond
            before[base + beyond] = left
            alive[rows * shape + right] = False
            tree[top + leaves + right] = NONE
            for spot, a, b in ((left, made, ids[base + beyond]), (ahead, ids[base + ahead], made)):
                rank = self.lookup(a, b)
                # No part ahead: the change goes to the node that is not used.
                node = np.where(spot == end, 0, leaves + spot)
                tree[top + node] = np.where(rank < NONE, rank * leaves + spot, NONE)
            nodes = [leaves + left, leaves + right, np.where(ahead == end, 0, leaves + ahead)]
            for _ in range(leaves.bit_length() - 1):
                nodes = [node >> 1 for node in nodes]
                for node in nodes:
                    under = top + 2 * node
                    tree[top + node] = np.minimum(tree[under], tree[under + 1])
        alive = alive.reshape(n, shape)
        packed = ids.reshape(n, leaves + 1)[:, :-1][alive].astype("<i4").tobytes()
        stops = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]

    def merge_tree(self, word: bytes) -> bytes:
        """Packed ids of a word of any length, by a tree of its own."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        rank_of, results, n = self.rank_of, self.results, len(word)
        leaves = 1 << max(0, (n - 1).bit_length())
        ids = [*self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), -1]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        none = int(NONE)
        tree = [none] * (2 * leaves)

        def value(place: int, following: int) -> int:
            rank = rank_of.get((ids[place] << PART) | ids[following]) if following < n else None
            return none if rank is None else rank * leaves + place

        def put(place: int, new: int):
            node = leaves + place
            tree[node] = new
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        for i in range(n - 1):
            tree[leaves + i] = value(i, i + 1)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            rank, left = divmod(tree[1], leaves)
            right = after[left]
            beyond = after[right]
            ids[left], after[left] = int(results[rank]), beyond
            if beyond < n:
                before[beyond] = left
            put(right, none)
            put(left, value(left, beyond))
            if left:
                put(before[left], value(before[left], left))
        kept, place = [], 0
        while place < n:
            kept.append(ids[place])
            place = after[place]
        return np.array(kept, "<i4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word; an empty one has none."""
        out = [b""] * len(words)
        sizes = [max(0, len(w) - 1).bit_length() if w else -1 for w in words]
        by_size: dict[int, list[int]] = {}
        for i, size in enumerate(sizes):
            by_size.setdefault(size, []).append(i)
        for size, members in by_size.items():
            if size < 0:
                continue
            if 1 << size > SHORT:
                for i in members:
                    out[i] = self.merge_tree(words[i])
                continue
            for first in range(0, len(members), FOREST):
                some = members[first : first + FOREST]
                for i, packed in zip(some, self.merge_forest([words[i] for i in some], 1 << size)):
                    out[i] = packed
        return out


class Pairs:
    """A tokenizer file as sent to the executors; its size is that of the file.

    ``plain`` takes the strings of special tokens within a text as ordinary text.
    """

    def __init__(self, path: str, pattern: str, plain: bool = False):
        spec = read_spec(path)
        ids, letters = spec["model"]["vocab"], byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        pairs = np.array([(ids[a], ids[b]) for a, b in merges], np.int64).reshape(-1, 2)
        results = np.array([ids[a + b] for a, b in merges], np.int64)
        self.ranks = PairRanks(pairs, results, np.array([ids[letters[b]] for b in range(256)], np.int64))
        byte_of = {letter: b for b, letter in letters.items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()} | {i: s.encode() for s, i in added.items()}
        self.added = {} if plain else added
        self.pattern = pattern
        self._start()

    def _start(self):
        names = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.find = regex.compile(self.pattern).findall
        self.memo = Memo(self._packed)
        sizes = np.zeros(max(self.tokens) + 1, np.int64)
        for i, token in self.tokens.items():
            sizes[i] = len(token)
        self.known = np.zeros(len(sizes), bool)
        self.known[list(self.tokens)] = True
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.blob = np.frombuffer(b"".join(self.tokens[i] for i in sorted(self.tokens)), np.uint8)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("ranks", "tokens", "added", "pattern")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _packed(self, words: list[str]) -> list[bytes]:
        return self.ranks.merge([w.encode() for w in words])

    def _split(self, text: str) -> list[str] | None:
        return None if self.cut and self.cut.search(text) else self.find(text)

    def _around(self, text: str) -> bytes:
        """Ids of a text that names added tokens: these come before any split."""
        out, at = [], 0
        for hit in self.cut.finditer(text):
            out += self.memo.packed([self.find(text[at : hit.start()])])
            out.append(np.array([self.added[hit.group()]], "<i4").tobytes())
            at = hit.end()
        return b"".join(out + self.memo.packed([self.find(text[at:])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        words = [self._split(text) for text in texts]
        packed = iter(self.memo.packed([w for w in words if w is not None]))
        return [self._around(text) if w is None else next(packed) for text, w in zip(texts, words)]

    def encode_new(self, strings: list[str]) -> list[bytes]:
        """The same for strings that name no added tokens, without the memo."""
        return by_pretokens(strings, self.find, self._packed)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes (u8) of all ``ids``; one that is no token is an error."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.sizes) and self.known[ids].all()):
            raise ValueError("an id is no token")
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        return self.blob[np.arange(total) + np.repeat(self.starts[ids] - (stops - sizes), sizes)]


def pairs(spark: SparkSession, path: str, pattern: str, plain: bool = False):
    """The tokenizer as a broadcast variable, read once on the driver."""
    return spark.sparkContext.broadcast(Pairs(path, pattern, plain))


def packed_lists(packed: list[bytes]) -> pa.Array:
    """Packed ids as a list array."""
    stops = np.cumsum([0] + [len(x) // 4 for x in packed], dtype=np.int32)
    return pa.ListArray.from_arrays(stops, pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode_descriptions(issues: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, tokens) of ``issues``: id, description.

    ``path`` names a tokenizer file in JSON (read on the driver) with byte-level
    merges; ``pattern`` is its split into pre-tokens. Added tokens of the file
    count wherever a description names them; truncation and padding do not. One
    row per issue, repeated ids and null ids included. Null and empty
    descriptions give an empty list; an empty table gives no rows; texts of any
    length are encoded whole. Other columns, whatever their names, are ignored.
    """
    shared = pairs(issues.sparkSession, path, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        for batch in batches:
            done = 0
            for texts in portions(batch.column("description").to_pylist()):
                tokens = packed_lists(tokenizer.encode(texts))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(done, len(texts)), tokens], ["id", "tokens"])
                done += len(texts)

    kind = dict(issues.select("id").dtypes)["id"]
    return issues.select("id", "description").mapInArrow(encode, f"id {kind}, tokens ARRAY<INT>")


def decode_descriptions(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (id, tokens) with ``decoded``, the text its tokens stand for.

    Bytes that are no UTF-8 become replacement characters. A null list gives
    null, an empty one an empty text, an id that is no token an error.
    """
    shared = pairs(encoded.sparkSession, path, pattern)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy()
        counts = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(), 0)
        tokenizer = shared.value
        data = tokenizer.decode(flat)
        stops = np.concatenate([[0], np.cumsum(tokenizer.sizes[flat])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        whole = data.tobytes()
        texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(stops[:-1], stops[1:])]
        return pa.array(texts, pa.string(), mask=~lists.is_valid().to_numpy(zero_copy_only=False))

    return encoded.select("id", "tokens", decode("tokens").alias("decoded"))


def packed(tokens: Column) -> Column:
    """Each list of ids as little-endian unsigned 32-bit integers; null gives null."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        return pa.array([x.values.to_numpy().astype("<u4").tobytes() if x.is_valid else None for x in lists], pa.binary())

    return pack(tokens)
