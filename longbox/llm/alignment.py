"""Alignment of two tokenizers over issue descriptions.

A description is encoded by byte-level merges (A) and by pieces (B); wherever a
token of each ends at the same byte, a group ends. Most groups are one token of
each, so from a common end the two arrays of ends are compared at the current
shift between their indices, in stretches that double as long as they are equal
and halve when they are not. What then differs is one irregular group: it is
walked to the next common end, and the shift is that of its sizes.

Neither tokenizer goes on from other characters to a space, so all words end at
common ends: new words are aligned, one behind the other, and the groups of
those met before come from a bounded memo.

Tokens that end together are linked. The shorter of them is a suffix of the
longer, so the pairs of ids that can ever be linked follow from the two
vocabularies; their counts over all issues have that bound, whatever the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longbox.llm.memo import Memo, portions, words
from longbox.llm.pairtree import Pairs
from longbox.llm.storage import stored

SPACE = "▁"
# The first comparison after an irregular group, in tokens.
STRETCH = 4
PART = 32
# Bytes of a row group: Spark reads up to 4096 rows of one at a time, with all their lists.
ROW_GROUP = 4 << 20


class Pieces:
    """A piece model that prefixes a space."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.model = file.read()
        self._start()

    def _start(self):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.tokens = {
            i: bytes([int(piece[3:5], 16)]) if self.processor.is_byte(i) else piece.replace(SPACE, " ").encode()
            for i in range(self.processor.get_piece_size())
            for piece in [self.processor.id_to_piece(i)]
        }
        # No piece goes on from other characters to a space.
        crossing = re.compile(f"[^{SPACE}]{SPACE}").search
        self.by_word = not any(crossing(self.processor.id_to_piece(i)) for i in self.tokens)

    def __getstate__(self):
        return {"model": self.model}

    def __setstate__(self, state):
        self.model = state["model"]
        self._start()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        found = self.processor.encode(texts, num_threads=1)
        stops = (4 * np.cumsum(list(map(len, found)), dtype=np.int64)).tolist()
        ids = np.fromiter(chain.from_iterable(found), "<i4").tobytes()
        return [ids[i:j] for i, j in zip([0, *stops], stops)]


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens in each group from the ends of two tokenizations.

    Both rise strictly to the same last end. Groups are given as (sizes in A,
    sizes in B).
    """
    ends_a, ends_b = a.astype(np.int64).tobytes(), b.astype(np.int64).tobytes()
    at_a, at_b = memoryview(ends_a).cast("q"), memoryview(ends_b).cast("q")
    n, groups, irregular = len(a), 0, []
    i = j = 0
    while i < n:
        # Tokens from i and j on begin at a common end; their shift is j - i.
        begun, step = i, STRETCH
        while i < n and ends_a[8 * i : 8 * (i + step)] == ends_b[8 * j : 8 * (j + step)]:
            done = min(step, n - i)
            i, j, step = i + done, j + done, 2 * step
        while step > 1 and i < n:
            step //= 2
            if ends_a[8 * i : 8 * (i + step)] == ends_b[8 * j : 8 * (j + step)]:
                i, j = i + step, j + step
        groups += i - begun
        if i < n:
            first_i, first_j = i, j
            x, y = at_a[i], at_b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = at_a[i]
                else:
                    j += 1
                    y = at_b[j]
            i, j = i + 1, j + 1
            irregular.append((groups, i - first_i, j - first_j))
            groups += 1
    sizes = np.ones((2, groups), np.int32)
    places = np.array(irregular, np.int64).reshape(-1, 3).T
    sizes[:, places[0]] = places[1:]
    return sizes[0], sizes[1]


class Spelling:
    """Bytes of tokens by id, end to end."""

    def __init__(self, tokens: dict[int, bytes]):
        said = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.sizes = np.array([len(token) for token in said], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(said), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return self.blob[runs(self.starts[ids], self.sizes[ids])].tobytes()


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one behind the other."""
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    places += np.arange(len(places))
    return places


class LinkTable:
    """All pairs (A id, B id) of tokens of which one ends with the other."""

    def __init__(self, tokens_a: dict[int, bytes], tokens_b: dict[int, bytes]):
        ids_a: dict[bytes, list[int]] = {}
        ids_b: dict[bytes, list[int]] = {}
        for tokens, ids in ((tokens_a, ids_a), (tokens_b, ids_b)):
            for i, token in tokens.items():
                if token:
                    ids.setdefault(token, []).append(i)
        found = set()
        for token, own in ids_a.items():
            for k in range(len(token)):
                found.update((a, b) for b in ids_b.get(token[k:], ()) for a in own)
        for token, own in ids_b.items():
            for k in range(1, len(token)):
                found.update((a, b) for a in ids_a.get(token[k:], ()) for b in own)
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.keys, self.b = (pairs[:, 0] << PART) | pairs[:, 1], pairs[:, 1]

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, (a.astype(np.int64) << PART) | b)


class Aligner:
    """Both tokenizers as sent to the executors."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        self.first, self.second = Pairs(path_a, pattern, plain=True), Pieces(path_b)
        self._start()

    def _start(self):
        self.a, self.b = Spelling(self.first.tokens), Spelling(self.second.tokens)
        self.memo = Memo(self._records)

    def __getstate__(self):
        return {"first": self.first, "second": self.second}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _records(self, new: list[str]) -> list[bytes]:
        """Numbers of A ids, B ids and groups of a space and each word, and the four lists.

        A word that either tokenizer changes has an empty record.
        """
        said = [f" {word}" for word in new]
        whole = [word.encode() for word in said]
        lengths = np.fromiter(map(len, whole), np.int64, len(whole))
        ids, numbers, kept = [], [], np.ones(len(new), bool)
        for spelling, packed in ((self.a, self.first.encode_new(said)), (self.b, self.second.encode(new))):
            numbers.append(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)
            ids.append(np.frombuffer(b"".join(packed), "<i4"))
            reached = np.append(0, np.cumsum(spelling.sizes[ids[-1]]))[np.append(0, np.cumsum(numbers[-1]))]
            kept &= np.diff(reached) == lengths
        # Merges of bytes change none; pre-tokens that leave a byte out show in the length.
        b = ids[1][np.repeat(kept, numbers[1])]
        joined, expected = self.b.joined(b), [word for word, good in zip(whole, kept.tolist()) if good]
        if joined != b"".join(expected):
            stops = np.cumsum(lengths[kept]).tolist()
            kept[kept] = [joined[i:j] == word for i, j, word in zip([0, *stops], stops, expected)]
        a, b = (some[np.repeat(kept, n)] for some, n in zip(ids, numbers))
        n_a, n_b = (n[kept] for n in numbers)
        sizes_a, sizes_b = align(np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b]))
        # All words end with a group.
        n_groups = np.diff(np.searchsorted(np.cumsum(sizes_a), np.cumsum(n_a)) + 1, prepend=0)
        stops = np.cumsum(3 + n_a + n_b + 2 * n_groups)
        records = np.empty(stops[-1] if len(stops) else 0, "<i4")
        at = np.append(0, stops)[:-1]
        for n in (n_a, n_b, n_groups):
            records[at] = n
            at = at + 1
        for values, n in ((a, n_a), (b, n_b), (sizes_a, n_groups), (sizes_b, n_groups)):
            records[runs(at, n)] = values
            at = at + n
        found, stops = records.tobytes(), (4 * stops).tolist()
        cut = iter([found[i:j] for i, j in zip([0, *stops], stops)])
        return [next(cut) if good else b"" for good in kept.tolist()]

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        return words(text) if self.second.by_word else [text]

    def columns(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A ids, B ids, sizes in A, sizes in B: where those of each text start and the last end, and all of them."""
        lists = self.memo.lists(map(self._words, texts))
        numbers = np.fromiter(map(len, lists), np.int64, len(lists))
        records = [record for some in lists for record in some]
        sizes = np.fromiter(map(len, records), np.int64, len(records)) // 4
        text = np.repeat(np.arange(len(texts)), numbers)
        starts = np.cumsum(sizes) - sizes
        changed = np.zeros(len(texts), bool)
        changed[text[sizes == 0]] = True
        starts, text = starts[~changed[text]], text[~changed[text]]
        data = np.frombuffer(b"".join(records), "<i4")
        counts = [data[starts + i].astype(np.int64) for i in range(3)]
        at, out = starts + 3, []
        for n in (*counts, counts[2]):
            of_text = np.bincount(text, n, len(texts)).astype(np.int64)
            out.append((np.append(0, np.cumsum(of_text)), data[runs(at, n)]))
            at = at + n
        return out

    def align(self, texts: list[str]) -> list[list[np.ndarray]]:
        """[A ids, B ids, sizes in A, sizes in B] of each text."""
        columns = self.columns(texts)
        return [[values[stops[i] : stops[i + 1]] for stops, values in columns] for i in range(len(texts))]


def aligner(spark: SparkSession, path_a: str, pattern: str, path_b: str):
    """The tokenizers as a broadcast variable; its size is that of their files."""
    return spark.sparkContext.broadcast(Aligner(path_a, pattern, path_b))


def align_descriptions(issues: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """(id, a, b, a_sizes, b_sizes) of ``issues``: id, description.

    ``a`` are the ids of a space and the description by the byte-level tokenizer
    file ``path_a`` (split by ``pattern``), ``b`` those of the description by the
    piece model ``path_b``, which adds the space; strings of special tokens are
    ordinary text to both. Group k takes the next ``a_sizes[k]`` ids of ``a`` and
    ``b_sizes[k]`` of ``b``. Null and empty descriptions, and those that either
    tokenizer changes, have four empty lists. One row per issue, repeated and
    null ids included; an empty table gives no rows; descriptions of any length
    are taken whole; other columns, whatever their names, are ignored.
    """
    shared = aligner(issues.sparkSession, path_a, pattern, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in portions(batch.column("description").to_pylist()):
                columns = [pa.ListArray.from_arrays(stops.astype(np.int32), pa.array(values)) for stops, values in shared.value.columns(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(done, len(texts)), *columns], ["id", "a", "b", "a_sizes", "b_sizes"]
                )
                done += len(texts)

    kind = dict(issues.select("id").dtypes)["id"]
    schema = f"id {kind}, a ARRAY<INT>, b ARRAY<INT>, a_sizes ARRAY<INT>, b_sizes ARRAY<INT>"
    return issues.select("id", "description").mapInArrow(run, schema)


def _last_ids(ids: pa.Array, sizes: pa.Array) -> np.ndarray:
    """The last id of each group, over all rows: groups leave no id out."""
    return ids.flatten().to_numpy()[np.cumsum(sizes.flatten().to_numpy(), dtype=np.int64) - 1]


def _ids_of_links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_last_ids(batch.column(side), batch.column(f"{side}_sizes")) for side in ("a", "b"))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n): how often two ids are linked over all rows of ``aligned``.

    Each task counts its own links first and sends one row for each pair it met.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            a, b = _ids_of_links(batch)
            new, n = np.unique((a.astype(np.int64) << PART) | b, return_counts=True)
            keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"a": keys >> PART, "b": keys & ((1 << PART) - 1), "n": counts})

    columns = aligned.select("a", "b", "a_sizes", "b_sizes")
    return columns.mapInArrow(count, "a BIGINT, b BIGINT, n BIGINT").groupBy("a", "b").agg(F.sum("n").alias("n"))


class Counts:
    """Counts of all pairs that can be linked, and whether they are their B id's highest."""

    def __init__(self, table: LinkTable, rows: list):
        a, b, n = np.array(rows, np.int64).reshape(-1, 3).T
        self.table, self.n = table, np.zeros(len(table.keys), np.int64)
        self.n[table.numbers(a, b)] = n
        highest = np.zeros(int(table.b.max(initial=0)) + 1, np.int64)
        np.maximum.at(highest, table.b, self.n)
        self.best = self.n == highest[table.b]


def score_links(aligned: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """``aligned`` with n_links, n_best and count_sum.

    A link is counted as often as its pair of ids is linked over all rows;
    ``n_best`` are the links whose count is the highest of any pair with their
    id in B, ties included, ``count_sum`` the sum of the counts of a row's links.
    Counts go through the driver: one number for each pair that the vocabularies
    admit at most (of tokens of which one ends with the other), never more.
    Write ``aligned`` down before, as it is read twice. No rows, no counts.
    """
    both = Aligner(path_a, pattern, path_b)
    rows = [tuple(row) for row in link_counts(aligned).toLocalIterator()]
    shared = aligned.sparkSession.sparkContext.broadcast(Counts(LinkTable(both.first.tokens, both.second.tokens), rows))

    @F.arrow_udf("struct<n_links: bigint, n_best: bigint, count_sum: bigint>")
    def score(a: pa.Array, b: pa.Array, a_sizes: pa.Array, b_sizes: pa.Array) -> pa.Array:
        counts = shared.value
        links = counts.table.numbers(_last_ids(a, a_sizes), _last_ids(b, b_sizes))
        stops = np.cumsum(a_sizes.value_lengths().to_numpy(), dtype=np.int64)

        def per_row(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[stops], prepend=0)

        columns = [per_row(np.ones(len(links), np.int64)), per_row(counts.best[links]), per_row(counts.n[links])]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n_links", "n_best", "count_sum"])

    return aligned.withColumn("_score", score("a", "b", "a_sizes", "b_sizes")).select(*aligned.columns, "_score.*")


def align_and_score(issues: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """``align_descriptions`` written once, with the columns of ``score_links``."""
    aligned = stored(align_descriptions(issues, path_a, pattern, path_b), "aligned", **{"parquet.block.size": str(ROW_GROUP)})
    return score_links(aligned, path_a, pattern, path_b)


@lru_cache(maxsize=8)
def _names(bits: int, end: str) -> np.ndarray:
    """The decimal of each number of up to so many bits, with ``end`` behind."""
    return np.array([f"{i}{end}" for i in range(1 << bits)], object)


def groups_text(a: Column, b: Column, a_sizes: Column, b_sizes: Column) -> Column:
    """Groups as ``a1,a2|b1;a3|b2,b3``; no groups are an empty text."""

    def parts(ids: np.ndarray, sizes: np.ndarray, end: str) -> list[str]:
        """The ids of each group, comma between and ``end`` behind."""
        names = _names(int(ids.max(initial=0)).bit_length(), end)
        stops = np.cumsum(sizes, dtype=np.int64)
        said = names[ids[stops - 1]].tolist()
        for group in np.flatnonzero(sizes > 1).tolist():
            stop = int(stops[group])
            said[group] = ",".join(map(str, ids[stop - sizes[group] : stop].tolist())) + end
        return said

    @F.arrow_udf("string")
    def text(a: pa.Array, b: pa.Array, a_sizes: pa.Array, b_sizes: pa.Array) -> pa.Array:
        flat = [column.flatten().to_numpy() for column in (a, a_sizes, b, b_sizes)]
        left, right = parts(flat[0], flat[1], "|"), parts(flat[2], flat[3], ";")
        said = np.empty(2 * len(left), object)
        said[::2], said[1::2] = left, right
        stops = (2 * np.cumsum([0, *a_sizes.value_lengths().to_pylist()])).tolist()
        said = said.tolist()
        return pa.array(["".join(said[i:j])[:-1] for i, j in zip(stops[:-1], stops[1:])], pa.string())

    return text(a, b, a_sizes, b_sizes)
