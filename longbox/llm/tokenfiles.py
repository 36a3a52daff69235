"""Token ids of issue descriptions in packed binary files.

Ids go in blocks of 1024, each as a patched frame of reference: the least id is
the frame, what is above it is packed at a width that fits 90 of 100 ids, and
the high bits of the others stand in a list of exceptions. A file starts with
an index of its issues and one of its blocks, so that any issue can be read
without the blocks before it.

Layout, little-endian: magic, block length, issues, ids, blocks (u32, u64, u64,
u64); per issue its id (i64), whether it has one (u8) and its first id (u64);
per block its start, and the end of the last (u64); the blocks. A block: frame
(u32), width (u8), exceptions (u16), packed bits, then places (u16) and high
bits (u32) of the exceptions. The last block is filled up with its frame.
"""

from __future__ import annotations

import json
import struct
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from longbox.llm.memo import Memo, portions, single_spaced, words
from longbox.llm.pairtree import byte_letters, read_spec
from longbox.llm.storage import one_task_each, open_input, open_output, stored, task_name
from longbox.sources.tables import shared_folder

MAGIC = b"LBXIDS1\n"
BLOCK = 1024
FITTING = 0.9
# A file is full at so many ids.
FILE_IDS = 4_000_000
# Blocks packed at a time.
PACKED = 256
# Characters of texts encoded at a time: each word of theirs is looked up once.
PORTION = 1 << 23
# Bytes of the words met before and their ids.
KNOWN = 300_000_000

_HEAD = struct.Struct("<8sIQQQ")
_BLOCK_HEAD = struct.Struct("<IBH")


def pack(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Blocks of ``ids`` (u32), and where each starts and the last ends."""
    blocks = []
    for first in range(0, len(ids), BLOCK * PACKED):
        part = ids[first : first + BLOCK * PACKED]
        filled = -len(part) % BLOCK
        last = part[len(part) - len(part) % BLOCK :].min() if filled else 0
        rows = np.concatenate([part, np.full(filled, last, part.dtype)]).reshape(-1, BLOCK)
        frames = rows.min(axis=1)
        above = rows - frames[:, None]
        bits = np.frexp(above.astype(np.float64))[1].astype(np.int8)
        rank = int(np.ceil(FITTING * BLOCK)) - 1
        widths = np.partition(bits, rank, axis=1)[:, rank]
        packed = [b""] * len(rows)
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            spread = np.unpackbits(above[at].astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32)[:, :width]
            for i, row in zip(at, np.packbits(spread.reshape(len(at), -1), axis=1, bitorder="little")):
                packed[i] = row.tobytes()
        patched = bits > widths[:, None]
        for i in range(len(rows)):
            places = np.flatnonzero(patched[i])
            high = above[i, places] >> np.uint32(widths[i])
            head = _BLOCK_HEAD.pack(int(frames[i]), int(widths[i]), len(places))
            blocks.append(head + packed[i] + places.astype("<u2").tobytes() + high.astype("<u4").tobytes())
    return blocks, np.cumsum([0] + [len(b) for b in blocks], dtype=np.uint64)


def unpack(block: bytes) -> np.ndarray:
    """The ``BLOCK`` ids (u32) of one block."""
    frame, width, n = _BLOCK_HEAD.unpack_from(block)
    at = _BLOCK_HEAD.size
    size = BLOCK * width // 8
    bits = np.zeros((BLOCK, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(block, np.uint8, size, at), bitorder="little").reshape(BLOCK, width)
    above = np.packbits(bits, bitorder="little").view("<u4").astype(np.uint32)
    places = np.frombuffer(block, "<u2", n, at + size)
    high = np.frombuffer(block, "<u4", n, at + size + 2 * n)
    above[places] |= high << np.uint32(width)
    return above + np.uint32(frame)


def file_bytes(issue_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> Iterator[bytes]:
    """A whole file, in pieces."""
    blocks, starts = pack(ids)
    yield _HEAD.pack(MAGIC, BLOCK, len(issue_ids), len(ids), len(blocks))
    yield np.array([0 if i is None else i for i in issue_ids], "<i8").tobytes()
    yield np.array([i is not None for i in issue_ids], np.uint8).tobytes()
    yield (np.cumsum(lengths, dtype=np.uint64) - np.array(lengths, np.uint64)).astype("<u8").tobytes()
    yield starts.astype("<u8").tobytes()
    yield from blocks


def read_file(read) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(issue id, first id's place in the file, ids) of each issue, from ``read(n)``."""
    magic, block, n, total, n_blocks = _HEAD.unpack(read(_HEAD.size))
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a file of token ids")
    issue_ids = np.frombuffer(read(8 * n), "<i8").tolist()
    known = np.frombuffer(read(n), np.uint8).astype(bool).tolist()
    firsts = np.frombuffer(read(8 * n), "<u8").astype(np.int64).tolist()
    starts = np.frombuffer(read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
    held, begun, taken = np.empty(0, np.uint32), 0, 0
    for i, first in enumerate(firsts):
        stop = firsts[i + 1] if i + 1 < n else total
        parts = [held[first - begun :]]
        while taken * BLOCK < stop:
            parts.append(unpack(read(int(starts[taken + 1] - starts[taken]))))
            taken += 1
        held, begun = np.concatenate(parts), first
        yield issue_ids[i] if known[i] else None, first, held[: stop - first]


def _lengths(parts: list) -> np.ndarray:
    return np.fromiter(map(len, parts), np.int64, len(parts))


def _listed(strings: pa.Array) -> list[str]:
    # Several times as quick as to_pylist.
    return strings.to_numpy(zero_copy_only=False).tolist()


def _taken(data: bytes, stops: np.ndarray, places: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Those pieces of ``data`` that ``places`` name, joined, and where each begins and the last ends; ``stops`` are the ends of all pieces."""
    offsets = pa.py_buffer(np.append(0, stops).astype(np.int64))
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, offsets, pa.py_buffer(data)]).take(places)
    _, offsets, joined = pieces.buffers()
    return memoryview(joined or b""), np.frombuffer(offsets or bytes(8), np.int64, len(pieces) + 1)


def _cut(joined: memoryview, begins: np.ndarray, stops: np.ndarray) -> list[bytes]:
    """The pieces of ``joined`` up to each of ``stops``, counted in ``begins``."""
    ends = begins[stops].tolist()
    return [bytes(joined[a:b]) for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
class Library:
    """A byte-level tokenizer of a file, asked once for each new word.

    The library encodes every pre-token by itself, and none goes on from other
    characters to white space, so the ids of a text's words joined are those of
    the whole text. The pre-tokens of new words go to the library in the letters
    of the file, without another split. Texts with one of the file's added
    tokens go to it whole, since such tokens come before the split.
    """

    def __init__(self, path: str, pattern: str):
        self.split = regex.compile(pattern).findall
        self.tokenizer = Tokenizer.from_file(path)
        added = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(added)).search if added else lambda text: None
        spec = read_spec(path) | {"pre_tokenizer": None, "added_tokens": [], "truncation": None, "padding": None}
        self.merges, self.letters = Tokenizer.from_str(json.dumps(spec)), byte_letters()
        ids = self.merges.get_vocab()
        self.sizes = np.zeros(max(ids.values()) + 1, np.int64)
        self.sizes[list(ids.values())] = list(map(len, ids))
        self.memo = Memo(self._after_spaces, KNOWN)

    def _after_spaces(self, new: list[str]) -> list[bytes]:
        """Ids of words with a space before each."""
        # A space and letters are one pre-token.
        alpha = list(map(str.isalpha, new))
        single, others = [f" {word}" for word, one in zip(new, alpha) if one], [word for word, one in zip(new, alpha) if not one]
        # The space of the next word would go on white space at the end of a word.
        ends = [i for i, word in enumerate(others, 1) if word[-1:].isspace()]
        runs = [others[a:b] for a, b in zip([0, *ends], [*ends, len(others)]) if a < b]
        pretokens = list(chain.from_iterable(self.split(f" {' '.join(run)}") for run in runs))
        stops = np.cumsum(_lengths(pretokens)).searchsorted(np.cumsum(_lengths(others) + 1)) + 1
        ids = self._joined(single + pretokens, np.append(np.arange(1, len(single) + 1), len(single) + stops))
        ids, split = iter(ids[: len(single)]), iter(ids[len(single) :])
        return [next(ids if one else split) for one in alpha]

    def _packed(self, strings: list[str]) -> list[bytes]:
        """Ids of strings without added tokens."""
        pretokens = list(map(self.split, strings))
        return self._joined(list(chain.from_iterable(pretokens)), np.cumsum(_lengths(pretokens)))

    def _joined(self, pretokens: list[str], stops: np.ndarray) -> list[bytes]:
        """Ids of runs of pre-tokens, of which the library gets each once; ``stops`` are the ends of the runs."""
        coded = pa.array(pretokens, pa.large_string()).dictionary_encode()
        merged, ends = self._merged(_listed(coded.dictionary))
        return _cut(*_taken(merged, ends, coded.indices), stops)

    def _merged(self, pretokens: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of all ``pretokens``, and where those of each end."""
        if not pretokens:
            return b"", np.empty(0, np.int64)
        # No byte of UTF-8 is 255.
        letters = b"\xff".join([s.encode() for s in pretokens]).decode("latin-1").translate(self.letters)
        said = letters.split(self.letters[255])
        ids = np.array(self.merges.encode_batch_fast([said], is_pretokenized=True, add_special_tokens=False)[0].ids, "<i4")
        # The quick way doesn't tell which pre-token an id is of, but its letters do.
        stops = np.cumsum(self.sizes[ids]).searchsorted(np.cumsum(_lengths(said))) + 1
        return ids.tobytes(), 4 * stops

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        whole = [self.added(text) is not None for text in texts]
        firsts, rests, uneven = [], [], []
        for text, odd in zip(texts, whole):
            if odd:
                continue
            # No space before the first word, so it is no word of the memo.
            if single_spaced(text):
                first, space, rest = text.partition(" ")
                rests.append(rest if space else None)
            else:
                first, *rest = words(text)
                uneven.append((len(rests), rest))
                rests.append(None)
            firsts.append(first)
        packed = map(bytes.__add__, self._packed(firsts), self._looked_up(rests, uneven))
        return [self._whole(text) if odd else next(packed) for text, odd in zip(texts, whole)]

    def _looked_up(self, rests: list[str | None], uneven: list[tuple[int, list[str]]]) -> list[bytes]:
        """Ids of the words of each of ``rests``, cut at all its spaces; ``uneven`` has the place and words of others."""
        cut = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        counts = cut.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.append(counts, _lengths([some for _, some in uneven]))
        apart = pa.array(chain.from_iterable(some for _, some in uneven), pa.large_string())
        coded = pa.concat_arrays([cut.flatten(), apart]).dictionary_encode()
        found = self.memo.each(_listed(coded.dictionary))
        ids = _cut(*_taken(b"".join(found), np.cumsum(_lengths(found)), coded.indices), np.cumsum(counts))
        for (at, _), own in zip(uneven, ids[len(rests) :]):
            ids[at] = own
        return ids[: len(rests)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()


def write_token_files(issues: DataFrame, path: str, pattern: str, end_id: int) -> DataFrame:
    """(path, start, issues, ids) of the files that hold ``issues``: id, description.

    Descriptions are encoded whole by the tokenizer in ``path``, which lies on
    every executor, without special tokens added; ``pattern`` is its split into
    pre-tokens, none of which goes on from other characters to white space.
    ``end_id`` follows each, also empty and null ones. Issues are in
    ascending order of id (null first), equal ids by description, over all
    files: ``start`` counts the ids in all files before. No issues give no
    files. Other columns are ignored. Files lie in the shared folder and are
    full at 4 million ids.
    """
    folder = shared_folder(issues.sparkSession, "ids")
    end = np.array([end_id], "<i4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, number = Library(path, pattern), 0
        known, parts, size = [], [], 0

        def full():
            name = task_name(f"{number}.ids")
            with open_output(folder, name) as out:
                for piece in file_bytes(known, [len(p) // 4 for p in parts], np.frombuffer(b"".join(parts), "<u4")):
                    out.write(piece)
            return pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{name}"], "part": [int(name[:6])], "number": [number], "issues": [len(known)], "ids": [size // 4]}
            )

        read = deque()

        def texts() -> Iterator[str | None]:
            for batch in batches:
                read.extend(batch.column("id").to_pylist())
                yield from batch.column("description").to_pylist()

        for ids in chain.from_iterable(map(library.encode, portions(texts(), PORTION))):
            known.append(read.popleft())
            parts.append(ids + end)
            size += len(parts[-1])
            if size >= 4 * FILE_IDS:
                yield full()
                known, parts, size, number = [], [], 0, number + 1
        if known:
            yield full()

    ordered = (
        issues.select(F.col("id").cast("bigint").alias("id"), "description")
        .repartitionByRange("id")
        .sortWithinPartitions("id", "description")
    )
    files = stored(ordered.mapInArrow(write, "path STRING, part BIGINT, number BIGINT, issues BIGINT, ids BIGINT"), "id-list")
    # One row a file, so the order of all files is a small window.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("ids").over(before), F.lit(0))
    return files.select("path", start.alias("start"), "issues", "ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            with open_input(path) as file:
                rows, size = {"id": [], "start": [], "ids": []}, 0
                schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
                for issue_id, first, ids in read_file(file.read):
                    rows["id"].append(issue_id)
                    rows["start"].append(start + first)
                    rows["ids"].append(ids.astype("<u4").tobytes())
                    size += len(ids)
                    if size >= BLOCK * BLOCK:
                        yield pa.RecordBatch.from_pydict(rows, schema)
                        rows, size = {"id": [], "start": [], "ids": []}, 0
                yield pa.RecordBatch.from_pydict(rows, schema)


def read_token_files(files: DataFrame) -> DataFrame:
    """(id, start, ids) of all issues in ``files``: path, start.

    ``start`` counts the ids before the issue over all files; ``ids`` are its
    ids, end id included, as little-endian unsigned 32-bit integers (binary).
    """
    return one_task_each(files.select("path", "start")).mapInArrow(_read, "id BIGINT, start BIGINT, ids BINARY")
