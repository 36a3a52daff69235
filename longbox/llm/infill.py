"""Fill-in-middle transformation of issue descriptions.

A description is cut at two code points, and its middle goes behind prefix and
suffix. Cuts count code points, texts are bytes: a sparse index of the multibyte
characters alone, with their excess bytes, leads from one to the other. A binary
search in it gives the excess before a cut; what lies between multibyte
characters is arithmetic. One index serves all texts of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Bytes of texts that go out in one batch.
PORTION = 1 << 24


class CutIndex:
    """Multibyte characters of UTF-8 bytes: their places and excess bytes."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        kinds = data[lead]
        excess = 1 + (kinds >= 0xE0).astype(np.int64) + (kinds >= 0xF0)
        # excess_before[k]: excess bytes of the first k multibyte characters
        self.excess_before = np.concatenate([[0], np.cumsum(excess)])
        self.bytes_at = lead
        self.points_at = lead - self.excess_before[:-1]

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte cut (between characters)."""
        return at - self.excess_before[np.searchsorted(self.bytes_at, at)]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before each cut in code points."""
        return at + self.excess_before[np.searchsorted(self.points_at, at)]


@dataclass(frozen=True)
class Choice:
    """How descriptions are cut: draws come from a hash of ``seed`` and id.

    Of 100 draws, those from ``plain_from`` on leave a description plain; of the
    others those below ``spm_below`` put the suffix first.
    """

    seed: int = 1
    plain_from: int = 90
    spm_below: int = 20

    def draws(self, issue_id) -> np.ndarray:
        digest = hashlib.sha256(f"{self.seed}:{'' if issue_id is None else issue_id}".encode()).digest()
        return np.frombuffer(digest, ">u4", 4).astype(np.int64)


def _marked(texts: pa.Array) -> np.ndarray:
    found = [pc.match_substring(texts, mark).to_numpy(zero_copy_only=False) for mark in (PREFIX, SUFFIX, MIDDLE)]
    return np.logical_or.reduce(found)


def transform_batch(ids: list, texts: pa.Array, choice: Choice) -> pa.RecordBatch:
    """Columns n, form, prefix_chars, middle_chars and output of whole texts (no nulls)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    index = CutIndex(data)
    points = index.to_points(offsets)
    first, n = points[:-1], np.diff(points)
    draws = np.array([choice.draws(i) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    plain = (n == 0) | _marked(texts) | (draws[:, 2] % 100 >= choice.plain_from)
    spm = draws[:, 3] % 100 < choice.spm_below
    at = index.to_bytes(first[:, None] + cuts)
    raw, out = data.tobytes(), []
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for i, (a, b, c, d) in enumerate(zip(offsets[:-1].tolist(), *at.T.tolist(), offsets[1:].tolist())):
        if plain[i]:
            out.append(raw[a:d])
        elif spm[i]:
            out.append(b"".join((marks[1], raw[c:d], marks[0], raw[a:b], marks[2], raw[b:c])))
        else:
            out.append(b"".join((marks[0], raw[a:b], marks[1], raw[c:d], marks[2], raw[b:c])))
    return pa.RecordBatch.from_pydict(
        {
            "n": n,
            "form": pa.array(np.where(plain, PLAIN, np.where(spm, SPM, PSM)), pa.string()),
            "prefix_chars": pa.array(cuts[:, 0], pa.int64(), mask=plain),
            "middle_chars": pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain),
            "output": pa.array(out, pa.binary()).cast(pa.string()),
        }
    )


def runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, count) of neighbours that have about ``PORTION`` bytes together."""
    group = np.cumsum(sizes) // PORTION
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]]) if len(sizes) else [0]
    yield from zip(starts[:-1], np.diff(starts))


def transform_descriptions(issues: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of ``issues``: id, description.

    ``n`` is the length in code points. The prefix ends after ``h1 % (n + 1)`` or
    ``h2 % (n + 1)`` code points, the middle after the other, whichever comes
    first; h1 to h4 are the first 32-bit words of the SHA-256 of ``seed:id``.
    ``form`` is plain (the description itself), psm or spm; empty and null
    descriptions and those with a mark in them are plain, with null counts. A
    null id draws as an empty one. Rows that share an id share their draws, not
    their cuts. Texts are cut whole, whatever their length; an empty table gives
    no rows; other columns, whatever their names, are ignored.
    """

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("description"), "")
            for first, count in runs(pc.binary_length(texts).to_numpy()):
                ids = batch.column("id").slice(first, count)
                made = transform_batch(ids.to_pylist(), texts.slice(first, count), choice)
                yield pa.RecordBatch.from_arrays([ids, *made.columns], ["id", *made.schema.names])

    kind = dict(issues.select("id").dtypes)["id"]
    schema = f"id {kind}, n BIGINT, form STRING, prefix_chars BIGINT, middle_chars BIGINT, output STRING"
    return issues.select("id", "description").mapInArrow(transform, schema)


def restored(output: Column, form: Column) -> Column:
    """The description that ``output`` was made from; null gives null.

    A text with a mark is never cut, so each mark stands once where it was put.
    """
    size = F.lit(len(PREFIX))
    one = F.when(form == SPM, SUFFIX).otherwise(PREFIX)
    two = F.when(form == SPM, PREFIX).otherwise(SUFFIX)
    second = F.position(two, output)
    third = F.position(F.lit(MIDDLE), output)
    head = F.substring(output, F.length(one) + 1, second - size - 1)
    tail = F.substring(output, second + size, third - second - size)
    middle = F.substring(output, third + size, F.length(output))
    cut = F.when(form == SPM, F.concat(tail, middle, head)).otherwise(F.concat(head, middle, tail))
    return F.when(form == PLAIN, output).otherwise(cut)
