"""Evaluation passages in issue descriptions, found with suffix arrays.

Descriptions are the training side. Each batch of them is a shard with a suffix
array over its words; every suffix of every evaluation item is looked up in it
by binary search, all of them at once. Suffixes that agree on a window of ten
words are hits. A text and an item with hits share one more suffix array, which
gives the longest verbatim match from each hit word; nothing lists the places of
an item times those of a text.

A word that no item has cannot be part of a match, so the array holds the
suffixes of the stretches between such words only, and of those only stretches
as long as the shortest window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.llm.storage import stored

WINDOW = 10
# Words of evaluation text that one broadcast holds; more take further passes.
BLOCK_WORDS = 1_000_000

FOUND = "STRUCT<n_words: BIGINT, n_hit: BIGINT, matches: ARRAY<STRUCT<item_id: BIGINT, item_word: BIGINT, word: BIGINT, n_words: BIGINT>>>"
MATCH = pa.struct([(name, pa.int64()) for name in ("item_id", "item_word", "word", "n_words")])

# A-Z in lower case; every other ASCII character but digits and a-z is a space.
_SPACED = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SPACED).split()


class Items:
    """Word numbers (from 1), words and distinct windows of some evaluation items."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.number: dict[bytes, int] = {}
        self.ids, self.words = [], []
        # For each width its windows by number; and which windows an item has, in order.
        tables: dict[int, dict[tuple[int, ...], int]] = {}
        self.has: list[np.ndarray] = []
        for item_id, own in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in own]
            width = min(WINDOW, len(ids))
            if not width:
                continue
            table = tables.setdefault(width, {})
            found = {table.setdefault(tuple(ids[at : at + width]), len(table)) for at in range(len(ids) - width + 1)}
            self.ids.append(item_id)
            self.words.append(np.array(ids, np.int64))
            self.has.append(np.array(sorted(found), np.int64))
        widths = np.array([min(WINDOW, len(w)) for w in self.words], np.int64)
        # For each width: the windows, and the items that have each of them.
        self.windows = []
        for width, table in sorted(tables.items()):
            own = np.flatnonzero(widths == width)
            window = np.concatenate([self.has[i] for i in own])
            item = np.repeat(own, [len(self.has[i]) for i in own])
            stops = np.concatenate([[0], np.cumsum(np.bincount(window, minlength=len(table)))])
            self.windows.append((width, np.array(list(table), np.int32), item[np.argsort(window, kind="stable")], stops))
        self.shortest = min((w[0] for w in self.windows), default=0)


class Shard:
    """Suffix array of the stretches of known words in some texts."""

    def __init__(self, texts: list[list[int]], shortest: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        # Every text ends with a 0, as do unknown words.
        flat = np.zeros(self.starts[-1], np.int32)
        for start, text in zip(self.starts, texts):
            flat[start : start + len(text)] = text
        breaks = np.flatnonzero(flat == 0)
        run = np.diff(breaks, prepend=-1) - 1
        long = run >= max(shortest, 1)
        ends, run = breaks[long], run[long]
        kept = np.repeat(ends - run - np.concatenate([[0], np.cumsum(run + 1)[:-1]]), run + 1)
        self.origin = np.arange(len(kept)) + kept
        self.text = np.concatenate([flat[self.origin], np.zeros(WINDOW, np.int32)])
        end = np.repeat(np.cumsum(run + 1) - 1, run + 1)
        self.array = self._sorted(end)

    def _sorted(self, end: np.ndarray) -> np.ndarray:
        """Suffixes by their words, to the depth of a window, by doubling."""
        n = len(end)
        if not n:
            return np.empty(0, np.int64)
        at, depth = np.arange(n), 1
        rank = np.unique(self.text[:n], return_inverse=True)[1].astype(np.int64)
        while depth < WINDOW:
            later = np.where(at + depth < end, rank[np.minimum(at + depth, n - 1)], 0)
            rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
            depth *= 2
        order = np.argsort(rank, kind="stable")
        return order[self.text[order] > 0]

    def _bound(self, windows: np.ndarray, after: bool) -> np.ndarray:
        """For each window the first suffix not before it, or (``after``) beyond it."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.array), np.int64)
        across, rows = np.arange(windows.shape[1]), np.arange(len(windows))
        while (open_ := low < high).any():
            middle = np.minimum((low + high) // 2, len(self.array) - 1)
            gap = self.text[self.array[middle][:, None] + across] - windows
            sign = gap[rows, (gap != 0).argmax(axis=1)]
            right = (sign < 0) | (after & (sign == 0))
            low = np.where(open_ & right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in the texts) of every occurrence of a window."""
        if not len(self.array):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low, high = self._bound(windows, False), self._bound(windows, True)
        count = high - low
        which = np.repeat(np.arange(len(windows)), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return which, self.origin[self.array[low[which] + nth]]


def _covered(starts: np.ndarray, stops: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Places per owner covered by any of the intervals; owners don't overlap."""
    total = np.zeros(n, np.int64)
    if len(starts):
        order = np.argsort(starts, kind="stable")
        starts, stops, owner = starts[order], np.maximum.accumulate(stops[order]), owner[order]
        fresh = np.maximum(starts, np.concatenate([[0], stops[:-1]]))
        np.add.at(total, owner, np.maximum(stops - fresh, 0))
    return total


def _longest(item: np.ndarray, text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``places`` in ``text`` the length and the place in ``item`` of the longest match from there.

    Item and text are put in one order of suffixes by doubling; the longest match
    of a place is with one of the nearest suffixes of the item, before or after it.
    """
    ends = np.array([-1], np.int64), np.array([-2], np.int64)
    joined = np.concatenate([item, ends[0], text, ends[1]])
    n, depth = len(joined), 1
    ranks = [np.unique(joined, return_inverse=True)[1].astype(np.int64) + 1]
    while depth < min(len(item), len(text)) and ranks[-1].max() < n:
        later = np.zeros(n, np.int64)
        later[: n - depth] = ranks[-1][depth:]
        ranks.append(np.unique(ranks[-1] * (n + 1) + later, return_inverse=True)[1].astype(np.int64) + 1)
        depth *= 2
    order = np.argsort(ranks[-1], kind="stable")
    nth = np.empty(n, np.int64)
    nth[order] = np.arange(n)
    ours = order < len(item)
    before = np.maximum.accumulate(np.where(ours, np.arange(n), -1))
    after = np.minimum.accumulate(np.where(ours, np.arange(n), n)[::-1])[::-1]
    start = places + len(item) + 1
    best, where = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    for near in (before[nth[start]], after[nth[start]]):
        real = (near >= 0) & (near < n)
        at = order[np.where(real, near, 0)]
        length = np.zeros(len(places), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            rank = ranks[level]
            # Two lengths of a level: all levels below give one less than this one.
            for _ in range(2 if level == len(ranks) - 1 else 1):
                a, b = np.minimum(start + length, n - 1), np.minimum(at + length, n - 1)
                length += np.where(real & (rank[a] == rank[b]) & (a != b), 1 << level, 0)
        better = length > best
        best, where = np.where(better, length, best), np.where(better, at, where)
    return best, where


def _matches(items: Items, texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its hit words; and rows (item, item word, word, length), the texts of the rows."""
    shard = Shard(texts, items.shortest)
    starts, stops, owners, hits = [], [], [], []
    for at, (width, windows, _, _) in enumerate(items.windows):
        which, place = shard.find(windows)
        owner = np.searchsorted(shard.starts, place, side="right") - 1
        starts, stops, owners = [*starts, place], [*stops, place + width], [*owners, owner]
        order = np.lexsort((place, owner))
        hits += [(o, at, which[part], place[part]) for o, part in _by_owner(owner[order], order)]
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, stops, owners)]
    rows, texts_of = [np.empty((0, 4), np.int64)], []
    for owner, at, which, place in sorted(hits, key=lambda h: h[:2]):
        width, _, having, bounds = items.windows[at]
        own = np.asarray(texts[owner], np.int64)
        for item in np.unique(np.concatenate([having[bounds[w] : bounds[w + 1]] for w in np.unique(which)])):
            mine = place[np.isin(which, items.has[item])] - shard.starts[owner]
            found = _longest_of(items.words[item], own, mine, width)
            rows.append(np.column_stack([np.full(len(found), items.ids[item]), found]))
            texts_of += [owner] * len(found)
    return _covered(*flat, len(texts)), np.array(texts_of, np.int64), np.concatenate(rows)


def _by_owner(owner: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, its part of ``order``), ``owner`` being sorted."""
    if len(owner):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(owner[a]), order[a:b]


def _longest_of(item: np.ndarray, text: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Rows (item word, word, length): matches from ``places`` that no longer one of the item holds."""
    # Stretches of hit words, of which the text between has no part.
    fresh = np.concatenate([[True], np.diff(places) > width])
    firsts = places[fresh]
    lasts = places[np.concatenate([np.flatnonzero(fresh)[1:], [len(places)]]) - 1] + width
    shift = np.cumsum(fresh) - 1
    lengths = lasts - firsts
    bases = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    # What parts two stretches is a word of no item, each time another one.
    parts = [np.append(text[a:b], -3 - i) for i, (a, b) in enumerate(zip(firsts, lasts))]
    best, where = _longest(item, np.concatenate(parts), places - firsts[shift] + bases[shift])
    reach = places + best
    longest = np.concatenate([[True], reach[1:] > reach[:-1]])
    return np.column_stack([where, places, best])[longest]


def find(text: Column, items) -> Column:
    """What a text shares with the ``items`` of a broadcast ``Items``, as ``FOUND``."""

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        known = items.value
        number = known.number.get
        own = [[number(w, 0) for w in words(x.as_py())] for x in texts]
        hit, owner, rows = _matches(known, own)
        stops = np.searchsorted(owner, np.arange(len(own) + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(4)], fields=list(MATCH))
        lists = pa.ListArray.from_arrays(stops, values)
        return pa.StructArray.from_arrays(
            [pa.array([len(x) for x in own], pa.int64()), pa.array(hit), lists], names=["n_words", "n_hit", "matches"]
        )

    return found(text)


def _blocks(evaluation: DataFrame) -> Iterator[Items]:
    """The items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    rows = evaluation.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text")
    for item_id, text in rows.toLocalIterator():
        own = words(text)
        block.append((item_id, own))
        size += len(own)
        if size >= BLOCK_WORDS:
            yield Items(block)
            block, size = [], 0
    yield Items(block)


def contamination(issues: DataFrame, evaluation: DataFrame) -> DataFrame:
    """``issues`` (id, description) as (id, n_words, n_hit, matches).

    ``evaluation``: item_id, text. Words are runs of digits, letters a-z (A-Z
    count as such) and non-ASCII characters. A window is ten words of an item in
    a row, or the whole of a shorter item. ``matches`` lists for each item the
    verbatim matches that contain a window and lie in no longer match of that
    item: item_id, item_word and word (offsets from 0 in item and description;
    one place of the item, if it has several), n_words; ``n_hit`` counts the words of the
    description inside any occurrence of a window. Descriptions null or without
    words have none. Items without an id, null or without words take no part;
    items of equal id are listed under it. One row per issue; no items or no
    issues give no matches or no rows. Other columns are ignored.
    """
    spark = issues.sparkSession
    out = held = None
    for items in _blocks(evaluation):
        if out is None:
            held = spark.sparkContext.broadcast(items)
            out = issues.select("id", "description", find(F.col("description"), held).alias("found"))
            continue
        # A further block: hit words can overlap those of the blocks before, which are done with once stored.
        before = stored(out, "found")
        held.destroy()
        held = spark.sparkContext.broadcast(items)
        more = before.select("id", "description", "found", find(F.col("description"), held).alias("more"))
        matches = F.array_union("found.matches", "more.matches")
        out = more.select(
            "id", "description", F.struct("found.n_words", _hit(matches).alias("n_hit"), matches.alias("matches")).alias("found")
        )
    return out.select("id", "found.*")


def _hit(matches: Column) -> Column:
    """Words covered by any of the matches."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["word"].alias("a"), (m["word"] + m["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("end"))
    step = lambda acc, s: F.struct(
        (acc["total"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("total"),
        F.greatest(acc["end"], s["b"]).alias("end"),
    )
    return F.aggregate(spans, start, step, lambda acc: acc["total"])


def without_contaminated(issues: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Rows of ``issues`` (all columns) that hold no window of any item."""
    held = None
    for items in _blocks(evaluation):
        if held is not None:
            issues = stored(issues, "clean")
            held.destroy()
        held = issues.sparkSession.sparkContext.broadcast(items)
        issues = issues.filter(find(F.col("description"), held)["n_hit"] == 0)
    return issues
