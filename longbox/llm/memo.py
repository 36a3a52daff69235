"""Words of texts, and packed ids of strings met before, in bounded memory."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

# Bytes that the strings of a memo and their ids may take, overhead included.
BYTES = 200_000_000
# What a string, its ids and its place in a dict take besides their text.
OVERHEAD = 180
# Characters of texts handled at a time.
PORTION = 1 << 20

# A space within a run of white space, not last in it.
_in_run = re.compile(r" (?!\S)(?<=[^\S ] )").search
_cut = re.compile(r"(?<=\S) (?=.)", re.DOTALL).split


def single_spaced(text: str) -> bool:
    """Whether ``words`` cuts ``text`` at each of its spaces."""
    return not ("  " in text or text[:1] == " " or text[-1:] == " " or _in_run(text))


def words(text: str) -> list[str]:
    """Words that joined by one space each are ``text``; only an empty text has an empty one.

    The space before a word is the first or the last of its run of white space.
    So it begins a token wherever no token goes on from other characters to
    white space, and white space before the last of its run is taken together.
    """
    return text.split(" ") if single_spaced(text) else _cut(text)


class Memo(dict):
    """Ids of strings, asked for once as long as the memo has room.

    Its keys are the strings met since half the room was last used up; those of
    the half before are ``older`` until met again. So frequent strings stay, and
    no result changes.
    """

    def __init__(self, packed_of: Callable[[list[str]], Iterable[bytes]], bound: int = BYTES):
        self.packed_of, self.bound = packed_of, bound
        self.older: dict[str, bytes] = {}
        self.new: dict[str, bytearray] = {}
        self.bytes = self.older_bytes = 0

    @property
    def known(self) -> dict[str, bytes]:
        return self

    def __missing__(self, string: str) -> bytes | bytearray:
        """Ids met before, or room for those to be asked for."""
        ids = self.older.pop(string, None) if self.older else None
        if ids is None:
            ids = self.new[string] = bytearray()
        else:
            self.older_bytes -= len(string) + len(ids) + OVERHEAD
        self[string] = ids
        return ids

    def _age(self) -> None:
        if 2 * (self.bytes - self.older_bytes) > self.bound:
            self.older, self.older_bytes = dict(self), self.bytes - self.older_bytes
            self.bytes = self.older_bytes
            self.clear()

    def each(self, strings: list[str]) -> list[bytes]:
        """The ids of distinct strings."""
        self._age()
        found = list(map(self.get, strings))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        if self.older:
            for i in lacking:
                ids = self.older.pop(strings[i], None)
                if ids is not None:
                    found[i] = self[strings[i]] = ids
                    self.older_bytes -= len(strings[i]) + len(ids) + OVERHEAD
            lacking = [i for i in lacking if found[i] is None]
        new = [strings[i] for i in lacking]
        if new:
            packed = list(self.packed_of(new))
            self.update(zip(new, packed, strict=True))
            self.bytes += sum(map(len, new)) + sum(map(len, packed)) + OVERHEAD * len(new)
            for i, ids in zip(lacking, packed):
                found[i] = ids
        return found

    def lists(self, lists: Iterable[list[str]]) -> list[list[bytes]]:
        """The ids of each string in each list."""
        self._age()
        try:
            # A list is looked up while it is fresh in the processor's cache.
            found = [list(map(self.__getitem__, strings)) for strings in lists]
            for (string, room), ids in zip(self.new.items(), self.packed_of(list(self.new)), strict=True):
                room[:] = self[string] = ids
                self.bytes += len(string) + len(ids) + OVERHEAD
            self.new = {}
        except BaseException:
            # No room may stay empty.
            self.__init__(self.packed_of, self.bound)
            self.clear()
            raise
        return found

    def packed(self, lists: Iterable[list[str]]) -> list[bytes]:
        """The joined ids of each list of strings."""
        return [b"".join(found) for found in self.lists(lists)]


def by_pretokens(
    strings: list[str], split: Callable[[str], list[str]], packed_of: Callable[[list[str]], Iterable[bytes]]
) -> list[bytes]:
    """Ids of each string from those of its pre-tokens, each asked for once.

    A space and letters are one pre-token.
    """
    parts = [[s] if s[1:].isalpha() and s[0] == " " else split(s) for s in strings]
    distinct = list(set(chain.from_iterable(parts)))
    ids = dict(zip(distinct, packed_of(distinct), strict=True))
    return [ids[some[0]] if len(some) == 1 else b"".join(map(ids.__getitem__, some)) for some in parts]


def portions(texts: Iterable[str | None], chars: int = PORTION) -> Iterator[list[str]]:
    """``texts``, null as empty, in runs of about ``chars`` characters."""
    run, size = [], 0
    for text in texts:
        run.append(text or "")
        size += len(run[-1])
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run
