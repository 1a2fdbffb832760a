"""Token ids of texts by way of their units: a unit is encoded once and looked up wherever it recurs.

A text is cut at each space that something other than white space follows; the space belongs to the unit
behind it.  Byte-level and word BPE never merge across such a place, so the ids of a text are those of its
units in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np

#: Units remembered by a worker; beyond, it starts afresh.  A bound on memory, which doesn't change results.
REMEMBERED = 700_000
#: Characters of text cut at once.
SLICE = 1 << 20

_LOOSE = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")


def cut(text: str) -> list[str]:
    """Units of ``text``; all but the first lack the space they begin with."""
    return _CUT.split(text) if _LOOSE.search(text) else text.split(" ")


def text_slices(texts: list[str], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about ``limit`` characters; a longer text is alone."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= limit:
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


#: Marks that both patterns tell from the letter before them.
TAILS = frozenset(".,!?;:")


class UnitTable:
    """Ids of the units seen so far.  ``encode`` gives the ids of each of a list of distinct strings.

    A unit that ends in a letter and a mark has the ids of what is before the mark, and the mark's.  ``lower``:
    the tokenizer lower-cases, so units of ASCII letters are encoded in lower case.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], lower: bool = False):
        self.encode, self.lower = encode, lower
        self._clear()

    def _clear(self) -> None:
        self.first: dict[str, int] = {}  # units at the start of a text
        self.rest: dict[str, int] = {}  # units behind a space
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.used, self.count = 0, 0

    def _grow(self, name: str, size: int) -> None:
        have = getattr(self, name)
        if size > len(have):
            more = np.zeros(max(size, 2 * len(have)), have.dtype)
            more[: len(have)] = have
            setattr(self, name, more)

    def _store(self, known: dict[str, int], new: list[str], found: list) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        self._grow("ids", self.used + total)
        self._grow("begin", self.count + len(new) + 1)
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        self.begin[self.count + 1 : self.count + len(new) + 1] = self.used + np.cumsum(sizes)
        known.update(zip(new, range(self.count, self.count + len(new)), strict=True))
        self.used += total
        self.count += len(new)

    def _known(self, code: int) -> list[int]:
        return self.ids[self.begin[code] : self.begin[code + 1]].tolist()

    def _plain(self, unit: str) -> tuple[str, str]:
        """What to encode for a unit, and the mark behind it."""
        tail = ""
        if "<" in unit:  # perhaps a special token
            return unit, tail
        if len(unit) > 1 and unit[-1] in TAILS and unit[-2].isalpha() and unit[-2] < "\u0100":
            unit, tail = unit[:-1], unit[-1]
        return (unit.lower() if self.lower and unit.isascii() else unit), tail

    def _learn(self, known: dict[str, int], new: list[str], lead: str) -> None:
        plain = list(map(self._plain, new))
        bases = list({b for b, _ in plain}.difference(known))
        self._store(known, bases, list(self.encode([lead + b for b in bases] if lead else bases)) if bases else [])
        marks = {t for _, t in plain if t}.difference(self.first)
        if marks:
            self._store(self.first, list(marks), list(self.encode(list(marks))))
        tails = {t: self._known(self.first[t]) for _, t in plain if t}
        more = [(u, b, t) for u, (b, t) in zip(new, plain, strict=True) if u not in known]
        self._store(known, [u for u, *_ in more], [self._known(known[b]) + tails[t] if t else self._known(known[b]) for _, b, t in more])

    def _find(self, known: dict[str, int], units: list[str], lead: str) -> np.ndarray:
        codes = np.fromiter(map(known.get, units, repeat(-1)), np.int64, len(units))
        lacking = np.flatnonzero(codes < 0)
        if len(lacking):
            self._learn(known, list({units[i] for i in lacking.tolist()}), lead)
            codes[lacking] = [known[units[i]] for i in lacking.tolist()]
        return codes

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each unit, and the number of units of each text."""
        if self.count > REMEMBERED:
            self._clear()
        units = [cut(t) for t in texts]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        heads = [u[0] for u in units]
        codes = np.full(int(sizes.sum()), -1, np.int64)
        inner = np.ones(len(codes), bool)
        inner[np.cumsum(sizes) - sizes] = False
        codes[inner] = self._find(self.rest, [x for u in units for x in u[1:]], " ")
        codes[~inner] = self._find(self.first, heads, "")
        return codes, sizes

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        codes, sizes = self._codes(texts)
        n = np.concatenate([[0], np.cumsum((self.begin[codes + 1] - self.begin[codes]))])
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return n[edge[1:]] - n[edge[:-1]]

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        codes, sizes = self._codes(texts)
        begin = self.begin[codes]
        n = self.begin[codes + 1] - begin
        edge = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(begin - edge[:-1], n) + np.arange(edge[-1])]
        ends = edge[np.cumsum(sizes)]
        return ids, np.diff(ends, prepend=0)
