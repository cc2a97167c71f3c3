"""A bounded table of packed ids by word, and the ids of many words in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np


class WordCache:
    """Packed ids of words in two generations: when the young one is full it becomes the old one.

    Words in use move on to the new young generation, so a long tail of rare words does not push out the
    frequent ones, and at most about twice ``room`` words are held. Words that are new are encoded together.
    """

    def __init__(self, room: int = 400_000):
        self.room = room
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lookup(self, words: list[str], encode: Callable[[list[str]], list[bytes]], mark: str = "") -> list[bytes]:
        """The packed ids of distinct words. ``mark`` goes before their keys, where words of several kinds share the table."""
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        keys = [mark + w for w in words] if mark else words
        found = list(map(young.get, keys))
        fresh = []
        for i, got in enumerate(found):
            if got is None:
                got = found[i] = old.get(keys[i])
                if got is None:
                    fresh.append(i)
                else:
                    young[keys[i]] = got
        if fresh:
            for i, ids in zip(fresh, encode([words[i] for i in fresh]), strict=True):
                found[i] = young[keys[i]] = ids
        return found


def gathered(rows: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (unsigned 32-bit) of words in their order, by the packed ids of distinct words and the number of each word; and where each word's ids end, with a 0 before."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
    table = np.frombuffer(b"".join(rows), "<u4")
    first = np.cumsum(sizes) - sizes
    n = sizes[code]
    ends = np.concatenate([[0], np.cumsum(n)])
    source = np.arange(int(ends[-1]))
    source += np.repeat(first[code] - ends[:-1], n)
    return table[source], ends


def portions(texts: Iterable[str | None], size: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts of about ``size`` characters together; null becomes empty."""
    part: list[str] = []
    held = 0
    for text in texts:
        part.append(text or "")
        held += len(part[-1])
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part
