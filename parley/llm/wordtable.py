"""Tables of the words that a Python worker has met: words repeat, so their ids are made once and joined by number."""

from __future__ import annotations

import numpy as np

#: Words that a worker remembers before it starts anew.
WORDS_KEPT = 300_000
#: The same, in stored bytes.
BYTES_KEPT = 16 << 20


class Strings:
    """Strings of bytes (or of other small numbers), numbered from 0 and joined by arrays of numbers; more can be added."""

    def __init__(self, dtype=np.uint8):
        self.data, self.start, self.size = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.count = 0

    def add(self, data: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(data) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        while self.count + len(sizes) > len(self.size):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.data[self.used : self.used + len(data)] = data
        self.size[self.count : self.count + len(sizes)] = sizes
        self.start[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = self.used + len(data), self.count + len(sizes)

    @staticmethod
    def of(items: list[bytes]) -> Strings:
        out = Strings()
        out.add(np.frombuffer(b"".join(items), np.uint8), np.array([len(x) for x in items], np.int64))
        return out

    def joined(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of all numbers in one, and where each group of the given sizes begins and ends in them."""
        size = self.size[numbers]
        end = np.cumsum(size)
        step = np.ones(int(end[-1]) if len(end) else 0, np.int64)
        some = size > 0
        first, at = (end - size)[some], self.start[numbers][some]
        if len(first):
            step[first[0]] = at[0]
            step[first[1:]] = at[1:] - (at[:-1] + size[some][:-1] - 1)
        border = np.concatenate(([0], np.cumsum(counts)))
        return self.data[np.cumsum(step)], np.concatenate(([0], end))[border]


class Known(dict):
    """Numbers for words (or other keys); a word that is new gets the next number and waits in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number
