"""Sequences of different lengths, laid out so that one numpy call does a step of all of them."""

from __future__ import annotations

import numpy as np


class Lockstep:
    """Time-major layout: place ``at[i]`` holds element i of the sequences one after another.

    Sequences are ranked by falling length, so those that have a t-th element are the first ones.
    """

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        longest = int(lengths.max()) if len(lengths) else 0
        self.active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
        self.offsets = np.r_[0, np.cumsum(self.active)]
        starts = np.cumsum(lengths) - lengths
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
        self.at = self.offsets[step] + rank[self.owner]
        self.steps = longest

    def pack(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.at] = values
        return out

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        return packed[self.at]

    def part(self, t: int) -> slice:
        return slice(self.offsets[t], self.offsets[t + 1])


class Remembered(dict):
    """Key -> row number of a growing table; the rows of new keys are made together. ``trim`` bounds it between slices."""

    def __init__(self, make, width: int, limit: int = 300_000):
        super().__init__()
        self.make, self.width, self.limit = make, width, limit
        self.rows = np.zeros((0, width), np.float32)

    def look_up(self, keys: list[str]) -> np.ndarray:
        """A row of the table for each key. make gets a list of new keys and gives their rows."""
        new = list(set(keys).difference(self))
        if new:
            n = len(self)
            if n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[:n], np.zeros((n + 2 * len(new), self.width), np.float32)])
            self.rows[n : n + len(new)] = self.make(new)
            self.update(zip(new, range(n, n + len(new)), strict=True))
        at = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        return self.rows[at]

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.rows = np.zeros((0, self.width), np.float32)
