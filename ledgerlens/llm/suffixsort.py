"""Suffix sorting of many short texts at once, to a bounded depth, by two-stage sorting.

A suffix is of type S if it is smaller than the suffix one byte further, else of type L. Only the S
suffixes are sorted directly. The L suffixes follow by one scan over the buckets of first bytes: a
suffix that has its place gives the one before it the next place in that one's bucket.
"""

from __future__ import annotations

import numpy as np

# Rows of adjacent suffixes compared at once.
COMPARE_ROWS = 50_000


class SuffixArray:
    """Suffixes of texts (joined in `data`, `starts` and `lengths` in bytes) that start in the
    first `wanted` bytes of each text, sorted by at least `depth` bytes.

    Each wanted suffix has `depth` bytes before its text ends. `order` holds their places in
    `data`, and `common` the bytes each shares with the one before it, up to `depth`.
    """

    def __init__(
        self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, wanted: np.ndarray,
        depth: int,
    ) -> None:
        # Texts apart by one end mark, which is smaller than every byte.
        self.depth, gaps = depth, np.arange(len(starts))
        self.starts = starts + gaps
        size = len(data) + len(starts)
        self.line = np.zeros(size + depth, np.uint8)
        symbol = np.zeros(size, np.uint16)
        owner = np.repeat(gaps, lengths)
        self.line[np.arange(len(data)) + owner] = data
        symbol[np.arange(len(data)) + owner] = data.astype(np.uint16) + 1
        self.ends, self.last = self.starts + lengths, self.starts + wanted - 1
        small = self._types(symbol)
        # What is sorted: the wanted suffixes, and from the last of them on up to the next S suffix.
        stops = np.flatnonzero(small)
        until = stops[np.searchsorted(stops, self.last)]
        step = np.zeros(size + 1, np.int8)
        np.add.at(step, self.starts, 1)
        np.add.at(step, until + 1, -1)
        inside = np.cumsum(step[:size], dtype=np.int8) > 0
        order = self._induce(symbol, small, inside, self._direct(symbol, np.flatnonzero(small & inside)))
        text = np.searchsorted(self.starts, order, "right") - 1
        order = order[order <= self.last[text]]
        self.order, self.text = order, np.searchsorted(self.starts, order, "right") - 1
        self.common = self._common(order)

    @staticmethod
    def _types(symbol: np.ndarray) -> np.ndarray:
        """Whether each suffix is of type S; end marks are."""
        small = np.ones(len(symbol), bool)
        small[:-1] = symbol[:-1] < symbol[1:]
        small[symbol == 0] = True
        differs = np.flatnonzero(symbol[:-1] != symbol[1:])
        equal = np.flatnonzero((symbol[:-1] == symbol[1:]) & (symbol[:-1] > 0))
        small[equal] = small[differs[np.searchsorted(differs, equal)]] if len(equal) else False
        return small

    def _direct(self, symbol: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The S suffixes in order of `depth` bytes, or as many as their text has left."""
        rows = np.lib.stride_tricks.sliding_window_view(self.line, self.depth)[places]
        left = self.ends[np.searchsorted(self.starts, places, "right") - 1] - places
        short = np.flatnonzero(left < self.depth)
        rows[short] *= np.arange(self.depth) < left[short, None]
        order = places[np.argsort(rows.view(f"S{self.depth}").ravel(), kind="stable")]
        # A text's end and a zero byte look the same in a row, but lie in buckets of their own.
        return order[np.argsort(symbol[order], kind="stable")]

    @staticmethod
    def _induce(
        symbol: np.ndarray, small: np.ndarray, inside: np.ndarray, direct: np.ndarray,
    ) -> np.ndarray:
        first = np.append(symbol[direct], 257)
        edges = np.searchsorted(first, np.arange(258))
        induced: list[list[np.ndarray]] = [[] for _ in range(257)]
        out = []

        def before(places: np.ndarray, c: int) -> np.ndarray:
            """L suffixes one byte before these; those of other buckets take places there."""
            p = places[places > 0] - 1
            p = p[inside[p] & ~small[p]]
            own = symbol[p]
            away = p[own > c]
            if len(away):
                kinds = symbol[away]
                by = np.argsort(kinds, kind="stable")
                kinds = kinds[by]
                cut = np.flatnonzero(np.diff(kinds)) + 1
                for part, kind in zip(np.split(away[by], cut), kinds[np.append(0, cut)]):
                    induced[kind].append(part)
            return p[own == c]

        for c in range(257):
            now = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
            induced[c] = []
            while len(now):  # a run of one byte is induced within its own bucket
                out.append(now)
                now = before(now, c)
            sorted_here = direct[edges[c]:edges[c + 1]]
            if len(sorted_here):
                out.append(sorted_here)
                before(sorted_here, c)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _common(self, order: np.ndarray) -> np.ndarray:
        common = np.zeros(len(order), np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(self.line, self.depth)
        for at in range(1, len(order), COMPARE_ROWS):
            stop = min(at + COMPARE_ROWS, len(order))
            rows = windows[order[at - 1:stop]]
            differs = rows[1:] != rows[:-1]
            where = differs.argmax(axis=1)
            common[at:stop] = np.where(differs[np.arange(len(where)), where], where, self.depth)
        return common
