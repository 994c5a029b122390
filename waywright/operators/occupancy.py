"""When a run was at a progress: its stretches in order of time, searched by trees over what progress they reach.

A run's stretches follow one another, so which of them is nearest to a time among those that
reach a progress is a search to either side of that time.  A node of a tree holds what its
stretches reach between them; nodes that don't reach the progress are passed over.
"""

from __future__ import annotations

from bisect import bisect_right

from ..functions import constants as K

#: Holds that follow one another within so many milliseconds are one.
TOUCH_MS = 0.5
Found = tuple[float, float, bool]  # how far from the time asked for, when, and whether the stretch can be trusted


class Spans:
    """Ranges of progress in order of time: the nearest to a place in the order that do, or don't, hold a progress."""

    def __init__(self, lo: list[float], hi: list[float]):
        self.n, self.size = len(lo), 1
        while self.size < max(1, self.n):
            self.size *= 2
        far, blank = float("inf"), self.size - self.n
        self.least, self.most = [far] * self.size + lo + [far] * blank, [-far] * self.size + hi + [-far] * blank  # of any
        self.high, self.low = [-far] * self.size + lo + [-far] * blank, [far] * self.size + hi + [far] * blank  # of all
        for i in range(self.size - 1, 0, -1):
            a, b = 2 * i, 2 * i + 1
            self.least[i], self.most[i] = min(self.least[a], self.least[b]), max(self.most[a], self.most[b])
            self.high[i], self.low[i] = max(self.high[a], self.high[b]), min(self.low[a], self.low[b])

    def _some(self, node: int, p: float, held: bool) -> bool:
        """Whether a range below a node may hold p, or, if not ``held``, whether one doesn't."""
        return self.least[node] <= p <= self.most[node] if held else self.high[node] > p or self.low[node] < p

    def _below(self, node: int, p: float, held: bool, last: bool) -> int:
        stack = [node]
        while stack:
            x = stack.pop()
            if self._some(x, p, held):
                if x >= self.size:
                    return x - self.size
                stack += (2 * x, 2 * x + 1) if last else (2 * x + 1, 2 * x)
        return -1

    def last(self, i: int, p: float, held: bool = True) -> int:
        """The last place up to i whose range holds p (or doesn't), -1 if there is none."""
        if i < 0:
            return -1
        node = min(i, self.n - 1) + self.size
        if (got := self._below(node, p, held, True)) >= 0:
            return got
        while node > 1:
            if node & 1 and (got := self._below(node - 1, p, held, True)) >= 0:
                return got
            node //= 2
        return -1

    def first(self, i: int, p: float, held: bool = True) -> int:
        """The first place from i on whose range holds p (or doesn't), -1 if there is none."""
        if i >= self.n:
            return -1
        node = max(0, i) + self.size
        if (got := self._below(node, p, held, False)) >= 0:
            return got
        while node > 1:
            if not node & 1 and (got := self._below(node + 1, p, held, False)) >= 0:
                return got
            node //= 2
        return -1


class Passages:
    """Stretches in one direction: each passes a progress at one moment."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows  # e0, e1, p0, p1, lo, hi, good
        self.begins = [r[0] for r in rows]
        self.spans = Spans([r[4] - K.GHOST_M for r in rows], [r[5] + K.GHOST_M for r in rows])

    def _moment(self, i: int, p: float, q: float) -> Found:
        e0, e1, p0, p1, *_, good = self.rows[i]
        e = e0 + min(1.0, max(0.0, (p - p0) / (p1 - p0))) * (e1 - e0)
        return abs(q - e), e, good

    def nearest(self, p: float, q: float) -> Found | None:
        """The moment nearest to q; of two as near the earlier, of one moment that which isn't to be trusted."""
        if not self.rows:
            return None
        here, found = bisect_right(self.begins, q) - 1, []
        for step, i in ((-1, self.spans.last(here, p)), (1, self.spans.first(here + 1, p))):
            best, more = None, 2  # the stretch around q may pass p on its other side: one more is looked at, and all of that moment
            while i >= 0 and (more or found[-1][1] == best):
                found.append(self._moment(i, p, q))
                more = max(0, more - 1)
                best = found[-1][1] if more == 0 and best is None else best
                i = self.spans.last(i - 1, p) if step < 0 else self.spans.first(i + 1, p)
        return min(found, default=None)


class Holds:
    """Stretches that stay at a progress, or about it; those that follow at once, and can be trusted alike, are one."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.begins = [r[0] for r in rows]
        self.spans = Spans([r[4] - K.GHOST_M for r in rows], [r[5] + K.GHOST_M for r in rows])
        # Where a row doesn't follow the one before it at once.
        apart = [True, *(not self._joins(i - 1, i) for i in range(1, len(rows)))]
        self.chain_start = list(range(len(rows)))
        for i in range(1, len(rows)):
            if not apart[i]:
                self.chain_start[i] = self.chain_start[i - 1]
        self.chain_end = list(range(len(rows)))
        for i in range(len(rows) - 2, -1, -1):
            if not apart[i + 1]:
                self.chain_end[i] = self.chain_end[i + 1]

    def _joins(self, a: int, b: int) -> bool:
        return self.rows[a][6] == self.rows[b][6] and self.rows[b][0] <= self.rows[a][1] + TOUCH_MS

    def _block(self, i: int, p: float) -> tuple[int, int]:
        """First and last row of the hold of p that row i is part of."""
        a = b = i
        while True:
            a = max(self.chain_start[a], self.spans.last(a, p, held=False) + 1)
            k = self.spans.last(a - 1, p)
            if k < 0 or not self._joins(k, a):
                break
            a = k
        while True:
            gap = self.spans.first(b, p, held=False)
            b = min(self.chain_end[b], gap - 1 if gap >= 0 else self.spans.n)
            k = self.spans.first(b + 1, p)
            if k < 0 or not self._joins(b, k):
                break
            b = k
        return a, b

    def around(self, p: float, q: float) -> list[tuple[float, float, bool]]:
        """The holds of p next to q, two to either side: when each begins and ends, and whether it can be trusted."""
        if not self.rows:
            return []
        here, out = bisect_right(self.begins, q) - 1, []
        i, after = self.spans.last(here, p), here + 1
        for k in range(2):
            if i < 0:
                break
            a, b = self._block(i, p)
            after = max(after, b + 1) if k == 0 else after
            out.append((self.rows[a][0], self.rows[b][1], self.rows[a][6]))
            i = self.spans.last(a - 1, p)
        i = self.spans.first(after, p)
        for _ in range(2):
            if i < 0:
                break
            a, b = self._block(i, p)
            out.append((self.rows[a][0], self.rows[b][1], self.rows[a][6]))
            i = self.spans.first(b + 1, p)
        return out


class Occupancy:
    """A run's stretches (kind, e0, e1, p0, p1, lo, hi, good), in order of time."""

    def __init__(self, rows: list[tuple]):
        of = lambda kind: [r[1:] for r in rows if r[0] == kind]
        self.holds, self.ups, self.downs = Holds(of("hold")), Passages(of("up")), Passages(of("down"))

    def at(self, p: float, q: float, in_stall: bool) -> tuple[float, bool] | None:
        """When the run was at p, for a run that was there at q, and whether that can be trusted.

        A hold that q lies in answers with q itself.  Else a run that stands still asks for the
        nearest hold, then the nearest passage; one that moves for the nearest passage upwards,
        then the nearest arrival, then the nearest passage down.
        """
        holds = self.holds.around(p, q)
        inside = [h for h in holds if h[0] <= q <= h[1]]
        if inside:
            return q, any(h[2] for h in inside)
        if in_stall:
            clamped = [(abs(q - c), c, h[2]) for h in holds for c in (min(h[1], max(h[0], q)),)]
            found = min(clamped, default=None) or min((x for x in (self.ups.nearest(p, q), self.downs.nearest(p, q)) if x), default=None)
        else:
            found = self.ups.nearest(p, q) or min(((abs(q - h[0]), h[0], h[2]) for h in holds), default=None) or self.downs.nearest(p, q)
        return found and found[1:]
