"""Do two neighbouring tokens of a merge vocabulary stay apart when merged afresh?

A token has one history: the merges that build it, each with its rank (lower ranks go
first, the leftmost among equals). Only the parts that touch the seam matter: the right
edge of the left token and the left edge of the right one, each from its single symbol
up to the whole token, with the rank at which it is swallowed by the next. Two edge
parts that exist at the same time and may merge, before either is swallowed, break the
seam; if no such two exist, the tokens stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

NEVER = float("inf")


class Seams:
    """Seam checks for one vocabulary; rank(x, y) is the rank at which x and y merge, or None."""

    def __init__(self, rank: Callable[[str, str], float | None], keep: int = 300_000):
        self.rank, self.keep = rank, keep
        self.history: dict[str, tuple[list, list] | None] = {}
        self.known: dict[tuple[str, str], bool] = {}

    def merge(self, symbols: Sequence[str]) -> list[str]:
        """Plain merging of a short sequence."""
        return self._merge(symbols)[0]

    def _merge(self, symbols: Sequence[str]):
        parts = list(symbols)
        edges = [([(p, NEVER)], [(p, NEVER)]) for p in parts]
        ranks = [self.rank(a, b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts, edges
            whole = parts[at] + parts[at + 1]
            (left, _), (_, right) = edges[at], edges[at + 1]
            left, right = ([*e[:-1], (e[-1][0], best), (whole, NEVER)] for e in (left, right))
            parts[at : at + 2], edges[at : at + 2] = [whole], [(left, right)]
            ranks[at : at + 2] = [self.rank(whole, parts[at + 1])] if at + 1 < len(parts) else []
            if at:
                ranks[at - 1] = self.rank(parts[at - 1], whole)

    def edges(self, token: str) -> tuple[list, list] | None:
        """The left and the right edge of a token, or None if merging doesn't build it."""
        if token not in self.history:
            parts, edges = self._merge(token)
            self.history[token] = edges[0] if len(parts) == 1 else None
        return self.history[token]

    def apart(self, a: str, b: str) -> bool:
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > self.keep:
                self.known.clear()
            got = self.known[a, b] = self._apart(self.edges(a)[1], self.edges(b)[0])
        return got

    def _apart(self, left: list, right: list) -> bool:
        rank, i, j = self.rank, 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            r = rank(x, y)
            if r is not None and r < x_ends and r <= y_ends:  # among equals the leftmost goes first
                return False
            if x_ends <= y_ends:
                if x_ends == NEVER:
                    return True
                i += 1
            else:
                j += 1
