"""Suffix automaton over sequences of hashable items."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """Accepts every run of consecutive items of the sequences added to it."""

    def __init__(self):
        self.length, self.link = [0], [-1]
        self.moves: list[dict[Hashable, int]] = [{}]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.moves.append(moves)
        return len(self.length) - 1

    def _split(self, p: int, item: Hashable) -> int:
        """The state of the longest run ending with the move from p, split off where it is shorter."""
        length, link, moves = self.length, self.link, self.moves
        q = moves[p][item]
        if length[p] + 1 == length[q]:
            return q
        clone = self._state(length[p] + 1, link[q], dict(moves[q]))
        link[q] = clone
        while p >= 0 and moves[p].get(item) == q:
            moves[p][item] = clone
            p = link[p]
        return clone

    def add(self, sequence: Iterable[Hashable]) -> None:
        length, link, moves = self.length, self.link, self.moves
        last = 0
        for item in sequence:
            if item in moves[last]:
                last = self._split(last, item)
                continue
            new = self._state(length[last] + 1, 0, {})
            p = last
            while p >= 0 and item not in moves[p]:
                moves[p][item] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, item)
            last = new

    def matching(self, sequence: Sequence[Hashable]) -> Iterable[int]:
        """For every place, the length of the longest accepted run that ends there."""
        length, link, moves = self.length, self.link, self.moves
        state = matched = 0
        for item in sequence:
            after = moves[state].get(item)
            while after is None and state:
                state = link[state]
                matched = length[state]
                after = moves[state].get(item)
            if after is None:
                matched = 0
            else:
                state = after
                matched += 1
            yield matched
