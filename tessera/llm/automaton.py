"""Suffix automaton over word numbers, built on-line, with the first place of every state."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """Holds every substring of the sequences added so far. A state's `first` is the end of its earliest occurrence,
    as the sequences were added; sequences are parted by a mark that no sequence holds."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last, self.size, self.marks = 0, 0, -1

    def extend(self, x: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[self.last] + 1)
        first.append(self.size)
        self.size += 1
        p = self.last
        while p != -1 and x not in nxt[p]:
            nxt[p][x] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][x]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p != -1 and nxt[p].get(x) == q:
                    nxt[p][x] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def add(self, sequence: Iterable[int]) -> int:
        """Append a sequence and a mark; where it starts."""
        at = self.size
        for x in sequence:
            self.extend(x)
        self.extend(self.marks)
        self.marks -= 1
        return at

    def matches(self, sequence: list[int], least: int) -> list[int]:
        """For each start of `least` consecutive words, the end of their earliest occurrence, or -1: matching
        statistics, cut back to the state that holds the last `least` words."""
        nxt, link, length = self.next, self.link, self.length
        state = have = 0
        out = []
        for i, x in enumerate(sequence):
            while state and x not in nxt[state]:
                state = link[state]
                have = length[state]
            if x in nxt[state]:
                state = nxt[state][x]
                have += 1
            while state and length[link[state]] >= least:
                state = link[state]
                have = length[state]
            if i + 1 >= least:
                out.append(self.first[state] if have >= least else -1)
        return out
