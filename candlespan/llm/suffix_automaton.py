"""A generalised suffix automaton over the word sequences of several items.

Words are numbered; a transition is one entry `state << 32 | word` of a dictionary. A state stands for the substrings that end
at the same places of the items; `length` is the longest of them and `link` the state of the longest suffix that ends at more
places. `windows` lists, for each state, the windows that are suffixes of its longest string: their length and items.
"""

from __future__ import annotations

import re

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased. On UTF-8 bytes, as every byte of a character beyond ASCII belongs to words."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class SuffixAutomaton:
    def __init__(self, items: list[tuple[str, str | None]], window: int = 10):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.go: dict[int, int] = {}
        self.link, self.length, self._out = [-1], [0], [[]]
        numbered = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]) for name, text in items]
        numbered = [(name, words) for name, words in numbered if words]
        for _, words in numbered:
            last = 0
            for w in words:
                last = self._extend(last, w)
        del self._out
        self._mark(numbered)

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append([])
        return len(self.length) - 1

    def _put(self, state: int, word: int, to: int) -> None:
        if (key := state << 32 | word) not in self.go:
            self._out[state].append(word)
        self.go[key] = to

    def _split(self, state: int, word: int, old: int) -> int:
        """The state for the `old` strings that are no longer than one word more than `state`'s."""
        if self.length[old] == self.length[state] + 1:
            return old
        new = self._state(self.length[state] + 1, self.link[old])
        for w in self._out[old]:
            self._put(new, w, self.go[old << 32 | w])
        self.link[old] = new
        while state >= 0 and self.go.get(state << 32 | word) == old:
            self._put(state, word, new)
            state = self.link[state]
        return new

    def _extend(self, last: int, word: int) -> int:
        if (known := self.go.get(last << 32 | word)) is not None:
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0)
        while last >= 0 and (last << 32 | word) not in self.go:
            self._put(last, word, new)
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.go[last << 32 | word])
        return new

    def _mark(self, numbered: list[tuple[str, list[int]]]) -> None:
        own: dict[int, dict[int, set[str]]] = {}
        for name, words in numbered:
            state, seen = 0, set()
            for w in words:
                state = self.go[state << 32 | w]
                up = state
                while up > 0 and up not in seen:
                    seen.add(up)
                    if self.length[self.link[up]] < self.window <= self.length[up]:
                        own.setdefault(up, {}).setdefault(self.window, set()).add(name)
                    up = self.link[up]
            if len(words) < self.window:
                own.setdefault(state, {}).setdefault(len(words), set()).add(name)
        self.windows: list[tuple[tuple[int, tuple[str, ...]], ...]] = [()] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            mine = tuple((n, tuple(sorted(x))) for n, x in sorted(own.get(state, {}).items()))
            self.windows[state] = self.windows[self.link[state]] + mine
        #: The shortest window of each state; no match shorter than it can report anything.
        self.least = [w[0][0] if w else 1 << 30 for w in self.windows]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint (first, end) word spans covered by occurrences of windows, and the items they belong to."""
        get, go, link, length, least = self.vocabulary.get, self.go.get, self.link, self.length, self.least
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = matched = 0
        for i, word in enumerate(words):
            w = get(word)
            if w is None:
                state = matched = 0
                continue
            to = go(state << 32 | w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = go(state << 32 | w)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            if matched >= least[state]:
                for n, names in self.windows[state]:
                    if n <= matched:
                        items.update(names)
                        longest = n
                first = i + 1 - longest
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))
        return spans, items
