"""String automata: (generalised) suffix automaton, delimiter stack, phrase automaton."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator, Sequence


class SuffixAutomaton:
    """Suffix automaton of one or several sequences of hashable tokens.

    States are numbers; 0 is the root. `trans[s]` maps a token to a state, `link[s]` is the suffix link, `length[s]`
    the longest string of the state. With several sequences, `ends` holds for each prefix state the (sequence, position)
    pairs where it ends, and `occurrences` gives those of any state.
    """

    def __init__(self, sequences: Iterable[Sequence[Hashable]]) -> None:
        self.trans: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, seq in enumerate(sequences):
            last = 0
            for at, token in enumerate(seq):
                last = self._extend(last, token)
                self.ends[last].append((number, at))
        self._order: list[tuple[int, int]] | None = None

    def _new(self, length: int, trans: dict, link: int) -> int:
        self.trans.append(trans)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.trans) - 1

    def _split(self, p: int, token: Hashable, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.trans[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.trans[p].get(token) == q:
            self.trans[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: Hashable) -> int:
        if (q := self.trans[last].get(token)) is not None:  # only when a further sequence begins like an earlier one
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        cur, p = self._new(self.length[last] + 1, {}, 0), last
        while p != -1 and token not in self.trans[p]:
            self.trans[p][token] = cur
            p = self.link[p]
        if p != -1:
            q = self.trans[p][token]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return cur

    def occurrences(self, state: int) -> list[tuple[int, int]]:
        """All (sequence, end position) at which the strings of `state` end."""
        if self._order is None:
            children: list[list[int]] = [[] for _ in self.trans]
            for s, parent in enumerate(self.link):
                if parent >= 0:
                    children[parent].append(s)
            self._flat: list[tuple[int, int]] = []
            self._order = [(0, 0)] * len(self.trans)
            stack: list[tuple[int, bool]] = [(0, False)]
            begin = [0] * len(self.trans)
            while stack:
                s, done = stack.pop()
                if done:
                    self._order[s] = (begin[s], len(self._flat))
                else:
                    begin[s] = len(self._flat)
                    self._flat += self.ends[s]
                    stack.append((s, True))
                    stack += [(c, False) for c in children[s]]
        a, b = self._order[state]
        return self._flat[a:b]

    def shared(self, tokens: Iterable[Hashable], least: int) -> Iterator[tuple[int, int, int, int]]:
        """(end, sequence, position, length): for every place of `tokens` and every sequence, each position at which
        both have a common ending of at least `least` tokens, and how long the longest is. Complete: what ends inside a
        longer match of another sequence is given too, as the suffix links hold it. The positions of a state lie within
        those of its link, so each is given once."""
        if self._order is None:
            self.occurrences(0)
        s, n = 0, 0
        trans, link, length, order, flat = self.trans, self.link, self.length, self._order, self._flat
        for at, token in enumerate(tokens):
            while s and token not in trans[s]:
                s = link[s]
                n = length[s]
            q = trans[s].get(token)
            if q is None:
                s, n = 0, 0
                continue
            s, n = q, n + 1
            if n < least:
                continue
            a, b = order[s]
            for k, e in flat[a:b]:
                yield at, k, e, n
            r = link[s]
            while r > 0 and (m := length[r]) >= least:
                x, y = order[r]
                for k, e in flat[x:a]:
                    yield at, k, e, m
                for k, e in flat[b:y]:
                    yield at, k, e, m
                a, b, r = x, y, link[r]

    def matches(self, tokens: Iterable[Hashable], least: int) -> list[tuple[int, int, int]]:
        """(end position, length, state) of every match of at least `least` tokens that the next token does not
        prolong; shorter ones ending at the same place are left to the caller (suffix links)."""
        out, s, n, at = [], 0, 0, -1
        trans, link, length = self.trans, self.link, self.length
        for at, token in enumerate(tokens):
            q = trans[s].get(token)
            if q is None:
                if n >= least:
                    out.append((at - 1, n, s))
                while s and (q := trans[s].get(token)) is None:
                    s = link[s]
                    n = length[s]
                if q is None:
                    q = trans[s].get(token)
                if q is None:
                    s, n = 0, 0
                    continue
            s, n = q, n + 1
        if n >= least:
            out.append((at, n, s))
        return out

    def coverage(self, tokens: Sequence[Hashable], least: int) -> int:
        """How many of `tokens` lie in matches of at least `least` tokens."""
        covered, upto = 0, -1
        for end, n, _ in self.matches(tokens, least):
            covered += end - max(upto, end - n)
            upto = end
        return covered


PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "”": "“", "】": "【", "」": "「"}


def open_delimiters(text: str) -> list[str]:
    """The brackets and quotes of `text` that are still open at its end, outermost first; a closing one that fits none
    is passed over, and double quotes open and close in turn."""
    stack: list[str] = []
    for c in text:
        if c in "([{（“【「":
            stack.append(c)
        elif c in PAIRS:
            if PAIRS[c] in stack:
                while stack.pop() != PAIRS[c]:
                    pass
        elif c == '"':
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            else:
                stack.append(c)
    return stack


class PhraseAutomaton:
    """Finds any of a set of phrases in one pass over a text."""

    def __init__(self, phrases: Iterable[str]) -> None:
        import ahocorasick

        self.a = ahocorasick.Automaton()
        for p in phrases:
            self.a.add_word(p, p)
        self.a.make_automaton()

    def find(self, text: str) -> list[str]:
        return [p for _, p in self.a.iter(text)]
