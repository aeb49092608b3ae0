"""A trie searched with a Levenshtein automaton that also takes a swap of neighbours as one error."""

from __future__ import annotations


class Automaton:
    """The automaton of all words within ``most`` errors, independent of the word.

    A state is a set of (letters of the word used beyond the base, errors, waiting for the other half of a swap).
    It reads, for each letter of an entry, where in the next letters of the word that letter occurs. Transitions are
    worked out when first needed and kept: there are few states, whatever the words.
    """

    def __init__(self, most: int) -> None:
        self.most = most
        self.width = 2 * most + 2
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: dict[tuple[int, int, int], tuple[int, int]] = {}
        #: For each state, as bits, how many more letters than the word has from the base (plus ``shift``) an entry may still have.
        self.reach: list[int] = []
        self.shift = self.width + most + 1
        self.start = self._id(frozenset({(0, 0, 0)}))

    def _id(self, state: frozenset) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            more = {e - i - swap for i, errors, swap in state for e in range(errors - self.most, self.most - errors + 1)}
            self.reach.append(sum(1 << m + self.shift for m in more))
        return self.number[state]

    def move(self, state: int, seen: int, left: int) -> tuple[int, int]:
        """(new state, letters the base moves on); state -1 is the empty one. ``left``: letters of the word from the base, at most width."""
        key = (state, seen, left)
        if (out := self.moves.get(key)) is not None:
            return out
        after = set()
        for i, e, swap in self.states[state]:
            if swap:
                if seen >> i & 1:
                    after.add((i + 2, e, 0))
                continue
            if i < left and seen >> i & 1:
                after.add((i + 1, e, 0))
            if e < self.most:
                after.add((i, e + 1, 0))
                if i < left:
                    after.add((i + 1, e + 1, 0))
                for d in range(1, self.most - e + 1):
                    if i + d < left and seen >> (i + d) & 1:
                        after.add((i + d + 1, e + d, 0))
                if i + 1 < left and seen >> (i + 1) & 1:
                    after.add((i, e + 1, 1))
        kept = {p for p in after if not any(q != p and not q[2] and q[1] < p[1] and abs(q[0] - p[0]) <= p[1] - q[1] for q in after if not p[2])}
        if not kept:
            out = (-1, 0)
        else:
            base = min(p[0] for p in kept)
            out = (self._id(frozenset((i - base, e, s) for i, e, s in kept)), base)
        self.moves[key] = out
        return out

    def errors(self, state: int, left: int) -> int:
        """The least number of errors with which an entry may end here; more than ``most`` if it may not."""
        return min((e + left - i for i, e, s in self.states[state] if not s and i <= left), default=self.most + 1)


class Trie:
    """Words with values; several values and several words for a value (its aliases) may be given."""

    def __init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.values: list[set] = [set()]
        #: For each node, as bits, how many letters the words below it still have.
        self.rest: list[int] = [0]

    def add(self, word: str, value: object) -> None:
        at = 0
        self.rest[0] |= 1 << len(word)
        for i, c in enumerate(word):
            to = self.children[at].get(c)
            if to is None:
                to = self.children[at][c] = len(self.children)
                self.children.append({})
                self.values.append(set())
                self.rest.append(0)
            at = to
            self.rest[at] |= 1 << len(word) - i - 1
        self.values[at].add(value)

    def search(self, word: str, automaton: Automaton) -> dict[object, int]:
        """The values of all entries within the automaton's errors, with the least number of errors of each.

        Branches of which no word has a length that the errors left allow aren't entered.
        """
        found: dict[object, int] = {}
        n, width = len(word), automaton.width
        if n > self.rest[0].bit_length() - 1 + automaton.most:  # longer than any word by more than that
            return found
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        mask = (1 << width) - 1
        move, children, values = automaton.move, self.children, self.values
        moves, seen = automaton.moves, places.get
        reach, rest, shift = automaton.reach, self.rest, automaton.shift
        stack = [(0, automaton.start, 0)]
        while stack:
            node, state, base = stack.pop()
            if values[node]:
                e = automaton.errors(state, n - base)
                if e <= automaton.most:
                    for v in values[node]:
                        if e < found.get(v, automaton.most + 1):
                            found[v] = e
            left = n - base
            if left > width:
                left = width
            for c, to in children[node].items():
                key = (state, (seen(c, 0) >> base) & mask, left)
                step = moves.get(key)
                if step is None:
                    step = move(*key)
                if step[0] >= 0:
                    at = base + step[1]
                    if rest[to] << shift >> n - at & reach[step[0]]:
                        stack.append((to, step[0], at))
        return found
