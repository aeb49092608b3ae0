"""Byte-level BPE over whole columns of text, without a loop over characters or tokens.

A batch of texts is one array of code points. Pre-tokens are found from character classes,
hashed from prefix sums of a polynomial, and looked up in a minimal perfect hash of the
vocabulary. What the vocabulary doesn't hold as a whole is merged with a heap over linked bytes.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3

# Code points with the White_Space property, the contractions of the pattern.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters handled at once; a longer text is cut where white space follows other text, which is always a token's end.
CHUNK = 1 << 19


def character_classes() -> np.ndarray:
    """The class of every code point, from the Unicode database."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(29))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class Powers:
    """Powers of the hash's base and of its inverse, as long as the longest chunk so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * CHUNK)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                out = np.full(n, base, _U)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))


_POWERS = Powers()
_LETTERS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, all from one prefix sum."""
    _POWERS.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_LETTERS[data] * _POWERS.up[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _POWERS.down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


class PerfectHash:
    """A minimal perfect hash by hash-and-displace: n keys to 0..n-1, one displacement for a bucket of about four."""

    def __init__(self, keys: np.ndarray) -> None:
        n = self.n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("keys must differ")
        self.buckets = max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        bucket = (keys % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        tries = np.arange(1, 257, dtype=np.int64)
        for b in np.argsort(-(bounds[1:] - bounds[:-1]), kind="stable"):
            own = keys[order[bounds[b] : bounds[b + 1]]]
            if len(own) == 0:
                break
            if len(own) == 1:
                break
            first = 0
            while True:
                slots = self._slot(own[None, :], (tries + first)[:, None])
                good = free[slots].all(axis=1)
                if len(own) > 1:
                    ordered = np.sort(slots, axis=1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b] = tries[k] + first
                    free[slots[k]] = False
                    break
                first += len(tries)
        left = iter(np.flatnonzero(free))
        for b in np.flatnonzero(bounds[1:] - bounds[:-1] == 1):  # a lone key is sent straight to a free slot
            self.shift[b] = -1 - int(next(left))

    def _slot(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (_mix(keys ^ (shift.astype(_U) * _U(0xA24BAED4963EE407))) % _U(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % _U(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slot(keys, shift))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class ByteBPE:
    """A byte-level BPE vocabulary of token bytes and ranks, as ``.tiktoken`` files hold it."""

    def __init__(self, ranks: dict[bytes, int], remember: int = 200_000) -> None:
        self.ranks, self.remember = ranks, remember
        tokens = list(ranks)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.begins = np.cumsum(self.lengths) - self.lengths
        hashes = span_hashes(self.data, self.begins, self.begins + self.lengths)
        self.hash = PerfectHash(hashes)
        at = self.hash(hashes)
        place = np.empty(len(tokens), np.int64)
        place[at] = np.arange(len(tokens))
        self.hashes, self.begins, self.lengths = hashes[place], self.begins[place], self.lengths[place]
        self.ids = np.array([ranks[t] for t in tokens], np.int32)[place]
        self.kinds = character_classes()
        self.pool: dict[bytes, np.ndarray] = {}

    @classmethod
    def read(cls, path: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank is joined first, the leftmost of equals."""
        n = len(word)
        if n == 1:
            return [self.ranks[word]]
        ranks = self.ranks
        end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is joined to the part before
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle == 0 or middle >= n or end[middle] != stop:
                continue  # one of the two parts has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := ranks.get(word[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def pretokens(self, points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; ``fresh`` marks the first character of each text."""
        n = len(points)
        kind = self.kinds[points]
        run = fresh.copy()
        run[0] = True
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        inside = ~fresh[1:]  # position i+1 is in the same text as i
        space = kind == SPACE
        word_after_space = space[:-1] & ~space[1:] & inside
        start[:-1] |= word_after_space  # the last white space before a word stands alone or goes with the word
        start[1:] &= ~(word_after_space & (points[:-1] == 0x20))
        marks = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & inside)
        if len(marks):
            one = points[marks + 1]
            two = np.where(marks + 2 < n, points[np.minimum(marks + 2, n - 1)], 0)
            same = (marks + 2 < n) & ~fresh[np.minimum(marks + 2, n - 1)]
            size = np.where(np.isin(one, [ord(c) for c in ONE_LETTER]), 1, 0)
            for a, b in TWO_LETTERS:
                size = np.where((one == ord(a)) & (two == ord(b)) & same, 2, size)
            marks, size = marks[size > 0], size[size > 0]
            start[marks + 1] = False
            after = marks + 1 + size
            start[after[after < n]] = True
        return np.flatnonzero(start)

    def _chunk(self, points: np.ndarray, data: np.ndarray, fresh: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, and how many each of them has."""
        at = self.pretokens(points, fresh)
        if len(data) == len(points):
            starts = at
        else:
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            starts = (np.cumsum(width) - width)[at]
        ends = np.append(starts[1:], len(data))
        sizes = ends - starts
        hashes = span_hashes(data, starts, ends)
        slot = self.hash(hashes)
        hit = (self.hashes[slot] == hashes) & (self.lengths[slot] == sizes)
        w = np.flatnonzero(hit)  # equal hashes are checked byte for byte
        same = self.data[_ragged(self.begins[slot[w]], sizes[w])] == data[_ragged(starts[w], sizes[w])]
        if not same.all():
            hit[w[np.logical_and.reduceat(same, np.cumsum(sizes[w]) - sizes[w]) == False]] = False  # noqa: E712
        count = np.ones(len(at), np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            raw, pool = data.tobytes(), self.pool
            if len(pool) > self.remember:
                pool.clear()
            parts = []
            for s, e in zip(starts[miss].tolist(), ends[miss].tolist()):
                word = raw[s:e]
                if (ids := pool.get(word)) is None:
                    ids = np.array(self.merge(word), np.int32)
                    if e - s <= 64:
                        pool[word] = ids
                parts.append(ids)
            count[miss] = [len(x) for x in parts]
        total = np.cumsum(count)
        out = np.empty(int(total[-1]) if len(total) else 0, np.int32)
        out[(total - 1)[hit]] = self.ids[slot[hit]]
        if len(miss):
            out[_ragged((total - count)[miss], count[miss])] = np.concatenate(parts)
        bounds = np.append(np.searchsorted(at, text_starts), len(at))
        return out, np.diff(np.concatenate(([0], total))[bounds])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each text; null and empty texts have none."""
        ids, numbers = [], np.zeros(len(texts), np.int64)
        for pieces, owners in _pieces(texts):
            joined = "".join(pieces)
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            data = np.frombuffer(joined.encode(), np.uint8)
            sizes = np.array([len(p) for p in pieces], np.int64)
            begins = np.cumsum(sizes) - sizes
            fresh = np.zeros(len(points), bool)
            fresh[begins] = True
            out, n = self._chunk(points, data, fresh, begins)
            ids.append(out)
            np.add.at(numbers, owners, n)
        return (np.concatenate(ids) if ids else np.empty(0, np.int32)), numbers


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Non-empty pieces of the texts in order, about CHUNK characters at a time, with the number of their text."""
    pieces, owners, size = [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > CHUNK:
                stop = _cut(text, at + CHUNK)
            pieces.append(text[at:stop] if at or stop < len(text) else text)
            owners.append(k)
            size += stop - at
            at = stop
            if size >= CHUNK:
                yield pieces, owners
                pieces, owners, size = [], [], 0
    if pieces:
        yield pieces, owners


_SPACES = frozenset(map(chr, WHITE_SPACE))


def _cut(text: str, near: int) -> int:
    """The first place from ``near`` where white space follows something else."""
    i, spaces = near, _SPACES
    while i < len(text) and not (text[i] in spaces and text[i - 1] not in spaces):
        i += 1
    return i
