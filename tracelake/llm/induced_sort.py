"""External induced suffix sorting of a byte string, the task-side helper of the exact substring operator.

Suffixes are L-type (greater than the next suffix) or S-type; the leftmost S-type ones (LMS) are sorted first, and every other
suffix is induced from its successor. The priority queue of (first byte, rank) pairs holds ranks in the order of insertion, so
it is one first-in-first-out queue a byte, kept on disk beyond ``memory_bytes``. LMS substrings are sorted by the same
induction and named; where names repeat, the reduced string is sorted by doubling, to the depth that the caller asks for.
Arrays of the size of the text are disk-backed maps beyond a limit.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Places in a shard's text: shards stay below 2 GB.
POSITION = np.int32


class Queues:
    """A first-in-first-out queue of positions for each byte value; contents above the limit go to files."""

    def __init__(self, folder: str, name: str, memory_bytes: int):
        self.folder, self.most = tempfile.mkdtemp(prefix=f"{name}-", dir=folder), memory_bytes
        self.parts: list[list] = [[] for _ in range(256)]
        self.held = 0

    def put(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        """Adds positions behind the queues of their symbols, in the given order."""
        if not len(positions):
            return
        positions = positions[np.argsort(symbols, kind="stable")]
        at = 0
        for c, n in enumerate(np.bincount(symbols, minlength=256).tolist()):
            if n:
                self.parts[c].append(positions[at : at + n])
                at += n
        self.grown(positions.nbytes)

    def append(self, symbol: int, positions: np.ndarray) -> None:
        """Adds positions behind the queue of one symbol."""
        self.parts[symbol].append(positions)
        self.grown(positions.nbytes)

    def grown(self, size: int) -> None:
        self.held += size
        if self.held > self.most:
            self.spill()

    def spill(self) -> None:
        for c, parts in enumerate(self.parts):
            if fresh := [p for p in parts if isinstance(p, np.ndarray)]:
                with open(os.path.join(self.folder, str(c)), "ab") as f:
                    for p in fresh:
                        f.write(np.ascontiguousarray(p, POSITION).tobytes())
                self.parts[c] = [sum(len(p) if isinstance(p, np.ndarray) else p for p in parts)]
        self.held = 0

    def drop(self) -> None:
        self.parts = [[] for _ in range(256)]
        shutil.rmtree(self.folder)

    def take(self, symbol: int) -> np.ndarray:
        """Everything in a symbol's queue, which is then empty."""
        parts, self.parts[symbol] = self.parts[symbol], []
        out = []
        for p in parts:
            if isinstance(p, np.ndarray):
                out.append(p)
                self.held -= p.nbytes
            else:
                path = os.path.join(self.folder, str(symbol))
                out.append(np.fromfile(path, POSITION))
                os.remove(path)
        return np.concatenate(out) if len(out) > 1 else out[0] if out else np.empty(0, POSITION)


def disk_array(folder: str, name: str, kind, size: int, memory_bytes: int = 48 << 20) -> np.ndarray:
    """An array, on disk if it is larger than ``memory_bytes``."""
    if size * np.dtype(kind).itemsize <= memory_bytes:
        return np.empty(size, kind)
    return np.asarray(np.memmap(os.path.join(folder, name), kind, "w+", shape=(size,)))


def suffix_types(text: np.ndarray, out: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type. The end of the text counts as smaller than any byte."""
    n = len(text)
    if not n:
        return out
    differs = np.r_[text[:-1] != text[1:], True]
    rises = np.r_[text[:-1] < text[1:], False]
    next_change = np.where(differs, np.arange(n), n - 1)
    next_change = np.minimum.accumulate(next_change[::-1])[::-1]
    out[:] = rises[next_change]
    return out


def induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, folder: str, memory_bytes: int) -> tuple[Queues, Queues]:
    """All suffixes in order from the LMS ones in order: queues of L-type (ascending) and S-type (descending) suffixes by byte."""
    given = Queues(folder, "seed", memory_bytes)
    given.put(text[seeds], seeds)
    pending, done_l = Queues(folder, "l", memory_bytes), Queues(folder, "L", memory_bytes)
    if len(text):  # the last suffix is L-type and induced by the end of the text
        pending.put(text[-1:], np.array([len(text) - 1], POSITION))

    def feed(queue: Queues, source: np.ndarray, kind: bool, c: int) -> np.ndarray:
        """Queues the predecessors of the wanted type; those that begin with ``c`` again are the next wave."""
        before = source[source > 0] - 1
        before = before[is_s[before] == kind]
        first = text[before]
        same = first == c
        queue.put(first[~same], before[~same])
        return before[same]

    for c in range(256):
        wave = pending.take(c)
        while len(wave):
            done_l.append(c, wave)
            wave = feed(pending, wave, False, c)
        feed(pending, given.take(c), False, c)
    pending, done_s, kept_l = Queues(folder, "s", memory_bytes), Queues(folder, "S", memory_bytes), Queues(folder, "K", memory_bytes)
    for c in range(255, -1, -1):
        wave = pending.take(c)
        while len(wave):
            done_s.append(c, wave)
            wave = feed(pending, wave, True, c)
        own = done_l.take(c)
        kept_l.append(c, own)
        feed(pending, own[::-1], True, c)
    return kept_l, done_s


def prefix_hashes(text: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums for hashes of any substring, and the powers of the base's inverse. ``out`` has one place more than the text."""
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 2**64)
    powers = powers_of(base, len(text))
    out[0] = 0
    with np.errstate(over="ignore"):
        out[1:] = np.cumsum((text.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(0x632BE59BD9B4E019)) * powers, dtype=np.uint64)
    return out, powers_of(inverse, len(text) + 1)


_powers: dict[int, np.ndarray] = {}


def powers_of(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1), np.uint64)
        done = 1
        with np.errstate(over="ignore"):
            while done < len(have):
                step = min(done, len(have) - done)
                have[done : done + step] = have[:step] * np.uint64(pow(base, done, 2**64))
                done += step
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def substring_hashes(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (sums[stop] - sums[start]) * inverse[start]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def sort_reduced(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the reduced string to ``depth`` names at least, by doubling.

    A suffix's rank is the place in the order where its group begins, so groups are split in place, and only suffixes of groups
    of two or more are looked at again.
    """
    n = len(names)
    order = np.argsort(names)
    first = np.r_[True, names[order][1:] != names[order][:-1]]
    start = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
    reach = 1
    while reach < depth:
        tied = np.flatnonzero(~(first & np.r_[first[1:], True]))
        if not len(tied):
            break
        at = order[tied]
        ahead = at + reach
        key = rank[at] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        own = np.argsort(key)
        at, key = at[own], key[own]
        order[tied] = at
        first[tied] = np.r_[True, key[1:] != key[:-1]]
        new = first[tied]
        begins = tied[np.flatnonzero(new)]
        rank[at] = np.repeat(begins, np.diff(np.r_[np.flatnonzero(new), len(tied)]))
        reach *= 2
    return order


def sorted_suffixes(text: np.ndarray, folder: str, depth: int = 200, memory_bytes: int = 64 << 20):
    """Yields the suffixes in order, bucket by bucket; suffixes that agree in ``depth`` bytes may come in any order."""
    n = len(text)
    is_s = suffix_types(text, disk_array(folder, "types", np.bool_, n, memory_bytes))
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(POSITION)
    if len(lms):
        unused, found = induce(text, is_s, lms, folder, memory_bytes)
        number = disk_array(folder, "lms", POSITION, n, memory_bytes)
        number[:] = -1
        number[lms] = np.arange(len(lms), dtype=POSITION)
        ordered = []
        for c in range(256):
            part = number[found.take(c)[::-1]]
            ordered.append(part[part >= 0])
        index = np.concatenate(ordered)
        order = lms[index]
        unused.drop()
        found.drop()
        # the LMS substring reaches to the next LMS position, that byte included
        stop = np.minimum(np.r_[lms[1:], n - 1][index] + 1, n)
        sums, inverse = prefix_hashes(text, disk_array(folder, "sums", np.uint64, n + 1, memory_bytes))
        h = substring_hashes(sums, inverse, order, stop)
        length = stop - order
        new = np.r_[True, (h[1:] != h[:-1]) | (length[1:] != length[:-1])]
        named = np.cumsum(new) - 1
        if named[-1] + 1 < len(order):
            names = np.empty(len(lms), np.int64)
            names[index] = named
            order = lms[sort_reduced(names, -(-depth // 2))]  # LMS places are two bytes apart at least
    else:
        order = lms
    low, high = induce(text, is_s, order, folder, memory_bytes)
    for c in range(256):
        yield low.take(c)
        yield high.take(c)[::-1]
