"""Suffix arrays by external induced sorting: arrays and queues that go to disk where they outgrow memory.

Suffixes that are smaller than the next but follow one that is not (S*) are put
in order first: their substrings are sorted (as tuples of their names where these
fit in memory, else by inducing), named, and where names repeat the sequence of
names is sorted the same way, or in memory once it fits. From these, one ascending
and one descending scan induce all others. A scan takes suffix tuples (name,
position) from a priority queue and puts the tuple of the position before back
into it, under a name that is never behind. The queue keeps ranges of names
apart; tuples of one name leave in the order in which they came, which is the
order of what follows them. Tuples are taken in runs: as long as no tuple
comes after the smallest name that those before it put back.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples of a range of names that is sorted in memory at once; tuples taken from the queue at once.
RANGE, TAKEN = 1 << 14, 1 << 16
#: Positions of a text of names that is sorted in memory, by doubling, where the recursion ends; substrings sorted as tuples.
FEW, TUPLES = 1 << 21, 1 << 22
NEVER, NARROW = np.iinfo(np.int64).max // 4, np.iinfo(np.uint16).max


class Store:
    """Arrays in memory up to room bytes in all; further ones in files, which go when the store is closed."""

    def __init__(self, room: int):
        self.room, self.files = room, []

    def array(self, n: int, kind: type) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.room:
            self.room -= size
            return np.empty(n, kind)
        self.files.append(tempfile.TemporaryFile())
        return np.memmap(self.files[-1], kind, "w+", shape=(n,))

    def free(self, array: np.ndarray) -> None:
        if not isinstance(array, np.memmap):
            self.room += array.nbytes

    def close(self) -> None:
        for f in self.files:
            f.close()


class Queue:
    """Tuples (name, position) by ranges of names, each in the order they came in; those over room bytes are in files."""

    def __init__(self, bounds: np.ndarray, room: int):
        self.bounds, self.room, self.held = bounds, room, 0
        self.memory: list[list[np.ndarray]] = [[] for _ in bounds]
        self.file: dict[int, tuple] = {}

    def push(self, names: np.ndarray, positions: np.ndarray) -> None:
        """names ascend."""
        if not len(names):
            return
        at = np.searchsorted(self.bounds, names, side="right") - 1
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
            part = np.stack([names[a:b], positions[a:b]], axis=1)
            self.memory[at[a]].append(part)
            self.held += part.nbytes
        if self.held > self.room:
            for r, parts in enumerate(self.memory):
                if parts:
                    file = self.file.setdefault(r, tempfile.TemporaryFile())
                    for p in parts:
                        p.tofile(file)
                    self.memory[r] = []
            self.held = 0

    def take(self, r: int) -> np.ndarray:
        """All tuples of a range so far; they leave the queue."""
        parts, self.memory[r] = self.memory[r], []
        self.held -= sum(p.nbytes for p in parts)
        if r in self.file:
            with self.file.pop(r) as file:
                file.seek(0)
                parts = [np.fromfile(file, np.int64).reshape(-1, 2), *parts]
        return np.concatenate(parts) if parts else np.empty((0, 2), np.int64)


def is_small(text: np.ndarray, store: Store) -> np.ndarray:
    """True for each position whose suffix is smaller than the next position's; the last counts as such."""
    n = len(text)
    small, after = store.array(n, bool), True
    small[n - 1] = True
    for b in range(n - 1, 0, -RANGE):
        a = max(0, b - RANGE)
        here, there = text[a:b].astype(np.int64), text[a + 1 : b + 1].astype(np.int64)
        decided = np.concatenate([np.sign(there - here), [1 if after else -1]])[::-1]
        last = np.maximum.accumulate(np.where(decided != 0, np.arange(len(decided)), 0))
        small[a:b] = (decided[last] > 0)[::-1][: b - a]
        after = small[a]
    return small


def ranges(text: np.ndarray, top: int) -> np.ndarray:
    """First names of ranges that hold about RANGE positions each; a name with more has one of its own."""
    counts = np.zeros(top + 1, np.int64)
    for a in range(0, len(text), 1 << 20):
        counts += np.bincount(text[a : a + (1 << 20)], minlength=top + 1)
    slot = np.cumsum(counts) // RANGE
    alone = counts >= RANGE
    slot += np.cumsum(alone) + np.concatenate([[0], np.cumsum(alone)[:-1]])
    return np.flatnonzero(np.diff(slot, prepend=-1))


def induce(text: np.ndarray, top: int, small: np.ndarray, seeds: np.ndarray, up: bool, store: Store, room: int) -> np.ndarray:
    """Positions in order: ascending, of the suffixes that are not small, from seeds that are; or descending, of all, from those that are not small.

    seeds stand in the order of the scan.
    """
    name = (lambda p: text[p].astype(np.int64)) if up else (lambda p: top - text[p].astype(np.int64))
    bounds = ranges(text, top)
    if not up:
        bounds = np.unique(np.concatenate([[0], top + 1 - bounds[bounds > 0]]))
    queue = Queue(bounds, room)
    n = int(small.sum())
    out, filled, seed = store.array(len(text) - n if up else len(text), np.int64), 0, 0

    def put_back(keys: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(names, positions) that tuples in this order put back, and how many can be taken; keys are twice the names, and one more for seeds."""
        before = positions - 1
        own = (before >= 0) & (small[before] != up)
        target = np.full(len(before), NEVER)
        target[own] = name(before[own])
        late = np.flatnonzero(keys[1:] > 2 * np.minimum.accumulate(target)[:-1])
        m = int(late[0]) + 1 if len(late) else len(keys)
        narrow = np.minimum(target[:m], NARROW).astype(np.uint16) if top < NARROW else target[:m]
        order = np.argsort(narrow, kind="stable")[: int(own[:m].sum())]
        return target[:m][order], before[:m][order], m

    for r, low in enumerate(bounds):
        high = int(bounds[r + 1]) if r + 1 < len(bounds) else top + 1
        end = seed
        while end < len(seeds):  # seeds of this range
            more = name(seeds[end : end + TAKEN]) >= high
            end += int(more.argmax()) if more.any() else len(more)
            if more.any():
                break
        if high == low + 1:
            while len(taken := queue.take(r)):
                for a in range(0, len(taken), TAKEN):
                    part = taken[a : a + TAKEN]
                    names, positions, _ = put_back(2 * part[:, 0], part[:, 1])
                    queue.push(names, positions)
                    out[filled : filled + len(part)] = part[:, 1]
                    filled += len(part)
            for a in range(seed, end, TAKEN):
                part = seeds[a : min(end, a + TAKEN)]
                queue.push(*put_back(np.full(len(part), 2 * low + 1), part)[:2])
                if not up:
                    out[filled : filled + len(part)] = part
                    filled += len(part)
        else:
            taken = queue.take(r)
            own = np.array(seeds[seed:end])
            keys = np.concatenate([2 * taken[:, 0], 2 * name(own) + 1])
            order = np.argsort(keys, kind="stable")
            keys, positions = keys[order], np.concatenate([taken[:, 1], own])[order]
            width = 1024
            while len(keys):
                names, before, m = put_back(keys[:width], positions[:width])
                given = positions[:m] if not up else positions[:m][keys[:m] & 1 == 0]
                out[filled : filled + len(given)] = given
                filled += len(given)
                keys, positions = keys[m:], positions[m:]
                here = int(np.searchsorted(names, high))
                if here:
                    at = np.searchsorted(keys, 2 * names[:here], side="right")
                    keys, positions = np.insert(keys, at, 2 * names[:here]), np.insert(positions, at, before[:here])
                if here < len(names):
                    queue.push(names[here:], before[here:])
                width = min(TAKEN, max(256, 2 * m))
        seed = end
    if not up:
        out[filled] = len(text) - 1  # nothing follows it that could induce it
    return out


def named(text: np.ndarray, stars: np.ndarray, rank: np.ndarray, store: Store) -> tuple[np.ndarray, int]:
    """(name of each star's substring, in the order of positions, and how many differ); rank holds numbers of stars in order."""
    sizes = np.append(np.diff(stars), 0) + 1
    names = store.array(len(stars), np.int64)
    last = 0
    names[rank[0]] = 0
    for at in range(1, len(rank), RANGE):
        a, b = np.array(rank[at - 1 : at - 1 + RANGE][: len(rank) - at]), np.array(rank[at : at + RANGE])
        same = sizes[a] == sizes[b]
        left, k = np.flatnonzero(same), 0
        while len(left):
            own = text[stars[a[left]] + k] == text[stars[b[left]] + k]
            same[left[~own]] = False
            k += 1
            left = left[own & (sizes[a[left]] > k)]
        names[b] = last + np.cumsum(~same)
        last = int(names[b[-1]])
    return names, last + 1


def tuple_names(text: np.ndarray, top: int, stars: np.ndarray) -> tuple[np.ndarray, int]:
    """As named, by sorting: substrings by their first few names at once, then those still equal by what follows.

    A substring that is another's beginning comes after it, as it ends with a
    small suffix where the other has one that is not.
    """
    sizes = np.append(np.diff(stars), 0) + 1
    bits = (top + 1).bit_length()
    step = max(1, 63 // bits)
    names, left, at = np.zeros(len(stars), np.int64), np.arange(len(stars)), 0
    while len(left):
        key = np.zeros(len(left), np.int64)
        for k in range(at, at + step):
            here = np.minimum(stars[left] + k, len(text) - 1)
            key = (key << bits) | np.where(k < sizes[left], text[here].astype(np.int64), top + 1)
        order = np.lexsort((key, names[left])) if at else np.argsort(key)
        own, key = names[left][order], key[order]
        group = np.concatenate([[True], own[1:] != own[:-1]])
        new = group | np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        start = np.flatnonzero(group)[np.cumsum(group) - 1]
        names[left[order]] = own + (first - start)
        at += step
        # a name leaves room for as many as bear it; only those that go on, and are not alone, are told apart further
        several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        left = left[order][several & (sizes[left][order] >= at)]
    met, names = np.unique(names, return_inverse=True)
    return names.astype(np.int64), len(met)


def doubled(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of a short text, by sorting prefixes of twice the length in each round, up to depth entries."""
    rank, h = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        further = np.zeros(len(rank), np.int64)
        further[: max(0, len(rank) - h)] = rank[h:] + 1
        keys = rank * (len(rank) + 1) + further
        order = np.argsort(keys)
        rank[order] = np.cumsum(np.diff(keys[order], prepend=keys[order[0]]) > 0)
        h *= 2
        if rank[order[-1]] == len(rank) - 1 or h >= depth:
            return order


def suffix_array(text: np.ndarray, top: int, store: Store, room: int = 64 << 20, depth: int = NEVER, recursion: bool = False) -> np.ndarray:
    """Positions of text in the order of their suffixes.

    text holds names from 0 to top; its last one is 0 and stands nowhere else.
    room bounds what a queue holds in memory. Suffixes that agree in depth
    entries may come in any order.
    """
    if len(text) <= FEW and recursion or len(text) == 1:
        return doubled(np.asarray(text), depth)
    small = is_small(text, store)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1

    def scans(seeds: np.ndarray) -> np.ndarray:
        left = induce(text, top, small, seeds, True, store, room)
        both = induce(text, top, small, left[::-1], False, store, room)
        store.free(left)
        return both[::-1]

    if len(stars) <= TUPLES:
        names, distinct = tuple_names(text, top, stars)
    else:
        order = scans(stars[np.argsort(text[stars], kind="stable")])
        starred = store.array(len(text), bool)
        starred[:] = False
        starred[stars] = True
        rank = np.concatenate([np.searchsorted(stars, part[starred[part]]) for part in (order[a : a + (1 << 20)] for a in range(0, len(order), 1 << 20))])
        store.free(starred)
        store.free(order)
        names, distinct = named(text, stars, rank, store)
    rank = suffix_array(names, distinct - 1, store, room, depth, True) if distinct < len(stars) else np.argsort(names)
    out = scans(stars[rank])
    store.free(small)
    return out
