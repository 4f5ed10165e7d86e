"""Bin completion: the fewest bins for counts of sizes, by branch and bound.

A node of the search is what is left of the counts. Some bin holds the largest size left, so the node branches over the
undominated fillings around it, least waste first, and over how often each is used, from as often as the counts allow down to
once. A filling is dominated if one part of those left, put in for some of its parts, fills the bin better or with fewer
parts: then an optimal solution exists without it. Fillings that a node has tried around its largest size are not tried
again below it, as every solution with them has been seen; a node that was met before, in no more bins, is left. A branch is
pruned when its bins and the lower bound of what is left can't beat the incumbent, and a filling when its waste is more than
the incumbent allows. The first incumbents are best-fit solutions: best-fit decreasing, and then each dive along the
best-fitting fillings.

The search ends when the incumbent meets the lower bound or no branch is left, and then is optimal, or after `effort` steps;
the result says which, and both numbers. Sums of sizes are bit sets, so a node's cost doesn't depend on how many pieces there
are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

Filling = dict[int, int]


@dataclass(frozen=True)
class Plan:
    """Fillings (size -> times) and how often each is used. bound: no plan has fewer bins; proven: nor fewer than this one."""

    fillings: list[tuple[Filling, int]]
    bound: int
    proven: bool

    @property
    def bins(self) -> int:
        return sum(n for _, n in self.fillings)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins. For each threshold t up to half the capacity: sizes of over half have a bin each, those of
    over capacity - t have it alone, and the others' room is all there is for sizes from t to the half. sizes must rise."""
    if not len(sizes):
        return 0
    upto = np.concatenate(([0], np.cumsum(counts)))
    mass = np.concatenate(([0], np.cumsum(counts * sizes)))
    half = np.searchsorted(sizes, capacity // 2, "right")
    at = np.arange(half + 1)  # the threshold is the size there; the last: none of the small ones
    alone = np.searchsorted(sizes, capacity - np.append(sizes[:half], capacity // 2 + 1), "right")
    alone = np.maximum(alone, half)
    shared, room = upto[alone] - upto[half], (upto[alone] - upto[half]) * capacity - (mass[alone] - mass[half])
    over = np.maximum(0, -(-(mass[half] - mass[at] - room) // capacity))
    return int((upto[-1] - upto[alone] + shared + over).max())


def best_fit_decreasing(counts: Filling, capacity: int) -> list[tuple[Filling, int]]:
    """Every piece, from the largest, goes into the fullest bin that has room for it; equal bins are kept together."""
    rooms: list[int] = []  # rising
    bins: dict[int, list[tuple[Filling, int]]] = {}

    def put(room: int, filling: Filling, n: int) -> None:
        if n:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((filling, n))

    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                filling, n = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                room, filling, n = capacity, {}, left
            fit = room // size
            full = min(n, left // fit)
            put(room - fit * size, filling | {size: fit}, full)
            left -= full * fit
            if full < n and left:  # less than a bin's worth
                put(room - left * size, filling | {size: left}, 1)
                full, left = full + 1, 0
            if filling:
                put(room, filling, n - full)
    return [group for room in rooms for group in bins[room]]


def _times(sums: int, size: int, most: int, mask: int) -> int:
    """The sums with 0 … most times a size more, as bit sets."""
    step = 1
    while most > 0:
        k = min(step, most)
        sums |= sums << (k * size) & mask
        most -= k
        step *= 2
    return sums


def undominated(parts: list[tuple[int, int]], spare: int, waste: int) -> bool:
    """Whether no spare size x can be put in for some parts so that the filling has more in it, or as much in fewer parts.
    parts: (size, times); spare: the sizes left besides, as a bit set."""
    one = many = 0  # the sums of one part, of two or more
    for size, times in parts:
        for _ in range(times):
            many |= (many | one) << size
            one |= 1 << size
    wide = (1 << (waste + max(one, many, 1).bit_length() + 1)) - 1
    more = _times(one | 1, 1, waste - 1, wide) << 1 if waste else 0  # x > a part, or anything into the waste
    return not spare & (more | _times(many, 1, waste, wide))


class _Budget:
    def __init__(self, steps: int):
        self.left = steps

    def spend(self, n: int = 1) -> bool:
        self.left -= n
        return self.left > 0


def completions(sizes: list[int], left: list[int], at: int, room: int, budget: _Budget, most_waste) -> Iterator[Filling]:
    """The undominated fillings of `room` from sizes[at:] (falling), as place -> times, least waste first.

    most_waste(): fillings that waste more are of no use any more."""
    own = [i for i in range(at, len(sizes)) if left[i] and sizes[i] <= room]
    if not own or not budget.spend(1 + len(own) // 16):
        if not own and room <= most_waste():
            yield {}
        return
    mask, spare = (1 << (room + 1)) - 1, 0
    sums = [1]  # sums[-1 - j]: what own[j:] can make
    for i in reversed(own):
        sums.append(_times(sums[-1], sizes[i], min(left[i], room // sizes[i]), mask))
        spare |= 1 << sizes[i]
    sums.reverse()
    best = sums[0].bit_length() - 1
    if spare >> best & 1:  # one part that fills as well as anything dominates all else
        if room - best <= most_waste():
            yield {next(i for i in own if sizes[i] == best): 1}
        return

    def exact(j: int, total: int) -> Iterator[Filling]:
        if not total:
            yield {}
            return
        while j < len(own) and sums[j] >> total & 1:
            size = sizes[own[j]]
            if size <= total:
                for times in range(min(left[own[j]], total // size), 0, -1):
                    if sums[j + 1] >> (total - times * size) & 1:
                        for rest in exact(j + 1, total - times * size):
                            yield {own[j]: times, **rest}
            j += 1

    for total in range(best, max(1, room - most_waste()) - 1, -1):
        if sums[0] >> total & 1:
            if room - total > most_waste():
                return
            for filling in exact(0, total):
                if not budget.spend():
                    return
                used = sum(1 << sizes[i] for i, k in filling.items() if k == left[i])
                if undominated([(sizes[i], k) for i, k in filling.items()], spare & ~used, room - total):
                    yield filling


def pack(counts: Filling, capacity: int, effort: int = 200_000) -> Plan:
    """The fewest bins of `capacity` that hold all counts (size -> pieces), or the fewest found in `effort` steps."""
    sizes = sorted((s for s, n in counts.items() if n > 0), reverse=True)
    whole = [counts[s] for s in sizes]
    rising = np.array(sizes[::-1], np.int64)
    bound_of = lambda left: lower_bound(rising, np.array(left[::-1], np.int64), capacity)
    plan = best_fit_decreasing(counts, capacity)
    best, bound = sum(n for _, n in plan), bound_of(whole)
    total, budget, seen = sum(s * n for s, n in zip(sizes, whole, strict=True)), _Budget(effort), {}
    found: list[tuple[Filling, int]] | None = None

    def branches(left: list[int], waste: int, tried: frozenset):
        """(filling, times, what is tried around the same largest size) from a node."""
        at = next(i for i, n in enumerate(left) if n)
        after = [*left]
        after[at] -= 1
        allowed = lambda: (best - 1) * capacity - total - waste
        for parts in completions(sizes, after, at, capacity - sizes[at], budget, allowed):
            filling = {**parts, at: parts.get(at, 0) + 1}
            name = frozenset(filling.items())
            if name in tried:
                continue
            tried |= {name}
            for times in range(min(left[i] // k for i, k in filling.items()), 0, -1):
                yield filling, times, tried if left[at] > times * filling[at] else frozenset()

    class Node:
        """Holds its branches from the second on only: a dive leaves behind nodes, not their sums."""

        def __init__(self, left, bins, waste, tried, path):
            self.left, self.bins, self.waste, self.tried, self.path = left, bins, waste, tried, path
            self.least, self.taken, self.rest = bins + bound_of(left), 0, None

        def branch(self):
            if self.rest is None:
                fresh = branches(self.left, self.waste, self.tried)
                if not self.taken:
                    self.taken = 1
                    return next(fresh, None)
                next(fresh, None)
                self.rest = fresh
            return next(self.rest, None)

    nodes = [Node(whole, 0, 0, frozenset(), None)] if best > bound else []
    while nodes and best > bound and budget.left > 0:
        node = nodes[-1]
        taken = node.branch() if node.least < best else None
        if taken is None:
            nodes.pop()
            continue
        budget.spend()
        filling, times, tried = taken
        left = [*node.left]
        for i, k in filling.items():
            left[i] -= k * times
        bins, path = node.bins + times, (({sizes[i]: k for i, k in filling.items()}, times), node.path)
        if not any(left):
            if bins < best:
                best, found = bins, []
                while path:
                    found.append(path[0])
                    path = path[1]
            continue
        if not tried:
            name = hashlib.blake2b(np.array(left, np.int64).tobytes(), digest_size=16).digest()
            if seen.get(name, bins + 1) <= bins:
                continue
            seen[name] = bins
        waste = node.waste + times * (capacity - sum(sizes[i] * k for i, k in filling.items()))
        nodes.append(Node(left, bins, waste, tried, path))
    proven = best == bound or (not nodes and budget.left > 0)
    return Plan(plan if found is None else found, best if proven else bound, proven)
