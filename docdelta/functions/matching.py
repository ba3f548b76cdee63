"""Longest common runs of two sequences, and the best order-preserving pairs of a block: small helpers that run inside tasks.

A sequence is a string: of characters, or of units, each of which is given a character of its own. What is the longest
run is fixed by the result that reports show: of equally long ones the one that begins first in the old side, then in
the new one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np

#: Up to this product of the lengths a run is grown by substring tests, beyond it found by an automaton in linear time.
SMALL = 1 << 20
#: Up to so many pairs of texts are held against each other one by one, beyond it by a matrix for each character.
FEW = 100


def as_characters(old: list, new: list) -> tuple[str, str]:
    """Both sides with a character for each different item. Surrogates are left out, which a string may not end in
    the middle of."""
    codes: dict = {}
    for x in (*old, *new):
        if x not in codes:
            codes[x] = chr(len(codes) + 1 if len(codes) < 0xD7FF else len(codes) + 0x801)
    return "".join(map(codes.__getitem__, old)), "".join(map(codes.__getitem__, new))


def grown_run(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the first longest run, by trying to grow it at each start: by one, two, four
    and so on characters, then by what is left between the last two."""
    at, size, n = 0, 0, len(a)
    for i in range(n):
        if i + size >= n:
            break
        step = 1
        while i + size + step <= n and a[i : i + size + step] in b:
            at, size, step = i, size + step, 2 * step
        while step > 1:
            step //= 2
            if i + size + step <= n and a[i : i + size + step] in b:
                size += step
    return at, b.find(a[at : at + size]), size


def automaton_run(a: str, b: str) -> tuple[int, int, int]:
    """The same by a suffix automaton of ``a``: each state knows where its first occurrence ends."""
    follow: list[dict] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(a):
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    best = (0, 0, 0)
    state = size = 0
    for j, c in enumerate(b):
        while state and c not in follow[state]:
            state = link[state]
            size = length[state]
        if c in follow[state]:
            state, size = follow[state][c], size + 1
            if size >= best[2]:
                found = (first[state] - size + 1, j - size + 1, size)
                if size > best[2] or found[0] < best[0]:
                    best = found
    return best


def longest_run(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run; of equal ones the first in ``a``, then in ``b``."""
    return grown_run(a, b) if len(a) * len(b) <= SMALL else automaton_run(a, b)


def common_runs(a: str, b: str) -> list[tuple[int, int, int]]:
    """Runs in order: the longest one, then the longest ones on both sides of it, and so on. Touching runs are one."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i1, i2, j1, j2 = todo.pop()
        if i1 == i2 or j1 == j2:
            continue
        i, j, size = longest_run(a[i1:i2], b[j1:j2])
        if size:
            i, j = i + i1, j + j1
            found.append((i, j, size))
            todo += [(i1, i, j1, j), (i + size, i2, j + size, j2)]
    runs: list[tuple[int, int, int]] = []
    for i, j, size in sorted(found):
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1] = (runs[-1][0], runs[-1][1], runs[-1][2] + size)
        else:
            runs.append((i, j, size))
    return runs


def edits(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """(tag, i1, i2, j1, j2): what turns ``a`` into ``b`` between their common runs."""
    out, i, j = [], 0, 0
    for x, y, size in [*common_runs(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        i, j = x + size, y + size
        if size:
            out.append(("equal", x, i, y, j))
    return out


def ratio(a: str, b: str) -> float:
    """Twice the characters in common runs, as a share of all characters; 1 for two empty texts."""
    if a == b:
        return 1.0
    return 2 * sum(size for *_, size in common_runs(a, b)) / (len(a) + len(b))


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, character) of all characters, and the lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.repeat(np.arange(len(texts)), size), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), size


def ratio_from(a: str, b: str, threshold: float) -> float | None:
    """``ratio`` if it is ``threshold`` at least, else none, which is found out as soon as what is left cannot reach it."""
    if a == b:
        return 1.0
    both = len(a) + len(b)
    found, open_ends, todo = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while todo:
        if 2 * (found + open_ends) / both < threshold:
            return None
        i1, i2, j1, j2 = todo.pop()
        open_ends -= min(i2 - i1, j2 - j1)
        i, j, size = longest_run(a[i1:i2], b[j1:j2])
        if size:
            i, j = i + i1, j + j1
            found += size
            for side in ((i1, i, j1, j), (i + size, i2, j + size, j2)):
                if least := min(side[1] - side[0], side[3] - side[2]):
                    open_ends += least
                    todo.append(side)
    value = 2 * found / both
    return value if value >= threshold else None


def possible_pairs(old: list[str], new: list[str], threshold: float, cells: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """The places (i, j) of texts whose lengths and common characters allow a ``ratio`` of ``threshold``.

    Many texts are taken a matrix of about ``cells`` sums at a time: for each character the smaller one of its counts.
    """
    if len(old) * len(new) <= FEW:
        bags = [(len(b), Counter(b)) for b in new]
        for i, a in enumerate(old):
            bag = Counter(a)
            for j, (m, other) in enumerate(bags):
                least = threshold * (len(a) + m)
                if 2 * min(len(a), m) >= least and 2 * sum(min(k, other[c]) for c, k in bag.items() if c in other) >= least:
                    yield i, j
        return
    right, right_codes, m = _characters(new)
    step = max(1, cells // len(new))
    for start in range(0, len(old), step):
        left, left_codes, n = _characters(old[start : start + step])
        codes, at = np.unique(np.concatenate([left_codes, right_codes]), return_inverse=True)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(1, len(codes) + 1))
        both = np.zeros((len(n), len(m)), np.int32)
        begin = 0
        for end in ends:
            places, begin = order[begin:end], end
            x = np.bincount(left[places[places < len(left)]], minlength=len(n)).astype(np.int32)
            y = np.bincount(right[places[places >= len(left)] - len(left)], minlength=len(m)).astype(np.int32)
            rows, columns = np.flatnonzero(x), np.flatnonzero(y)
            if 2 * len(rows) > len(n) and 2 * len(columns) > len(m):
                both += np.minimum.outer(x, y)
            elif len(rows) and len(columns):
                both[np.ix_(rows, columns)] += np.minimum.outer(x[rows], y[columns])
        least = threshold * (n[:, None] + m[None])
        for i, j in np.argwhere((2 * np.minimum(n[:, None], m[None]) >= least) & (2 * both >= least)).tolist():
            yield start + i, j


def best_pairs(cells: dict[int, list[tuple[int, float]]], n: int, m: int) -> list[tuple[str, int | None, int | None]]:
    """The order-preserving pairs of greatest total, from ``cells``: for an old place its (new place, value), in order.

    Only cells are gone through, not the n x m places between them: the best total over the new places seen so far is
    a staircase, of which the steps are kept. What stays unpaired reads deletions first, and of equal totals the one
    that leaves the last new places unpaired is taken, then the one that pairs the later old place.
    """
    ends: list[int] = []  # where a step begins: the number of new places used
    totals: list[float] = []
    nodes: list[tuple] = []  # (old place, new place, the node before it)
    for i in sorted(cells):
        found = []
        for j, value in cells[i]:
            k = bisect_right(ends, j) - 1
            found.append((j + 1, (totals[k] if k >= 0 else 0.0) + value, (i, j, nodes[k] if k >= 0 else None)))
        for end, total, node in found:
            k = bisect_left(ends, end)
            here = k < len(ends) and ends[k] == end
            before = totals[k - 1] if k else 0.0
            if total <= before or here and total < totals[k]:
                continue
            stop = k
            while stop < len(ends) and (totals[stop] <= total or ends[stop] == end):
                stop += 1
            ends[k:stop], totals[k:stop], nodes[k:stop] = [end], [total], [node]
    out, i, j = [], n, m
    node = nodes[-1] if nodes else None
    while node or i or j:
        x, y, before = node or (-1, -1, None)
        out += [("add", None, k) for k in range(j - 1, y, -1)]
        out += [("del", k, None) for k in range(i - 1, x, -1)]
        if node is None:
            break
        out.append(("pair", x, y))
        i, j, node = x, y, before
    return out[::-1]
