"""External induced sorting of suffixes with their common-prefix lengths.

Suffixes fall into L (greater than their successor) and S types; the leftmost S of each run (LMS) is
ordered first, by recursion on the string of its substrings' names. Two scans then induce the order
of all other suffixes: each scanned suffix hands its predecessor to a priority queue under the
predecessor's first symbol. Tuples in the queue carry the common-prefix length with the tuple before
them, one more than the least along the scan in between. Queues keep their larger sorted runs in
files, and the scan takes as many symbols at once as do not feed each other. The recursion ends at strings
that fit in memory (BASE), which rank doubling orders.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .common import Rolling, mix

U64 = np.uint64
#: Above so many tuples a run goes to a file.
IN_MEMORY = 1 << 18


def on_disk(x: np.ndarray, folder: str | None) -> np.ndarray:
    if folder is None or len(x) <= IN_MEMORY:
        return x
    f = tempfile.TemporaryFile(dir=folder)
    out = np.memmap(f, x.dtype, "w+", shape=x.shape)
    f.close()  # the mapping keeps the unnamed file
    out[:] = x
    return out


class DiskQueue:
    """Tuples (symbol, position, prefix) taken by symbol, then by time of arrival."""

    def __init__(self, folder: str | None):
        self.folder, self.runs = folder, []

    def push(self, sym, pos, lcp):
        if not len(sym):
            return
        order = np.argsort(sym, kind="stable")
        run = [sym[order], pos[order], lcp[order], 0]
        while self.runs and len(self.runs[-1][0]) - self.runs[-1][3] <= 2 * (len(run[0]) - run[3]):
            old = self.runs.pop()
            cols = [np.concatenate([old[i][old[3] :], run[i][run[3] :]]) for i in range(3)]
            order = np.argsort(cols[0], kind="stable")
            run = [x[order] for x in cols] + [0]
        self.runs.append([on_disk(x, self.folder) for x in run[:3]] + [run[3]])

    def least(self):
        self.runs = [r for r in self.runs if r[3] < len(r[0])]
        return min((int(r[0][r[3]]) for r in self.runs), default=None)

    def peek(self, below):
        parts = [(r[0][a:b], r[1][a:b], r[2][a:b]) for r in self.runs for a, b in [(r[3], r[3] + int(np.searchsorted(r[0][r[3] :], below)))] if b > a]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(cols[0], kind="stable")
        return tuple(x[order] for x in cols)

    def drop(self, below):
        for r in self.runs:
            r[3] += int(np.searchsorted(r[0][r[3] :], below))


def range_min(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of q[lo..hi], both ends counted, from a table of power-of-two spans."""
    width = hi - lo + 1
    level = np.zeros(len(lo), np.int64)
    out = np.full(len(lo), 255, np.uint8)
    np.floor(np.log2(width), out=level, casting="unsafe", where=width > 0)
    t, top = q, int(level.max(initial=0))
    for k in range(top + 1):
        at = level == k
        out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << k) + 1])
        t = np.minimum(t[: -(1 << k)], t[1 << k :]) if len(t) > 1 << k else t
    return out


class Scan:
    """One inducing scan. sym: each position's symbol in scan order; feeds: the positions it orders."""

    def __init__(self, sym, feeds, run, cap, folder):
        self.sym, self.feeds, self.run, self.cap = sym, feeds, run, cap
        self.queue, self.out = DiskQueue(folder), []
        size = int(sym.max()) + 1 if cap else 0
        self.since, self.seen = np.full(size, 255, np.uint8), np.zeros(size, bool)

    def step(self, pos, q, own=None):
        """Hands on the predecessors of pos, whose prefixes are q; those under the symbol `own` come back."""
        j = np.flatnonzero(pos > 0)
        j = j[self.feeds[pos[j] - 1]]
        to = self.sym[pos[j] - 1]
        lcp = np.zeros(len(j), np.uint8)
        if self.cap and len(pos):
            if len(j):
                order = np.argsort(to, kind="stable")
                t, at = to[order], j[order]
                first = np.concatenate([[True], t[1:] != t[:-1]])
                lo = np.where(first, 0, np.concatenate([[0], at[:-1] + 1]))
                least = range_min(q, lo, at)
                least[first] = np.minimum(least[first], self.since[t[first]])
                least = np.minimum(least.astype(np.int64) + 1, self.cap)
                least[first & ~self.seen[t]] = 0
                lcp[order] = least
            np.minimum(self.since, q.min(), out=self.since)
            if len(j):
                last = np.concatenate([t[1:] != t[:-1], [True]])
                tail = np.concatenate([np.minimum.accumulate(q[::-1])[::-1], [255]]).astype(np.uint8)
                self.since[t[last]], self.seen[t[last]] = tail[at[last] + 1], True
        if own is not None:
            mine = to == own
            back = pos[j][mine] - 1, lcp[mine]
            j, to, lcp = j[~mine], to[~mine], lcp[~mine]
        self.queue.push(to, pos[j] - 1, lcp)
        return back if own is not None else None

    def joined(self, dyn, sta, sta_q, dyn_q):
        """Fed and given suffixes of one range of symbols in order, with the prefix of each and its predecessor."""
        pos = np.concatenate([dyn, sta])
        s = self.sym[pos]
        order = np.argsort(s, kind="stable")
        q = np.concatenate([dyn_q, sta_q])[order]
        pos, s, given = pos[order], s[order], order >= len(dyn)
        if self.cap and len(pos):
            new = np.concatenate([[True], s[1:] != s[:-1]])
            seam = np.concatenate([[False], given[1:] & ~given[:-1]]) & ~new
            k = np.flatnonzero(seam)
            q[k] = np.minimum(np.minimum(self.run[pos[k]], self.run[pos[k - 1]]), self.cap)
            q[new] = 0
        return pos, q

    def go(self, given, given_q):
        """given: suffixes whose order is known. Returns those fed, in order, with their prefixes."""
        given_sym, at, step = self.sym[given], 0, 1
        while True:
            c, own = self.queue.least(), int(given_sym[at]) if at < len(given) else None
            if c is None and own is None:
                break
            c = own if c is None else c if own is None else min(c, own)
            d = c + step
            _, dyn, dyn_q = self.queue.peek(d)
            end = at + int(np.searchsorted(given_sym[at:], d))
            pos = np.concatenate([dyn, given[at:end]])
            prev = pos[pos > 0] - 1
            src, prev = self.sym[pos[pos > 0]][self.feeds[prev]], prev[self.feeds[prev]]
            to = self.sym[prev]
            inside = to < d
            if inside.any():
                d = int(to[inside].min())  # a symbol that this range feeds starts the next one
                step = max(1, step // 2)
                if d <= c:
                    self.alone(c, given, given_sym, given_q, at)
                    at += int(np.searchsorted(given_sym[at:], c + 1))
                    continue
                _, dyn, dyn_q = self.queue.peek(d)
                end = at + int(np.searchsorted(given_sym[at:], d))
            else:
                step *= 2
            self.queue.drop(d)
            pos, q = self.joined(dyn, given[at:end], given_q[at:end], dyn_q)
            self.out.append(self.fed(dyn, dyn_q))
            self.step(pos, q)
            at = end
        if not self.out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([x[0] for x in self.out]), np.concatenate([x[1] for x in self.out])

    def fed(self, dyn, dyn_q):
        q = dyn_q.copy()
        if len(dyn) and self.cap:
            s = self.sym[dyn]
            q[np.concatenate([[True], s[1:] != s[:-1]])] = 0
        return dyn, q

    def alone(self, c, given, given_sym, given_q, at):
        """A symbol that feeds itself: its suffixes come in rounds."""
        _, dyn, dyn_q = self.queue.peek(c + 1)
        self.queue.drop(c + 1)
        last = None
        while len(dyn):
            if last is None and self.cap:
                dyn_q = dyn_q.copy()
                dyn_q[0] = 0
            self.out.append((dyn, dyn_q))
            last = int(dyn[-1])
            dyn, dyn_q = self.step(dyn, dyn_q, own=c)
        end = at + int(np.searchsorted(given_sym[at:], c + 1))
        sta, sta_q = given[at:end], given_q[at:end].copy()
        if len(sta):
            if self.cap:
                sta_q[0] = min(int(self.run[sta[0]]), int(self.run[last]), self.cap) if last is not None else 0
            self.step(sta, sta_q)


def induce(t, is_s, lms, lms_q, run, cap, folder):
    """All suffixes in order from the order of the LMS ones, with prefixes (capped; none if cap is 0)."""
    n, top = len(t), int(t.max())
    pos_l, q_l = Scan(t, ~is_s, run, cap, folder).go(lms, lms_q)
    q_down = np.concatenate([[0], q_l[::-1][:-1]]).astype(np.uint8) if len(q_l) else q_l
    pos_s, q_s = Scan(top - t, is_s, run, cap, folder).go(pos_l[::-1], q_down)
    q_s = np.concatenate([q_s[1:], [0]]).astype(np.uint8) if len(q_s) else q_s  # to the one before in ascending order
    pos_s, q_s = np.concatenate([[n - 1], pos_s[::-1]]), np.concatenate([[0], q_s[::-1]]).astype(np.uint8)
    pos, q = np.concatenate([pos_l, pos_s]), np.concatenate([q_l, q_s])
    order = np.argsort(t[pos], kind="stable")
    given = order >= len(pos_l)
    pos, q = pos[order], q[order]
    if cap:
        s = t[pos]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        k = np.flatnonzero(np.concatenate([[False], given[1:] & ~given[:-1]]) & ~new)
        q[k] = np.minimum(np.minimum(run[pos[k]], run[pos[k - 1]]), cap)
        q[new] = 0
    return pos, q


def types(t):
    """Whether each suffix is of type S; the length of the run of equal symbols that starts at each position."""
    n = len(t)
    change = np.concatenate([t[:-1] != t[1:], [True]])
    end = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]
    up = np.concatenate([t[:-1] < t[1:], [True]])
    return up[end], np.minimum(end - np.arange(n) + 1, 255).astype(np.uint8)


#: A reduced string of up to so many symbols is ordered in memory instead of by a further recursion.
BASE = 1 << 18


def packed(t, pos, stop, top):
    """Some symbols from each pos on as one word, those from stop on as `top`; and how many."""
    bits = int(top).bit_length()
    each = 64 // bits
    word = np.zeros(len(pos), U64)
    for i in range(each):
        at = np.minimum(pos + i, len(t) - 1)
        word = (word << U64(bits)) | np.where(pos + i < stop, t[at], top).astype(U64)
    return word, each


def refined(order, new, key):
    """Ties (elements of order after the first of their group, by `new`) ordered anew by key(elements)."""
    tied = ~new
    tied[:-1] |= ~new[1:]
    at = np.flatnonzero(tied)
    items, group = order[at], np.cumsum(new)[at]
    k = key(items)
    rank = np.lexsort((k, group))
    order[at] = items[rank]
    k, first = k[rank], new[at]
    first[1:] |= k[1:] != k[:-1]
    new[at] = first
    return at


def named(t, lms):
    """Order of the substrings between LMS positions, and their names by rank; one that ends where another goes on is the greater."""
    stop = np.append(lms[1:] + 1, len(t))
    top = int(t.max()) + 1
    word, each = packed(t, lms, stop, top)
    order = np.argsort(word, kind="stable")
    new = np.concatenate([[True], word[order][1:] != word[order][:-1]])
    size = stop - lms
    for depth in range(each, int(size.max()), each):
        if not (~new & (size[order] > depth)).any():
            break
        refined(order, new, lambda i, depth=depth: packed(t, lms[i] + depth, stop[i], top)[0])
    return order, np.cumsum(new) - 1


def sort_in_memory(t):
    """Suffixes of t in order by doubling ranks, only where they still tie."""
    n = len(t)
    word, width = packed(t + 1, np.arange(n), np.full(n, n), 0 if n == 0 else int(t.max()) + 2)
    order = np.argsort(word, kind="stable")
    new = np.concatenate([[True], word[order][1:] != word[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while not new.all():
        at = refined(order, new, lambda i, width=width: rank[np.minimum(i + width, n)])
        rank[order[at]] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[at]
        width *= 2
    return order


def sort_suffixes(t: np.ndarray, cap: int = 0, folder: str | None = None):
    """Suffixes of t in order, and each one's common prefix with the one before, at most `cap` (under 254).

    t: int64 symbols from 0; the last is the least and occurs once.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    is_s, run = types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    m = len(lms)
    index, name = named(t, lms)
    pos = lms[index]
    reduced = np.empty(m, np.int64)
    reduced[index] = name
    if name[-1] + 1 < m:
        pos = lms[sort_in_memory(reduced) if m <= BASE else sort_suffixes(reduced, 0, folder)[0]]
    q = np.zeros(m, np.uint8)
    if cap and m > 1:
        # common prefixes of neighbouring LMS suffixes, by halving over hashes of whole symbols
        a, b, rolling = pos[:-1], pos[1:], Rolling(mix(t.astype(U64) + U64(1)))
        lo, room = np.zeros(m - 1, np.int64), np.minimum(n - np.maximum(a, b), cap)
        hi = room.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = rolling.spans(a, a + mid) == rolling.spans(b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        q = np.concatenate([[0], lo]).astype(np.uint8)
    return induce(t, is_s, pos, q, run, cap, folder)
