"""External induced sorting of suffixes with their common prefixes, by recursion.

A suffix is small if it is less than the next one, else large; the left-most small ones (seeds) of each run decide the
order of all others. Their substrings up to the next seed are sorted and named, and the string of names, at most half
as long, is sorted by the same function until its names are mostly different or one name covers the depth asked for. The
seeds in order then induce the large suffixes upwards, and these induce the small ones downwards.

An induction reads tuples (symbol, position, common prefix with the tuple before) from a priority queue by symbol and
time of arrival. Emitting a suffix pushes the one that starts a symbol earlier; its common prefix is one more than the
least one emitted since the last push to the same symbol. Tuples are emitted in batches: as many from the front as
cannot be overtaken by what they push. So a batch is a bucket where symbols are few, and many buckets where they are
many, and nothing runs a loop for each symbol.

Queues, texts and results lie in memory up to `limit` bytes each and in unlinked scratch files of the task beyond, so a
text may be far larger than memory. Only batches (`BATCH` tuples), a few numbers for each symbol, and the tuples of a
band of rare symbols (1/512 of all) are always held.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of one array or queue kept in memory, tuples of a batch, and positions worked on at once elsewhere.
LIMIT = 64 << 20
BATCH, BLOCK = 1 << 19, 1 << 20
#: Bands of symbols, and rounds of pushes within one band that are ranked together.
BANDS, WAVES = 512, 12
#: Share of different names from which on their string is sorted by them, and only ties by what follows.
MOSTLY = 0.5


class Scratch:
    """Arrays of one sort, in memory or in files; `spilled` counts the bytes that went to files."""

    def __init__(self, limit: int = LIMIT):
        self.limit, self.spilled = limit, 0

    def array(self, n: int, dtype) -> np.ndarray:
        """An array of zeros."""
        size = n * np.dtype(dtype).itemsize
        if size <= self.limit:
            return np.zeros(n, dtype)
        self.spilled += size
        with tempfile.TemporaryFile() as file:
            file.truncate(size)
            return np.memmap(file, dtype, "r+", shape=(n,))


class Spool:
    """An array that grows at its end."""

    def __init__(self, scratch: Scratch, dtype):
        self.scratch, self.dtype, self.parts, self.held, self.n, self.file = scratch, np.dtype(dtype), [], 0, 0, None

    def append(self, some: np.ndarray) -> None:
        self.parts.append(np.asarray(some, self.dtype))
        self.held += self.parts[-1].nbytes
        self.n += len(some)
        if self.held > self.scratch.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for part in self.parts:
            part.tofile(self.file)
        self.scratch.spilled += self.held
        self.parts, self.held = [], 0

    def finished(self) -> np.ndarray:
        if not self.file:
            return np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype)
        self._spill()
        self.file.flush()
        with self.file:
            return np.memmap(self.file, self.dtype, "r", shape=(self.n,))


class Queues:
    """A first-in first-out queue of tuples for each band of symbols; all go to a file when they outgrow the limit."""

    def __init__(self, bands: int, scratch: Scratch):
        self.parts: list[list] = [[] for _ in range(bands)]
        self.scratch, self.held, self.file, self.staged, self.n = scratch, 0, None, [], 0

    def push(self, bands: np.ndarray, columns: tuple) -> None:
        """Tuples (arrays) to their bands."""
        if len(bands):
            self.staged.append((bands, *columns))
            self.n += len(bands)
            if self.n > BATCH:
                self._deal()

    def _deal(self) -> None:
        bands, *columns = (np.concatenate(c) for c in zip(*self.staged, strict=True))
        self.staged, self.n = [], 0
        order = np.argsort(bands, kind="stable")
        bands = bands[order]
        cuts = np.flatnonzero(bands[1:] != bands[:-1]) + 1
        columns = [c[order] for c in columns]
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bands)], strict=True):
            self.parts[int(bands[a])].append(tuple(c[a:b] for c in columns))
        self.held += sum(c.nbytes for c in columns)
        if self.held > self.scratch.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for queue in self.parts:
            for i, part in enumerate(queue):
                if isinstance(part[0], np.ndarray):
                    queue[i] = tuple((self._written(c), len(c), c.dtype) for c in part)
        self.scratch.spilled += self.held
        self.held = 0

    def _written(self, column: np.ndarray) -> int:
        at = self.file.tell()
        column.tofile(self.file)
        return at

    def pop(self, band: int, most: int) -> tuple | None:
        """The oldest tuples of a band, at most so many; None if there are none."""
        if self.staged:
            self._deal()
        queue, out, n, taken = self.parts[band], [], 0, 0
        while taken < len(queue) and n < most:
            part = queue[taken]
            if isinstance(part[0], tuple):
                size = part[0][1]
                own = min(size, most - n)
                got = []
                for at, _, kind in part:
                    self.file.seek(at)
                    got.append(np.fromfile(self.file, kind, own))
                rest = tuple((at + own * kind.itemsize, size - own, kind) for at, _, kind in part)
            else:
                size = len(part[0])
                own = min(size, most - n)
                got, rest = [c[:own] for c in part], tuple(c[own:] for c in part)
                self.held -= sum(c.nbytes for c in got)
            out.append(got)
            n += own
            if own < size:
                queue[taken] = rest
                break
            taken += 1
        del queue[:taken]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else None


def least(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of e[a:b] for each a < b, by minima of runs of 1, 2, 4, ... numbers."""
    out = np.empty(len(a), e.dtype)
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    runs = e
    for j in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == j)
        if len(own):
            out[own] = np.minimum(runs[a[own]], runs[b[own] - (1 << j)])
        if len(runs) > 1 << j:
            runs = np.minimum(runs[: -(1 << j)], runs[1 << j :])
    return out


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Equal symbols, up to depth, of suffixes at different places a and b."""
    out, live, k = np.zeros(len(a), np.int32), np.arange(len(a)), 0
    while len(live) and k < depth:
        live = live[text[a[live] + k] == text[b[live] + k]]
        k += 1
        out[live] = k
    return out


def small_ones(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last symbol must be the only smallest."""
    n = len(text)
    out = scratch.array(n, bool)
    out[n - 1] = True
    for b in range(n - 1, 0, -BLOCK):
        a = max(0, b - BLOCK)
        own = text[a : b + 1]
        differs = np.flatnonzero(own[1:] != own[:-1])
        at = np.searchsorted(differs, np.arange(b - a))
        known = at < len(differs)
        out[a:b] = out[b]
        nxt = differs[at[known]]
        out[a:b][known] = own[nxt] < own[nxt + 1]
    return out


class _Bands:
    """Symbols in bands: of one symbol if it is frequent or symbols are few, else of some 1/512 of the text."""

    def __init__(self, text: np.ndarray, symbols: int):
        counts = np.zeros(symbols, np.int64)
        for a in range(0, len(text), BLOCK):
            counts += np.bincount(text[a : a + BLOCK], minlength=symbols)
        if symbols <= BANDS:
            self.of = np.arange(symbols)
        else:
            quota = max(1, len(text) // BANDS)
            hot, part = counts > quota, (np.cumsum(counts) - counts) // quota
            new = (part[1:] != part[:-1]) | hot[1:] | hot[:-1]
            self.of = np.concatenate(([0], np.cumsum(new)))
        self.first = np.searchsorted(self.of, np.arange(int(self.of[-1]) + 2))


class _Induction:
    """One induction: upwards from seeds to large suffixes, or downwards from large suffixes to small ones."""

    def __init__(self, text, small, bands: _Bands, up: bool, depth: int, scratch: Scratch, track: bool):
        self.text, self.small, self.bands, self.up, self.depth, self.scratch, self.track = text, small, bands, up, depth, scratch, track
        self.symbols = len(bands.of)
        self.last = (-1, False, 0)
        self.lcp = np.int16 if depth < 32_000 else np.int32
        if track:
            self.source = np.full(self.symbols, -1, np.int64)  # symbol of the suffix behind the last push
            self.since = np.zeros(self.symbols, self.lcp)  # least common prefix emitted since that push
            self.touched = np.empty(0, np.int64)

    def _own_prefixes(self, sym, fixed, pos, lcp):
        """The common prefix of each tuple of a batch with the one emitted before."""
        before = np.concatenate(([self.last[0]], sym[:-1]))
        was = np.concatenate(([self.last[1]], fixed[:-1]))
        same = sym == before
        e = np.where(same, lcp, 0).astype(self.lcp)
        edge = np.flatnonzero(same & fixed & ~was)
        if len(edge):
            e[edge] = common(self.text, np.concatenate(([self.last[2]], pos))[edge], pos[edge], self.depth)
        return e

    def _emit(self, sym, fixed, pos, lcp, e=None):
        """The batch's own common prefixes with the tuple emitted before, and what it pushes: symbol, position, prefix."""
        if self.track and e is None:
            e = self._own_prefixes(sym, fixed, pos, lcp)
        has = np.flatnonzero(pos > 0)
        p = pos[has] - 1
        good = self.small[p] != self.up
        has, p = has[good], p[good]
        s = self.text[p].astype(np.int64)
        order = np.argsort(s, kind="stable")
        s, p, has = s[order], p[order], has[order]
        pushed = self._prefixes(s, has, sym, e) if self.track and len(s) else np.empty(len(s), self.lcp)
        if self.track and not len(s):
            self._pass_by(sym, e)
        self.last = (int(sym[-1]), bool(fixed[-1]), int(pos[-1]))
        return e, s, p, pushed

    def _pass_by(self, sym, e):
        if len(self.touched) and sym[0] == sym[-1] == self.last[0]:
            self.since[self.touched] = np.minimum(self.since[self.touched], e.min())
        else:
            self.touched = np.empty(0, np.int64)

    def _prefixes(self, s, at, sym, e):
        new = np.concatenate(([True], s[1:] != s[:-1]))
        out = np.empty(len(s), np.int32)
        later = np.flatnonzero(~new)
        if len(later):
            out[later] = least(e, at[later - 1] + 1, at[later] + 1)
        first = np.flatnonzero(new)
        c, i = s[first], at[first]
        so_far = np.minimum.accumulate(e)
        out[first] = np.where(self.source[c] < 0, -1, np.where(self.source[c] == sym[i], np.minimum(self.since[c], so_far[i]), 0))
        end = np.flatnonzero(np.concatenate((s[1:] != s[:-1], [True])))
        c, i = s[end], at[end]
        self._pass_by(sym, e)
        self.touched = np.unique(np.concatenate((self.touched, c[sym[i] == sym[-1]])))
        self.source[c] = sym[i]
        to_end = np.append(np.minimum.accumulate(e[::-1])[::-1], self.depth)
        self.since[c] = to_end[i + 1]
        return np.minimum(out + 1, self.depth).astype(self.lcp)

    def run(self, places: np.ndarray, prefixes: np.ndarray | None):
        """Batches (positions, prefixes, whether given) in order of emission; places are given, in that order."""
        n, top, bands = len(places), self.symbols - 1, self.bands
        queues = Queues(int(bands.of[-1]) + 1, self.scratch)
        counts = np.zeros(self.symbols, np.int64)
        for a in range(0, n, BLOCK):
            counts += np.bincount(self.text[places[a : a + BLOCK]], minlength=self.symbols)
        ends = np.cumsum(counts) if self.up else np.cumsum(counts[::-1])
        given = lambda a, b: (places[a:b], prefixes[a:b] if self.track else np.zeros(b - a, self.lcp))
        at = 0
        many = range(len(bands.first) - 1)
        for band in many if self.up else reversed(many):
            lo, hi = int(bands.first[band]), int(bands.first[band + 1])
            until = int(ends[hi - 1] if self.up else ends[top - lo])
            if hi - lo == 1:
                mine, more = Queues(1, self.scratch), True  # what the band pushes into itself comes after what it had
                while True:
                    got = queues.pop(band, BATCH) if more else None
                    more = got is not None
                    if not more:
                        got = mine.pop(0, BATCH)
                    fixed = got is None
                    if fixed and at == until:
                        break
                    if fixed:
                        stop = min(until, at + BATCH)
                        pos, lcp = given(at, stop)
                        at = stop
                    else:
                        _, pos, lcp = got
                    flag = np.full(len(pos), fixed)
                    e, s, p, pushed = self._emit(np.full(len(pos), lo, np.int64), flag, pos, lcp)
                    yield pos, e, flag
                    here = s == lo
                    mine.push(np.zeros(int(here.sum()), np.int64), (s[here], p[here], pushed[here]))
                    to = ~here
                    queues.push(bands.of[s[to]], (s[to], p[to], pushed[to]))
                continue
            got = queues.pop(band, 1 << 62)
            pos, lcp = given(at, until)
            at = until
            sym, flag = self.text[pos].astype(np.int64), np.ones(len(pos), bool)
            if got is not None:
                sym, pos, lcp, flag = np.concatenate((got[0], sym)), np.concatenate((got[1], pos)), np.concatenate((got[2], lcp)), np.concatenate((np.zeros(len(got[0]), bool), flag))
            if not len(pos):
                continue
            whole = self._band(band, sym, pos, lcp, flag)
            if whole is not None:
                sym, pos, lcp, flag, e = whole
                e, s, p, pushed = self._emit(sym, flag, pos, lcp, e)
                yield pos, e, flag
                out = bands.of[s] != band
                queues.push(bands.of[s[out]], (s[out], p[out], pushed[out]))
                continue
            while True:
                key = 2 * (sym if self.up else top - sym) + flag
                order = np.argsort(key, kind="stable")
                key, sym, pos, lcp, flag = (x[order] for x in (key, sym, pos, lcp, flag))
                s = p = pushed = None
                while len(pos):
                    k = self._safe(key, pos)
                    e, s, p, pushed = self._emit(sym[:k], flag[:k], pos[:k], lcp[:k])
                    yield pos[:k], e, flag[:k]
                    key, sym, pos, lcp, flag = (x[k:] for x in (key, sym, pos, lcp, flag))
                    if len(s):
                        to = bands.of[s]
                        here = to == band
                        if not here.all():
                            queues.push(to[~here], (s[~here], p[~here], pushed[~here]))
                        if here.any():
                            s, p, pushed = s[here], p[here], pushed[here]
                            break
                    s = None
                if s is None:
                    break
                sym, pos, lcp, flag = np.concatenate((sym, s)), np.concatenate((pos, p)), np.concatenate((lcp, pushed)), np.concatenate((flag, np.zeros(len(s), bool)))

    def _band(self, band, sym, pos, lcp, flag):
        """All tuples of a band in order, with those that it pushes into itself; None if these go on for long.

        Which tuples there are does not depend on their order. They are ranked by symbol and, one of the band's own
        pushes, by the rank of what pushed it, until the ranks stay; likewise their common prefixes.
        """
        parts, start, own = [(sym, pos, lcp, flag, np.full(len(pos), -1))], 0, pos
        for wave in range(WAVES + 1):
            has = np.flatnonzero(own > 0)
            p = own[has] - 1
            good = self.small[p] != self.up
            has, p = has[good], p[good]
            s = self.text[p].astype(np.int64)
            here = np.flatnonzero(self.bands.of[s] == band)
            if not len(here):
                break
            if wave == WAVES:
                return None
            start += 0 if wave == 0 else len(parts[-2][0])
            parts.append((s[here], p[here].astype(pos.dtype), np.zeros(len(here), lcp.dtype), np.zeros(len(here), bool), start + has[here]))
            own = parts[-1][1]
        first = len(pos)
        sym, pos, lcp, flag, source = (np.concatenate(c) for c in zip(*parts, strict=True))
        key = 2 * (sym if self.up else self.symbols - 1 - sym) + flag
        second = np.arange(len(pos))
        rank = None
        while True:
            order = np.lexsort((second, key))
            new = np.empty(len(order), np.int64)
            new[order] = np.arange(len(order))
            if first == len(pos) or (rank is not None and np.array_equal(new, rank)):
                break
            rank = new
            second[first:] = first + rank[source[first:]]
        if self.track:
            made = np.flatnonzero(order >= first)  # places in order of the band's own pushes
            before = np.maximum(made - 1, 0)
            joined = (made > 0) & (key[order[made]] == key[order[before]])
            lcp = lcp.copy()
            lcp[order[made]] = np.where(joined, 1, 0)  # after one from an earlier band; or the first of its bucket
            both = np.flatnonzero(joined & (order[before] >= first))
            of, a, b = order[made[both]], new[source[order[before[both]]]] + 1, new[source[order[made[both]]]] + 1
            lcp[of] = self.depth
            e = self._own_prefixes(sym[order], flag[order], pos[order], lcp[order])
            at = made[both]
            while len(at):
                now = np.minimum(least(e, a, b) + 1, self.depth)
                if np.array_equal(now, e[at]):
                    break
                e[at] = now
        else:
            e = None
        return sym[order], pos[order], lcp[order], flag[order], e

    def _safe(self, key: np.ndarray, pos: np.ndarray) -> int:
        """How many tuples from the front none of what they push can overtake."""
        step = 4096
        for stop in (min(step, len(key)), min(BATCH, len(key))):
            p = np.maximum(pos[:stop], 1) - 1
            s = self.text[p].astype(np.int64)
            pushes = (self.small[p] != self.up) & (pos[:stop] > 0)
            to = np.where(pushes, 2 * (s if self.up else self.symbols - 1 - s), 1 << 62)
            late = np.flatnonzero(key[1:stop] > np.minimum.accumulate(to)[:-1])
            if len(late):
                return int(late[0]) + 1
        return stop


class Order:
    """All suffixes in order: `blocks` gives positions, and common prefixes (up to depth) with the one before each."""

    def __init__(self, emitted: np.ndarray, prefixes: np.ndarray | None, n: int):
        self.emitted, self.prefixes, self.n = emitted, prefixes, n

    def blocks(self, size: int | None = None):
        size = size or BLOCK
        m = self.n - 1
        yield np.array([m], self.emitted.dtype), np.zeros(1, np.int32)
        for b in range(m, 0, -size):
            a = max(0, b - size)
            lcp = np.zeros(b - a, np.int32)
            if self.prefixes is not None:
                if b == m:
                    lcp[1:] = self.prefixes[b - 1 : a : -1] if a else self.prefixes[b - 1 : 0 : -1]
                else:
                    lcp[:] = self.prefixes[b:a:-1]
            yield np.asarray(self.emitted[a:b])[::-1], lcp

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        pos, lcp = zip(*self.blocks(), strict=True)
        return np.concatenate(pos), np.concatenate(lcp)


def _induced(text, small, bands, seeds, prefixes, depth, scratch) -> Order:
    """The order that seeds (in order) induce; prefixes None: without common prefixes."""
    track = prefixes is not None
    up = _Induction(text, small, bands, True, depth, scratch, track)
    large, large_lcp = Spool(scratch, seeds.dtype), Spool(scratch, up.lcp)
    for pos, e, fixed in up.run(seeds, prefixes):
        large.append(pos[~fixed])
        if track:
            large_lcp.append(e[~fixed])
    places = large.finished()[::-1]
    if track:
        # going down, a tuple's prefix is the one that the next larger had
        given = large_lcp.finished()
        shifted = scratch.array(len(given), up.lcp)
        shifted[:-1] = given[1:]
        given = shifted[::-1]
    down = _Induction(text, small, bands, False, depth, scratch, track)
    every, lcp = Spool(scratch, seeds.dtype), Spool(scratch, up.lcp)
    for pos, e, _ in down.run(places, given if track else None):
        every.append(pos)
        if track:
            lcp.append(e)
    return Order(every.finished(), lcp.finished() if track else None, len(text))


def _named(text, seeds, ordered, depth, scratch) -> tuple[np.ndarray, np.ndarray]:
    """The string of names of the seeds' substrings, and of each name its common prefix with the name before."""
    n = len(seeds)
    names, edges = scratch.array(n, np.int64), Spool(scratch, np.int32)
    edges.append(np.zeros(1, np.int32))
    names[n - 1] = 0
    now = 0
    for a in range(1, n, BLOCK):
        b = min(n, a + BLOCK)
        pos = np.asarray(ordered[a - 1 : b])
        number = np.searchsorted(seeds, pos)
        length = np.minimum(np.where(number + 1 < n, seeds[np.minimum(number + 1, n - 1)] - pos, 0) + 1, depth + 1)
        x, y, lx, ly = pos[:-1], pos[1:], length[:-1], length[1:]
        short = np.minimum(lx, ly)
        same, live, k = np.zeros(len(x), np.int32), np.arange(len(x)), 0
        while len(live):
            live = live[text[x[live] + k] == text[y[live] + k]]
            k += 1
            same[live] = k
            live = live[short[live] > k]
        differs = (same < short) | (lx != ly)
        numbers = now + np.cumsum(differs)
        names[number[1:]] = numbers
        edges.append(same[differs])
        now = int(numbers[-1]) if len(numbers) else now
    return names, edges.finished()


def _by_names(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes of mostly different names, and common prefixes: only ties are looked at further."""
    order = np.argsort(names, kind="stable")
    rank = np.empty(len(names) + 1, np.int64)
    # a rank is the place of the first of its ties
    first_of = lambda new: np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    own = names[order]
    rank[order], rank[-1] = first_of(np.concatenate(([True], own[1:] != own[:-1]))), -1
    h = 1
    while h < depth:
        now = rank[order]
        tied = np.concatenate(([False], now[1:] == now[:-1]))
        tied[:-1] |= tied[1:]
        if not tied.any():
            break
        at = np.flatnonzero(tied)
        some, first = order[at], now[at]
        later = rank[np.minimum(some + h, len(names))]
        by = np.lexsort((later, first))
        order[at] = some[by]
        first, later = first[by], later[by]
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (later[1:] != later[:-1])))
        rank[order[at]] = at[first_of(new)]
        h *= 2
    lcp = np.zeros(len(names), np.int32)
    lcp[1:] = common(names, order[:-1], order[1:], depth)
    return order, lcp


def suffix_order(text: np.ndarray, depth: int, scratch: Scratch | None = None) -> Order:
    """All suffixes of text ordered by their first `depth` symbols at least. The last symbol must be 0 and the only one."""
    scratch = scratch or Scratch()
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    symbols = int(max(text[a : a + BLOCK].max() for a in range(0, n, BLOCK))) + 1
    small = small_ones(text, scratch)
    found = Spool(scratch, kind)
    for a in range(1, n, BLOCK):
        b = min(n, a + BLOCK)
        found.append(np.flatnonzero(small[a:b] & ~small[a - 1 : b - 1]) + a)
    seeds = found.finished()
    if not len(seeds):
        return Order(np.empty(0, kind), np.empty(0, np.int16), n)
    bands = _Bands(text, symbols)
    rough = seeds[np.argsort(text[seeds], kind="stable")]
    is_seed = scratch.array(n, bool)
    is_seed[seeds] = True
    ordered, at = scratch.array(len(seeds), kind), 0
    for pos, _ in _induced(text, small, bands, rough, None, depth, scratch).blocks():
        own = pos[is_seed[pos]]
        ordered[at : at + len(own)] = own
        at += len(own)
    names, edges = _named(text, seeds, ordered, depth, scratch)
    less = depth // 2 + 1  # two neighbouring seeds are two symbols apart at least
    if less <= 1 or len(edges) > MOSTLY * len(seeds):
        blocks = [_by_names(names, less)]
    else:
        blocks = suffix_order(names, less, scratch).blocks()
    in_order, prefixes = Spool(scratch, kind), Spool(scratch, np.int32)
    last = None
    for i, lcp in blocks:
        before = np.concatenate(([i[0] if last is None else last], i[:-1]))
        full = (lcp >= less) | (before == i)
        out = np.full(len(i), depth, np.int64)
        part = np.flatnonzero(~full)
        x, y = before[part] + lcp[part], i[part] + lcp[part]
        equal, shared = seeds[y] - seeds[i[part]], least(edges, names[x] + 1, names[y] + 1)
        # a substring that is the beginning of the other: what follows it differs from place to place
        to_end = lambda z: np.where(z + 1 < len(seeds), seeds[np.minimum(z + 1, len(seeds) - 1)] - seeds[z], 0) + 1
        whole = np.flatnonzero(shared >= np.minimum(to_end(x), to_end(y)))
        shared[whole] = common(text, seeds[x[whole]], seeds[y[whole]], depth)
        out[part] = equal + shared
        out[before == i] = 0
        in_order.append(seeds[i])
        prefixes.append(np.minimum(out, depth))
        last = i[-1]
    return _induced(text, small, bands, in_order.finished(), prefixes.finished(), depth, scratch)
