"""Best partners of rows by text, amount and day: what joins.fuzzy_match does in a task, with numpy.

Rows that agree in everything but the key are one class; of a class the smallest key
stands for all.  A pair is scored only if it can reach what one of its ends has
already: equal texts nearest in amount give each class a first score, which leaves
to each gap of days some range of amounts and to each amount some number of edits.
Within the range, pairs are sifted by the bits of two signatures (which letters, how
often; which neighbours), each edit changing few bits; what is left is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLACK = 2e-6  # scores are rounded to six digits
ROWS, COLUMNS, BATCH, PART = 64, 4096, 1 << 17, 1 << 15


class Texts:
    """Distinct texts as code points, their signatures, and edit distances between them."""

    def __init__(self, texts: pa.Array):
        self.size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        seen = np.zeros(0x110000, bool)
        parts = []
        for at in range(0, len(texts), PART):
            parts.append(np.frombuffer("".join(texts[at : at + PART].to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32))
            seen[parts[-1]] = True
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.letters = max(1, int(seen.sum()))
        place = (np.cumsum(seen) - 1).astype(np.int32)
        self.flat = np.concatenate([place[part] for part in parts])
        self.bag, self.pairs = self._bags(), self._neighbours()

    def _bags(self) -> np.ndarray:
        """64 bits, each for a letter that occurs so many times at least; those that tell most are taken."""
        n, width = len(self.size), min(64, self.letters)
        common = np.argsort(-np.bincount(self.flat, minlength=self.letters), kind="stable")[:width]
        place = np.full(self.letters, width)
        place[common] = np.arange(width)
        counts = np.empty((n, width), np.uint8)
        for at, size, flat in self._parts():
            owner, letter = np.repeat(np.arange(len(size)), size), place[flat]
            kept = letter < width
            counts[at : at + len(size)] = np.minimum(np.bincount(owner[kept] * width + letter[kept], minlength=len(size) * width), 4).reshape(-1, width)
        events = [(float(p * (1 - p)), c, r) for r in range(1, 5) for c, p in enumerate((counts >= r).mean(axis=0))]
        out = np.zeros(n, np.uint64)
        for bit, (_, c, r) in enumerate(sorted(events, reverse=True)[:64]):
            out |= (counts[:, c] >= r).astype(np.uint64) << np.uint64(bit)
        return out

    def _neighbours(self) -> np.ndarray:
        """64 bits, each for some pairs of letters side by side."""
        out = np.zeros(len(self.size), np.uint64)
        for at, size, flat in self._parts():
            if len(flat):
                flat = flat.astype(np.int64)
                both = (flat * 31 + np.append(flat[1:], 0) * 17) * 0x9E3779B1 >> 16 & 63
                bits = np.uint64(1) << both.astype(np.uint64)
                some, start = np.flatnonzero(size), np.cumsum(size) - size
                bits[start[some] + size[some] - 1] = 0
                out[at + some] = np.bitwise_or.reduceat(bits, start[some])
        return out

    def _parts(self):
        """The first text's number, the sizes and the letters of some texts at a time."""
        for at in range(0, len(self.size), PART):
            size = self.size[at : at + PART]
            yield at, size, self.flat[self.start[at] :][: size.sum()]

    def edits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Levenshtein distance of texts x[i] and y[i]."""
        out = np.empty(len(x), np.int64)
        step = 8192 if self.letters <= 128 else max(64, (1 << 20) // self.letters)
        for at in range(0, len(x), step):
            a, b = x[at : at + step], y[at : at + step]
            m, n = self.size[a].copy(), self.size[b].copy()
            left = np.flatnonzero((m > 0) & (n > 0))
            while len(left):  # equal ends take no edit
                left = left[self.flat[self.start[a[left]] + m[left] - 1] == self.flat[self.start[b[left]] + n[left] - 1]]
                m[left] -= 1
                n[left] -= 1
                left = left[(m[left] > 0) & (n[left] > 0)]
            swap = m > n
            a, b, m, n = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n, m), np.where(swap, m, n)
            short = m <= 64
            got = n.copy()
            for which, way in ((short & (m > 0), self._bits), (~short, self._rows)):
                i = np.flatnonzero(which)
                if len(i):
                    i = i[np.argsort(-n[i], kind="stable")]
                    got[i] = way(a[i], b[i], m[i], n[i])
            out[at : at + step] = got
        return out

    def _bits(self, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Myers' algorithm, a column of up to 64 rows in a word; longer b first."""
        one, u = np.uint64(1), np.uint64
        texts, row = np.unique(a, return_inverse=True)
        table = np.zeros((len(texts), self.letters), u)
        for p in range(min(64, int(self.size[texts].max()))):
            has = np.flatnonzero(self.size[texts] > p)
            table[has, self.flat[self.start[texts[has]] + p]] |= one << u(p)
        table, base, start = table.ravel(), row * self.letters, self.start[b]
        score, high = m.copy(), (m - 1).astype(u)
        plus, minus = np.full(len(a), ~u(0)), np.zeros(len(a), u)
        counts = np.searchsorted(-n, -np.arange(int(n[0])), "left")
        for p, k in enumerate(counts):
            eq = table[base[:k] + self.flat[start[:k] + p]]
            pv, mv = plus[:k], minus[:k]
            xv = eq | mv
            xh = eq & pv
            xh += pv
            xh ^= pv
            xh |= eq
            ph = ~(xh | pv)
            ph |= mv
            mh = pv & xh
            score[:k] += ((ph >> high[:k] & one).astype(np.int64)) - ((mh >> high[:k] & one).astype(np.int64))
            ph <<= one
            ph |= one
            mh <<= one
            minus[:k] = ph & xv
            xv |= ph
            plus[:k] = mh | ~xv
        return score

    def _rows(self, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The plain table, a row at a time, few pairs at once."""
        out = np.empty(len(a), np.int64)
        step = max(1, (1 << 18) // int(m.max()))
        for at in range(0, len(a), step):
            s = slice(at, at + step)
            wide = np.arange(int(m[s].max()) + 1)
            own = self.flat[np.minimum(self.start[a[s]][:, None] + wide[None, :-1], len(self.flat) - 1)]
            row = np.tile(wide, (len(own), 1))
            for p in range(int(n[s].max())):
                k = int(np.searchsorted(-n[s], -p, "left"))
                there = self.flat[self.start[b[s]][:k] + p]
                new = np.empty_like(row[:k])
                new[:, 0] = p + 1
                new[:, 1:] = np.minimum(row[:k, 1:] + 1, row[:k, :-1] + (own[:k] != there[:, None]))
                row[:k] = np.minimum.accumulate(new - wide, axis=1) + wide
            out[s] = row[np.arange(len(row)), m[s]]
        return out


class Side:
    """The classes of one side by day and amount, and the best partner of each so far."""

    def __init__(self, code, day, a, at, told, rank, row, home, threshold):
        order = np.lexsort((a, day))
        self.code, self.day, self.a, self.at, self.told, self.rank, self.row, self.home = (v[order] for v in (code, day, a, at, told, rank, row, home))
        self.n = len(order)
        self.least = np.full(self.n, threshold - SLACK)
        self.score, self.by, self.partner = np.full(self.n, -np.inf), np.full(self.n, -1), np.full(self.n, -1)

    def of(self, day: int) -> slice:
        return slice(*np.searchsorted(self.day, [day, day + 1]))

    def take(self, i: np.ndarray, rank: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        """Better partners j of i: by score, then by key."""
        order = np.lexsort((rank, -score, i))
        i, rank, j, score = i[order], rank[order], j[order], score[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        i, rank, j, score = i[first], rank[first], j[first], score[first]
        better = (score > self.score[i]) | ((score == self.score[i]) & (rank < self.by[i]))
        i = i[better]
        self.score[i], self.by[i], self.partner[i] = score[better], rank[better], j[better]
        self.least[i] = np.maximum(self.least[i], self.score[i] - SLACK)


class Match:
    def __init__(self, table: pa.Table, weights: tuple[float, ...], threshold: float, days: int, described: bool):
        w = self.w = (*map(float, weights), 0.0)[: 4 if described else 3]
        self.days, self.threshold, self.described, self.full = days, threshold, described, 100.0 * sum(w)
        column = lambda c: pa.concat_arrays(table[c].chunks)
        self.keys = column("k")
        rank = pc.rank(self.keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        self.side, self.home = (column(c).to_numpy(zero_copy_only=False) for c in ("s", "home"))
        coded = column("x").dictionary_encode()
        self.texts = Texts(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        a = column("a").cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        a = a if w[1] > 0 else np.zeros(len(a))
        day = column("d").to_numpy(zero_copy_only=False).astype("datetime64[D]").astype(np.int64)
        day -= day.min() - days
        self.span = int(day.max()) + days + 1
        self.amounts, at = np.unique(a, return_inverse=True)
        told = np.zeros(len(a), np.int64)
        if described:
            tokens = column("t").dictionary_encode()
            self.tokens, told = [frozenset(t.split()) for t in tokens.dictionary.to_pylist()], tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = ((self.side * np.int64(len(coded.dictionary)) + code) * self.span + day) * len(self.amounts) + at
        if described:
            key = np.unique(key, return_inverse=True)[1] * len(self.tokens) + told
        order = np.lexsort((rank, key))
        fresh = np.append(True, key[order][1:] != key[order][:-1])
        first = order[fresh]
        self.group = np.empty(len(a), np.int64)
        self.group[order] = np.cumsum(fresh) - 1
        home = np.logical_or.reduceat(self.home[order], np.flatnonzero(fresh))
        self.sides = [Side(*(v[first][mine] for v in (code, day, a, at, told, rank)), first[mine], home[mine], threshold) for mine in (self.side[first] == 0, self.side[first] == 1)]
        self.waiting: list[tuple] = []
        self.held = 0

    def money(self, a, b):
        with np.errstate(invalid="ignore"):
            return np.fmax(0.0, 100.0 * (1 - np.abs(a - b) / np.fmax(np.fmax(np.abs(a), np.abs(b)), 0.01)))

    def total(self, text, money, gap):
        return self.w[0] * text + self.w[1] * money + self.w[2] * 100.0 * (1 - gap / (self.days + 1))

    def reach(self, a, part):
        """The amounts that lie no more than ``part`` of the larger one off."""
        part = np.minimum(np.maximum(part, 0.0), 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.where(part < 1, np.fmax(np.abs(a) / (1 - part), np.abs(a) + 0.01 * part), np.inf)
        near = np.where(part < 1, np.abs(a) - part * np.fmax(np.abs(a), 0.01), -np.inf)
        far, near = far + far * 1e-9, near - np.abs(np.where(np.isfinite(near), near, 0)) * 1e-9
        return np.where(a < 0, -far, near), np.where(a < 0, -near, far)

    def of_text(self, one: Side):
        """Order and sorted places by text, day and amount."""
        place = (one.code * self.span + one.day) * len(self.amounts) + one.at
        order = np.argsort(place)
        return order, place[order]

    def first_bounds(self) -> None:
        """Of equal texts, those nearest in amount."""
        places = [self.of_text(s) for s in self.sides]
        for one, other, (order, there) in ((*self.sides, places[1]), (*self.sides[::-1], places[0])):
            for gap in range(-self.days, self.days + 1):
                asked = (one.code * self.span + one.day + gap) * len(self.amounts) + one.at
                place = np.searchsorted(there, asked)
                for k in (place - 1, place):
                    j = order[np.clip(k, 0, other.n - 1)]
                    fits = (k >= 0) & (k < other.n) & (other.code[j] == one.code) & (other.day[j] == one.day + gap)
                    score = self.total(100.0, self.money(one.a, other.a[j]), abs(gap))
                    one.least = np.where(fits, np.maximum(one.least, score - SLACK), one.least)
        self.start = [s.least.copy() for s in self.sides]
        for one in self.sides:
            one.least[~one.home] = np.inf  # nobody asks for their partners here
        for side, (one, other, (order, there)) in enumerate(((*self.sides, places[1]), (*self.sides[::-1], places[0]))):
            for gap in range(-self.days, self.days + 1):
                room = self.full - self.start[side] - self.w[2] * 100.0 * abs(gap) / (self.days + 1) + 1e-9
                i = np.flatnonzero(one.home & (room >= 0))
                low, high = self.reach(one.a[i], room[i] / (100.0 * self.w[1]) if self.w[1] > 0 else np.ones(len(i)))
                base = (one.code[i] * self.span + one.day[i] + gap) * len(self.amounts)
                lo, hi = np.searchsorted(there, base + np.searchsorted(self.amounts, low, "left")), np.searchsorted(there, base + np.searchsorted(self.amounts, high, "right"))
                i, lo, hi = (v[hi > lo] for v in (i, lo, hi))
                while len(i):
                    n = max(1, int(np.searchsorted(np.cumsum(hi - lo), BATCH, "right")))
                    count = hi[:n] - lo[:n]
                    ends = np.cumsum(count)
                    me, it = np.repeat(i[:n], count), order[np.arange(ends[-1]) - np.repeat(ends - count - lo[:n], count)]
                    self.offer(*((me, it) if side == 0 else (it, me)), np.full(len(me), abs(gap)), side)
                    i, lo, hi = i[n:], lo[n:], hi[n:]

    def search(self, side: int) -> None:
        """Partners of the classes of one side, other than by equal texts."""
        (one, other), start, theirs = (self.sides if side == 0 else self.sides[::-1]), self.start[side], self.start[1 - side]
        w, size, bag = self.w, self.texts.size, self.texts.bag
        for gap in sorted(range(-self.days, self.days + 1), key=abs):
            room = self.full - start - w[2] * 100.0 * abs(gap) / (self.days + 1) + 1e-9
            left = room - 100.0 * w[0] / (size[one.code] + 1)  # after one edit
            for day in np.unique(one.day[one.home & (left >= 0)]):
                mine, there = one.of(day), other.of(day + gap)
                i = np.flatnonzero(one.home[mine] & (left[mine] >= 0)) + mine.start
                j = np.arange(there.start, there.stop)
                if side == 1:  # the other pairs were met from there
                    j = j[~other.home[j] | (theirs[j] > start[i].min() + 1e-9)]
                if not len(j):
                    continue
                amounts, length, bits = other.a[j], size[other.code[j]], bag[other.code[j]]
                for at in range(0, len(i), ROWS):
                    rows = i[at : at + ROWS]
                    most, least, largest = left[rows].max(), one.a[rows[0]], one.a[rows[-1]]
                    lo, hi = 0, len(j)
                    if w[1] > 0 and most < 100.0 * w[1]:
                        low, high = self.reach(np.array([least, largest]), most / (100.0 * w[1]))
                        lo, hi = np.searchsorted(amounts, low[0], "left"), np.searchsorted(amounts, high[1], "right")
                    for c in range(lo, hi, COLUMNS):
                        e = min(hi, c + COLUMNS)
                        if w[0] <= 0:
                            self.wait(side, np.repeat(rows, e - c), np.tile(j[c:e], len(rows)), gap)
                            continue
                        off = np.fmin(1.0, np.fmax(0.0, np.fmax(least - amounts[c:e], amounts[c:e] - largest)) / np.fmax(np.fmax(np.abs(amounts[c:e]), 0.01), max(abs(least), abs(largest))))
                        rest = np.clip(room[rows].max() - 100.0 * w[1] * off, 0.0, None)
                        edits = np.where(rest < 100.0 * w[0], rest * length[c:e] / np.maximum(100.0 * w[0] - rest, 1e-12) + 1e-9, 64)
                        edits = np.minimum(edits, 32).astype(np.uint8) * np.uint8(2)
                        r, k = np.nonzero(np.bitwise_count(bag[one.code[rows]][:, None] ^ bits[None, c:e]) <= edits)
                        self.wait(side, rows[r], j[c + k], gap)
        self.flush(side)

    def wait(self, side: int, i: np.ndarray, j: np.ndarray, gap: int) -> None:
        self.waiting.append((i, j, np.full(len(i), abs(gap), np.int8)))
        self.held += len(i)
        if self.held >= BATCH:
            self.flush(side)

    def flush(self, side: int) -> None:
        if self.held:
            i, j, gap = map(np.concatenate, zip(*self.waiting))
            for at in range(0, len(i), BATCH):
                s = slice(at, at + BATCH)
                self.offer(*((i[s], j[s]) if side == 0 else (j[s], i[s])), gap[s], side)
        self.waiting, self.held = [], 0

    def offer(self, i: np.ndarray, j: np.ndarray, gap: np.ndarray, side: int) -> None:
        """Score pairs that can be the best of one of their ends."""
        (left, right), w, texts = self.sides, self.w, self.texts
        money = self.money(left.a[i], right.a[j])
        most = self.total(100.0, money, gap) + (100.0 * w[3] if self.described else 0.0)
        need = np.minimum(left.least[i], right.least[j])
        need = np.maximum(need, self.start[side][i if side == 0 else j])
        x, y = left.code[i], right.code[j]
        longer = np.maximum(texts.size[x], texts.size[y])
        fits = most >= need
        if w[0] > 0:
            allowed = np.minimum(longer, np.floor((most - need) / (100.0 * w[0]) * longer + 1e-9))
            differ = lambda bits: np.maximum(np.bitwise_count(bits[x] & ~bits[y]), np.bitwise_count(bits[y] & ~bits[x]))
            fits &= (np.abs(texts.size[x] - texts.size[y]) <= allowed) & (differ(texts.bag) <= allowed)
            fits &= differ(texts.pairs) <= 2 * allowed
        i, j, gap, money, need, x, y, longer = (v[fits] for v in (i, j, gap, money, need, x, y, longer))
        if w[0] > 0 and len(i):
            edits = np.zeros(len(i), np.int64)
            other = np.flatnonzero(x != y)
            edits[other] = texts.edits(x[other], y[other])
            near = edits <= allowed[fits]
            i, j, gap, money, need, longer, edits = (v[near] for v in (i, j, gap, money, need, longer, edits))
            text = np.where(longer == 0, 100.0, 100.0 * (1 - edits / np.maximum(longer, 1)))
        else:
            text = np.full(len(i), 0.0)
        score = self.total(text, money, gap)
        if self.described:
            told = [(self.tokens[p], self.tokens[q]) for p, q in zip(left.told[i].tolist(), right.told[j].tolist())]
            score = score + w[3] * np.array([100.0 * len(p & q) / len(p | q) if p or q else 100.0 for p, q in told])
        score = np.floor(score * 1e6 + 0.5) / 1e6
        good = (score >= self.threshold) & (score >= need)
        i, j, score = i[good], j[good], score[good]
        if len(i):
            left.take(i, right.rank[j], j, score)
            right.take(j, left.rank[i], i, score)

    def found(self) -> pa.Table:
        """s, k, p, score of the rows at home here that have a partner."""
        if self.sides[0].n and self.sides[1].n:
            self.first_bounds()
            self.search(0)
            self.search(1)
        n = sum(s.n for s in self.sides)
        score, partner = np.full(n, -np.inf), np.zeros(n, np.int64)
        for one, other in (self.sides, self.sides[::-1]):
            has = one.partner >= 0
            g = self.group[one.row[has]]
            score[g], partner[g] = one.score[has], other.row[one.partner[has]]
        rows = np.flatnonzero(self.home & (score[self.group] >= self.threshold))
        g = self.group[rows]
        return pa.table({"s": pa.array(self.side[rows], pa.int32()), "k": self.keys.take(pa.array(rows)), "p": self.keys.take(pa.array(partner[g])), "score": pa.array(score[g])})
