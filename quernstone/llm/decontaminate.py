"""Benchmark decontamination under edit distance, by the CGK embedding and bit-sampling LSH.

Texts are sequences of terms (runs of letters and digits, lower-cased), so
case, punctuation and line breaks do not hide a passage.  An item of n terms
leaks into a document if some stretch of the document has an edit distance (in
terms) of at most ``floor(max_edit * n)`` to the whole item.

The CGK embedding walks over a sequence: at step j it emits the current term and
goes on to the next one if random bit j of that term says so.  Two sequences at a
small edit distance fall into step again, so their embeddings have a small
Hamming distance, and sampled places of the embeddings agree.  Windows start at
every ``STRIDE``-th term of a document and, for an item, at each of its first
``STRIDE`` terms, so that some window of the document starts exactly where one of
the item's does.  The windows of items are taken at further starts all along the
item as well, so one edit near its start does not hide it.  Each of ``WALKS``
walks is sampled ``SAMPLES`` times at ``PLACES`` of its first ``STEPS`` places;
every agreement with an item's key, near which at least two thirds of the item's
next ``LOOK`` terms stand, is a candidate, and an exact edit distance decides.

Short items (fewer than ``SHORT`` terms) have too little room for a sample of
places.  They are cut into one piece more than the edits they allow, so one piece
stands unchanged in any leak; a piece is a window of its own, whose whole embedding
(no place left out) is the key, and every place of a document is probed.  So no leak
of a short item is missed.  Items without terms leak nowhere.

Documents stream through one pass without a shuffle; the keys of the items are
broadcast, in blocks of at most ``BLOCK`` items and about ``BLOCK_BYTES`` of text, one
pass a block, so neither grows with the documents.  Candidates of one document are
verified one by one, so no pair of documents is ever formed; windows that agree with
very many items (a shared beginning) are compared in slices of ``SLICE`` pairs.

Null and empty texts hold nothing; null item ids are kept; very long texts are read
whole.  Repeated documents each get their rows, and so does a leak of each of several
equal items; ties among matches of one item go to the smallest distance, then the
first place.  Other columns, whatever their names, are not read by ``find_leaks`` and
unchanged by ``decontaminate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._env import ship
from quernstone.llm._words import U, Words, mix

STRIDE, STEPS, WALKS, SAMPLES, PLACES, SHORT = 4, 16, 4, 4, 4, 14
BLOCK, BLOCK_BYTES, SLICE = 20_000, 32 << 20, 1 << 18
LOOK = 12
LEAKS = "doc_id long, item_id long, start long, distance int, item_words int"


def _samples() -> np.ndarray:
    """Places of the embedding that each sample of each walk takes: walks x samples x places."""
    rng = np.random.default_rng(97)
    part = STEPS // PLACES  # one place in each part: the walk may stay at a term for a few steps
    return np.arange(PLACES) * part + rng.integers(0, part, (WALKS, SAMPLES, PLACES))


def cgk_keys(term: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sample of each walk the windows (numbers of ``start``) whose sampled places all lie before ``stop``, and their keys."""
    last = len(term) - 1
    out = []
    for walk, places in enumerate(_samples()):
        bits = mix(term + U(0x9E3779B97F4A7C15 * (walk + 1) & 0xFFFFFFFFFFFFFFFF))
        at = start.copy()
        key = [np.full(len(start), U(walk + 1)) for _ in range(SAMPLES)]
        whole = [np.ones(len(start), bool) for _ in range(SAMPLES)]
        for j in range(STEPS):
            here = np.minimum(at, last)
            for k in range(SAMPLES):
                if j in places[k]:
                    key[k] *= U(0xD6E8FEB86659FD93)
                    key[k] += term[here]
                    key[k] ^= key[k] >> U(29)
                    if j == places[k][-1]:
                        whole[k] = at < stop
            at += ((bits[here] >> U(j)) & U(1)).astype(np.int64)
        for k in range(SAMPLES):
            own = np.flatnonzero(whole[k])
            out.append((own, mix(key[k][own])))
    return out


def whole_keys(term: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Keys of windows of ``size`` terms: the first walk's whole embedding, of two steps a term, with a mark after the window's end."""
    bits = mix(term + U(0x9E3779B97F4A7C15))
    last, at, key = len(term) - 1, start.copy(), np.full(len(start), U(size))
    for j in range(2 * size):
        here = np.minimum(at, last)
        inside = at < start + size
        key *= U(0xD6E8FEB86659FD93)
        key += np.where(inside, term[here], U(1))
        key ^= key >> U(29)
        # The walk must have seen every term: from where it could no longer, it goes on.
        must = (start + size - at) >= 2 * size - j
        at += (must | ((bits[here] >> U(j & 63)) & U(1)).astype(bool)).astype(np.int64)
    return mix(key)


def _terms(texts) -> Words:
    return Words(pc.utf8_lower(texts.cast(pa.large_string())), lower=True, terms=True)


class Items:
    """The keys of a block of items, sorted, with the item and the offset of each."""

    def __init__(self, ids: list, texts: list, max_edit: float):
        w = _terms(pa.array(texts, pa.string()))
        self.ids, self.size = ids, w.counts()
        self.terms = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.flat, self.first = np.append(w.hash, np.zeros(LOOK, np.uint64)), w.first
        row = w.row_of_word()
        place = np.arange(len(row))
        offset = place - w.first[row]
        # Every term from which an item still has as many terms as a walk needs on average.
        use = (self.size[row] >= SHORT) & ((offset < STRIDE) | (self.size[row] - offset >= STEPS // 2 + 2))
        start = place[use]
        keys = cgk_keys(w.hash, start, w.first[1:][row[start]])
        self.tables = []
        for own, k in keys:
            order = np.argsort(k, kind="stable")
            at = start[own[order]]
            self.tables.append((k[order], row[at], offset[at]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(np.concatenate([t[0] for t in self.tables]) >> U(44)).astype(np.int64)] = True
        # size of a piece -> its keys, sorted, with the item and the offset of each
        self.short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        pieces: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero((self.size > 0) & (self.size < SHORT)).tolist():
            many = allowed(int(self.size[i]), max_edit) + 1
            edges = [k * int(self.size[i]) // many for k in range(many + 1)]
            for x, y in zip(edges[:-1], edges[1:]):
                if y > x:
                    pieces.setdefault(y - x, []).append((i, x))
        for n, own in sorted(pieces.items()):
            item, offset = np.array(own, np.int64).T
            k = whole_keys(w.hash, w.first[item] + offset, n)
            order = np.argsort(k, kind="stable")
            self.short[n] = k[order], item[order], offset[order]

    def _alike(self, w: Words, item: np.ndarray, start: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Of windows that agree, those where at least two thirds of the item's next terms stand near by; their item and place."""
        if not len(item):
            return np.zeros((0, 2), np.int64)
        step = np.arange(LOOK)
        inside = offset[:, None] + step < self.size[item][:, None]
        mine = self.flat[(self.first[item] + offset)[:, None] + step]
        theirs = w.hash[np.clip(start[:, None] + np.arange(-2, LOOK + 2), 0, len(w.hash) - 1)]
        both = ((mine[:, :, None] == theirs[:, None, :]).any(axis=2) & inside).sum(axis=1)
        keep = 3 * both >= 2 * inside.sum(axis=1)
        return np.stack((item[keep], start[keep] - offset[keep]), axis=1)

    def candidates(self, w: Words) -> np.ndarray:
        """item, place: distinct pairs of an item and the term of the documents at which it would start."""
        row = w.row_of_word()
        start = np.flatnonzero((np.arange(len(row)) - w.first[row]) % STRIDE == 0)
        found = [np.zeros((0, 2), np.int64)]
        for (table, item, offset), (own, keys) in zip(self.tables, cgk_keys(w.hash, start, w.first[1:][row[start]])):
            seen = np.flatnonzero(self.maybe[(keys >> U(44)).astype(np.int64)])
            for k, at in agreeing(table, keys[seen]):
                found.append(self._alike(w, item[k], start[own[seen[at]]], offset[k]))
        for n, (table, item, offset) in self.short.items():
            place = np.flatnonzero(w.first[1:][row] - np.arange(len(row)) >= n)
            for k, at in agreeing(table, whole_keys(w.hash, place, n)):
                found.append(np.stack((item[k], place[at] - offset[k]), axis=1))
        return np.unique(np.concatenate(found), axis=0)


def agreeing(table: np.ndarray, keys: np.ndarray):
    """Numbers of the entries of a sorted table and of the keys that agree, in slices of about SLICE pairs."""
    a, n = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
    n -= a
    some = np.flatnonzero(n)
    total = np.cumsum(n[some])
    for part in np.split(some, np.searchsorted(total, np.arange(SLICE, int(total[-1]) if len(total) else 0, SLICE))):
        for low in range(0, int(n[part].max()) if len(part) else 0, SLICE):  # a key with more entries than a slice
            m = np.clip(n[part] - low, 0, SLICE)
            yield np.repeat(a[part] + low - (np.cumsum(m) - m), m) + np.arange(int(m.sum())), np.repeat(part, m)


def allowed(n: int, max_edit: float) -> int:
    """Edits that a leak of an item of n terms may have."""
    return int(max_edit * n + 1e-9)


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where the first such stretch of least length starts."""
    m = len(text)
    cost, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    step = np.arange(m + 1)
    for i, t in enumerate(item, 1):
        change = np.concatenate(([i], cost[:-1] + (text != t)))
        drop = cost + 1
        new = np.where(change <= drop, change, drop)
        new[0] = i
        came = np.where(change <= drop, np.concatenate(([0], origin[:-1])), origin)
        run = np.minimum.accumulate(new - step)
        best = run + step
        src = np.maximum.accumulate(np.where(new - step == run, step, -1))
        origin = np.where(best < new, came[src], came)
        cost = best
    k = np.flatnonzero(cost == cost.min())
    k = k[np.argmin(k - origin[k])]
    return int(cost[k]), int(origin[k])


def leaks(items: Items, texts, max_edit: float) -> list[tuple[int, int, int, int]]:
    """row, item, start term, distance: the best match of each item in each row that holds it."""
    w = _terms(texts)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for item, place in items.candidates(w).tolist():
        n = int(items.size[item])
        most = allowed(n, max_edit)
        # The item may start up to ``most`` terms off; its row is where most of it lies.
        row = int(np.searchsorted(w.first, max(place, 0), side="right") - 1)
        for r in {row, int(np.searchsorted(w.first, min(max(place, 0) + most, len(w.hash) - 1), side="right") - 1)}:
            low, high = int(w.first[r]), int(w.first[r + 1])
            if out.get((r, item), (1,))[0] == 0:
                continue
            own = w.hash[place : place + n] if place >= low and place + n <= high else None
            if own is not None and (own == items.terms[item]).all():
                got = (0, place - low)
            else:
                a, b = max(low, place - 2 * most), min(high, place + n + 2 * most)
                if b <= a:
                    continue
                if np.isin(items.terms[item], w.hash[a:b]).sum() < n - most:  # no such distance is possible
                    continue
                distance, start = best_match(items.terms[item], w.hash[a:b])
                if distance > most:
                    continue
                got = (distance, a + start - low)
            if (r, item) not in out or got < out[r, item]:
                out[r, item] = got
    return [(r, i, s, d) for (r, i), (d, s) in sorted(out.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_edit: float = 0.15) -> DataFrame:
    """One row a document and item that it holds: doc_id, item_id, start (term of the document), distance, item_words."""
    ship(docs.sparkSession)
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for held in _item_blocks(bench, max_edit):

        def run(batches, held=held):
            items = held.value
            for batch in batches:
                ids = batch.column("doc_id")
                found = leaks(items, batch.column("text"), max_edit)
                r, i, s, d = (list(x) for x in zip(*found)) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r, pa.int64())), pa.array([items.ids[k] for k in i], pa.int64()), pa.array(s, pa.int64()), pa.array(d, pa.int32()), pa.array([int(items.size[k]) for k in i], pa.int32())], ["doc_id", "item_id", "start", "distance", "item_words"])

        part = rows.mapInArrow(run, LEAKS)
        out = part if out is None else out.unionAll(part)
    return out


def _item_blocks(bench: DataFrame, max_edit: float) -> list:
    """Broadcasts of the items, in blocks that a hash cuts; at least one."""
    size = bench.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-size[0] // BLOCK), -(-int(size[1] or 0) // BLOCK_BYTES))
    out = []
    for n in range(blocks):
        got = sorted(bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text or ""))
        out.append(bench.sparkSession.sparkContext.broadcast(Items([r.item_id for r in got], [r.text for r in got], max_edit)))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_edit: float = 0.15) -> DataFrame:
    """docs without the rows whose text holds an item, whatever their ids; rows pass each block of items in place, without a shuffle or a join."""
    ship(docs.sparkSession)
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    names = docs.columns
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    for held in _item_blocks(bench, max_edit):

        def clean(batches, held=held):
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                stay[[r for r, *_ in leaks(held.value, batch.column("text"), max_edit)]] = False
                yield batch if stay.all() else batch.filter(pa.array(stay))

        out = out.mapInArrow(clean, out.schema)
    return out.select("row.*")
