"""Removal of word passages that repeat earlier documents, by fixed-block anchors.

Non-overlapping blocks of ``block_words`` words of every document, counted from
its start, are the indexed anchors; every rolling window of as many words of
every document probes them.  Any repeat of ``window_words`` >= 2 * block_words - 1
words holds a whole block of the earlier document, so each has a hit.  Around
each hit the text is extended, window by window, as long as the words agree
exactly with a document of smaller id; the union of these windows is the maximal
repeated passage, and it goes.

Scale: texts are dealt once to chunks by a hash (one exchange, used three times).

1. A chunk sends a short hash of each *distinct* rolling window of a block's length
   once (3 to 5 bytes) to the bucket of its key range, with a mark if a block of its
   own says these words, and gets one bit back: a hit is a block that is indexed and
   whose words start at more than one place.  This is a filter; a chance agreement of
   hashes costs work, not words.  The hash widens with the input.
2. Windows of full length around a hit go on with their words.  Neighbouring windows
   that share the smallest block hash among theirs stand together as one stretch of
   words (four windows on average), once a chunk, with the smallest id that holds it,
   and meet all equal windows in the bucket of that hash.  There every window is
   compared with its like word by word, as bytes: hashes only bring them together.
   The bucket answers with one bit a window: whether a smaller id has the same words.
3. Windows that go, in a row, make the maximal repeated passages.

Nothing is collected or broadcast, no pair of documents is ever formed, and
a passage that every document holds costs one entry a chunk, however its copies are
aligned.

Null or empty texts have no words; very long ones are read whole.  A null id counts as
larger than all others.  Rows with equal ids are kept, and never count as earlier than
one another.  Columns other than id, text and ``rest`` are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from quernstone.llm import _chunks as C
from quernstone.llm._env import input_bytes, ship
from quernstone.llm._words import Words, mix, same_bytes

U = np.uint64
STRETCHES = "bucket int, chunk long, n int, sizes binary, firsts binary, words binary"
OUT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


def _bits(size: int) -> int:
    """Bits of a probe's hash: eight more than the words of an input of so many bytes need, in whole bytes."""
    return min(56, max(40, 8 * -(-(max(size, 1).bit_length() + 6) // 8)))


def _anchor_entries(chunk: int, table: pa.Table, block: int, bits: int, buckets: int) -> pa.Table:
    w = Words(table["text"])
    place, key = w.grams(block)
    key = key >> U(64 - bits)
    keys, order, number = C.distinct(key)
    row = np.searchsorted(w.first, place, side="right") - 1
    anchor = (place - w.first[row]) % block == 0
    count = np.minimum(np.bincount(number, minlength=len(keys)), 2)
    held = np.zeros(len(keys), bool)
    held[number[anchor[order]]] = True
    return C.entries(chunk, keys, (count + 4 * held).astype(np.uint64), bits, buckets)


def _hit(vals: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """1 where a block is indexed and its words start at more than one place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    anchored = np.bitwise_or.reduceat(vals & U(4), starts) > 0
    return (anchored & (np.add.reduceat(vals & U(3), starts) >= 2)).astype(np.uint64)


class Stretches:
    """The windows of full length that hold a hit, as stretches of words, each distinct one of the chunk once.

    place: the windows (word numbers); run: the stretch of each; entry: for each run
    the number of its distinct stretch; offset: the place of each window in its run.
    Distinct stretches are sorted by bucket and stand for the smallest id of theirs.
    """

    def __init__(self, w: Words, ids: np.ndarray, answers: pa.Table, block: int, window: int, bits: int, buckets: int, wide: int):
        place, h = w.grams(block)
        keys, order, number = C.distinct(h >> U(64 - bits))
        hit = C.read_answers(answers, keys, bits, buckets).astype(bool)
        at = np.zeros(len(w.hash) + 1, np.int32)
        at[place[order]] = hit[number]
        hits = np.concatenate(([0], np.cumsum(at)))
        least = np.full(len(w.hash) + 1, ~U(0))
        least[place] = h
        place, h = w.grams(window)
        near = hits[place + window - block + 1] - hits[place] > 0
        self.place, h = place[near], h[near]
        place = self.place
        low = least[place]
        for k in range(1, window - block + 1):
            np.minimum(low, least[place + k], out=low)
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (low[1:] != low[:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(place)))
        self.run = np.cumsum(new) - 1
        self.offset = np.arange(len(place)) - first[self.run] if len(place) else place
        # All words of the chunk, one space between: the bytes that are compared and sent.
        size = w.end - w.start
        begin = np.cumsum(size + 1) - (size + 1)
        total = int((size + 1).sum())
        self.words = np.full(total + 8, 32, np.uint8)
        to = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        self.words[to] = w.raw[to + np.repeat(w.start - begin, size)]
        a = place[first]
        self.low, self.high = begin[a], begin[a + many + window - 2] + size[a + many + window - 2]
        self.bucket = ((low[first] >> U(32)) * U(wide) >> U(32)).astype(np.int64)
        key = mix(h[first] ^ mix(h[first + many - 1] + many.astype(np.uint64)))
        order = np.lexsort((key, self.bucket))
        k, b = key[order], self.bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        lead = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        same = same_bytes(self.words, self.low[order], self.high[order], self.words, self.low[lead], self.high[lead])
        lead = np.where(same, lead, order)  # one that only hashes alike stands for itself
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        some = np.unique(rank[lead])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.searchsorted(some, rank[lead])
        self.leads = order[some]
        self.doc = ids[np.searchsorted(w.first, a, side="right") - 1]  # of each run
        self.first = np.full(len(some), C.NO_ID, np.int64)
        np.minimum.at(self.first, self.entry, self.doc)
        self.many = many[self.leads]  # windows of each distinct stretch

    def rows(self, chunk: int) -> pa.Table:
        size = (self.high - self.low)[self.leads]
        at = np.concatenate(([0], np.cumsum(size)))
        data = self.words[np.repeat(self.low[self.leads] - at[:-1], size) + np.arange(at[-1])].tobytes()
        own = self.bucket[self.leads]
        full, begin = np.unique(own, return_index=True)
        stop = np.append(begin[1:], len(own))
        firsts = self.first.view(np.uint64) ^ U(1 << 63)
        parts = [(C.pack(size[x:y]), C.pack(firsts[x:y]), data[at[x] : at[y]]) for x, y in zip(begin.tolist(), stop.tolist())]
        s, f, t = (list(x) for x in zip(*parts)) if parts else ([], [], [])
        return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array(np.full(len(full), chunk), pa.int64()), "n": pa.array(stop - begin, pa.int32()), "sizes": pa.array(s, pa.binary()), "firsts": pa.array(f, pa.binary()), "words": pa.array(t, pa.binary())})

    def goes(self, answers: pa.Table) -> np.ndarray:
        """For each window whether a smaller id holds its words."""
        bits = np.zeros(int(self.many.sum()), bool)
        at = np.concatenate(([0], np.cumsum(self.many)))
        own = self.bucket[self.leads]
        for b, v in zip(answers["bucket"].to_pylist(), answers["vals"].to_pylist()):
            x, y = at[np.searchsorted(own, b, "left")], at[np.searchsorted(own, b, "right")]
            bits[x:y] = np.unpackbits(np.frombuffer(v, np.uint8), count=y - x)
        entry = self.entry[self.run]
        return bits[at[entry] + self.offset] | (self.doc[self.run] > self.first[entry])


def equal_windows(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of texts whose words one space parts, and numbers that are equal where the words are, compared as bytes."""
    place, h = w.grams(window)
    keys, order, number = C.distinct(h)
    group = np.empty(len(place), np.int64)
    group[order] = number
    lead = np.empty(len(keys), np.int64)
    lead[number[::-1]] = order[::-1]
    padded = np.concatenate((w.raw, np.zeros(8, np.uint8)))
    low, high = w.start[place], w.end[place + window - 1]
    one = lead[group]
    other = ~same_bytes(padded, low, high, padded, low[one], high[one])
    if other.any():  # different words of one hash
        raw, names = w.raw.tobytes(), {}
        for k in np.flatnonzero(other).tolist():
            group[k] = len(keys) + names.setdefault(raw[low[k] : high[k]], len(names))
    return place, group


def _compared(table: pa.Table, window: int) -> pa.Table:
    n = table["n"].to_numpy()
    size = np.concatenate([C.unpack(x, m) for x, m in zip(table["sizes"].to_pylist(), n)]).astype(np.int64)
    first = (np.concatenate([C.unpack(x, m) for x, m in zip(table["firsts"].to_pylist(), n)]) ^ U(1 << 63)).view(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    w = Words(pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(b"".join(table["words"].to_pylist()))]))
    place, group = equal_windows(w, window)
    entry = np.searchsorted(w.first, place, side="right") - 1
    least = np.full(int(group.max()) + 1 if len(group) else 0, C.NO_ID, np.int64)
    np.minimum.at(least, group, first[entry])
    later = least[group] < first[entry]
    row = np.searchsorted(entry, np.concatenate(([0], np.cumsum(n))))
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "vals": pa.array([np.packbits(later[x:y]).tobytes() for x, y in zip(row[:-1], row[1:])], pa.binary())}).cast(pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("vals", pa.binary())]))


def _kept(table: pa.Table, marks: np.ndarray, w: Words) -> pa.Table:
    """marks: for each word whether it goes."""
    gone = np.concatenate(([0], np.cumsum(marks)))
    texts, digests = [], []
    raw = w.raw.tobytes()
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if gone[b] == gone[a]:
            kept = b" ".join(raw[w.start[a] : w.end[b - 1]].split()) if b > a else b""
        else:
            stay = a + np.flatnonzero(~marks[a:b])
            kept = b" ".join([raw[s:e] for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist())])
        texts.append(kept)
        digests.append(hashlib.sha256(kept).hexdigest())
    n = w.counts()
    out = pa.table({"doc_id": table["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone[w.first[1:]] - gone[w.first[:-1]], pa.int64()), "kept": pa.array(texts, pa.binary()).cast(pa.string()), "kept_sha256": pa.array(digests, pa.string())}).cast(_SCHEMA)
    return out.append_column("rest", table["rest"]).append_column("text", table["text"]) if "rest" in table.column_names else out


def _result(table: pa.Table, answers: pa.Table, compared: pa.Table, block: int, window: int, bits: int, buckets: int, wide: int) -> pa.Table:
    w, ids = Words(table["text"]), C.ids_of(table)
    near = Stretches(w, ids, answers, block, window, bits, buckets, wide)
    goes = near.place[near.goes(compared)]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, goes, 1)
    np.add.at(cover, goes + window, -1)
    return _kept(table, np.cumsum(cover)[:-1] > 0, w)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_words: int = 13, block_words: int = 7, rest: list[str] | None = None) -> DataFrame:
    """Each document without the words of repeated passages: doc_id, n_words, n_removed, kept (words joined by one space), kept_sha256.

    A word goes if it lies in ``window_words`` consecutive words of its document
    that also stand in a document with a smaller id; the input decides, not what
    is left of it.  rest: other columns to carry along, as the struct ``rest``;
    the unchanged ``text`` then comes, too.
    """
    if window_words < 2 * block_words - 1:
        raise ValueError("window_words must be at least 2 * block_words - 1")
    ship(docs.sparkSession)
    chunks, buckets = C.layout(docs)
    bits, wide = _bits(input_bytes(docs)), 2 * buckets
    rows = lambda: C.in_chunks(docs, id_col, text_col, chunks, rest)
    n, k = window_words, block_words

    def sent(key, table):
        return _anchor_entries(key[0].as_py(), table, k, bits, buckets)

    hits = C.answered(rows().groupBy("chunk").applyInArrow(sent, C.ENTRIES), _hit)

    def stretches(key, table, answers):
        return Stretches(Words(table["text"]), C.ids_of(table), answers, k, n, bits, buckets, wide).rows(key[0].as_py())

    def compare(table):
        return _compared(table, n)

    near = rows().groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(stretches, STRETCHES)
    compared = near.groupBy("bucket").applyInArrow(compare, C.ANSWERS)
    both = hits.selectExpr("chunk", "bucket", "vals", "0 as kind").unionAll(compared.selectExpr("chunk", "bucket", "vals", "1 as kind"))

    def result(key, table, answers):
        kind = answers["kind"].to_numpy()
        return _result(table, answers.filter(pa.array(kind == 0)), answers.filter(pa.array(kind == 1)), k, n, bits, buckets, wide)

    schema = StructType.fromDDL(OUT)
    if rest:
        schema = schema.add("rest", rows().schema["rest"].dataType).add("text", "string")
    return rows().groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(result, schema)
