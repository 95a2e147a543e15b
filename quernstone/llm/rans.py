"""A static range asymmetric numeral system coder for token ids, on whole arrays.

A segment holds the ids of consecutive documents.  One frequency table, counted
over the segment and scaled to 2**20, is shared by all its blocks.  A block is
2**16 ids, dealt in turn to 64 lanes, each with a 64-bit state that renormalises
by 32-bit words; the lanes' words interleave in one stream.  Blocks do not depend
on one another: each has its place, its lanes' states, a checksum of its ids, and
checkpoints (states and place in the stream) from which decoding can start
within the block.  numpy runs all lanes of all blocks, or all checkpointed
stretches, side by side.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from quernstone.llm._chunks import pack, unpack

U = np.uint64
MAGIC, SCALE, LANES, ROWS, EVERY = b"QTOK1", 20, 64, 1024, 256
LOW = U(1 << 31)
BLOCK = LANES * ROWS


def frequencies(count: np.ndarray) -> np.ndarray:
    """Counts (all positive) scaled to a sum of 2**SCALE, none below 1."""
    total = 1 << SCALE
    f = np.maximum(1, count.astype(np.float64) * total // count.sum()).astype(np.int64)
    order, spare = np.argsort(-f, kind="stable"), total - int(f.sum())
    if spare > 0:
        f[order[0]] += spare
    while spare < 0:
        cut = np.minimum(f[order] - 1, np.maximum(1, -spare * f[order] // total))
        room = np.minimum(np.cumsum(cut), -spare)
        f[order] -= np.diff(room, prepend=0)
        spare = total - int(f.sum())
    return f


def _field(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + data


def encode(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: documents, their numbers of ids, and all ids in order."""
    n = len(ids)
    blocks = max(1, -(-n // BLOCK))
    rows = ROWS if blocks > 1 else max(1, -(-n // LANES))
    count = np.bincount(ids, minlength=1) if n else np.ones(1, np.int64)
    symbol = np.flatnonzero(count)
    index, count = (np.cumsum(count > 0) - 1)[ids], count[symbol]
    f = frequencies(count).astype(np.uint64)
    c = np.concatenate(([U(0)], np.cumsum(f)[:-1].astype(np.uint64)))
    flat = np.full(blocks * rows * LANES, int(np.argmax(f)), np.int64)  # the last block is filled up with the commonest id
    flat[:n] = index
    grid = flat.reshape(blocks, rows, LANES)
    x = np.full((blocks, LANES), LOW, np.uint64)
    out = np.zeros((rows, blocks, LANES), np.uint32)
    wrote = np.zeros((rows, blocks, LANES), bool)
    marks = []
    top = (LOW >> U(SCALE)) << U(32)
    for r in range(rows - 1, -1, -1):
        s = grid[:, r, :]
        own = f[s]
        full = x >= top * own
        out[r] = x.astype(np.uint32)
        wrote[r] = full
        x = np.where(full, x >> U(32), x)
        q = x // own
        x = (q << U(SCALE)) + (x - q * own) + c[s]
        if r % EVERY == 0 and r:
            marks.append(x.copy())
    words = wrote.sum(axis=2)
    place = np.concatenate((np.zeros((1, blocks), np.int64), np.cumsum(words, axis=0)))
    streams = [out[:, b][wrote[:, b]] for b in range(blocks)]
    sums = np.array([zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) for b in range(blocks)], np.uint64)
    at_marks = place[[r for r in range(0, rows, EVERY)]].T
    states = np.stack([x, *marks[::-1]], axis=1)  # block, checkpoint, lane
    head = struct.pack("<5sBHIQQII", MAGIC, SCALE, LANES, rows, n, len(doc_ids), blocks, len(symbol))
    fields = [pack(symbol), pack(f), doc_ids.astype("<i8").tobytes(), pack(sizes), pack(place[-1]), pack(sums), pack(at_marks.ravel()), states.astype("<u8").tobytes(), np.concatenate(streams).astype("<u4").tobytes()]
    body = b"".join(map(_field, fields))
    return head + struct.pack("<I", zlib.crc32(body)) + body


class Segment:
    """A segment opened for decoding: its checksum verified, its table laid out, no id decoded yet."""

    def __init__(self, data: bytes):
        size = struct.calcsize("<5sBHIQQII")
        magic, self.scale, self.lanes, self.rows, self.n, docs, self.blocks, symbols = struct.unpack_from("<5sBHIQQII", data)
        if magic != MAGIC or zlib.crc32(data[size + 4 :]) != struct.unpack_from("<I", data, size)[0]:
            raise ValueError("not a segment, or a damaged one")
        fields, at = [], size + 4
        while at < len(data):
            m = struct.unpack_from("<Q", data, at)[0]
            fields.append(data[at + 8 : at + 8 + m])
            at += 8 + m
        self.parts = -(-self.rows // EVERY)
        self.symbol, self.f = unpack(fields[0], symbols).astype(np.int64), unpack(fields[1], symbols)
        self.doc_ids, self.sizes = np.frombuffer(fields[2], "<i8"), unpack(fields[3], docs).astype(np.int64)
        length, self.sums = unpack(fields[4], self.blocks).astype(np.int64), unpack(fields[5], self.blocks)
        start = np.concatenate(([0], np.cumsum(length)[:-1]))
        self.place = unpack(fields[6], self.blocks * self.parts).astype(np.int64).reshape(self.blocks, self.parts) + start[:, None]
        self.state = np.frombuffer(fields[7], "<u8").reshape(self.blocks, self.parts, self.lanes)
        self.words = np.append(np.frombuffer(fields[8], "<u4"), np.uint32(0))
        self.c = np.concatenate(([U(0)], np.cumsum(self.f)[:-1].astype(np.uint64)))
        self.slot = np.repeat(np.arange(symbols), self.f.astype(np.int64))

    def run(self, block: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The ids from each of these checkpoints to the next one, as stretches x rows x lanes."""
        x, place = self.state[block, part].astype(np.uint64), self.place[block, part]
        rest = np.minimum(EVERY, self.rows - part * EVERY)
        out = np.zeros((len(block), EVERY, self.lanes), np.int64)
        lowest = U((1 << self.scale) - 1)
        for r in range(int(rest.max())):
            low = x & lowest
            s = self.slot[low]
            out[:, r] = s
            x = self.f[s] * (x >> U(self.scale)) + low - self.c[s]
            need = (x < LOW) & (r < rest)[:, None]
            took = np.cumsum(need, axis=1)
            word = self.words[np.where(need, place[:, None] + took - 1, len(self.words) - 1)]
            x = np.where(need, (x << U(32)) | word, x)
            place = place + took[:, -1]
        return self.symbol[out]


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, their numbers of ids, all ids; every checkpointed stretch of every block at once, checksums verified."""
    s = Segment(data)
    block, part = (x.ravel() for x in np.indices((s.blocks, s.parts)))
    ids = s.run(block, part).reshape(s.blocks, s.parts * EVERY, s.lanes)[:, : s.rows].reshape(-1)[: s.n]
    for b in range(s.blocks):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != int(s.sums[b]):
            raise ValueError(f"the checksum of block {b} is wrong")
    return s.doc_ids, s.sizes, ids


def decode_from(data: bytes, block: int, checkpoint: int) -> tuple[int, np.ndarray]:
    """The ids from one checkpoint of one block to the next, alone, and the place of the first in the segment."""
    s = Segment(data)
    at = (block * s.rows + checkpoint * EVERY) * s.lanes
    rows = min(EVERY, s.rows - checkpoint * EVERY)
    return at, s.run(np.array([block]), np.array([checkpoint]))[0, :rows].reshape(-1)[: max(0, s.n - at)]
