"""Token-id files: ids of all documents in ascending order of doc_id, in segments of a static range coder.

Documents are range-partitioned and sorted by id, so file order is id order.  A
task tokenises its documents with the tokenizers library, appends the end id to
each, and writes segments of about ``SEGMENT`` ids (see :mod:`rans`), one a row
of a Parquet container, which Spark commits atomically on any file system that
it can reach and which lets each executor decode its own segments.  Where a
document starts in the whole corpus follows on reading from the segments' sizes;
no second pass over texts and no global count is needed to write.

The library is fast on distinct text only: texts are cut where a run of white
space starts, which its byte-level pattern always does, too, and each distinct
piece is encoded once a worker, with a cache of bounded size.  Pieces are looked up
by a hash and then compared byte by byte; texts with a piece whose hash is that of
another piece are encoded whole.

Null texts are empty: the end id alone.  Null ids come first.  Equal ids stand
side by side, by a hash of their text, and are dealt over partitions by it, too, so
rows without an id, however many, need no single task; repeated rows are each
written.  Very long texts are encoded whole.  Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm import rans
from quernstone.llm._env import input_bytes, release, ship
from quernstone.llm._words import Words, mix, same_bytes
from quernstone.llm.bpe import byte_symbols, read_model, waves

SEGMENT, CACHE_STEMS, JOINED, WAVE_BYTES = 1 << 21, 600_000, 2000, 5_000_000
NULL_ID = -(1 << 63)
MOST_BROADCAST = 500_000
CONTAINER = "part int, seq int, docs long, tokens long, payload binary"
FIRST = "\x1e"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PLAIN = re.compile(r"[^\s\x1e]\S*")


class _Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class LibraryEncoder:
    """Whole-text encoding of a byte-level tokenizers file by way of distinct pieces and stems.

    A piece goes from the start of one run of white space to the next.  It is a
    stem and the punctuation after its last letter or digit; the pattern always
    parts these.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_buffer(model)
        self.added = [t["content"] for t in json.loads(model).get("added_tokens", [])]
        self.symbol = dict(enumerate(byte_symbols()))
        self.tok.no_padding()
        self.tok.no_truncation()
        one = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.line = one("\n")
        self.joins = len(self.line) == 1 and one(" a\n b") == [*one(" a"), *self.line, *one(" b")]
        self.parts = all(one(f" a{c}") == [*one(" a"), *one(c)] for c in MARKS)
        self.lines = one("\nab") == [*self.line, *one("ab")]
        self.alone = self._alone(["ab", FIRST + "Straße"]) == [one(" ab"), one("Straße")] and self._alone(["ab", "Straße", "日本", "12"]) == [one(t) for t in (" ab", " Straße", " 日本", " 12")]
        self.clear()

    def clear(self) -> None:
        self.stem = _Numbers()
        self.coded = 0
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.known, self.parts_of = np.zeros(0, np.uint64), np.zeros((0, 3), np.int32)
        self.store, self.place = np.zeros(8, np.uint8), np.zeros((0, 2), np.int64)  # the bytes of the known pieces; where each starts and ends

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        for t in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        own = np.flatnonzero(odd)
        for n in range(0, len(own), JOINED):
            some = own[n : n + JOINED]
            for k, e in zip(some, self.tok.encode_batch_fast(texts.take(pa.array(some)).to_pylist(), add_special_tokens=False)):
                out[k] = np.array(e.ids, np.uint32)
        plain = np.flatnonzero(~odd)
        for k, ids in zip(plain, self._encode_plain(texts.filter(pa.array(~odd)) if len(own) else texts)):
            out[k] = ids
        return out

    def _encode_plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Texts without odd white space or added tokens: a piece is a run of white space and the word after it."""
        w = Words(texts)
        raw, at = w.raw, w.at
        first, last = w.first[:-1], w.first[1:]
        begin = np.empty_like(w.start)  # of the run before each word
        begin[1:] = w.end[:-1]
        some = np.flatnonzero(last > first)
        begin[first[some]] = at[:-1][some]
        # The white space after the last word of a text, or a text of white space alone, is a piece of its own.
        stop = at[:-1].copy()
        stop[some] = w.end[last[some] - 1]
        tail = np.flatnonzero(stop < at[1:])
        size = w.start - begin
        padded = np.concatenate((raw, np.zeros(8, np.uint8)))
        run = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))[begin] & MASKS[np.minimum(size, 8)]
        for k in np.flatnonzero(size > 8).tolist():
            run[k] = zlib.crc32(raw[begin[k] : w.start[k]].tobytes()) + (int(size[k]) << 32)
        key = w.hash ^ mix(run + np.minimum(size, 9).astype(np.uint64))
        tails = [raw[a:b].tobytes() for a, b in zip(stop[tail].tolist(), at[1:][tail].tolist())]
        key = np.concatenate((key, np.array([zlib.crc32(t) + (len(t) << 32) + (1 << 63) for t in tails], np.uint64)))
        doc = np.concatenate((w.row_of_word(), tail))
        begin, end = np.concatenate((begin, stop[tail])), np.concatenate((w.end, at[1:][tail]))
        keys, where, number = np.unique(key, return_index=True, return_inverse=True)
        fresh = np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)] != keys) if len(self.known) else np.arange(len(keys))
        if len(fresh):
            data = raw.tobytes()
            low, high = begin[where[fresh]], end[where[fresh]]
            slices = [data[a:b] for a, b in zip(low.tolist(), high.tolist())]
            parts = self._learn([x.decode() for x in slices])
            known = np.concatenate((self.known, keys[fresh]))
            order = np.argsort(known, kind="stable")
            stop = len(self.store) - 8 + np.cumsum(high - low)
            place = np.concatenate((self.place, np.stack((stop - (high - low), stop), axis=1)))
            self.store = np.concatenate((self.store[:-8], np.frombuffer(b"".join(slices), np.uint8), np.zeros(8, np.uint8)))
            self.known, self.parts_of, self.place = known[order], np.concatenate((self.parts_of, parts))[order], place[order]
        held = np.searchsorted(self.known, keys)
        other = doc[~same_bytes(padded, begin, end, self.store, *self.place[held[number]].T)]
        parts = self.parts_of[held][number]
        if len(tail):
            order = np.argsort(doc, kind="stable")  # a tail comes after its text's words
            parts, doc = parts[order], doc[order]
        cut = np.searchsorted(doc, np.arange(w.n + 1))
        own = parts.ravel()
        start, many = self.at[own], self.at[own + 1] - self.at[own]
        stops = np.concatenate(([0], np.cumsum(many)))
        where = np.repeat((start - stops[:-1]).astype(np.int32), many)  # both ends are far below 2**31: the cache and a wave are bounded
        where += np.arange(stops[-1], dtype=np.int32)
        ids = self.flat[where]
        out = [ids[stops[3 * a] : stops[3 * b]] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        for k in np.unique(other).tolist():  # a piece only hashes like a known one
            out[k] = np.array(self.tok.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        return out

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Encode the stems that these pieces bring; for each piece the numbers of its three parts: a line end, the stem, the marks."""
        stem, out = self.stem, []
        nothing, line = stem[FIRST], stem[FIRST + "\n"]
        parts, lines = self.parts, self.lines
        for p in pieces:
            before, c = nothing, p[0]
            if c == " ":
                p = p[1:]  # a stem is named without its space; one that has none is marked
            elif c == "\n" and lines and p[1:2].isalnum():
                before, p = line, FIRST + p[1:]
            else:
                p = FIRST + p
            if parts and not p[-1:].isalnum():
                cut = p.rstrip(MARKS)
                if len(cut) < len(p) and cut[-1:].isalnum():
                    out += before, stem[cut], stem[FIRST + p[len(cut) :]]
                    continue
            out += before, stem[p], nothing
        self._encode(list(islice(stem, self.coded, None)))
        self.coded = len(stem)
        return np.array(out, np.int32).reshape(-1, 3)

    def _alone(self, words: list[str]) -> list[list[int]]:
        """Ids of a space and a word of letters or of decimals: the pattern makes one token of each, the library's model does the rest."""
        model, symbol = self.tok.model.tokenize, self.symbol
        space = symbol[32]
        named = [(space, w) if w[0] != FIRST else ("", w[1:]) for w in words]
        return [[t.id for t in model(s + (w if w.isascii() else w.encode().decode("latin-1").translate(symbol)))] for s, w in named]

    def _encode(self, fresh: list[str]) -> None:
        alone = [k for k, p in enumerate(fresh) if self.alone and ((q := p[1:] if p[:1] == FIRST else p).isalpha() or q.isdecimal())]
        held = set(alone)
        plain = [k for k, p in enumerate(fresh) if k not in held and self.joins and _PLAIN.fullmatch(p)]
        held.update(plain)
        other = [k for k in range(len(fresh)) if k not in held]
        size = np.zeros(len(fresh), np.int64)
        words = self._alone([fresh[k] for k in alone])
        size[alone] = [len(w) for w in words]
        got, owners = [np.fromiter(chain.from_iterable(words), np.int64)], alone
        for n in range(0, len(plain), JOINED):
            own = plain[n : n + JOINED]
            ids = np.array(self.tok.encode_batch_fast([" " + "\n ".join([fresh[k] for k in own])], add_special_tokens=False)[0].ids)
            stop = ids == self.line[0]
            size[own] = np.bincount(np.cumsum(stop)[~stop], minlength=len(own))
            got.append(ids[~stop])
            owners += own
        for n in range(0, len(other), JOINED):
            own = other[n : n + JOINED]
            texts = [fresh[k][1:] if fresh[k][:1] == FIRST else " " + fresh[k] for k in own]
            for k, e in zip(own, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
                got.append(np.array(e.ids, np.int64))
                size[k] = len(got[-1])
            owners += own
        flat = np.concatenate([np.zeros(0, np.int64), *got])
        owners = np.array(owners, np.int64)
        start = np.zeros(len(fresh), np.int64)
        start[owners] = np.cumsum(size[owners]) - size[owners]
        shift = np.repeat(start - (np.cumsum(size) - size), size)
        self.flat = np.concatenate((self.flat, flat[shift + np.arange(len(shift))].astype(np.uint32)))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))


_kept: dict[int, LibraryEncoder] = {}


def _encoder(model: bytes) -> LibraryEncoder:
    key = hash(model)
    if key not in _kept:
        _kept.clear()
        _kept[key] = LibraryEncoder(model)
    return _kept[key]


def encode_segments(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments in file order: part, seq, docs, tokens, payload."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(read_model(path))

    def run(batches):
        coder, part = _encoder(model.value), TaskContext.get().partitionId()
        seq, ids, docs_, sizes, held = 0, [], [], [], 0

        def segment():
            payload = rans.encode(np.array(docs_, np.int64), np.array(sizes, np.int64), np.concatenate(ids).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs_)], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())], ["part", "seq", "docs", "tokens", "payload"])

        for wave in waves(batches, "text", WAVE_BYTES):
            if len(coder.stem) > CACHE_STEMS or len(coder.known) > 2 * CACHE_STEMS:
                coder.clear()
            texts = pa.concat_arrays([batch.column("text") for batch in wave])
            for doc, own in zip([d for batch in wave for d in batch.column("doc_id").fill_null(NULL_ID).to_pylist()], coder.encode(texts)):
                own = np.append(own, np.uint32(end_id))
                ids.append(own)
                docs_.append(doc)
                sizes.append(len(own))
                held += len(own)
                if held >= SEGMENT:
                    yield segment()
                    release()
                    seq, ids, docs_, sizes, held = seq + 1, [], [], [], 0
        if docs_:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Where ids repeat or lack, a hash of the text parts them; else it need not be read to find the ranges.
    many, different = rows.agg(F.count("*"), F.approx_count_distinct("doc_id", 0.02)).first()
    rows = rows.withColumn("tie", F.xxhash64("text") if many - different > 0.1 * many else F.lit(0).cast("long"))
    parts = max(12, input_bytes(docs) // 12_000_000)
    return rows.repartitionByRange(int(parts), "doc_id", "tie").sortWithinPartitions("doc_id", F.xxhash64("text"), "text").select("doc_id", "text").mapInArrow(run, CONTAINER)


def decode_segments(segments: DataFrame) -> DataFrame:
    """part, seq, doc_id, place (of its first id in the segment), ids: the documents of container rows."""
    ship(segments.sparkSession)

    def run(batches):
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "payload"))):
                docs, sizes, ids = rans.decode(payload)
                at = np.concatenate(([0], np.cumsum(sizes)))
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                ids_ = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer((at * 4).astype(np.int64).tobytes()), data]).cast(pa.binary())
                doc = pa.array(docs, pa.int64(), mask=docs == NULL_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), part), pa.int32()), pa.array(np.full(len(docs), seq), pa.int32()), doc, pa.array(at[:-1], pa.int64()), ids_], ["part", "seq", "doc_id", "place", "ids"])

    return segments.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, doc_id long, place long, ids binary")


def starts(segments: DataFrame) -> DataFrame:
    """part, seq, before: how many ids stand in earlier segments.  One row a segment; the widest step has one row a part."""
    part = segments.groupBy("part").agg(F.sum("tokens").alias("total"))
    earlier = part.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    own = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    return segments.select("part", "seq", "tokens").withColumn("own", own).join(earlier, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("before"))


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    encode_segments(docs, path, end_id, id_col, text_col).write.option("compression", "uncompressed").parquet(folder)


def read_token_files(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers)."""
    segments = spark.read.schema(CONTAINER).parquet(folder)
    before = starts(segments)
    if segments.select("part").count() <= MOST_BROADCAST:  # a row of three numbers a segment; else Spark joins by a shuffle
        before = F.broadcast(before)
    docs = decode_segments(segments).join(before, ["part", "seq"])
    return docs.select("doc_id", (F.col("before") + F.col("place")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
