"""Byte-pair encoding and decoding with a given vocabulary, by an index of pair occurrences.

The distinct words of a wave of texts (a bounded part of a partition) lie in one
array of symbols, linked to their neighbours.  The index maps every mergeable
pair to all its places in that array.  Active ranks are applied in ascending
order: all places of the pair of lowest rank merge at once, and only the lists
of the pairs to their left and right change.  A merge list in which a pair could
rank below the merge that makes one of its halves is rejected, so a rank, once
applied, never comes back.

Words repeat, so each wave encodes distinct words only; a task keeps the words
of its last waves in a cache of bounded size.  There is no shuffle and no state
beyond the cache: a lost task is simply run again.

Memory: a wave ends within a batch where that holds many bytes, only a single text
is never cut; places and symbols are 32-bit numbers; a task that ends leaves its worker
nothing but the model, and decoding needs no more than the tokens' texts.

The vocabulary is a tokenizers JSON file with BPE, an NFC / white space /
lower-case normaliser, a Split pattern and byte-level symbols; its path is a
parameter, and its content (under 2 MB) is broadcast.

Null texts encode as empty: no ids, and the decoded text is "".  Very long texts are
encoded whole; repeated rows and rows without an id each get their ids.  Columns other
than id and text are not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._env import release, ship

WAVE_BYTES = 2_500_000
DECODED_BYTES = 4_000_000
RANKED = 1 << 17
CACHE_WORDS = 100_000
MOST_MODEL_BYTES = 64_000_000
_WHITE = "\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def token_texts(spec: dict) -> list[str]:
    """The text of each id of a tokenizers file."""
    vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [""] * (max([*vocab.values(), *added.values()]) + 1)
    for text, i in [*vocab.items(), *added.items()]:
        out[i] = text
    return out


class PairIndex:
    """The merges of a vocabulary, applied to many words at once."""

    def __init__(self, model: bytes):
        spec = json.loads(model)
        bpe = spec["model"]
        self.suffix = bpe.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = bpe["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = token_texts(spec)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in bpe["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.left, self.right, self.size = left, right, len(self.tokens)
        born = np.full(self.size, -1)
        born[self.made[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a pair ranks below the merge that makes one of its symbols")
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.rank_of, self.keys = order.astype(np.int32), key[order]
        names = byte_symbols()
        self.inner = np.array([vocab.get(c, -1) for c in names], np.int32)
        self.last = np.array([vocab.get(c + self.suffix, -1) for c in names], np.int32)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace("\\s", _WHITE))
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def words(self, piece: str) -> list[str | int]:
        """The words of a piece of text, and the ids of added tokens that stand in it."""
        out: list[str | int] = []
        for part in self.special.split(piece) if self.special and "<" in piece else [piece]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                text = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out += self.pattern.findall(text.lower())
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(a) > RANKED:
            return np.concatenate([self._ranks(a[k : k + RANKED], b[k : k + RANKED]) for k in range(0, len(a), RANKED)])
        key = np.multiply(a, self.size, dtype=np.int64)
        key += b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], np.int32(-1))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's start and end."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        del raw
        kind = np.int32 if len(data) < (1 << 31) - 2 else np.int64
        stop = np.cumsum(size)
        sym = self.inner[data]
        sym[stop - 1] = self.last[data[stop - 1]]
        word = np.repeat(np.arange(len(words), dtype=kind), size)
        del data, stop
        known = sym >= 0
        if not known.all():
            sym, word = sym[known], word[known]
        n = len(sym)
        sym = np.append(sym, np.int32(-1))  # place n: no neighbour
        nxt, prv = np.arange(1, n + 2, dtype=kind), np.arange(-1, n, dtype=kind)
        cut = np.flatnonzero(word[1:] != word[:-1])
        nxt[cut], prv[cut + 1] = n, n
        nxt[n - 1 :], prv[0], prv[n] = n, n, n
        live = np.ones(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(place: np.ndarray) -> None:
            """Put the pairs that start at these places in the index."""
            rank = self._ranks(sym[place], sym[nxt[place]])
            some = rank >= 0
            place, rank = place[some], rank[some]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            place, rank = place[order], rank[order]
            del order
            at = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
            for r, p in zip(rank[at].tolist(), np.split(place, at[1:]) if len(at) > 1 else [place]):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        note(np.flatnonzero(nxt[:n] < n).astype(kind))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            i = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            j = nxt[i]
            i = i[live[i] & (sym[i] == a) & (sym[j] == b)]
            if a == b and len(i) > 1:
                i = np.sort(i)
                j = nxt[i]
                taken, last = [], -1
                for x, y in zip(i.tolist(), j.tolist()):
                    if x != last:
                        taken.append(x)
                        last = y
                i = np.array(taken, kind)
            if not len(i):
                continue
            j = nxt[i]
            k = nxt[j]
            sym[i] = self.made[r]
            live[j] = False
            nxt[i] = k
            prv[k] = i
            prv[n] = n
            before = prv[i]
            note(np.concatenate((before[before < n], i[k < n])))
        stay = np.flatnonzero(live[:n])
        return sym[stay], np.searchsorted(word[stay], np.arange(len(words) + 1))


class Encoder:
    """Encodes texts by way of distinct pieces (text between spaces) and distinct words."""

    def __init__(self, model: bytes):
        self.index = PairIndex(model)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        number = self.number
        return np.array([number.setdefault(p, len(number)) for p in text.split(" ")], np.int32)

    def learn(self) -> None:
        """Encode the pieces that came since the last time."""
        have = len(self.at) - 1
        seen: dict[str, int] = {}
        added: list[int] = []
        names, many = array("q"), array("q")  # the words of all fresh pieces: numbers in seen, or -1 - a place in added
        for p, _ in self._tail(have):
            words = self.index.words(p)
            many.append(len(words))
            for w in words:
                if isinstance(w, str):
                    names.append(seen.setdefault(w, len(seen)))
                else:
                    added.append(w)
                    names.append(-len(added))
        ids, at = self.index.encode(list(seen))
        ids, at = np.concatenate((ids, np.array(added, np.int64))), np.concatenate((at, at[-1] + np.arange(1, len(added) + 1)))
        name = np.frombuffer(names, np.int64) if len(names) else np.zeros(0, np.int64)
        name = np.where(name < 0, len(seen) - 1 - name, name)
        size = at[name + 1] - at[name]
        stop = np.cumsum(size)
        ids = ids[np.repeat(at[name] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        stop = np.concatenate(([0], stop))[np.cumsum(np.frombuffer(many, np.int64))] if len(many) else np.zeros(0, np.int64)
        self.flat = np.concatenate((self.flat, ids.astype(np.uint32)))
        self.at = np.concatenate((self.at, self.at[-1] + stop))

    def _tail(self, have: int) -> Iterator[tuple[str, int]]:
        from itertools import islice

        return islice(self.number.items(), have, None)

    def ids(self, number: np.ndarray) -> np.ndarray:
        start, size = self.at[number], self.at[number + 1] - self.at[number]
        total = int(size.sum())
        shift = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return self.flat[shift + np.arange(total)]


_kept: dict[int, Encoder] = {}
_texts: dict[int, pa.Array] = {}


def _tokens(model: bytes) -> pa.Array:
    key = hash(model)
    if key not in _texts:
        _texts.clear()
        _texts[key] = pa.array(token_texts(json.loads(model)), pa.string())
    return _texts[key]


def _encoder(model: bytes) -> Encoder:
    key = hash(model)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(model)
    return _kept[key]


def waves(batches, column: str, most: int):
    """Runs of batches of about so many bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def bounded(batches, column: str, most: int):
    """The batches, in slices of at most so many bytes of a column, or of one row."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).tolist()
        first, held = 0, 0
        for k, s in enumerate(size):
            if held + s > most and k > first:
                yield batch.slice(first, k - first)
                first, held = k, 0
            held += s
        if first < len(size):
            yield batch.slice(first)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MOST_MODEL_BYTES + 1)
    if len(model) > MOST_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MOST_MODEL_BYTES} bytes")
    return model


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, the token ids of each text as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(read_model(path))

    def run(batches):
        release()  # what this worker still holds of other work
        coder = _encoder(model.value)
        for wave in waves(bounded(batches, "text", WAVE_BYTES), "text", WAVE_BYTES):
            if len(coder.number) > CACHE_WORDS:
                coder.clear()
            numbers = [[coder.numbers(t or "") for t in batch.column("text").to_pylist()] for batch in wave]
            coder.learn()
            for batch, own in zip(wave, numbers):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([coder.ids(x).tobytes() for x in own], pa.binary())], ["doc_id", "ids"])
            del batch, wave, numbers
            release()
        coder.clear()
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded: the tokens' texts joined by a space, as a vocabulary without a decoder decodes."""
    spark = encoded.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(read_model(path))

    def run(batches):
        release()
        tokens = _tokens(model.value)
        for batch in bounded(batches, "ids", DECODED_BYTES):
            ids = batch.column("ids").fill_null(b"")
            raw = ids.to_pylist()
            at = np.cumsum([0, *(len(x) // 4 for x in raw)])
            names = tokens.take(pa.array(np.frombuffer(b"".join(raw), np.uint32)))
            decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), names), " ")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoded], ["doc_id", "ids", "decoded"])
            del batch, ids, raw, names, decoded
            release()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")
