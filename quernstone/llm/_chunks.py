"""A distributed index of hashes over chunks of documents.

Documents are dealt to chunks by a hash of their id and text, so rows without an id
or with one id are dealt, too.  Each chunk states every
*distinct* key once, with one value (pre-aggregation: a key that a third of all
documents hold makes one entry a chunk, not one a document), sorted, as byte
planes of differences, cut by key range into buckets.  A bucket combines the
values of equal keys over all chunks and answers every entry in the order in
which it came, so the answer needs no keys.  Chunks and buckets are as many as
the input asks for, so both stay bounded in memory at any size of input.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._env import input_bytes

U = np.uint64
NO_ID = np.iinfo(np.int64).max
ENTRIES = "bucket int, chunk long, n int, keys binary, vals binary"
ANSWERS = "chunk long, bucket int, vals binary"


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, as many as the largest needs; the first byte says how many."""
    x = np.ascontiguousarray(x, dtype=np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, width * n, 1).reshape(width, n).T
    return out.view(np.uint64).reshape(-1)


def layout(docs: DataFrame) -> tuple[int, int]:
    """Numbers of chunks and of buckets for this input: chunks of 1 to 64 MB of input, growing with its root."""
    size = input_bytes(docs)
    chunk = min(64e6, max(1e6, 46 * size**0.5))
    return max(768, int(size / chunk)), max(128, int(size / (2 * chunk)))


def in_chunks(docs: DataFrame, id_col: str, text_col: str, chunks: int, rest: list[str] | None = None) -> DataFrame:
    """chunk, doc_id, text and, if named, the other columns as one; the same plan each time, so that Spark reuses one exchange for all uses within a query."""
    more = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return row.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "*").repartition("chunk")


def ids_of(table: pa.Table) -> np.ndarray:
    """doc_id as numpy; null counts as larger than any other."""
    return table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64) if table.num_rows else np.zeros(0, np.int64)


def cuts(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where the sorted keys of ``bits`` bits pass from bucket to bucket."""
    edge = [-(-(i << bits) // buckets) for i in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edge, np.uint64)), [len(keys)]))


def entries(chunk: int, keys: np.ndarray, vals: np.ndarray, bits: int, buckets: int) -> pa.Table:
    """The rows that a chunk sends: keys are sorted and distinct, vals unsigned."""
    at = cuts(keys, bits, buckets)
    full = np.flatnonzero(np.diff(at))
    step = np.diff(keys, prepend=U(0))
    k, v = [], []
    for b in full:
        s = step[at[b] : at[b + 1]].copy()
        s[0] = keys[at[b]]
        k.append(pack(s))
        v.append(pack(vals[at[b] : at[b + 1]]))
    return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array(np.full(len(full), chunk), pa.int64()), "n": pa.array(np.diff(at)[full], pa.int32()), "keys": pa.array(k, pa.binary()), "vals": pa.array(v, pa.binary())})


def answered(sent: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """combine(vals, starts): values sorted by key and where each key starts, to one value a key; each entry gets its key's."""

    def bucket(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        keys = np.concatenate([np.cumsum(unpack(k, m), dtype=np.uint64) for k, m in zip(table["keys"].to_pylist(), n)])
        vals = np.concatenate([unpack(v, m) for v, m in zip(table["vals"].to_pylist(), n)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        one = combine(vals[order], np.flatnonzero(new))
        out = np.empty(len(keys), np.uint64)
        out[order] = one[np.cumsum(new) - 1]
        at = np.concatenate(([0], np.cumsum(n)))
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "vals": pa.array([pack(out[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())}).cast(pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("vals", pa.binary())]))

    return sent.groupBy("bucket").applyInArrow(bucket, ANSWERS)


def read_answers(table: pa.Table, keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The answers to a chunk's keys, in the order of the keys."""
    at, out = cuts(keys, bits, buckets), np.zeros(len(keys), np.uint64)
    for b, v in zip(table["bucket"].to_pylist(), table["vals"].to_pylist()):
        out[at[b] : at[b + 1]] = unpack(v, at[b + 1] - at[b])
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the order that sorts, and for each sorted place the number of its key."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return s[new], order, np.cumsum(new) - 1
