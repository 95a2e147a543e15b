"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of a text is a position.  A forward and a backward GRU read stretches
of ``STRETCH`` bytes (each byte of the text is in exactly one), their states
label every position with a distribution over the languages, and a document's
probabilities are the mean over all its positions.  The network is trained in
numpy by backpropagation through time, on the driver, on a bounded sample of
labelled documents (``SAMPLE`` of each language, by a hash of their id; their whole
texts, in stretches): steps draw a document, then one of its stretches.  One scan
finds the sample, from the rows below a bound of the hash, one fetches its texts.
Prediction is one pass over whole texts without a shuffle, however long they are; the
model is broadcast and has a fixed size.

A text that is null or has no letter is ``und`` with score 0.  Languages are the
labels seen in training, at most ``LANGUAGES`` of them (more is an error); a null
label or id is not learned from.  Rows that repeat an id each count and each get
their prediction; ties of probability go to the first language by name.  Other
columns pass unchanged, but for ``lang_pred`` and ``score``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm._env import hash_bound, ship

HIDDEN, STRETCH, SIDE = 8, 96, 4096
SAMPLE, STEPS, BATCH, LANGUAGES = 400, 260, 192, 64
f4 = np.float32


@dataclass
class Gru:
    """One direction.  table: 3 * HIDDEN x 256 inputs of each byte (update, reset, candidate); state: 3 * HIDDEN x HIDDEN."""

    table: np.ndarray
    state: np.ndarray

    def run(self, data: np.ndarray, keep: bool = False):
        """data: time x batch bytes.  States after each byte: time x HIDDEN x batch; with keep also the gates."""
        steps, batch = data.shape
        out = np.empty((steps, HIDDEN, batch), f4)
        gates = np.empty((steps, 4, HIDDEN, batch), f4) if keep else None
        h = np.zeros((HIDDEN, batch), f4)
        for t in range(steps):
            x = self.table[:, data[t]]
            u = self.state @ h
            g = np.tanh(0.5 * (x[: 2 * HIDDEN] + u[: 2 * HIDDEN]))
            g += 1
            g *= 0.5
            z, r = g[:HIDDEN], g[HIDDEN:]
            n = np.tanh(x[2 * HIDDEN :] + r * u[2 * HIDDEN :])
            if keep:
                gates[t] = z, r, n, u[2 * HIDDEN :]
            h = n + z * (h - n)
            out[t] = h
        return (out, gates) if keep else out

    def back(self, data, out, gates, d_out):
        """Gradients of table and state from those of the states."""
        d_table, d_state = np.zeros((256, 3 * HIDDEN), f4), np.zeros_like(self.state)
        d = np.zeros(out.shape[1:], f4)
        for t in range(len(data) - 1, -1, -1):
            d = d + d_out[t]
            z, r, n, u = gates[t]
            before = out[t - 1] if t else np.zeros_like(d)
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            inner = np.concatenate((dz, dr, dn * r))
            np.add.at(d_table, data[t], np.concatenate((dz, dr, dn)).T)
            d_state += inner @ before.T
            d = d * z + self.state.T @ inner
        return d_table.T, d_state


@dataclass
class ByteGru:
    languages: list[str]
    ahead: Gru
    behind: Gru
    weight: np.ndarray
    bias: np.ndarray

    def positions(self, data: np.ndarray) -> np.ndarray:
        """languages x time x batch: the distribution at each position of the columns of bytes."""
        a, b = self.ahead.run(data), self.behind.run(data[::-1])[::-1]
        z = np.tensordot(self.weight[:, :HIDDEN], a, (1, 1)) + np.tensordot(self.weight[:, HIDDEN:], b, (1, 1)) + self.bias[:, None, None]
        z -= z.max(axis=0)
        np.exp(z, out=z)
        z /= z.sum(axis=0)
        return z

    def documents(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean over the positions of each text; raw: bytes of all texts, at: where each starts and ends."""
        size = np.diff(at)
        pieces = -(-size // STRETCH)
        doc = np.repeat(np.arange(len(size)), pieces)
        start = at[doc] + STRETCH * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(STRETCH, at[doc + 1] - start)
        total = np.zeros((len(self.languages), len(size)))
        padded = np.append(raw, np.zeros(STRETCH, np.uint8))
        steps = np.arange(STRETCH)[:, None]
        for n in range(0, len(doc), SIDE):
            s, m = start[n : n + SIDE], length[n : n + SIDE]
            data = padded[s + steps]
            inside = steps < m
            data[~inside] = 0
            p = self.positions(data) * inside
            for k, sums in enumerate(p.sum(axis=1)):
                total[k] += np.bincount(doc[n : n + SIDE], weights=sums, minlength=len(size))
        return total / np.maximum(size, 1)


def fit(data: np.ndarray, label: np.ndarray, languages: list[str], seed: int = 5, steps: int = STEPS, many: np.ndarray | None = None) -> ByteGru:
    """data: stretches x STRETCH bytes; label: number of the language of each document; many: of its stretches, which stand together (one each if not given)."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    init = lambda *shape: rng.normal(0, 0.3, shape).astype(f4)
    model = ByteGru(languages, Gru(init(3 * HIDDEN, 256), init(3 * HIDDEN, HIDDEN)), Gru(init(3 * HIDDEN, 256), init(3 * HIDDEN, HIDDEN)), init(k, 2 * HIDDEN), np.zeros(k, f4))
    params = [model.ahead.table, model.ahead.state, model.behind.table, model.behind.state, model.weight, model.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    many = np.ones(len(label), np.int64) if many is None else many
    start = np.cumsum(many) - many
    groups = [np.flatnonzero(label == c) for c in range(k)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, max(1, BATCH // k)) for g in groups])
        y, pick = label[pick], start[pick] + rng.integers(0, many[pick])
        x = data[pick].T
        a, ga = model.ahead.run(x, True)
        b, gb = model.behind.run(x[::-1], True)
        both = np.concatenate((a, b[::-1]), axis=1)
        z = np.matmul(model.weight, both) + model.bias[:, None]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(len(y))] -= 1
        d = p.astype(f4) / f4(x.size)
        d_weight = np.matmul(d, both.transpose(0, 2, 1)).sum(axis=0)
        d_both = np.matmul(model.weight.T, d)
        grads = [*model.ahead.back(x, a, ga, d_both[:, :HIDDEN]), *model.behind.back(x[::-1], b, gb, d_both[::-1, HIDDEN:]), d_weight, d.sum(axis=(0, 2))]
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        rate = 0.02 * (1 - step / (steps + 1)) + 0.001
        for q, g, m, v in zip(params, grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(f4)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> ByteGru | None:
    """Learn from the rows given whose language is not null; None if there are none."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL AND id IS NOT NULL")
    total = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if not total:
        return None
    if len(total) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    rows = rows.filter("text RLIKE '[^\\\\s]'")
    # Of each language the rows of lowest hash; tasks pass on only those below a bound, which widens should texts without letters leave too few.
    number, share = F.xxhash64("id", F.lit(3)), {name: 4 * sample / n for name, n in total.items()}
    while True:
        bound = F.create_map(*[F.lit(x) for name, part in share.items() for x in (name, hash_bound(part))])
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("number", "id"))
        some = rows.select("id", "lang", number.alias("number")).filter(F.col("number") <= bound[F.col("lang")]).withColumn("rank", rank).filter(F.col("rank") <= sample)
        got = some.select("id", "lang").collect()  # bounded: languages * sample rows
        few = [name for name, part in share.items() if part < 1 and sum(r.lang == name for r in got) < sample]
        if not few:
            break
        share.update({name: 16 * share[name] for name in few})
    spark = docs.sparkSession
    picked = rows.join(F.broadcast(spark.createDataFrame(got, "id long, lang string").distinct()), ["id", "lang"])

    def cut(batches):
        for batch in batches:
            data = []
            for t in batch.column("text").to_pylist():
                raw = t.encode()
                data.append(raw + b" " * (-len(raw) % STRETCH))
            yield pa.RecordBatch.from_arrays([batch.column("lang").cast(pa.string()), pa.array(data, pa.binary())], ["lang", "data"])

    got = sorted(picked.mapInArrow(cut, "lang string, data binary").collect())
    if not got:
        return None
    names = sorted({r.lang for r in got})
    number = {n: k for k, n in enumerate(names)}
    data = np.frombuffer(b"".join(r.data for r in got), np.uint8).reshape(-1, STRETCH)
    return fit(data, np.array([number[r.lang] for r in got]), names, many=np.array([len(r.data) // STRETCH for r in got]))


def language_id(docs: DataFrame, model: ByteGru | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the mean probability of that language); columns of these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    base = docs.drop("lang_pred", "score")
    fields = [f.name for f in base.schema.fields]

    def run(batches):
        net = held.value
        for batch in batches:
            texts = batch.column(fields.index(text_col)).cast(pa.large_string())
            some = np.array([net is not None and t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            own = texts.filter(pa.array(some))
            if len(own):
                at = np.concatenate(([0], np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False)))).astype(np.int64)
                raw = np.frombuffer(own.buffers()[2], np.uint8)
                first = np.frombuffer(own.buffers()[1], np.int64)[own.offset]
                p = net.documents(raw[first : first + at[-1]], at)
                lang[some] = np.array(net.languages, object)[p.argmax(axis=0)]
                score[some] = np.clip(p.max(axis=0), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*fields, "lang_pred", "score"])

    return base.mapInArrow(run, base.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).cast("double").alias("score")).schema)
