"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (runs of letters and digits, ASCII lower-cased),
hashed to ``2**22`` places.  The score is

    sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>),

over the terms of the text that the model knows; the factors v carry pairs, such
as an insult with a mention of a group, that additive weights miss.  Training
runs in numpy on the driver, on a bounded sample (``SAMPLE`` documents of each
label, taken by a hash of their id, whole texts).  Which terms the documents hold is
counted on the executors, over whole texts however long; the ``FEATURES`` terms of
highest chi-square are learned, and only which of these each document holds comes to
the driver.  The intercept is corrected for the sampling of the labels, whose totals
are counted over all rows.  Scoring is one pass over whole texts without a shuffle;
the model is broadcast and has a fixed size.

Null and empty texts have no terms: their score is the intercept's.  Labels that
are null do not count; a document labelled more than once counts as toxic if any
label says so; rows that repeat an id each count and each get their score.  Without
labels of both kinds nothing can be learned, and the scores are the share of toxic
labels (0 where there is none).  Ties of chi-square go to the smaller hash.  Other
columns pass unchanged, but for ``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._env import lowest, removed, ship, written
from quernstone.llm._words import Words

PLACES, SAMPLE, FEATURES, FACTORS, STEPS = 1 << 22, 2000, 1024, 8, 150


@dataclass
class FactorizationMachine:
    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, rows: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """row, term: the distinct terms of each row."""
        at = np.minimum(np.searchsorted(self.terms, term), max(len(self.terms) - 1, 0))
        known = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        row, at = row[known], at[known]
        out = np.full(rows, self.bias) + np.bincount(row, weights=self.weight[at], minlength=rows)
        for v in self.factor.T:
            one = np.bincount(row, weights=v[at], minlength=rows)
            two = np.bincount(row, weights=v[at] ** 2, minlength=rows)
            out += 0.5 * (one * one - two)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * np.clip(x, -60, 60))


def term_sets(texts) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and the distinct hashed terms of each row."""
    w = Words(texts, lower=True, terms=True)
    key = np.unique(w.row_of_word() * PLACES + (w.hash % np.uint64(PLACES)).astype(np.int64))
    return w.n, key // PLACES, key % PLACES


def fit(texts: list[np.ndarray], label: np.ndarray, odds: float, seed: int = 7) -> FactorizationMachine:
    """texts: distinct terms of each document; odds: of toxic labels in all rows."""
    n, positive = len(texts), label.sum()
    term = np.concatenate(texts) if n else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), [len(t) for t in texts])
    names, number = np.unique(term, return_inverse=True)
    held = np.bincount(number, minlength=len(names))
    toxic = np.bincount(number, weights=label[row], minlength=len(names))
    expect = held * positive / max(n, 1)
    chi = (toxic - expect) ** 2 / np.maximum(expect * (1 - positive / n) * (1 - held / (n + 1)), 1e-9)
    chi[held < 3] = 0
    best = np.sort(np.lexsort((names, -chi))[:FEATURES])
    best = best[chi[best] > 0]
    place = np.full(len(names), -1)
    place[best] = np.arange(len(best))
    x = np.zeros((n, len(best)), np.float32)
    some = place[number] >= 0
    x[row[some], place[number][some]] = 1
    rng = np.random.default_rng(seed)
    k = len(best)
    w, v, b = np.zeros(k, np.float32), rng.normal(0, 0.02, (k, FACTORS)).astype(np.float32), np.float32(np.log(positive / (n - positive)))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v, np.zeros(1, np.float32))]
    for step in range(1, STEPS + 1):
        one = x @ v
        z = b + x @ w + 0.5 * (one**2 - x @ v**2).sum(axis=1)
        e = (sigmoid(z) - label).astype(np.float32) / n
        grads = [x.T @ e + 1e-5 * w, x.T @ (e[:, None] * one) - (x.T @ e)[:, None] * v + 1e-4 * v, np.array([e.sum()], np.float32)]
        moved = []
        for g, s in zip(grads, state):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            moved.append(0.05 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8))
        w, v, b = w - moved[0], v - moved[1], b - moved[2][0]
    bias = float(b) - float(np.log(positive / (n - positive))) + float(np.log(odds))
    return FactorizationMachine(names[best].astype(np.int64), bias, w.astype(float), v.astype(float))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> FactorizationMachine:
    """Learn from the labelled rows given; at most ``sample`` documents of each label."""
    spark = docs.sparkSession
    ship(spark)
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    total = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    positive, negative = total.get(1, 0), total.get(0, 0)
    if not positive or not negative:
        share = positive / max(positive + negative, 1)
        return FactorizationMachine(np.zeros(0, np.int64), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(0), np.zeros((0, FACTORS)))
    order = F.xxhash64("id", F.lit(11))
    some = lowest(marks.filter("label = 1"), order, sample, positive).unionAll(lowest(marks.filter("label = 0"), order, sample, negative))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(text.join(F.broadcast(some), "id").select("id", "label", "text"), "labelled")  # bounded: 2 * sample documents
    n, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    if not toxic or toxic == n:
        return FactorizationMachine(np.zeros(0, np.int64), float(np.log(positive / negative)), np.zeros(0), np.zeros((0, FACTORS)))

    def held(batches):
        for batch in batches:
            _, row, term = term_sets(batch.column("text"))
            own = batch.column("label").to_numpy()[row].astype(float)
            names, number = np.unique(term, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.bincount(number), pa.int64()), pa.array(np.bincount(number, weights=own).astype(np.int64))], ["term", "held", "toxic"])

    counts = rows.mapInArrow(held, "term long, held long, toxic long").groupBy("term").agg(F.sum("held").alias("held"), F.sum("toxic").alias("toxic")).filter("held >= 3")
    chi = F.pow(F.col("toxic") - F.col("held") * (toxic / n), 2) / F.greatest(F.col("held") * (1 - F.col("held") / (n + 1)), F.lit(1e-9))
    best = np.array(sorted(r.term for r in counts.orderBy(chi.desc(), "term").limit(FEATURES).select("term").collect()), np.int64)
    known = spark.sparkContext.broadcast(best)

    def terms(batches):
        for batch in batches:
            n, row, term = term_sets(batch.column("text"))
            some = np.isin(term, known.value)
            row, term = row[some], term[some]
            at = np.searchsorted(row, np.arange(n + 1))
            own = [term[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(own, pa.binary())], ["id", "label", "terms"])

    got = sorted(rows.mapInArrow(terms, "id long, label int, terms binary").collect())
    removed(spark, rows)
    return fit([np.frombuffer(r.terms, np.int32).astype(np.int64) for r in got], np.array([float(r.label) for r in got]), positive / negative)


def toxicity_scores(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold); columns of these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    base = docs.drop("score", "predicted")
    fields = [f.name for f in base.schema.fields]

    def run(batches):
        for batch in batches:
            n, row, term = term_sets(batch.column(fields.index(text_col)).cast(pa.string()))
            score = sigmoid(held.value.logits(n, row, term))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*fields, "score", "predicted"])

    return base.mapInArrow(run, base.select("*", F.lit(0.0).cast("double").alias("score"), F.lit(0).cast("int").alias("predicted")).schema)


def held_out(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))
