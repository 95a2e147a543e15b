"""A training-corpus pipeline: five stages, each one operator over all that the stage before it kept.

toxicity            documents that the factorization machine calls toxic go
near_duplicates     of each component of n-gram Jaccard links the document of smallest id stays
substring_dedup     words of passages that stand in documents of smaller id go; rows stay
decontaminate       documents that hold a benchmark item go
bpe                 every text is encoded and decoded

All but the last return the columns of documents, whatever the others are called.
Rows without an id are documents of their own, larger than all with one: they go
where their text is a near copy of another's.  Of rows that repeat an id and a text
one stays, unless it has no words; rows that share an id and differ in text stay or
go together in near_duplicates, each by its own text elsewhere.  Empty and null texts
pass every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm._env import removed, written
from quernstone.llm.bpe import bpe_decode, bpe_encode
from quernstone.llm.decontaminate import decontaminate
from quernstone.llm.ngram_join import jaccard_components
from quernstone.llm.substring_dedup import substring_dedup
from quernstone.llm.toxicity import held_out, toxicity_scores, train

#: No SQL says what the first stage has learned; tests hold the stages against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, _table(spark, sf_dir, "labels").filter(held_out("doc_id", 5) != 0))
    rows = docs.select(F.struct(*_all(docs)).alias("row"), "text")
    return toxicity_scores(rows, model).filter("predicted = 0").select("row.*")


def _all(docs: DataFrame, but: tuple[str, ...] = ()) -> list:
    return [F.col(f"`{c}`") for c in docs.columns if c not in but]


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs with ``key``: the id, or for rows without one a number that their text gives, above all ids; of rows that repeat id and text one."""
    held = docs.select(F.struct(*_all(docs)).alias("row"), F.col("doc_id").cast("long").alias("key"), F.col("text").alias("text"))
    again = held.filter("key IS NOT NULL").groupBy("key").count().filter("count > 1").select("key")
    lacks, repeats = not held.filter("key IS NULL").limit(1).isEmpty(), not again.limit(1).isEmpty()
    if not lacks and not repeats:
        return held
    number = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 3)
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")  # these are no copies of anything, and all stay
    parts = [held.filter(blank).withColumn("key", F.coalesce("key", number))]
    held = held.filter(~blank)
    sole = held.filter("key IS NOT NULL")
    if repeats:
        again = written(again, "repeated")
        parts.append(sole.join(again, "key", "left_semi").groupBy("key", F.xxhash64("text").alias("h"), "text").agg(F.first("row").alias("row")).select("row", "key", "text"))
        sole = sole.join(again, "key", "left_anti").select("row", "key", "text")
    if lacks:
        parts.append(held.filter("key IS NULL").groupBy("text").agg(F.first("row").alias("row")).select("row", number.alias("key"), "text"))
    for part in parts:
        sole = sole.unionByName(part)
    return written(sole, "told-apart")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _told_apart(docs)
    found = jaccard_components(own, id_col="key")
    later = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct()
    return own.join(later, "key", "left_anti").select("row.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = substring_dedup(docs, rest=rest)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = out.select("doc_id", text.alias("text"), *[F.col(f"rest.`{c}`").alias(c) for c in rest])
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*_all(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe_decode(bpe_encode(docs, path), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substring_dedup", substrings), ("decontaminate", benchmark), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written as Parquet and read again."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            removed(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
