"""N-gram Jaccard self-join of documents by T-occurrence search with DivideSkip.

A document is its set of distinct word n-grams.  Two documents link when
100 * |x and y| >= 100 * threshold * |x or y|; then y holds at least
T = ceil(threshold * |x|) grams of x.

1. Documents are dealt to chunks by a hash of their id.  Every chunk sends its
   distinct grams to buckets and learns, for each, how many documents hold it.
   A gram of one document only cannot link; a document with fewer than T shared
   grams links with nothing and takes no further part.
2. Documents with equal sets form a class, which its smallest id represents.
3. The rarest |x| - T + 1 grams of a representative are its short inverted
   lists: any link of x shares one of them.  Buckets of lists turn each list to
   a star (a tree of its documents, never their pairs); the connected components
   of these stars, the clusters, hold every possible link.
4. A cluster of more than ``BLOCK`` documents is parted into size bands, each as
   wide as the threshold, so links lie within a band or between neighbours only;
   bands are cut into blocks, and each pair of blocks of one band or of two
   neighbours is a bounded task in which every document of one is a T-occurrence
   query against the inverted lists of the other: the short lists are merged (by a
   sort that merges runs, the vector form of the heap), documents that reach T - L
   in them are probed by binary search in the L long lists, and the sizes decide.
   A task returns a spanning tree of its links.
5. Components of the links, joined back over classes to all documents.

Nothing that grows with the input is collected or broadcast.  The rows of a
gram, set or cluster that a third of all documents hold are pre-aggregated or
dealt over blocks.  Grams are compared by 64-bit hashes.

A cluster that passages shared by unrelated documents hold together is thus searched
by size, but still in a number of blocks that grows with the square of a band's.

Empty and null texts have no grams and link with nothing; very long ones are read
whole.  Columns other than id and text are not read.  A null id counts as
larger than all others and stays null.  Rows with equal ids count as one
document in links and keep their own n_shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm import _chunks as C
from quernstone.llm._components import components, forest
from quernstone.llm._env import input_bytes, removed, ship, written
from quernstone.llm._words import U, Words, mix

BITS = 48
EDGES = "a long, b long"
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SETS = "doc_id long, n long, f1 long, f2 long, shared binary, rare binary"
BLOCK, BLOCKS, BLOCK_MOST = 128, 12, 4096


def gram_sets(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of the distinct grams, by row and hash; a shorter text is one gram of all its words."""
    w = Words(table["text"], lower=True)
    place, h = w.grams(n)
    row = np.searchsorted(w.first, place, side="right") - 1
    count, rows, hashes = w.counts(), [row], [h]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            place, h = w.grams(k)
            rows.append(short)
            hashes.append(h[np.searchsorted(place, w.first[short])])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _sums(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set and two fingerprints of it."""
    n = np.bincount(row, minlength=rows)
    at = np.concatenate(([0], np.cumsum(n)))
    total = [np.concatenate(([U(0)], np.cumsum(mix(h * U(k)), dtype=np.uint64))) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    f1, f2 = (t[at[1:]] - t[at[:-1]] for t in total)
    return n, f1.view(np.int64), f2.view(np.int64)


def _carriers(ids: np.ndarray, n: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    """Of the rows with equal sets the one of smallest id; rows without grams are none."""
    order = np.lexsort((ids, f2, f1, n))
    first = np.ones(len(order), bool)
    o, p = order[1:], order[:-1]
    first[1:] = (n[o] != n[p]) | (f1[o] != f1[p]) | (f2[o] != f2[p])
    out = np.zeros(len(ids), bool)
    out[order[first]] = True
    return out & (n > 0)


def _chunk_sets(table: pa.Table, grams: int):
    ids = C.ids_of(table)
    row, h = gram_sets(table, grams)
    n, f1, f2 = _sums(row, h, table.num_rows)
    carrier = _carriers(ids, n, f1, f2)
    mine = carrier[row]
    return ids, row[mine], h[mine], n, f1, f2, carrier


def _sent(chunk: int, table: pa.Table, grams: int, buckets: int) -> pa.Table:
    _, _, h, *_ = _chunk_sets(table, grams)
    keys, _, number = C.distinct(h >> U(64 - BITS))
    return C.entries(chunk, keys, np.bincount(number, minlength=len(keys)).astype(np.uint64), BITS, buckets)


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _documents(table: pa.Table, answers: pa.Table, grams: int, buckets: int, percent: int) -> pa.Table:
    ids, row, h, n, f1, f2, carrier = _chunk_sets(table, grams)
    keys, order, number = C.distinct(h >> U(64 - BITS))
    held = np.empty(len(h), np.uint64)
    held[order] = C.read_answers(answers, keys, BITS, buckets)[number]
    some = held >= 2
    shared = np.bincount(row[some], minlength=len(ids))
    take = carrier & (shared >= _least(n, percent))
    use = some & take[row]
    row, h, held = row[use], h[use], held[use]
    at = np.searchsorted(row, np.arange(len(ids) + 1))
    sets: list[bytes | None] = [None] * len(ids)
    rare: list[bytes | None] = [None] * len(ids)
    for i in np.flatnonzero(take).tolist():
        own, freq = h[at[i] : at[i + 1]], held[at[i] : at[i + 1]]
        few = len(own) - int(_least(n[i], percent)) + 1
        sets[i] = own.tobytes()
        rare[i] = own[np.lexsort((own, freq))[:few]].tobytes()
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()), "shared": pa.array(sets, pa.binary()), "rare": pa.array(rare, pa.binary())})


def _split_lists(buckets: int):
    """Of each batch the smallest document of every rare gram, dealt by gram; the batch's other holders as edges to it."""

    def lists(batches):
        for batch in batches:
            rare = [np.frombuffer(x, np.uint64) for x in batch["rare"].to_pylist()]
            if not rare:
                continue
            doc = np.repeat(batch["doc_id"].to_numpy(zero_copy_only=False), [len(x) for x in rare])
            h = np.concatenate(rare)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            lead = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            a, b = forest(doc[~new], lead[~new])
            h, doc = h[new], doc[new]
            at = C.cuts(h >> U(16), 48, buckets)
            full = np.flatnonzero(np.diff(at))
            k = [h[at[i] : at[i + 1]].tobytes() for i in full] + [b""]
            d = [doc[at[i] : at[i + 1]].tobytes() for i in full] + [np.stack((a, b)).tobytes()]
            spread = int(doc[0] % buckets) if len(doc) else 0
            yield pa.RecordBatch.from_arrays([pa.array([*full.tolist(), spread], pa.int32()), pa.array(k, pa.binary()), pa.array(d, pa.binary())], ["bucket", "h", "d"])

    return lists


def _stars(table: pa.Table) -> pa.Table:
    a, b, hs, ds = [], [], [], []
    for h, d in zip(table["h"].to_pylist(), table["d"].to_pylist()):
        if h:
            hs.append(np.frombuffer(h, np.uint64))
            ds.append(np.frombuffer(d, np.int64))
        elif d:
            x = np.frombuffer(d, np.int64).reshape(2, -1)
            a.append(x[0])
            b.append(x[1])
    if hs:
        h, d = np.concatenate(hs), np.concatenate(ds)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        lead = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        a.append(d[~new])
        b.append(lead[~new])
    none = np.zeros(0, np.int64)
    u, v = forest(np.concatenate([*a, none]), np.concatenate([*b, none]))
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_EDGES)


def t_occurrence(query: np.ndarray, need: int, lists: list[np.ndarray], members: int) -> tuple[np.ndarray, np.ndarray]:
    """DivideSkip: members of at least ``need`` of the sorted inverted lists that ``query`` names, and of how many.

    The L longest lists, L = need / (0.01 * log2(longest) + 1), are set aside; the
    others are merged; who is in need - L of these is looked up in the long ones
    by binary search.
    """
    size = np.array([len(lists[t]) for t in query])
    order = np.argsort(size, kind="stable")
    longest = int(size.max()) if len(size) else 0
    aside = min(need - 1, int(need / (0.01 * np.log2(max(longest, 2)) + 1)), len(query))
    short, long_ = order[: len(order) - aside], order[len(order) - aside :]
    if not len(short):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    merged = np.sort(np.concatenate([lists[t] for t in query[short]]), kind="stable")
    new = np.ones(len(merged), bool)
    new[1:] = merged[1:] != merged[:-1]
    at = np.flatnonzero(new)
    found, count = merged[at].astype(np.int64), np.diff(np.append(at, len(merged)))
    keep = count >= max(1, need - aside)
    found, count = found[keep], count[keep]
    left = aside
    for t in query[long_]:
        if not len(found):
            break
        own = lists[t]
        i = np.searchsorted(own, found)
        count = count + (own[np.minimum(i, len(own) - 1)] == found)
        left -= 1
        keep = count + left >= need
        found, count = found[keep], count[keep]
    return found, count


def _links(table: pa.Table, percent: int) -> pa.Table:
    """Links between the documents of side 0 and side 1 (side 2: with each other) as a spanning tree."""
    ids, n, side = table["doc_id"].to_numpy(), table["n"].to_numpy(), table["side"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table["shared"].to_pylist()]
    size = np.array([len(x) for x in sets])
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), size)
    terms, order, number = C.distinct(h)
    term = np.empty(len(h), np.int64)
    term[order] = number
    target = side[doc] != 0
    by = order[target[order]]
    cut = np.searchsorted(term[by], np.arange(len(terms) + 1))
    held = doc[by]
    lists = [held[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
    alone = np.diff(cut)
    at = np.concatenate(([0], np.cumsum(size)))
    a, b = [], []
    for x in np.flatnonzero(side != 1).tolist():
        need = int(_least(n[x], percent))
        own = term[at[x] : at[x + 1]]
        own = own[alone[own] > (1 if side[x] == 2 else 0)]
        if len(own) < need:
            continue
        y, both = t_occurrence(own, need, lists, len(ids))
        ok = (y != x) & (100 * both >= percent * (n[x] + n[y] - both))
        y = y[ok]
        if len(y):
            a.append(np.full(len(y), x))
            b.append(y)
    none = np.zeros(0, np.int64)
    u, v = forest(ids[np.concatenate([*a, none])], ids[np.concatenate([*b, none])])
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_EDGES)


def _bands(members: DataFrame, percent: int) -> DataFrame:
    """members (component, n, ...) with their band's blocks: base, blocks (its own), low and high (those to be paired with), total (of the cluster).

    Bands of a cluster number their blocks one after the other: of 128 documents each,
    but at most 12 of up to 4096, and more only beyond.  A cluster of at most BLOCK
    documents is one block.
    """
    band = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9) if percent < 100 else F.col("n")
    members = members.withColumn("band", band.cast("long"))
    count = members.groupBy("component", "band").agg(F.count("*").alias("many"))
    own = F.greatest(F.least(F.ceil(F.col("many") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("many") / BLOCK_MOST)).cast("long")
    by = Window.partitionBy("component")
    count = count.withColumn("every", F.sum("many").over(by)).withColumn("blocks", own).withColumn("base", F.sum("blocks").over(by.orderBy("band")) - F.col("blocks"))
    near = by.orderBy("band").rangeBetween(-1, 1)
    count = count.withColumns({"low": F.min("base").over(near), "high": F.max(F.col("base") + F.col("blocks")).over(near)})
    return members.join(count.hint("merge"), ["component", "band"]).drop("band", "many")  # not to be broadcast: it grows with the clusters


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links of at least ``percent`` % Jaccard similarity reach, the document's own included."""
    spark = docs.sparkSession
    ship(spark)
    chunks, buckets = C.layout(docs)
    rows = lambda: C.in_chunks(docs, id_col, text_col, chunks)

    def sent(key, table):
        return _sent(key[0].as_py(), table, words, buckets)

    def documents(key, table, answers):
        return _documents(table, answers, words, buckets, percent)

    held = C.answered(rows().groupBy("chunk").applyInArrow(sent, C.ENTRIES), np.add.reduceat)
    sets = written(rows().groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(documents, SETS), "sets")

    some = sets.filter("shared IS NOT NULL")
    lead = some.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc_id"))
    reps = some.join(lead.select("doc_id"), "doc_id", "left_semi")
    lists = reps.select("doc_id", "rare").mapInArrow(_split_lists(buckets), "bucket int, h binary, d binary")
    stars = lists.groupBy("bucket").applyInArrow(_stars, EDGES)
    clusters = written(components(stars, "stars"), "clusters")

    size = input_bytes(docs)
    small = max(64, size // 2_000_000)
    placed = reps.select("doc_id", "n").join(clusters.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id")
    blocked = reps.select("doc_id", "shared").join(_bands(placed, percent).hint("merge"), "doc_id")
    one = blocked.filter(F.col("every") <= BLOCK).select(F.pmod(F.xxhash64("component"), F.lit(small)).alias("group"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(2).alias("side"), "doc_id", "n", "shared")
    own = F.col("base") + F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    many = (
        blocked.filter(F.col("every") > BLOCK).withColumn("own", own).withColumn("other", F.explode(F.sequence("low", F.col("high") - 1)))
        .select((F.col("component") + small).alias("group"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "doc_id", "n", "shared")
    )

    def links(table):
        return _links(table, percent)

    # As many tasks as this work needs: by bytes alone Spark would put the blocks of a large cluster in a few.
    tasks = int(max(16, size // 4_000_000))
    linked = one.unionAll(many).repartition(tasks, "group", "lo", "hi").groupBy("group", "lo", "hi").applyInArrow(links, EDGES)
    joined = components(linked, "links")
    classes = sets.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    classes = written(classes.join(joined, F.col("rep") == F.col("id"), "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component")), "classes")
    removed(spark, clusters)
    rows_ = sets.select("doc_id", "n", "f1", "f2")  # those without grams, however many, have no class to look up
    out = rows_.filter("n > 0").join(classes, ["n", "f1", "f2"], "left").select("doc_id", "n", "component").unionAll(rows_.filter("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component")))
    null = F.lit(C.NO_ID)
    return out.select(F.nullif("doc_id", null).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "doc_id"), null).alias("component_id"))
