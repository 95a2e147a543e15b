"""Near-duplicates among embeddings, by robust-pruned flat graphs over overlapping cluster shards.

1. Equal vectors form a class (partial aggregation first, so a group of copies that
   holds a third of all rows is one entry of a task); the rest is done on classes,
   which carry how many vectors they stand for.
2. Centres come from a bounded sample (``SAMPLE`` vectors by a hash, at least four
   a centre): a few rounds of spherical k-means, after which no two centres are
   closer than a cosine of ``APART``.  There is a centre for every ``PER_CLUSTER``
   vectors, ``MOST_CLUSTERS`` at most; beyond that every centre's cell is clustered
   once more from a bounded sample of its own, so shards keep their size.  Every
   class belongs to the shards of its ``OVERLAP`` nearest centres.  Shards of more
   than ``SHARD`` classes are cut into blocks by a hash.
3. Each block builds a flat graph: vectors enter in growing batches, each
   searches the graph so far from the medoid, keeps a robust-pruned list of
   neighbours, and neighbours get it back and are pruned, too.
4. The lists that a class got in its shards are united, and edges searched both ways.
5. Each class is a query in every block of its own shards: a greedy search from the
   medoid, then a widening one, which goes on from every vector found within
   ``threshold - SLACK`` until no new one turns up.  What is found counts only by
   the cosine in double precision, and only in the first shard that both ends
   share.  Two vectors thus meet if they share one of their ``OVERLAP`` nearest
   centres, and then from both sides: ``n_links`` is symmetric but for what a graph
   search misses.
6. The recall is audited in the run: ``AUDIT`` queries (by a hash of the vector)
   are compared by brute force with all rows, in blocks, in one pass.

A task returns the number of links of each query and a spanning tree of them, so
large groups of near copies give no list of pairs; components of the trees join
the classes.  The work grows with the table, but for a shard of very many different
vectors that lie within the threshold of one another: these have as many links as
pairs, and all its blocks are searched.

A vector is a distinct pair of id and components: repeated rows count once and each
gets the result.  Vectors that share an id and differ are two vectors.  Vectors that
are null, zero, or hold null or non-finite components link with nothing; so do those
of different lengths with one another.  A null id is an id of its own that counts as
larger than all others.  Vectors are told apart by 64-bit hashes of their components.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm._chunks import NO_ID
from quernstone.llm._components import components, forest
from quernstone.llm._env import lowest, release, removed, ship, written

SAMPLE, LEAST_CLUSTERS, MOST_CLUSTERS, PER_CLUSTER, OVERLAP, SHARD, APART = 4096, 48, 4096, 200, 4, 4000, 0.85
DEGREE, BEAM, ALPHA, SLACK, QUERIES, CELLS, ASKED, AUDIT, HOT = 16, 24, 1.2, 0.05, 512, 2_000_000, 10_000, 256, 4096
NEIGHBOURS = "node long, near array<long>"
FOUND = "node long, a long, b long, n long"
PLACED = "node long, rep long, weight long, v binary, shards array<long>"
log = logging.getLogger(__name__)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a direction, and these at length one, in double precision."""
    x = np.asarray(x, np.float64)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1) if x.size else np.zeros(len(x), bool)
    x = x[ok]
    if not len(x):
        return ok, x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return ok, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(vectors: pa.Array) -> list[bytes | None]:
    """The components of each list as bytes; None for lists that are null or hold null or non-finite components or no other than zero."""
    vectors = vectors.cast(pa.large_list(vectors.type.value_type))
    at = vectors.offsets.to_numpy()
    flat = vectors.values
    gap = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
    x = flat.fill_null(0).to_numpy(zero_copy_only=False)
    x = x if x.dtype == np.float32 else x.astype(np.float64)
    x = x + x.dtype.type(0)  # one zero only
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    some = np.concatenate(([0], np.cumsum(x != 0)))
    ok = vectors.is_valid().to_numpy(zero_copy_only=False) & (np.diff(gap[at]) == 0) & (np.diff(bad[at]) == 0) & (np.diff(some[at]) > 0)
    data, width = x.tobytes(), x.itemsize
    return [data[a * width : b * width] if k else None for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), ok.tolist())]


def centres(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Up to k directions, no two closer than APART."""

    def spread(c: np.ndarray) -> np.ndarray:
        kept: list[int] = []
        near = c @ c.T
        for i in range(len(c)):
            if not kept or near[i, kept].max() < APART:
                kept.append(i)
        return c[kept]

    c = spread(x[:k])
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c = spread(total[size > 1e-9] / size[size > 1e-9, None])
    return c


def nearest(x: np.ndarray, c: np.ndarray, most: int) -> np.ndarray:
    """For each row the numbers of the centres nearest to it."""
    return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :most]


def robust_prune(x: np.ndarray, point: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """For each point (a row of cand, -1 for none) at most DEGREE candidates, nearest first, dropping those that a kept one is ALPHA times closer to."""
    cand = np.where(cand == point[:, None], -1, cand)
    order = np.argsort(np.where(cand < 0, 9.0, -sim), axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    far = 1 - sim
    v = x[np.maximum(cand, 0)]
    apart = 1 - np.matmul(v, v.transpose(0, 2, 1))
    live, count = cand >= 0, np.zeros(len(cand), np.int64)
    out = np.full((len(cand), DEGREE), -1, np.int64)
    for i in range(cand.shape[1]):
        take = np.flatnonzero(live[:, i] & (count < DEGREE))
        if not len(take):
            continue
        out[take, count[take]] = cand[take, i]
        count[take] += 1
        live[take] &= ~(ALPHA * apart[take, i] <= far[take])
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BEAM nearest vectors that a greedy search from start meets, and their similarities, for all queries at once."""
    n = len(q)
    ids, sim = np.full((n, BEAM), -1, np.int64), np.full((n, BEAM), -9.0, np.float32)
    ids[:, 0], sim[:, 0] = start, q @ x[start]
    done = np.zeros((n, BEAM), bool)
    done[:, 1:] = True
    row = np.arange(n)
    while True:
        open_ = np.where(done, -9.0, sim)
        at = open_.argmax(axis=1)
        go = np.flatnonzero(~done[row, at])
        if not len(go):
            return ids, sim
        done[go, at[go]] = True
        near = graph[ids[go, at[go]]]
        fresh = (near >= 0) & ~(near[:, :, None] == ids[go][:, None, :]).any(axis=2)
        s = np.where(fresh, np.einsum("nd,nkd->nk", q[go], x[np.maximum(near, 0)]), np.float32(-9))
        every, sims = np.concatenate((ids[go], np.where(fresh, near, -1)), axis=1), np.concatenate((sim[go], s), axis=1)
        seen = np.concatenate((done[go], ~fresh), axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :BEAM]
        ids[go], sim[go], done[go] = np.take_along_axis(every, order, 1), np.take_along_axis(sims, order, 1), np.take_along_axis(seen, order, 1)


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def build(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """The flat graph of the vectors: DEGREE neighbours each, -1 for none."""
    n, start = len(x), medoid(x)
    graph = np.full((n, DEGREE), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        ids, sim = beam_search(x, graph, start, x[batch])
        if len(batch) > 1:  # those that enter together know one another's nearest
            own = x[batch] @ x[batch].T
            k = min(DEGREE, len(batch))
            top = np.argpartition(-own, k - 1, axis=1)[:, :k]
            ids, sim = np.concatenate((ids, batch[top]), axis=1), np.concatenate((sim, np.take_along_axis(own, top, 1)), axis=1)
        graph[batch] = robust_prune(x, batch, ids, sim)
        source = np.repeat(batch, DEGREE)
        target = graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        give = np.argsort(target, kind="stable")
        source, target = source[give], target[give]
        who, first, many = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, many)
        sim_back = np.einsum("nd,nd->n", x[source], x[target])
        best = np.lexsort((-sim_back, target))
        source = source[best]
        keep = place < 2 * DEGREE
        wide = np.full((len(who), 2 * DEGREE), -1, np.int64)
        wide[np.repeat(np.arange(len(who)), many)[keep], place[keep]] = source[keep]
        cand = np.concatenate((graph[who], wide), axis=1)
        sims = np.einsum("nd,nkd->nk", x[who], x[np.maximum(cand, 0)])
        graph[who] = robust_prune(x, who, cand, sims)
        at += size
        size = min(2 * size, 512)
    return graph


def range_search(x: np.ndarray, graph: np.ndarray, wide: np.ndarray, q: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Query and vector of all pairs with a similarity of at least low that the widening search meets.  wide: the graph with edges both ways."""
    n, m = len(q), len(x)
    ids, sim = beam_search(x, graph, medoid(x), q)
    seen = np.zeros(n * m, bool)
    row, col = np.nonzero((ids >= 0) & (sim >= low))
    flat = np.unique(row * m + ids[row, col])
    seen[flat] = True
    found = [flat]
    while len(flat):
        parts = []
        for part in np.array_split(flat, 1 + len(flat) * wide.shape[1] // CELLS):  # hubs make wide rows
            near = wide[part % m]
            to = ((part // m)[:, None] * m + near)[near >= 0]
            to = np.unique(to[~seen[to]])
            seen[to] = True
            close = np.einsum("nd,nd->n", q[to // m], x[to % m]) >= low
            parts.append(to[close])
        flat = np.concatenate(parts)
        found.append(flat)
    flat = np.concatenate(found)
    return flat // m, flat % m


def both_ways(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The graph with every edge in both directions, so that no vector is without a way to it."""
    flat = np.unique(np.concatenate((source * n + target, target * n + source)))
    source, target = flat // n, flat % n
    many = np.bincount(source, minlength=n)
    graph = np.full((n, max(1, int(many.max()) if n else 1)), -1, np.int64)
    graph[source, np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)] = target
    return graph


def _rows(data: list[bytes], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length from their bytes: unit() of them."""
    return unit(np.frombuffer(b"".join(data), dtype).reshape(len(data), -1))


def _members(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray]:
    return table["node"].to_numpy(), _rows(table["v"].to_pylist(), dtype)[1]


def _graph(table: pa.Table, dtype) -> pa.Table:
    ids, x = _members(table, dtype)
    graph = build(x.astype(np.float32))
    near = [ids[g[g >= 0]] for g in graph]
    return pa.table({"node": pa.array(ids, pa.int64()), "near": pa.array(near, pa.list_(pa.int64()))})


def _shards(table: pa.Table) -> np.ndarray:
    """The shards of each row, -1 where there are fewer."""
    lists = table["shards"].to_pylist()
    out = np.full((len(lists), max(map(len, lists))), -1, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _search(shard: int, table: pa.Table, threshold: float, dtype) -> pa.Table:
    """Rows of kind 0 are the block's members with their united lists, of kind 1 the queries; where there are none, the members are the queries."""
    kind = table["kind"].to_numpy()
    block, asked = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
    if not asked.num_rows:
        asked = block
    ids, x = _members(block, dtype)
    own, rep, weight = _shards(block), block["rep"].to_numpy(), block["weight"].to_numpy()
    who, q = _members(asked, dtype)
    theirs, asker = _shards(asked), asked["rep"].to_numpy()
    lists = block["near"].combine_chunks()
    by = np.argsort(ids, kind="stable")
    flat, source = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = by[np.minimum(np.searchsorted(ids[by], flat), len(ids) - 1)]
    here = ids[at] == flat
    source, at = source[here], at[here]
    many = np.bincount(source, minlength=len(ids))
    graph = np.full((len(ids), max(1, int(many.max()))), -1, np.int64)
    graph[source, np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)] = at
    wide = both_ways(len(ids), source, at)
    small = x.astype(np.float32)
    count, a, b = np.zeros(len(who), np.int64), [], []
    for n in range(0, len(who), QUERIES):
        part = q[n : n + QUERIES]
        i, j = range_search(small, graph, wide, part.astype(np.float32), threshold - SLACK)
        for s in range(0, len(i), 1 << 18):
            u, v = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            ok = (np.einsum("nd,nd->n", part[u], x[v]) >= threshold) & (who[n + u] != ids[v])
            u, v = u[ok], v[ok]
            mine, other = theirs[n + u], own[v]
            common = (mine[:, :, None] == other[:, None, :]).any(axis=2) & (mine >= 0)
            first = np.where(common, mine, NO_ID).min(axis=1) == shard
            u, v = u[first], v[first]
            count[n : n + len(part)] += np.bincount(u, weights=weight[v], minlength=len(part)).astype(np.int64)
            fa, fb = forest(asker[n + u], rep[v])
            a.append(fa)
            b.append(fb)
    empty = np.zeros(0, np.int64)
    fa, fb = forest(np.concatenate([*a, empty]), np.concatenate([*b, empty]))
    release()
    some = np.flatnonzero(count)
    pad = np.full(len(some), -1)
    return pa.table({"node": pa.array(np.concatenate((who[some], np.full(len(fa), -1))), pa.int64()), "a": pa.array(np.concatenate((pad, fa)), pa.int64()), "b": pa.array(np.concatenate((pad, fb)), pa.int64()), "n": pa.array(np.concatenate((count[some], np.zeros(len(fa), np.int64))), pa.int64())})


def _placed(classes: DataFrame, total: int, dtype, most: int, per: int) -> DataFrame:
    """classes with the shards of each: numbers of its nearest centres, of one level or of two."""
    spark = classes.sparkSession
    wanted = total // per
    k = int(min(most, max(LEAST_CLUSTERS, wanted)))
    got = lowest(classes.select("v"), F.xxhash64("v", F.lit(5)), max(SAMPLE, 4 * k), total).collect()  # bounded by SAMPLE and most
    by_length: dict[int, list] = {}
    for r in got:
        by_length.setdefault(len(r.v), []).append(bytes(r.v))
    points, base = {}, 0
    for length, own in sorted(by_length.items()):
        c = centres(_rows(own, dtype)[1], max(1, k * len(own) // len(got)))
        points[length] = (base, c)
        base += len(c)
    held = spark.sparkContext.broadcast(points)
    fine = -(-wanted // most) if wanted > most else 1
    first = OVERLAP if fine == 1 else OVERLAP // 2

    def place(batches):
        for batch in batches:
            data = batch.column("v").to_pylist()
            size = np.array([len(v) for v in data])
            out: list = [None] * len(data)
            for length in np.unique(size).tolist():
                own = np.flatnonzero(size == length)
                start, c = held.value.get(length, ((1 << 38) + length, None))  # a length that the sample missed is a shard of its own
                if c is None:
                    near = np.zeros((len(own), 1), np.int64)
                else:
                    near = nearest(_rows([data[i] for i in own], dtype)[1], c, first)
                for i, x in zip(own, near + start):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "shards"])

    coarse = classes.mapInArrow(place, PLACED)
    if fine == 1:
        return coarse
    # The second level: a cell's own centres, from a bounded sample of it; a large cell is dealt to pieces.
    coarse = written(coarse, "coarse")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("v", F.lit(6)), "node"))
    sample = coarse.select(F.col("shards")[0].alias("cell"), "node", "v").withColumn("rank", rank).filter(F.col("rank") <= 4 * most).drop("rank")

    def centre(table):
        x = _rows(table["v"].to_pylist(), dtype)[1]
        c = centres(x, max(1, min(fine * 4, table.num_rows // 4)))  # cells differ in size: up to four times the mean
        return pa.table({"cell": pa.array([table["cell"][0].as_py()] * len(c), pa.int64()), "no": pa.array(np.arange(len(c)), pa.int64()), "c": pa.array([y.tobytes() for y in c], pa.binary())})

    inner = sample.groupBy("cell").applyInArrow(centre, "cell long, no long, c binary")
    inner = written(inner, "centres")
    each = coarse.select("node", "rep", "weight", "v", F.explode("shards").alias("cell"))
    pieces = written(each.groupBy("cell").agg(F.ceil(F.count("*") / (8 * SHARD)).cast("int").alias("pieces")), "pieces")  # one row a cell
    each = each.join(pieces, "cell").withColumn("piece", F.pmod(F.xxhash64("node", F.lit(2)), F.col("pieces")).cast("int"))
    dealt = inner.join(pieces.select("cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")), "cell")

    def assign(key, table, cs):
        if not table.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "shards": pa.array([], pa.list_(pa.int64()))})
        cs = cs.sort_by("no")
        c = np.frombuffer(b"".join(cs["c"].to_pylist()), np.float64).reshape(cs.num_rows, -1) if cs.num_rows else None
        near = nearest(_rows(table["v"].to_pylist(), dtype)[1], c, OVERLAP // 2) if c is not None else np.zeros((table.num_rows, 1), np.int64)
        return pa.table({"node": table["node"], "shards": pa.array(list(near + (key[0].as_py() << 24)), pa.list_(pa.int64()))})

    shards = each.groupBy("cell", "piece").cogroup(dealt.groupBy("cell", "piece")).applyInArrow(assign, "node long, shards array<long>")
    shards = shards.groupBy("node").agg(F.flatten(F.collect_list("shards")).alias("shards"))  # OVERLAP numbers at most
    return coarse.drop("shards").join(shards, "node").select("node", "rep", "weight", "v", "shards")


def _audit(units: DataFrame, counts: DataFrame, total: int, threshold: float, dtype) -> float:
    """Share of the links of AUDIT queries, taken by a hash of the vector, that the search counted; brute force against all rows, in one pass."""
    spark = units.sparkSession
    asked = lowest(counts, F.xxhash64("v", F.lit(9)), AUDIT, total).select("node", "v", "n_links").collect()  # bounded
    held = spark.sparkContext.broadcast([(r.node, bytes(r.v)) for r in asked])

    def count(batches):
        total = np.zeros(len(held.value), np.int64)
        for batch in batches:
            data, nodes = batch.column("v").to_pylist(), batch.column("node").to_numpy()
            weight = batch.column("weight").to_numpy()
            size = np.array([len(v) for v in data])
            for length in {len(v) for _, v in held.value}:
                own, mine = np.flatnonzero(size == length), [k for k, (_, v) in enumerate(held.value) if len(v) == length]
                if not len(own):
                    continue
                sim = _rows([data[i] for i in own], dtype)[1] @ _rows([held.value[k][1] for k in mine], dtype)[1].T
                same = nodes[own][:, None] == np.array([held.value[k][0] for k in mine])
                total[mine] += ((sim >= threshold) & ~same).T @ weight[own]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["k", "n"])

    true = {r.k: r.n for r in units.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    every = sum(true.values())
    return sum(min(true.get(k, 0), r.n_links) for k, r in enumerate(asked)) / every if every else 1.0


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, most_clusters: int = MOST_CLUSTERS, per_cluster: int = PER_CLUSTER, shard: int = SHARD) -> DataFrame:
    """One row a row: vec_id, n_links, component_id, kept, audited_recall (the same in all rows: of the run's audit, over links between different vectors)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(vector_col).alias("v"))
    dtype = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    if dtype is np.float64:
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed(batch.column("v")), pa.binary())], ["vec_id", "v"])

    units = rows.mapInArrow(pack, "vec_id long, v binary").withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    some = units.filter("v IS NOT NULL")
    size = some.select("node", "vec_id").distinct().groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = written(some.select("node", "v").dropDuplicates(["node"]).join(size, "node").select("node", "rep", "weight", "v"), "classes")
    total = classes.count()
    placed = written(_placed(classes, total, dtype, most_clusters, per_cluster), "placed")
    shapes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks"), F.ceil(F.count("*") / ASKED).cast("int").alias("pieces"))
    shapes = written(shapes, "shapes")  # one row a shard: Spark broadcasts it only where it is small
    members = placed.select("*", F.explode("shards").alias("shard")).join(shapes, "shard")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = members.withColumn("block", block)

    def graph(table):
        return _graph(table, dtype)

    lists = members.select("shard", "block", "node", "v").groupBy("shard", "block").applyInArrow(graph, NEIGHBOURS)
    united = written(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "united")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = members.join(united, "node").select("shard", "block", F.when(F.col("blocks") == 1, 1).otherwise(F.col("pieces")).alias("pieces"), "node", "rep", "weight", "v", "shards", "near")
    index = index.select("shard", "block", each("pieces").alias("piece"), F.lit(0).alias("kind"), "node", "rep", "weight", "v", "shards", "near")
    piece = F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces")).cast("int").alias("piece")
    asked = members.filter("blocks > 1").select("shard", each("blocks").alias("block"), piece, F.lit(1).alias("kind"), "node", "rep", "weight", "v", "shards", F.lit(None).cast("array<long>").alias("near"))

    def search(key, table):
        return _search(key[0].as_py(), table, threshold, dtype)

    found = written(index.unionAll(asked).groupBy("shard", "block", "piece").applyInArrow(search, FOUND), "found")
    joined = components(found.filter("n = 0").select("a", "b"), "vectors")
    counts = found.filter("n > 0").groupBy("node").agg(F.sum("n").alias("n_links"))
    counted = classes.join(counts, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    done = written(counted.join(joined, F.col("rep") == F.col("id"), "left").select("node", "v", (F.col("n_links") + F.col("weight") - 1).alias("n_links"), F.col("n_links").alias("others"), "weight", F.coalesce("component", "rep").alias("component")), "results")
    share = _audit(classes, done.select("node", "v", F.col("others").alias("n_links")), total, threshold, dtype)
    log.info("embedding_links: audited recall %.4f", share)
    for table in (placed, shapes, united, found):
        removed(spark, table)
    # Rows of the few large classes are dealt over salts in the join back.
    hot = done.filter(F.col("weight") > HOT).select("node", F.lit(16).alias("salts"))  # one of HOT rows at most
    left = units.select("vec_id", "node").join(F.broadcast(hot), "node", "left").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.coalesce("salts", F.lit(1)).cast("long")))
    right = done.select("node", "n_links", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("weight") > HOT, 15).otherwise(0).cast("long"))).alias("salt"))
    out = left.join(right, ["node", "salt"], "left")
    null = F.lit(NO_ID)
    component = F.coalesce("component", "vec_id")
    return out.select(F.nullif("vec_id", null).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.nullif(component, null).alias("component_id"), (F.col("vec_id") == component).alias("kept"), F.lit(share).alias("audited_recall"))


def recall(vectors: DataFrame, result: DataFrame, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> float:
    """Share of brute-force links that the result counts, over queries with ids divisible by ``every``, in blocks against all rows; for tables that fit the driver."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).collect()
    length = max((len(r.v) for r in rows if r.v is not None), default=0)
    rows = [r for r in rows if r.v is not None and len(r.v) == length and None not in r.v]
    ok, x = unit(np.array([r.v for r in rows], np.float64).reshape(len(rows), length))
    ids = np.array([r.id for r in rows])[ok]
    got = {r.vec_id: r.n_links for r in result.collect()}
    asked = np.flatnonzero(ids % every == 0)
    found = true = 0
    for n in range(0, len(asked), 512):
        near = (x[asked[n : n + 512]] @ x.T >= threshold).sum(axis=1) - 1
        true += int(near.sum())
        found += sum(min(int(t), got[i]) for t, i in zip(near, ids[asked[n : n + 512]].tolist()))
    return found / true if true else 1.0
