from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import scalar
from quernstone.operators import approx, graph, ivm, joins, lake, provenance, quality
from quernstone.plans.advice import partitioning, select_views
from quernstone.plans.dsl import Features, Metrics, Pipeline, is_deterministic, lineage
from quernstone.plans.sqlpair import guarded
from quernstone.sources.readers import Catalog, read_jsonl
from quernstone.streaming import asof, cdc, cep, watermarks

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_asof_ties_and_bounds(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "k string, t int").withColumn("t", F.timestamp_seconds("t"))
    right = spark.createDataFrame([("a", 10, 1), ("a", 10, 2), ("a", 15, 3)], "k string, u int, v int").withColumn("u", F.timestamp_seconds("u"))
    got = joins.asof_join(left, right, ["k"], "t", "u", ["v"], tie="v").select("k", F.unix_timestamp("t"), "v")
    assert rows(got) == [("a", 10, 2), ("a", 20, 3), ("b", 5, None)]
    got = joins.asof_join(left, right, ["k"], "t", "u", ["v"], tie="v", allow_exact=False, lookback="4 SECONDS").select("v")
    assert [r.v for r in got.collect()] == [None, None, None]


def test_acyclicity():
    assert joins.is_acyclic([{"a", "b"}, {"b", "c"}, {"c", "d"}])
    assert not joins.is_acyclic([{"a", "b"}, {"b", "c"}, {"c", "a"}])


@few
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=30))
def test_triangles_brute_force(spark, edges):
    e = {(min(a, b), max(a, b)) for a, b in edges if a != b}
    want = sorted((x, y, z) for x in range(8) for y in range(x + 1, 8) for z in range(y + 1, 8) if {(x, y), (y, z), (x, z)} <= e)
    df = spark.createDataFrame(edges or [(0, 0)], "src int, dst int")
    assert rows(joins.triangles(df)) == want


@few
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=12), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.sampled_from([1, -1])), min_size=1, max_size=8))
def test_group_delta_is_recomputation(spark, base, change):
    old = ivm.signed(spark.createDataFrame(base, "k int, v int"))
    delta = spark.createDataFrame([(k, v, d) for k, v, d in change], "k int, v int, _diff long")
    agg = [F.count("*").alias("n"), F.max("v").alias("hi")]
    view = ivm.signed(ivm.visible(ivm.consolidate(old)).groupBy("k").agg(*agg))
    after = ivm.visible(ivm.apply_delta(view, ivm.delta_group_by(ivm.consolidate(old), delta, ["k"], agg)))
    assert rows(after) == rows(ivm.visible(ivm.apply_delta(old, delta)).groupBy("k").agg(*agg))


def test_left_join_delta_retracts_placeholder(spark):
    left, right = ivm.signed(spark.createDataFrame([(1, "x")], "k int, l string")), ivm.signed(spark.createDataFrame([], "k int, r string"))
    d = ivm.delta_left_join(left, left.limit(0), right, ivm.signed(spark.createDataFrame([(1, "y")], "k int, r string")), ["k"])
    assert rows(d) == [(1, "x", "y", 1), (1, "x", None, -1)]
    gone = ivm.delta_left_join(left, left.withColumn("_diff", F.lit(-1).cast("long")), right, right, ["k"])
    assert rows(gone) == [(1, "x", None, -1)]


def test_semirings(spark):
    df = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t3")], "x string, t string")
    why = provenance.project(provenance.annotate(df, provenance.WHY, F.col("t")), provenance.WHY, ["x"])
    assert rows(why.select("x", "_k")) == [("a", [["t1"], ["t2"]]), ("b", [["t3"]])]
    assert provenance.exact_probability([["t1"], ["t2"]], {"t1": 0.5, "t2": 0.5}) == 0.75
    square = provenance.how_join(provenance.how(df, F.col("t")).drop("t"), provenance.how(df, F.col("t")).drop("t"), ["x"])
    assert rows(provenance.multiplicity(square, ["x"])) == [("a", 4), ("b", 1)]


def test_statistics():
    assert quality.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-6)
    assert quality.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert quality.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert quality.beta_posterior(9, 1, 0.5)[0] == pytest.approx(10 / 12)
    assert approx.hoeffding_size(0.05, 0.05) == math.ceil(math.log(40) / 0.005)


def test_ledger():
    ledger = approx.PrivacyLedger(1.0)
    ledger.charge(0.6)
    assert ledger.plan(0.6)[0] == "rewrite" and ledger.plan(0.4)[0] == "accept"
    with pytest.raises(ValueError):
        ledger.charge(0.6)


def test_noise_moments(spark):
    x = spark.range(20_000).select(approx.laplace_noise(2.0, "id", seed=1).alias("l"), approx.gaussian_noise(3.0, "id", seed=2).alias("g"))
    m = x.agg(F.avg("l"), F.var_pop("l"), F.avg("g"), F.var_pop("g")).first()
    assert abs(m[0]) < 0.1 and abs(m[1] - 8) < 0.8 and abs(m[2]) < 0.1 and abs(m[3] - 9) < 0.6


def test_graph_loops(spark):
    e = spark.createDataFrame([(1, 2, 10.0), (2, 3, 10.0), (3, 1, 10.0), (3, 4, 1.0)], "src long, dst long, weight double")
    assert [(r.path, r.exposure) for r in graph.simple_cycles(e, 3, 4).collect()] == [([1, 2, 3], 10.0)]
    assert rows(graph.contagion(e, [1], 0.5)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    total = graph.pagerank(e, 30, dangling="redistribute").agg(F.sum("rank")).first()[0]
    assert total == pytest.approx(1.0, abs=1e-6)


def test_snapshots(spark, tmp_path):
    t = lake.SnapshotTable(spark, str(tmp_path / "t"))
    t.write(spark.range(3).toDF("id"))
    t.write(spark.range(3, 5).toDF("id"), mode="append")
    t.write(spark.range(1).toDF("id"))
    assert [t.read(v).count() for v in (0, 1, 2)] == [3, 5, 1]
    assert rows(t.changes(0, 1)) == [(3, "insert"), (4, "insert")]
    assert len(t.vacuum(1)) == 2 and t.read().count() == 1


def test_scd2_inserts_new_keys_once(spark):
    cur = lake.scd2(spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "k int, v string, s int"), ["k"], ["v"], "s")
    assert rows(cur.select("k", "v", "valid_from", "valid_to")) == [(1, "a", 1, 3), (1, "b", 3, None)]
    after = lake.merge_scd2(cur, spark.createDataFrame([(2, "z", 9)], "k int, v string, s int"), ["k"], ["v"], "s")
    assert after.filter("k = 2").count() == 1


def test_heal_and_drift(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "a string, extra string")
    healed = quality.heal(df, [("a", "int"), ("b", "double")])
    assert rows(healed) == [(1, None), (2, None)]
    with pytest.raises(ValueError):
        quality.heal(spark.createDataFrame([("x",), ("y",)], "a string"), [("a", "int")])
    assert quality.compatible({"a": ("int", True)}, {"a": ("bigint", True), "b": ("string", True)}, "backward") == ["b is required and not written"]


def test_cep_fold():
    p = cep.Pattern("p").begin("A").then("B", gap=5).then("C", count=2).within(20)
    ms = [m for _, m in p.fold([(0, "A", 0, 0), (1, "X", 0, 0), (3, "B", 0, 0), (4, "C", 0, 0), (6, "C", 0, 0), (7, "A", 0, 0), (20, "B", 0, 0), (21, "B", 0, 0)])]
    assert [m for m in ms if m] == [(0, 6)]
    single = cep.Pattern("s").begin("A")
    assert sum(1 for _, m in single.fold([(0, "A", 0, 0), (1, "A", 0, 0)]) if m) == 2


def test_asof_corrections():
    state = asof.fresh()
    out = list(asof.fold([(10, "left", 1.0), (5, "right", 2.0), (8, "right", 3.0), (6, "right", 4.0)], state, 100, 100))
    assert [o[4] for o in out] == ["+", "-", "+", "-", "+"] and out[-1][3] == 3.0


def test_watermarks():
    assert watermarks.pareto([("a", 0.9, 5), ("b", 0.8, 5), ("c", 0.99, 50)]) == ["a", "c"]
    assert watermarks.advance(100, {"x": 5, "y": 10}, 95) == 95
    pid = watermarks.Pid(1.0, 0.1, 10)
    assert pid.update(5.0) <= 1.0


def test_causal_sort(spark):
    log = spark.createDataFrame([("g", "p", 1, {"p": 1}), ("g", "q", 1, {"p": 1, "q": 1}), ("g", "p", 2, {"p": 2, "q": 1})], "g string, p string, s int, c map<string,int>")
    got = cdc.causal_sort(log, "g", "p", "s", "c").orderBy("place").select("producer", "seq")
    assert [tuple(r) for r in got.collect()] == [("p", 1), ("q", 1), ("p", 2)]


def test_envelope(spark):
    good = '{"before": null, "after": {"id": 1, "v": "x"}, "op": "c", "ts_ms": 5, "source": {"lsn": 7}}'
    flat = cdc.flatten_envelope(spark.createDataFrame([(good,), ("{broken",)], "value string"), "value", "id: INT, v: STRING")
    ok, bad = cdc.dead_letters(flat)
    assert ok.first()[:4] == (1, "x", "c", 7) and bad.count() == 1


def test_dsl(spark):
    p = Pipeline(spark)
    p.source("a")(lambda s: s.range(10).withColumn("k", F.col("id") % 2))
    p.add("f", "filter", ["a"], condition="id > 3").add("g", "aggregate", ["f"], by=["k"], aggregates={"n": ("count", "id"), "s": ("sum", "id")})
    assert rows(p.compile("g")) == [(0, 3, 18), (1, 3, 21)]
    with pytest.raises(ValueError):
        Pipeline(spark).add("x", "filter", ["y"], condition="1").add("y", "filter", ["x"], condition="1").compile("x")


def test_metrics_features_lineage(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", 5.0, 0.0)], "d string, x double, y double")
    m = Metrics(x={"kind": "simple", "measure": "sum(x)"}, y={"kind": "simple", "measure": "sum(y)"}, r={"kind": "ratio", "numerator": "x", "denominator": "y"})
    assert rows(m.compute(df, ["r"], ["d"])) == [("a", 1.0), ("b", None)]
    f = Features()
    f.feature("twice")(lambda d: F.col("x") * 2)
    assert [r.twice for r in f.compute(df).collect()] == [2.0, 6.0, 10.0]
    assert is_deterministic(lambda: df)
    assert dict(lineage(spark.range(3).selectExpr("id * 2 AS z")))["z"] == ["id"]


def test_guard_and_catalog(spark):
    with pytest.raises(ValueError):
        guarded("SELECT * FROM a ASOF JOIN b ON a.x = b.x")
    c = Catalog(spark).add_frame("a", spark.range(3)).add_frame("b", spark.range(2, 5))
    assert c.sql("SELECT count(*) FROM a JOIN b USING (id)").first()[0] == 1


def test_bad_json_is_kept_apart(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\nbroken\n')
    good, bad = read_jsonl(spark, str(tmp_path / "x.json"), "a INT")
    assert good.count() == 1 and bad.first()[0] == "broken"


def test_scalars(spark):
    df = spark.createDataFrame([("12 tháng", "a@b.org, +84 123 456 789")], "t string, x string")
    r = df.select(scalar.term_days(F.col("t")).alias("d"), scalar.mask_pii(F.col("x")).alias("m"), joins.token_sort_ratio(F.lit("Foo bar"), F.lit("bar foo")).alias("r")).first()
    assert (r.d, r.m, r.r) == (360, "<email>, <phone>", 100.0)


def test_advice():
    assert select_views([{"name": "a", "cost": 5, "benefit": 10}, {"name": "b", "cost": 6, "benefit": 9}], 6) == ["a"]
    assert partitioning({"day": {"filters": 9, "distinct": 365}, "id": {"filters": 1, "joins": 5, "distinct": 10**7}}, 10**9)["partition_by"] == "day"


def test_ntile_matches_window(spark):
    w = Window.orderBy("id")
    assert spark.range(10).select(F.ntile(3).over(w).alias("n")).groupBy("n").count().count() == 3


def test_betweenness_and_weights(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 4, 3.0)], "src long, dst long, weight double")
    assert rows(graph.betweenness(e)) == [(1, 0.0), (2, 1.0), (3, 0.0), (4, 0.0)]
    r = dict(rows(graph.pagerank(e, 1, tolerance=0.0, weight="weight")))
    assert r[4] > r[2]


def test_interval_coverage(spark):
    df = spark.range(3000).select("id", (F.col("id") % 97 + 1).cast("double").alias("v"))
    assert approx.coverage(df, "id", "v", 300, range(8), 0.999) >= 0.85


def test_global_watermark(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 9.0), ("b", 7.0)], "k string, w double")
    assert watermarks.global_watermark(df, "w", "k").first()[0] == 7.0


class _Handle:
    """A state store in memory, with the calls that keyed state makes."""

    def __init__(self):
        self.made = {}

    def getListState(self, name, schema, ttl=None):
        return self.made.setdefault(name, _ListStore())

    def getMapState(self, name, key, schema, ttl=None):
        return self.made.setdefault(name, _MapStore())


class _ListStore(list):
    def exists(self):
        return bool(self)

    def get(self):
        return iter(list(self))

    def appendValue(self, v):
        self.append(v)

    def put(self, vs):
        self[:] = vs


class _MapStore(dict):
    writes = 0

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self.writes += 1
        self[k] = v

    def removeKey(self, k):
        del self[k]

    def iterator(self):
        return iter(self.items())


def test_list_and_map_state():
    from quernstone.streaming.state import List, Map

    h = _Handle()
    rows = List(h, "rows", "v int")
    assert rows.get() == []
    rows.add(1)
    rows.add(2)
    rows.update([*rows.get(), 3])
    assert List(h, "rows", "v int").get() == [1, 2, 3]
    m = Map(h, "m", "k string", "v int", ttl=10, refresh=True)
    m.put("a", 1)
    assert m.get("a") == 1 and m.get("b", 0) == 0 and m.items() == [("a", 1)] and h.made["m"].writes == 2
    m.remove("a")
    assert m.items() == []


def test_exact_quantiles_and_ranks(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from quernstone.operators.windows import exact_quantiles, first_numbered, global_ntile, global_rank

    x = np.random.default_rng(0).integers(0, 300, 1000) / 7
    df = spark.createDataFrame([(float(v), k) for k, v in enumerate(x)] + [(None, -1)], "v double, id int")
    ranks = [0.0, 0.013, 0.5, 0.77, 1.0]
    assert np.allclose(exact_quantiles(df, "v", ranks), np.quantile(x, ranks)) and exact_quantiles(df.filter("id < -5"), "v", [0.5]) == [None]
    some = df.filter("v IS NOT NULL")
    got = {r.id: r for r in global_rank(global_ntile(some, ["v", "id"], 7, "t"), "v", "rk").collect()}
    order = sorted(range(1000), key=lambda k: (x[k], k))
    sizes = [143] * 6 + [142]
    tile = [t + 1 for t, n in enumerate(sizes) for _ in range(n)]
    assert all(got[k].t == tile[i] and got[k].rk == 1 + int((x < x[k]).sum()) for i, k in enumerate(order))
    assert [(r.rn, r.id) for r in first_numbered(some, [F.desc("v"), "id"], 3).orderBy("rn").collect()] == [(i + 1, k) for i, k in enumerate(sorted(range(1000), key=lambda k: (-x[k], k))[:3])]


def test_generic_join_against_pandas(spark):
    import numpy as np

    from quernstone.operators.joins import generic_join

    rng = np.random.default_rng(1)
    r, s, t = ({(int(a), f"k{b}") for a, b in rng.integers(0, 12, (60, 2))}, {(f"k{a}", int(b)) for a, b in rng.integers(0, 12, (60, 2))}, {(int(a), int(b)) for a, b in rng.integers(0, 12, (60, 2))})
    frames = [spark.createDataFrame(sorted(r) + [(None, "k1")], "x int, y string"), spark.createDataFrame(sorted(s), "y string, z int"), spark.createDataFrame(sorted(t), "x int, z int")]
    want = {(x, y, z) for x, y in r for y2, z in s if y2 == y if (x, z) in t}
    out = generic_join(frames, cells=27)
    assert {(row.x, row.y, row.z) for row in out.collect()} == want and out.count() == len(want)
    assert generic_join([frames[0], frames[1].limit(0)]).count() == 0


def test_generic_join_counts_without_making_the_results(spark):
    """Two triangles at each of 40 nodes of a complete graph: 40 * 40 ** 4 results; and on a sparse graph the numbers of the rows themselves."""
    from quernstone.operators.joins import generic_join

    bowtie = [("x", "y"), ("y", "z"), ("z", "x"), ("x", "u"), ("u", "v"), ("v", "x")]
    full = spark.range(1600).select((F.col("id") % 40).alias("a"), (F.col("id") / 40).cast("long").alias("b"))
    assert rows(generic_join([full.toDF(*p) for p in bowtie], by=["x"])) == rows(spark.range(40).select("id", F.lit(40**4)))
    some = full.filter("(a * 7 + b * 3) % 11 < 2 AND a < 14 AND b < 14")
    for shape, by in ((bowtie, ["x"]), (bowtie, ["u", "y"]), ([("x", "y"), ("y", "z"), ("z", "w"), ("w", "x")], ["z"]), ([("x", "y"), ("z", "w")], ["y"])):
        frames = [some.toDF(*p) for p in shape]
        want = rows(generic_join(frames).groupBy(*by).agg(F.count("*").alias("n")))
        assert want and rows(generic_join(frames, by=by)) == want


def test_fuzzy_match_loses_no_pair(spark):
    """Amounts far apart that the weights still let through, and a row whose best partner prefers another."""
    import datetime as dt

    from quernstone.operators.joins import fuzzy_match

    d = dt.date(2024, 1, 5)
    left = spark.createDataFrame([(1, "inv 77", 100.0, d), (2, "inv 78", 100.0, d), (3, "other", 5.0, d)], "k int, r string, a double, d date")
    right = spark.createDataFrame([(10, "inv 77", 40.0, d), (11, "inv 78", 100.0, d), (12, "inv 79", 100.0, d)], "k int, r string, a double, d date")
    got = {(x.lk, x.rk) for x in fuzzy_match(left, right, "k", "r", "a", "d").collect()}
    assert got == {(2, 11), (1, 12)} or got == {(2, 11), (1, 10)}
    assert {(x.lk, x.rk) for x in fuzzy_match(left.filter("k = 1"), right.filter("k = 10"), "k", "r", "a", "d").collect()} == {(1, 10)}


def test_pagerank_without_edges(spark, tmp_path):
    """No edges: no ranks, and no error; so too where no edge carries more than the others."""
    from quernstone.plans import registry

    for dangling in ("drop", "redistribute"):
        none = graph.pagerank(spark.createDataFrame([], "src long, dst long"), 3, dangling=dangling)
        assert none.columns == ["id", "rank"] and rows(none) == []
    one = {"lineitem": "1L AS l_orderkey, 1L AS l_suppkey, 5.0D AS l_extendedprice", "orders": "1L AS o_orderkey, 1L AS o_custkey", "customer": "1L AS c_custkey, 3 AS c_nationkey", "supplier": "1L AS s_suppkey, 4 AS s_nationkey"}
    for name, row in one.items():
        spark.sql(f"SELECT {row}").write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows(registry.queries()["pagerank"](spark, str(tmp_path))) == []


def test_fuzzy_match_stores_no_list_of_pairs(spark, monkeypatch):
    """One day, one amount, references a digit or two apart: each of 150 * 150 pairs reaches the threshold, and no step stores more rows than there are."""
    import datetime as dt

    stored = []
    monkeypatch.setattr(graph, "_cut", lambda df: (stored.append(df.count()), df)[1])
    rest = [100.0, dt.date(2024, 1, 5)]
    left, right = (spark.createDataFrame([(k, f"{word} {1000 + k}", *rest) for k in range(150)], "k int, r string, a double, d date") for word in ("Inv", "inv."))
    assert rows(joins.fuzzy_match(left, right, "k", "r", "a", "d", rounds=1)) == sorted([(k, k, 100.0) for k in range(150)], key=str)
    assert stored and max(stored) <= 150


def test_layout_pages_whatever_the_order_of_repeated_lines(spark, tmp_path):
    """512 rows of one order and line: the page of the parts searched for does not depend on how the rows are stored."""
    from quernstone.plans import registry

    got = []
    for name, at in (("a", "id"), ("b", "511 - id"), ("c", "(id * 77) % 512")):
        spark.range(0, 512, 1, 1).selectExpr("1L AS l_orderkey", "1 AS l_linenumber", f"CASE WHEN ({at}) < 100 THEN 120L ELSE 1000L + ({at}) END AS l_partkey").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        got.append(tuple(registry.queries()["layout_pages"](spark, f"{tmp_path}/{name}").first()))
    assert got == [(2, 1, 1)] * 3


def _rows_made(plan) -> int:
    """The most rows that a node of an executed plan gave on."""
    kind, own = plan.getClass().getSimpleName(), plan.metrics().get("numOutputRows")
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return max([own.get().value() if own.isDefined() else 0, *map(_rows_made, below)])


def test_fuzzy_match_makes_no_rows_of_pairs(spark):
    """No row has an equal on the other side, each of 300 * 300 pairs reaches the threshold, and no step gives on more rows than both sides and their results have."""
    import datetime as dt

    rest = [100.0, dt.date(2024, 1, 5)]
    left, right = (spark.createDataFrame([(k, f"{word} {1000 + k}", *rest) for k in range(300)], "k int, r string, a double, d date") for word in ("invoice number", "invoice numbed"))
    got = joins.fuzzy_match(left, right, "k", "r", "a", "d", rounds=1)
    assert rows(got) == sorted([(k, k, round(100 - 50 / 19, 6)) for k in range(300)], key=str)
    assert 0 < _rows_made(got._jdf.queryExecution().executedPlan()) <= 2400


@pytest.mark.parametrize("crowd", [500_000, 5])
@pytest.mark.parametrize("case", ["near", "signs", "text only", "described"])
def test_fuzzy_match_like_a_search_over_all_pairs(spark, monkeypatch, case, crowd):
    """Copies, ties, long and empty texts, letters of all kinds, small and negative amounts, days around 1970; blocks of days cut by amount or not."""
    import datetime as dt
    import random

    monkeypatch.setattr(joins, "CROWD", crowd)
    rnd = random.Random(case)
    weights = {"text only": (1.0, 0.0, 0.0), "described": (0.4, 0.2, 0.2, 0.2)}.get(case, (0.5, 0.3, 0.2))
    threshold, days = {"signs": (55.0, 1), "near": (80.0, 2)}.get(case, (70.0, 2))

    def text():
        return rnd.choice(["", "x" * 70, "長" * 40, "inv ", "inv "]) + "".join(rnd.choice("01é長") for _ in range(rnd.randrange(4)))

    def one():
        amount = rnd.choice([-1, 1]) * round(rnd.uniform(0, 0.05), 3) if case == "signs" else rnd.choice([100.0, 99.99, round(rnd.uniform(1, 200), 2)])
        return rnd.randrange(40), text(), amount, dt.date(1969, 12, 28) + dt.timedelta(rnd.randrange(12)), rnd.choice(["", "p q", "q r", "p"])

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    def score(p, q):
        x, y = (" ".join(sorted(v[1].split())) for v in (p, q))
        gap, n = abs((p[3] - q[3]).days), max(len(x), len(y))
        told = set(p[4].split()), set(q[4].split())
        parts = [1 - lev(x, y) / n if n else 1, max(0, 1 - abs(p[2] - q[2]) / max(abs(p[2]), abs(q[2]), 0.01)), 1 - gap / (days + 1), len(told[0] & told[1]) / len(told[0] | told[1]) if told[0] | told[1] else 1]
        return round(sum(100 * w * v for w, v in zip(weights, parts)), 6) if gap <= days else 0

    left, right = [one() for _ in range(40)], [one() for _ in range(30)]
    right += [(k + 100, *rest) for k, *rest in left[:15]]
    pairs = [(score(p, q), p[0], q[0]) for p in left for q in right]
    ours, theirs = {}, {}
    for s, p, q in pairs:
        if s >= threshold:
            ours[p], theirs[q] = min(ours.get(p, (0, 0)), (-s, q)), min(theirs.get(q, (0, 0)), (-s, p))
    want = sorted([(p, q, -s) for p, (s, q) in ours.items() if theirs[q] == (s, p)], key=str)
    frames = [spark.createDataFrame(v, "k int, r string, a double, d date, t string") for v in (left, right)]
    got = joins.fuzzy_match(*frames, "k", "r", "a", "d", weights, threshold, days, "t" if case == "described" else None, rounds=1)
    assert want and rows(got) == want
