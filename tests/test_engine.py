"""Operators on small inputs with results worked out by hand, and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.functions import paths, text, values, vectors
from thicket.functions.predicates import ElemMatch, Filter, condition
from thicket.operators import graph, knn, mutate
from thicket.operators.pipeline import Pipeline
from thicket.operators.query import Query, anchor, run
from thicket.plans.explain import report
from thicket.sources import documents
from thicket.sources.collections import Engine
from thicket.streaming import changes

ITEM = "items array<struct<sku:string,qty:bigint>>"


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(scope="module")
def orders(spark):
    rows = [("o1", "paid", [("A", 2), ("B", 3)]), ("o2", "paid", [("A", 4)]), ("o3", "open", [("B", 1)])]
    return spark.createDataFrame(rows, f"id string, status string, {ITEM}")


def test_unwind_group_and_global(spark, orders):
    e = Engine(spark).register("orders", orders)
    p = Pipeline("orders").unwind("items").group("items.sku", ("qty", "sum", "items.qty"), ("n", "count", None))
    assert [tuple(r) for r in e.pipeline(p).select("sku", "qty", "n").collect()] == [("A", 6, 2), ("B", 4, 2)]
    g = Pipeline("orders").unwind("items").group(None, ("n", "count", None), ("s", "sum", "items.qty"), ("a", "avg", "items.qty"), ("lo", "min", "items.qty"), ("hi", "max", "items.qty"))
    assert e.pipeline(g).first().asDict() == {"id": "$all", "n": 4, "s": 10, "a": 2.5, "lo": 1, "hi": 4}
    paid = Pipeline("orders").match_query(Query("orders").where_eq("status", "paid")).unwind("items")
    assert e.pipeline(paid).count() == 3
    assert e.pipeline(Pipeline("orders").unwind("status")).count() == 0
    for bad in (Pipeline("o").unwind("a.b"), Pipeline("o").project("a..b"), Pipeline("o").group("k", ("x", "count", None), ("x", "count", None)), Pipeline("o").group("k", ("x", "median", "v"))):
        with pytest.raises(ValueError):
            bad.validate()


def test_group_keys_and_saturating_sum(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([("a", 1, big), ("b", None, 5), ("c", 1, big), ("d", None, 7)], "id string, k bigint, v bigint")
    out = Engine(spark).register("c", df).pipeline(Pipeline("c").group("k", ("s", "sum", "v"), ("none", "avg", "no"), ("zero", "sum", "id")))
    assert [tuple(r) for r in out.collect()] == [("$all", None, 12, None, 0), ("1", 1, big, None, 0)]


def test_elem_match(spark, orders):
    got = orders.filter(condition(orders.schema, elem_matches=[ElemMatch("items", (Filter("sku", "eq", "A"), Filter("qty", "gt", 3)))]))
    assert ids(got) == ["o2"]
    rows = [("empty", []), ("none", None), ("match", [(None, 9), ("x", 1)]), ("other", [("y", 1)])]
    df = spark.createDataFrame(rows, f"id string, {ITEM}")
    assert ids(run(df, Query("o").elem_match("items", ("sku", "eq", "x")))) == ["match"]
    scalar = spark.createDataFrame([("s", [7, 9]), ("t", [8])], "id string, items array<bigint>")
    assert ids(run(scalar, Query("o").elem_match("items", ("", "eq", 7)))) == ["s"]
    assert run(scalar, Query("o").elem_match("id", ("", "eq", 7))).count() == 0
    with pytest.raises(ValueError):
        Query("o").elem_match("items")


def test_arrays(spark):
    df = spark.createDataFrame([("all", ["a", "a"]), ("mixed", ["a", "b"]), ("empty", []), ("none", None)], "id string, tags array<string>")
    assert ids(run(df, Query("d").where("tags", "array_all_eq", "a"))) == ["all"]
    assert ids(run(df, Query("d").where("tags", "array_contains", "b"))) == ["mixed"]
    assert ids(run(df, Query("d").where("tags", "array_contains_any", ["b", "z", 1]))) == ["mixed"]
    assert ids(run(df, Query("d").where("tags", "array_contains", 1))) == []
    numbers = spark.createDataFrame([("i", [1.0, -0.0]), ("z", [0.0])], "id string, v array<double>")
    assert ids(run(numbers, Query("d").where("v", "array_contains", 1))) == ["i"]
    assert ids(run(numbers, Query("d").where("v", "array_contains", 0.0))) == ["z"]
    longer = spark.createDataFrame([("a", [9]), ("b", [1, 1]), ("c", None)], "id string, v array<bigint>")
    assert ids(run(longer, Query("d").order_by("v"))) == ["c", "a", "b"]
    assert ids(run(longer, Query("d").where("v", "gt", [8, 8]))) == [] and ids(run(longer, Query("d").where("v", "gt", [100]))) == ["b"]


def test_dotted_paths(spark):
    profile = "profile struct<address:struct<city:string,zip:string>>"
    df = spark.createDataFrame([("a", (("Zeta", "1"),)), ("b", (("Alpha", "2"),)), ("c", (("Mid", "3"),)), ("d", None)], f"id string, {profile}")
    city = "profile.address.city"
    assert ids(run(df, Query("d").or_where(city, "eq", "Zeta").or_where(city, "eq", "Alpha").order_by("id"))) == ["a", "b"]
    assert ids(run(df, Query("d").order_by(city))) == ["d", "b", "c", "a"]
    assert ids(run(df, Query("d").order_by(city, False).limit(2))) == ["a", "c"]
    assert ids(run(df, Query("d").where(city, "ne", "Zeta").order_by("id"))) == ["b", "c"]
    assert run(df, Query("d").where("profile.nothing.here", "ne", 1)).count() == 0


def test_projection(spark):
    df = spark.createDataFrame([("u1", "ana", ("bandung", 40115), [("x", 1)])], "id string, name string, profile struct<city:string,zip:bigint>, tags array<struct<k:string,v:int>>")
    assert run(df, Query("u").select("profile.city", "name")).first().asDict(True) == {"id": "u1", "name": "ana", "profile": {"city": "bandung"}}
    assert run(df, Query("u").select("profile.city", "profile")).first().profile.zip == 40115
    assert run(df, Query("u").select("name.first")).first().name == "ana"
    assert run(df, Query("u").select("tags.v")).first().asDict(True)["tags"] == [{"v": 1}]
    assert run(df, Query("u").select("profile..city")).columns == ["id"]
    assert paths.parts_of("a..b") is None


def test_dynamic_null_is_not_absent(spark):
    raw = [("d1", '{"p":{"city":"Rome","zip":"00100"}}'), ("d2", '{"p":{"city":"Oslo","zip":"0150"}}'), ("d3", '{"p":{"city":null}}'), ("d4", '{"n":7,"t":true,"s":"12"}')]
    df = documents.from_json(spark.createDataFrame(raw, "id string, json string"))
    find = lambda *f: sorted(ids(documents.dynamic_filter(df, [f])))
    assert find("p.city", "eq", "Rome") == ["d1"] and find("p.zip", "gt", "00999") == ["d2"]
    assert find("p.city", "ne", "Rome") == ["d2", "d3"] and find("p.city", "eq", None) == ["d3"] and find("p.city", "eq", 42) == []
    assert find("s", "eq", 12) == find("n", "eq", "7") == find("t", "eq", "TRUE") == find("n", "gt", 6.5) == ["d4"]
    order = [r.id for r in df.orderBy(documents.order_key(F.col("doc"), "p.city").asc_nulls_first(), "id").collect()]
    assert order == ["d4", "d3", "d2", "d1"]


def test_aggregates(spark):
    rows = [(f"d{i:02d}", i, "even" if i % 2 == 0 else "odd") for i in range(50)] + [("x", None, "odd")]
    df = spark.createDataFrame(rows, "id string, n bigint, grp string")
    got = run(df, Query("c").where_eq("grp", "odd").aggregate("min", "n").aggregate("max", "n").aggregate("count").aggregate("avg", "n").limit(3)).first()
    assert got.asDict() == {"min_n": 1.0, "max_n": 49.0, "count": 26.0, "avg_n": 25.0}
    none = run(df, Query("c").where_eq("grp", "no").aggregate("min", "n").aggregate("sum", "n").aggregate("avg", "grp")).first()
    assert none.asDict() == {"min_n": None, "sum_n": 0.0, "avg_grp": 0.0}


@pytest.mark.parametrize("kind,stored", [("bigint", 7062007), ("string", "7062007"), ("double", 7062007.0)])
def test_crosstype_equality(spark, kind, stored):
    df = spark.createDataFrame([("s", stored)], f"id string, pin {kind}")
    for v in (7062007, "7062007", 7062007.0):
        for op in ("eq", "gte", "lte"):
            assert ids(run(df, Query("c").where("pin", op, v))) == ["s"], (op, v)
        assert ids(run(df, Query("c").where("pin", "in", [v]))) == ["s"] and ids(run(df, Query("c").where("pin", "not_in", [v]))) == []


WEIGHT = {bool: 1, int: 2, float: 2, str: 4}


def model(stored, op, value):
    """The comparison rules, in plain Python."""
    if stored is None:
        return False
    a, b = stored, value
    if isinstance(a, bool) and isinstance(b, str) or isinstance(a, str) and isinstance(b, bool):
        said = (b if isinstance(b, str) else a).strip().lower()
        if said not in ("true", "false"):
            return False
        a, b = (a if isinstance(a, bool) else said == "true"), (b if isinstance(b, bool) else said == "true")
    elif isinstance(a, str) and isinstance(b, (int, float)):
        number = values.parse_number(a)
        if number is None or (isinstance(b, int) and not isinstance(number, int)):
            a, b = 4, 2
        else:
            a = number
    elif isinstance(b, str) and isinstance(a, (int, float)):
        number = values.parse_number(b)
        a, b = (2, 4) if number is None else (a, number)
    elif b is None:
        a, b = 1, 0
    return {"eq": a == b, "ne": a != b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "boolean"])
def test_comparisons_against_model(spark, kind):
    stored = {"bigint": [0, 1, -5, 42, None], "double": [0.5, 1.0, -2.0, None], "string": ["1", "0.5", "abc", "true", " False ", "-5", "", None], "boolean": [True, False, None]}[kind]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(stored)], f"id string, v {kind}")
    asked = [(op, v) for op in values.COMPARISONS for v in (0, 1, 42, 0.5, -2.0, "1", "0.5", "abc", "true", "FALSE", True, False, None)]
    wide = df.select("id", *(condition(df.schema, [Filter("v", op, v)]).alias(f"c{i}") for i, (op, v) in enumerate(asked)))
    for r in wide.collect():
        for i, (op, v) in enumerate(asked):
            assert r[f"c{i}"] == model(stored[int(r.id)], op, v), (stored[int(r.id)], op, v)


def test_nan_and_markers(spark):
    df = spark.createDataFrame([("n", float("nan")), ("o", 1.0)], "id string, v double")
    for op in ("gt", "gte", "lt", "lte", "ne"):
        assert "n" not in ids(run(df, Query("c").where("v", op, 0.0)))
    assert ids(run(df, Query("c").where("v", "eq", float("nan")))) == ["n"]
    assert run(df, Query("c").where("v", "near", [1.0])).count() == run(df, Query("c").where("", "traverse", {})).count() == 0
    with pytest.raises(ValueError):
        Query("c").where_near("v", [1.0]).or_where("v", "eq", 1).marker("near")
    with pytest.raises(ValueError):
        Filter("v", "like", "x")


def test_text(spark):
    df = spark.createDataFrame([("1", "Indomie Goreng"), ("2", "Indomie Rendang"), ("3", "Mie Sedap Ayam"), ("4", None)], "id string, name string")
    count = lambda op, q: run(df, Query("f").where("name", op, q)).count()
    assert [count("match_prefix", q) for q in ("indom", "indomie goreng", "nope", "")] == [2, 1, 0, 3]
    assert [count("match", q) for q in ("indom", "INDOMIE", "ayam mie", "")] == [0, 2, 1, 3]
    assert count("contains", "mie G") == 1 and count("starts_with", "Mie") == 1
    tok = spark.createDataFrame([("Hé, l'été—a 42x!",)], "t string").select(text.terms(F.col("t")).alias("t")).first().t
    assert tok == ["hé", "été", "42x"]
    assert ids(text.search(df, "name", "?")) == [] and ids(text.search(df, "name", "goreng INDOMIE")) == ["1"]


def test_paging_equals_full_sort(spark):
    pick = random.Random(4)
    rows = [(f"d{i:05d}", None if i % 11 == 0 else i % 50, f"t{i % 37}") for i in range(600)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, age bigint, name string").repartition(4)
    low = lambda v: (v is not None, v or 0)
    for asc in (True, False):
        want = sorted(sorted(rows), key=lambda r: low(r[1]), reverse=not asc)
        if not asc:  # ties stay by id ascending
            want = sorted(rows, key=lambda r: r[0])
            want = sorted(want, key=lambda r: tuple(-x for x in low(r[1])))
        got = ids(run(df, Query("t").order_by("age", asc).offset(13).limit(40)))
        assert got == [r[0] for r in want[13:53]]
    seen, at = [], None
    while True:  # keyset walk
        q = Query("t").order_by("name").order_by("id").limit(90)
        page = run(df, q if at is None else q.start_after(*at)).collect()
        if not page:
            break
        seen += [r.id for r in page]
        at = (page[-1]["name"], page[-1].id)
    assert seen == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert anchor(df, "d00001", (("age", True),)) == (1,)
    with pytest.raises(KeyError):
        anchor(df, "d00011", (("age", True),))


def test_sorted_ids_and_missing_collections(spark):
    e = Engine(spark).register("c", spark.createDataFrame([(f"k{i}",) for i in (1, 3, 5, 7)], "id string"))
    assert ids(e.ids("c", "k3")) == ["k3", "k5", "k7"] and ids(e.ids("c", "k3", exclusive=True, limit=1)) == ["k5"]
    assert ids(e.ids("c", "k4", reverse=True)) == ["k3", "k1"] and ids(e.ids("c", offset=3)) == ["k7"]
    assert e.collection("none").count() == 0 and e.exists("c", "k5") and not e.exists("c", "k2")
    assert mutate.allowed([("a", True), ("a/private", False)], "a/private/x") is False and mutate.allowed([], "z")


@pytest.fixture(scope="module")
def points(spark):
    rows = [("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "x"), ("c", [1.0, 1.0], "y"), ("d", [10.0, 0.0], "y"), ("e", [1.0], "x"), ("f", None, "x"), ("g", [0.0, 0.0], "z")]
    return spark.createDataFrame(rows, "id string, emb array<float>, grp string")


@pytest.mark.parametrize("metric,order", [("cosine", "adcbg"), ("l2", "acgbd"), ("ip", "dacbg")])
def test_knn(spark, points, metric, order):
    got = knn.knn(points, "emb", [1.0, 0.0], 5, metric).collect()
    assert "".join(r.id for r in got) == order
    batch = knn.knn_batch(points.repartition(3), "emb", [[1.0, 0.0], [0.0, 0.0]], 5, metric).filter("query = 0").orderBy("rank").collect()
    assert "".join(r.id for r in batch) == order
    assert all(abs(a.score - b.score) < 1e-12 for a, b in zip(got, batch))


def test_knn_filters_cuts_and_binary(spark, points):
    only = (Filter("grp", "eq", "y"),)
    assert ids(knn.knn(points, "emb", [1.0, 0.0], 1, "l2", filters=only)) == ["c"]
    assert ids(knn.knn(points, "emb", [1.0, 0.0], 3, "l2", max_distance=1.0)) == ["a", "c", "g"]
    assert knn.knn(points, "grp_none", [1.0], 3).count() == 0
    e = Engine(spark).register("p", points)
    assert ids(e.query(Query("p").where_near("emb", [1.0, 0.0], "l2").where("grp", "ne", "x").limit(2).offset(1))) == ["g", "d"]
    import struct

    raw = [("r", struct.pack("<3f", 1.5, -2.25, 1e-40)), ("s", b"abc"), ("i", struct.pack("<3f", float("inf"), 0.0, 3e38))]
    got = {r.id: r.v for r in spark.createDataFrame(raw, "id string, b binary").select("id", vectors.decoded(F.col("b")).alias("v")).collect()}
    assert got["r"] == vectors.decode(raw[0][1]) and got["s"] is None and got["i"][0] == float("inf")


def test_hybrid(spark):
    rows = [("d1", "alpha beta gamma", [1.0, 0.0], "u"), ("d2", "alpha beta delta", [0.9, 0.1], "u"), ("d3", "alpha epsilon", [0.0, 1.0], "v")]
    df = spark.createDataFrame(rows, "id string, name string, emb array<float>, grp string")
    got = knn.hybrid(df, "name", "alpha beta", "emb", [1.0, 0.0], 3).collect()
    assert [r.id for r in got] == ["d1", "d2", "d3"] and got[0].score > got[1].score > got[2].score
    assert abs(got[0].score - 2 / 61) < 1e-12 and abs(got[2].score - 1 / 63) < 1e-12
    assert ids(knn.hybrid(df, "name", "alpha", "emb", [1.0, 0.0], 3, filters=(Filter("grp", "eq", "v"),))) == ["d3"]
    assert knn.hybrid(df, "name", "alpha", "emb", [1.0, 0.0], 0).count() == 0
    with pytest.raises(ValueError):
        knn.hybrid(df, "name", "alpha", "emb", [1.0, 0.0], 3, rrf_k=0)


def edges_of(spark, *pairs):
    rows = [(a, b, f"e{i}", float(w)) for i, (a, b, w) in enumerate(pairs)]
    return spark.createDataFrame(rows, "src string, dst string, edge string, weight double")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_walks(spark):
    e = edges_of(spark, ("n/a", "n/b", 1), ("n/b", "n/c", 1), ("n/a", "n/c", 10))
    assert [(r.node, r.depth, r.path, r.via) for r in graph.bfs(e, "n/a", "out", 2, include_path=True).collect()] == [("n/b", 1, ["n/a", "n/b"], ["e0"]), ("n/c", 1, ["n/a", "n/c"], ["e2"])]
    assert [(r.node, r.cost, r.depth) for r in graph.dijkstra(e, "n/a").collect()] == [("n/b", 1.0, 1), ("n/c", 2.0, 2)]
    assert [(r.node, r.cost) for r in graph.simple_paths(e, "n/a", "out", 5).collect()] == [("n/a", 0.0), ("n/b", 1.0), ("n/c", 2.0), ("n/c", 10.0)]
    ring = edges_of(spark, ("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("u", "a", 1))
    assert [r.node for r in graph.bfs(ring, "a", "out", 9).collect()] == ["b", "c"]
    assert {r.node for r in graph.bfs(ring, "a", "in", 1).collect()} == {"c", "u"}
    assert graph.bfs(ring, "nowhere", "both", 3).count() == 0 and graph.bfs(ring, "a", "out", 9, limit=1).count() == 1
    chain = edges_of(spark, ("a", "b", 1), ("b", "c", 1), ("c", "d", 1))
    assert [r.node for r in graph.bfs(chain, "a", "out", 5, nodes=nodes_of(spark, "bc")).collect()] == ["b", "c"]
    for bad in (0, 257):
        with pytest.raises(ValueError):
            graph.bfs(chain, "a", "out", bad)


def test_edge_tables(spark):
    docs = spark.createDataFrame([("1", "a", "b", 2.0, "follows", True), ("2", "b", "c", float("nan"), "follows", True), ("3", "c", "d", -4.0, "likes", False), ("4", "d", "e", None, "follows", False)], "id string, _from string, _to string, w double, kind string, ok boolean")
    assert [r.weight for r in graph.edge_collection(docs, "w").orderBy("edge").collect()] == [2.0, 1.0, 0.0, 1.0]
    assert [r.edge for r in graph.edge_collection(docs, "w", "kind", {"ok": True}, "follows").orderBy("edge").collect()] == ["1", "2"]
    refs = spark.createDataFrame([("1", "x"), ("2", None)], "id string, link string")
    assert [(r.src, r.dst, r.weight) for r in graph.reference_edges(refs, "c", link="t").collect()] == [("c/1", "t/x", 1.0)]


def test_whole_graph(spark):
    pairs = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")]
    e, n = edges_of(spark, *((a, b, 1) for a, b in pairs)), nodes_of(spark, "abcde")
    for f in (graph.communities, graph.components):
        assert sorted(tuple(r) for r in f(e, n).collect()) == [("a", "a"), ("a", "b"), ("c", "c"), ("c", "d"), ("e", "e")]
    assert [tuple(r) for r in graph.degrees(e, n).collect()] == [("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("d", 1, 1), ("e", 0, 0)]
    star = edges_of(spark, *(("h", f"s{i}", 1) for i in range(3)))
    nodes = nodes_of(spark, ["h", "s0", "s1", "s2"])
    top = graph.pagerank(star, nodes, 0.85, ["h"], 2).collect()
    assert top[0].node == "h" and abs(top[0].score - 0.15) < 1e-12 and abs(top[1].score - 0.15 * 0.85 / 3) < 1e-12
    assert graph.pagerank(star, nodes).agg(F.sum("score")).first()[0] < 1 and graph.pagerank(star, nodes, seeds=["no"]).agg(F.sum("score")).first()[0] == 0
    with pytest.raises(ValueError):
        graph.pagerank(star, nodes, 1.5)
    dag = edges_of(spark, ("c", "a", 1), ("c", "b", 1), ("a", "d", 1), ("b", "d", 1))
    assert [r.node for r in graph.topological_order(dag, nodes_of(spark, "abcde")).orderBy("pos").collect()] == ["c", "a", "b", "d", "e"]
    assert {(r.node, r.level) for r in graph.peel(dag, nodes_of(spark, "abcde"))[0].collect()} == {("c", 0), ("e", 0), ("a", 1), ("b", 1), ("d", 2)}
    assert graph.find_cycle(dag, nodes_of(spark, "abcde")).count() == 0
    ring = edges_of(spark, ("x", "a", 1), ("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "y", 1))
    cycle = [r.node for r in graph.find_cycle(ring, nodes_of(spark, "abcxy")).orderBy("pos").collect()]
    assert sorted(cycle) == ["a", "b", "c"]
    assert graph.topological_order(ring, nodes_of(spark, "abcxy")).count() == 0
    loop = edges_of(spark, ("a", "a", 1))
    assert graph.topological_order(loop, nodes_of(spark, "a")).count() == 0 and [r.node for r in graph.find_cycle(loop, nodes_of(spark, "a")).collect()] == ["a"]


def test_components_on_a_long_chain(spark):
    names = [f"n{i:03d}" for i in range(200)]
    pick = random.Random(8)
    pairs = list(zip(names, names[1:]))[:150] + list(zip(names[151:], names[152:]))
    pick.shuffle(pairs)
    got = graph.components(edges_of(spark, *((a, b, 1) for a, b in pairs)), nodes_of(spark, names)).collect()
    assert {r.component for r in got if r.node <= "n150"} == {"n000"} and {r.component for r in got if r.node > "n150"} == {"n151"}


def test_batches(spark):
    df = spark.createDataFrame([("a", 1, "x", 0), ("b", 2, "y", 0), ("c", 3, "z", 0), ("d", 4, "w", 0)], "id string, v bigint, s string, _time bigint")
    ops = [(1, "put", "a", 10, None), (2, "patch", "a", None, "p"), (3, "delete", "b", None, None), (4, "patch", "b", 7, None), (5, "patch", "c", 30, None), (6, "soft_delete", "c", None, None), (7, "patch", "e", 5, None), (8, "put", "f", 1, "q"), (9, "put", "f", 2, None)]
    out = mutate.apply_batch(df, spark.createDataFrame(ops, "seq bigint, op string, id string, v bigint, s string"), 9)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 10, "p", 9), ("b", 7, None, 9), ("d", 4, "w", 0), ("e", 5, None, 9), ("f", 2, None, 9)]
    made = mutate.with_ids(spark.createDataFrame([("", 1), (None, 2), ("k", 3)], "id string, v int"), 1_700_000_000_000_000_000).collect()
    assert len({r.id for r in made}) == 3 and all(len(r.id) == 20 for r in made if r.id != "k")
    patched = mutate.patch_where(df, Query("c").where("v", "gt", 2), {"v": 0, "new": "n"})
    assert sorted((r.id, r.v, r["new"]) for r in patched.collect()) == [("a", 1, None), ("b", 2, None), ("c", 0, "n"), ("d", 0, "n")]


def test_unique_and_schema(spark):
    df = spark.createDataFrame([("1", "ios", "eu"), ("2", "ios", "ca"), ("3", "android", "eu"), ("4", None, "x"), ("5", None, "x")], "id string, platform string, region string")
    assert {(r.platform, r.n) for r in mutate.unique_violations(df, ["platform"]).collect()} == {("ios", 2), (None, 2)}
    assert mutate.unique_violations(df, ["platform"], sparse=True).count() == 1
    assert mutate.unique_violations(df, ["platform"], where=F.col("region") == "eu").count() == 0
    rules = [{"name": "status", "kind": "string", "required": True}, {"name": "qty", "kind": "int", "default": 1}, {"name": "note"}]
    orders = spark.createDataFrame([("a", "paid", None), ("b", None, 5)], "id string, status string, qty bigint")
    assert [r.qty for r in mutate.apply_schema(orders, rules).orderBy("id").collect()] == [1, 5]
    assert [tuple(r) for r in mutate.schema_violations(orders, rules).collect()] == [("b", "status", "missing")]
    assert mutate.schema_violations(orders, [{"name": "qty", "kind": "string"}]).count() == 1
    for bad in ([{"name": "a"}, {"name": "a"}], [{"name": "a", "kind": "int", "default": "x"}], [{"name": "a.b"}]):
        with pytest.raises(ValueError):
            mutate.check_rules(bad)


def test_soft_delete(spark):
    df = spark.createDataFrame([("1", 5), ("2", 6)], "id string, a bigint")
    left, records = mutate.soft_delete(df, "t", Query("t").where("id", "eq", "1"), 1000, 50)
    records = spark.createDataFrame(records.collect(), records.schema)
    live = lambda d: d.select(F.concat(F.lit("t/"), "id").alias("key"))
    assert ids(left) == ["2"] and [r.key for r in mutate.restore_available(records, live(left), "t", 1049).collect()] == ["t/1"]
    assert mutate.restore_available(records, live(left), "u").count() == 0 and mutate.restore_available(records, live(left), None, 1050).count() == 0
    back = mutate.restore(left, records, "t", "1")
    assert sorted((r.id, r.a) for r in back.collect()) == [("1", 5), ("2", 6)]
    assert mutate.restore_available(records, live(back)).count() == 0  # put again: its owner is the new row
    assert mutate.delete_queue(records, 1010).first().left_us == 40 and mutate.sweep(records, 1050).count() == 0


def test_last_write_wins(spark):
    columns = "id string, _time bigint, v string, deleted boolean"
    local = spark.createDataFrame([("a", 5, "l", False), ("b", 5, "l", False), ("c", 5, "l", False)], columns)
    remote = spark.createDataFrame([("a", 4, "r", False), ("b", 5, "r", False), ("c", 6, "r", True), ("d", 1, "r", False)], columns)
    got = {r.id: (r.v, r.deleted) for r in mutate.lww_merge(local, remote).collect()}
    assert got == {"a": ("l", False), "b": ("l", False), "c": ("r", True), "d": ("r", False)}


def test_stream(spark, tmp_path):
    schema = T.StructType.fromDDL("id string, _time bigint, v string, deleted boolean")
    log = str(tmp_path / "log")
    for part in ([("a", 1, "x", False), ("b", 1, "x", False)], [("a", 2, "y", False), ("b", 3, "", True)], [("a", 2, "late tie", False), ("c", 1, "z", False)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(log)
        changes.ingest(changes.op_log(spark, log, schema, 1), str(tmp_path / "v"), str(tmp_path / "c")).awaitTermination()
    live = changes.state(spark, str(tmp_path / "v"), schema)
    assert sorted((r.id, r.v) for r in live.collect()) == [("a", "y"), ("c", "z")]
    changes.compact(spark, str(tmp_path / "v"), schema, str(tmp_path / "w"))
    assert changes.state(spark, str(tmp_path / "w"), schema).count() == 2
    batch = spark.read.schema(schema).parquet(log)
    assert sorted(tuple(r) for r in changes.watch_query(batch, Query("x").where_eq("v", "z")).collect()) == [("b", "delete"), ("c", "put")]


def test_json_and_backup(spark, tmp_path):
    df = spark.createDataFrame([("1", 5, float("nan"), b"\x01\xff", ("c", "9"), [1.0, float("inf")])], "id string, _time bigint, x double, b binary, r struct<collection:string,doc_id:string>, a array<double>")
    assert documents.to_json(df).first().json == '{"_time":5,"a":[1.0,null],"b":[1,255],"r":{"__ref__":"c/9"}}'
    documents.backup(df, str(tmp_path / "b"))
    assert documents.restore_backup(spark, str(tmp_path / "b")).count() == 1
    typed = documents.from_json(spark.createDataFrame([("1", '{"a":{"b":2}}')], "id string, json string"), "a struct<b:int>")
    assert typed.first().a.b == 2


def test_catalog(spark, tmp_path):
    from thicket.sources.admin import Catalog, conflicts, walk

    rows = [(f"k{i}", i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, _time bigint, v bigint")
    c = Catalog(Engine(spark).register("a", df).register("private/x", df).register("b", df.limit(0)), [("private", False)])
    assert c.query(Query("a").where("v", "lt", 3)).count() == 3
    with pytest.raises(PermissionError):
        c.query(Query("private/x"))
    assert [(r.action, r.collection, r.allowed) for r in c.audit_log().collect()] == [("query", "a", True), ("query", "private/x", False)]
    left, moved = c.relocate("a", "b", Query("a").where("v", "gte", 15))
    assert left.count() == 15 and moved.count() == 5
    assert c.compact("a", str(tmp_path / "a")).count() == 20 and c.list_collections("priv*") == ["private/x"]
    assert c.load("a") == ["a"] and c.query(Query("a")).count() == 20
    c.unload("a")
    c.rename("a", "z")
    assert c.drop("z") and not c.drop("z") and c.engine.collection("z").count() == 0
    with pytest.raises(PermissionError):
        Catalog(c.engine, read_only=True).drop("b")
    seen = []
    assert walk(df.orderBy("v"), lambda r: seen.append(r.v) or len(seen) < 4) == 4 and seen == [0, 1, 2, 3]
    read = spark.createDataFrame([("k1", 1), ("k2", 7), ("new", None), ("k3", None)], "id string, _time bigint")
    assert sorted(ids(conflicts(df, read))) == ["k2", "k3"]
    with c.cancellable("g"):
        assert df.count() == 20
    c.cancel("g")


def test_indexes(spark):
    from thicket.operators.indexes import Index, Indexes, approximate_knn, quantised, recall, side_table, violations

    known = Indexes()
    unique = Index("composite", "c", (("a", "asc"), ("b", "desc")), unique=True)
    assert known.ensure(unique, unique, Index("fts", "c", (("t", "asc"),))) == 2
    with pytest.raises(ValueError):
        known.create(Index("composite", "c", (("a", "asc"), ("b", "asc"))))
    assert [i.kind for i in known.list("c")] == ["composite", "fts"] and known.drop("fts", "c", "t") and not known.drop("fts", "c", "t")
    df = spark.createDataFrame([("1", 1, 2, "x y", "on"), ("2", 1, 2, "aa bb aa", "off"), ("3", None, 2, None, "on"), ("4", None, 2, "aa", "on")], "id string, a int, b int, t string, s string")
    assert violations(df, unique).count() == 2
    assert violations(df, Index("composite", "c", (("a", "asc"), ("b", "asc")), True, True)).count() == 1
    assert violations(df, Index("composite", "c", (("a", "asc"), ("b", "asc")), True, True, (Filter("s", "eq", "on"),))).count() == 0
    posts = side_table(df, Index("fts", "c", (("t", "asc"),)))
    assert {(r.term, r.id, r.tf) for r in posts.collect()} == {("aa", "2", 2), ("bb", "2", 1), ("aa", "4", 1)}
    assert ids(text.search_postings(posts, "aa")) and side_table(df, unique).count() == 4
    pick = random.Random(3)
    centres = [[pick.gauss(0, 1) for _ in range(40)] for _ in range(8)]
    rows = [(f"v{i:03d}", [x + pick.gauss(0, 0.3) for x in centres[i % 8]]) for i in range(400)]
    vec = spark.createDataFrame(rows, "id string, e array<double>")
    index = quantised(vec, "e")
    row = index.filter("id = 'v000'").first()
    assert max(abs(row.scale * q - x) for q, x in zip(row.q, rows[0][1])) <= row.scale / 2 + 1e-9
    exact = knn.knn(vec, "e", rows[0][1], 10)
    assert recall(exact, approximate_knn(vec, index, "e", rows[0][1], 10), 10) >= 0.9


def test_approximate_knn_finds_all_neighbours(spark):
    from thicket.operators.indexes import approximate_knn, quantised, recall

    pick = random.Random(4)
    rows = [(f"v{i:04d}", [pick.gauss(0, 1) for _ in range(40)]) for i in range(3000)]
    vec = spark.createDataFrame(rows, "id string, e array<double>").cache()
    query = [pick.gauss(0, 1) for _ in range(40)]
    for metric in ("cosine", "l2", "ip"):
        exact = knn.knn(vec, "e", query, 10, metric)
        assert recall(exact, approximate_knn(vec, quantised(vec, "e"), "e", query, 10, metric), 10) == 1.0


def test_plans(spark, sf_dir):
    from thicket.sources.collections import over_tables

    e = over_tables(spark, sf_dir)
    point = report(e.get("orders", "100").select("o_totalprice"))
    assert any("EqualTo(o_orderkey,100)" in p for p in point["pushed"]) and point["exchanges"] == 0
    narrow = report(e.query(Query("orders").where_eq("o_orderstatus", "F").select("o_custkey")))
    assert "o_orderpriority" not in narrow["columns"][0] and any("EqualTo(o_orderstatus,F)" in p for p in narrow["pushed"])
    top = report(e.query(Query("orders").order_by("o_totalprice").limit(5)))
    assert "TakeOrderedAndProject" in top["text"] and top["exchanges"] == 0
    assert report(knn.knn(e.collection("embeddings"), "embedding", [0.1] * 64, 3))["python"] == 0


def test_walks_in_the_order_of_discovery(spark):
    edges = spark.createDataFrame([("S", "P"), ("S", "Q"), ("P", "z"), ("Q", "a"), ("z", "gone"), ("gone", "y")], "src string, dst string")
    there = spark.createDataFrame([(n,) for n in "SPQzay"], "node string")
    assert [r.node for r in graph.bfs(edges, "S", "out", 3, 3).collect()] == ["P", "Q", "z"]
    full = graph.bfs(edges, "S", "out", 4, None, include_path=True, existing=there).collect()
    assert [(r.node, r.depth) for r in full] == [("P", 1), ("Q", 1), ("z", 2), ("a", 2), ("y", 4)]
    assert full[-1].path == ["S", "P", "z", "gone", "y"]
    assert graph.bfs(edges, "nobody", "out", 3, existing=there).count() == 0
    assert graph.bfs(edges, "gone", "out", 3, existing=there).count() == 0
    assert graph.dijkstra(edges, "gone", "out", 3, existing=there).count() == 0


def test_weighted_walks_under_a_depth_cap(spark):
    rows = [("A", "X", "ax", 10.0), ("A", "b", "ab", 1.0), ("b", "c", "bc", 1.0), ("c", "X", "cx", 1.0), ("X", "t", "xt", 1.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, edge string, weight double")
    capped = graph.dijkstra(edges, "A", "out", 2, include_path=True).collect()
    assert [(r.node, r.cost, r.depth) for r in capped] == [("b", 1.0, 1), ("c", 2.0, 2), ("X", 10.0, 1), ("t", 11.0, 2)]
    free = {r.node: r for r in graph.dijkstra(edges, "A", include_path=True).collect()}
    assert (free["X"].cost, free["X"].path, free["X"].via) == (3.0, ["A", "b", "c", "X"], ["ab", "bc", "cx"])
    assert [r.via for r in graph.simple_paths(edges, "A", "out", 1).collect()] == [[], ["ab"], ["ax"]]

    import heapq
    import random

    pick = random.Random(3)
    some = [(f"n{pick.randrange(25)}", f"n{pick.randrange(25)}", f"e{i}", float(pick.randrange(1, 9))) for i in range(70)]
    hops = {}
    for a, b, _, w in some:
        if a != b:
            hops[(a, b)] = min(w, hops.get((a, b), w))
    for cap in (1, 2, 3, 5):
        cost, heap, want = {"n0": 0.0}, [(0.0, "n0", 0)], {}
        while heap:
            c, at, depth = heapq.heappop(heap)
            if at in want or c > cost[at]:
                continue
            want[at] = (c, depth)
            if depth < cap:
                for (a, b), w in hops.items():
                    if a == at and b not in want and c + w < cost.get(b, 1e9):
                        cost[b] = c + w
                        heapq.heappush(heap, (c + w, b, depth + 1))
        got = {r.node: (r.cost, r.depth) for r in graph.dijkstra(spark.createDataFrame(some, "src string, dst string, edge string, weight double"), "n0", "out", cap).collect()}
        assert got == {k: v for k, v in want.items() if k != "n0"}


def test_engine_terminals_and_walking_queries(spark):
    engine = Engine(spark).register("p", spark.createDataFrame([(str(i), 0, i, i % 3) for i in range(9)], "id string, _time long, n long, g int"))
    q = Query("p").where("g", "eq", 1)
    assert (engine.count(q), engine.sum(q, "n"), engine.avg(q, "n"), engine.min(q, "n"), engine.max(q, "n")) == (3, 12.0, 4.0, 1.0, 7.0)
    assert engine.first(q.order_by("n", False)).n == 7 and engine.first(Query("p").where("n", "gt", 99)) is None
    assert engine.delete(q).count() == 6 and engine.patch(q, {"n": 0}).filter("n = 0").count() == 4
    walk = Query("p").where_traverse("p", "1", "out", 2)
    with pytest.raises(ValueError, match="edge table"):
        engine.query(walk)
    engine.link(spark.createDataFrame([("p/1", "p/2"), ("p/2", "p/5"), ("p/2", "p/77"), ("p/5", "p/8")], "src string, dst string"))
    assert [r.id for r in engine.query(walk).collect()] == ["2", "5"]
    assert engine.count(walk) == 2 and engine.query(Query("p").where_traverse("p", "77", "in", 2)).count() == 0


def brute_communities(pairs, nodes, rounds=32):
    near = {n: set() for n in nodes}
    for a, b in pairs:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    label = {n: n for n in nodes}
    for _ in range(rounds):
        was = dict(label)
        for n in sorted(nodes):
            votes = [label[m] for m in near[n]]
            if votes:
                label[n] = min(set(votes), key=lambda x: (-votes.count(x), x))
        if was == label:
            break
    least = {}
    for n in sorted(nodes):
        least.setdefault(label[n], n)
    return [(least[label[n]], n) for n in sorted(nodes)]


@pytest.mark.parametrize("block, held, passes", [(1 << 20, 1 << 20, 16), (40, 0, 16), (40, 1 << 20, 2)])
def test_communities_in_blocks(spark, monkeypatch, block, held, passes):
    """Whatever the blocks, read again or held, in passes or node by node: as one node after the other."""
    for name, value in (("BLOCK", block), ("HELD", held), ("PASSES", passes)):
        monkeypatch.setattr(graph, name, value)
    pick = random.Random(block + passes)
    names = [f"n{i}" for i in range(70)] + ["é", "z🙂"]
    pairs = [(pick.choice(names), pick.choice(names)) for _ in range(130)] + list(zip(names[:40], names[1:41])) + [("n1", "gone"), ("n3", "n3")]
    pairs += [("n5", n) for n in names[:60]]
    got = graph.communities(edges_of(spark, *((a, b, 1) for a, b in pairs)), nodes_of(spark, names)).collect()
    assert [tuple(r) for r in got] == brute_communities(pairs, names)
    assert graph.communities(edges_of(spark, ("a", "b", 1)), nodes_of(spark, "xy")).count() == 2


def test_a_block_in_passes_and_one_by_one(monkeypatch):
    import numpy as np

    pick = np.random.default_rng(5)
    for kind in range(6):
        n = 60
        near = np.triu(pick.random((n, n)) < (0.05, 0.2, 0.6, 1.0, 0.05, 0.0)[kind], 1)
        near |= np.eye(n, k=1, dtype=bool) if kind > 3 else False
        near |= near.T
        a = np.flatnonzero(near.any(axis=1))
        b = np.concatenate([np.flatnonzero(near[i]) for i in a]).astype("<i4")
        for passes in (1, 3, 100):
            monkeypatch.setattr(graph, "PASSES", passes)
            label, want = np.arange(n), np.arange(n)
            for _ in range(4):
                was = want.copy()
                for i in a:
                    kinds, counts = np.unique(want[near[i]], return_counts=True)
                    want[i] = kinds[np.argmax(counts)]
                assert graph._propagate(a, near[a].sum(axis=1), b, label) == bool((was != want).any())
                assert label.tolist() == want.tolist()


def test_ordered_results_have_no_bound_of_edges(spark):
    """More edges than the two million at which there was an error: 2,100 nodes, each with an edge to all that follow, and one back."""
    n = 2100
    name = lambda c: F.format_string("n%04d", c)
    nodes = spark.range(n).select(name("id").alias("node"))
    down = nodes.select(F.col("node").alias("src")).join(nodes.select(F.col("node").alias("dst")), F.col("src") < F.col("dst"))
    assert down.count() > 2_000_000
    assert [r.node for r in graph.topological_order(down, nodes).collect()] == [f"n{i:04d}" for i in range(n)]
    ring = down.union(spark.createDataFrame([("n2099", "n0000")], "src string, dst string"))
    assert [r.node for r in graph.find_cycle(ring, nodes).collect()] == [f"n{i:04d}" for i in range(n)]
    assert graph.topological_order(ring, nodes).count() == 0
    assert {r.community for r in graph.communities(down, nodes).collect()} == {"n0000"}
    with pytest.raises(ValueError, match="at most 10 "):
        graph.communities(down, nodes, most=10)


@pytest.mark.parametrize("vector, rounds", [(1 << 22, 30), (0, 3)])
def test_pagerank_sent_and_joined(spark, monkeypatch, vector, rounds):
    monkeypatch.setattr(graph, "VECTOR_NODES", vector)
    monkeypatch.setattr(graph, "BLOCK", 30)
    pick = random.Random(4)
    names = [f"n{i}" for i in range(40)]
    pairs = {(pick.choice(names), pick.choice(names[:30])) for _ in range(150)} | {(n, "n0") for n in names[:35]} | {("n1", "gone")}
    for seeds in (None, ["n3", "n4", "no"]):
        known = [(a, b) for a, b in pairs if b != "gone"]
        start = {n: 1 / 40 if not seeds else (n in seeds) / 2 for n in names}
        score = dict(start)
        for _ in range(rounds):
            score = {n: 0.15 * start[n] + 0.85 * sum(score[a] / sum(c == a for c, _ in known) for a, b in known if b == n) for n in names}
        got = {r.node: r.score for r in graph.pagerank(edges_of(spark, *((a, b, 1) for a, b in pairs)), nodes_of(spark, names), seeds=seeds, rounds=rounds).collect()}
        assert got.keys() == score.keys() and all(abs(got[n] - score[n]) < 1e-12 for n in names)
    assert graph.pagerank(edges_of(spark, ("a", "b", 1)), nodes_of(spark, "")).count() == 0


def test_cheapest_routes_of_so_many_hops(spark):
    """A cheap route of 30 hops beside a dear one of 25: 24 rounds reach neither's end, 25 the dear one, 30 the cheap one."""
    cheap = [(f"a{i:02d}", f"a{i + 1:02d}", 1) for i in range(30)]
    dear = [("a00", "b01", 9), *((f"b{i:02d}", f"b{i + 1:02d}", 9) for i in range(1, 24)), ("b24", "a30", 9)]
    edges = edges_of(spark, *cheap, *dear)
    cost = lambda rounds: {r.node: r.cost for r in graph.dijkstra(edges, "a00", rounds=rounds).collect()}
    assert "a30" not in cost(24) and cost(25)["a30"] == 225.0 and cost(30)["a30"] == cost(None)["a30"] == 30.0
    assert cost(24)["a24"] == 24.0 and "a25" not in cost(24)


def test_cheapest_query_where_cheap_routes_are_long(spark, tmp_path):
    """Orders and parts in a chain of 60 hops: the query's costs are those of its SQL, on rows where more rounds find more."""
    import duckdb

    from thicket.plans import queries as engine

    rows = [(k // 2 + 1, (k + 1) // 2, 1.0) for k in range(60)] + [(1, 14, 900.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(c.sql(engine.oracle_sql()["graph_dijkstra"]).fetchall())
    bought = dict((n, run) for n, run, _ in engine.ENTRIES)["graph_dijkstra"]
    from thicket.sources.collections import Engine

    assert sorted(tuple(r) for r in bought(Engine(spark), str(tmp_path)).collect()) == want
    assert any(cost > 800 for _, cost in want)
