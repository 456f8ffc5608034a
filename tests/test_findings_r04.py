"""Steps that took disk with every round: lens graphs, and what is left behind on the way."""

import random

import pytest

from lakequill.operators import components as K
from lakequill.operators import lens as L


def _files(spark):
    sc = spark.sparkContext._jsc.sc()
    folder = sc.getCheckpointDir()
    if folder.isEmpty():
        return 0
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.get())
    return path.getFileSystem(sc.hadoopConfiguration()).getContentSummary(path).getLength()


def _adj(spark, copies, n=40, links=110):
    rng = random.Random(4)
    w = {}
    for c in range(copies):
        for _ in range(links):
            a, b = rng.sample(range(n), 2)
            w[f"{c}-{min(a, b)}", f"{c}-{max(a, b)}"] = float(rng.randint(1, 4))
    w["loop", "loop"] = 2.0
    rows = [(a, b, v) for (a, b), v in w.items()]
    return spark.createDataFrame(rows + [(b, a, v) for a, b, v in rows if a != b], "a string, b string, w double")


@pytest.mark.parametrize("held", [K.HELD, 3])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(K, "HELD", held)
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(900, 960)] + [(500, k) for k in range(600, 640)] + [(7, 7)]
    up = {x: x for e in links for x in e}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = [tuple(r) for r in K.components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == {x: find(x) for x in up if find(x) != x}


def test_r04_f1_f2_lenses_of_components(spark, monkeypatch):
    adj = _adj(spark, 3).localCheckpoint()
    centers = spark.createDataFrame([(c,) for c in ("0-3", "0-7", "1-3", "2-11", "loop", "alone", "0-3", None)], "center string")
    before = _files(spark)
    monkeypatch.setattr(L, "forward_push", None)  # a round of components of bounded size shuffles nothing
    nodes, edges = L.lens(adj, centers, most=9)
    want = {(r.center, r.node): (round(r.score, 12), r.depth) for r in nodes.collect()}, sorted(map(tuple, edges.collect()))
    assert {c for c, _ in want[0]} == {"0-3", "0-7", "1-3", "2-11", "loop", "alone"} and want[0]["alone", "alone"] == (1.0, 0)
    assert _files(spark) - before < 200_000
    monkeypatch.undo()
    chosen = L.shown(L.forward_push(adj, centers), 9)
    assert {(r.center, r.node): round(r.score, 12) for r in chosen.collect()} == {k: s for k, (s, _) in want[0].items()}
    assert sorted(map(tuple, L.induced(chosen, adj).collect())) == want[1]
    # in waves, in bins, and beyond what a task takes whole
    for put in ({"TOGETHER": 1, "UNDER_WAY": 1, "CENTERS": 1}, {"TOGETHER": 150}, {"TOGETHER": 1, "WHOLE": 50}):
        for k, v in put.items():
            monkeypatch.setattr(L, k, v)
        nodes, edges = L.lens(adj, centers, most=9)
        assert {(r.center, r.node): (round(r.score, 12), r.depth) for r in nodes.collect()} == want[0]
        assert sorted(map(tuple, edges.collect())) == want[1]
        monkeypatch.undo()


def test_r04_f1_f2_rounds_leave_nothing(spark):
    adj, centers = _adj(spark, 1).localCheckpoint(), spark.createDataFrame([("0-1",)], "center string")
    took = []
    for rounds in (1, 9):
        before = _files(spark)
        assert L.forward_push(adj, centers, rounds=rounds).count() > 1
        took.append(_files(spark) - before)
    assert took[1] < 2 * took[0]


@pytest.mark.parametrize("bounds", [{}, {"FEW_EDGES": 0}, {"HOPS": 1, "SENT_NODES": 0}])
def test_r04_f3_ranks_by_reach(spark, monkeypatch, bounds):
    from lakequill.operators import graph as G
    from lakequill.sources.tables import stored

    seen = []

    def cut(df):
        kept = stored(df)
        if "w" in df.columns:
            seen.extend(r.a for r in kept.collect())
        return kept

    for k, v in bounds.items():
        monkeypatch.setattr(G, k, v)
    adj = _adj(spark, 3).localCheckpoint()
    before = _files(spark)
    got = {r.node: r.r for r in G.pagerank_from(adj.unionByName(adj), "1-3", cut, rounds=12).collect()}  # rows of one edge add up
    assert _files(spark) - before < 20_000
    # no table of all edges is made on the way
    assert seen and all(a.startswith("1-") for a in seen)
    edges = {(r.a, r.b): r.w for r in adj.collect()}
    total = {}
    for (a, _), w in edges.items():
        total[a] = total.get(a, 0.0) + w
    rank = {"1-3": 1.0}
    for _ in range(12):
        new = {"1-3": 0.15}
        for (a, b), w in edges.items():
            if a in rank:
                new[b] = new.get(b, 0.0) + 0.85 * rank[a] * w / total[a]
        rank = new
    assert got.keys() == rank.keys() and all(abs(got[n] - r) < 1e-9 for n, r in rank.items())
    assert {r.node: r.r for r in G.pagerank_from(adj, "alone", cut).collect()} == {"alone": 1.0}


def test_r04_f4_second_hops_asked_for(spark, tmp_path):
    import duckdb

    from lakequill.plans import registry

    rng = random.Random(12)
    tables = {
        "part": ([(i, f"part {i % 7}" if i % 5 else f"{i}", None if i == 3 else f"b{i % 3}", i % 51) for i in range(60)], "p_partkey long, p_name string, p_brand string, p_size int"),
        "supplier": ([(i, f"of part {i} and {i % 3}") for i in range(6)], "s_suppkey long, s_name string"),
        "orders": ([(o, "1-URGENT" if o % 4 else "5-LOW") for o in range(150)], "o_orderkey long, o_orderpriority string"),
        # one supplier has a third of the lines, some parts stand beside none
        "lineitem": ([(o, n, rng.randrange(50), 0 if rng.random() < 0.33 else rng.randrange(7), rng.choice("RAN"), rng.choice("OF")) for o in range(150) for n in range(1, 1 + rng.randrange(1, 4))], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = registry.queries()["m5_role_typed_neighbours"](spark, str(tmp_path))
    assert "lineitem" not in got._jdf.queryExecution().executedPlan().toString()  # the roles are stored one after the other
    want = con.execute(f"SELECT seed, role, place, page, reason FROM ({registry.oracle_sql()['m5_role_typed_neighbours']})").fetchall()
    order = lambda rows: sorted(map(str, map(tuple, rows)))
    assert order(got.select("seed", "role", "place", "page", "reason").collect()) == order(want)
    assert len(want) > 240
