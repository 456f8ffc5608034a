"""Redirects, spanning trees, names and plans against plain loops."""

import random

from lakequill.operators import merges as M


def _end(node, to):
    seen = []
    while node not in seen:
        seen.append(node)
        if node not in to or to[node] == node:
            return node
        node = to[node]
    return min(seen[seen.index(node) :])


def test_roots(spark):
    rng = random.Random(5)
    to = {n: rng.randrange(120) for n in rng.sample(range(120), 100)}
    to |= {1000 + i: 1001 + i for i in range(70)}  # a long chain
    to |= {2000 + i: 2000 + (i + 1) % 9 for i in range(9)} | {2100: 2004}  # a circle of nine, and a way into it
    rows = [*to.items(), (None, 3), (4000, None)]
    got = {r.node: r.root for r in M.roots(spark.createDataFrame(rows, "node long, to long")).collect()}
    nodes = set(to) | set(to.values())
    assert got == {n: _end(n, to) for n in nodes}
    assert got[1000] == 1070 and got[2100] == 2000


def test_roots_of_nothing(spark):
    assert M.roots(spark.createDataFrame([], "node long, to long")).collect() == []


def test_maximum_spanning_tree(spark):
    rng = random.Random(6)
    edges = {}
    for _ in range(60):
        a, b = sorted(rng.sample(range(25), 2))
        edges[a, b] = rng.randint(1, 5)
    edges[100, 101] = 2
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    want = set()
    for (a, b), w in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.add((a, b, w))
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, w long")
    assert {tuple(r) for r in M.maximum_spanning_tree(df).collect()} == want
    assert M.maximum_spanning_tree(df.where("a = b")).collect() == []


def test_names_and_plan(spark):
    decisions = spark.createDataFrame([(2, 1), (3, 2), (4, 1)], "node long, to long")
    names = spark.createDataFrame([(1, 0, "Über Net"), (2, 0, "ber-net"), (2, 1, "U-Net"), (3, 0, "u net"), (3, 1, "??"), (4, 0, None)], "node long, place int, surface string")
    got = {(r.root, r.key, r.surface, r.node) for r in M.names_of(names, M.roots(decisions)).collect()}
    assert got == {(1, "bernet", "Über Net", 1), (1, "unet", "U-Net", 2)}
    pages = spark.createDataFrame([(1, True), (2, True), (3, False)], "node long, has_topics boolean")
    links = spark.createDataFrame([("x", 2), ("x", 2), ("y", 2), ("y", 3), (None, 3)], "src string, dst long")
    plan = {r.node: (r.kind, r.new_names, r.linkers) for r in M.plan(decisions, pages, names, links).collect()}
    assert plan == {2: ("recompile-keep", ["unet"], 2), 3: ("inbox-append", [], 1), 4: ("alias-only", [], 0)}
    new = {tuple(r) for r in M.rewritten(links.where("src is not null"), M.roots(decisions)).collect()}
    assert new == {("x", 1, 2), ("y", 1, 2)}
