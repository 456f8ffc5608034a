"""Related pages by role against plain loops."""

import math
import random

from lakequill.operators import related as R


def test_neighbourhood(spark):
    rng = random.Random(3)
    nodes = [f"n{i:02d}" for i in range(25)]
    und = {}
    while len(und) < 45:
        a, b = sorted(rng.sample(nodes, 2))
        und[a, b] = (float(rng.randint(1, 3)), sorted(rng.sample(range(9), rng.randint(1, 3))))
    adj = {}
    for (a, b), (w, s) in und.items():
        adj.setdefault(a, {})[b] = (w, s)
        adj.setdefault(b, {})[a] = (w, s)
    damp = lambda n: math.log2(2 + len(adj[n]))
    want = {}
    for seed, near in adj.items():
        for n, (w, s) in near.items():
            want[seed, n] = (1, round(w / damp(n), 9), seed, tuple(s))
        far = {}
        for mid, (w1, s1) in near.items():
            for dst, (w2, s2) in adj[mid].items():
                if dst != seed and dst not in near:
                    far.setdefault(dst, []).append((-w1 * w2 * 0.5, mid, tuple(dict.fromkeys(s1 + s2))))
        for dst, ways in far.items():
            strength, mid, via = min(ways)
            want[seed, dst] = (2, round(-strength / damp(dst), 9), mid, via)
    rows = [(a, b, w, s) for a, near in adj.items() for b, (w, s) in near.items()]
    got = R.neighbourhood(spark.createDataFrame(rows, "a string, b string, w double, sources array<long>")).collect()
    assert {(r.seed, r.page): (r.dist, round(r.score, 9), r.pred, tuple(r.via)) for r in got} == want


def _assign(populations, label, fixed, called):
    """One seed after the other, role after role."""
    out, reserved, contra = [], set(), set()
    why = {"contradiction": "no-opponent" if called else "no-callout", "evidence": "no-source", "definition": "no-concept-neighbor", "cluster": fixed or "no-nearby-cluster-peer"}
    for role in R.ROLES:
        left = [] if role == "cluster" and fixed else [p for p in populations.get(role, []) if p[0] not in reserved or role == "evidence" and p[0] in contra]
        if role == "cluster" and len(left) >= 2 and label and {p[2] for p in left[:2]} == set(label) and all(p[1] == 2 for p in left[:2]):
            left = left[2:]
        for k, p in enumerate(left[:2]):
            out.append((role, k + 1, p[0], None))
            reserved.add(p[0])
            if role == "contradiction":
                contra.add(p[0])
        if not left:
            out.append((role, 0, None, why[role]))
    return out


def test_assignment(spark):
    rng = random.Random(8)
    pages = [(f"p{i}", 1 + i % 2, f"t{i % 5}") for i in range(12)]
    seeds, rows, want = [], [], set()
    for n in range(150):
        seed, label = f"s{n:03d}", rng.choice([[], ["t1", "t3"], ["t1"], ["t0", "t2"]])
        fixed, called = rng.choice([None, None, None, "seed"]), rng.random() < 0.5
        seeds.append((seed, label, fixed, called))
        of = {}
        for role in R.ROLES:
            of[role] = rng.sample(pages, rng.choice([0, 1, 2, 3, 9]))
            rows += [(seed, role, k + 1, *p) for k, p in enumerate(of[role])]
        want |= {(seed, *r) for r in _assign(of, label, fixed, called)}
    seeds.append(("alone", [], None, False))
    want |= {("alone", *r) for r in _assign({}, [], None, False)}
    got = R.assign(spark.createDataFrame(seeds, "seed string, label array<string>, fixed string, called boolean"), spark.createDataFrame(rows, "seed string, role string, rank int, page string, dist int, title string"))
    assert {tuple(r) for r in got.collect()} == want


def test_label_of_the_cluster_is_suppressed(spark):
    seeds = spark.createDataFrame([("a", ["t1", "t2"], None, False), ("b", ["t1", "t2"], None, False)], "seed string, label array<string>, fixed string, called boolean")
    rows = [("a", "cluster", 1, "x", 2, "t1"), ("a", "cluster", 2, "y", 2, "t2"), ("b", "cluster", 1, "x", 2, "t2"), ("b", "cluster", 2, "y", 2, "t1"), ("b", "cluster", 3, "z", 2, "t9")]
    got = R.assign(seeds, spark.createDataFrame(rows, "seed string, role string, rank int, page string, dist int, title string"))
    assert {(r.seed, r.page) for r in got.where("role = 'cluster'").collect()} == {("a", None), ("b", "z")}
