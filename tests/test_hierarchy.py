import random

from corpusloom.operators import hierarchy as H

SCHEMA = "conv string, node string, up string, seen int, parent string"


def brute(rows):
    par = {}
    for c, n, p, v, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[3] is not None, r[3] or 0, r[2] is not None, r[2] or "")):
        par[c, n] = p
    out = {}
    for c, n in par:
        path, seen, at = [n], {n}, n
        while (p := par[c, at]) is not None and (c, p) in par:
            if p in seen:
                path = None
                break
            path.insert(0, p)
            seen.add(p)
            at = p
        out[c, n] = path
    cyc = set()
    for c, n in par:
        at, steps = n, 0
        while (p := par[c, at]) is not None and (c, p) in par and steps <= len(par):
            at, steps = p, steps + 1
            if at == n:
                cyc.add((c, n))
                break
    return out, cyc


def test_random_forests_with_cycles(spark):
    r = random.Random(3)
    rows = []
    for c in range(12):
        n = r.choice([1, 2, 5, 30])
        for k in range(n):
            rows.append((f"c{c}", f"n{k}", r.choice([None, "missing", f"n{r.randrange(n)}", f"n{max(0, k - 1)}"]), 1, "clash"))
    rows += rows[:5] + [(None, "x", None, 1, ""), ("c0", None, "n0", 1, ""), ("deep", "d0", None, 1, "")] + [("deep", f"d{k}", f"d{k - 1}", 1, "") for k in range(1, 70)]
    df = spark.createDataFrame(rows, SCHEMA)
    paths, cyc = brute(rows)
    assert {tuple(x) for x in H.cycle_nodes(df, "node", "up", ["conv"], "seen").collect()} == cyc
    got = H.hierarchy(df, "node", "up", ["conv"], "seen").collect()
    assert len(got) == len(paths)
    below = {}
    for k, p in paths.items():
        for a in (p or [])[:-1]:
            below[k[0], a] = below.get((k[0], a), 0) + 1
    for x in got:
        p = paths[x.conv, x.node]
        assert x.path == p and x.in_cycle == ((x.conv, x.node) in cyc) and x.below_cycle == (p is None and not x.in_cycle)
        if p:
            assert (x.root, x.depth, x.n_descendants) == (p[0], len(p) - 1, below.get((x.conv, x.node), 0))


def test_current_branch_and_descendants(spark):
    df = spark.createDataFrame([("c", "a", None, "b2"), ("c", "b1", "a", "b2"), ("c", "b2", "a", "b2"), ("d", "z", None, "nowhere")], "k string, n string, p string, cur string")
    t = H.hierarchy(df, "n", "p", ["k"], current="cur")
    assert {(r.k, r.n) for r in t.collect() if r.on_current_branch} == {("c", "a"), ("c", "b2")}
    assert {tuple(r) for r in H.descendants(t, "n", ["k"]).collect()} == {("c", "a", "b1", 1), ("c", "a", "b2", 1)}


def test_empty_and_self_parent(spark):
    empty = spark.createDataFrame([], "k string, n string, p string")
    assert H.cycle_nodes(empty, "n", "p", ["k"]).count() == 0 and H.hierarchy(empty, "n", "p", ["k"]).count() == 0
    one = spark.createDataFrame([("k", "a", "a"), ("k", "b", "a")], "k string, n string, p string")
    assert [r.n for r in H.cycle_nodes(one, "n", "p", ["k"]).collect()] == ["a"]
