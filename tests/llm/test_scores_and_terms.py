import math
import random
from collections import defaultdict
from statistics import NormalDist

from corpusloom.llm import distinctive as D
from corpusloom.llm import rank_fusion as R

SCORES = {"a": 1.0, "b": 2.0}
SCHEMA = "q long, item long, a double, b double, at int, fused string"


def brute(rows, scores):
    newest = {}
    for q, i, a, b, at, _ in rows:
        if q is not None and i is not None:
            key = (at is not None, at or 0, a is not None, a or 0, b is not None, b or 0)
            if (q, i) not in newest or key > newest[q, i][0]:
                newest[q, i] = (key, a, b)
    out = {}
    for q in {k[0] for k in newest}:
        items = [k for k in newest if k[0] == q]
        total = defaultdict(float)
        for n, (name, w) in enumerate(scores.items()):
            vals = {k: newest[k][n + 1] for k in items if newest[k][n + 1] is not None and not math.isnan(newest[k][n + 1])}
            for k, v in vals.items():
                rank = sum(x < v for x in vals.values()) + (sum(x == v for x in vals.values()) + 1) / 2
                total[k] += w * NormalDist().inv_cdf((rank - 0.5) / len(vals))
        for k in items:
            out[k] = total[k] / sum(scores.values())
    return out


def test_fused_scores_against_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 2, 2, 2, None]), r.randrange(25), r.choice([None, float("nan"), 1e9, r.random(), 0.5]), r.choice([None, -3.0, r.gauss(0, 1)]), r.choice([1, 2]), "clash") for _ in range(150)]
    rows += [r_ for r_ in rows[:20]] + [(3, 1, None, None, 1, ""), (4, 1, 2.0, 2.0, None, "")]
    rows = [x for k, x in enumerate(rows) if (x[0], x[1], x[4]) not in {(y[0], y[1], y[4]) for y in rows[:k]} or x in rows[:k]]
    df = spark.createDataFrame(rows, SCHEMA)
    f = R.fused_scores(df, "q", "item", SCORES, "at")
    want = brute([x if x[2] is None or not math.isnan(x[2]) else (*x[:2], None, *x[3:]) for x in rows], SCORES)
    got = {(x.q, x.item): x.fused for x in f.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    ranked = R.ranking(f, "q", "item").collect()
    for q in {k[0] for k in want}:
        order = sorted((k for k in want if k[0] == q), key=lambda k: (-round(got[k], 9), k[1]))
        assert [x.item for x in sorted((x for x in ranked if x.q == q), key=lambda x: x.rank)] == [k[1] for k in order]
        assert {x.item for x in R.first_of_ranking(f, "q", "item").collect() if x.q == q} == {order[0][1]}


def test_scale_does_not_count(spark):
    rows = [(1, k, float(k), float((k * 7) % 10), 1, "") for k in range(10)]
    big = [(q, i, a * 1e6 + 5, b, at, x) for q, i, a, b, at, x in rows]
    a, b = ({x.item: x.fused for x in R.fused_scores(spark.createDataFrame(r, SCHEMA), "q", "item", SCORES, "at").collect()} for r in (rows, big))
    assert a == b


def test_empty(spark):
    assert R.ranking(R.fused_scores(spark.createDataFrame([], SCHEMA), "q", "item", SCORES, "at"), "q", "item").count() == 0
    assert D.most_distinctive(D.distinctiveness(spark.createDataFrame([], "c long, t string, n int"), "c", "t", "n"), "c", "t").count() == 0


def test_distinctiveness_against_brute_force(spark):
    r = random.Random(4)
    rows = [(r.randrange(30), r.choice(["The", "the", "rare", "Word", "x", "", None, f"w{r.randrange(40)}"]), r.choice([1, 1, 2, 5, None, 0]), "clash") for _ in range(600)]
    rows += [(k, "everywhere", 1, "") for k in range(30)] + [(None, "the", 3, "")]
    df = spark.createDataFrame(rows, "c long, t string, n int, df string")
    tf = defaultdict(int)
    for c, t, n in {x[:3] for x in rows if x[0] is not None and x[1] and (x[2] or 0) > 0}:
        tf[c, t.lower()] += n
    n = len({c for c, _ in tf})
    want = {}
    for (c, t), f in tf.items():
        d, cf = sum(k[1] == t for k in tf), sum(v for k, v in tf.items() if k[1] == t)
        want[c, t] = f * (-math.log2(d / n) + math.log2(1 - math.exp(-cf / n)))
    scored = D.distinctiveness(df, "c", "t", "n")
    got = {(x.c, x.t): x.score for x in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for x in D.most_distinctive(scored, "c", "t").collect():
        best = min((-round(v, 9), t) for (c, t), v in want.items() if c == x.c)
        assert x.t == best[1]
