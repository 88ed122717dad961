import math

import numpy as np

from listwatch.llm import vptree

SCHEMA = "shard string, vec_id long, embedding array<float>, kind string, part int"


def brute(rows, queries, k):
    def ok(i, v):
        return i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    rows = [(i, tuple(map(float, v))) for i, v in rows if ok(i, v)]
    asked = {}
    for i, v in queries:
        if ok(i, v):
            v = tuple(map(float, v))
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        best = {}
        for i, x in rows:
            if i != q and len(x) == len(v):
                s = 0.0
                for a, b in zip(v, x):
                    s += a * b
                best[i] = max(best.get(i, -math.inf), s)
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k])]
    return sorted(out)


def make(spark, rows):
    return spark.createDataFrame([("x", i, v, "y", 3) for i, v in rows], SCHEMA)


def test_exact_with_factor_one_and_edge_rows(spark, scratch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(600)]
    same = [float(np.float32(x)) for x in rng.normal(size=6)]
    rows += [(i, same) for i in range(1000, 1200)]                       # a hot vector: ties go to the smaller id
    rows += [(7, rows[7][1]), (8, same), (None, same), (2000, None), (2020, [0.0] * 6), (2040, [float("nan")] * 6),
             (2060, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2080, [float("inf")] + [0.0] * 5), (2100, [1.0, 2.0]), (2120, [2.0, 1.0]), (2140, [])]
    df = make(spark, rows)
    got = vptree.nearest(df, df.where("vec_id % 20 = 0"), scratch, k=20, factor=1.0, shard_rows=150)
    assert sorted(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], 20)


def test_ties_and_repeated_ids_at_factor_one(spark, scratch):
    rng = np.random.default_rng(11)
    signs = [(i, rng.choice([-1.0, 1.0], 16).tolist()) for i in range(1024)]
    same, near = [1.0, 2.0, 3.0], lambda i: [1.0, 2.0, 3.0 - i / 1024]
    one_id = [(2, same), (3, same), *[(1, same)] * 30, (20, same)]                     # an id on many rows of a vector
    many = [(1, near(i)) for i in range(60)] + [(i, near(70 + i)) for i in range(2, 40)]  # an id on many near vectors
    for rows in (signs, one_id, many):
        df = make(spark, rows)
        got = vptree.nearest(df, df.where("vec_id % 20 = 0"), scratch, k=20, factor=1.0, shard_rows=400)
        assert sorted(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] % 20 == 0], 20)


def test_fewer_candidates_and_empty_table(spark, scratch):
    rows = [(i, [1.0, float(i)]) for i in range(5)]
    df = make(spark, rows)
    got = vptree.nearest(df, df, scratch, k=20)
    assert sorted(map(tuple, got.collect())) == brute(rows, rows, 20)
    none = make(spark, [])
    assert vptree.nearest(none, none, scratch).collect() == []


def test_recall_of_the_relaxed_search(spark, scratch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()]
    got = vptree.nearest(df, df.where("vec_id % 20 = 0"), scratch, k=20, factor=5.0, shard_rows=200).collect()
    want = {(q, i) for q, _, i, _ in brute(rows, [r for r in rows if r[0] % 20 == 0], 20)}
    assert len({(r[0], r[2]) for r in got} & want) >= 0.95 * len(want)


def test_larger_factors_prune_more():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.05, size=(300, 4)) for c in range(8)])
    norm = float(np.linalg.norm(x, axis=1).max())
    visits = []
    for factor in (1.0, 4.0):
        tree, count = vptree.Tree(np.arange(len(x)), x, norm, factor), [0]
        visit = tree._visit

        def counted(at, active, bound, visit=visit, count=count, tree=tree):
            if len(tree.nodes[at]) == 2:
                count[0] += int((bound * tree.factor <= tree.reach[active]).sum()) if tree.least is None else 0
            visit(at, active, bound)

        tree._visit = counted
        tree.search(x[::50], 5)
        visits.append(count[0])
    assert visits[1] <= visits[0] < len(x[::50]) * sum(len(n) == 2 for n in tree.nodes)
