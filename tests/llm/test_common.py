import random

from pyspark.sql import functions as F

from listwatch.llm import common


def test_components_of_chains_stars_and_loops(spark, scratch):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 150)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 3), (2000, None)]
    edges += [(rng.randrange(3000, 3060), rng.randrange(3000, 3060)) for _ in range(40)] + [(-7, 9000), (9000, 9001), (0, 1)]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_without_edges(spark, scratch):
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), scratch).collect() == []


def test_smallest_is_the_smallest(spark):
    df = spark.range(20_000).select("id", F.xxhash64("id").alias("key"))
    every = sorted((r["key"], r["id"]) for r in df.collect())
    for limit in (1, 50, 3000, 30_000):
        assert [(r["key"], r["id"]) for r in common.smallest(df, "key", limit).collect()] == every[:limit]
    assert common.smallest(df.where("false"), "key", 5).collect() == []


def test_scratch_tables_are_dropped(spark, scratch):
    import glob
    scratch.save(spark.range(3), "t")
    assert scratch.save(spark.range(4), "t").count() == 4
    scratch.drop("t")
    assert len(glob.glob(f"{scratch.root}/*-t-*")) == 1
