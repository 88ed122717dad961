import random

import xxhash
from pyspark.sql import functions as F

from listwatch.llm import simhash

SCHEMA = "doc_id long, text string, fp string, wild int, rest long, m map<string,string>"


def slow_fingerprint(text, shingle=3):
    """Straight from the definition."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, max_bits=2):
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def fixture():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "DELTA", "été", "ñu"]
    base = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(400))
    rows = [(None, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one  two"), (7, "one two three"),
            (8, "É a\x0bb\x0cc"), (9, "x " * 3000), (10, "x " * 3001), (3, "one"), (None, "only here and null"), (None, "only here and null")]
    for i in range(60):
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append((100 + i, " ".join(w)))
    return rows + [(200 + i, base) for i in range(10)]


def make(spark, rows):
    return spark.createDataFrame([(d, t, "a", 1, 2, {"k": "v"}) for d, t in rows], SCHEMA)


def test_fingerprints_by_definition():
    for _, t in fixture():
        assert simhash.fingerprint(None if t is None else t.encode(), 3) == slow_fingerprint(t)


def test_components_against_all_pairs(spark, scratch):
    rows = fixture()
    out = simhash.components(make(spark, rows), scratch)
    got = sorted(map(tuple, out.select("doc_id", simhash.hex_digits(F.col("fp")), "component_id").collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)


def test_links_with_crowded_variants(spark, scratch):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(150)}
    fps |= {centre ^ rng.getrandbits(32) for _ in range(80)} | {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for bits in (1, 2, 3):
        want = {(a, b) for a in fps for b in fps if simhash._signed(a) > simhash._signed(b) and (a ^ b).bit_count() <= bits}
        for hot in (2, 10_000):
            s = type(scratch)(spark, "links")
            got = {(r[0] % 2**64, r[1] % 2**64) for r in simhash.links(df, bits, s, hot).collect()}
            assert got == want, (bits, hot)


def test_no_index_is_broadcast(spark, scratch):
    """Spark guesses the size of exploded variants by that of the fingerprints, which says that they could be broadcast."""
    df = scratch.save(spark.createDataFrame([(i * i,) for i in range(100)], "fp long"), "distinct")
    plan = simhash.links(df, 2, scratch, hot=2)._jdf.queryExecution().sparkPlan().toString()
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    assert plan.count("SortMergeJoin") == 3  # variants, and the crowded ones of two segments
    assert "BroadcastHashJoin" not in "".join(x for x in plan.split("\n") if ", Inner" in x)


def test_one_of_each(spark, scratch):
    rows = fixture()
    df = make(spark, rows)
    kept = simhash.one_of_each(df, scratch)
    assert kept.columns == df.columns
    comps = {}
    for (d, t), (_, _, c) in zip(rows, brute_components(rows)):
        comps.setdefault(c if c is not None else t, set()).add(d)
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(str(min((d for d in ds if d is not None), default=None)) for ds in comps.values())


def test_empty_table(spark, scratch):
    assert simhash.components(make(spark, []), scratch).collect() == []
    assert simhash.one_of_each(make(spark, []), scratch).collect() == []
