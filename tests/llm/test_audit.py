import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from listwatch.llm import audit, queries
from listwatch.llm.common import Scratch

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least_docs=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in groups if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def masses(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 10 ** 9 * (n + 1) // total for t, n in c.items()}

        p, q = {s: masses(c) for s, c in own.items()}, masses(whole)
        for s in own:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, some in (("pair", pairs), ("term", terms)):
                some.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(some) if part == "pair" or k < top]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLES['op12_divergence']})").fetchall())
    assert collected(queries.op12_divergence(spark, folder)) == want and len(want) > 1000


@pytest.mark.parametrize("term_block, source_block", [(4096, 32), (7, 2), (50, 1)])
def test_equals_brute_force_in_any_blocks(spark, docs, term_block, source_block):
    some = docs.limit(60)
    want = brute([tuple(r) for r in some.select("text", "lang", "source").collect()], top=5)
    assert collected(audit.audit(some, Scratch(spark, "a"), top=5, term_block=term_block, source_block=source_block)) == want


def test_edge_rows(spark):
    rows = [(None, None, None), ("", "xx", "s1"), ("Äb äb Äb\x7fz\x00é1É_é", "xx", "s2"), ("Äb é É", "xx", "s1"), ("äb Äb", "xx", "s2"), ("Äb É É é", "xx", "s3"),
            ("only once", "yy", "s1"), ("", "yy", "s2"), ("alone alone", "zz", "s1"), ("ab ab", None, "s1"), ("AB ab", None, "s1"), ("ab c" * 20_000, "", "s2"),
            ("ab ab", None, "s1")]
    df = spark.createDataFrame([(1, *r, 3, "x") for r in rows], "doc_id int, text string, lang string, source string, `a.b` int, term string")
    assert collected(audit.audit(df, Scratch(spark, "a"))) == brute(rows)
    assert audit.audit(df.limit(0), Scratch(spark, "a")).collect() == []


def test_products_are_exact():
    rng = np.random.default_rng(4)
    levels = np.concatenate([rng.integers(1, 10 ** 9, (200, 5)), rng.integers(1, 4, (100, 5)), np.ones((1, 5), dtype=np.int64)])
    want = [[sum((int(p) - int(q)) ** 2 // int(q) for p, q in zip(levels[:, g], levels[:, h])) for h in range(5)] for g in range(5)]
    assert audit._priced(levels).astype(object).tolist() == [[x % 2 ** 64 - (x % 2 ** 64 >> 63) * 2 ** 64 for x in row] for row in want]


def test_tasks_hand_on_what_they_hold(spark, docs, monkeypatch):
    some = docs.limit(60)
    want = sorted(map(tuple, audit.term_counts(some).collect()))
    monkeypatch.setattr(audit, "HELD_TERMS", 100)
    assert sorted(map(tuple, audit.term_counts(some).collect())) == want
