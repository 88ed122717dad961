import hashlib
import random
from collections import Counter

import numpy as np

from listwatch.llm import suffix_dedup as sd


def brute(rows, window=sd.WINDOW):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i:i + window] for _, r in raws for i in range(len(r) - window + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(6)

    def prose(n):
        return "".join(rng.choice("abcdefghij klmnop é") for _ in range(n))

    shared, second = prose(700), prose(450)
    rows = [(1, prose(1500)), (2, prose(300) + shared + prose(200)), (3, shared), (4, prose(100) + shared[50:600] + second),
            (5, second + prose(90) + second), (6, prose(399)), (7, None), (8, ""), (9, "short"), (9, "short"),
            (10, "a" * 1300), (11, prose(50) + "a" * 800 + prose(50)), (12, "xyz" * 500), (13, prose(10) + "xyz" * 300 + "q"),
            (14, shared[:399]), (None, shared + prose(5)), (None, prose(500)), (15, "b" * 400), (16, "c" * 401)]
    copy = prose(900)
    rows += [(20 + i, copy) for i in range(4)] + [(30, copy + "."), (31, copy[:450]), (20, copy)]
    near = prose(1200)
    for i in range(25):
        at = rng.randrange(1200)
        rows.append((40 + i, near[:at] + "#" + near[at + 1:]))
    twice = prose(600)
    return rows + [(70, twice), (70, twice), (71, "é" * 300)]


def check(spark, scratch, rows, **options):
    df = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, k1 int, bucket string")
    got = sorted(map(tuple, sd.digest(df, scratch, **options).collect()), key=str)
    assert [r[:5] for r in got] == brute(rows)
    assert all(share == removed / max(n, 1) for _, n, removed, _, _, share in got)
    return df


def test_against_all_substrings(spark, scratch):
    rows = fixture()
    df = check(spark, scratch, rows)
    kept = sd.remove_repeats(df, type(scratch)(spark, "again")).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in kept
                  if r["doc_id"] is not None) == [r for r in brute(rows) if r[0] is not None] or \
        sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in kept), key=str) == brute(rows)


def test_crowded_buckets_are_dealt_again(spark, scratch):
    check(spark, scratch, fixture(), crowded=1)


def test_empty_table(spark, scratch):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.digest(df, scratch).collect() == []


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = sd.anchors(raw)
    monkeypatch.setattr(sd, "SEGMENT", 700)
    pieces = sd.anchors(raw)

    def by_window(found):
        return [(s + i, s + o, g) for s, n, o, g, _ in zip(*(x.tolist() for x in found)) for i in range(n)]

    assert by_window(whole) == by_window(pieces)
    assert [w for w, _, _ in by_window(whole)] == list(range(5000 - sd.WINDOW + 1))


def test_suffixes_are_sorted_and_equal_ones_found():
    rng = random.Random(8)
    core = bytes(rng.choice(b"ab") for _ in range(500))
    contexts, counts, offsets = [], [], []
    for _ in range(40):
        lead, tail = rng.randrange(0, 90), rng.randrange(0, 60)
        contexts.append(core[90 - lead:90 + 340 + tail] + bytes(rng.choice(b"ab") for _ in range(60 - tail)))
        contexts[-1] = contexts[-1].ljust(400, b"c")
        counts.append(len(contexts[-1]) - 399)
        offsets.append(lead)
    counts, offsets = np.array(counts), np.array(offsets)
    owner, start, same, fresh = sd.sort_bucket(contexts, counts, offsets)
    suffix = [contexts[o][s:s + 400] for o, s in zip(owner.tolist(), start.tolist())]
    for i in range(1, len(suffix)):
        assert fresh[i] or suffix[i - 1] <= suffix[i]
        assert same[i] == (not fresh[i] and suffix[i - 1] == suffix[i])
    every = Counter(c[i:i + 400] for c, n in zip(contexts, counts.tolist()) for i in range(n))
    for c, n, found in zip(contexts, counts.tolist(), sd.repeats(contexts, counts, offsets)):
        # equal windows have their anchor at equal distance in real buckets; here only those count
        assert set(found.tolist()) <= {i for i in range(n) if every[c[i:i + 400]] > 1}


def test_cut_merges_touching_runs():
    raw = bytes(range(256)) * 10
    removed, spans, kept = sd.cut(raw, np.array([400, 0, 1200]), np.array([1, 1, 5]))
    assert (removed, spans, kept) == (800 + 404, 2, raw[800:1200] + raw[1604:])


def test_anchors_are_read_twice_without_files_of_their_own(spark, scratch, monkeypatch):
    saved, save = [], type(scratch).save
    monkeypatch.setattr(type(scratch), "save", lambda self, df, name, **kw: saved.append(name) or save(self, df, name, **kw))
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    check(spark, scratch, fixture())
    assert "grams" in saved and "anchors" not in saved  # was a file a task, and three helper processes a file
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
