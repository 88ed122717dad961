import re
import zlib
from collections import Counter

from listwatch.llm import queries, spelling
from listwatch.llm.common import Scratch

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(rows, every=31, least=7, occurrences=2, ratio=10):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}
    # words that share no deletion variant are more than one edit apart
    by_variant = {}
    for w in words:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_variant.setdefault(v, []).append(w)
    near = {w: set() for w in words}
    for some in by_variant.values():
        for a in some:
            near[a].update(b for b in some if one_edit(a, b))
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_whole_query_equals_brute_force(spark, docs):
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = collected(queries.op11_spelling(spark, "/root/testdata/sf0.01"))
    assert got == want and sum(r[1] is not None for r in want) > 10


def test_common_chunks_are_refined(spark, docs):
    some = docs.limit(150)
    want = brute([tuple(r) for r in some.select("doc_id", "text").collect()], ratio=2)
    for hot in (0, 3, 10 ** 9):
        assert collected(spelling.variants(some, Scratch(spark, "s"), ratio=2, hot=hot)) == want


def test_every_edit_is_found(spark):
    base, letters = ["abcdefg", "abcdefgh", "äbcdefghé", "aaaaaaa", "abababab"], "axÀÿ"
    words = {w for b in base for i in range(len(b) + 1) for w in
             (b, b[:i] + b[i + 1:], *(b[:i] + c + b[i:] for c in letters), *(b[:i] + c + b[i + 1:] for c in letters))}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    want = {(a, b) for a in words for b in words if one_edit(a, b) and (len(a), a) < (len(b), b)}
    for hot in (0, 4, 1000):
        got = [tuple(r) for r in spelling.near_pairs(df, Scratch(spark, "s"), hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_edge_rows(spark):
    chain = [("abcdefgh", 4), ("abcdefghi", 40), ("abcdefghij", 400), ("abcdefghxx", 40)]
    text = " ".join(" ".join([w] * n) for w, n in chain)
    rows = [(None, "ZEBRASTRIPE Ünïcödêr ünïcödêr÷ 日本語語語語語語"), (None, "ZEBRASTRIPE Ünïcödêr ünïcödêr÷ 日本語語語語語語"), (1, None), (2, ""), (3, text),
            (3, text), (4, "x" * 100_000 + " short ABCDEFg abcdefG"), (5, "zebrastripe zebrastripes zebrastripe zebrastripes")]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, word string, n long")
    for every in (31, 1, 10 ** 9):
        assert collected(spelling.variants(df, Scratch(spark, "s"), every=every)) == brute(rows, every)
    assert spelling.variants(df.limit(0), Scratch(spark, "s")).collect() == []


def test_tasks_hand_on_what_they_hold(spark, docs, monkeypatch):
    some = docs.limit(100)
    want = sorted(map(tuple, spelling.words(some, Scratch(spark, "s")).collect()))
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    assert sorted(map(tuple, spelling.words(some, Scratch(spark, "s")).collect())) == want


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms, Scratch(spark, "s")).collect()} == {"w20"}
