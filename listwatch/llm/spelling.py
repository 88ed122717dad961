"""Grouping of spelling variants by asymmetric q-chunks (operator 11).

Two words are near if one edit (a code point inserted, deleted or replaced)
makes one of the other. Of a near pair the shorter word u of length L (of
equal lengths: the one that sorts first) gives two disjoint chunks, its first
and its last L // 2 code points. One edit touches one of them at most, so the
other word holds the untouched chunk, at the chunk's place or, if a code point
was inserted before it, one behind. The other word gives all its positional
grams of the two lengths that such chunks can have. Chunks and grams are
equality-joined on (gram, place), a chunk being listed at its place and one
behind, and pairs are verified by the edit distance itself.

A chunk that more than ``hot`` words give is too common to be a key: what
remains of the word beside it again differs by one edit at most and gives two
chunks of its own, and the join key is then both chunks. Nothing is capped.

A word's form is its near word of largest count, if that is at least ``ratio``
times the word's own; following forms multiplies the count by ``ratio`` each
time, so roots are found by a few rounds of pointer doubling.

Words are counted per batch inside the tasks before anything is shuffled.

Defined cases: a null text has no words; a null doc_id reads as the empty
string in the checksum; repeated rows count again; ties of counts go to the
word smallest in code-point order; texts of any length are read whole; an
empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwatch.llm.common import Scratch

#: Letters of the contract; all of them are Latin-1, so one byte each there.
LETTERS = r"A-Za-zÀ-ÿ"
#: Distinct words counted in a task before they are handed on, and words that share a chunk before it is refined.
HELD_WORDS = 200_000
HOT = 200


def _results(doc: str, runs: list[str], every: int, least: int) -> Counter:
    """Results of one document's runs with their occurrences. Equal runs of a document have equal checksums, so each
    distinct run is looked at once. ``bytes.lower`` changes A-Z only."""
    lower: Counter = Counter()
    for run, n in Counter(runs).items():
        lower[run.encode("latin-1").lower()] += n
    seed, out = zlib.crc32(f"{doc}:".encode()), Counter()
    for word, n in lower.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < least:
                continue
        out[word] += n
    return out


def words(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", every: int = 31, least: int = 7,
          occurrences: int = 2) -> DataFrame:
    """(word, n): the distinct results of at least ``least`` code points with at least ``occurrences``."""
    find = re.compile(f"[{LETTERS}]{{{least},}}").findall

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.update(_results(doc or "", find(text or ""), every, least))
                if len(held) > HELD_WORDS:
                    yield _counted(held)
                    held = Counter()
        if held:
            yield _counted(held)

    counted = df.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "word string, n long")
    return scratch.save(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences), "words")


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                       pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _chunks(word: Column, size: Column) -> Column:
    """The first and the last ``size`` code points: (place, gram)."""
    last = F.char_length(word) - size
    return F.array(F.struct(F.lit(0).alias("place"), F.substring(word, F.lit(1), size).alias("gram")),
                   F.struct(last.alias("place"), F.substring(word, last + 1, size).alias("gram")))


def _grams(word: Column, size: Column) -> Column:
    """All positional grams of ``size`` code points (a word has at least as many)."""
    return F.transform(F.sequence(F.lit(0), F.char_length(word) - size),
                       lambda k: F.struct(k.alias("place"), F.substring(word, k + 1, size).alias("gram")))


def _gram_sizes(word: Column) -> Column:
    """Lengths of the chunks that a word as long as this, or shorter by one, can give."""
    return F.explode(F.array_distinct(F.array(_half(word), F.floor((F.char_length(word) - 1) / 2).cast("int"))))


def _beside(word: Column) -> Column:
    """What is left of the word without its gram."""
    return F.concat(F.substring(word, F.lit(1), F.col("place")),
                    F.substring(word, F.col("place") + F.char_length("gram") + 1, F.char_length(word)))


def _shifted(place: Column) -> Column:
    """A chunk is listed at its place and, as a code point may have been inserted before it, one behind."""
    return F.explode(F.array(place, place + 1))


def _near(u: Column, v: Column) -> Column:
    """Exactly one edit; the lengths say which pairs of a chunk word and a gram word count."""
    lu, lv = F.char_length(u), F.char_length(v)
    return ((lv == lu + 1) | ((lv == lu) & (u < v))) & (F.levenshtein(u, v, 1) == 1)


def _half(word: Column) -> Column:
    return F.floor(F.char_length(word) / 2).cast("int")


def near_pairs(vocabulary: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(u, v): the near pairs of distinct words (column word, at least two code points), each once."""
    word, rest, key = F.col("word"), F.col("rest"), ["gram", "place"]
    chunks = scratch.save(vocabulary.select("word", F.explode(_chunks(word, _half(word))).alias("c")).select("word", "c.*"), "chunks")
    common = scratch.save(chunks.groupBy(key).count().where(F.col("count") > hot).select(key), "common")
    grams = vocabulary.select("word", _gram_sizes(word).alias("size")).select(
        "word", F.explode(_grams(word, F.col("size"))).alias("g")).select("word", "g.*")
    found = _verified(chunks.join(common, key, "left_anti").select(word.alias("u"), "gram", _shifted(F.col("place")).alias("place")),
                      grams.select(word.alias("v"), *key), key)

    # common chunks: what is left of the word beside the chunk gives two chunks and grams of its own
    mine = chunks.join(common, key, "left_semi").select(word.alias("u"), "gram", _shifted(F.col("place")).alias("place"), _beside(word).alias("rest"))
    mine = mine.select("u", *key, F.explode(_chunks(rest, _half(rest))).alias("c"))
    mine = mine.select("u", *key, F.col("c.gram").alias("gram2"), _shifted(F.col("c.place")).alias("place2"))
    at = common.select("gram", _shifted(F.col("place")).alias("place")).distinct()
    other = grams.join(at, key, "left_semi").select(word.alias("v"), *key, _beside(word).alias("rest"))
    other = other.select("v", *key, "rest", _gram_sizes(rest).alias("size")).select("v", *key, F.explode(_grams(rest, F.col("size"))).alias("g"))
    other = other.select("v", *key, F.col("g.gram").alias("gram2"), F.col("g.place").alias("place2"))
    return found.unionByName(_verified(mine, other, [*key, "gram2", "place2"])).distinct()


def _verified(chunks: DataFrame, grams: DataFrame, key: list[str]) -> DataFrame:
    return chunks.join(grams, key).where(_near(F.col("u"), F.col("v"))).select("u", "v")


def variants(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", every: int = 31, least: int = 7,
             occurrences: int = 2, ratio: int = 10, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word."""
    vocabulary = words(df, scratch, id_col, text_col, every, least, occurrences)
    pairs = scratch.save(near_pairs(vocabulary, scratch, hot), "pairs")
    both = pairs.toDF("word", "other").unionByName(pairs.select(F.col("v").alias("word"), F.col("u").alias("other")))
    counts = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(counts, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    best = best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    chosen = F.col("other_n") >= ratio * F.col("n")
    formed = scratch.save(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("other")).alias("form"),
        F.when(chosen, F.col("other_n")).alias("form_n")), "formed")
    root = roots(formed.where("form IS NOT NULL").select("word", "form"), scratch)
    return formed.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for each word that has a form: the end of its chain of forms (column form), which has no cycles."""
    cur, step = scratch.save(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("farther"))
        nxt = scratch.save(cur.join(on, "root", "left").select("word", F.coalesce("farther", "root").alias("root"),
                                                               F.col("farther").isNotNull().alias("moved")), f"roots-{step + 1}")
        if not nxt.where("moved").head(1):
            return nxt.select("word", "root")
        scratch.drop(f"roots-{step}")
        cur, step = nxt.select("word", "root"), step + 1
