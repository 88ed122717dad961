"""Divergence of sources within a language by one-hot level products (operator 12).

Every language keeps the terms of at least ``least_docs`` of its documents. A
group (language, source), and the language itself, gives each kept term the
mass p = 1 + floor(10^9 (count + 1) / (N + V)) with N the sum of its counts
and V the number of kept terms. The price of a term under p as seen from q is
f = floor((p - q)^2 / q); two sources of a language differ by the sum of f over
all kept terms, and a source's own terms are ranked by f against the language.

The sum needs the joint table of count levels of every two sources: how many
terms have level a in one and level b in the other. The kept terms of a
language are dealt into blocks and its sources into column blocks; each unit
(term block, two column blocks) is one group of rows in Spark, of bounded
size. In a unit, indicator columns for (source, level) are multiplied by their
transpose, a few hundred terms at a time; the products are whole numbers
below 2^24 and so exact in single precision, and yield all joint tables at
once, level zero included. Every occurring cell is priced in whole numbers.
Terms that a unit's sources both lack differ by a constant and are added by
their number. No pair of rows is ever joined.

Documents are reduced to counts per batch inside the tasks before anything is
shuffled; sums of units are sums per pair of sources, the result's own size.

All arithmetic is exact: 64-bit whole numbers, 128-bit decimals where a count
is scaled. Sums stay below (10^9 + V)^2 + 10^9 + V.

Defined cases: null text, lang and source read as ''; each row is a document
of its own, also one of a repeated or null id; malformed UTF-8 reads as
U+FFFD; texts of any length are read whole; a language without kept terms
gives its pairs of sources the value 0 and no terms; a group without terms
has N = 0 and keeps its pairs; ties go to the item that sorts first by its
bytes; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from listwatch.llm.common import Scratch

SCALE = 1_000_000_000
#: ASCII letters and all bytes of other characters: the runs that count as terms, once A-Z are lower-cased.
TERM = rb"[a-z\x80-\xff]+"
#: Distinct (group, term) pairs held in a task before they are handed on.
HELD_TERMS = 400_000
#: Terms and sources of one unit, and terms of one product.
TERM_BLOCK = 4096
SOURCE_BLOCK = 32
PRODUCT_TERMS = 256


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""
    find = re.compile(TERM).findall

    def rows(n: dict, docs: dict):
        for (lang, source), own in n.items():
            if own:
                terms = pa.array(list(own), pa.binary()).cast(pa.string())
                of_docs = list(map(docs[lang, source].__getitem__, own))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(own)), pa.repeat(source, len(own)), terms, pa.array(list(own.values()), pa.int64()),
                     pa.array(of_docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        n: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}
        for b in batches:
            for raw, lang, source in zip(*(c.to_pylist() for c in b.columns)):
                terms = find(raw.decode(errors="replace").encode().lower())
                n.setdefault((lang, source), Counter()).update(terms)
                docs.setdefault((lang, source), Counter()).update(set(terms))
                if len(n) + sum(map(len, n.values())) > HELD_TERMS:
                    yield from rows(n, docs)
                    n, docs = {}, {}
        yield from rows(n, docs)

    text, lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    counted = df.select(text.cast("binary").alias("text"), lang.alias("lang"), source.alias("source")).mapInArrow(
        run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def mass(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + kept)); 1 where no term is kept."""
    scaled = F.lit(SCALE).cast("decimal(38,0)") * (n + F.lit(1)).cast("decimal(20,0)")
    whole = F.call_function("div", scaled, (total + F.when(kept > 0, kept)).cast("decimal(20,0)"))
    return F.when(kept > 0, F.lit(1) + whole).otherwise(F.lit(1)).cast("long")


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _unit(columns: pa.Table, same: bool) -> pa.Table:
    """Sums of f over one unit's terms for each ordered pair of its sources: those of one column block, or (not
    ``same``) those of two different ones. Rows without a term give a source with its mass at count zero."""
    term = columns["term"].combine_chunks()
    heads = columns.filter(term.is_null())
    own = columns.filter(term.is_valid())
    sources, zero, part = (np.array(heads[c].to_pylist(), dtype=t) for c, t in (("source", object), ("p", np.int64), ("part", np.int64)))
    place = {s: i for i, s in enumerate(sources)}
    which = own["term"].combine_chunks().dictionary_encode()
    levels = np.tile(zero, (len(which.dictionary), 1))
    if len(own):
        levels[which.indices.to_numpy(), [place[s] for s in own["source"].to_pylist()]] = own["p"].to_numpy()
    # terms of like frequency together: few levels, so few columns
    levels = levels[np.argsort(levels.max(axis=1), kind="stable")]
    sums = np.zeros((len(sources), len(sources)), dtype=np.int64)
    for at in range(0, len(levels), PRODUCT_TERMS):
        sums += _priced(levels[at:at + PRODUCT_TERMS])
    wanted = part[:, None] == part if same else part[:, None] != part
    np.fill_diagonal(wanted, False)
    a, b = np.nonzero(wanted)
    return pa.table({"source": pa.array(sources[a], pa.string()), "item": pa.array(sources[b], pa.string()),
                     "value": pa.array(sums[a, b], pa.int64()), "terms": pa.array(np.full(len(a), len(levels), dtype=np.int64)),
                     "p0": pa.array(zero[a], pa.int64()), "q0": pa.array(zero[b], pa.int64())})


def _priced(levels: np.ndarray) -> np.ndarray:
    """Sum of f(p, q) over the rows of ``levels`` for each ordered pair of its columns, by products of indicators."""
    n, groups = levels.shape
    values, codes = zip(*(np.unique(levels[:, g], return_inverse=True) for g in range(groups)))
    ends = np.cumsum([len(v) for v in values])
    starts = ends - [len(v) for v in values]
    q = np.concatenate(values)
    one_hot = np.zeros((n, len(q)), dtype=np.float32)
    for g, (code, start) in enumerate(zip(codes, starts)):
        one_hot[np.arange(n), start + code] = 1
    turned, out = np.ascontiguousarray(one_hot.T), np.zeros((groups, groups), dtype=np.int64)
    for g in range(groups):  # one block of the product: the joint tables of g with every column
        joint = turned @ one_hot[:, starts[g]:ends[g]]
        b, a = np.nonzero(joint)  # by column of the other, so that sums are runs
        p = values[g][a]
        total = np.concatenate([[0], np.cumsum(joint[b, a].astype(np.int64) * ((p - q[b]) * (p - q[b]) // q[b]))])
        out[g] = total[np.searchsorted(b, ends)] - total[np.searchsorted(b, starts)]
    return out


def audit(df: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_docs: int = 3, top: int = 200, term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for each two sources of a language, all ranks; part
    ``term`` for the terms that a source has above its language, to rank ``top``."""
    counts = scratch.save(term_counts(df, text_col, lang_col, source_col), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    terms = scratch.save(terms.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "terms")
    kept = scratch.save(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")
    scratch.drop("counts")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang_col, source_col)]
    groups = df.select(names[0].alias("lang"), names[1].alias("source")).distinct()
    n_sources = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    zero = F.lit(0).cast("long")
    groups = scratch.save(groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(n_sources, "lang").select(
        "lang", "source", F.coalesce("own_total", zero).alias("own_total"), F.coalesce("kept", zero).alias("kept"),
        F.coalesce("lang_total", zero).alias("lang_total"), "n_sources"), "groups")

    massed = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "kept", "n_sources", mass(F.col("n"), F.col("own_total"), F.col("kept")).alias("p"),
        mass(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    return _ranked(_pairs(massed, groups, term_block, source_block), "pair").unionByName(_ranked(
        massed.where("p > q").select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value")), "term", top))


def _pairs(massed: DataFrame, groups: DataFrame, term_block: int, source_block: int) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language."""
    blocks = F.greatest(F.ceil(F.col("kept") / term_block), F.lit(1))
    parts = F.ceil(F.col("n_sources") / source_block)
    part = F.pmod(F.xxhash64("source"), parts)
    heads = groups.where("n_sources > 1").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"),
        mass(F.lit(0).cast("long"), F.col("own_total"), F.col("kept")).alias("p"), part.alias("part"), parts.alias("parts"))
    rows = massed.where("n_sources > 1").select(
        "lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "source", "term", "p", part.alias("part"), parts.alias("parts"))
    units = rows.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    units = units.select("lang", "block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
                         "source", "term", "p", "part")

    def run(key, table):
        lang, _, low, high = (k.as_py() for k in key)
        out = _unit(table, low == high)
        return out.add_column(0, "lang", pa.array([lang] * len(out), pa.string()))

    summed = units.groupBy("lang", "block", "low", "high").applyInArrow(
        run, "lang string, source string, item string, value long, terms long, p0 long, q0 long")
    summed = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"),
                                                           F.max("p0").alias("p0"), F.max("q0").alias("q0"))
    rest = groups.groupBy("lang").agg(F.max("kept").alias("kept"))
    value = F.col("value") + (F.col("kept") - F.col("terms")) * price(F.col("p0"), F.col("q0"))
    return summed.join(rest, "lang").select("lang", "source", "item", value.alias("value"))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", rank)
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM l GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
grid AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
                1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(totals.total, 0) + v.v) AS p
         FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang
         LEFT JOIN totals ON totals.lang = g.lang AND totals.source = g.source
         LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
whole AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.n + 1)) // (v.total + v.v) AS q FROM l JOIN v ON v.lang = l.lang),
above AS (SELECT grid.lang, grid.source, grid.term AS item, (p - q) * (p - q) // q AS value
          FROM grid JOIN whole ON whole.lang = grid.lang AND whole.term = grid.term WHERE grid.n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM above)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
