"""Mixing sources to target weights by iterative proportional fitting (operator 4).

Tokens are summed per cell (source, language, topic). The cells' weights are
raked to the target shares of each margin in turn until all margins fit, and
every document is then kept with the probability of its cell: raked weight over
actual share, scaled so that the largest is 1 (or to a wanted fraction of the
tokens). Kept tokens therefore have the target margins in expectation.

DataFrame functions only. The documents are read once to count cells and once
to sample; in between the work is on one row per cell, a few rounds to a
table, so neither lineage nor plan grows with the rounds. The draw is a hash of the
document's id, text and a seed: the same rows are kept whatever the partitioning.

Defined cases: null sources, languages and topics are values of their own;
null, empty and blank texts have 0 tokens and the probability of their cell; a
cell without tokens keeps its documents (probability 1), it weighs nothing; target values that
no document has are left out and the rest scaled up; values without a target keep their actual
share; repeated rows draw alike; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from listwatch.llm.common import Scratch, every

#: Rounds in one plan, between two tables.
ROUNDS_A_TABLE = 3
#: Rounds at most; raking stops when the margins fit to TOLERANCE, or no longer change by as much.
ROUNDS = 60
TOLERANCE = 1e-9
SEED = "mix-1"


def tokens(text: Column) -> Column:
    """Number of runs of non-blank characters."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\n\r\x0b\f]+"), lambda w: w != "")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by form and wording; fixed rules, first match counts."""
    return (F.when(text.isNull(), "none").when(text.rlike("(?i)licen[sc]ed? under|all rights reserved|copyright"), "legal")
            .when(text.contains(" | "), "table")
            .when(text.rlike(r"[*#$%&]{3}"), "markup")
            .when(text.rlike(r"[A-Z]{4,}!!"), "shout")
            .when(F.length(text) < 200, "note")
            .otherwise("prose"))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, target): shares proportional to the actual token counts to the given power (1: as they are, 0: even)."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0").select(margin, F.pow("t", F.lit(power)).alias("p"))
    total = sums.agg(F.sum("p")).first()[0] or 1.0
    return sums.select(margin, (F.col("p") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, rounds: int = ROUNDS,
         tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (margins..., tokens) with ``weight``, whose sums per margin fit the target shares (margin, target)."""
    size = cells.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    total, n = size["t"] or 0, size["n"]
    cur = cells.withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    for m, target in targets.items():  # what each value of a margin is to weigh
        goal = _goals(cells, m, target, total)
        cur = cur.join(goal, cur[m].eqNullSafe(goal[f"_{m}"]), "left").drop(f"_{m}")
    before, cur = float("inf"), scratch.save(cur, "rake", rows=n)
    for _ in range(0, rounds, ROUNDS_A_TABLE):
        fitted = cur
        for _ in range(ROUNDS_A_TABLE):
            for m in targets:
                # a window holds the cells, not the documents, of one value of the margin
                fitted = fitted.withColumn(f"sum_{m}", F.sum("weight").over(Window.partitionBy(m)))
                fitted = fitted.withColumn("weight", F.col("weight") * F.coalesce(
                    F.col(f"goal_{m}") / F.nullif(F.col(f"sum_{m}"), F.lit(0.0)), F.lit(1.0)))
        misfit = F.greatest(F.lit(0.0), *[F.abs(F.col(f"sum_{m}") - F.col(f"goal_{m}")) for m in targets])
        cur = scratch.save(fitted.select(*cur.columns, misfit.alias("misfit")), "rake", rows=n)
        now = cur.agg(F.max("misfit")).first()[0] or 0.0
        cur = cur.drop("misfit")
        # margins that contradict each other (a source with a language of its own) settle without fitting
        if now < tolerance or abs(before - now) < tolerance:
            break
        before = now
    return cur.select(*cells.columns, "weight")


def _goals(cells: DataFrame, margin: str, target: DataFrame, total: int) -> DataFrame:
    """(_margin, goal_margin): values without a target keep their share, the others fill the rest."""
    actual = cells.groupBy(margin).agg((F.sum("tokens") / F.lit(float(total or 1))).alias("actual")).where("actual > 0")
    both = actual.join(target, actual[margin].eqNullSafe(target[margin]), "left").select(actual[margin].alias(f"_{margin}"), "actual", "target")
    sums = both.agg(F.sum("target").alias("named"), F.sum(F.when(F.col("target").isNull(), F.col("actual"))).alias("free")).first()
    named, free = float(sums["named"] or 1), float(sums["free"] or 0)
    return both.select(f"_{margin}", F.coalesce(F.col("target") / named * (1 - free), F.col("actual")).alias(f"goal_{margin}"))


def draw(id_col: str, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the row's id, its text and the seed."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, powers: dict[str, float], scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
        fraction: float | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(id_col, source, lang, topic, n_tokens, probability, kept) of every row, with the columns of ``docs`` as ``row``.

    ``targets`` gives the shares of each margin; by default each margin's own shares, tempered by ``powers``.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*every(docs)).alias("row"), F.col(id_col), "source", "lang",
                       topic(text).alias("topic"), tokens(text).alias("n_tokens"), draw(id_col, text).alias("u"))
    margins = list(powers)
    cells = scratch.save(rows.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")), "cells")
    raked = rake(cells, targets or {m: tempered(cells, m, p) for m, p in powers.items()}, scratch)
    ratio = raked.where("tokens > 0").withColumn("ratio", F.col("weight") / F.col("tokens"))
    stats = ratio.agg(F.max("ratio").alias("top"), F.sum("tokens").alias("all")).first()
    scale = (1.0 / stats["top"] if fraction is None else fraction * stats["all"]) if stats["top"] else 0.0
    chance = ratio.select(*(F.col(m).alias(f"_{m}") for m in margins), F.least(F.col("ratio") * scale, F.lit(1.0)).alias("p"))
    same = reduce(Column.__and__, [rows[m].eqNullSafe(chance[f"_{m}"]) for m in margins])
    out = rows.join(chance, same, "left").withColumn("probability", F.coalesce("p", F.lit(1.0)))
    return out.select(id_col, "source", "lang", "topic", "n_tokens", "probability",
                      (F.col("u") < F.col("probability")).cast("int").alias("kept"), "row")


def oracle(powers: dict[str, float]) -> str:
    """The same in DuckDB SQL over ``documents``, raked in a recursive query of ROUNDS rounds."""
    goals = ", ".join(
        f"goal_{m} AS (SELECT {m}, pow(sum(tokens), {p}) / sum(pow(sum(tokens), {p})) OVER () AS goal FROM cells GROUP BY {m} HAVING sum(tokens) > 0)"
        for m, p in powers.items())
    margins = ", ".join(powers)
    nested = "rake"
    for m in powers:
        nested = (f"(SELECT c.round, c.source, c.lang, c.topic, c.tokens, c.weight * g.goal / sum(c.weight) OVER (PARTITION BY c.{m}) AS weight "
                  f"FROM {nested} c JOIN goal_{m} g ON g.{m} IS NOT DISTINCT FROM c.{m})")
    return rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, lang, len(list_filter(string_split_regex(text, '[ \t\n\r\x0b\f]+'), lambda w: w <> '')) AS n_tokens,
           CASE WHEN text IS NULL THEN 'none'
                WHEN regexp_matches(text, '(?i)licen[sc]ed? under|all rights reserved|copyright') THEN 'legal'
                WHEN contains(text, ' | ') THEN 'table'
                WHEN regexp_matches(text, '[*#$%&]{{3}}') THEN 'markup'
                WHEN regexp_matches(text, '[A-Z]{{4,}}!!') THEN 'shout'
                WHEN length(text) < 200 THEN 'note' ELSE 'prose' END AS topic,
           ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT
               / {float(1 << 48)!r} AS u
    FROM documents),
cells AS (SELECT {margins}, sum(coalesce(n_tokens, 0)) AS tokens FROM docs GROUP BY {margins}),
{goals},
rake AS (
    SELECT 0 AS round, source, lang, topic, tokens, tokens / sum(tokens) OVER () AS weight FROM cells WHERE tokens > 0
    UNION ALL
    SELECT round + 1, source, lang, topic, tokens, weight FROM {nested} WHERE round < {ROUNDS}),
chance AS (
    SELECT *, least((weight / tokens) / max(weight / tokens) OVER (), 1.0) AS p FROM rake WHERE round = {ROUNDS})
SELECT d.doc_id, d.source, d.lang, d.topic, coalesce(d.n_tokens, 0)::BIGINT AS n_tokens, round(coalesce(p, 1.0), 6) AS probability,
       (u < coalesce(p, 1.0))::INTEGER AS kept
FROM docs d LEFT JOIN chance c ON c.source IS NOT DISTINCT FROM d.source AND c.lang IS NOT DISTINCT FROM d.lang
    AND c.topic IS NOT DISTINCT FROM d.topic
"""
