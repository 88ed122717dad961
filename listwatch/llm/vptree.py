"""Approximate nearest neighbours by vantage-point trees per shard (operator 1).

Rows are dealt to shards of about ``SHARD_ROWS`` by a hash of their id. Each
task builds the tree of a shard once and streams the query set through it in
blocks; every query visits every shard and the shards' best are merged
by rank. Nearness is the inner product. It becomes a metric by one more
component, sqrt(M^2 - |x|^2) with M the largest norm (0 for a query):
the distance then falls as the product rises, so the triangle inequality holds
and the search is the exact maximum-inner-product search.

Pruning: a subtree whose distance bound is b is left out when ``factor`` * b
exceeds the distance of the k-th best so far. Factor 1 is the exact search;
larger factors prune more and may miss. On vectors without structure the
bounds are weak, see the README for recall measured against brute force.

Equal vectors of a shard are folded to one point of the tree with all its
ids, so any number of copies costs one distance. Ties and repeated ids are
settled whole: a query's points down to the last one asked for, within
rounding, are gathered again where more of them tie than the search keeps, and
where they hold fewer than k ids the search asks for more points. Scores that
are returned are sums in double precision of the original components, from
first to last.

Defined cases: vectors that are null, empty or zero, or that hold a null or
non-finite component, take no part, nor do rows with a null id; vectors of
another length are no candidates; rows with the query's id are the query's
own; an id on several rows is one query (with the smallest vector) and counts
once as a candidate (with its best score); fewer candidates than k are all
returned; ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from listwatch.llm.common import Scratch

SHARD_ROWS = 8192
#: Queries that one task takes through its tree; beyond it the shard is given to several tasks.
TASK_QUERIES = 50_000
BLOCK = 1024
LEAF = 128
#: Points kept above those asked for; if more tie with the last one, they are gathered by a second visit.
SPARE = 8
#: Rounding of a product and of a distance, as a share of the norms.
ROUNDING, SLACK = 1e-10, 1e-7


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


class Tree:
    """Vantage-point tree over the distinct rows of ``x`` (n, d); ``ids`` are the rows' ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, max_norm: float, factor: float, seed: int = 0):
        x = np.ascontiguousarray(x + 0.0)
        order = np.lexsort((ids, *x.T[::-1]))
        x, ids = x[order], ids[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
        once = new | np.concatenate([[True], ids[1:] != ids[:-1]])
        x, ids, new = x[once], ids[once], new[once]
        self.first = np.append(np.flatnonzero(new), len(ids))  # of each point, in ids
        self.ids, self.x = ids, x[new]
        self.factor = factor
        self.m2 = max_norm ** 2 * (1 + 1e-12)
        lift = np.sqrt(np.maximum(self.m2 - np.einsum("ij,ij->i", self.x, self.x), 0))
        self.y = np.concatenate([self.x, lift[:, None]], axis=1)
        self.nodes: list[tuple] = []
        self.points = self._build(np.arange(len(self.x)), np.random.default_rng(seed))

    def _build(self, members: np.ndarray, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(members) <= LEAF:
            self.nodes[at] = (members, np.ascontiguousarray(self.x[members].T))
            return at
        # of a few vantage points, the one that spreads a sample of the members most
        tried = rng.choice(members, 8, replace=False)
        sample = self.y[rng.choice(members, min(256, len(members)), replace=False)]
        spread = [np.linalg.norm(sample - self.y[v], axis=1).std() for v in tried]
        vantage = tried[int(np.argmax(spread))]
        distance = np.linalg.norm(self.y[members] - self.y[vantage], axis=1)
        order = np.argsort(distance, kind="stable")
        half = len(members) // 2
        inner, outer = members[order[:half]], members[order[half:]]
        near, far = distance[order[half - 1]], distance[order[half]]
        self.nodes[at] = (vantage, near, far, self._build(inner, rng), self._build(outer, rng))
        return at

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of ``q``, points, products): every point found whose product is at least that of the row's k-th, but for
        rounding."""
        keep = k + SPARE
        self.best = np.full((len(q), keep), -np.inf)
        self.found = np.full((len(q), keep), -1, dtype=np.int64)
        self.q, self.q2, self.k = q, np.einsum("ij,ij->i", q, q), k
        self.reach, self.slack = np.full(len(q), np.inf), SLACK * np.sqrt(self.q2 + self.m2)
        self.least = None
        self._visit(self.points, np.arange(len(q)), np.zeros(len(q)))
        self.least = -np.partition(-self.best, k - 1, axis=1)[:, k - 1] - ROUNDING * np.sqrt(self.q2 * self.m2)
        cut = np.isfinite(self.best).all(axis=1) & (self.best.min(axis=1) >= self.least)  # more may tie than are kept
        rows, columns = np.nonzero((self.found >= 0) & (self.best >= self.least[:, None]) & ~cut[:, None])
        self.tied = [(rows, self.found[rows, columns], self.best[rows, columns])]
        if cut.any():
            self._visit(self.points, np.flatnonzero(cut), np.zeros(int(cut.sum())))
        return tuple(np.concatenate(c) for c in zip(*self.tied))

    def _visit(self, at: int, active: np.ndarray, bound: np.ndarray) -> None:
        live = bound * self.factor <= self.reach[active] * (1 + 1e-9) + self.slack[active]
        active, bound = active[live], bound[live]
        if not len(active):
            return
        node = self.nodes[at]
        if len(node) == 2:
            members, columns = node
            if self.least is not None:  # the second visit gathers, the first has fixed how far it goes
                s = self.q[active] @ columns
                rows, at = np.nonzero(s >= self.least[active][:, None])
                self.tied.append((active[rows], members[at], s[rows, at]))
                return
            s = np.concatenate([self.best[active], self.q[active] @ columns], axis=1)
            keep = self.best.shape[1]
            pick = np.argpartition(-s, keep - 1, axis=1)[:, :keep] if s.shape[1] > keep else np.broadcast_to(np.arange(keep), (len(s), keep))
            points = np.concatenate([self.found[active], np.broadcast_to(members, (len(active), len(members)))], axis=1)
            self.best[active] = best = np.take_along_axis(s, pick, axis=1)
            self.found[active] = np.take_along_axis(points, pick, axis=1)
            kth = -np.partition(-best, self.k - 1, axis=1)[:, self.k - 1]
            self.reach[active] = np.sqrt(np.maximum(self.q2[active] + self.m2 - 2 * kth, 0))
            return
        vantage, near, far, inner, outer = node
        # the vantage point's lift meets the query's last component, which is 0
        d = np.sqrt(np.maximum(self.q2[active] + self.m2 - 2 * (self.q[active] @ self.x[vantage]), 0))
        inside = d * 2 <= near + far
        out = ~inside
        self._visit(inner, active[inside], np.maximum(bound[inside], d[inside] - near))
        self._visit(outer, active[out], np.maximum(bound[out], far - d[out]))
        self._visit(outer, active[inside], np.maximum(bound[inside], far - d[inside]))
        self._visit(inner, active[out], np.maximum(bound[out], d[out] - near))

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
        """(query id, id, score) of each query's k best ids of this tree."""
        out, asked, points = ([], [], []), np.arange(len(q)), k + 1  # the query's own point may be among them
        while len(asked):
            more = []
            rows, found, _ = self.search(q[asked], points)
            order = np.lexsort((found, rows))
            rows, found = rows[order], found[order]
            score = np.zeros(len(rows))
            for j in range(self.x.shape[1]):  # one component after the other: the same sum whatever the place of a row
                score += q[asked[rows], j] * self.x[found, j]
            edges = np.searchsorted(rows, np.arange(len(asked) + 1))
            for i, lo, hi in zip(asked.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
                own, best = query_ids[i], {}
                for s, p in sorted(zip((-score[lo:hi]).tolist(), found[lo:hi].tolist())):
                    # of one point the k smallest ids besides the query's own are enough
                    for x in self.ids[self.first[p]:min(self.first[p + 1], self.first[p] + k + 1)].tolist():
                        if x != own:
                            best.setdefault(x, s)
                if len(best) < k and points < len(self.x):
                    more.append(i)
                    continue
                for x, s in sorted(best.items(), key=lambda e: (e[1], e[0]))[:k]:
                    for column, value in zip(out, (own, x, -s)):
                        column.append(value)
            asked, points = np.array(more, dtype=np.int64), 4 * points
        return out


def nearest(df: DataFrame, queries: DataFrame, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding",
            k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id_col, score): of each row of ``queries`` the k nearest rows of ``df`` found, its own apart."""
    vec = F.col(vec_col)
    rows = df.where(usable(vec) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.cast("array<double>").alias("vec"))
    asked = (queries.where(usable(vec) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.cast("array<double>").alias("vec"))
             .groupBy("id").agg(F.min("vec").alias("vec")))
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    stats, n_queries = rows.agg(F.count("*").alias("n"), F.max(size).alias("norm")).first(), asked.count()
    shards = max(1, math.ceil(stats["n"] / shard_rows))
    groups = max(1, math.ceil(n_queries / TASK_QUERIES))
    norm = float(stats["norm"] or 0.0)
    # a shard's rows come first, then the queries that its task takes through them
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"),
                       F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(0).alias("kind"), "id", "vec")
    sought = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                          F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "vec")

    def run(batches):
        task, kept, trees = None, [], None

        def by_length(ids, vecs):
            starts, flat = vecs.offsets.to_numpy(), vecs.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(starts)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                yield int(n), ids[rows], flat[starts[rows][:, None] + np.arange(n)]

        for b in batches:
            columns = [b.column(i) for i in range(5)]
            where = np.stack([c.to_numpy() for c in columns[:3]], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(axis=1)])) if len(where) else []
            for lo, hi in zip(cuts, np.append(cuts[1:], len(where))):
                shard, part, kind = where[lo].tolist()
                if (shard, part) != task:
                    task, kept, trees = (shard, part), [], None
                some = list(by_length(columns[3].slice(lo, hi - lo).to_numpy(), columns[4].slice(lo, hi - lo)))
                if kind == 0:
                    kept += some
                    continue
                if trees is None:
                    trees = {n: Tree(np.concatenate([i for m, i, _ in kept if m == n]),
                                     np.concatenate([x for m, _, x in kept if m == n]), norm, factor) for n in {m for m, _, _ in kept}}
                    kept = []
                for n, ids, q in some:
                    if n in trees:
                        for at in range(0, len(ids), BLOCK):
                            found = trees[n].nearest(ids[at:at + BLOCK], q[at:at + BLOCK], k)
                            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()),
                                                              pa.array(found[2], pa.float64())], names=["query_id", "id", "score"])

    dealt = held.unionByName(sought).repartition(max(shards * groups, 1), "shard", "part").sortWithinPartitions("shard", "part", "kind")
    found = dealt.mapInArrow(run, "query_id long, id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
