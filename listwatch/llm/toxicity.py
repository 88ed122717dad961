"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration (operator 10).

The labelled documents of smallest hash, ``SAMPLE`` at most, are dealt into
``FOLDS`` folds by a hash of their wording. The lexicon's terms are words, and beginnings of words
(inflected forms share them), that far more toxic than clean documents hold;
of near copies one counts, and they share a fold. A sample document gets its features with the lexicon of the other folds, so the
trees see terms as they work on unseen texts; the isotonic step calibrates scores of
trees that were fitted without the document's fold. Scoring uses lexicon and
trees of the whole sample. All of it is a few kilobytes, fitted in numpy on the
driver from one row of features per sample document.

Features of a whole text: densities of lexicon words, of word beginnings, of
common insults and of obfuscated forms (letters replaced by look-alikes, split by punctuation or
stretched), the strongest term, the share of lexicon words near a second-person
word, capitals, punctuation, obfuscation and stretching rates, length.

Defined cases: null and empty texts have all-zero features and get a score
like any other; rows with a null id are scored, never learned from; a document
labelled more than once counts as toxic if any label says so; labels of null,
and of documents that do not exist, are ignored; without usable labels of both
kinds every score is the share of toxic labels (0 without any label).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwatch.llm.common import Scratch, smallest

SAMPLE = 20_000
FOLDS = 4
LEXICON = 2_000
#: A term needs one in so many toxic documents (three at least), so that copies of one document give no terms.
LEAST_SHARE = 100
#: Lengths of the word beginnings that can be terms.
STEMS = (4, 5, 6)
#: Words to either side that count as near.
NEAR = 5
CACHE = 120_000

# Second-person words of the four languages
SECOND_PERSON = frozenset((
    "you your yours yourself du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "ti tus usted ustedes vosotros").split())
# Common insults, a feature beside the learned lexicon
INSULTS = frozenset((
    "idiot idiots moron morons stupid dumb fool loser losers trash garbage scum clown jerk worthless pathetic disgusting "
    "useless imbecile bastard bitch asshole dickhead shithead scumbag "
    "idiotin dummkopf trottel depp arschloch abschaum versager wichser hurensohn "
    "imbécile crétin connard connasse salaud salope ordure abruti débile "
    "idiota imbécil estúpido estúpida tonto basura escoria cabrón gilipollas pendejo").split())
# Characters that stand for letters in obfuscated words
LOOK_ALIKE = str.maketrans("013457@$!|", "oleastasil")

FEATURES = ("word_density", "stem_density", "insult_density", "hidden_density", "weight_density", "strongest", "log_hits", "distinct_share",
            "near_second_person", "second_person_density", "capital_rate", "shouted_rate", "punctuation_rate",
            "exclaim_rate", "obfuscation_rate", "stretch_rate", "log_words")

#: Weight of a common insult among the lexicon's log-odds.
INSULT_WEIGHT = 3.0

_EDGES = ".,;:!?\"'()[]{}<>*#$%&-_/\\|~+="
_STRETCHED = re.compile(r"(.)\1\1")
_SINGLE = re.compile(r"(.)\1+")


def selected(labels: DataFrame, train: Column, id_col: str = "doc_id", label_col: str = "toxic",
             limit: int = SAMPLE) -> DataFrame:
    """(id_col, y): the ``limit`` labelled ids of smallest hash."""
    key = F.xxhash64(id_col)
    known = (labels.where(train & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
             .select("y", id_col, key.alias("key")))
    return smallest(known, "key", limit).select(id_col, "y")


def with_sketch(texts: DataFrame) -> DataFrame:
    """Adds ``sketch``, the smallest hash of the text's 3-word shingles: near copies mostly share it, other texts hardly
    ever do. One pass in Python: word lists are long, and SQL lambdas would cut them anew for each shingle."""
    schema = texts.select("*").schema.add("sketch", "long")

    def run(batches):
        for b in batches:
            hashes = []
            for t in b.column("text").to_pylist():
                words = (t or "").lower().split()
                hashes.append(min(xxhash.xxh64_intdigest(" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))))
            yield b.append_column("sketch", pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)))

    return texts.mapInArrow(run, schema)


def terms(texts: DataFrame) -> DataFrame:
    """(term, part, n_toxic, n): documents of (text, y, part, sketch) that hold a word or a beginning of a longer word;
    of documents with equal sketch and label one counts (one row of ``texts`` is marked ``first``)."""
    texts = texts.where("first")
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    stems = [F.transform(F.filter("words", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.substring(w, 1, n)) for n in STEMS]
    both = texts.select("y", "part", words.alias("words")).select(
        "y", "part", F.array_distinct(F.concat(
            F.transform("words", lambda w: F.concat(F.lit("="), w)), *stems)).alias("terms"))
    return (both.select("y", "part", F.explode("terms").alias("term")).where(F.length("term") >= 4).groupBy("term", "part")
            .agg(F.sum("y").alias("n_toxic"), F.count("*").alias("n")))


def lexicon(counted: DataFrame, sizes: DataFrame, without: int | None = None, limit: int = LEXICON) -> dict[str, float]:
    """Log-odds of the strongest terms of all folds but one; a leading '=' marks a whole word, the rest are beginnings.
    ``counted``: terms(); ``sizes``: documents per (part, y)."""
    others = F.lit(True) if without is None else F.col("part") != without
    n = {r["y"]: r["n"] for r in sizes.where(others).groupBy("y").agg(F.sum("n").alias("n")).collect()}
    toxic, clean = int(n.get(1, 0)), int(n.get(0, 0))
    if not toxic or not clean:
        return {}
    odds = (F.log((F.col("n_toxic") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("n_toxic") + 0.5) / (clean + 1)))
    found = (counted.where(others).groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n").alias("n"))
             .where(F.col("n_toxic") >= max(3, toxic // LEAST_SHARE)).select("term", odds.alias("odds"), "n_toxic")
             .where("odds > 2.5").orderBy(F.desc(F.col("odds") * F.sqrt("n_toxic")), "term").limit(limit))
    return {r["term"]: float(r["odds"]) for r in found.collect()}


class Featurizer:
    """Dense features of whole texts; what a token contributes is computed once and kept in a bounded cache."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self._reset()

    def _reset(self):
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, 12))

    def _term(self, word: str) -> tuple[float, float]:
        """Weights of a lower-case word as such and by its beginnings."""
        get = self.lexicon.get
        return get("=" + word, 0.0), max((get(word[:n], 0.0) for n in STEMS if len(word) > n), default=0.0)

    def _token(self, token: str) -> tuple:
        core = token.strip(_EDGES)
        low = core.lower()
        word = stem = hidden = 0.0
        plain = low.isalpha()
        insult = low in INSULTS
        if plain:
            word, stem = self._term(low)
        stretched = bool(_STRETCHED.search(low)) and any(c.isalpha() for c in low)
        mixed = not plain and any(c.isalpha() for c in low)
        if not word and not stem and not insult and (mixed or stretched):
            letters = "".join(c for c in low.translate(LOOK_ALIKE) if c.isalpha())
            for form in {letters, _SINGLE.sub(r"\1", letters)}:
                hidden = max(hidden, *self._term(form), INSULT_WEIGHT * (form in INSULTS))
        n_letters = sum(map(str.isalpha, token))
        n_upper = sum(map(str.isupper, token))
        return (word, stem, hidden, max(word, stem, hidden, INSULT_WEIGHT * insult), low in SECOND_PERSON, n_letters, n_upper,
                n_letters >= 3 and n_upper == n_letters, len(token) - sum(map(str.isalnum, token)),
                token.count("!") + token.count("?"), mixed + 2 * stretched, insult)

    def _ids(self, tokens: list[str]) -> np.ndarray:
        index = self.index
        try:
            return np.array([index[t] for t in tokens], dtype=np.int64)
        except KeyError:
            for t in tokens:
                if t not in index:
                    at = index[t] = len(index)
                    if at == len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.table[at] = self._token(t)
            return np.array([index[t] for t in tokens], dtype=np.int64)

    def features(self, texts: list[str | None]) -> np.ndarray:
        if len(self.index) > CACHE:
            self._reset()
        tokens = [(t or "").split() for t in texts]
        ids = [self._ids(t) for t in tokens]
        out = np.zeros((len(texts), len(FEATURES)))
        for i, at in enumerate(ids):
            if len(at):
                out[i] = self._one(self.table[at], at)
        return out

    @staticmethod
    def _one(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        n = len(rows)
        hits = np.flatnonzero(rows[:, 3])
        you = np.flatnonzero(rows[:, 4])
        near = 0
        if len(hits) and len(you):
            right = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - hits), np.abs(you[np.maximum(right - 1, 0)] - hits))
            near = int((gap <= NEAR).sum())
        total = rows.sum(axis=0)
        letters = max(total[5], 1)
        mixed, stretched = rows[:, 10] % 2, rows[:, 10] >= 2
        return np.array((
            100 * np.count_nonzero(rows[:, 0]) / n, 100 * np.count_nonzero(rows[:, 1]) / n, 100 * total[11] / n,
            100 * np.count_nonzero(rows[:, 2]) / n, 100 * total[3] / n, rows[:, 3].max(), np.log1p(len(hits)),
            len(np.unique(ids[hits])) / max(len(hits), 1), near / max(len(hits), 1), 100 * len(you) / n,
            total[6] / letters, total[7] / n, total[8] / n, total[9] / n, mixed.sum() / n, stretched.sum() / n, np.log1p(n)))


@dataclass
class Model:
    lexicon: dict[str, float]
    prior: float = 0.0
    base: float = 0.0
    #: Each tree: arrays of the split feature, its threshold and the leaves' values; node i has children 2i+1, 2i+2.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    #: Isotonic steps: raw scores and the calibrated value at each.
    raw: np.ndarray = field(default_factory=lambda: np.zeros(0))
    calibrated: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for split, threshold, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while node.size and node[0] < len(split):
                node = 2 * node + 1 + (x[np.arange(len(x)), split[node]] > threshold[node])
            out += value[node - len(split)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(self.raw):
            return np.full(len(x), self.prior)
        return np.interp(self.margin(x), self.raw, self.calibrated)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48) -> Model:
    """Trees of logistic loss, split on histograms of each feature's quantile bins."""
    model = Model({}, prior=float(y.mean()))
    p = min(max(model.prior, 1e-3), 1 - 1e-3)
    model.base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]),
                                      np.quantile(c[c > 0], np.linspace(0, 1, bins // 2 + 1)[:-1]) - 1e-9 if (c > 0).any() else []]))
            for c in x.T]
    width = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
    n_feat, margin = x.shape[1], np.full(len(x), model.base)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        inner = (1 << depth) - 1
        split, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * n_feat + np.arange(n_feat)) * width + binned
            g = np.bincount(cell.ravel(), np.repeat(grad, n_feat), count * n_feat * width).reshape(count, n_feat, width).cumsum(2)
            h = np.bincount(cell.ravel(), np.repeat(hess, n_feat), count * n_feat * width).reshape(count, n_feat, width).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt ** 2 / (ht + 1)
            gain[(h < 1) | (ht - h < 1)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            feat, at = best // width, best % width
            for k in range(count):
                if gain[k, feat[k], at[k]] > 1e-6 and at[k] < len(cuts[feat[k]]):
                    split[first + k], threshold[first + k] = feat[k], cuts[feat[k]][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), split[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + 1)
        margin += value[leaf]
        model.trees.append((split, threshold, value))
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a non-decreasing step per distinct raw score, as (raw, calibrated) points."""
    points, inverse = np.unique(raw, return_inverse=True)
    weight, value = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []  # sum, weight, number of points
    for s, w in zip(value, weight):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, n2 = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += w2
            blocks[-1][2] += n2
    fitted = np.concatenate([np.full(int(n), s / w) for s, w, n in blocks]) if blocks else np.zeros(0)
    return points, fitted


def fit(docs: DataFrame, labels: DataFrame, train: Column, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", limit: int = SAMPLE) -> Model:
    """``train``: a condition on the ids that may be learned from."""
    chosen = scratch.save(selected(labels, train, id_col, label_col, limit), "chosen")
    # at most `limit` ids, so the broadcast is bounded; it saves a shuffle of all texts
    sample = scratch.save(docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
                          .join(F.broadcast(chosen), id_col).select(id_col, "text", "y"), "texts")
    # near copies go to the same fold
    sample = scratch.save(with_sketch(sample).withColumn("part", F.pmod("sketch", F.lit(FOLDS)).cast("int")), "sample")
    scratch.drop("texts")
    key = F.xxhash64(id_col, "text")
    firsts = scratch.save(sample.groupBy("sketch", "y").agg(F.min(key).alias("first_key")), "firsts")  # `limit` rows at most
    marked = (sample.join(F.broadcast(firsts), ["sketch", "y"]).withColumn("first", key == F.col("first_key"))
              .select("text", "y", "part", "sketch", "first"))
    counted = scratch.save(terms(marked), "terms")
    sizes = scratch.save(sample.groupBy("part", "y").agg(F.countDistinct("sketch").alias("n")), "sizes")
    of_others = [lexicon(counted, sizes, k) for k in range(FOLDS)]
    words = lexicon(counted, sizes)

    def run(batches):
        fold, f = None, None  # rows come sorted by fold, so one cache of tokens is held at a time
        for b in batches:
            x = []
            for k, t in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                if k != fold:
                    fold, f = k, Featurizer(of_others[k])
                x.append(f.features([t])[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))],
                                             names=["key", "part", "y", "x"])

    rows = (sample.select(key.alias("key"), "part", "y", "text").sortWithinPartitions("part")
            .mapInArrow(run, "key long, part int, y int, x array<double>").collect())
    rows.sort(key=lambda r: (r["key"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    y, part = np.array([r["y"] for r in rows], dtype=float), np.array([r["part"] for r in rows])
    prior = float(y.mean()) if len(y) else 0.0
    if len({*y}) < 2:
        return Model(words, prior=prior)
    raw = np.zeros(len(y))
    for k in np.unique(part):  # scores of trees that did not see the fold
        a, b = part != k, part == k
        raw[b] = boost(x[a], y[a]).margin(x[b]) if len({*y[a]}) == 2 else 0.0
    model = boost(x, y)
    model.lexicon = words
    model.raw, model.calibrated = isotonic(raw, y)
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, score) of every row: one pass, no shuffle."""
    schema = df.select(*keep).schema.add("score", "double")

    def run(batches):
        f = Featurizer(model.lexicon)
        for b in batches:
            s = np.clip(model.score(f.features(b.column(len(keep)).to_pylist())), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(s)], names=[*keep, "score"])

    return df.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
