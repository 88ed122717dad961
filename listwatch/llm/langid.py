"""Language identification by a byte convolutional network (operator 6).

A text is lower-cased, its non-letter ASCII becomes single spaces, and its
UTF-8 bytes are cut into windows of ``WINDOW`` bytes (the last one padded with
zero bytes). The network looks at the bytes one-hot through filters of several
widths, takes each filter's largest response in the window, and a softmax layer gives
the window's languages. A text's prediction is the mean of its windows' probabilities,
weighted by their bytes; all windows of the whole text count.

Training runs in numpy on the driver, on a bounded sample: up to ``PER_LANG``
documents of each language, those of smallest hash, and of each one piece of up
to ``PIECE`` characters. Prediction is one pass over the documents without a shuffle.

Defined cases: null texts and texts without a letter give ``und`` with score
0; with nothing to learn from, every text does. Rows with a null language are
never learned from. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from listwatch.llm.common import enough_for, under_share

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
PER_LANG = 1500
PIECE = 1536
STEPS = 700
BATCH = 128
#: Windows convolved at once when predicting.
BLOCK = 512

_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = {c: " " for c in range(128) if not chr(c).isalpha()}


def prepare(text: str) -> bytes:
    return " ".join(text.lower().translate(_TO_SPACE).split()).encode("utf-8", "replace")


def windows(raw: bytes) -> np.ndarray:
    """(n, WINDOW) bytes; the last window is padded with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


@dataclass
class Network:
    """tables[width] is (width, 256, FILTERS): a filter's weight of each byte at each place."""

    langs: list[str]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def head(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        """(n, WINDOW, FILTERS) responses; a place past the window's end reads zero bytes."""
        x = np.pad(x, ((0, 0), (0, width - 1)))
        return sum(self.tables[width][j][x[:, j:j + WINDOW]] for j in range(width))


def train(pieces: list[str], labels: list[str], seed: int = 7) -> Network:
    """Fit by Adam on random windows of random length, so that short texts are seen as well."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    y_all = np.array([langs.index(x) for x in labels])
    raws = [prepare(p) or b" " for p in pieces]
    of_lang = [np.flatnonzero(y_all == k) for k in range(len(langs))]
    n_feat = FILTERS * len(WIDTHS)
    net = Network(langs, {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
                  np.zeros(n_feat, np.float32), rng.normal(0, 0.3, (n_feat, len(langs))).astype(np.float32),
                  np.zeros(len(langs), np.float32))
    params = [*net.tables.values(), net.bias, net.dense, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows = np.arange(BATCH)
    for step in range(1, STEPS + 1):
        y = rng.integers(len(langs), size=BATCH)
        x = np.zeros((BATCH, WINDOW), np.uint8)
        for i, k in enumerate(y):
            raw = raws[rng.choice(of_lang[k])]
            size = min(len(raw), int(rng.choice((12, 32, 96, WINDOW))))
            at = int(rng.integers(len(raw) - size + 1))
            x[i, :size] = np.frombuffer(raw[at:at + size], np.uint8)
        pooled, places = [], {}
        for w in WIDTHS:
            r = net.responses(x, w)
            places[w] = r.argmax(axis=1)
            pooled.append(np.take_along_axis(r, places[w][:, None, :], axis=1)[:, 0])
        pooled = np.concatenate(pooled, axis=1)
        hidden = np.maximum(pooled + net.bias, 0)
        d_out = net.head(pooled)
        d_out[rows, y] -= 1
        d_out /= BATCH
        d_hidden = (d_out @ net.dense.T) * (hidden > 0)
        grads = []
        for i, w in enumerate(WIDTHS):
            d = d_hidden[:, i * FILTERS:(i + 1) * FILTERS]
            padded = np.pad(x, ((0, 0), (0, w - 1)))
            g = np.empty_like(net.tables[w])
            for j in range(w):
                byte = padded[rows[:, None], places[w] + j].astype(np.int64)
                g[j] = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), d.ravel(),
                                   256 * FILTERS).reshape(256, FILTERS)
            grads.append(g)
        grads += [d_hidden.sum(axis=0), hidden.T @ d_out, d_out.sum(axis=0)]
        rate = 0.03 * (1 - step / (STEPS + 1))
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return net


class Predictor:
    """The network's filters as tables of 16-bit integers by byte pair, for convolving many windows."""

    def __init__(self, net: Network):
        self.net = net
        limit = max(np.abs(t).max(axis=1).sum(axis=0).max() for t in net.tables.values())
        self.scale = 30000 / max(float(limit), 1e-6)
        self.parts = []  # of each width: (offset, by pair or by byte, table)
        for w in WIDTHS:
            t, parts = net.tables[w], []
            for j in range(0, w - 1, 2):
                pair = (t[j][None, :, :] + t[j + 1][:, None, :]).reshape(65536, FILTERS)  # low byte comes first
                parts.append((j, True, self._fixed(pair)))
            if w % 2:
                parts.append((w - 1, False, self._fixed(t[w - 1])))
            self.parts.append(parts)

    def _fixed(self, table: np.ndarray) -> np.ndarray:
        return np.round(table * self.scale).astype(np.int16)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each window of (n, WINDOW) bytes."""
        reach = max(WIDTHS)
        wide = np.pad(x, ((0, 0), (0, reach))).astype(np.uint16)
        pairs = wide[:, :-1] | (wide[:, 1:] << 8)
        out = []
        for parts in self.parts:
            r = None
            for j, paired, table in parts:
                got = table.take((pairs if paired else wide)[:, j:j + WINDOW], axis=0)
                r = got if r is None else np.add(r, got, out=r)
            while r.shape[1] > 1:  # halve along the places: contiguous blocks, faster than one reduction
                half = r.shape[1] // 2
                r = np.maximum(r[:, :half], r[:, half:])
            out.append(r[:, 0])
        return np.concatenate(out, axis=1) / np.float32(self.scale)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability of each text."""
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.net.langs:
            return lang, score
        total = np.zeros((len(texts), len(self.net.langs)))
        weight = np.zeros(len(texts))
        held: list[tuple[int, np.ndarray, int]] = []

        def flush():
            x = np.concatenate([w for _, w, _ in held])
            probs = np.concatenate([self.net.head(self.pooled(x[i:i + BLOCK])) for i in range(0, len(x), BLOCK)])
            at = 0
            for i, w, size in held:
                sizes = np.full(len(w), float(WINDOW))
                sizes[-1] = size - WINDOW * (len(w) - 1)
                total[i] += sizes @ probs[at:at + len(w)]
                weight[i] += size
                at += len(w)
            held.clear()

        for i, text in enumerate(texts):
            if text and _LETTER.search(text) and (raw := prepare(text)):
                held.append((i, windows(raw), len(raw)))
                if sum(len(w) for _, w, _ in held[-1:]) >= BLOCK or len(held) >= BLOCK:
                    flush()
        if held:
            flush()
        for i in np.flatnonzero(weight):
            k = int(total[i].argmax())
            lang[i], score[i] = self.net.langs[k], min(1.0, float(total[i, k] / weight[i]))
        return lang, score


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """(piece, lang): of each language the ``per_lang`` documents of smallest hash of id and text; of each a piece of up
    to PIECE characters that starts at a place given by the hash. Languages are counted first, so that only hashes
    small enough to be chosen are ranked."""
    usable = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    start = F.pmod(key, F.greatest(F.length(text_col) - PIECE, F.lit(0)) + 1) + 1
    counts = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return usable.select(F.lit("").alias("piece"), F.col(lang_col).alias("lang")).limit(0)
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, enough_for(per_lang, float(n)))])
    rows = usable.select(F.col(lang_col).alias("lang"), key.alias("key"),
                         F.col(text_col).substr(start.cast("int"), F.lit(PIECE)).alias("piece"))
    rows = rows.where(under_share(F.col("key"), F.element_at(shares, F.col("lang"))))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("key", "piece"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("piece", "lang")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Network:
    rows = sorted((r["lang"], r["piece"]) for r in sample(df, id_col, text_col, lang_col, per_lang).collect())
    if not rows:
        empty = np.zeros(0, np.float32)
        return Network([], {w: np.zeros((w, 256, FILTERS), np.float32) for w in WIDTHS}, empty, empty, empty)
    return train([p for _, p in rows], [lang for lang, _ in rows])


def predict(df: DataFrame, net: Network, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, lang_pred, score) of every row."""
    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        model = Predictor(net)
        for b in batches:
            lang, score = model.predict(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return df.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """True for the ids whose crc32 (of the id as text) modulo ``folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
