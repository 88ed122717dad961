"""Byte-level BPE encoding and decoding (operator 7).

Texts are cut into words by the tokenizer's pattern. Inside each Spark task
the distinct words of a batch are encoded by one recursive DuckDB query:
every word is a set of (word, position, token) rows, the rows and their right
neighbours are joined to the merge table, and each round contracts the
leftmost pair of smallest rank of each word, until no word has a pair left.
Decoding joins the ids to the vocabulary and concatenates the bytes by an
ordered aggregate per document.

Spark deals out the documents; nothing is shuffled and no state is kept
across rows but a bounded cache of encoded words. The rows of a query are bounded, so DuckDB works in memory and
writes no files. A word that is itself a
vocabulary entry is that token, as in the public library. The recursive query
holds all rounds of a word, whose size is quadratic in its length; words of
more than ``LONG_WORD`` bytes are contracted by the same rule (smallest rank,
then leftmost) with a heap over a linked list.

Defined cases: a null text encodes like the empty one (no ids, empty bytes);
null ids decode like an empty list; an id outside the vocabulary raises.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_WORD = 128  # positions take 8 bits in ENCODE_SQL
WORDS_PER_QUERY = 20_000
#: Rows of all rounds of one query at most, a word of n bytes counting as n * n: some 100 MB.
ROWS_PER_QUERY = 4 << 20
#: Ids that one query decodes.
ROWS_PER_DECODE = 1 << 20
#: Words of one generation of a worker's cache.
CACHE_WORDS = 250_000

#: ``place`` is 256 * word + position. Of a pair, ``best`` packs its rank, the positions of its left and right token
#: and the position after it, so its minimum is the leftmost pair of smallest rank.
ENCODE_SQL = """
WITH RECURSIVE step(round, place, tok, next_place) AS (
    SELECT 0, place, tok, place + 1 FROM start_rows
    UNION ALL
    SELECT s.round + 1, s.place,
           CASE WHEN s.place & 255 = (best >> 16) & 255 THEN (best >> 24)::INTEGER ELSE s.tok END,
           CASE WHEN s.place & 255 = (best >> 16) & 255 THEN ((s.place & -256) + (best & 255))::INTEGER ELSE s.next_place END
    FROM step s JOIN (
        SELECT l.place >> 8 AS word,
               min((m.rank << 24) | ((l.place & 255) << 16) | ((r.place & 255) << 8) | (r.next_place - (r.place & -256))) AS best
        FROM step l
        JOIN step r ON r.place = l.next_place
        JOIN merges m ON m.pair = (l.tok::BIGINT << 32) | r.tok
        GROUP BY l.place >> 8) c ON c.word = s.place >> 8
    WHERE s.place & 255 <> (best >> 8) & 255
)
SELECT place >> 8 AS word, tok
FROM step JOIN (SELECT place >> 8 AS of_word, max(round) AS last FROM step GROUP BY 1)
  ON of_word = place >> 8 AND last = round
ORDER BY place
"""

DECODE_SQL = """
SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM token_rows JOIN vocabulary USING (id) GROUP BY doc
"""


class Tokenizer:
    """Vocabulary, merge table and DuckDB connection of one Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        get = self.ranks.get
        merges = [(get(t[:i]), get(t[i:]), r) for t, r in self.ranks.items() for i in range(1, len(t))]
        merges = np.array([m for m in merges if m[0] is not None and m[1] is not None], dtype=np.int64).reshape(-1, 3)
        self.vocabulary = {i: t for t, i in self.ranks.items()}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        for name, columns in (("merges", {"pair": (merges[:, 0] << 32) | merges[:, 1], "rank": merges[:, 2]}),
                              ("vocabulary", {"id": list(self.vocabulary), "hex": [t.hex() for t in self.vocabulary.values()]})):
            rows = pa.table(columns)  # noqa: F841 - read by name below
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode_words(self, words: list[str]) -> None:
        """Fill the cache with the ids (little-endian unsigned 32-bit) of ``words``."""
        pending, cache = [], self.cache
        for word in words:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                cache[word] = rank.to_bytes(4, "little")
            elif len(raw) > LONG_WORD:
                cache[word] = np.array(self._contract_long(raw), dtype="<u4").tobytes()
            else:
                pending.append((word, raw))
        for part in _slices([max(len(raw) ** 2, ROWS_PER_QUERY // WORDS_PER_QUERY) for _, raw in pending], ROWS_PER_QUERY):
            some = pending[part]
            lengths = np.fromiter((len(raw) for _, raw in some), dtype=np.int64, count=len(some))
            starts = np.cumsum(lengths) - lengths
            flat = np.frombuffer(b"".join(raw for _, raw in some), dtype=np.uint8)
            start_rows = pa.table({  # noqa: F841 - read by name in the query
                "place": (np.repeat(256 * np.arange(len(some)) - starts, lengths) + np.arange(len(flat))).astype(np.int32),
                "tok": self.byte_ids[flat].astype(np.int32)})
            out = self.db.execute(ENCODE_SQL).fetchnumpy()
            ids = np.asarray(out["tok"]).astype("<u4").tobytes()
            ends = np.cumsum(np.bincount(np.asarray(out["word"]), minlength=len(some))) * 4
            at_byte = 0
            for (word, _), end in zip(some, ends.tolist()):
                cache[word] = ids[at_byte:end]
                at_byte = end

    def _pair(self, left: int, right: int) -> int | None:
        return self.ranks.get(self.vocabulary[left] + self.vocabulary[right])

    def _contract_long(self, raw: bytes) -> list[int]:
        toks = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)].tolist()
        n, pair = len(toks), self._pair
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pair(toks[i], toks[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i] if toks[i] >= 0 else n
            if j >= n or pair(toks[i], toks[j]) != rank:
                continue  # a pair that an earlier contraction has consumed
            toks[i], toks[j], right[i] = rank, -1, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := pair(rank, toks[right[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if left[i] >= 0 and (r := pair(toks[left[i]], rank)) is not None:
                heapq.heappush(heap, (r, left[i]))
        return [t for t in toks if t >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:  # two generations: words still in use come back from the older one
            self.cache, self.older = {}, self.cache
        missing = set(chain.from_iterable(words)).difference(self.cache)
        known = missing & self.older.keys()
        self.cache.update((w, self.older[w]) for w in known)
        if len(missing) > len(known):
            self._encode_words(sorted(missing - known))
        return [b"".join(map(self.cache.__getitem__, w)) for w in words]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids (given as little-endian unsigned 32-bit integers)."""
        lengths = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
        if len(flat) and int(flat.max()) not in self.vocabulary and not set(np.unique(flat).tolist()) <= self.vocabulary.keys():
            raise ValueError("an id is not in the vocabulary")
        doc = np.repeat(np.arange(len(ids)), lengths)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = [b""] * len(ids)
        for at in range(0, len(flat), ROWS_PER_DECODE):  # a very long list takes several queries
            part = slice(at, at + ROWS_PER_DECODE)
            token_rows = pa.table({"doc": doc[part], "pos": pos[part], "id": flat[part]})  # noqa: F841 - read by name in the query
            for d, raw in self.db.execute(DECODE_SQL).fetchall():
                out[d] += bytes(raw)
        return out


@lru_cache(maxsize=2)
def tokenizer(ranks_path: str, pattern: str) -> Tokenizer:
    return Tokenizer(ranks_path, pattern)


def _slices(sizes: list[int], limit: int) -> Iterator[slice]:
    """Cut a batch so that no slice but one of a single row exceeds ``limit``."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the token ids of each whole text as binary, four bytes an id, little-endian."""
    schema = df.select(id_col).schema.add("ids", "binary")

    def run(batches):
        tok = tokenizer(ranks_path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for s in _slices([len(t) for t in texts], 1 << 21):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[s], pa.array(tok.encode(texts[s]), pa.binary())], names=[id_col, "ids"])

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, decoded): the bytes that each list of ids (binary, four bytes an id) stands for."""
    names = [id_col, *keep]
    schema = df.select(*names).schema.add("decoded", "binary")

    def run(batches):
        tok = tokenizer(ranks_path, pattern)
        for b in batches:
            ids = [x or b"" for x in b.column(len(names)).to_pylist()]
            for s in _slices([len(x) for x in ids], 1 << 22):
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i)[s] for i in range(len(names))), pa.array(tok.decode(ids[s]), pa.binary())],
                    names=[*names, "decoded"])

    return df.select(*names, ids_col).mapInArrow(run, schema)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded): ``encode``, then ``decode`` of those ids, by one tokenizer in one pass."""
    schema = df.select(id_col).schema.add("ids", "binary").add("decoded", "binary")

    def run(batches):
        tok = tokenizer(ranks_path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for s in _slices([len(t) for t in texts], 1 << 20):
                ids = tok.encode(texts[s])
                yield pa.RecordBatch.from_arrays([b.column(0)[s], pa.array(ids, pa.binary()), pa.array(tok.decode(ids), pa.binary())],
                                                 names=[id_col, "ids", "decoded"])

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def digest(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and return per document: n_tokens, ids_sha256, decoded_sha256 (lowercase hex)."""
    both = encode_decode(df, ranks_path, pattern, id_col, text_col)
    return both.select(id_col, F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
