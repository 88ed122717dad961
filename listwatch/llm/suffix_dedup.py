"""Removal of repeated passages by blockwise suffix sorting with cover samples (operator 9).

Every byte covered by a ``WINDOW``-byte string that also starts anywhere else
in the corpus is removed. The suffixes that can matter are few, so the sort
is cut into independent buckets and fed with these only:

1. Equal texts are folded: a text of WINDOW bytes or more that occurs twice is removed
   whole, and one copy of it goes on as a witness for the others.
2. Each window is assigned to one *anchor*, the GRAM-byte string inside it with the
   smallest hash (leftmost, if tied). Equal windows have equal anchors at
   equal distance, so windows can only be equal within the bucket of one
   anchor string. Neighbouring windows share an anchor: about one row per
   hundred bytes leaves the task.
3. Anchors that occur once end here. Occurrences whose whole *context* (all
   bytes of the windows of one anchor) is equal are folded by hash before
   anything is gathered; they are repeated as they are.
4. The remaining distinct contexts are dealt by anchor, and each task sorts one
   bucket (or a batch of small ones) at a time: suffixes are
   compared by their first PERIOD bytes, long ties by ranks of the sampled
   suffixes, computed beforehand by doubling, and the last PERIOD bytes.
   Contexts are laid out with their anchors on multiples of PERIOD; equal
   suffixes then agree in their place modulo PERIOD, the only difference that
   the cover has to serve is 0, and one sample per PERIOD bytes is a difference cover.
   Suffixes next to each other with all keys equal are the repeats.
5. The repeated runs of windows of a text are merged and cut out in one pass.

Memory: a task holds one batch of buckets. A bucket of more than ``CROWDED``
distinct contexts is dealt again, by the bytes that all windows of a
short stretch of starts have in common, so its parts differ only at their ends.

Defined cases: a null text is an empty one; texts shorter than WINDOW lose
nothing; a row with a null or repeated id is an occurrence like any other and
gets its own row of results.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwatch.llm.common import Scratch

WINDOW = 400
#: Bytes of an anchor.
GRAM = 128
#: Distance of the cover's samples.
PERIOD = 16
#: Bytes whose ranks the samples have; with PERIOD bytes before and after they span a window.
RANKED = WINDOW - PERIOD
#: Window starts of one piece of a long text.
SEGMENT = 1 << 19
#: Distinct contexts of one anchor beyond which its bucket is dealt again, in stretches of STRETCH window starts.
CROWDED = 20_000
STRETCH = 16
#: Bytes of contexts sorted at once.
BATCH_BYTES = 4 << 20

_PLACE = (1 << 20) - 1
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, SEGMENT + WINDOW + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), SEGMENT + WINDOW + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums whose differences, scaled back, hash any substring."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[:len(raw)], out=sums[1:])
    return sums


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    n, step, out = len(x) - width + 1, 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[:n], out[width - step:width - step + n])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: first window start, number of windows, distance of the anchor from the first start, hash of
    the anchor's bytes, hash of the context (all bytes of these windows, and their number)."""
    parts = []
    for at in range(0, max(len(raw) - WINDOW + 1, 0), SEGMENT):
        piece = raw[at:at + SEGMENT + WINDOW - 1]
        sums = _prefix_sums(piece)
        n = len(piece) - GRAM + 1
        h = _mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[:n])
        ordered = (h & ~np.uint64(_PLACE)) | np.arange(n, dtype=np.uint64)  # equal hashes: the leftmost
        place = (sliding_min(ordered, WINDOW - GRAM + 1) & np.uint64(_PLACE)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        count = np.diff(np.append(first, len(place)))
        context = (sums[first + count + WINDOW - 1] - sums[first]) * _DOWN[first]
        parts.append((first + at, count, place[first] - first, h[place[first]],
                      _mix(context ^ _mix(count.astype(np.uint64)))))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _pack(start, count, offset):
    return (start << 20) | (count << 10) | offset


def _unpack(at):
    return at >> 20, (at >> 10) & 1023, at & 1023


def _names(*keys: np.ndarray) -> np.ndarray:
    """Rank of each row of the given key columns, equal rows equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_bucket(contexts: list[bytes], counts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sort the suffixes that start a window of the given contexts.

    Context i has ``counts[i]`` windows, from its first byte on, and its anchor
    at ``offsets[i]``. Returns, in suffix order within each place modulo
    PERIOD: the context and start of each suffix, whether its first WINDOW bytes equal those of
    the suffix before it, and whether the place modulo PERIOD is a new one.
    """
    lengths = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    # each context starts so that its anchor falls on a multiple of PERIOD
    lead = (-offsets) % PERIOD
    room = -(-(lead + lengths) // PERIOD) * PERIOD
    base = np.cumsum(room) - room
    total = int(room.sum())
    text = np.zeros(total + WINDOW + PERIOD, dtype=np.uint8)
    for b, c in zip((base + lead).tolist(), contexts):
        text[b:b + len(c)] = np.frombuffer(c, np.uint8)
    eight = np.ndarray(len(text) - 7, dtype=">u8", buffer=text, strides=(1,))

    # ranks of the samples, over 16, 32, 64, 128 and 256 bytes, then over RANKED = 256 + 128
    sample = np.arange(0, total, PERIOD)
    rank = _names(eight[sample].astype(np.uint64), eight[sample + 8].astype(np.uint64))
    ranks, reach = {PERIOD: rank}, PERIOD
    while reach * 2 <= RANKED:
        step = reach // PERIOD
        rank = _names(rank, np.append(rank[step:], np.full(min(step, len(rank)), -1)))
        reach *= 2
        ranks[reach] = rank
    while reach < RANKED:
        more = max(k for k in ranks if k <= RANKED - reach)
        step = reach // PERIOD
        rank = _names(rank, np.append(ranks[more][step:], np.full(min(step, len(rank)), -1)))
        reach += more

    owner = np.repeat(np.arange(len(contexts)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (base + lead)[owner] + start
    residue = at % PERIOD
    keys = (residue, eight[at].astype(np.uint64), eight[at + 8].astype(np.uint64),
            rank[(at + (-at) % PERIOD) // PERIOD],
            eight[at + WINDOW - PERIOD].astype(np.uint64), eight[at + WINDOW - 8].astype(np.uint64))
    order = np.lexsort(keys[::-1])
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    for k in keys:
        k = k[order]
        same[1:] &= k[1:] == k[:-1]
    fresh = np.diff(residue[order], prepend=-1) != 0
    return owner[order], start[order], same, fresh


def repeats(contexts: list[bytes], counts: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Starts, within each context, of the windows that occur more than once in the bucket."""
    owner, start, same, _ = sort_bucket(contexts, counts, offsets)
    again = same | np.append(same[1:], False)
    owner, start = owner[again], start[again]
    order = np.lexsort((start, owner))
    return np.split(start[order], np.searchsorted(owner[order], np.arange(1, len(contexts))))


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of the maximal runs of ascending integers."""
    first = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    return starts[first], np.diff(np.append(first, len(starts)))


def _text_keys(text: Column) -> list[Column]:
    """120 bits of the text's SHA-1, as two longs."""
    sha = F.sha1(text)
    return [F.conv(F.substring(sha, 1, 15), 16, 10).cast("long").alias("k1"),
            F.conv(F.substring(sha, 16, 15), 16, 10).cast("long").alias("k2")]


def _find_anchors(texts: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            found = [_fold(*anchors(np.frombuffer(t, np.uint8))) for t in b.column(2).to_pylist()]
            n = [len(f[0]) for f in found]
            gram, context, at, times = (np.concatenate([f[i] for f in found]) for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (gram.view(np.int64), context.view(np.int64), np.repeat(k1, n), np.repeat(k2, n), at, times)],
                names=["gram", "context", "k1", "k2", "at", "times"])

    return texts.mapInArrow(run, "gram long, context long, k1 long, k2 long, at long, times long")


def _fold(start, count, offset, gram, context) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, context, packed place, times): neighbours of equal context, as in a long run of one byte, in one row."""
    first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])])[:len(gram)])
    times = np.diff(np.append(first, len(gram)))
    return gram[first], context[first], _pack(start, count, offset)[first], times


def _cut_contexts(wanted: DataFrame) -> DataFrame:
    """From (k1, k2, text, wants: array of (gram, at, single, crowded)) the rows to be dealt to the buckets."""
    names = ["bucket", "k1", "k2", "at", "single", "bytes"]

    def pieces(raw, gram, at, crowded):
        start, count, offset = _unpack(at)
        if not crowded:
            yield gram, at, raw[start:start + count + WINDOW - 1]
            return
        # stretches of window starts, fixed by their distance from the anchor; `core` is what all windows of one hold
        place = start + offset
        while count > 0:
            ahead = place - start
            low = ahead - ahead % STRETCH
            n = min(count, ahead - low + 1)
            core = raw[place - low:place - low - STRETCH + 1 + WINDOW]
            key = (gram & ((1 << 64) - 1)) ^ xxhash.xxh64_intdigest(core, low)
            yield _signed(key), _pack(start, n, ahead), raw[start:start + n + WINDOW - 1]
            start += n
            count -= n

    def run(batches):
        for b in batches:
            out = []
            for k1, k2, raw, wants in zip(*(b.column(i).to_pylist() for i in range(4))):
                for w in wants:
                    out += [(key, k1, k2, at, w["single"], part) for key, at, part in pieces(raw, w["gram"], w["at"], w["crowded"])]
                if len(out) >= 2048:
                    yield _context_rows(out, names)
                    out = []
            if out:
                yield _context_rows(out, names)

    return wanted.mapInArrow(run, "bucket long, k1 long, k2 long, at long, single boolean, bytes binary")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _context_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _sort_buckets(contexts: DataFrame) -> DataFrame:
    """Runs of repeated windows (k1, k2, first, n) of the single contexts; rows come sorted by bucket."""

    def work(rows):
        at = np.array([r[3] for r in rows], dtype=np.int64)
        start, count, offset = _unpack(at)
        out = ([], [], [], [])
        for r, s, found in zip(rows, start.tolist(), repeats([r[5] for r in rows], count, offset)):
            if r[4] and len(found):
                for first, n in zip(*(x.tolist() for x in _runs(found))):
                    for column, value in zip(out, (r[1], r[2], s + first, n)):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["k1", "k2", "first", "n"])

    def run(batches):
        rows, size = [], 0  # whole buckets, then the last one, which may go on
        begin = 0           # of the last bucket
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if rows and r[0] != rows[-1][0]:
                    if size >= BATCH_BYTES:
                        yield work(rows)
                        rows, size = [], 0
                    begin = len(rows)
                rows.append(r)
                size += len(r[5])
            if size >= 4 * BATCH_BYTES and begin:  # a large bucket has begun: sort what is complete
                yield work(rows[:begin])
                rows = rows[begin:]
                size, begin = sum(len(r[5]) for r in rows), 0
        if rows:
            yield work(rows)

    return contexts.mapInArrow(run, "k1 long, k2 long, first long, n long")


def cut(raw: bytes, first: np.ndarray, n: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, bytes kept) for runs of repeated windows."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate((first + n + WINDOW - 1)[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    begin, end = begin[new], end[np.append(new[1:], len(end)) - 1]
    kept = b"".join(raw[a:b] for a, b in zip(np.append(0, end).tolist(), np.append(begin, len(raw)).tolist()))
    return len(raw) - len(kept), len(begin), kept


def _cut_texts(texts: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            for k1, k2, raw, runs in zip(*(b.column(i).to_pylist() for i in range(4))):
                removed, spans, kept = cut(raw, np.array([r["first"] for r in runs]), np.array([r["n"] for r in runs]))
                out.append((k1, k2, removed, spans, kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types)],
                                             names=["k1", "k2", "n_removed", "n_spans", "kept"])

    return texts.mapInArrow(run, "k1 long, k2 long, n_removed long, n_spans long, kept binary")


def _search(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, crowded: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (id, text, n_bytes and the text's keys); the keys of texts that are removed whole; and of the other
    texts that lose something: keys, n_removed, n_spans, kept."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), raw.alias("text"), F.length(raw).cast("long").alias("n_bytes"), *_text_keys(raw))
    keys = ["k1", "k2"]
    long_rows = rows.where(F.col("n_bytes") >= WINDOW)
    copies = scratch.save(long_rows.groupBy(*keys).agg(F.count("*").alias("copies"), F.min("id").alias("least"))
                          .where("copies > 1").select(*keys, "least"), "copies")
    # one witness of each text; where no id tells copies apart they all stay, which costs work only
    texts = (long_rows.join(copies, keys, "left").where(F.col("least").isNull() | (F.col("id") == F.col("least")))
             .select(*keys, "text"))

    # read twice and then no more: kept as blocks on the executors' disks. Files on a local store start three helper
    # processes each, which share the executor's memory for a moment and are counted as holding all of it
    found = _find_anchors(texts).persist(StorageLevel.DISK_ONLY)
    grams = scratch.save(found.groupBy("gram").agg(F.sum("times").alias("n")).where("n > 1").select("gram"), "grams")
    hits = scratch.save(found.join(grams, "gram", "left_semi"), "hits")
    found.unpersist()

    contexts = scratch.save(hits.groupBy("gram", "context").agg(
        F.sum("times").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one")), "contexts")
    buckets = (contexts.groupBy("gram").agg(F.count("*").alias("size"), F.count_if(F.col("n") == 1).alias("singles"))
               .where("size > 1 and singles > 0").select("gram", (F.col("size") > crowded).alias("crowded")))
    wants = (contexts.join(buckets, "gram").select("one.k1", "one.k2", F.struct(
        "gram", "one.at", (F.col("n") == 1).alias("single"), "crowded").alias("want"))
        .groupBy(*keys).agg(F.collect_list("want").alias("wants")))  # no more than one text's anchors
    dealt = _cut_contexts(texts.join(wants, keys).select(*keys, "text", "wants"))
    sorted_runs = _sort_buckets(dealt.repartition("bucket").sortWithinPartitions("bucket"))

    unpacked = [F.shiftright("at", 20).alias("first"), (F.shiftright("at", 10).bitwiseAND(F.lit(1023)) * F.col("times")).alias("n")]
    folded = contexts.where("n > 1").select("gram", "context")
    runs = hits.join(folded, ["gram", "context"], "left_semi").select(*keys, *unpacked).unionByName(sorted_runs)
    runs = scratch.save(runs.groupBy(*keys).agg(F.collect_list(F.struct("first", "n")).alias("runs")), "runs")
    done = _cut_texts(texts.join(runs, keys).select(*keys, "text", "runs"))
    return rows, copies.select(*keys, F.lit(True).alias("is_copy")), done.dropDuplicates(keys)


def remove_repeats(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                   crowded: int = CROWDED) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept): kept is what is left of each text, as binary."""
    rows, copies, done = _search(df, scratch, id_col, text_col, crowded)
    return _results(rows.withColumnRenamed("text", "whole"), copies, done, id_col,
                    F.coalesce("kept", "whole"), F.lit("").cast("binary")).withColumnRenamed("left", "kept")


def digest(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
           crowded: int = CROWDED) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, removed_share) for each row; the share of an empty text is 0."""
    rows, copies, done = _search(df, scratch, id_col, text_col, crowded)
    # texts stay where they are: only their digests meet the results
    out = _results(rows.select("id", "k1", "k2", "n_bytes", F.sha2("text", 256).alias("whole")), copies,
                   done.withColumn("kept", F.sha2("kept", 256)), id_col,
                   F.coalesce("kept", "whole"), F.sha2(F.lit("").cast("binary"), 256)).withColumnRenamed("left", "kept_sha256")
    return out.withColumn("removed_share", F.col("n_removed") / F.greatest("n_bytes", F.lit(1)))


def _results(rows: DataFrame, copies: DataFrame, done: DataFrame, id_col: str, left: Column, nothing: Column) -> DataFrame:
    return (rows.join(copies, ["k1", "k2"], "left").join(done, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(F.col("is_copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("is_copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("is_copy"), nothing).otherwise(left).alias("left")))
