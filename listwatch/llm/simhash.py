"""SimHash near-duplicates by deletion-variant signatures (operator 2).

A text's fingerprint has 64 bits; bit b is set if more than half of its word
shingles' hashes have it set. Two fingerprints are linked if they differ in
at most ``max_bits`` bits. With ``max_bits // 2 + 1`` segments, one segment
of a linked pair differs in at most one bit, so the pair shares the variant
of that segment in which this bit is a wildcard. Distinct fingerprints are
indexed by all their one-wildcard segment variants, joined on equality of the
variant and verified on all 64 bits; links become components.

Equal fingerprints are folded before anything else, so groups of copies cost
one row. A variant shared by more than ``HOT`` distinct fingerprints is not
joined as it stands: the bits outside its segment are cut into segments and
indexed by one-wildcard variants again (the same argument holds for the rest),
so the join key then fixes both. Nothing is capped.

Defined cases: null, empty and blank texts have fingerprint zero and are
linked like any other; fewer words than the shingle length form one shingle;
rows with a null id are fingerprinted and linked, and a component without any
id has a null component_id; repeated rows each get their row; texts of any
length are read whole; other columns, whatever their names, are passed on by
``one_of_each`` and not read otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, MapType, StructType

from listwatch.llm.common import Scratch, connected_components, every

SEED = 42
HOT = 256
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Unsigned 64-bit fingerprint of one UTF-8 text. ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at
    the six ASCII white-space bytes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    last = max(len(words) - shingle, 0)
    starts = (ends - lengths)[:last + 1].tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])]
        bits = np.unpackbits(np.array(some, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts)).view(">u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, fp): fp is the fingerprint's bits as a signed long."""
    names = [id_col, *keep]
    schema = df.select(*names).schema.add("fp", "long")

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(len(names)).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(names))), pa.array(fps.view(np.int64))], names=[*names, "fp"])

    return df.select(*names, F.col(text_col).cast("binary")).mapInArrow(run, schema)


def _masks(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` cut into ``parts`` runs of nearly equal length."""
    return [x.tolist() for x in np.array_split(np.array(bits), parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(fp: Column, segments: list[list[int]]) -> Column:
    """One struct for each segment bit: the bit that is wild, and the segment without it."""
    out = []
    for seg in segments:
        whole = sum(1 << b for b in seg)
        out += [F.struct(F.lit(b).alias("wild"), fp.bitwiseAND(F.lit(_signed(whole & ~(1 << b)))).alias("rest")) for b in seg]
    return F.explode(F.array(*out))


def _first_shared(segments: list[list[int]], x: Column, wild: Column) -> Column:
    """Of the variants of one segment that a pair shares, exactly one counts: the wildcard at the bit in which the
    segments differ, or at the segment's first bit if they don't. ``x``: the bits in which the pair differs."""
    whole = F.element_at(F.create_map(*[F.lit(v) for seg in segments for b in seg
                                        for v in (b, _signed(sum(1 << i for i in seg)))]), wild)
    return (x.bitwiseAND(whole) != 0) | wild.isin([seg[0] for seg in segments])


def _pairs(index: DataFrame, keys: list[str], segments: list[list[int]], max_bits: int) -> DataFrame:
    # sorted and merged: an index is far larger than Spark's guess, which takes no account of exploded rows, so it could be broadcast
    a = index.select(*keys, F.col("fp").alias("a")).hint("merge")
    b = index.select(*keys, F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    return a.join(b, keys).where((F.col("a") > F.col("b")) & (F.bit_count(x) <= max_bits)
                                 & _first_shared(segments, x, F.col("wild"))).select("a", "b")


def links(distinct: DataFrame, max_bits: int, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(a, b): the pairs of distinct fingerprints (column fp) that differ in at most ``max_bits`` bits."""
    parts = max_bits // 2 + 1
    segments = _masks(list(range(64)), parts)
    index = distinct.select("fp", _variants(F.col("fp"), segments).alias("v")).select("fp", "v.wild", "v.rest")
    crowded = scratch.save(index.groupBy("wild", "rest").count().where(F.col("count") > hot)
                           .select("wild", "rest"), "crowded")
    found = _pairs(index.join(crowded, ["wild", "rest"], "left_anti"), ["wild", "rest"], segments, max_bits)
    # crowded variants: index the bits outside the segment by one-wildcard variants as well
    for seg in segments if parts > 1 else []:  # a single segment's variant is shared by two fingerprints at most
        others = _masks([b for b in range(64) if b not in seg], parts)
        # a pair's other bits differ in max_bits at most, so one of `parts` runs of them differs in one at most
        sub = (index.join(crowded.where(F.col("wild").isin(seg)), ["wild", "rest"], "left_semi")
               .select("fp", F.col("wild").alias("wild1"), F.col("rest").alias("rest1"),
                       _variants(F.col("fp"), others).alias("v")).select("fp", "wild1", "rest1", "v.wild", "v.rest"))
        a_b = _pairs(sub, ["wild1", "rest1", "wild", "rest"], others, max_bits)
        found = found.unionByName(a_b)
    return found


def components(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               max_bits: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, fp, root, component_id) for each row: component_id is the smallest id linked through any chain,
    root the component's smallest fingerprint."""
    fps = scratch.save(fingerprints(df, id_col, text_col, shingle, keep), "fingerprints")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = connected_components(links(distinct, max_bits, scratch), scratch)
    linked = roots.join(distinct, roots["node"] == distinct["fp"]).select("node", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    of_fp = distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return fps.join(of_fp, "fp").select(id_col, *keep, "fp", "root", "component_id")


def one_of_each(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                max_bits: int = 2) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row of smallest id (nulls last; ties: smallest
    hash of the row), once if it is repeated. All columns stay as they are."""
    row = F.struct(*every(df))
    keyed = df.select(row.alias("row"), *_row_keys(df), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = components(keyed, scratch, "id", "text", shingle, max_bits, keep=("key1", "key2"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key1", "key2")).alias("first"))
    kept = scratch.save(first.select("first.key1", "first.key2").distinct(), "kept")
    again = F.row_number().over(W.partitionBy("key1", "key2").orderBy("key1"))  # repeated rows meet here, they are equal
    return (keyed.select("key1", "key2", "row").join(kept, ["key1", "key2"], "left_semi")
            .withColumn("nth", again).where("nth = 1").select("row.*"))


def _row_keys(df: DataFrame) -> list[Column]:
    """96 bits that tell rows apart; equal rows have equal keys. Hashes pass over nulls, so these go in as flags."""
    parts = [F.to_json(F.struct(c)) if isinstance(f.dataType, (MapType, StructType, ArrayType)) else c
             for f, c in zip(df.schema.fields, every(df))]
    flags = [c.isNull() for c in every(df)]
    return [F.xxhash64(*parts, *flags).alias("key1"), F.hash(*parts, *flags).alias("key2")]


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
