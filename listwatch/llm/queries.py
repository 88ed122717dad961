"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwatch.llm import audit, bm25, bpe, langid, mixing, pieces, secrets, simhash, spelling, suffix_dedup, toxicity, vptree, warc
from listwatch.llm.common import Scratch

#: The rank file of the byte-level BPE queries.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The model of the SentencePiece query.
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), Scratch(spark, "vptree"), k=20, factor=5.0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"), shingle=3, max_bits=2)
    return out.select("doc_id", simhash.hex_digits(out["fp"]).alias("fingerprint"), "component_id")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), Scratch(spark, "secrets"))
    return out.select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"),
                      "score", "is_secret")


#: Target shares of each margin: its actual token shares, tempered.
MIX = {"source": 0.95, "lang": 0.9, "topic": 0.95}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = mixing.mix(docs, MIX, Scratch(spark, "mixing"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


#: op5: documents, or benchmark items, whose id is divisible by this are the queries.
QUERY_EVERY = 50


def op5_bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "bm25-documents"), table(spark, sf_dir, "documents").select("doc_id", "text")
    index = scratch.save(bm25.build(docs), "index")
    return bm25.search_blocks(index, docs.where(F.col("doc_id") % QUERY_EVERY == 0), scratch, "doc_id", "text", k=20)


def op5_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "bm25")
    index = scratch.save(bm25.build(table(spark, sf_dir, "documents")), "index")
    asked = table(spark, sf_dir, "benchmark").where(F.col("item_id") % QUERY_EVERY == 0)
    return bm25.search(index, asked, scratch, "item_id", "text", k=20)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    Scratch(spark, "langid")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()))
    out = langid.predict(docs, net)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    Scratch(spark, "bpe")
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"), Scratch(spark, "suffix"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out_of_fold = table(spark, sf_dir, "documents").select("doc_id", "text"), langid.held_out("doc_id", 3, 1)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~out_of_fold, Scratch(spark, "toxicity"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", out_of_fold.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), Scratch(spark, "spelling"), every=31, least=7, occurrences=2, ratio=10)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), Scratch(spark, "audit"), least_docs=3, top=200)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    Scratch(spark, "pieces")
    return pieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vptree": op1_vptree,
    "op2_simhash": op2_simhash,
    "op3_secrets": op3_secrets,
    "op4_mixing": op4_mixing,
    "op5_bm25_documents": op5_bm25_documents,
    "op5_bm25": op5_bm25,
    "op6_langid": op6_langid,
    "op7_bpe": op7_bpe,
    "op8_warc": op8_warc,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_spelling": op11_spelling,
    "op12_divergence": op12_divergence,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLES: dict[str, str] = {
    "op4_mixing": mixing.oracle(MIX),
    "op5_bm25_documents": bm25.oracle_documents(20, QUERY_EVERY),
    "op5_bm25": bm25.oracle(20, QUERY_EVERY),
    "op8_warc": warc.ORACLE,
    "op12_divergence": audit.ORACLE,
}
