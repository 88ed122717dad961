"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of their input, extra columns included.

1. language_id   - trains on the documents it is given, drops those without a recognisable language
2. near_duplicates - keeps one document of each SimHash component
3. secrets       - replaces found secrets in the text, keeps every document
4. mix           - samples documents by raked probabilities
5. tokenize      - encodes the texts, decodes the ids, returns both

ORACLE_SQL is None: no stage but the fourth can be said in SQL. tests/llm holds
the pipeline against a plain Python version instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwatch.llm import bpe, langid, mixing, secrets, simhash
from listwatch.llm.common import Scratch, every
from listwatch.llm.queries import MIX, RANKS

#: Mean probability below which no language is recognised; with more than four languages, that many times an equal share.
LEAST_SCORE, TIMES_EQUAL = 0.35, 1.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null, has no letter, or has no language of ``least_score`` or more."""
    Scratch(spark, "pipeline-langid")
    net = langid.fit(docs)
    rows = docs.select(F.struct(*every(docs)).alias("row"))
    out = langid.predict(rows, net, "row.text", keep=("row",))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score(len(net.langs)))).select("row.*")


def least_score(n_langs: int) -> float:
    return min(LEAST_SCORE, TIMES_EQUAL / max(n_langs, 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component of fingerprints within 2 bits (3-word shingles)."""
    return simhash.one_of_each(docs, Scratch(spark, "pipeline-simhash"), shingle=3, max_bits=2)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a placeholder; n_chars follows the text."""
    scratch = Scratch(spark, "pipeline-secrets")
    clean = secrets.redact(docs, secrets.scan(docs, scratch))
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    changed = F.col("text").contains(secrets.PLACEHOLDER)
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that kept tokens have the tempered shares of sources, languages and topics."""
    return mixing.mix(docs, MIX, Scratch(spark, "pipeline-mix")).where("kept = 1").select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, text): ids are little-endian unsigned 32-bit, text is decoded from them."""
    Scratch(spark, "pipeline-bpe")
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    out = bpe.encode_decode(docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text"), path, pattern, id_col="row")
    return out.select("row.doc_id", "row.lang", "row.source", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
                      "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mix", mix),
    ("tokenize", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
