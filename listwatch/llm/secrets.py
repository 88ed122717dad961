"""Secret scan with a random forest for false-positive removal (operator 3).

Candidates are runs of key characters and values assigned to a name. Each
candidate is described by its length and character classes, by transitions
between character classes and between letters, by how much of it the corpus's
own dictionary covers, by its path (the source) and by its neighbouring words.
A random forest trained from labelled findings keeps the secrets.

Everything runs as DataFrame and SQL functions: ``split`` and
``regexp_extract_all`` give the pieces between candidates and the candidates of
a text, in step, so places and neighbours need no second search; the forest is
Spark's own. The dictionary counts the words of all documents; its
``DICTIONARY`` most frequent words and their letter pairs are bounded and go
into the plan as sets. The forest learns from ``TRAIN_ROWS`` findings of each label at
most, those of smallest hash.

Labelled findings are any DataFrame of features and a label. Where nobody has
labelled any, ``weak_labels`` labels those that a format settles: values of a
published key format, or mixed letters and digits assigned to a credential's name, are
secrets; plain words and numbers are not, nor mixed values after a word like commit or checksum; the rest
stays unlabelled and is left to the forest.

Defined cases: null and empty texts have no candidates; a null path has the
features of an empty one; repeated rows each give their findings; without
findings of both labels only values of a published key format are reported as secrets (score 1, others 0).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwatch.llm.common import Scratch, every, private, smallest

DICTIONARY = 3000
#: Lengths of dictionary words.
WORD_LENGTHS = (3, 4, 5, 6)
TRAIN_ROWS = 5000
TREES = 20
DEPTH = 6
#: Score from which a finding is a secret.
THRESHOLD = 0.5
PLACEHOLDER = "[SECRET]"

#: Where a value of 8 characters may begin; a cheap test before the long ones.
BEGIN = r"""(?<=[=:>\s"'`])(?=[^\s"'<>]{8})"""
#: What stands between a name's last character and a value assigned to it: closing quotes or brackets, blanks, = : := => and the
#: like, blanks, an opening quote.
ASSIGNED = r"""(?<=[=:>]\s{0,16}["'`]?)(?<=\w["'`\])]{0,2}\s{0,16}[=:]{1,3}>?\s{0,16}["'`]?)(?:(?<=["'`])|(?![=:]))[^\s"'<>]{8,}"""
#: A value alone between an opening and a closing tag.
TAGGED = r"""(?<=>\s{0,16})(?<=<[\w.:\-]{1,64}(?:\s[^<>]{0,64})?>\s{0,16})[^\s"'<>]{8,}(?=\s{0,16}</)"""
#: A run of key characters of 16 or more, or 8 or more characters assigned to a name or in a tag.
CANDIDATE = rf"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{{16,}}={{0,2}}|{BEGIN}(?:{ASSIGNED}|{TAGGED})"
# Published formats of keys
KEY_FORMATS = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_live_[A-Za-z0-9]{20,}$|^AIza[A-Za-z0-9_\-]{35}$|^eyJ[A-Za-z0-9_\-]{10,}$"
CREDENTIAL = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
HARMLESS = r"(?i)(example|sample|dummy|fake|placeholder|test|mock|sha1|sha256|md5|checksum|commit|digest|uuid|hash)"
#: Names of values that look like keys and are none.
FINGERPRINT = r"(?i)(?<![\p{L}\p{N}])(sha-?\d*|md5|commit|revision|checksum|digest|hash|etag|uuid|guid)(?![\p{L}\p{N}])"
PATH_HINT = r"(?i)(test|example|sample|mock|fixture|doc|spec)"

FEATURES = ("n", "digits", "upper", "lower", "other", "distinct", "class_changes", "letter_pairs", "coverage", "longest_word",
            "is_hex", "path_hint", "path_depth", "path_length", "credential_before", "harmless_near", "assigned", "quoted", "words_before",
            "words_after")


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> tuple[list[str], list[str]]:
    """The most frequent short words over all documents, and their most frequent letter pairs."""
    word = F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word")
    counted = (docs.select(word).where(F.length("word").between(WORD_LENGTHS[0], WORD_LENGTHS[-1]))
               .groupBy("word").count().orderBy(F.desc("count"), "word").limit(size))
    words = [r["word"] for r in counted.collect()]
    pairs: dict[str, int] = {}
    for w in words:
        for a, b in zip(w, w[1:]):
            pairs[a + b] = pairs.get(a + b, 0) + 1
    return words, sorted(sorted(pairs), key=lambda p: -pairs[p])[:250]


def _share(value: str, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def candidates(docs: DataFrame, words: list[str], pairs: list[str], id_col: str = "doc_id", text_col: str = "text",
               path_col: str = "source") -> DataFrame:
    """One row a candidate: id_col, text_key (hash of the text), nth, start (from 1), value, FEATURES."""
    text = F.col(text_col).cast("string")
    cut = docs.where(text.rlike(CANDIDATE)).select(
        F.col(id_col), F.xxhash64(text).alias("text_key"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.split(text, CANDIDATE, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"))
    near = cut.select(id_col, "text_key", "path", F.posexplode(F.arrays_zip(
        "found", F.slice("gaps", F.lit(1), F.size("found")).alias("before"), F.slice("gaps", F.lit(2), F.size("found")).alias("after"),
        F.transform(F.sequence(F.lit(1), F.size("found")), lambda i: F.aggregate(
            F.slice("gaps", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(
            F.slice("found", F.lit(1), i - 1), F.lit(0), lambda a, x: a + F.length(x)) + 1).alias("start"))).alias("nth", "c"))
    rows = near.select(id_col, "text_key", "path", "nth", F.col("c.start").alias("start"), F.col("c.found").alias("value"),
                       # neighbours: up to three words on either side
                       F.substring_index(F.regexp_replace("c.before", r"\s+", " "), " ", -4).alias("before"),
                       F.substring_index(F.regexp_replace("c.after", r"\s+", " "), " ", 4).alias("after"))
    value = F.col("value")
    low = F.lower("value")
    n = F.length("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        value, r"[^\p{L}\p{N}]", "#"), r"\p{Lu}", "U"), r"\p{L}(?<!U)", "l"), r"\p{N}", "0")
    begins = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))

    def covered(i):
        hit = F.lit(False)
        for length in WORD_LENGTHS:
            of_length = [w for w in words if len(w) == length]
            if of_length:
                hit = hit | low.substr(i, F.lit(length)).isin(of_length)
        return hit

    near_words = F.concat_ws(" ", "before", "after")
    features = {
        "n": F.log1p(n), "digits": _share("value", r"[^0-9]"), "upper": _share("value", r"[^\p{Lu}]"),
        "lower": _share("value", r"[^\p{Ll}]"), "other": _share("value", r"[\p{L}\p{N}]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "class_changes": F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / n,
        "letter_pairs": F.size(F.filter(begins, lambda i: low.substr(i, F.lit(2)).isin(pairs or [""]))) / F.size(begins),
        "coverage": F.size(F.filter(begins, covered)) / F.size(begins),
        "longest_word": F.array_max(F.transform(F.split(value, r"[^\p{L}]+"), lambda w: F.length(w))) / n,
        "is_hex": value.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("int"),
        "path_hint": F.col("path").rlike(PATH_HINT).cast("int"),
        "path_depth": F.size(F.split("path", "/")), "path_length": F.length("path"),
        "credential_before": F.col("before").rlike(CREDENTIAL).cast("int"),
        "harmless_near": near_words.rlike(HARMLESS).cast("int"),
        "assigned": F.col("before").rlike(r"""[=:]>?\s*["'`]?$|<[\w.:\-]+(\s[^<>]*)?>\s*$""").cast("int"),
        "quoted": F.col("before").rlike(r"""["'`]$""").cast("int"),
        "words_before": F.size(F.split(F.trim("before"), " ")), "words_after": F.size(F.split(F.trim("after"), " ")),
    }
    return rows.select(id_col, "text_key", "nth", "start", "value", "before",
                       *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in features.items()))


def weak_labels() -> Column:
    """1: a format or a credential's name settles it; 0: a plain word or number, or mixed after a FINGERPRINT word; null: open."""
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike(r"\p{L}")
    named = (F.col("credential_before") == 1) & (F.col("assigned") == 1) & mixed & (F.col("harmless_near") == 0)
    fingerprint = mixed & F.col("before").rlike(FINGERPRINT) & (F.col("credential_before") == 0)
    return (F.when(F.col("value").rlike(KEY_FORMATS) | named, 1).when(fingerprint, 0)
            .when(F.col("value").rlike(r"^[\p{L}_\-/+]+$|^[0-9\-]+$") & (F.col("assigned") == 0), 0))


def train(labelled: DataFrame, scratch: Scratch, limit: int = TRAIN_ROWS):
    """Fit the forest on ``limit`` rows of each label (the columns of ``candidates`` and label); None without both. Findings of
    equal value and features count once."""
    rows = (labelled.where(F.col("label").isNotNull()).select(F.col("label").cast("double").alias("label"), "value", *FEATURES).distinct()
            .select("label", F.xxhash64("value", *FEATURES).alias("key"), *FEATURES))
    parts = [smallest(rows.where(F.col("label") == y), "key", limit) for y in (0.0, 1.0)]
    # a bounded set in one sorted partition: the forest's draws then don't depend on how the rows were dealt
    sample = scratch.save(parts[0].unionByName(parts[1]).repartition(1).sortWithinPartitions("key", "label"), "findings")
    if len(sample.select("label").distinct().collect()) < 2:
        return None
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=11)
    return forest.fit(_assembler().transform(sample))


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="x")


def score(found: DataFrame, model) -> DataFrame:
    """The candidates with score and is_secret."""
    if model is None:
        scored = found.withColumn("score", F.col("value").rlike(KEY_FORMATS).cast("double"))
    else:
        scored = (model.transform(_assembler().transform(found))
                  .withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction"))
    return scored.withColumn("is_secret", (F.col("score") >= THRESHOLD).cast("int"))


def scan(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
         label: Column | None = None) -> DataFrame:
    """All candidates of ``docs`` scored by a forest trained on those that ``label`` (default: weak_labels) labels."""
    words, pairs = dictionary(docs, text_col)
    found = scratch.save(candidates(docs, words, pairs, id_col, text_col, path_col), "candidates")
    model = train(found.withColumn("label", weak_labels() if label is None else label), scratch)
    return score(found, model)


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets of ``findings`` replaced by PLACEHOLDER."""
    id_, key, nth = private(docs, "_id", "_key", "_nth")
    flagged = (findings.where("is_secret = 1").groupBy(F.col(id_col).alias(id_), F.col("text_key").alias(key))
               .agg(F.collect_set("nth").alias(nth)))  # no more than one text's candidates
    text = F.col(text_col).cast("string")
    gaps, found = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), F.size(found)), lambda i: F.concat(
        F.get(gaps, i), F.when(F.array_contains(F.col(nth), i), PLACEHOLDER).otherwise(F.coalesce(F.get(found, i), F.lit("")))))
    joined = docs.join(flagged, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(key)), "left")
    return joined.select(*(F.when(F.col(nth).isNotNull(), F.concat_ws("", pieces)).otherwise(c).alias(name) if name == text_col else c
                           for name, c in zip(docs.columns, every(docs))))
