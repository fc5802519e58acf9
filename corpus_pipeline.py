"""Four stages from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before it kept. All but the last return the columns of ``documents``, and any
others that came in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordgraph.llm import langid, minhash, packing, pii
from fjordgraph.storage import cut

#: Key of the surrogates where ``FJORDGRAPH_PII_KEY`` has none; for tests only, as
#: who has the key can invert them.
TEST_KEY = "not a secret: test tables only"
#: Least share of the best language; undetermined texts go whatever their score.
MIN_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that are clearly in one of the corpus's languages.

    Null texts and those without a letter go. Repeated rows share a fate, as it
    depends on the text alone; an empty table stays empty. Extra columns stay.
    """
    predict = langid.predictor(spark, langid.fit(docs))
    told = docs.withColumn("__lid", predict(F.col("text")))
    return told.where((F.col("__lid.lang_pred") != langid.UNDETERMINED) & (F.col("__lid.score") >= MIN_SCORE)).drop("__lid")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class.

    Of rows that repeat an id and its text one stays; texts without words all do.
    An empty table stays empty, and extra columns stay.
    """
    return minhash.drop_duplicates(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in the place of personal data; all documents stay.

    ``n_chars`` follows the text. Null texts stay null, repeated rows are replaced
    alike, an empty table stays empty, and extra columns stay.
    """
    told = docs.withColumn("__pii", pii.surrogate(spark, F.col("text"), pii.environment_key(otherwise=TEST_KEY))["text"])
    more = {"n_chars": F.char_length("__pii").cast("long")} if "n_chars" in docs.columns else {}
    return told.withColumns({"text": F.col("__pii")} | more).drop("__pii")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of several lengths, as pieces with their ids.

    Null texts have an end token only, each of repeated rows is packed, and an
    empty table gives no pieces. Extra columns are not used.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokens and fitted models are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
