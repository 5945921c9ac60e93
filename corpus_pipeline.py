"""A training-data pipeline over ``documents``.

Toxic documents go, one document of each near-duplicate group stays, personal data is replaced
by its kind, sources are mixed to their target weights as whole documents, and the result is
encoded to token ids. Every stage takes the rows that the one before kept and returns the
columns of documents; the last returns tokens.

Defined results: a null text counts as an empty one, which is scored, grouped, mixed (size 0) and
encoded (no tokens) like any other, and stays null in the stages before the last. Documents with
null ids take part; of a group the least id stays, null ids last, and of rows that share an id
the least text hash; repeated rows leave one. A null source is a source of its own. Other columns,
whatever their names, go through unread. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.session import materialize
from factorloom.llm.bpe import encode_texts
from factorloom.llm.common import table
from factorloom.llm.mixing import mix_documents
from factorloom.llm.pii import redact_documents
from factorloom.llm.simhash import drop_near_duplicates
from factorloom.llm.toxicity import drop_toxic, training_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"), training_rows())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256); ids are little-endian 32-bit."""
    # Executors that have run four stages have little room: their tasks hold few words.
    coded = encode_texts(docs, decode=True, held=1 << 14, cached=1 << 17)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("tokens", tokens),
]

# The classifier and the fingerprints have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each kept result is written once, so none runs twice."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
