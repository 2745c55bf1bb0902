"""A corpus pipeline of five stages over the documents table, each one reading what the stage before it wrote.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame: the columns of documents, but for the last, whose rows are pieces of
sequences. Rows without doc_id, or with one that others have, are documents of their own, known by their texts; empty tables pass through as empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.llm import linededup, packing, pii, similar, toxicity
from changelake.llm.frames import fresh, settle, text_key
from changelake.llm.queries import vocabulary


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, with n_chars of the text as it is now."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = fresh(docs, "score", "predicted")
    scored = toxicity.score(docs, model, score, predicted)
    return scored.where(F.col(predicted) == 0).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand elsewhere first; one that is made of such passages alone goes."""
    lines, removed = fresh(docs, "lines", "removed")
    found = linededup.deduplicate(docs, lines, removed)
    return _counted(found.where((F.col(removed) == 0) | F.col("text").rlike("\\S")), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    A document is known by its doc_id, null or not, and its text; of repeated rows one stays. A document with an id stays rather than one without.
    """
    key, id_, other, own = fresh(docs, "key", "id", "other", "own")
    groups = similar.groups(docs.select("doc_id", "text"))
    first = groups.where("first").select(F.col("doc_id").alias(other), F.col("t").alias(own))
    # Repeated rows meet before the shuffle, so that none is hot in the join.
    once = docs.withColumns({key: text_key(), id_: F.col("doc_id").cast("long")}).dropDuplicates([key, id_])
    kept = once.join(first, F.col(id_).eqNullSafe(F.col(other)) & (F.col(key) == F.col(own)), "left_semi")
    return kept.select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _counted(pii.redact(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_copies),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: SQL cannot express learning, content-defined chunks or the random field; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each but the last returns is written to the shared folder first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settle(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
