"""The corpus pipeline: quality, exact copies, near copies, mixture, packing.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` on all that
its predecessor kept; all but the last return the columns of ``documents``.

Every stage takes null and empty texts (a null one counts as empty), texts of
any length, null doc_ids, repeated rows and further columns, which come back
unchanged under their names; an empty table gives an empty result. What each
does with them is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm import forest, mixing, naming, packing, rules
from mensura.llm.common import keep_rows, read, stage_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from ``labels``, predicts good.

    Each row is judged by its whole text alone: repeated rows stay or go
    together, and empty texts go or stay by the score of an empty text.
    """
    model = rules.fit(docs, read(spark, sf_dir, "labels"))
    return rules.keep(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space.

    The row with the most code points stays, ties by the smallest doc_id (a
    null one last). Null and empty texts and those of white space alone are
    one group; rows that repeat each other wholly leave one.
    """
    groups = naming.exact_groups(docs)
    return keep_rows(docs, groups.select("doc_id", "row_key", F.col("kept").cast("int").alias("copies")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, 80 per cent.

    The smallest doc_id stays. Texts without words are near to nothing and
    stay; unlike texts under one doc_id both stay.
    """
    return forest.without_near_copies(docs, words=5, least=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0, 1 or 2 times).

    Documents come whole, however long, and repeated rows each by themselves.
    Texts without words add nothing to the mix and are left out; null sources
    are one source.
    """
    return keep_rows(docs, mixing.mix(docs).select("doc_id", "row_key", "copies"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 ids.

    A null or empty text is its end id alone; only documents of more than 2048
    ids are cut; every copy of a repeated row is packed.
    """
    return packing.pack(docs)


STAGES = [
    ("keep_quality", keep_quality),
    ("drop_copies", drop_copies),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: A fitted classifier and packing cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stored and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, name, compression="zstd")
    return docs
