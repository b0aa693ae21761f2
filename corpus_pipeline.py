"""A corpus on its way to training files: five stages, each an operator of covermap.llm over what the one before kept.

Toxic documents are rejected, one document of each near-duplicate group stays, documents with benchmark passages are
dropped, sources are mixed to their target weights, and the mix is written as token ids in binary files, whose digest
is the result. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from covermap.llm.common import kept, table
from covermap.llm.decontamination import without_leaks
from covermap.llm.mixing import mix
from covermap.llm.simhash import first_of_each
from covermap.llm.token_ids import written_ids
from covermap.llm.toxicity import without_toxic

SIMILARITY = 0.8


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates are those of op3_simhash and texts of at least SIMILARITY in their five-word shingles."""
    return first_of_each(docs, similarity=SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands in the mix as often as its source's target asks for, at most three times."""
    return mix(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the mix, read back from the files."""
    return written_ids(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
    ("token-id output", write_ids),
]

#: The trained and iterative stages have no SQL; tests hold the rows against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
