"""The corpus pipeline: five stages, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, packing, simhash, substrings, toxicity
from tallyloom.llm.common import shared_folder, table
from tallyloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic.

    Null and empty texts are kept, repeated rows and rows with equal ids are judged
    each for itself, and without labels of both kinds all documents stay.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles overlap by four fifths: that of the smallest id.

    Null and wordless texts are one group; of repeated rows one stays; a null id
    counts after all others.
    """
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes or more that also stand elsewhere.

    Null and short texts stay as they are, ids do not matter, and texts that occur
    twice lose all of their bytes, in every row of them.
    """
    return substrings.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs.

    Null and empty texts have none. Rows that share an id are judged each by its
    text; without benchmark items all documents stay.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, placed in sequences.

    A null or empty text is one piece, the closing id; repeated rows are packed each
    for itself, and null ids stay null.
    """
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
