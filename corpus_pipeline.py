"""The corpus pipeline: quality, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. ``run`` writes each
stage's rows to the shared folder and rereads them as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from manifestry.llm import bpe, mixing, pairwise, pseudonym, simhash
from manifestry.llm.common import read, remove, shared_dir
from manifestry.llm.queries import rank_file, table_key


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker accepts, learnt from their labels.

    A null or empty text is scored like any other; a document at the cut is accepted; repeated rows are treated alike;
    without labels of both kinds all have the same score, which is the cut's, and stay; further columns are kept; an
    empty table gives an empty one.
    """
    return pairwise.accepted(docs, pairwise.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id, then the smallest hash of the row) of each near-duplicate group.

    Null, empty and wordless texts are copies of each other; rows without an id all stay; rows that share an id but
    not a text are documents of their own; further columns are kept; an empty table gives an empty one.
    """
    return simhash.deduplicate(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for the personal data in their texts; every row and column stays.

    A null text stays null, a text without such data as it is; equal values get equal pseudonyms in all documents; an
    empty table gives an empty one.
    """
    return pseudonym.pseudonymize(docs, key=table_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have no words and may be taken or not; a null source is a source; repeated rows and rows that
    share an id are taken each for itself; further columns are kept; an empty table gives an empty one.
    """
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and decoded bytes, a row for each copy in the mix.

    A null or empty text has no tokens; an empty table gives an empty result; further columns are not read.
    """
    return bpe.encoded_digests(docs, *rank_file())


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_copies), ("personal_data", replace_personal_data), ("mixing", mix_sources), ("tokens", encode_tokens)]

#: Models, keyed networks and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, reread from the shared folder; what a stage wrote goes once the next one has read it."""
    docs, folder, before = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
