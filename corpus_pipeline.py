"""A corpus pipeline of five stages: quality, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import Written, free_shuffles, table
from plumbline.llm.exact_dedup import keep_first
from plumbline.llm.mixing import mix_documents
from plumbline.llm.quality import keep_quality
from plumbline.llm.sentencepiece_lattice import encode_documents
from plumbline.llm.simhash import keep_representatives


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents among its input.

    Null and empty texts have the score of the bias alone. Rows with a null doc_id are scored like all others and
    teach nothing; of rows that share a labelled id one text teaches. Repeated rows have equal scores. Ties can't
    occur: a score is accepted from the threshold on. Other columns, of whatever name, pass unchanged. Texts of any length (under
    2 GB, as everywhere) are scored whole; an empty table stays empty.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts that with the smallest doc_id stays; null counts as empty.

    Of equal rows of one id one stays, of an id's different texts each is decided for itself. Rows with a null doc_id
    go if their text has an id elsewhere; else one of them stays. Other columns, of whatever name, pass unchanged. Texts of any length
    count whole; an empty table stays empty.
    """
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, similarity 0.8 or more, that with the smallest doc_id stays.

    Null and empty texts are linked with each other, texts of under five words with those of the same words. Rows
    with a null doc_id stay, as a decision can't name them; rows that share a staying id all stay. Other columns, of whatever name, pass
    unchanged. Texts of any length count whole; an empty table stays empty.
    """
    return keep_representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture visits it, with a budget of as many tokens as there are.

    A null source is a source of its own. Null and empty texts have no tokens and come along once an epoch. Rows that share a
    doc_id, null too, are visited together. Orders are by hash and then by doc_id, so there are no ties. Other columns, of whatever name, pass
    unchanged. Texts of any length are taken or left whole; an empty table stays empty.
    """
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled pieces; null and empty texts have none. The row key is the doc_id (null: 0), so repeated rows have equal pieces.

    Other columns are left out. Texts of any length are encoded whole; an empty table gives none.
    """
    return encode_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]

#: Training and sampling can't be said in SQL; tests hold the stages against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir), name).read()
        free_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
