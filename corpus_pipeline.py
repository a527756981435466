"""From raw documents to training sequences: quality, near duplicates, mix, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.mixing import mixed_documents
from spindle.llm.near_documents import near_documents
from spindle.llm.piece_encoding import encode_documents
from spindle.llm.quality import good_documents
from spindle.llm.queries import piece_model
from spindle.llm.shared import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. Rows without an id
    and repeated rows are judged by their text; empty texts have a score too."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word runs have a similarity
    of 0.8 or more: that with the smallest doc_id. Of rows that repeat a doc_id
    one stays, the least by text. Documents without words or without a doc_id
    link with nothing and stay."""
    links = near_documents(docs, size=5, percent=80)
    dropped = staged(links.where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    named = docs.where("doc_id IS NOT NULL").alias("d").join(dropped.alias("x"), F.col("d.doc_id") == F.col("x.doc_id"), "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    first = named.select(F.struct("d.*").alias("document"), place.alias("place")).where("place = 1").select("document.*")
    return first.union(docs.where("doc_id IS NULL"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them; those taken by
    less than half, and those without words, go."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless) of every document that is left."""
    return encode_documents(docs, piece_model())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("pieces", pieces)]

#: A trained classifier and keyed hashes are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
