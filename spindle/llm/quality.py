"""A learned quality score of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.convolution import log_odds, train

PER_CLASS = 1500  # texts of each label that a network learns from, the bound of what the driver holds
MAX_BYTES = 8192  # of a text to learn from; scores are of whole texts of any length
STEPS = 500
SEED = 7
ACCEPT = 0.3


@dataclass
class QualityModel:
    """A trained network, or None where the labels show one class only, and what
    to add to its log-odds."""

    network: dict | None
    shift: float

    def score(self, text: Column) -> Column:
        """The probability, from 0 to 1, that a text is good. Null counts as empty."""
        network, shift = self.network, self.shift

        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                if network is None:
                    odds = np.zeros(len(texts))
                else:
                    odds = np.concatenate([*log_odds(network, (t or b"" for t in texts)), np.empty(0)])
                yield pd.Series(1 / (1 + np.exp(-np.clip(odds + shift, -50, 50))))

        scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(scored, "double")(text.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn_quality(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> QualityModel:
    """Learn from at most PER_CLASS texts of each label, of MAX_BYTES at most,
    in the order of a hash of their ids, without the held-out ones.

    Ids without a label, null labels and ids absent from `documents` are left
    out; an id with several labels has the least. The shares of the labels among
    all usable ids set the base rate. Without both labels the score is the
    smoothed share of label 1.
    """
    ids = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.octet_length(text_column).alias("bytes")).where(F.col("bytes") <= MAX_BYTES)
    named = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label"))
    usable = named.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    known = usable.join(ids, "doc_id", "left_semi")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    shift = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    if len(counts) < 2:
        return QualityModel(None, shift)
    chosen: dict[int, int] = {}
    for label in (0, 1):
        picked = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
        chosen |= {r["doc_id"]: label for r in picked.select("doc_id").collect()}
    some = documents.sparkSession.createDataFrame(list(chosen.items()), "doc_id long, label int")
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    short = texts.where(F.octet_length("text") <= MAX_BYTES).join(F.broadcast(some), "doc_id")  # at most 2 * PER_CLASS rows
    rows = short.groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    y = np.array([r["label"] for r in rows])
    network = train([bytes(r["text"]) for r in rows], y, STEPS, SEED)
    return QualityModel(network, shift - float(np.log((y == 1).sum() / (y == 0).sum())))


def quality_scores(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of `documents`.

    score is the probability of label 1 from the whole text alone, null and
    empty texts included; predicted is 1 from a score of 0.3. A row without an
    id is scored and not held out. Equal texts have equal scores. An empty table
    gives an empty result; other columns are not looked at.
    """
    model = learn_quality(documents, labels, id_column, text_column)
    scored = documents.select(F.col(id_column).cast("long").alias("doc_id"), model.score(F.col(text_column)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents whose score reaches `accept`, with all their columns."""
    return documents.where(learn_quality(documents, labels).score(F.col("text")) >= accept)
