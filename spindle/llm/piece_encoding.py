"""Documents as sequences of pieces, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.pieces import PieceModel
from spindle.llm.shared import kept_in_worker

TOGETHER = 250  # texts whose new words are merged at once
CHARACTERS = 1_000_000  # of those texts, but for a single longer one


def _together(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for end, text in enumerate(texts):
        if end > start and (end - start >= TOGETHER or size + len(text) > CHARACTERS):
            yield slice(start, end)
            start = end
            size = 0
        size += len(text)
    yield slice(start, len(texts))


def encode_documents(documents: DataFrame, model: str, rate: float = 0.1, seed: int = 17, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, n_pieces, lossless), a row per row of `documents`.

    `model` is the path of a model file that the executors can read, `rate` the
    share of merges that are skipped, `seed` and the doc_id the key of which. The
    same seed gives the same ids on every run and any partitioning; rate 0 gives
    the model's own encoding, but that a space mark in a text, which the model
    takes for a space, is always encoded as bytes. lossless says that decoding the ids gave back the
    text, which was done for every row. Null and empty texts have no pieces; rows
    without an id are encoded as if it were -1; repeated rows are encoded alike.
    An empty table gives an empty result, other columns are not looked at.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_in_worker(("pieces", model), lambda: PieceModel(model))
        for batch in batches:
            names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            found, lossless = [], []
            for some in _together(texts):
                keys = [-1 if n is None else n for n in names[some].to_pylist()]
                done = pieces.encode_all(texts[some], keys, rate, seed)
                lossless += pieces.restores(done, texts[some])
                found += done
            sizes = np.array([len(i) for i in found], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array(np.concatenate([*found, np.empty(0, np.uint16)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends), values), pa.array(sizes), pa.array(lossless, pa.bool_())], ["doc_id", "ids", "n_pieces", "lossless"])

    return rows.mapInArrow(encode, "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decoded(ids: Column, model: str) -> Column:
    """The texts of sequences of ids; null stays null."""

    def decode(batches):
        pieces = kept_in_worker(("pieces", model), lambda: PieceModel(model))
        for sequences in batches:
            yield sequences.map(lambda s: None if s is None else pieces.decode(s))

    decode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(decode, "string")(ids)
