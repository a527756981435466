"""Token counts of documents, and what fits a budget of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.prefix_counts import PrefixCounter
from spindle.llm.shared import kept_in_worker


def token_counts(text: Column, tokenizer: str, budget: int) -> Column:
    """struct(n_tokens, fitting): the tokens of the whole text, and the length in
    characters of its longest prefix with at most `budget` tokens (of its
    normalized form where that differs in length). Null counts as empty."""

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = kept_in_worker(("prefix counter", tokenizer), lambda: PrefixCounter(tokenizer))
        for texts in batches:
            found = []
            for t in texts:
                n = counter.count(t) if t else 0
                found.append((n, len(t or "") if n <= budget else counter.prefixes(t, budget).fitting(budget)))
            yield pd.DataFrame(found, columns=["n_tokens", "fitting"])

    counted.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(counted, "n_tokens long, fitting long")(text.cast("string"))


def document_tokens(documents: DataFrame, tokenizer: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fitting), a row per row of
    `documents`.

    `tokenizer` is the path of a tokenizer file that the executors can read.
    Counts are those of its library without begin, end or added special tokens,
    on whole texts of any length; special strings inside a text are one token.
    Null texts count as empty: no bytes, no tokens. Repeated rows count alike, an
    empty table gives an empty result, other columns are not looked at.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    counted = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_counts(F.col("text"), tokenizer, limit).alias("found"))
    n = F.col("found.n_tokens")
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), F.col("found.fitting").alias("fitting"))
