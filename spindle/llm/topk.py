"""Exact top-k search by columnar branch and bound.

Vectors lie in blocks, one column of numbers per dimension. A task meets one
block of queries with one block of vectors and adds up inner products some
dimensions at a time. After each step the rest of a product is at most the
product of the remaining norms, so candidates that cannot reach the k-th best
score any more are removed and the survivors moved together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.shared import packed, staged, unpacked, vectors_of

BLOCK = 8192  # vectors of a block
QUERY_BLOCK = 1024
STEP = 16  # dimensions added at a time
SLAB = 2048  # columns looked at before the thresholds rise
EXACT = 2.0**53  # sums of integers below this are exact in doubles


def best_of_block(ids, columns, query_ids, queries, k: int):
    """The k best (score, id) of every query in one block, itself left out.

    `columns` holds a row per dimension, `queries` a row per query; both hold
    whole numbers. Ties go to the smaller id.
    """
    dim, n = columns.shape
    largest = np.abs(columns).max(initial=0) * np.abs(queries).max(initial=0) * max(dim, 1)
    kind = np.float64 if largest < EXACT else np.int64
    order = np.argsort(-np.square(columns).sum(axis=1), kind="stable")
    columns, queries = columns[order].astype(kind), queries[:, order].astype(kind)
    steps = [slice(s, min(s + STEP, dim)) for s in range(0, dim, STEP)]
    rest = lambda x, axis, s: np.sqrt(np.square(x[s.stop :] if axis == 0 else x[:, s.stop :], dtype=np.float64).sum(axis=axis)) * (1 + 1e-9)
    mass, query_mass = [rest(columns, 0, s) for s in steps], [rest(queries, 1, s) for s in steps]
    scores = [np.empty(0, kind)] * len(queries)
    found = [np.empty(0, np.int64)] * len(queries)
    for start in range(0, n, SLAB):
        slab = slice(start, min(start + SLAB, n))
        first = queries[:, steps[0]] @ columns[steps[0], slab]
        for q in range(len(queries)):
            least = scores[q][-1] if len(scores[q]) == k else -math.inf
            part = first[q]
            alive = np.flatnonzero((part + query_mass[0][q] * mass[0][slab] >= least) & (ids[slab] != query_ids[q]))
            part, alive = part[alive], alive + start
            for at in range(1, len(steps)):
                if not len(alive):
                    break
                part = part + queries[q, steps[at]] @ columns[steps[at], alive]
                stays = part + query_mass[at][q] * mass[at][alive] >= least
                part, alive = part[stays], alive[stays]
            if len(alive):
                part, named = np.concatenate([scores[q], part]), np.concatenate([found[q], ids[alive]])
                best = np.lexsort((named, -part))[:k]
                scores[q], found[q] = part[best], named[best]
    return scores, found


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float | None = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query.

    Components are first turned into floor(scale * x), so scores are whole
    numbers and ties real; they go to the smaller id. `is_query` is a condition
    on `vec_id`. Every other vector of the same length is a candidate; if there
    are fewer than k, all are returned. Vectors that are null or empty, or hold
    null or non-finite components, and rows without an id take no part; rows
    repeating an id count once. Scores beyond 64 bits wrap. An empty table gives
    an empty result; other columns are not looked at.

    Each query block meets each vector block in a task of its own, so a task
    holds two blocks whatever the table's size, and no single one holds all rows
    of anything. The number of blocks follows the number of rows.
    """
    whole = F.transform("vector", lambda x: F.floor(F.lit(scale) * x).cast("double"))
    pack = F.pandas_udf(lambda s: pd.Series(packed(s), dtype=object), "binary")
    prepared = vectors_of(vectors, id_column, vector_column)
    numbers = staged(prepared.select("vec_id", F.size("vector").alias("dim"), is_query.alias("asks"), pack(whole).alias("vector")), "vectors")
    rows, asked = numbers.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, math.ceil(rows / BLOCK)), max(1, math.ceil(asked / QUERY_BLOCK))
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = numbers.select("dim", spread(blocks).alias("block"), every(query_blocks).alias("query_block"), F.lit(False).alias("asks"), "vec_id", "vector")
    queries = numbers.where("asks").select("dim", every(blocks).alias("block"), spread(query_blocks).alias("query_block"), "asks", "vec_id", "vector")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        dim, asks = int(rows["dim"].iloc[0]), rows["asks"].to_numpy()
        ids, values = rows["vec_id"].to_numpy(), unpacked(rows["vector"], dim)
        named = ids[asks]
        scores, found = best_of_block(ids[~asks], np.ascontiguousarray(values[~asks].T), named, values[asks], k)
        return pd.DataFrame(
            {
                "query_id": np.repeat(named, [len(s) for s in scores]),
                "vec_id": np.concatenate([*found, np.empty(0, np.int64)]),
                "score": np.concatenate([*scores, np.empty(0)]).astype(np.int64),
            }
        )

    met = candidates.union(queries).groupBy("dim", "query_block", "block")
    best = met.applyInPandas(search, "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
