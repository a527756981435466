"""Documents as tokens of two tokenizers, aligned, and how usual their links are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.shared import kept_in_worker, staged
from spindle.llm.token_windows import WindowAligner

TOGETHER = 300_000  # characters of the texts that are aligned at once; a longer text is aligned alone
HOT = 200_000  # a pair with more than a HOT-th of all links is joined by broadcast; there are fewer than HOT of them


def _together(texts: list[str | None]) -> Iterator[slice]:
    start = size = 0
    for end, text in enumerate(texts):
        size += len(text or "")
        if size > TOGETHER and end > start:
            yield slice(start, end)
            start, size = end, len(text or "")
    yield slice(start, len(texts))


def align_documents(documents: DataFrame, a: str, b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pairs, times), a row per row of
    `documents`.

    `a` is the path of a byte-level tokenizer file and `b` that of a piece model,
    which executors can read. Special tokens are never added, and their strings
    in texts are plain text. Tokens of A are those of a space and the text, B
    adds the space. The offsets at which tokens of both end cut them into groups:
    `groups` is `a1,a2|b1;a3|b2,b3` with decimal ids. `pairs` are the distinct
    pairs of ids whose tokens share bytes somewhere in the text, ascending, as
    b * (size of A's vocabulary) + a, and `times` how often they do.

    Texts that are null, empty or not lossless in either tokenizer have zeros and
    nothing. Rows without an id and repeated rows are aligned alike; an empty
    table gives an empty result; other columns are not looked at.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept_in_worker(("aligner", a, b), lambda: WindowAligner(a, b))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for some in _together(texts):
                found = aligner.align(texts[some])
                columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                ends = np.concatenate([[0], np.cumsum([len(f[4]) for f in found])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *[f[k] for f in found]]).astype(t))) for k, t in ((4, np.int64), (5, np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[some], *columns, *lists], ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])

    return rows.mapInArrow(align, "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): the links of all rows that hold a pair of ids, and whether
    no pair of its B id has more. Links combine before the shuffle."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("link.*")
    counts = staged(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "pair_counts")
    b_id = F.floor(F.col("pair") / width)
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # one row per id of B's vocabulary
    return staged(counts.join(F.broadcast(most), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def link_scores(aligned: DataFrame, width: int, key: str = "row") -> DataFrame:
    """(key, n_best, count_sum) of the rows of `aligned` that have links.

    Frequent pairs, of which there are fewer than HOT, come by broadcast. The
    others have at most a HOT-th of the links each, so that the join by pair
    deals them out evenly.
    """
    counts = pair_counts(aligned, width)
    total = counts.agg(F.sum("n")).scalar()
    hot, rare = counts.where(F.col("n") * HOT > total), counts.where(F.col("n") * HOT <= total)
    each = aligned.select(key, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(key, F.col("link.pairs").alias("pair"), "link.times")
    usual = each.join(F.broadcast(hot), "pair")
    others = each.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rare.hint("merge"), "pair")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    parts = [part.groupBy(key).agg(*sums) for part in (usual, others)]
    return parts[0].union(parts[1]).groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned_documents(documents: DataFrame, a: str, b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a
    row per row of `documents`; see `align_documents`.

    n_links counts the pairs of tokens that share bytes. The count of a pair of
    ids is the number of links with it in all rows: count_sum adds it over the
    links, n_best counts links whose count is the highest of their B id. The
    hash is that of `groups`, and '' where there are none. The texts are
    tokenized once; groups are hashed at once and never stored.
    """
    width = len(WindowAligner(a, b).a.bytes)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    n_links = F.aggregate("times", F.lit(0).cast("long"), lambda s, x: s + x)
    found = align_documents(documents, a, b, id_column, text_column).withColumns({"groups_sha256": digest, "n_links": n_links})
    rows = staged(found.drop("groups").withColumn("row", F.monotonically_increasing_id()), "aligned")
    scores = link_scores(rows, width)
    score = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "times").join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *score, "groups_sha256")
