"""Exact duplicates by a persistent index of digests.

The index is a table with one row for every text ever seen, in buckets by digest
and sorted by it. New documents are reduced to digests, those digests that the
index lacks are found by a sort-merge anti-join, and appended. Both sides of the
join are in buckets: only the new digests move, never the index.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.shared import scratch, staged

HOT = 1000  # a digest with more than a HOT-th of the rows is joined by broadcast; there are fewer than HOT of them


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, as 32 bytes. Null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def digests_of(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, digest), a row per row of `documents`."""
    return documents.select(F.col(id_column).cast("long").alias("doc_id"), digest(F.col(text_column)).alias("digest"))


def texts_of(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, copies) of distinct texts, with the largest id of their
    rows. Copies combine before the shuffle; staged, since the planner would
    otherwise join before it combines and send all copies of a text to one task."""
    return staged(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("copies")), "texts")


class DigestIndex:
    """A table (digest, keep_id) in a folder that all executors share.

    The folder keeps its contents between sessions and is opened again with the
    number of buckets it was made with; from spark.sql.shuffle.partitions on,
    joins leave the index where it is. Files are appended per batch and bucket;
    `compact` makes one sorted file of each bucket again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = f"digests_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{self.path}'"
        )

    def entries(self) -> DataFrame:
        """(digest, keep_id), one row per text."""
        return self.spark.table(self.name)

    def unseen(self, texts: DataFrame) -> DataFrame:
        """(digest, keep_id) of the texts that the index lacks."""
        return texts.select("digest", "keep_id").join(self.entries().hint("merge"), "digest", "left_anti")

    def add(self, texts: DataFrame) -> None:
        """Append what is unseen. An append that fails leaves nothing behind, and
        a batch added twice adds nothing the second time."""
        self.unseen(texts).write.insertInto(self.name)

    def judged(self, digests: DataFrame, texts: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of
        `digests`, given their texts, which must have been added. Frequent texts,
        of which there are fewer than HOT, are joined by broadcast, so that no
        task gets a group of copies beyond a HOT-th of the rows."""
        sizes = staged(texts.groupBy("digest").agg(F.sum("copies").alias("group_size")), "sizes")
        known = staged(sizes.join(self.entries().hint("merge"), "digest"), "groups")
        total = known.agg(F.sum("group_size")).scalar()
        hot = F.broadcast(known.where(F.col("group_size") * HOT > total).select("digest", F.struct("keep_id", "group_size").alias("hot")))
        rows = digests.join(hot, "digest", "left")
        rare = rows.where("hot IS NULL").select("doc_id", "digest").join(known.hint("merge"), "digest")
        every = rows.where("hot IS NOT NULL").select("doc_id", "digest", "hot.*").unionByName(rare)
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return every.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def compact(self, path: str) -> DigestIndex:
        """The same entries in another folder, one sorted file per bucket."""
        other = DigestIndex(self.spark, path, self.buckets)
        every = self.spark.read.schema(self.entries().schema).parquet(self.path)  # not as buckets, so that rows are dealt anew
        every.repartition(self.buckets, "digest").write.insertInto(other.name)
        return other


def new_documents(index: DigestIndex, documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Deduplicate arriving documents against all that came before: adds their
    texts to the index and returns the rows that stay, with their columns. Of the
    copies of a new text the largest id stays, the least row if it repeats;
    without ids, the least row.
    """
    texts = texts_of(digests_of(documents, id_column, text_column))
    stay = staged(index.unseen(texts), "unseen")
    marked = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"), F.col(id_column).cast("long").alias("id"), digest(F.col(text_column)).alias("digest"))
    same = (F.col("m.digest") == F.col("s.digest")) & F.col("m.id").eqNullSafe(F.col("s.keep_id"))
    first = marked.alias("m").join(stay.alias("s"), same, "left_semi").groupBy("digest").agg(F.min("document").alias("document")).select("document.*")
    result = staged(first, "new")
    index.add(texts)
    return result


def exact_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row per row of
    `documents`: the row with the largest id of equal texts stays.

    Texts are equal when all their bytes are; null counts as empty. Documents
    without an id stay only if no copy has one, and keep_id is null then. Rows
    that repeat an id and a text are marked alike. An empty table gives an empty
    result; other columns are not looked at.

    The documents with the larger half of the ids enter a new index first, then
    the others are held against it; a text that came first thus has the larger
    id. Texts are read once, digests are staged.
    """
    spark = documents.sparkSession
    digests = staged(digests_of(documents, id_column, text_column), "digests")
    index = DigestIndex(spark, scratch(spark, "digest_index"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    middle = digests.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    newer = F.coalesce(F.col("doc_id") > F.lit(middle).cast("long"), F.lit(False))
    batches = [texts_of(digests.where(newer)), texts_of(digests.where(~newer))]
    for texts in batches:
        index.add(texts)
    return index.judged(digests, batches[0].union(batches[1]))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
