"""The persistent index of digests against plain accounts of the same thing."""

import hashlib
import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from spindle.llm import digest_index
from spindle.llm.digest_index import DigestIndex, digests_of, exact_duplicates, new_documents, texts_of

DOCUMENTS = "doc_id long, text string, keep_id string, digest string, copies string, document string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], DOCUMENTS)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_copies_nulls_empty_texts_and_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "A", "a ", "é", "é", "", None, "long " * 9000, "x" * rng.randrange(60)])) for i in range(250)]
    rows += [(None, "a"), (None, "only without id"), (None, "only without id"), (7, rows[7][1]), (-5, "a"), (3, "another text of 3")]
    df = table(spark, rows)
    assert collected(exact_duplicates(df)) == plain(rows)
    assert collected(exact_duplicates(df.repartition(7))) == plain(rows)
    assert collected(exact_duplicates(df.limit(0))) == []
    nameless = [(None, "a"), (None, "b")]
    assert collected(exact_duplicates(table(spark, nameless))) == plain(nameless)


def test_frequent_texts_go_by_broadcast_and_the_others_by_join(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else f"t{i % 40}") for i in range(200)]
    for bound in (1, 10, 1000):
        monkeypatch.setattr(digest_index, "HOT", bound)
        assert collected(exact_duplicates(table(spark, rows))) == plain(rows)


def test_batches_against_the_index(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    first = new_documents(index, table(spark, [(1, "a"), (2, "a"), (3, None), (4, "b")]))
    assert sorted((r["doc_id"], r["text"]) for r in first.collect()) == [(2, "a"), (3, None), (4, "b")]
    second = new_documents(index, table(spark, [(9, "a"), (9, "a"), (5, ""), (6, "c"), (6, "c"), (None, "d"), (None, "d")]))
    assert sorted(((r["doc_id"], r["text"]) for r in second.collect()), key=repr) == [(6, "c"), (None, "d")]
    assert first.columns == second.columns == DOCUMENTS.replace(" long", "").replace(" string", "").split(", ")
    # another session finds the folder again, and adding a batch twice adds nothing
    spark.sql(f"DROP TABLE {index.name}")
    again = DigestIndex(spark, str(tmp_path / "index"), 4)
    assert again.entries().count() == 5
    again.add(texts_of(digests_of(table(spark, [(9, "a"), (5, "")]))))
    assert again.entries().count() == 5
    assert new_documents(again, table(spark, [(1, "a")]).limit(0)).count() == 0


def test_compact_leaves_one_sorted_file_of_each_bucket(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    for start in (0, 50):
        index.add(texts_of(digests_of(table(spark, [(i, f"t{i}") for i in range(start, start + 80)]))))
    packed = index.compact(str(tmp_path / "packed"))
    assert collected(packed.entries()) == collected(index.entries())
    files = [p for p in Path(packed.path).glob("*.parquet")]
    assert sorted(re.search(r"_(\d{5})\.", p.name)[1] for p in files) == ["00000", "00001", "00002", "00003"]
    for p in files:
        held = [bytes(r["digest"]) for r in spark.read.parquet(str(p)).collect()]
        assert held == sorted(held)


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    index.add(texts_of(digests_of(table(spark, [(1, "a")]))))
    unseen = index.unseen(texts_of(digests_of(table(spark, [(1, "a"), (2, "b")]))))
    plan = unseen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and re.search(r"SortMergeJoin.*LeftAnti", plan) and "Bucketed: true" in plan
    assert "EvalPython" not in plan and "InPandas" not in plan
    assert [r["keep_id"] for r in unseen.select(F.col("keep_id")).collect()] == [2]
