"""Registered corpus queries against their SQL, and the pipeline stage by stage."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from spindle.llm.minhash import shingles_of, words_of  # noqa: E402
from spindle.llm.mixing import mix  # noqa: E402
from spindle.llm.quality import learn_quality  # noqa: E402
from spindle.llm.queries import ORACLE, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_and_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) == ""


def test_every_operator_has_one_query():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet").cache()]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stage(spark, docs[-1], FOLDER).cache())
    return docs


def test_stages_keep_the_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_quality_stage_drops_what_scores_low(spark, stages):
    before, after = stages[:2]
    model = learn_quality(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r["doc_id"] for r in before.select("doc_id", model.score(before["text"]).alias("s")).collect() if r["s"] >= 0.3}
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == want


def test_near_duplicate_stage_keeps_the_first_of_each_group(stages):
    before, after = stages[1:3]
    sets = {r["doc_id"]: shingles_of(words_of((r["text"] or "").encode()), 5) for r in before.collect()}
    above = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((above[a], above[b]))
                above = {i: x if t == y else t for i, t in above.items()}
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(set(above.values()))


def test_mixture_stage_copies_whole_documents(stages):
    before, after = stages[2:4]
    taken = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mix(before).collect() if r["size"]}
    copies = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert copies == {i: n for i, n in taken.items() if n}


def test_piece_stage_is_lossless(stages):
    before, after = stages[3:]
    assert after.count() == before.count() and after.where("NOT lossless").count() == 0


def test_near_duplicate_stage_on_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b c"), (3, "a b d"), (4, "A b c"), (5, ""), (6, None)], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(None, "a b"), (None, "a b"), (3, "a b c"), (5, ""), (6, None)], key=repr)


def test_run_on_the_smallest_sample(spark):
    assert corpus_pipeline.run(spark, FOLDER).where("NOT lossless").count() == 0
