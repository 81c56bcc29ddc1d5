"""Plans that must be the same for few rows as for many."""

import corpus_pipeline
from pixelith.llm import mixing


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan, "BroadcastHashJoin [" in plan


def test_texts_are_joined_without_a_broadcast(spark, docs):
    one = docs.where("doc_id between 1 and 10")
    assert joins(mixing.mixed_documents(one)) == (True, False)
    kept = corpus_pipeline.drop_near_duplicates(spark, one, "")
    assert "LeftSemi" in kept._jdf.queryExecution().executedPlan().toString()
    assert not any("BroadcastHashJoin" in line and "LeftSemi" in line for line in kept._jdf.queryExecution().executedPlan().toString().splitlines())
