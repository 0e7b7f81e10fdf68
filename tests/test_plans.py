"""Physical-plan checks: no cartesian products or nested-loop joins, no row-at-a-time Python UDFs,
filters and column pruning reach the Parquet scan."""

import pytest

import __spark_entry__ as entry
from conftest import SMALL

QUERIES = entry.queries()
CHECKED = ["flagship_triplet_eval", "t3_sample_negatives", "t5_caption_triplets", "m5_interleave_round_robin",
           "e2_embed_texts", "e7_rouge1_f", "e13_bertscore", "a6_wasserstein", "a11_threshold_curve", "a16_closeness_rank",
           "m14_curriculum_draw", "r2_best_checkpoint"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cartesian_or_row_udf(spark, name):
    p = _plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p


def test_read_split_prunes_partitions(spark):
    from tripletframe.sources import io
    from tripletframe.sources.fixtures import view

    lab = view(spark, SMALL, "fx_labeled")
    path = io.scratch_path(spark, "plan-bundle")
    io.save_split_bundle(lab, path)
    p = _plan(io.read_split(spark, path, "validation").select("row_id"))
    assert "PartitionFilters: [isnotnull(split" in p and "validation" in p
    assert "ReadSchema: struct<row_id:bigint>" in p


def test_column_pruning(spark):
    p = _plan(QUERIES["s8_read_columns"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p
