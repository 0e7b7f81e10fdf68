"""Registered queries with tiny buckets (many buckets per group) still equal their DuckDB oracles."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from tools.oracle_check import TABLES, rows_of
from tripletframe.operators import indexing

NAMES = ["t5_caption_triplets", "m1_sample_per_source", "m3_source_index", "m5_interleave_round_robin",
         "m9_epoch_batches", "m10_cap_samples", "m12_assign_levels", "m13_advance_on_score", "m14_curriculum_draw",
         "p14_encode_pad", "a2_batch_mean_loss", "a6_wasserstein", "r2_best_checkpoint"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_many_buckets_match_oracle(spark, con, name, monkeypatch):
    monkeypatch.setattr(indexing, "ROWS_PER_BUCKET", 7)
    df = entry.queries()[name](spark, SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got == want
