"""A delivery is cut into files by its size, and the sample is the batch reservoir's."""

from pyspark.sql import functions as F

from conftest import SMALL
from tripletframe.operators.triplets import reservoir_sample
from tripletframe.plans import stream_queries as Q
from tripletframe.sources.fixtures import fx_tokens


def test_deliveries_are_cut_into_files(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(120))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(Q, "W2_FILE_BYTES", 4096, raising=False)
    monkeypatch.setattr(Q.io, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = {tuple(r) for r in Q.w2_stream_sample_k(spark, str(tmp_path)).collect()}
    tokens = fx_tokens(spark, str(tmp_path)).withColumn("tok_id", F.col("row_id") * 100000 + F.col("pos"))
    assert got == {tuple(r) for r in reservoir_sample(tokens, Q.RESERVOIR_K, "tok_id").select("row_id", "pos", "token").collect()}
    assert len(list((tmp_path / "w2src").glob("*.parquet"))) >= 10
    assert len(list((tmp_path / "w2state").glob("batch_id=*"))) <= 4


def test_monitor_runs_a_batch_a_week_whatever_the_partitions(spark, monkeypatch):
    persisted, run, batches = Q._persisted, Q.W.stream_eval_monitor, []

    def watched(spark, src, out, *rest, **kw):
        run(spark, src, out, *rest, **kw)
        batches.extend(r[0] for r in spark.read.parquet(out).select("batch_id").distinct().collect())

    monkeypatch.setattr(Q, "_persisted", lambda df: persisted(df.repartition(6)))
    monkeypatch.setattr(Q.W, "stream_eval_monitor", watched)
    got = Q.w3_stream_eval_monitor(spark, SMALL).collect()
    assert sum(r["n"] for r in got) == 1000 and len(batches) <= 5  # 30 days
