"""Operators that carry whole texts keep to a bounded number of bytes a task, with the same rows."""

from pyspark.sql import functions as F

from tripletframe.llm.substring_dedup import substring_dedup
from tripletframe.operators import indexing
from tripletframe.operators import triplets as T


def test_negatives_are_numbered_in_buckets_of_bounded_bytes(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"premise {i} " * 50, f"answer {i}") for i in range(200)], "row_id long, premise string, correct_answer string")
    plain = sorted(map(tuple, T.sample_negatives(rows).collect()))
    monkeypatch.setattr(indexing, "BYTES_PER_BUCKET", 5_000)
    seen = []

    def watched(df, group_cols, order_cols, bucket, *rest):
        seen.append(max(r["b"] for r in df.groupBy(bucket.alias("k")).agg(F.sum(F.octet_length("premise")).alias("b")).collect()))
        return indexing.dense_index(df, group_cols, order_cols, bucket, *rest)

    monkeypatch.setattr(T, "dense_index", watched)
    assert sorted(map(tuple, T.sample_negatives(rows).collect())) == plain
    assert max(seen) < 4 * 5_000  # all premises have about 120,000 bytes


def test_repeated_passages_shuffle_whole_texts_once(spark, tmp_path):
    rows = [(i, None if i == 3 else "  two  spaces " if i == 4 else " ".join(f"w{j}" for j in range(i % 5, i % 5 + 30)), "src") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = substring_dedup(docs, extra=["source"], original=True)
    texts = {r["doc_id"]: r["kept_text"] for r in got.collect()}
    assert texts[3] is None and texts[4] == "  two  spaces " and texts[0] == rows[0][1] and texts[9] == "w33" and texts[1] == "w30"
    plain = {r["doc_id"]: r["kept_text"] for r in substring_dedup(docs, extra=["source"]).collect()}
    assert plain == {**texts, 3: "", 4: "two spaces"}
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1  # the other two steps reuse its exchange


def test_captions_are_numbered_without_their_texts(spark, tmp_path):
    rows = [(i, f"img{i % 7}", None if i == 9 else f"caption {i % 23} " * 5) for i in range(150)]
    spark.createDataFrame(rows, "row_id long, image_id string, caption string").write.parquet(str(tmp_path / "captions"))
    got = T.caption_triplets(spark.read.parquet(str(tmp_path / "captions")))
    image = {}
    for _, i, c in rows:
        image.setdefault(c, set()).add(i)
    out = {r["row_id"]: r for r in got.collect()}
    assert set(out) == {r[0] for r in rows} - {9}
    for k, i, c in rows:
        if k != 9:
            r = out[k]
            assert r["premise"] == c != r["correct_answer"] and i in image[r["correct_answer"]] and image[r["incorrect_answer"]] - {i}
    assert "caption" not in " ".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x)
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1  # the texts are shuffled once for all three roles
