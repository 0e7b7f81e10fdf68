"""The JSON registry (S13): reading, checking and building sources."""

import json

import pytest

from tripletframe.sources import io


def write(spark, tmp_path, cfg):
    path = str(tmp_path / "registry.json")
    with open(path, "w") as f:
        f.write(cfg if isinstance(cfg, str) else json.dumps(cfg))
    return io.dataset_registry(spark, path)


def test_registry_defaults_and_number_as_difficulty(spark, tmp_path):
    got = {r.name: r for r in write(spark, tmp_path, {"a": {"type": "pairs", "difficulty": 3, "columns": {"x": "premise"}}, "b": {}}).collect()}
    assert (got["a"].file, got["a"].difficulty, got["a"].columns, got["a"].splits) == ("parquet", "3", {"x": "premise"}, {})
    assert got["b"].type is None and got["b"].difficulty is None


def test_a_file_that_is_no_registry_raises(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)malformed|json"):
        write(spark, tmp_path, "[1, 2").collect()


def test_unknown_names_and_bad_types_are_warned_about_and_skipped(spark, tmp_path):
    reg = write(spark, tmp_path, {"a": {"type": "pairs", "split": {"train": "t"}}, "v": {"type": "video", "split": {"train": "t"}}, "n": {"split": {"train": "t"}}})
    rows = [(i, f"p{i}", f"c{i}") for i in range(6)]
    spark.createDataFrame(rows, "row_id long, premise string, correct_answer string").write.parquet(str(tmp_path / "a" / "t"))
    asked = spark.createDataFrame([("a",), ("v",), ("n",), ("zzz",), ("a",)], "name string")
    status = {r.name: r.status for r in io.validate_registry(reg, asked).collect()}
    assert status == {"a": "ok", "v": "bad_type", "n": "bad_type", "zzz": "unknown"}
    with pytest.warns(UserWarning, match="not in the registry"):
        got = io.build_sources(spark, reg, asked, str(tmp_path)).collect()
    assert sorted(r.row_id for r in got) == list(range(6)) and {(r.source, r.split) for r in got} == {("a", "train")}
    assert all(r.incorrect_answer != r.correct_answer for r in got)
    with pytest.warns(UserWarning):
        assert io.build_sources(spark, reg, asked.where("name = 'zzz'"), str(tmp_path)).count() == 0
