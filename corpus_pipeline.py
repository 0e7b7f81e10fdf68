"""Corpus pipeline: reject toxic documents, drop exact and near copies, cut repeated passages, pack.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next stage's documents. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletframe.llm import packing
from tripletframe.llm.common import free_shuffles, stash, table
from tripletframe.llm.exact_dedup import exact_dedup
from tripletframe.llm.queries import WORD_BPE
from tripletframe.llm.simhash import simhash_dedup
from tripletframe.llm.substring_dedup import substring_dedup
from tripletframe.llm.toxicity import reject_toxic
from tripletframe.session import ship_package


def _begin(spark: SparkSession) -> None:
    """Before a stage: the code on the executors, the disks free of what the stages before have shuffled."""
    ship_package(spark)
    free_shuffles(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; null and empty texts stay."""
    _begin(spark)
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty) one row stays, the one with the largest doc_id; a null text comes out empty.

    Other columns pass unchanged, whatever their names; an empty table stays empty.
    """
    _begin(spark)
    names = {c: c if c in ("doc_id", "text") else f"own_{c}" for c in docs.columns}
    kept = exact_dedup(docs.withColumnsRenamed(names), extra=list(names.values())).where("kept")
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (four-word shingles, at most four differing bits, linked) one row stays, the one with the smallest doc_id.

    A null id is above all others; of rows with one id, repeated ones too, any
    single row stays. Null and empty texts are near-duplicates of each other. An
    empty table stays empty; other columns pass unchanged, whatever their names.

    Rows are known by a digest of id and text (equal ones are in one component), so no copy of the rows is written.
    """
    _begin(spark)
    row_key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"), 256))
    own = docs.select(*(F.col(c).alias(f"own_{c}") for c in docs.columns), row_key.alias("row_key"))
    found = simhash_dedup(own.select(F.col("own_doc_id").alias("doc_id"), F.col("own_text").alias("text"), "row_key"), width=4, distance=4, extra=["row_key"], classes=True)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    stay = found.groupBy("component_root").agg(F.min(rank)["row_key"].alias("row_key"))
    return own.join(stay, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*(F.col(f"own_{c}").alias(c) for c in docs.columns))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that a document with a smaller id also has go; a changed text is its kept words joined by one space.

    A null id is above all others. Unchanged rows, null and empty texts pass as
    they are; repeated rows all stay; other columns pass unchanged but for
    n_chars, counted anew for a changed text. An empty table stays empty.
    """
    _begin(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = substring_dedup(docs.select("doc_id", "text", *(F.col(c).alias(f"own_{c}") for c in rest)), extra=[f"own_{c}" for c in rest], original=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in rest:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("own_n_chars")).cast("long")
    return found.select(*(new.get(c, F.col(f"own_{c}")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents placed in sequences of at most 2048 ids; null ids and repeated rows are packed each, an empty table gives no rows."""
    _begin(spark)
    return packing.pack(packing.pieces(docs, WORD_BPE, capacity=2048, end_id=0, digest=True), capacity=2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("substring_dedup", passages),
    ("best_fit_packing", pack),
]

#: The fitted, iterative and automaton stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
