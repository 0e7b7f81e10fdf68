"""Readers and writers.

Datasets are stored as Parquet partitioned by ``split`` (and ``subset``), so a
split read is partition pruning, not a filter after a full load. Writers are
idempotent: they write to a staging folder and publish it with one rename.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletframe.session import checkpoint_dir

TRIPLET_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in ("premise", "correct_answer", "incorrect_answer")]
)
MIXED_WRITE_BATCH = 50_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a machine-local temp dir on a cluster)."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ S1, S2, S6

def save_split_bundle(df: DataFrame, path: str, split_col: str = "split", subset_col: str | None = None) -> None:
    """S6 save: all splits of one dataset under one folder, partitioned by (subset,) split."""
    parts = [c for c in (subset_col, split_col) if c]
    df.write.mode("overwrite").partitionBy(*parts).parquet(path)


def load_split_bundle(spark: SparkSession, path: str) -> DataFrame:
    """S6 load; an unknown dataset name is an error."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"unknown dataset bundle: {path}")
    return spark.read.parquet(path)


def list_splits(bundle: DataFrame, split_col: str = "split") -> DataFrame:
    """Splits with their row counts."""
    return bundle.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))


def read_split(spark: SparkSession, path: str, split, split_col: str = "split") -> DataFrame:
    """One split (or a list of splits, unioned) by partition pruning."""
    splits = [split] if isinstance(split, str) else list(split)
    return spark.read.parquet(path).where(F.col(split_col).isin(splits))


def read_subset(spark: SparkSession, path: str, subset: str, split: str, subset_col: str = "subset", split_col: str = "split"):
    """A named subset inside a corpus (both partition columns pruned)."""
    return spark.read.parquet(path).where((F.col(subset_col) == subset) & (F.col(split_col) == split))


# ------------------------------------------------------------------ S3-S5

def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", header).option("sep", sep).option("quote", '"').option(
        "escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S3: headered CSV with quoted, multi-line text and an explicit schema (no inference)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"')
            .option("escape", '"').csv(path))


def read_tsv(spark: SparkSession, path: str, names: Sequence[str] = ("premise", "correct_answer")) -> DataFrame:
    """Headerless tab-separated pairs."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return (spark.read.schema(schema).option("sep", "\t").option("header", False).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


ANNOTATION_SCHEMA = T.StructType(
    [T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("image_id", T.StringType()), T.StructField("caption", T.StringType()),
    ])))]
)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON records {annotations: [{id, image_id, caption}]} -> one row per annotation."""
    j = spark.read.schema(ANNOTATION_SCHEMA).json(path)
    return j.select(F.explode("annotations").alias("a")).select(
        F.col("a.id").alias("row_id"), F.col("a.image_id").alias("image_id"), F.col("a.caption").alias("caption")
    )


def group_captions(rows: DataFrame) -> DataFrame:
    """Captions grouped per image (list ordered by annotation id; bounded by an image's captions)."""
    return rows.groupBy("image_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_id", "caption"))), lambda s: s["caption"]).alias("captions")
    )


# ------------------------------------------------------------------ S7-S9

def write_triplets(df: DataFrame, path: str, cols: Sequence[str] = ("premise", "correct_answer", "incorrect_answer"),
                   required: Sequence[str] | None = None, max_records: int = MIXED_WRITE_BATCH,
                   partition_by: Sequence[str] = ()) -> None:
    """Project, drop rows with a null required column, write snappy Parquet (each row exactly once)."""
    req = list(required or [c for c in cols if c in ("premise", "correct_answer", "incorrect_answer")])
    out = df.select(*cols, *[c for c in partition_by if c not in cols]).dropna(subset=req)
    w = out.write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", max_records)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_columns(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """Only the needed columns reach the scan (ReadSchema pruning)."""
    return spark.read.parquet(path).select(*cols)


def row_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Row count per table (Parquet footers via aggregate push-down)."""
    out = None
    for name, p in paths.items():
        c = spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


# ------------------------------------------------------------------ S10-S12

def write_results_csv(df: DataFrame, path: str) -> None:
    """Per-sample / summary CSV with header."""
    write_csv(df, path)


def write_summary_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per row (e.g. per dataset)."""
    df.write.mode("overwrite").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def _rename(spark: SparkSession, src: str, dst: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    s, d = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
    return s.getFileSystem(conf).rename(s, d)


def skip_if_done(spark: SparkSession, path: str, compute: Callable[[], DataFrame], fmt: str = "parquet") -> DataFrame:
    """Reuse a finished output (``_SUCCESS`` present) or compute, write to staging and publish by rename."""
    if _exists(spark, f"{path}/_SUCCESS"):
        return spark.read.format(fmt).load(path)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    compute().write.mode("overwrite").format(fmt).save(staging)
    if not _rename(spark, staging, path) and not _exists(spark, f"{path}/_SUCCESS"):
        raise OSError(f"could not publish {staging} -> {path}")
    return spark.read.format(fmt).load(path)


# ------------------------------------------------------------------ S13

KNOWN_TYPES = ("pairs", "triplets", "pkl", "prepared")


def dataset_registry(spark: SparkSession, path: str) -> DataFrame:
    """The declarative dataset table of a JSON file: ``{name: {file, type, columns, split, difficulty}}``.

    Read by Spark, so the file may lie on any file system. Missing maps are empty; a file that is not such
    an object raises.
    """
    kind = "map<string,struct<file:string,type:string,columns:map<string,string>,split:map<string,string>,difficulty:string>>"
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", kind, {"mode": "FAILFAST"})).alias("name", "e"))
    none = F.create_map().cast("map<string,string>")
    return entries.select("name", F.coalesce("e.file", F.lit("parquet")).alias("file"), "e.type", "e.difficulty",
                          F.coalesce("e.columns", none).alias("columns"), F.coalesce("e.split", none).alias("splits"))


def validate_registry(registry: DataFrame, requested: DataFrame, name_col: str = "name") -> DataFrame:
    """Requested names against the registry: 'ok', 'unknown' (warned and skipped) or 'bad_type'."""
    j = requested.select(name_col).distinct().join(registry.withColumn("_listed", F.lit(True)), name_col, "left")
    status = (F.when(F.col("_listed").isNull(), "unknown")
              .when(~F.coalesce(F.col("type").isin(list(KNOWN_TYPES)), F.lit(False)), "bad_type").otherwise("ok"))
    return j.withColumn("status", status).drop("_listed")


def warn_unknown(validated: DataFrame, name_col: str = "name") -> list[str]:
    bad = [r[name_col] for r in validated.where("status <> 'ok'").select(name_col).collect()]
    for b in bad:
        warnings.warn(f"dataset {b!r} is not in the registry or has a bad type; skipped")
    return bad


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": lambda spark, path: spark.read.parquet(path),
    "csv": lambda spark, path: spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path),
    "tsv": lambda spark, path: read_tsv(spark, path),
    "json": lambda spark, path: spark.read.json(path),
}


def build_sources(spark: SparkSession, registry: DataFrame, requested: DataFrame, root: str, key_col: str = "row_id", batch_size: int | None = None) -> DataFrame:
    """S13 + T12: the requested sources of a registry as one lazy plan of triplets.

    A source is read from ``root/name/folder`` for each (split -> folder) of its entry by its ``file`` format, its columns are
    renamed, and its type decides what happens (triplets keep their negatives, pairs draw them inside
    the split, prepared tables pass). Unknown names and bad types are warned about and skipped; with nothing left
    the result is empty. A source without a key column is keyed by a hash of its row. The registry is a configuration file: one plan branch per source and split.
    Result: source, split, difficulty, key, premise, correct_answer, incorrect_answer.
    """
    from tripletframe.operators.triplets import DEFAULT_BATCH, TRIPLET_COLS, prepare_source

    checked = validate_registry(registry, requested)
    warn_unknown(checked)
    out = None
    for e in checked.where("status = 'ok'").orderBy("name").collect():
        for split, folder in sorted((e["splits"] or {}).items()):
            x = READERS[e["file"]](spark, f"{root}/{e['name']}/{folder}")
            key = F.col(key_col).cast("long") if key_col in x.columns else F.xxhash64(*x.columns)
            x = prepare_source(x.withColumn(key_col, key), e["type"], e["columns"], batch_size or DEFAULT_BATCH, key_col)
            x = x.select(F.lit(e["name"]).alias("source"), F.lit(split).alias("split"), F.lit(e["difficulty"]).alias("difficulty"), key_col, *TRIPLET_COLS)
            out = x if out is None else out.unionByName(x)
    if out is None:
        fields = ", ".join(["source string, split string, difficulty string", f"{key_col} long", *(f"{c} string" for c in TRIPLET_COLS)])
        return spark.createDataFrame([], fields)
    return out
