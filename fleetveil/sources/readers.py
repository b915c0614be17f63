"""Sources: Parquet and gzip-CSV folders, tolerant CSV, size-targeted samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from fleetveil.functions.draws import hashed_uniform
from fleetveil.sources.sinks import run_report, write_table

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class SourceTable:
    name: str
    folder: str
    kind: str = "parquet"  # or "csv"
    tolerant: bool = False
    schema: StructType | str | None = None


def read_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)


def read_csv(
    spark: SparkSession,
    folder: str,
    schema: StructType | str | None = None,
    tolerant: bool = False,
    sampling_ratio: float | None = None,
    spread: int | None = None,
) -> DataFrame:
    """CSV with a header, gzip by file extension.

    Without ``schema`` the types are inferred, which costs a pass over
    ``sampling_ratio`` of the rows; the tolerant form infers from all rows and
    drops malformed ones. A gzip file is read by one task: ``spread`` shuffles
    the rows to that many partitions before further work.
    """
    reader = spark.read.option("header", True)
    reader = reader.option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        ratio = 1.0 if sampling_ratio is None or tolerant else sampling_ratio
        reader = reader.option("inferSchema", True).option("samplingRatio", ratio)
    rows = reader.csv(folder)
    return rows if spread is None else rows.repartition(spread)


def read_csv_with_rejects(
    spark: SparkSession, folder: str, schema: StructType
) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected lines of a CSV folder, in place of silent dropping."""
    keep = StructType(list(schema.fields)).add(CORRUPT, StringType())
    rows = (
        spark.read.option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).schema(keep).csv(folder)
    )
    # Spark refuses a scan that needs only the raw line; this always-true test keeps
    # the parsed columns referenced whatever is selected later.
    parsed = F.hash(*schema.fieldNames()) >= F.lit(-(2**31))
    return (
        rows.where(F.col(CORRUPT).isNull() & parsed).drop(CORRUPT),
        rows.where(F.col(CORRUPT).isNotNull() & parsed),
    )


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folder_exists(spark: SparkSession, folder: str) -> bool:
    files, path = _path(spark, folder)
    return files.exists(path)


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Total size of the files under a folder, from the file system's own summary."""
    files, path = _path(spark, folder)
    return files.getContentSummary(path).getLength()


def sample_fraction(size: int, target: int) -> float:
    """The fraction that brings ``size`` bytes down to ``target``; 1 if they are few enough."""
    return 1.0 if size <= target else target / size


def sample_by_key(
    rows: DataFrame, fraction: float, seed: str, keys: Sequence[str] | None = None
) -> DataFrame:
    """The rows whose hash of seed and key columns (all by default) lies below ``fraction``.

    A row's fate depends on its own values only, so the sample is the same however the table
    is partitioned; rows with equal keys are kept or left out together.
    """
    if fraction >= 1.0:
        return rows
    parts = [rows[f"`{k}`"] for k in (keys or rows.columns)]
    return rows.where(hashed_uniform(seed, *parts) < F.lit(float(fraction)))


def read_source(spark: SparkSession, source: SourceTable) -> DataFrame:
    if not folder_exists(spark, source.folder):
        raise FileNotFoundError(f"no folder for {source.name}: {source.folder}")
    if source.kind == "parquet":
        return read_parquet(spark, source.folder)
    return read_csv(spark, source.folder, source.schema, source.tolerant)


def read_sampled(
    spark: SparkSession,
    source: SourceTable,
    fraction: float,
    seed: str,
    keys: Sequence[str] | None = None,
) -> tuple[DataFrame, int, float]:
    """A sample of the table, its stored bytes and the fraction: see ``sample_by_key``."""
    rows = read_source(spark, source)
    size = folder_bytes(spark, source.folder)
    return sample_by_key(rows, fraction, seed, keys), size, fraction


def load_tables(
    spark: SparkSession,
    sources: Sequence[SourceTable],
    folder: str,
    fractions: Mapping[str, float] | None = None,
    seed: str = "",
) -> DataFrame:
    """Load sources into stored tables; a table named in ``fractions`` is sampled.
    Returns (table, status, rows, bytes, fraction, error): a missing or
    unreadable source is one row of the report and does not stop the others."""

    def job(source: SourceTable):
        fraction = (fractions or {}).get(source.name, 1.0)
        rows, size, fraction = read_sampled(spark, source, fraction, seed)
        return write_table(rows, f"{folder}/{source.name}"), size, fraction

    return run_report(spark, {s.name: (lambda s=s: job(s)) for s in sources})


def list_tables(spark: SparkSession, schemas: Sequence[str]) -> DataFrame:
    """(schema, table) of the catalog, one row per table."""
    rows = [(s, t.name) for s in schemas for t in spark.catalog.listTables(s)]
    return spark.createDataFrame(rows, "schema string, table string").orderBy("schema", "table")


def read_results(
    spark: SparkSession, folder: str, schemas: Mapping[str, StructType | str]
) -> dict[str, DataFrame]:
    """Re-read exported results with known types; absent ones are left out."""
    found = {}
    for name, schema in schemas.items():
        target = f"{folder}/query={name}"
        if folder_exists(spark, target):
            found[name] = spark.read.csv(target, header=True, schema=schema)
    return found
