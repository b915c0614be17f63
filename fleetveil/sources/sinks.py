"""Sinks: stored tables, query exports, noisy results, metric summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPORT_SCHEMA = (
    "table string, status string, rows long, bytes long, fraction double, error string"
)


def create_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def counted_write(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write a frame and count its rows in the same pass."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def write_table(
    df: DataFrame,
    path: str | None = None,
    table: str | None = None,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    bucket_by: tuple[str, int] | None = None,
) -> int:
    """Replace a stored table; returns its row count.

    Partition by the day column where queries filter on it. Sorting within the
    written files gives Parquet row-group ranges on the device key, the role an
    index plays elsewhere. ``bucket_by`` (catalog tables only) places the rows by
    device, so that later folds and joins on the device need no shuffle; it suits
    tables already folded per device and day, where no device has many rows.
    """
    if bucket_by is not None and table is None:
        raise ValueError("bucketing needs a catalog table")
    # Rebalancing lets AQE split a day that holds much of the data and merge small ones.
    laid_out = df.hint("rebalance", *partition_by) if partition_by else df
    if bucket_by is not None and not partition_by:
        # One task per bucket, so each bucket becomes one file.
        laid_out = df.repartition(bucket_by[1], bucket_by[0])
    order = [*partition_by, *[c for c in sort_by if c not in partition_by]]
    laid_out = laid_out.sortWithinPartitions(*order) if order else laid_out

    def write(frame: DataFrame) -> None:
        writer = frame.write.mode("overwrite")
        writer = writer.partitionBy(*partition_by) if partition_by else writer
        if bucket_by is not None:
            writer = writer.bucketBy(bucket_by[1], bucket_by[0])
            writer = writer.option("path", path) if path is not None else writer
        if table is not None:
            writer.saveAsTable(table)
        else:
            writer.parquet(path)

    return counted_write(laid_out, write)


def run_report(
    spark: SparkSession,
    jobs: Mapping[str, Callable[[], tuple[int, int | None, float | None]]],
    at_once: int = 4,
) -> DataFrame:
    """Run named jobs, each returning (rows, bytes, fraction); a failing job is
    recorded and the rest go on. The report has one row per job. A few jobs run at
    once, so that small tables do not leave a cluster idle."""

    def outcome(name: str) -> tuple:
        try:
            count, size, fraction = jobs[name]()
            status = "ok" if fraction is None or fraction >= 1.0 else "sampled"
            return name, status, count, size, fraction, None
        except FileNotFoundError as missing:
            return name, "missing", None, None, None, str(missing)
        except Exception as failure:  # noqa: BLE001 - reported, not hidden
            first_line = str(failure).splitlines()[0] if str(failure) else repr(failure)
            return name, "failed", None, None, None, first_line

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(outcome, jobs))
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Store every table of a lazy mapping as Parquet under ``folder``."""
    names = list(tables)
    spark = tables[names[0]].sparkSession

    def job(name: str):
        frame = tables[name]
        keys = [c for c in ("guid", "dt") if c in frame.columns]
        return write_table(frame, f"{folder}/{name}", sort_by=keys), None, None

    return run_report(spark, {n: (lambda n=n: job(n)) for n in names})


def export_results(
    spark: SparkSession, results: Mapping[str, Callable[[], DataFrame]], folder: str
) -> DataFrame:
    """Write each result as CSV with a header to ``folder/query=<name>``."""

    def job(name: str):
        target = f"{folder}/query={name}"
        rows = counted_write(
            results[name](), lambda df: df.write.mode("overwrite").csv(target, header=True)
        )
        return rows, None, None

    return run_report(spark, {n: (lambda n=n: job(n)) for n in results})


def write_csv(df: DataFrame, folder: str, files: int | None = None) -> int:
    """A folder of gzip CSV files with a header each; returns the number of rows.

    One task writes a file and one reads it. Without ``files`` their number follows the size of
    the rows: AQE cuts them into parts of its advisory size.
    """
    return counted_write(
        df.hint("rebalance") if files is None else df.repartition(files),
        lambda frame: frame.write.mode("overwrite").csv(folder, header=True, compression="gzip"),
    )


def noisy_only(released: DataFrame) -> DataFrame:
    return released.drop(*[c for c in released.columns if c.startswith("true_")])


#: How a stored release is laid out, and its columns.
RELEASE_KEYS = ("mechanism", "variant", "epsilon", "query_num")
RELEASE_CELLS = (
    "group_key string, item string, column string, noisy_value double, mechanism string, "
    "variant string, epsilon string, query_num int"
)


def write_release(released: DataFrame, folder: str, others_stay: bool = False) -> None:
    """Noisy cells or winners, laid out by mechanism, variant, epsilon and query.

    A frame that still has a true column is refused: ``noisy_only`` takes them off. With
    ``others_stay`` only the partitions that the frame has rows for are replaced.
    """
    true = [c for c in released.columns if c.startswith("true_")]
    if true:
        raise ValueError(f"true values must not be stored with the noise: {', '.join(true)}")
    mode = "dynamic" if others_stay else "static"
    (
        released.hint("rebalance", *RELEASE_KEYS).write.mode("overwrite")
        .option("partitionOverwriteMode", mode).partitionBy(*RELEASE_KEYS).parquet(folder)
    )


def read_release(spark: SparkSession, folder: str, schema: str = RELEASE_CELLS) -> DataFrame:
    """A stored release with its types: an epsilon is a label, not a number."""
    return spark.read.schema(schema).parquet(folder)


def write_summary(summary: DataFrame, folder: str, as_csv: bool = False) -> None:
    writer = summary.write.mode("overwrite")
    writer.csv(folder, header=True) if as_csv else writer.parquet(folder)
