"""Helpers shared by the operators: input, shared folder, hashes, Spark sizes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words in every operator here.
SPACE = "[\\x20\\x09-\\x0D]+"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not have it on their path."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in [root / "__init__.py", *sorted((root / "llm").glob("*.py"))]:
                z.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the master is local."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="fleetveil-shared-")
        context.setCheckpointDir(shared)
    return shared.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here.

    ``options`` are those of the Parquet writer.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(folder)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    It does so when the driver's garbage collection finds that nothing refers to them, which
    with a driver that does little may otherwise be long after.
    """
    spark.sparkContext._jvm.System.gc()


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a frame made by ``stored`` once nothing reads it any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by ``new_folder``, and nothing outside the shared folder."""
    root = shared_folder(spark).split(":", 1)[-1].lstrip("/")
    if folder.split(":", 1)[-1].lstrip("/").startswith(root):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, even if used inside lambda functions."""
    return F.get(F.transform(F.array(value), use), 0)


def fold_remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts
