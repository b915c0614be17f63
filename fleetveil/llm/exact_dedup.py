"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by the SHA-256 of the normalised text. A
batch of documents is reduced to one row per digest (a partial aggregate absorbs a group of
copies of any size before the shuffle), dropped where the index already holds the digest by a
sort-merge anti-join that reads the index without shuffling it, and the rest is appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, new_folder, shuffle_width, stored, text_or_empty


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row; a null text counts as an empty one."""
    return docs.select("doc_id", digest(normalised(text_or_empty())).alias("digest"))


class DigestIndex:
    """One row per distinct text ever appended: (digest, keep_id), bucketed by digest.

    ``folder`` holds the files. The number of buckets is fixed when the index is made; give
    the same number when an existing folder is opened by a later job.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.table = "digest_index_" + folder.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
            f"LOCATION '{folder}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The batch's new texts: (digest, keep_id) with the smallest doc_id of each.

        Rows whose doc_id is null stand for a text only if no other row has it. The firsts are
        stored, or the optimiser would move the anti-join below the aggregate, and all copies
        of a text would be shuffled.
        """
        firsts = stored(
            batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id")), "dedup-firsts"
        )
        return firsts.join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, batch: DataFrame) -> None:
        """Deduplicate a batch of (doc_id, digest) and add what is new, as one job."""
        new = self.unseen(batch).repartition(self.buckets, "digest")
        (
            new.write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.folder).saveAsTable(self.table)
        )

    def drop(self) -> None:
        """Forget the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def resolve(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Every row with the row that stands for its text.

    Both sides are shuffled by digest, so that a text with a third of all rows is split by
    the skew join; the bucketed layout is not used here because it would pin the hot bucket
    to one task.
    """
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    keepers = index.spark.read.schema(index.rows().schema).parquet(index.folder)
    groups = stored(keepers.join(sizes, "digest"), "dedup-groups")
    out = rows.join(groups.hint("merge"), "digest")
    return out.select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, batches: int = 2, index_folder: str | None = None) -> DataFrame:
    """One row per document: which document stands for its text, and how many share it.

    ``docs`` enters the index in ``batches`` of ascending doc_id, as documents arrive over
    time; the result does not depend on their number. Null text counts as empty, white space
    runs as one blank. Rows repeated with one doc_id are all marked kept if that id is the
    smallest of its text. A null doc_id goes with the last batch and never stands for a text
    that another row has; if it is the only one, keep_id is null and kept false. Other columns
    are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs), "dedup-digests")
    index = DigestIndex(
        spark, index_folder or new_folder(spark, "digest-index"), shuffle_width(spark)
    )
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        index.append(rows)
    else:
        edges = [low + (high - low + 1) * i // batches for i in range(batches + 1)]
        for start, end in zip(edges, edges[1:]):
            batch = (F.col("doc_id") >= start) & (F.col("doc_id") < end)
            if end == edges[-1]:
                batch = batch | F.col("doc_id").isNull()
            index.append(rows.where(batch))
    return resolve(rows, index)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP7_SQL = """
WITH d AS (
    SELECT doc_id,
           sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
), g AS (
    SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
