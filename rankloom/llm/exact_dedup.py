"""Exact deduplication against a persistent index of digests. DataFrame operations only.

The index is a table bucketed and sorted by the SHA-256 digest of the text, one row per distinct
text ever appended: digest, keep_id. A new batch is reduced to one row per digest (partial sums on
the map side, so a text with a third of all rows is no hot key), anti-joined with the index by a
sort-merge join that leaves the index's buckets where they are, and what is new is appended.
Appending a batch twice adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import attach, new_folder, stored, text_of

BUCKETS = 64


class DigestIndex:
    """A bucketed table ``name`` of digests in ``folder``; opened again if it is there.

    ``buckets`` belongs to the stored table: open it with the number it was made with.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, id_type: str = "bigint", buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )

    @classmethod
    def temporary(cls, spark: SparkSession, id_type: str = "bigint", buckets: int | None = None) -> DigestIndex:
        """An empty index in the shared folder, with as many buckets as shuffle partitions."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cls(spark, f"digests_{uuid.uuid4().hex}", new_folder(spark, "digests"), id_type, buckets)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add the digests of ``groups`` (digest, keep_id; one row per digest) that are not in yet."""
        new = groups.select("digest", "keep_id").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new = stored(new, "new-digests")  # the table is not read while it is written
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)


def digest(text: str = "text") -> Column:
    """SHA-256 of the text in UTF-8 as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(text_of(text).cast("binary"), 256))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept; the batch joins the index.

    ``group_size`` counts the rows of this batch with the same text. Of a text that the index knows
    from an earlier batch none is kept and keep_id is the earlier row; of a new text the largest id
    stays. Null text is the empty text. Null ids: kept only where a text has no other id. Rows that
    repeat id and text are one document and are marked alike. No rows give no rows; columns other
    than id and text are not read.
    """
    index = index or DigestIndex.temporary(docs.sparkSession, docs.schema[id].dataType.simpleString())
    rows = stored(docs.select(F.col(f"`{id}`").alias("doc_id"), digest(text).alias("digest")), "row-digests")
    groups = stored(
        rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups"
    )
    index.append(groups)
    known = index.rows().hint("merge")
    found = stored(groups.drop("keep_id").join(known, "digest"), "digest-keepers")
    total = rows.count()
    return attach(rows, found, "digest", "group_size", total).select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def unique_documents(docs: DataFrame, index: DigestIndex | None = None, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose text is kept: see ``deduplicate``.

    Dropped rows are found again by id and digest. Their list is a stored table, so Spark
    broadcasts it only if it is small and else merges by sorted keys.
    """
    dropped = deduplicate(docs, index, id=id, text=text).filter(~F.col("kept")).select(
        F.col("doc_id").alias("_dropped_id"), F.col("digest").alias("_dropped_digest")
    )
    dropped = stored(dropped.distinct(), "dropped-copies")
    same = docs[id].eqNullSafe(dropped["_dropped_id"]) & (digest(text) == dropped["_dropped_digest"])
    return docs.join(dropped, same, "left_anti")
