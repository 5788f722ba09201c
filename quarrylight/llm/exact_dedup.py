"""Exact dedup over a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 digest of a text.  A batch of
documents is reduced to one row per digest (map-side first, so thousands of copies cost one row
per task), anti-joined to the index by sort-merge, which reads the index without a shuffle, and
what is new is appended.  Texts never travel: only 32-byte digests do.

An index row names the batch that appended it, a hash of the batch's digests and ids.  A batch that is
run again, after a lost driver or a task that was repeated, finds its own rows, doesn't count them as
known, appends what is missing and gives the same result as the first time.

Defined results
---------------
* A null text counts as the empty text.  Null ids are ids like any other and sort lowest.
* Rows that repeat both id and text are one document: it is returned once, and each of its rows
  counts in ``group_size``.  One id with two texts is two documents.
* Of equal texts in a batch the largest id stays, unless the index already knew the text; then
  ``keep_id`` is the id in the index and nothing of the batch is kept.  The same batch again is no
  further batch: it gives the same result.
* Of rows that repeat id and text and differ in other columns, the one that is first as JSON stays.
* Only the two named columns are read, so further columns may have any names.
* An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_width

KEY = "digest"


def digest_of(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class DigestIndex:
    """``digest -> keep_id, batch`` as a table with ``buckets`` buckets, each sorted by digest.

    ``location`` may hold an index of an earlier session: declaring the table again over the same
    folder makes it readable, as long as ``buckets`` is the number it was made with.
    """

    def __init__(self, spark: SparkSession, table: str, location: str, buckets: int, id_type: str = "bigint"):
        self.spark, self.table, self.location, self.buckets = spark, table, location, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({KEY} BINARY, keep_id {id_type}, batch BIGINT) USING parquet "
            f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def without(self, heads: DataFrame, of: DataFrame) -> DataFrame:
        """The heads whose digest is not among some rows of the index, by a sort-merge anti-join."""
        return heads.join(of.select(KEY).hint("merge"), KEY, "left_anti")

    def drop(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def append(self, heads: DataFrame) -> None:
        """Each task writes one bucket: rows are dealt out by the hash that numbers the buckets."""
        (
            heads.select(KEY, "keep_id", "batch")
            .repartition(self.buckets, KEY)
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, KEY)
            .sortBy(KEY)
            .saveAsTable(self.table)
        )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    index: DigestIndex | None = None,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, and id_rows, its input rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    own = index or new_index(docs, scratch, id_col)
    pairs = scratch.keep(
        "pairs",
        docs.select(F.col(f"`{id_col}`").alias("id"), digest_of(F.col(f"`{text_col}`")).alias(KEY))
        .groupBy("id", KEY)
        .agg(F.count(F.lit(1)).alias("id_rows")),
    )
    heads = scratch.keep(
        "heads",
        pairs.groupBy(KEY).agg(F.max(F.struct("id")).getField("id").alias("keep_id"), F.sum("id_rows").alias("group_size")),
    )
    batch = heads.agg(F.sum(F.xxhash64(KEY, "keep_id").cast("decimal(20, 0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    batch = batch.select(F.xxhash64(F.col("s").cast("string"), "n")).first()[0]
    mine, others = own.rows().where(F.col("batch") == batch), own.rows().where(F.col("batch") != batch)
    fresh = scratch.keep("fresh", own.without(heads, others).select(KEY, "keep_id", "group_size", F.lit(True).alias("fresh")))
    known = heads.join(fresh.select(KEY), KEY, "left_anti").select(KEY, "group_size")
    known = known.join(others, KEY).select(KEY, "keep_id", "group_size", F.lit(False).alias("fresh"))
    verdicts = scratch.keep("verdicts", fresh.unionByName(known))
    missing = own.without(fresh, mine) if index else fresh
    own.append(missing.withColumn("batch", F.lit(batch)))
    if index is None:
        own.drop()
    return pairs.join(verdicts.hint("merge"), KEY).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("fresh") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex(KEY)).alias("text_sha256"),
        "id_rows",
    )


def new_index(docs: DataFrame, scratch: Scratch, id_col: str) -> DigestIndex:
    """An empty index for one run, with a bucket for each shuffle partition."""
    name = "quarrylight_digests_" + scratch.path.rpartition("-")[2]
    kind = docs.schema[id_col].dataType.simpleString()
    return DigestIndex(docs.sparkSession, name, f"{scratch.path}/index", shuffle_width(docs.sparkSession), kind)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text, one stays."""
    marks = exact_dedup(docs, id_col, text_col, index).where("kept")
    marks = marks.select(F.col(f"`{id_col}`").alias("mid"), F.unhex("text_sha256").alias("mdigest"), (F.col("id_rows") > 1).alias("again"))
    marks = Scratch(docs.sparkSession, "exact-kept").keep("marks", marks)
    # documents travel as one column, so their names can't clash with those used here
    tagged = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), digest_of(F.col(f"`{text_col}`")).alias(KEY))

    def of(which: DataFrame) -> DataFrame:
        on = (F.col(KEY) == F.col("mdigest")) & F.col("id").eqNullSafe(F.col("mid"))
        return tagged.join(which.select("mid", "mdigest").hint("merge"), on, "left_semi")

    kept = of(marks.where("NOT again")).select("row")
    if not marks.where("again").isEmpty():
        again = of(marks.where("again")).groupBy(KEY).agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.unionByName(again.select("row"))
    return kept.select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", F.col("group_size").cast("bigint"), "kept", "text_sha256")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
