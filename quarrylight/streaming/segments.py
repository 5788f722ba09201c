"""An index that grows by what changes: each batch of files becomes a segment, and nothing written before is touched.

Tables below a folder are partitioned by ``segment``: ``files`` (with text), ``chunks``, ``symbols``, ``postings``.
A segment holds the files of its batch that are new, changed or removed, and what is derived from them.
A file is live in the segment of its latest version; rows of its other segments don't count.

* What is written grows with the change, not with the index.
* A batch that is run again replaces its own partitions by the same rows.  ``files`` is written last: a batch
  that was cut off before is not visible, as no file is live in it.
* Removed files leave a row without text.
* ``merge`` rewrites the newest segments as one when they have grown beside an older one, so their number
  stays logarithmic; each row is rewritten a logarithmic number of times.
* What is on disk beside the tables is bounded: rows are shuffled in rounds, each round's shuffle files go when it is written,
  and staged rows go when they have been used.

Batches have even numbers; a merged segment has the odd number after the newest one it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sizes import broadcast_if_small
from ..operators import index

FILES = "repo string, path string, blob string, text string, lang string, size int, flags int, version bigint, segment int"
CHUNKS = "repo string, path string, start_line bigint, end_line bigint, symbol string, kind string, body string, segment int"
SYMBOLS = "repo string, path string, name string, name_lower string, kind string, line bigint, segment int"
SCHEMAS = {"files": FILES, "chunks": CHUNKS, "symbols": SYMBOLS, "postings": index.POSTINGS + ", segment int"}
#: Rows of a segment stand in this order, and are dealt out by it, so that a term or a file is in few row groups.
SORTED_BY = {"files": ["repo", "path"], "chunks": ["repo", "path"], "symbols": ["name_lower", "repo", "path"], "postings": ["term", "repo", "path"]}
PLACE = ["repo", "path"]
#: For each task that runs at once: bytes of bodies whose postings are shuffled in a round, and stored bytes that a merge shuffles in one.
ROUND, MERGED = 1 << 27, 1 << 26
#: Rows from which the bounds of a merge's rounds are taken, about.
SAMPLED = 100_000
#: Has shuffle files removed when a query is done; otherwise they stay until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: From described files (repo, path, lang, flags, text, ...) to chunks with bodies and symbols.
Cut = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def _same(a: DataFrame, b: DataFrame, *more: str) -> Column:
    """Whether rows have the same place; a repo or path that is null is one like others."""
    return reduce(and_, [a[c].eqNullSafe(b[c]) for c in [*PLACE, *more]])


def _below(columns: list[str], bound: tuple) -> Column:
    """Whether rows stand before ``bound`` in the order of the columns, nulls first; a filter that Parquet can use."""
    c, x = F.col(columns[0]), F.lit(bound[0])
    before = c.isNull() | (c < x)
    return before | ((c == x) & _below(columns[1:], bound[1:])) if columns[1:] else before


def _from(columns: list[str], bound: tuple) -> Column:
    """Whether rows stand at ``bound`` or after it."""
    c, x = F.col(columns[0]), F.lit(bound[0])
    return (c > x) | ((c == x) & _from(columns[1:], bound[1:])) if columns[1:] else c >= x


class Segments:
    def __init__(self, spark: SparkSession, folder: str, cut: Cut, stem: bool = True):
        self.spark, self.folder, self.cut, self.stem = spark, folder.rstrip("/"), cut, stem

    # ---- reading ----

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def stored(self, name: str) -> DataFrame:
        """All rows of a table, live or not."""
        path, schema = f"{self.folder}/{name}", SCHEMAS[name]
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def heads(self, before: int | None = None) -> DataFrame:
        """repo, path, blob (null: removed), version, segment of each file's latest version; texts aren't read."""
        rows = self.stored("files").select("repo", "path", "blob", "version", "segment")
        rows = rows if before is None else rows.where(F.col("segment") < before)
        latest = F.max(F.struct("version", "segment", "blob")).alias("v")
        return rows.groupBy(*PLACE).agg(latest).select(*PLACE, "v.blob", "v.version", "v.segment")

    def superseded(self) -> DataFrame | None:
        """repo, path, segment of files that a later segment holds as well; None where there is one segment, which holds a file once."""
        if len(self.numbers()) < 2:
            return None
        own = self.stored("files").select(*PLACE, "segment", "version").groupBy(*PLACE)
        own = own.agg(F.max(F.struct("version", "segment")).alias("v"), F.collect_list("segment").alias("all")).where(F.size("all") > 1)
        return own.select(*PLACE, F.explode(F.array_except("all", F.array("v.segment"))).alias("segment"))

    def live(self, name: str) -> DataFrame:
        """The rows of a table that belong to the live version of a file.

        All rows of the segments that hold files are, but those of files that a later segment holds as well.  These are as
        many as files were changed, and are sent to all rows while they are few; without any the table is read as it is.
        """
        rows = self.stored(name).where(F.col("segment").isin(self.numbers()))  # not those of a batch that was cut off
        rows = rows.where("blob is not null") if name == "files" else rows  # a removed file has no other rows
        old = self.superseded()
        if old is not None:
            rows = rows.join(broadcast_if_small(old), _same(rows, old, "segment"), "left_anti")
        return rows.select(*[c for c in rows.columns if c not in ("segment", "version")])

    def statistics(self) -> DataFrame:
        """One row: n_docs, n_tokens of the live chunks."""
        n_docs = self.live("chunks").agg(F.count(F.lit(1)).alias("n_docs"))
        return n_docs.crossJoin(self.live("postings").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens")))  # one row each

    def engine(self, **how):
        """A search engine over the live rows."""
        from ..plans.engine import Engine

        made = Engine(self.live("files"), self.live("chunks"), self.live("symbols"), self.stem, **how)
        made.postings = self.live("postings")
        made.tokens = index.token_rows(made.postings)
        row = self.statistics().first()
        made.statistics = self.spark.createDataFrame([tuple(row)], "n_docs long, n_tokens long")
        return made

    def numbers(self) -> list[int]:
        """The segments that hold files, oldest first; as many as there are partitions."""
        return sorted(r[0] for r in self.stored("files").select("segment").distinct().collect())

    # ---- writing ----

    def _ranged(self, name: str, rows: DataFrame) -> DataFrame:
        """Stored rows dealt out by ranges of their order, and sorted."""
        return rows.repartitionByRange(*SORTED_BY[name]).sortWithinPartitions(*SORTED_BY[name])

    def _write(self, name: str, rows: DataFrame, segment: int) -> None:
        """Writes rows as they are dealt out and sorted."""
        self._put(name, rows, segment, "overwrite")

    def _put(self, name: str, rows: DataFrame, segment: int, mode: str) -> None:
        columns = [c.split() for c in SCHEMAS[name].split(", ")[:-1]]
        rows = rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns])
        out = rows.withColumn("segment", F.lit(segment)).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("segment")
        out.option("compression", "zstd").parquet(f"{self.folder}/{name}")

    def _at_once(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    def _bytes(self, name: str, numbers: list[int]) -> int:
        """What the partitions of a table take where they are stored."""
        paths = [p for n in numbers if self._exists(p := f"{self.folder}/{name}/segment={n}")]
        at = [self.spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
        return sum(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in at)

    def _write_rounds(self, name: str, rounds: Iterator[DataFrame], segment: int) -> None:
        """Writes one after the other, in the place of what a batch or a merge that was cut off has left."""
        self._delete(f"{name}/segment={segment}")
        for i, rows in enumerate(rounds):
            self._put(name, rows, segment, "append") if i else self._write(name, rows, segment)

    def _staged(self, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/_staged/{name}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @contextmanager
    def _lean(self) -> Iterator[None]:
        """Shuffle files go with their query, and staged rows at the end."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            yield
            self._delete("_staged")
        finally:
            self.spark.conf.set(CLEANUP, before) if before else self.spark.conf.unset(CLEANUP)

    def _delete(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _changes(self, own: DataFrame, segment: int) -> DataFrame:
        """The rows of a staged batch that change something, with ``status``, dealt out by ranges of their place and sorted.

        What is known of their files is dealt out with them, so that texts are shuffled once, and neither joined nor grouped.
        """
        rows = own.withColumn("known", F.lit(False))
        if any(n < segment for n in self.numbers()):
            old, asked = self.heads(before=segment), broadcast_if_small(own.select(*PLACE).distinct())
            old = old.join(asked, _same(old, asked), "left_semi").drop("segment")
            rows = rows.unionByName(old.withColumn("known", F.lit(True)), allowMissingColumns=True)
        # what is known comes first, then the latest of the batch
        order = Window.partitionBy(*PLACE).orderBy(F.desc("known"), F.desc_nulls_last("version"), F.desc_nulls_last("blob"))
        rows = rows.repartitionByRange(*PLACE).withColumns({f"old_{c}": F.lag(c).over(order) for c in ("known", "blob", "version")})
        rows = rows.where("not known and coalesce(old_known, true)").where("old_known is null or version >= old_version")
        status = (
            F.when(F.col("blob").isNull() & F.col("old_blob").isNotNull(), "removed")
            .when(F.col("blob").isNotNull() & F.col("old_blob").isNull(), "added")
            .when(F.col("blob") != F.col("old_blob"), "changed")
        )
        rows = rows.withColumn("status", status).where("status is not null").drop("known", "old_known", "old_blob", "old_version")
        return rows.sortWithinPartitions(*SORTED_BY["files"])

    def _postings(self, segment: int) -> Iterator[DataFrame]:
        """Postings of a segment's chunks as written, in rounds over some of the files; a term is in a range of each round."""
        path, schema = f"{self.folder}/chunks/segment={segment}", CHUNKS.removesuffix(", segment int")
        if not self._exists(path):  # only removed files
            return
        sizes = [F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")]
        files = self.spark.read.schema(schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(*sizes).orderBy("file").collect()
        ends, at_once, lo = np.cumsum([0, *(r["bytes"] for r in files)]), self._at_once(), 0
        while lo < len(files):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + ROUND * at_once, "right")) - 1)
            if lo + at_once < hi < len(files):
                hi -= (hi - lo) % at_once  # files are of about one size, so that tasks end together
            chunks = self.spark.read.schema(schema).parquet(*[f"{path}/{r['file']}" for r in files[lo:hi]])
            yield index.ranged_postings(chunks, sum(r["n"] for r in files[lo:hi]), self.stem)
            lo = hi

    def _in_ranges(self, name: str, rows: DataFrame, stored: int) -> Iterator[DataFrame]:
        """Rows of ``stored`` bytes dealt out by ranges of their order, and sorted, in rounds that follow each other in that order."""
        columns, n = SORTED_BY[name][:2] if name in ("files", "chunks") else SORTED_BY[name][:1], -(-stored // (MERGED * self._at_once()))
        bounds: list[tuple | None] = []
        if n > 1:
            keys = rows.select(*columns)
            some = keys.sample(min(1.0, SAMPLED / max(1, keys.count())), 1).repartitionByRange(n, *columns)
            least = some.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*columns)).alias("least")).collect()
            bounds = sorted({b for b in (tuple(r["least"]) for r in least) if None not in b})[1:]
        for low, high in zip([None, *bounds], [*bounds, None]):
            own = rows if low is None else rows.where(_from(columns, low))
            yield self._ranged(name, own if high is None else own.where(_below(columns, high)))

    def apply(self, batch: DataFrame, number: int) -> dict[str, int]:
        """Batch ``number`` of described files with ``version``; a null text removes a file.  Returns the numbers added, changed and removed.

        Of several rows of a path the latest version counts, of equal versions the largest blob.  A file whose blob is live,
        or of which a later version is, is skipped.
        """
        segment = 2 * number
        blob = F.when(F.col("text").isNotNull(), F.col("blob")).alias("blob")
        own = batch.select("repo", "path", blob, "text", "lang", "size", "flags", F.col("version").cast("bigint").alias("version"))
        with self._lean():
            # a stream's batch is read once; chunks are cut where their files stand, so texts are dealt out once
            staged = self._staged("files", self._changes(self._staged("batch", own), segment))
            self._delete("_staged/batch")
            counts = {r["status"]: r["count"] for r in staged.groupBy("status").count().collect()}
            if counts:
                fresh = staged.drop("status")
                chunks, symbols = self.cut(fresh.where("blob is not null"))
                self._write("chunks", chunks.sortWithinPartitions(*SORTED_BY["chunks"]), segment)
                self._write("symbols", self._ranged("symbols", self._staged("symbols", symbols)), segment)
                self._delete("_staged/symbols")
                # postings come from the chunks as written, so that files are cut once
                self._write_rounds("postings", self._postings(segment), segment)
                self._write("files", fresh.sortWithinPartitions(*SORTED_BY["files"]), segment)
        return {k: counts.get(k, 0) for k in ("added", "changed", "removed")}

    def next_number(self) -> int:
        return (max(self.numbers(), default=-2) + 2) // 2

    def to_merge(self) -> list[int]:
        """The newest segments, as far back as one is less than twice as large as all newer ones together."""
        sizes = sorted(((r["segment"], r["count"]) for r in self.stored("files").groupBy("segment").count().collect()), reverse=True)
        total, upto = 0, 0
        for i, (_, n) in enumerate(sizes):
            if i and n < 2 * total:
                upto = i + 1
            total += n
        return sorted(s for s, _ in sizes[:upto])

    def merge(self) -> list[int]:
        """Rewrites the segments of ``to_merge`` as one and drops them; returns their numbers.

        The merged rows have a later segment and the same versions, so they become the live ones when ``files``
        is written, whole; before that nothing has changed, and after it the old rows no longer count.
        Only a merge that reaches the oldest segment forgets removed files.
        """
        with self._lean():
            used = {r[0] for r in self.heads().select("segment").distinct().collect()}
            self._drop([n for n in self.numbers() if n not in used])  # a merge that was cut off has left them
            merged = self.to_merge()
            if not merged:
                return []
            into = max(merged) + 1  # even, as a merged segment is merged again only when a batch has come after it
            oldest = min(merged) == min(self.numbers())
            old = self.superseded()
            old = None if old is None else broadcast_if_small(self._staged("merge", old))
            for name in ("chunks", "symbols", "postings", "files"):
                rows = self.stored(name).where(F.col("segment").isin(merged))
                rows = rows.where("blob is not null") if oldest and name == "files" else rows
                rows = rows if old is None else rows.join(old, _same(rows, old, "segment"), "left_anti")
                self._write_rounds(name, self._in_ranges(name, rows, self._bytes(name, merged)), into)
            self._drop(merged)
            return merged

    def _drop(self, numbers: list[int]) -> None:
        for name in SORTED_BY:
            for n in numbers:
                self._delete(f"{name}/segment={n}")


def refresh(source: DataFrame, segments: Segments, checkpoint: str) -> StreamingQuery:
    """Applies each micro-batch of a stream of described files with ``version``, until what is available has been read."""

    def run(batch: DataFrame, number: int) -> None:
        segments.apply(batch, number)

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
