"""The full-text index as tables: tokens, lengths, statistics, and its maintenance."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import porter, text
from ..functions.sizes import broadcast_if_small

CHUNK = ["repo", "path", "start_line"]


def stems(words: DataFrame) -> DataFrame:
    """word, term: each distinct word folded and stemmed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(term=[porter.porter(porter.fold(w)) for w in b["word"]])

    return words.select("word").distinct().mapInPandas(run, "word string, term string")


COLUMNS = ("symbol", "path", "body")
_LISTS = ("_symbol", "_path", "_body")


def _terms(words: pa.Array, stem: bool) -> pa.DictionaryArray:
    """The words by number, folded and stemmed if asked for, each distinct word of a batch once."""
    words = words.dictionary_encode()
    if stem:
        stems = pa.array([porter.porter(porter.fold(w)) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
        words = pa.DictionaryArray.from_arrays(stems.indices.take(words.indices), stems.dictionary)
    return words


def _lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


#: Tokens that a worker sums up at once, so that its memory doesn't follow the texts of a batch.
AT_ONCE = 1 << 18


def cuts(ends: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` of what is counted up to each row's end, ``rows`` at most; a larger row is a range."""
    start = 0
    while start < len(ends):
        upto = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
        end = max(start + 1, min(upto, start + rows))
        yield start, end
        start = end


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of token lists in slices of AT_ONCE tokens."""
    ends = np.cumsum(sum(_lengths(b.column(n)) for n in _LISTS))
    for lo, hi in cuts(ends, AT_ONCE, b.num_rows):
        yield b.slice(lo, hi - lo)


def occurrences(b: pa.RecordBatch, stem: bool) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of a batch its word, row, number of column and position; and of each row how many it has."""
    lists = [b.column(n) for n in _LISTS]
    sizes = [_lengths(x) for x in lists]
    row = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
    column = np.repeat(np.arange(len(sizes)), [int(s.sum()) for s in sizes])
    pos = np.concatenate([np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) for s in sizes])
    return _terms(pa.concat_arrays([x.flatten() for x in lists]), stem), row, column, pos, sum(sizes)


def token_lists(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.select("repo", "path", F.col("start_line").cast("bigint"), *more, *[text.index_tokens(F.col(c)).alias(n) for c, n in zip(COLUMNS, _LISTS)])


def _stemmed(own: DataFrame) -> DataFrame:
    """The same rows with the tokens of each column folded and stemmed; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns))
            for name in _LISTS:
                at = np.concatenate([[0], np.cumsum(_lengths(columns[name]))])
                columns[name] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), _terms(columns[name].flatten(), True).dictionary_decode())
            yield pa.RecordBatch.from_arrays(list(columns.values()), b.schema.names)

    return own.mapInArrow(run, own.schema)


def tokens(chunks: DataFrame, stem: bool = False) -> DataFrame:
    """repo, path, start_line, dl, col, pos, term: a row for each token of the symbol, path and body of chunks (with ``body``).

    ``dl`` is the chunk's number of tokens in all columns; it is counted in the row, so lengths need no join.
    """
    own = token_lists(chunks)
    own = _stemmed(own) if stem else own
    columns = F.array(*[F.struct(F.lit(c).alias("col"), F.col(n).alias("tokens")) for c, n in zip(COLUMNS, _LISTS)])
    dl = (F.size("_symbol") + F.size("_path") + F.size("_body")).cast("bigint")
    rows = own.select(*CHUNK, dl.alias("dl"), F.explode(columns).alias("c"))
    return rows.select(*CHUNK, "dl", "c.col", F.posexplode("c.tokens").alias("pos", "term"))


def postings(rows: DataFrame) -> DataFrame:
    """term, repo, path, start_line, tf (weighted by column), n (occurrences), dl, from tokens.

    A chunk's tokens come from one row, so each task sums up its postings before anything is shuffled.
    """
    weight = F.create_map(*[F.lit(x) for kv in C.WEIGHTS.items() for x in kv])[F.col("col")]
    return rows.groupBy("term", *CHUNK).agg(F.sum(weight).alias("tf"), F.count(F.lit(1)).alias("n"), F.first("dl").alias("dl"))


POSTINGS = "term string, repo string, path string, start_line bigint, tf double, n bigint, dl bigint, places array<int>"


def postings_of(chunks: DataFrame, stem: bool = False, bounds: list[str] | None = None) -> DataFrame:
    """The same straight from chunks, and ``places``, positions times four plus the number of the column.

    A chunk's tokens are summed up in its row, so nothing is shuffled.  Chunks with a ``number`` hand it on.
    With ``bounds``, terms in order, there is also ``part``, the range between bounds that a term falls into; a term that is
    several bounds is dealt out over its ranges by its path.  What a worker hands on is then in order of term.
    """
    more = ["number"] if "number" in chunks.columns else []
    weight = np.array([C.WEIGHTS[c] for c in COLUMNS])

    def parts(terms: pa.Array, code: np.ndarray, own: np.ndarray, paths: pa.Array) -> np.ndarray:
        low, high = (np.searchsorted(np.array(bounds, dtype=object), np.array(terms.to_pylist(), dtype=object), side) for side in ("left", "right"))
        crc = np.array([zlib.crc32((x or "").encode()) for x in paths.to_pylist()], dtype=np.int64)
        return (low[code] + crc[own] % (high - low + 1)[code]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            words, row, column, pos, dl = occurrences(b, stem)
            code = words.indices.to_numpy(zero_copy_only=False)
            key = row * max(1, len(words.dictionary)) + code
            if bounds is not None:
                rank = np.empty(len(words.dictionary), np.int64)
                rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(rank))
                key = rank[code] * b.num_rows + row
            order = np.argsort(key, kind="stable")
            key, row, code, column = key[order], row[order], code[order], column[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            places = pa.ListArray.from_arrays(pa.array([*first, len(key)], pa.int32()), pa.array((4 * pos[order] + column).astype(np.int32)))
            own = row[first]
            part = [] if bounds is None else [pa.array(parts(words.dictionary, code[first], own, b.column(b.schema.names.index("path"))))]
            yield pa.RecordBatch.from_arrays(
                [
                    words.dictionary.take(pa.array(code[first])), *(b.column(b.schema.names.index(c)).take(pa.array(own)) for c in CHUNK),
                    pa.array(np.add.reduceat(weight[column], first) if len(first) else np.zeros(0)), pa.array(np.diff(np.append(first, len(key)))),
                    pa.array(dl[own]), places, *(b.column(b.schema.names.index(c)).take(pa.array(own)) for c in more), *part,
                ],
                ["term", *CHUNK, "tf", "n", "dl", "places", *more, *["part" for _ in part]],
            )

    return token_lists(chunks, *more).mapInArrow(run, POSTINGS + "".join(f", {c} bigint" for c in more) + (", part int" if bounds is not None else ""))


#: Chunks from whose terms bounds are taken, about; and postings of a range.
SAMPLED, RANGE = 2_000, 1_000_000


def ranged_postings(chunks: DataFrame, n_chunks: int, stem: bool = False) -> DataFrame:
    """Postings of stored chunks, dealt out by ranges of terms and sorted by term and place.

    Bounds are those that Spark finds for the terms of a sample of chunks, so postings needn't be stored to find them;
    they decide where a posting stands and nothing else.
    """
    bounds: list[str] = []
    if n_chunks > SAMPLED // 4:
        fraction = min(1.0, SAMPLED / n_chunks)
        sample = postings_of(chunks.sample(fraction, 1), stem).select("term", "repo", "path").persist()
        total = int(sample.count() / fraction)
        n = max(1, -(-total // RANGE), min(chunks.sparkSession.sparkContext.defaultParallelism, total // 20_000))
        least = sample.repartitionByRange(n, "term", "repo", "path").groupBy(F.spark_partition_id()).agg(F.min("term").alias("term"))
        bounds = sorted(r["term"] for r in least.collect())[1:]
        sample.unpersist()
    dealt = postings_of(chunks, stem, bounds).repartitionById(len(bounds) + 1, "part").drop("part")
    return dealt.sortWithinPartitions("term", "repo", "path")


def phrase_postings(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """Postings (term, repo, path, start_line, tf, n, dl) of phrases (phrase, words: several tokens side by side in one column).

    ``rows`` are postings with places.  Those of the phrases' words meet in their chunk, each with its places moved back by the
    word's place in the phrase; what all of them share is where the phrase begins, so no row is made for a token.
    """
    asked = phrases.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("k", "term"))
    own = rows.select("term", *CHUNK, "dl", "places").join(broadcast_if_small(asked), "term")
    own = own.withColumn("at", F.transform("places", lambda p: p - 4 * F.col("k")))
    per = own.groupBy("phrase", "size", *CHUNK).agg(F.first("dl").alias("dl"), F.collect_list("at").alias("lists"))  # one list for each word
    per = per.where(F.size("lists") == F.col("size"))
    begins = F.aggregate(F.slice("lists", F.lit(2), F.col("size") - 1), F.col("lists")[0], F.array_intersect)
    weights = F.array(*[F.lit(C.WEIGHTS[c]).cast("double") for c in COLUMNS])
    per = per.withColumn("begins", begins).where(F.size("begins") > 0)
    tf = F.aggregate("begins", F.lit(0.0), lambda a, x: a + F.element_at(weights, (x % 4 + 1).cast("int")))
    return per.select(F.col("phrase").alias("term"), *CHUNK, tf.alias("tf"), F.size("begins").cast("bigint").alias("n"), "dl")


def token_rows(rows: DataFrame) -> DataFrame:
    """Tokens (repo, path, start_line, dl, col, pos, term) of postings with places."""
    place = rows.select("term", *CHUNK, "dl", F.explode("places").alias("x"))
    column = F.element_at(F.array(*map(F.lit, COLUMNS)), (F.col("x") % 4 + 1).cast("int"))
    return place.select(*CHUNK, "dl", column.alias("col"), F.expr("x div 4").cast("int").alias("pos"), "term")


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens, over the whole index and never over a filtered part.

    Lengths are counted within each chunk, so only sums leave a task.
    """
    sizes = [F.size(text.index_tokens(F.col(c))) for c in COLUMNS]
    dl = sizes[0] + sizes[1] + sizes[2]
    return chunks.select(dl.cast("bigint").alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))


def write(chunks: DataFrame, folder: str, stem: bool = True) -> None:
    """Stores postings with their places (for phrases) and statistics; texts are tokenised once."""
    write_postings(postings_of(chunks, stem), chunks.count(), folder)


def write_postings(rows: DataFrame, n_docs: int, folder: str, also: Callable[[DataFrame, DataFrame], None] | None = None) -> None:
    """Stores postings of ``n_docs`` chunks and the statistics that follow from them; ``also`` gets both as stored, with further columns.

    They are sorted by term, so that a query reads the row groups of its terms, and dealt out by
    ranges of term and place, so that a term with a large part of all postings is cut into several.
    """
    spark = rows.sparkSession
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    rows.write.parquet(staged)  # bounds of ranges are sampled from what is stored
    order = ["term", "repo", "path"]
    stored = spark.read.schema(POSTINGS).parquet(staged).repartitionByRange(*order).sortWithinPartitions(*order)
    stored.write.mode("overwrite").parquet(f"{folder}/postings")
    total = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    total.select(F.lit(n_docs).cast("bigint").alias("n_docs"), "n_tokens").coalesce(1).write.mode("overwrite").parquet(f"{folder}/statistics")
    if also is not None:
        also(spark.read.schema(rows.schema).parquet(staged), spark.read.parquet(f"{folder}/statistics"))
    path = spark._jvm.org.apache.hadoop.fs.Path(staged)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, tokens (a view of them) and statistics."""
    rows = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    return rows, token_rows(rows), spark.read.parquet(f"{folder}/statistics")


# ---- maintenance ----


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """repo, path, status: added, changed, unchanged or removed, by the blob of each path."""
    o = old.select("repo", "path", F.col("blob").alias("old_blob"))
    n = new.select("repo", "path", F.col("blob").alias("new_blob"))
    status = (
        F.when(F.col("old_blob").isNull(), "added")
        .when(F.col("new_blob").isNull(), "removed")
        .when(F.col("old_blob") == F.col("new_blob"), "unchanged")
        .otherwise("changed")
    )
    return o.join(n, ["repo", "path"], "full_outer").select("repo", "path", status.alias("status"))


def without_repos(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.where(~F.col("repo").isin(names))
