"""A trigram index over files, so that a search for a text or a pattern reads only files that may match.

Tables below a folder:

* ``files``: the files, partitioned by ``part``, a hash of repo and path, and sorted by them
* ``grams``: gram, repo, path, part, sorted by gram: each distinct run of three characters of a file's lower-cased lines
* ``counts``: gram, n: in how many files it is, sorted by gram

A text, or what a pattern surely needs, is a set of trigrams that all have to be there.  The rarest ones are looked up (the
filter reads only row groups that hold them), files that have all of them are candidates, and only the parts that hold
candidates are read.  A pattern that needs no three characters in a row reads all files, as without an index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.sizes import broadcast_if_small
from . import lookup

#: Trigrams that are looked up for a pattern: the rarest ones, which leave few candidates for the others.
LOOKED_UP = 6
PARTS = 256
#: Trigrams that a worker hands on at once, whatever the texts of its batch hold.
AT_ONCE = 1 << 18
#: Characters whose lower case depends on what stands beside them; what holds them isn't used for a search.
_UNSURE = "ςσΣİ̇"
_SPECIAL = frozenset(r"\.[]{}()*+?^$|")


def gram_number(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def grams_of(text: str) -> list[int]:
    """The trigrams of a lower-cased text that don't go over a line's end, by number."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < 3:
        return []
    inside = (points[:-2] != 10) & (points[1:-1] != 10) & (points[2:] != 10)
    return np.unique((points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inside])


def needed_grams(text: str) -> set[int]:
    """The trigrams that a lower-cased line with the text has."""
    low = text.lower()
    return {gram_number(low[i : i + 3]) for i in range(len(low) - 2) if not set(low[i : i + 3]) & set(_UNSURE)}


def required_texts(pattern: str) -> list[list[str]]:
    """Texts that a match surely holds: one of the lists applies (an alternative each), and of it all texts.

    Only what is plain at the top level counts; groups, classes and everything special end a text.
    """
    if any(x in pattern for x in ("(?", "\\Q", "\\E")):
        return [[]]
    alternatives, texts, run, i = [], [], "", 0

    def end() -> None:
        nonlocal run
        texts.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            following = pattern[i + 1 : i + 2]
            if following.isalnum() or not following or not following.isascii():
                return [[]]  # classes, references, codes: not worth a closer look
            run += following
            i += 2
        elif c in "([":
            end()
            depth, closing = 0, {"(": ")", "[": "]"}[c]
            while i < len(pattern):
                if pattern[i] == "\\":
                    i += 1
                elif c == "(" and pattern[i] == "[":
                    return [[]]
                elif pattern[i] == c:
                    depth += 1
                elif pattern[i] == closing:
                    depth -= 1
                    if not depth:
                        break
                i += 1
            i += 1
        elif c == "|":
            end()
            alternatives.append(texts)
            texts = []
            i += 1
        elif c in "?*{":
            run = run[:-1]  # the last character may be missing
            end()
            i = pattern.find("}", i) + 1 if c == "{" else i + 1
            if not i:
                return [[]]
        elif c in _SPECIAL:
            end()
            i += 1
        else:
            run += c
            i += 1
    end()
    return [*alternatives, texts]


def gram_batches(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """gram, repo, path, part of each text (``low``), some ``most`` rows at once."""
    for b in batches:
        own, row, size = [], [], 0
        for i, text in enumerate(b.column("low")):
            own.append(grams_of(text.as_py()))
            row.append(i)
            size += len(own[-1])
            if size >= most or i + 1 == b.num_rows:
                at = pa.array(np.repeat(row, [len(g) for g in own]))
                grams = np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grams), *(b.column(c).take(at) for c in ("repo", "path", "part"))], ["gram", "repo", "path", "part"])
                own, row, size = [], [], 0


class Grams:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.files, self.grams, self.counts = (spark.read.parquet(f"{folder}/{t}") for t in ("files", "grams", "counts"))

    @classmethod
    def write(cls, files: DataFrame, folder: str, parts: int = PARTS) -> Grams:
        """Indexes files (repo, path, text, ...); those that no search reads (null or too long texts) have no trigrams."""
        spark = files.sparkSession
        place = F.pmod(F.xxhash64("repo", "path"), F.lit(parts)).cast("int")
        own = files.withColumn("part", place)
        own.repartition("part").sortWithinPartitions("part", "repo", "path").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/files")
        stored = spark.read.parquet(f"{folder}/files").where(F.octet_length("text") <= C.MAX_BYTES)

        low = stored.select("repo", "path", "part", F.lower(F.replace("text", F.lit("\r\n"), F.lit("\n"))).alias("low"))
        low.mapInArrow(gram_batches, "gram bigint, repo string, path string, part int").write.mode("overwrite").parquet(f"{folder}/_staged")
        staged = spark.read.parquet(f"{folder}/_staged")  # bounds of ranges are sampled from what is stored
        order = ["gram", "repo", "path"]
        staged.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/grams")
        counts = staged.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/counts")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_staged")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return cls(spark, folder)

    def candidates(self, pattern: str, fixed: bool = True) -> DataFrame | None:
        """repo, path, part of the files that may match, or None where the pattern doesn't say."""
        alternatives = [[pattern]] if fixed else required_texts(pattern)
        needs = [set().union(*map(needed_grams, texts)) for texts in alternatives]
        if not all(needs):
            return None
        asked = sorted(set().union(*needs))
        often = dict(self.counts.where(F.col("gram").isin(asked)).collect())  # as many rows as the pattern has trigrams
        out = None
        for need in needs:
            rare = sorted(need, key=lambda g: (often.get(g, 0), g))[:LOOKED_UP]
            have = self.grams.where(F.col("gram").isin(rare)).groupBy("repo", "path", "part").agg(F.count(F.lit(1)).alias("n"))
            have = have.where(F.col("n") == len(rare)).drop("n")
            out = have if out is None else out.unionByName(have)
        return out.distinct()

    def files_for(self, pattern: str, fixed: bool = True) -> DataFrame:
        """The files that may match; of the others no text is read, as far as they are in other parts."""
        found = self.candidates(pattern, fixed)
        if found is None:
            return self.files.drop("part")
        found = found.persist()
        parts = [r[0] for r in found.select("part").distinct().collect()]  # at most as many as there are parts
        rows = self.files.where(F.col("part").isin(parts))
        return rows.join(broadcast_if_small(found), ["repo", "path", "part"], "left_semi").drop("part")

    def grep(self, pattern: str, fixed: bool = True, **how) -> DataFrame:
        """As ``lookup.grep`` over all files."""
        return lookup.grep(self.files_for(pattern, fixed), pattern, fixed, **how)
