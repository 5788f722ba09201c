"""Many fixed texts found in one scan of the files, by an automaton of all of them.

The automaton is built in each worker from the patterns, which travel with the task: at most PATTERN_BYTES of them.
Beyond that they are dealt into slices of that size, and each slice is a scan of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from .lookup import smart_case

#: Bytes of patterns that are searched at once; an automaton needs some thirty times as much.
PATTERN_BYTES = 4 << 20
#: Parts in which a query's matches are cut down to what may count.
DEALT = 16

Patterns = tuple[tuple[int, str], ...]


@functools.lru_cache(maxsize=4)
def _automaton(patterns: Patterns) -> ahocorasick.Automaton:
    """Finds the patterns; the value of each is the numbers of all that are equal to it, and its length."""
    by_text: dict[str, list[int]] = {}
    for number, text in patterns:
        by_text.setdefault(text, []).append(number)
    made = ahocorasick.Automaton()
    for text, numbers in by_text.items():
        made.add_word(text, (numbers, len(text)))
    made.make_automaton()
    return made


def _slices(patterns: DataFrame, most: int) -> Iterator[list]:
    """(query, pattern) without empty patterns, in parts of at most ``most`` bytes, dealt out by a hash."""
    own = patterns.select("query", "pattern").where("pattern <> ''").distinct()
    size = own.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    n = -(-size // most)
    for i in range(n):
        if rows := own.where(F.pmod(F.xxhash64("pattern", "query"), F.lit(n)) == i).collect():
            yield rows


def _union(parts: list[DataFrame], files: DataFrame, schema: str) -> DataFrame:
    out = parts[0] if parts else files.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def holding(files: DataFrame, patterns: DataFrame, most: int = PATTERN_BYTES) -> DataFrame:
    """query, repo, path of the files whose text holds the whole pattern, for patterns (query, pattern); a null text holds none."""
    kind = patterns.schema["query"].dataType.simpleString()
    schema = f"query {kind}, repo string, path string"

    def one(rows: list) -> DataFrame:
        queries, texts = [r["query"] for r in rows], tuple((i, r["pattern"]) for i, r in enumerate(rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(texts)
            for b in batches:
                found, row = [], []
                for i, text in enumerate(b.column("text")):
                    own = {n for _, (numbers, _) in automaton.iter(text.as_py() or "") for n in numbers}
                    found += [queries[n] for n in own]
                    row += [i] * len(own)
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.from_numpy_dtype("int64") if kind == "bigint" else None), b.column("repo").take(at), b.column("path").take(at)], ["query", "repo", "path"])

        return files.select("repo", "path", "text").mapInArrow(run, schema)

    return _union([one(rows) for rows in _slices(patterns, most)], files, schema)


def grep_many(
    files: DataFrame, patterns: DataFrame, per_file: int = C.MATCHES_PER_FILE, most: int | None = C.MATCHES, slice_bytes: int = PATTERN_BYTES
) -> DataFrame:
    """Matching lines of each pattern as ``lookup.grep`` finds them for one: query, repo, path, line, text.

    Patterns (query, pattern) without capitals ignore case.  The first ``per_file`` lines of a file count and, if ``most`` is
    given, the first ``most`` of each query in order of place.
    """
    kind = patterns.schema["query"].dataType.simpleString()
    schema = f"query {kind}, repo string, path string, line int, text string"
    own = files.where(F.octet_length("text") <= C.MAX_BYTES).select("repo", "path", "text")

    def one(rows: list) -> DataFrame:
        queries = [r["query"] for r in rows]
        any_case = tuple((i, r["pattern"].lower()) for i, r in enumerate(rows) if smart_case(r["pattern"]))
        as_is = tuple((i, r["pattern"]) for i, r in enumerate(rows) if not smart_case(r["pattern"]))

        def lines_of(text: str, found: dict[int, set[int]], patterns: Patterns) -> None:
            ends = None
            for end, (numbers, size) in _automaton(patterns).iter(text):
                if ends is None:
                    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10)
                first, last = np.searchsorted(ends, (end - size + 1, end))
                if first == last:  # a match doesn't go over the end of a line
                    for n in numbers:
                        found.setdefault(n, set()).add(int(first))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                query, row, line, text_of = [], [], [], []
                for i, value in enumerate(b.column("text")):
                    text = value.as_py().replace("\r\n", "\n")
                    found: dict[int, set[int]] = {}
                    if any_case:
                        lines_of(text.lower(), found, any_case)
                    if as_is:
                        lines_of(text, found, as_is)
                    if found:
                        lines = text.split("\n")
                        for n, at in found.items():
                            for x in sorted(at)[:per_file]:
                                query.append(queries[n]), row.append(i), line.append(x + 1), text_of.append(lines[x])
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query, pa.int64() if kind == "bigint" else None), b.column("repo").take(at), b.column("path").take(at), pa.array(line, pa.int32()), pa.array(text_of, pa.string())],
                    ["query", "repo", "path", "line", "text"],
                )

        return own.mapInArrow(run, schema)

    within = patterns.where(~F.col("pattern").contains("\n"))  # no line holds the others
    rows = _union([one(rows) for rows in _slices(within, slice_bytes)], files, schema)
    if most is None:
        return rows
    # a query's matches are cut down in DEALT parts first, so that no task reads all matches of a frequent pattern
    for by in (["query", F.pmod(F.xxhash64("repo", "path"), F.lit(DEALT))], ["query"]):
        place = Window.partitionBy(*by).orderBy("repo", "path", "line")
        rows = rows.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= most).drop("nth")
    return rows


def groups_of_many(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Matches of many queries by enclosing chunk, as ``lookup.group_by_chunk`` has them for one, with ``query``."""
    from .lookup import enclosing_chunk

    own = enclosing_chunk(matches, chunks)
    start = F.coalesce("start_line", F.greatest(F.lit(1), F.col("line") - 5))
    end = F.coalesce("end_line", F.col("line") + 5)
    own = own.select("query", "repo", "path", "line", start.alias("start_line"), end.alias("end_line"))
    by = own.groupBy("query", "repo", "path", "start_line")
    return by.agg(F.min_by("end_line", "line").alias("end_line"), F.count(F.lit(1)).alias("n"))
