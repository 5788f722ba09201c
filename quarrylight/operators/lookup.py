"""Symbols and matching lines."""

from __future__ import annotations

import re

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import USER, CorpusError
from ..functions import constants as C
from ..functions import paths
from .ranking import ORDER

# ---- filters ----


def filtered(rows: DataFrame, repos: list[str] | None = None, langs: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Rows of some repositories, languages and paths; what isn't given doesn't filter."""
    if repos:
        rows = rows.where(F.col("repo").isin(repos))
    if langs:
        rows = rows.where(F.col("lang").isin([x.lower() for x in langs]))
    return rows.where(paths.matches_glob(F.col("path"), path)) if path else rows


# ---- symbols ----


def enclosing_chunk(points: DataFrame, chunks: DataFrame, line: str = "line") -> DataFrame:
    """Adds start_line, end_line, symbol and kind of the chunk around each point (repo, path, line), null where none is.

    Chunks of a file are disjoint, so a hash join on the file with the lines as residual has at most
    one match for each point.
    """
    c = chunks.select(F.col("repo").alias("r"), F.col("path").alias("p"), "start_line", "end_line", F.col("symbol").alias("chunk_symbol"), F.col("kind").alias("chunk_kind"))
    inside = (F.col("repo") == F.col("r")) & (F.col("path") == F.col("p")) & F.col(line).between(F.col("start_line"), F.col("end_line"))
    return points.join(c, inside, "left").drop("r", "p")


def unqualified(query: str) -> str:
    """The lower-cased last part of a qualified name."""
    return re.split(r"[.:]", query.lower())[-1]


def match_class(name: Column, query: str) -> Column:
    """0 equal, 1 equal but for case, 2 begins with it, 3 holds it; null otherwise.  A qualifier of the query is cut off for 1 to 3."""
    low, lower = unqualified(query), F.lower(name)
    return F.when(name == query, 0).when(lower == low, 1).when(lower.startswith(low), 2).when(lower.contains(low), 3)


def find_symbols(symbols: DataFrame, files: DataFrame, query: str, limit: int = C.SYMBOL_LIST) -> DataFrame:
    """The first symbols that match: repo, path, lang, flags, name, kind, line, match, list_place, in the list's order."""
    found = symbols.withColumn("match", match_class(F.col("name"), query)).where("match is not null")
    own = found.join(files.select("repo", "path", "lang", "flags"), ["repo", "path"])
    plain = F.col("flags").bitwiseAND(C.TEST | C.VENDOR | C.GENERATED) != 0
    keys = ["match", plain.cast("int"), F.octet_length("name"), "repo", "path", "line", "name"]
    listed = own.orderBy(*keys).limit(limit)
    return listed.withColumn("list_place", F.row_number().over(Window.orderBy(*keys)))  # of at most ``limit`` rows


def rank_symbols(listed: DataFrame, query: str, limit: int = C.SYMBOL_LIMIT) -> DataFrame:
    """Hits of the best class; others only fill up half of the list, in the list's order."""
    everything = Window.partitionBy(F.lit(1))  # the listed symbols, a bounded number
    cls = F.greatest("match", F.lit(1))
    own = listed.withColumn("best", F.min(cls).over(everything)).withColumn("is_best", cls == F.col("best"))
    before = Window.orderBy("list_place")
    own = own.withColumn("n_before", F.row_number().over(before) - 1)
    own = own.where(F.col("is_best") | (F.col("n_before") < limit // 2))
    score = F.element_at(F.array(*map(F.lit, C.MATCH_SCORE)), F.col("match") + 1) * paths.penalty(F.col("flags"), query)
    own = own.withColumn("score", score)
    order = Window.orderBy(F.desc(F.round("score", 9)), "repo", "path", "line", "list_place")
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("best", "is_best", "n_before", "list_place")


# ---- lines ----


def smart_case(pattern: str) -> bool:
    """Whether case is ignored: the pattern has no capital."""
    return pattern == pattern.lower()


def line_match(text: Column, pattern: str, fixed: bool) -> Column:
    if fixed:
        return F.lower(text).contains(pattern.lower()) if smart_case(pattern) else text.contains(pattern)
    return text.rlike(("(?i)" if smart_case(pattern) else "") + pattern)


def check_regex(pattern: str) -> str:
    """The pattern, if the engine that will match it can read it."""
    try:
        SparkSession.active().sql("SELECT '' RLIKE :p", args={"p": pattern}).collect()
    except (PySparkException, Py4JError) as e:
        why = str(e).splitlines()[0]
        raise CorpusError(USER, f"invalid regex {pattern!r}: {why}", "quote it for an exact search") from e
    return pattern


def grep(files: DataFrame, pattern: str, fixed: bool = True, per_file: int = C.MATCHES_PER_FILE, most: int | None = C.MATCHES) -> DataFrame:
    """Matching lines: repo, path, line, text; the first ones of each file and, if ``most`` is given, of all files in order of place.

    A file is searched within its row, so only matches leave a task.  Files over the size limit aren't searched.
    """
    from ..sources.corpus import line_array

    own = files.where(F.octet_length("text") <= C.MAX_BYTES)
    whole = F.col("text").contains(pattern) if fixed and not smart_case(pattern) else F.lower("text").contains(pattern.lower()) if fixed else None
    if whole is not None and "\n" not in pattern:
        own = own.where(whole)  # cheaper than cutting lines
    numbered = F.transform(line_array(F.col("text")), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    hits = F.slice(F.filter(numbered, lambda x: line_match(x["text"], pattern, fixed)), 1, per_file)
    rows = own.select("repo", "path", F.explode(hits).alias("m")).select("repo", "path", "m.line", F.col("m.text").alias("text"))
    return rows if most is None else rows.orderBy("repo", "path", "line").limit(most)


def group_by_chunk(matches: DataFrame, chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Matches by enclosing chunk: repo, path, start_line, end_line, symbol, kind, n, match_lines.  Others get five lines around them."""
    own = enclosing_chunk(matches, chunks)
    start = F.coalesce("start_line", F.greatest(F.lit(1), F.col("line") - 5))
    end = F.coalesce("end_line", F.col("line") + 5)
    own = own.select(
        "repo", "path", "line", start.alias("start_line"), end.alias("end_line"), F.coalesce("chunk_symbol", F.lit("")).alias("symbol"), F.coalesce("chunk_kind", F.lit("match")).alias("kind")
    )
    first = F.min_by(F.struct("end_line", "symbol", "kind"), F.col("line")).alias("c")
    by = own.groupBy("repo", "path", "start_line").agg(first, F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("line")).alias("match_lines"))
    return by.select("repo", "path", "start_line", "c.end_line", "c.symbol", "c.kind", "n", "match_lines")


def grep_score(groups: DataFrame, pattern: str, fixed: bool) -> DataFrame:
    """Adds score to groups with flags: the number of matches, the symbol, the file name, and penalties."""
    low = pattern.lower()
    score = 1 + F.log(1 + F.col("n").cast("double"))
    if fixed:
        symbol = F.lower("symbol")
        score = score * F.when((symbol != "") & (symbol == low), 3.0).when((symbol != "") & symbol.contains(low), 2.0).otherwise(1.0)
        score = score * F.when(F.lower(paths.basename(F.col("path"))).contains(low), 1.3).otherwise(1.0)
    return groups.withColumn("score", score * paths.penalty(F.col("flags"), pattern))


def top_groups(groups: DataFrame, limit: int = C.GREP_LIMIT) -> DataFrame:
    best = groups.orderBy(F.desc(F.round("score", 9)), *ORDER).limit(limit)
    order = Window.orderBy(F.desc(F.round("score", 9)), *ORDER)  # of at most ``limit`` rows
    return best.withColumn("place", F.row_number().over(order))
