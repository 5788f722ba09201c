"""URL rules as a sort-merge range join.

A host becomes its reversed labels, each with a dot behind it: ``a.example.net`` is
``net.example.a.``.  A rule for a host and all its subdomains is then one interval of keys,
``[net.example., net.example/)``, and the intervals of two rules are nested or apart.  Rules and
URLs are dealt out by ranges of that key, sorted, and merged in one pass that keeps a stack of the
hosts whose interval is open, each with its paths, of which the longest that fits is looked up by length.  A rule that is open at the lower end of a range is sent to that
range too, so neither side is ever held in memory or broadcast, and a host with a third of all
rows is cut into several ranges by a checksum behind the key.

Defined results
---------------
* Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased;
  path: what follows up to ``?``, ``#`` or the end.  Null URLs and URLs without ``://`` have both empty.
* Of the rules that fit, the one with most characters (host and path together) wins, then the one
  with the longer host, then block before allow.
* A rule with an empty host fits every URL.  A URL that no rule fits gets ``default``.
* Each input row gives one row, repeated rows and null ids included; an empty table gives none.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: URLs looked at, for each range, to place the bounds of the ranges.
SAMPLE_PER_RANGE = 40

#: The rules of the query: host, path, action.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot; an empty host has an empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def url_verdicts(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.  ``rules`` has host, path, action."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col(f"`{url_col}`"))
    urls = scratch.keep(
        "urls",
        pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
        .withColumn("key", host_key(F.col("host")))
        .withColumn("sum", F.crc32(F.concat_ws("\u0001", F.col("id").cast("string"), "path"))),
    )
    bounds = _bounds(urls, shuffle_width(spark))
    kind = urls.schema["id"].dataType.simpleString()
    dealt = "part int, key string, rank int, upto string, id " + kind + ", host string, path string, action string"

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            keys, sums = b.column("key").to_pylist(), b.column("sum").to_pylist()
            part = pa.array([bisect_right(bounds, k) for k in zip(keys, sums)], pa.int32())
            none = pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays(
                [part, b.column("key"), pa.array([1] * n, pa.int32()), none, b.column("id"), b.column("host"), b.column("path"), none],
                ["part", "key", "rank", "upto", "id", "host", "path", "action"],
            )

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                end = r["key"][:-1] + "/" if r["key"] else "\U0010ffff"
                first, last = bisect_right(bounds, (r["key"], -1)), bisect_right(bounds, (end, -1))
                out += [(p, r["key"], 0, end, r["host"], r["path"], r["action"]) for p in range(first, last + 1)]
            cols = list(zip(*out)) or [()] * 7
            types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            arrays.insert(4, pa.nulls(len(out), id_type))
            yield pa.RecordBatch.from_arrays(arrays, ["part", "key", "rank", "upto", "id", "host", "path", "action"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(urls.schema["id"].dataType)
    own = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    own = own.withColumn("key", host_key(F.col("host")))
    events = urls.mapInArrow(deal_urls, dealt).unionByName(own.mapInArrow(deal_rules, dealt))
    # Rules stand before the URLs of the same key, wide ones before those nested in them.
    events = events.repartitionById(shuffle_width(spark), "part").sortWithinPartitions("part", "key", "rank", F.desc("upto"))
    return events.mapInArrow(
        lambda batches: _sweep(batches, default), f"id {kind}, host string, path string, rule string, verdict string"
    ).withColumnRenamed("id", id_col)


def _bounds(urls: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Lower bounds of the ranges but the first, from a sample of bounded size."""
    total = urls.count()
    if not total or ranges < 2:
        return []
    want = SAMPLE_PER_RANGE * ranges
    seen = sorted((r["key"], r["sum"]) for r in urls.select("key", "sum").sample(min(1.0, want / total), seed=7).limit(2 * want).collect())
    return sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []


class _Host:
    """A host whose interval is open, and the rules for it."""

    def __init__(self, upto: str, host: str):
        self.upto, self.host, self.actions = upto, host, {}
        self._lengths: list[int] | None = None

    def add(self, path: str, action: str) -> None:
        self._lengths = None
        if self.actions.get(path) != "block":
            self.actions[path] = action

    def longest(self, path: str) -> str | None:
        """The longest path of a rule that the path starts with."""
        if self._lengths is None:
            self._lengths = sorted({len(p) for p in self.actions}, reverse=True)
        return next((path[:n] for n in self._lengths if n <= len(path) and path[:n] in self.actions), None)


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    part, stack = None, []
    for b in batches:
        names = b.schema.names
        get = {c: b.column(names.index(c)).to_pylist() for c in ("part", "key", "rank", "upto", "host", "path", "action")}
        rule, verdict, is_url = [], [], []
        for p, key, rank, upto, host, path, action in zip(*get.values()):
            if p != part:
                part, stack = p, []
            while stack and stack[-1].upto <= key:
                stack.pop()
            is_url.append(rank == 1)
            if rank == 0:
                if not stack or stack[-1].host != host:
                    stack.append(_Host(upto, host))
                stack[-1].add(path, action)
                continue
            best = None
            for h in stack:
                if (q := h.longest(path)) is not None:
                    fit = len(h.host + q), len(h.host), h.actions[q] == "block", h.host + q, h.actions[q]
                    best = fit if best is None else max(best, fit)
            rule.append(best and best[3])
            verdict.append(best[4] if best else default)
        urls = b.filter(pa.array(is_url, pa.bool_()))
        yield pa.RecordBatch.from_arrays(
            [urls.column(names.index(c)) for c in ("id", "host", "path")] + [pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
            ["id", "host", "path", "rule", "verdict"],
        )


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP8_SQL = f"""
WITH rules(rhost, rpath, action) AS (VALUES {', '.join(map(str, RULES))}),
rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
)
SELECT any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path,
       arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
       coalesce(arg_max(action, length(rhost || rpath)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY rid
"""
