"""Ranges of files, trees, and the state of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions import paths
from ..sources.corpus import line_array

SHOWN, MOST_SHOWN = 200, 400
PER_DIR, ENTRIES = 25, 300


def show(files: DataFrame, targets: DataFrame, context: int = 0) -> DataFrame:
    """For targets (repo, path, start, end; 0 for none) the lines shown: repo, path, start_line, end_line, total, content, next.

    A range past the end of a file gives no row.
    """
    own = targets.join(files.select("repo", "path", line_array(F.col("text")).alias("lines")), ["repo", "path"])
    total = F.size("lines")
    open_ = F.coalesce("start", F.lit(0)) == 0
    first = F.when(open_, 1).otherwise(F.col("start"))
    last = F.when(open_, F.least(total, F.lit(SHOWN))).otherwise(F.greatest("start", F.coalesce("end", F.lit(0))))
    own = own.withColumn("start_line", F.greatest(F.lit(1), first - context)).withColumn("total", total)
    own = own.withColumn("end_line", F.least(total, last + context, F.col("start_line") + MOST_SHOWN - 1)).where("start_line <= total")
    width = F.length(F.col("end_line").cast("string"))
    shown = F.transform(
        F.sequence("start_line", "end_line"),
        lambda n: F.concat(F.lpad(n.cast("string"), width, " "), F.lit("| "), F.regexp_replace(F.element_at("lines", n), "[ \t]+$", ""), F.lit("\n")),
    )
    following = F.concat_ws(":", "repo", "path", F.concat_ws("-", F.col("end_line") + 1, F.least("total", F.col("end_line") + SHOWN)))
    next_ = F.when(F.col("end_line") < F.col("total"), following)
    return own.select("repo", "path", "start_line", "end_line", "total", F.array_join(shown, "").alias("content"), next_.alias("next"))


def tree(files: DataFrame, depth: int = 2, below: str = "") -> DataFrame:
    """Directories (with the number of files beneath) and files to a depth: repo, path, is_dir, files, depth, tag.

    Files beyond the first of a directory are one row ``... +n files``.  A path gives a row for each of
    its directories down to the depth, which are counted map-side first.
    """
    below = below.replace("\\", "/").strip("/")
    own = files.select("repo", "path")
    if below:
        own = own.where(F.col("path").startswith(below + "/")).withColumn("path", F.substring("path", len(below) + 2, 1 << 30))
    segments = F.split("path", "/")
    own = own.select("repo", "path", segments.alias("s"), F.size(segments).alias("n"))
    levels = F.expr(f"sequence(1, least(n - 1, {depth}))")
    dirs = own.where("n > 1").select("repo", F.explode(levels).alias("depth"), "s")
    dirs = dirs.groupBy("repo", F.expr("concat(array_join(slice(s, 1, depth), '/'), '/')").alias("path"), "depth").agg(F.count(F.lit(1)).alias("files"))
    flags = paths.path_flags(F.concat("path", F.lit("x")))
    dirs = dirs.select("repo", "path", F.lit(True).alias("is_dir"), "files", "depth", paths.main_tag(flags).alias("tag"))
    leaves = own.where(F.col("n") <= depth).select("repo", F.expr("array_join(slice(s, 1, n - 1), '/')").alias("parent"), "path", F.col("n").alias("depth"))
    in_dir = Window.partitionBy("repo", "parent").orderBy("path")
    counts = leaves.groupBy("repo", "parent", "depth").agg(F.count(F.lit(1)).alias("c"))
    leaves = leaves.withColumn("r", F.row_number().over(in_dir)).where(F.col("r") <= PER_DIR)
    leaves = leaves.select("repo", "path", F.lit(False).alias("is_dir"), F.lit(0).cast("bigint").alias("files"), "depth", F.lit("").alias("tag"))
    prefix = F.when(F.col("parent") == "", "").otherwise(F.concat("parent", F.lit("/")))
    more = counts.where(F.col("c") > PER_DIR).select(
        "repo",
        F.concat(prefix, F.lit("... +"), (F.col("c") - PER_DIR).cast("string"), F.lit(" files")).alias("path"),
        F.lit(False).alias("is_dir"),
        F.lit(0).cast("bigint").alias("files"),
        "depth",
        F.lit("").alias("tag"),
    )
    return dirs.unionByName(leaves).unionByName(more)


def largest_dir(entries: DataFrame) -> DataFrame:
    """The untagged top directory with most files of each repo: repo, path, files."""
    own = entries.where("is_dir and depth = 1 and tag = ''")
    best = own.groupBy("repo").agg(F.min(F.struct((-F.col("files")).alias("n"), "path")).alias("b"))
    return best.select("repo", "b.path", (-F.col("b.n")).alias("files"))


# ---- catalog ----


def repo_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """repo, files (not skipped), chunks."""
    f = files.groupBy("repo").agg(F.count(F.when(F.col("flags").bitwiseAND(C.SKIPPED) == 0, 1)).alias("files"))
    c = chunks.groupBy("repo").agg(F.count(F.lit(1)).alias("chunks"))
    return f.join(c, "repo", "left").select("repo", "files", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def top_langs(files: DataFrame, n: int = 3) -> DataFrame:
    """repo, langs: the commonest languages of code, by number of files and then name."""
    # Languages that don't count.
    own = files.where(~F.coalesce("lang", F.lit("")).isin("config", "text", "markdown", "html", "css", ""))
    counts = own.where(F.col("flags").bitwiseAND(C.SKIPPED) == 0).groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "lang")))  # a repo has a few dozen languages
    return counts.groupBy("repo").agg(F.slice(F.transform(ranked, lambda x: x["lang"]), 1, n).alias("langs"))


def repo_list(repos: DataFrame, stats: DataFrame, langs: DataFrame) -> DataFrame:
    out = repos.join(stats.withColumnRenamed("repo", "name"), "name", "left").join(langs.withColumnRenamed("repo", "name"), "name", "left")
    return out.select(
        "name",
        "url",
        "ref",
        "pinned",
        F.substring("sha", 1, 7).alias("sha"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
        "categories",
        F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce("langs", F.array().cast("array<string>")).alias("langs"),
    )


def category_counts(repos: DataFrame) -> DataFrame:
    """category, n, repos (sorted); repositories without one are the category ''."""
    own = repos.select("name", F.explode_outer("categories").alias("category"))
    own = own.select("name", F.coalesce("category", F.lit("")).alias("category"))
    return own.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("name")).alias("repos"))


def in_categories(repos: DataFrame, categories: list[str]) -> DataFrame:
    return repos.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories)).cast("array<string>")))


def status_issues(repos: DataFrame, stats: DataFrame, checkouts: DataFrame) -> DataFrame:
    """repo, problem for catalog, index and checkouts (name, sha) that don't agree."""
    c = checkouts.select(F.col("name").alias("cname"), F.col("sha").alias("csha"))
    both = repos.select("name", "sha").join(c, F.col("name") == F.col("cname"), "left")
    missing = both.where("cname is null").select(F.col("name").alias("repo"), F.lit("checkout missing").alias("problem"))
    there = both.where("cname is not null")
    differs = there.where("csha <> sha").select(F.col("name").alias("repo"), F.lit("checkout differs from manifest").alias("problem"))
    indexed = stats.where("files > 0").select(F.col("repo").alias("name"))
    bare = there.join(indexed, "name", "left_anti").select(F.col("name").alias("repo"), F.lit("not indexed").alias("problem"))
    names = repos.select(F.col("name").alias("repo"))
    orphans = stats.join(names, "repo", "left_anti").select("repo", F.lit("index rows for untracked repo").alias("problem"))
    visible = checkouts.where("not startswith(name, '.')").select(F.col("name").alias("repo"))
    untracked = visible.join(names, "repo", "left_anti").select("repo", F.lit("untracked directory in references/").alias("problem"))
    return missing.unionByName(differs).unionByName(bare).unionByName(orphans).unionByName(untracked)
