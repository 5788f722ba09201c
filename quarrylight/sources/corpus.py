"""Files, lines, chunks and symbols as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths


def tracked_files(spark: SparkSession, folder: str, repo: str | None = None) -> DataFrame:
    """Files below ``folder``: repo, path, blob, text.  The first folder is the repo where none is given."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.substring_index("path", folder.removeprefix("file:").rstrip("/") + "/", -1)
    name = F.lit(repo) if repo else F.substring_index(relative, "/", 1)
    path = relative if repo else F.expr("substring(relative, length(substring_index(relative, '/', 1)) + 2)")
    return (
        raw.withColumn("relative", relative)
        .where(~F.col("relative").rlike(r"(^|/)\.git/"))
        .select(name.alias("repo"), path.alias("path"), F.sha1("content").alias("blob"), F.decode("content", "UTF-8").alias("text"))
    )


def describe(files: DataFrame) -> DataFrame:
    """Adds lang, size and flags to repo, path, text."""
    lang = paths.language(F.col("path"))
    flags = paths.path_flags(F.col("path"))
    skipped = F.when(paths.skip_content(lang, F.coalesce("text", F.lit(""))), C.SKIPPED).otherwise(0)
    generated = F.when((skipped == 0) & paths.generated_header(F.col("text")), C.GENERATED).otherwise(0)
    return files.withColumns({"lang": lang, "size": F.octet_length("text"), "flags": flags.bitwiseOR(skipped).bitwiseOR(generated)})


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: repo, path, lang, blob, size, flags, text."""
    return as_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def as_files(docs: DataFrame, *more: str) -> DataFrame:
    """Documents (doc_id, text, lang, source, and ``more`` columns that stay) as files.

    Prose has long lines, so the test for dense content would drop a quarter of it; it isn't applied.
    """
    path = F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        F.col("source").alias("repo"),
        path.alias("path"),
        "lang",
        F.md5("text").alias("blob"),
        F.octet_length("text").alias("size"),
        F.when(paths.generated_header(F.col("text")), C.DOC | C.GENERATED).otherwise(C.DOC).alias("flags"),
        "text",
        *more,
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as files: repo (host), path, flags."""
    url = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    path = F.substring(url, F.locate("/", F.concat(url, F.lit("/"))) + F.lit(1), F.length(url))
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.substring_index(url, "/", 1).alias("repo"), path.alias("path"))
    return files.withColumn("flags", paths.path_flags(F.col("path")))


def line_array(text: Column) -> Column:
    """The lines of a text; a last empty one isn't counted."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def lines(files: DataFrame) -> DataFrame:
    """repo, path, line (from 1), text."""
    return files.select("repo", "path", F.posexplode(line_array(F.col("text"))).alias("at", "text")).select(
        "repo", "path", (F.col("at") + 1).alias("line"), "text"
    )


def window_chunks(files: DataFrame, window: int = C.WINDOW, with_body: bool = False) -> DataFrame:
    """Tiles of ``window`` lines with two lines or more that aren't trivial: repo, path, start_line, end_line, symbol, kind.

    Tiles are cut within a row, so nothing is shuffled.
    """
    own = files.withColumn("lines", line_array(F.col("text"))).where(F.size("lines") > 0)
    tile = F.explode(F.expr(f"sequence(0, (size(lines) - 1) div {window})")).alias("tile")
    cut = own.select("*", tile).withColumn("part", F.expr(f"slice(lines, tile * {window} + 1, {window})"))
    solid = F.size(F.filter("part", lambda x: ~F.btrim(x, F.lit(" \t\r")).isin(*C.TRIVIAL)))
    columns = ["repo", "path", (F.col("tile") * window + 1).alias("start_line"), (F.col("tile") * window + F.size("part")).alias("end_line")]
    columns += [F.lit("").alias("symbol"), F.lit("block").alias("kind")]
    return cut.where(solid >= 2).select(*columns, *[F.array_join("part", "\n").alias("body")] * with_body)


CAPITAL = r"(?:^|[^\p{L}\p{Nd}_])(\p{Lu}[\p{L}\p{Nd}_]*)"


def line_symbols(files: DataFrame) -> DataFrame:
    """A stand-in for definitions in prose: the first capitalised word of each line."""
    name = F.regexp_extract("text", CAPITAL, 1)
    own = lines(files).select("repo", "path", name.alias("name"), F.lower(name).alias("name_lower"), F.lit("line").alias("kind"), "line")
    return own.where("name <> ''")
