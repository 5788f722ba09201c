"""Source code made from documents, for queries about definitions: a piece for each line of a document.

A piece is some comment lines, a header, a body, in some languages an end, and some blank lines; how
many of each follows from the document's id and the line's number, so SQL can say where all of them are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import line_array

#: By the remainder of the document's id.
LANGUAGES = ["python", "go", "ruby", "markdown", "sql"]
#: Pieces with these remainders of the line's number: a long definition (of 50), a class with a method (of 5).
LONG_AT, CLASS_AT, LONG_BODY = 7, 4, 200

# Templates: comment, header, body, end.
PARTS = {
    "python": ("# about f%d", "def f%d(a):", "    use(a)", None),
    "go": ("// about f%d", "func f%d(a int) {", '\tuse(a, "}") // {', "}"),
    "ruby": ("# about f%d", "def f%d(a)", "  use(a)", "end"),
    "markdown": (None, "# f%d", "some text", None),
    "sql": ("-- about f%d", "create table f%d (", "  a int,", ");"),
}


def _piece(lang: str, doc: Column, k: Column) -> Column:
    """The lines of a piece, an array."""
    comment, header, body, end = PARTS[lang]
    number = lambda t: F.format_string(t, k) if "%d" in t else F.lit(t)
    long = F.lit(lang == "python") & (k % 50 == LONG_AT)
    size = F.when(long, LONG_BODY).otherwise(1 + (7 * k + doc) % 4)
    parts = [F.array_repeat(number(comment), (k % 3).cast("int"))] if comment else []
    if lang == "python":
        of_class = k % 5 == CLASS_AT
        header_line = F.when(of_class, F.format_string("class f%d:", k)).otherwise(number(header))
        method = F.array(F.format_string("    def m%d(self):", k), F.lit("        return 1"))
        parts += [F.array(header_line), F.array_repeat(F.lit(body), size.cast("int")), F.when(of_class & ~long, method).otherwise(F.array().cast("array<string>"))]
    else:
        parts += [F.array(number(header)), F.array_repeat(F.lit(body), size.cast("int"))]
    if end:
        parts.append(F.array(F.lit(end)))
    return F.concat(*parts, F.array_repeat(F.lit(""), (k % 2).cast("int")))


def _lines(lang: str, numbers: Column) -> Column:
    return F.flatten(F.transform(numbers, lambda k: _piece(lang, F.col("doc_id"), k.cast("bigint"))))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, lang, text: a source file for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.select("source", "doc_id", F.size(line_array(F.col("text"))).alias("n"), (F.col("doc_id") % len(LANGUAGES)).alias("which")).where("n > 0")
    numbers = F.sequence(F.lit(0), F.col("n") - 1)
    text = F.lit(None).cast("string")
    for i, lang in enumerate(LANGUAGES):
        text = F.when(F.col("which") == i, F.array_join(_lines(lang, numbers), "\n")).otherwise(text)
    lang = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("which") + 1).cast("int"))
    path = F.concat(lang, F.lit("/doc_"), F.col("doc_id").cast("string"))
    return own.select(F.col("source").alias("repo"), path.alias("path"), lang.alias("lang"), F.concat(text, F.lit("\n")).alias("text"))
