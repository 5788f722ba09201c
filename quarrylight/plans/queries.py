"""One query for each operator, over the whole tables they are given."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths, text
from ..functions.sizes import broadcast_if_small
from ..operators import batch, chunker, index, lookup, names, patterns, ranking, trigrams, views
from ..sources import catalog, corpus, evalset
from ..sources.shared import new_folder
from . import made_sources, samples

#: Lines of a chunk in these queries: documents are short, so tiles of 80 would be whole documents.
TILE = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r9(c: str | Column) -> Column:
    return F.round(c, 9)


def files_of(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.document_files(spark, sf)


def chunks_of(spark: SparkSession, sf: str, tile: int = TILE, body: bool = False) -> DataFrame:
    return corpus.window_chunks(files_of(spark, sf), tile, body)


def sample(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def stored(spark, rows: DataFrame, label: str) -> DataFrame:
    folder = new_folder(spark, label)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


# ---- scans and text ----


@query
def lines_scan(spark, sf):
    return corpus.lines(files_of(spark, sf))


@query
def scan_files(spark, sf):
    return files_of(spark, sf).drop("text")


@query
def tok_identifiers(spark, sf):
    return files_of(spark, sf).select("repo", "path", text.identifiers(F.col("text")).alias("tokens"))


def vocabulary(spark, sf) -> DataFrame:
    return files_of(spark, sf).select(F.explode(text.identifiers(F.col("text"))).alias("token")).distinct()


@query
def tok_parts(spark, sf):
    return vocabulary(spark, sf).select("token", text.parts(F.col("token")).alias("parts"))


@query
def tok_expand(spark, sf):
    own = text.expand(F.col("text"))
    return files_of(spark, sf).select("repo", "path", F.size(own).alias("n"), F.md5(F.array_join(own, " ")).alias("digest"))


@query
def stem_light(spark, sf):
    words = vocabulary(spark, sf).select(F.lower("token").alias("word")).distinct()
    return words.select("word", text.stem_light(F.col("word")).alias("stem"))


@query
def tok_porter(spark, sf):
    own = files_of(spark, sf).select(F.explode(text.index_tokens(F.col("text"))).alias("word"))
    return index.stems(own)


@query
def query_terms(spark, sf):
    @F.pandas_udf("array<string>")
    def terms(q: pd.Series) -> pd.Series:
        return q.map(text.query_terms)

    return evalset.queries(spark, sf).select("item_id", "q", terms("q").alias("terms"))


@query
def detect_mode(spark, sf):
    own = evalset.queries(spark, sf).select("q").unionByName(sample(spark, [(q,) for q in samples.QUERIES], "q string"))
    return own.distinct().select("q", paths.detect_mode(F.col("q")).alias("mode"))


# ---- files and paths ----


def all_paths(spark, sf) -> DataFrame:
    own = corpus.page_files(spark, sf).select("path").unionByName(sample(spark, [(p,) for p in samples.PATHS], "path string"))
    return own.distinct()


@query
def classify_lang(spark, sf):
    return all_paths(spark, sf).select("path", paths.language(F.col("path")).alias("lang"))


@query
def path_flags(spark, sf):
    own = all_paths(spark, sf).withColumn("flags", paths.path_flags(F.col("path")))
    return own.select("path", "flags", paths.tags(F.col("flags")).alias("tags"), paths.main_tag(F.col("flags")).alias("main_tag"))


@query
def filter_skip_path(spark, sf):
    return all_paths(spark, sf).where(~paths.skip_path(F.col("path")))


@query
def filter_skip_content(spark, sf):
    return files_of(spark, sf).where(~paths.skip_content(F.lit("text"), F.col("text"))).select("repo", "path")


@query
def flag_generated(spark, sf):
    own = files_of(spark, sf).select("text").unionByName(sample(spark, [(t,) for t in samples.HEADERS], "text string"))
    return own.select(F.md5("text").alias("blob"), paths.generated_header(F.col("text")).alias("generated"))


@query
def filter_conj(spark, sf):
    return lookup.filtered(files_of(spark, sf), ["src1", "src3", "src12"], ["EN", "fr"], "**/doc_*[135].txt").select("repo", "path")


@query
def filter_glob(spark, sf):
    own = all_paths(spark, sf)
    parts = [own.where(paths.matches_glob(F.col("path"), g)).select(F.lit(g).alias("glob"), "path") for g in samples.GLOBS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def url_normalize(spark, sf):
    own = spark.read.parquet(f"{sf}/pages.parquet").select("url").unionByName(sample(spark, [(u,) for u in samples.URLS], "url string"))
    return own.distinct().select("url", paths.normal_url(F.col("url")).alias("normal"))


@query
def parse_source(spark, sf):
    own = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("url").alias("source"))
    own = own.unionByName(sample(spark, [(u,) for u in samples.SOURCES], "source string")).distinct()
    return own.withColumn("p", paths.parse_source(F.col("source"))).select("source", "p.url", "p.owner", "p.name", "p.ref")


@query
def parse_target(spark, sf):
    own = files_of(spark, sf).select(F.concat("repo", F.lit(":"), "path", F.lit(":3-"), F.length("repo").cast("string")).alias("target"))
    own = own.unionByName(sample(spark, [(t,) for t in samples.TARGETS], "target string")).distinct()
    return own.withColumn("p", paths.parse_target(F.col("target"))).select(
        "target", "p.repo", "p.path", F.col("p.start").alias("start_line"), F.col("p.end").alias("end_line")
    )


# ---- chunks and index ----


@query
def chunk_windows(spark, sf):
    return chunks_of(spark, sf)


@query
def symbol_enclosing(spark, sf):
    own = lookup.enclosing_chunk(corpus.line_symbols(files_of(spark, sf)), chunks_of(spark, sf))
    return own.select("repo", "path", "name", "line", F.coalesce("start_line", "line").alias("start_line"), F.coalesce("end_line", "line").alias("end_line"))


@query
def file_chunks(spark, sf):
    """The chunks of one file of each repository: of its longest ones the last by path."""
    files = files_of(spark, sf)
    longest = files.groupBy("repo").agg(F.max_by("path", F.struct("size", "path")).alias("path"))
    return corpus.window_chunks(files.join(longest, ["repo", "path"], "left_semi"), TILE).orderBy("repo", "path", "start_line")


@query
def fts_stats(spark, sf):
    s = index.statistics(chunks_of(spark, sf, body=True))
    return s.select("n_docs", "n_tokens", r9(F.col("n_tokens") / F.col("n_docs")).alias("avgdl"))


@query
def index_build(spark, sf):
    return index.postings_of(chunks_of(spark, sf, body=True)).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("tf").alias("weighted"), F.sum("n").alias("n_tokens")
    )


@query
def chunk_defs(spark, sf):
    """Definition chunks and symbols of source files made from all documents."""
    return chunker.split_files(made_sources.sources(spark, sf), body=False)


@query
def chunk_samples(spark, sf):
    """The same of a small file in each kind of language."""
    own = sample(spark, [("inline", f"{lang}/{i}", lang, src) for i, (lang, src) in enumerate(samples.SOURCES_BY_LANGUAGE)], "repo string, path string, lang string, text string")
    return chunker.split_files(own).drop("body")


# ---- concept search ----


def asked(spark, sf) -> DataFrame:
    """query, terms: each item's first sentence as words."""
    own = evalset.queries(spark, sf).select(F.col("item_id").alias("query"), "q", text.words(F.col("q")).alias("terms"))
    return own.where(F.size("terms") > 0)


def shortlisted(spark, sf, k: int = C.SHORTLIST) -> DataFrame:
    terms = asked(spark, sf).select("query", F.explode("terms").alias("term"))
    return batch.best(chunks_of(spark, sf, body=True), terms, k, new_folder(spark, "asked"))


def scored(spark, sf, k: int = C.SHORTLIST, mentioned: Column | None = None) -> DataFrame:
    files = files_of(spark, sf).select("repo", "path", "flags")
    own = shortlisted(spark, sf, k).join(files, ["repo", "path"]).withColumns({"symbol": F.lit(""), "kind": F.lit("block")})
    return ranking.concept_score(own, asked(spark, sf), mentioned=mentioned)


@query
def concept_bm25(spark, sf):
    return shortlisted(spark, sf, 10).select("query", "repo", "path", "start_line", r9("bm25").alias("bm25"), "rank")


@query
def concept_score(spark, sf):
    return scored(spark, sf).select("query", "repo", "path", "start_line", r9("score").alias("score"))


@query
def concept_repo_boost(spark, sf):
    named = F.col("repo") == F.concat(F.lit("src"), (F.col("query") % 20).cast("string"))
    hits = ranking.top(scored(spark, sf, mentioned=named), 10)
    return hits.select("query", "repo", "path", "start_line", r9("score").alias("score"), "place")


@query
def cap_per_file(spark, sf):
    return ranking.cap_per_file(scored(spark, sf)).select("query", "repo", "path", "start_line", r9("score").alias("score"))


def concept_hits(spark, sf, limit: int = C.CONCEPT_LIMIT) -> DataFrame:
    return ranking.top(ranking.cap_per_file(scored(spark, sf)), limit)


def bodies_of(spark, sf, hits: DataFrame, name: str) -> DataFrame:
    """Chunks of the files of some hits with their bodies; only these files are cut."""
    files = files_of(spark, sf).join(broadcast_if_small(hits.select("repo", "path").distinct()), ["repo", "path"], "left_semi")
    return corpus.window_chunks(files, TILE, True).select("repo", "path", "start_line", F.col("body").alias(name))


@query
def concept_search(spark, sf):
    return concept_hits(spark, sf).select("query", "repo", "path", "start_line", r9("score").alias("score"), "place")


def pairs(q: Column, terms: Column) -> Column:
    """Words that stand side by side in a question, both of which are searched for."""
    words = F.regexp_extract_all(F.lower(q), F.lit(r"([\p{L}\p{N}]+)"), 1)
    both = F.arrays_zip(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))
    both = F.filter(both, lambda p: F.array_contains(terms, p["a"]) & F.array_contains(terms, p["b"]))
    return F.array_distinct(F.transform(both, lambda p: F.array(p["a"], p["b"])))


@query
def concept_phrases(spark, sf):
    """BM25 over the words of each question and its pairs of neighbouring words as phrases, from a stored index."""
    folder = new_folder(spark, "phrases")
    index.write(chunks_of(spark, sf, body=True), folder, stem=False)
    rows, _, statistics = index.read(spark, folder)
    own = asked(spark, sf).withColumn("pairs", pairs(F.col("q"), F.col("terms")))
    wanted = own.select("query", F.explode("pairs").alias("words")).withColumn("phrase", F.array_join("words", " "))
    terms = own.select("query", F.explode("terms").alias("term")).unionByName(wanted.select("query", F.col("phrase").alias("term")))
    best = batch.best_stored(rows, terms, wanted.select("phrase", "words").distinct(), statistics, 10, f"{folder}/asked")
    return best.select("query", "repo", "path", "start_line", r9("bm25").alias("bm25"), "rank")


@query
def excerpt_densest(spark, sf):
    """For each benchmark item, where the densest window for its words begins in each file that is shortlisted for it."""
    own = stored(spark, shortlisted(spark, sf).select("query", "repo", "path").distinct(), "files")
    own = broadcast_if_small(own.join(asked(spark, sf).select("query", "terms"), "query"))
    own = own.join(files_of(spark, sf).select("repo", "path", corpus.line_array(F.col("text")).alias("lines")), ["repo", "path"])
    own = own.withColumn("best", ranking.densest_window(F.col("lines"), F.col("terms")))
    return own.where("best is not null").select("query", "repo", "path", F.col("best").cast("int").alias("best"))


# ---- symbols ----

SYMBOL = "The"


def listed(spark, sf) -> DataFrame:
    return lookup.find_symbols(corpus.line_symbols(files_of(spark, sf)), files_of(spark, sf), SYMBOL)


@query
def symbol_lookup(spark, sf):
    return listed(spark, sf).select("repo", "path", "name", "line", "match", "list_place")


@query
def symbol_indexed(spark, sf):
    """The same list by a table of suffixes of all names: only symbols whose names hold the text are read."""
    own = names.Names.write(corpus.line_symbols(files_of(spark, sf)), new_folder(spark, "names"))
    return own.find(files_of(spark, sf), SYMBOL).select("repo", "path", "name", "line", "match", "list_place")


@query
def symbol_ranked(spark, sf):
    return lookup.rank_symbols(listed(spark, sf), SYMBOL).select("repo", "path", "name", "line", r9("score").alias("score"), "place")


@query
def symbol_search(spark, sf):
    hits = lookup.enclosing_chunk(lookup.rank_symbols(listed(spark, sf), SYMBOL), chunks_of(spark, sf))
    start = F.coalesce("start_line", "line")
    start = F.when(F.col("line") - start > 6, F.col("line") - 3).otherwise(start)
    hits = hits.withColumn("first", start).withColumn("last", F.least(F.coalesce("end_line", "line"), start + 13))
    own = hits.join(files_of(spark, sf).select("repo", "path", corpus.line_array(F.col("text")).alias("lines")), ["repo", "path"])
    excerpt = ranking.render(F.col("lines"), F.col("first"), F.col("last"), F.array("line"))
    return own.select("place", "repo", "path", "name", "line", "first", "last", excerpt.alias("excerpt"))


# ---- lines ----

EXACT, REGEX = "rights reserved", r"token = .[0-9a-f]{8}"
#: A pattern of two alternatives, and a text that is too short for an index.
EITHER, SHORT = r"rights? reserved|BEGIN [A-Z]+ PRIVATE KEY", "%"


def matches(spark, sf, fixed: bool = True) -> DataFrame:
    return lookup.grep(files_of(spark, sf), EXACT if fixed else lookup.check_regex(REGEX), fixed)


@query
def grep_exact(spark, sf):
    return matches(spark, sf)


@query
def grep_regex(spark, sf):
    return matches(spark, sf, False)


@query
def grep_indexed(spark, sf):
    """The same matches and those of two more patterns by a trigram index over all files: only files that may match are read."""
    own = trigrams.Grams.write(files_of(spark, sf), new_folder(spark, "trigrams"))
    out = None
    for name, pattern, fixed in (("exact", EXACT, True), ("regex", REGEX, False), ("either", EITHER, False), ("short", SHORT, True)):
        found = own.grep(pattern if fixed else lookup.check_regex(pattern), fixed).select(F.lit(name).alias("search"), "*")
        out = found if out is None else out.unionByName(found)
    return out


@query
def grep_many(spark, sf):
    """The lines that hold the question of any benchmark item, all found in one scan."""
    asked_for = evalset.queries(spark, sf).select(F.col("item_id").alias("query"), F.col("q").alias("pattern"))
    return patterns.grep_many(files_of(spark, sf), asked_for)


def groups(spark, sf) -> DataFrame:
    return lookup.group_by_chunk(matches(spark, sf), chunks_of(spark, sf))


@query
def grep_group_chunks(spark, sf):
    return groups(spark, sf)


@query
def grep_scored(spark, sf):
    own = groups(spark, sf).join(files_of(spark, sf).select("repo", "path", "flags"), ["repo", "path"])
    return lookup.top_groups(lookup.grep_score(own, EXACT, True)).select("repo", "path", "start_line", "end_line", "n", r9("score").alias("score"), "place")


@query
def excerpt_islands(spark, sf):
    """Windows of lines around the matches of a common word."""
    own = lookup.grep(files_of(spark, sf), "tion", most=None)
    chunks = chunks_of(spark, sf, C.WINDOW)
    hits = lookup.enclosing_chunk(own, chunks).where("start_line is not null").withColumn("query", F.lit("tion"))
    return ranking.match_windows(hits).select("repo", "path", "start_line", "island", "first_line", "last_line", "matches")


#: A concept, a symbol that isn't one, a quoted text and a pattern.
AUTO = ["rights reserved", "reserved", '"rights reserved"', "rights? reserved"]


@query
def auto_search(spark, sf):
    """Searches whose mode follows from the query, without stems."""
    from .engine import HIT, Engine

    files = files_of(spark, sf)
    engine = Engine(files, corpus.window_chunks(files, TILE, True), corpus.line_symbols(files), stem=False)
    out = None
    for q in AUTO:
        found = engine.search(q)
        own = found.hits.select(F.lit(q).alias("asked"), F.lit(found.mode).alias("mode"), *[c for c in HIT if c != "score"], r9("score").alias("score"))
        out = own if out is None else out.unionByName(own)
    return out


# ---- catalog ----


@query
def repos_scan(spark, sf):
    return catalog.document_repos(spark, sf)


@query
def repo_stats(spark, sf):
    return views.repo_stats(files_of(spark, sf), chunks_of(spark, sf))


@query
def repo_top_langs(spark, sf):
    return views.top_langs(files_of(spark, sf))


@query
def repo_list(spark, sf):
    return views.repo_list(catalog.document_repos(spark, sf), repo_stats(spark, sf), repo_top_langs(spark, sf))


@query
def category_counts(spark, sf):
    return views.category_counts(catalog.document_repos(spark, sf))


@query
def category_filter(spark, sf):
    return views.in_categories(catalog.document_repos(spark, sf), ["third", "seventh"]).select("name", "categories")


@query
def tag_untag(spark, sf):
    own = catalog.tag(catalog.document_repos(spark, sf), "src2", ["web", "even", "alpha"])
    return catalog.tag(own, "src6", ["even"], remove=True).select("name", "categories")


@query
def status_issues(spark, sf):
    """The catalog without src1 and with an unknown repository, against checkouts without src2 and an old one of src3."""
    repos = catalog.document_repos(spark, sf)
    kept = repos.where("name <> 'src1'").select("name", "sha").unionByName(sample(spark, [("ghost", "0"), ("empty", "1")], "name string, sha string"))
    there = repos.where("name <> 'src2'").select("name", F.when(F.col("name") == "src3", "old").otherwise(F.col("sha")).alias("sha"))
    there = there.unionByName(sample(spark, [("empty", "1"), (".hidden", "2"), ("stray", "3")], "name string, sha string"))
    return views.status_issues(kept, repo_stats(spark, sf), there)


# ---- views ----


@query
def tree_rollup(spark, sf):
    return views.tree(files_of(spark, sf))


@query
def show_range(spark, sf):
    targets = files_of(spark, sf).select("repo", "path", F.lit(3).alias("start"), F.lit(5).alias("end"))
    return views.show(files_of(spark, sf), targets, context=1)


@query
def hits_json(spark, sf):
    own = concept_hits(spark, sf).select("query", "place", "repo", "path", "start_line", r9("score").alias("score"), paths.tags(F.col("flags")).alias("tags"))
    loc = F.format_string("%s:%s:%d", "repo", "path", "start_line")
    return own.select("query", "place", F.to_json(F.struct("repo", "path", "start_line", "tags", loc.alias("loc"))).alias("hit"))


# ---- maintenance ----


def next_files(spark, sf) -> DataFrame:
    """Another snapshot: a tenth of the documents gone, a tenth changed, some new."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 10 <> 0")
    path = F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    body = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text"))
    own = docs.select(F.col("source").alias("repo"), path.alias("path"), F.md5(body).alias("blob"))
    new = docs.where("doc_id % 10 = 2").select(F.col("source").alias("repo"), F.concat(F.lit("new/"), path).alias("path"), F.md5("text").alias("blob"))
    return own.unionByName(new)


@query
def incremental_diff(spark, sf):
    return index.difference(files_of(spark, sf), next_files(spark, sf))


@query
def delete_repo(spark, sf):
    return index.without_repos(chunks_of(spark, sf), ["src1", "src4"])


# ---- reranking and evaluation ----


@query
def rerank_blend(spark, sf):
    hits = concept_hits(spark, sf, C.JUDGED).withColumn("id", F.concat_ws(":", "repo", "path", "start_line"))
    hits = broadcast_if_small(stored(spark, hits, "hits"))
    own = hits.drop("place").join(bodies_of(spark, sf, hits, "text"), ["repo", "path", "start_line"]).join(asked(spark, sf).select("query", F.col("q").alias("query_text")), "query")
    out = ranking.blend(own, ranking.overlap_scorer(own.withColumn("header", F.col("path"))))
    return out.select("query", "repo", "path", "start_line", r9("p").alias("p"), r9("blended").alias("blended"), "weak", "place")


@query
def pack_budget(spark, sf):
    hits = broadcast_if_small(stored(spark, concept_hits(spark, sf).select("query", "place", "repo", "path", "start_line"), "hits"))
    own = hits.join(bodies_of(spark, sf, hits, "excerpt"), ["repo", "path", "start_line"])
    return ranking.pack(own, 2000).select("query", "place", F.octet_length("excerpt").alias("size"), "kept")


@query
def eval_cases(spark, sf):
    own = evalset.expectations(spark, sf).groupBy("item_id").agg(F.array_sort(F.collect_list("place")).alias("expect"))
    cases = evalset.queries(spark, sf).join(own, "item_id")
    text_lines = cases.select(F.to_json(F.struct("q", "expect")).alias("value")).unionByName(sample(spark, [("// a comment",), ("",)], "value string"))
    return evalset.parse(text_lines).select("q", F.array_sort("expect").alias("expect"))


@query
def eval_metrics(spark, sf):
    expected = evalset.expectations(spark, sf).withColumnRenamed("item_id", "query")
    cases = expected.select("query").distinct()
    hits = concept_hits(spark, sf, 10).withColumn("end_line", F.col("start_line") + TILE - 1)
    out = ranking.metrics(cases, hits, expected)
    return out.select("cases", r9("hit1").alias("hit1"), r9("hit5").alias("hit5"), r9("mrr").alias("mrr"))
