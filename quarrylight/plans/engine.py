"""The verbs of the engine over an indexed corpus: search in five modes, show, tree, list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NOT_FOUND, USER, CorpusError
from ..functions import constants as C
from ..functions import paths, text
from ..functions.porter import fold, porter
from ..operators import blocks, chunker, index, lookup, names, ranking, trigrams, views
from ..sources import catalog
from ..sources.corpus import line_array, window_chunks

HIT = ["repo", "path", "start_line", "end_line", "symbol", "kind", "score", "place"]


@dataclass
class Result:
    mode: str
    hits: DataFrame
    note: str = ""
    terms: list[str] = field(default_factory=list)
    cost: float = 0.0  # in dollars


def cut(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (with body) and symbols of described files: definitions where the language has them, tiles otherwise."""
    live = files.where(F.col("flags").bitwiseAND(C.SKIPPED) == 0)
    parsed = live.where(F.col("lang").isin(*chunker.LANGUAGES))
    split = chunker.split_files(parsed)
    defs = split.where("what = 'chunk'").select("repo", "path", "start_line", "end_line", F.col("name").alias("symbol"), "kind", "body")
    tiles = window_chunks(live.where(~F.col("lang").isin(*chunker.LANGUAGES)), C.WINDOW, True)
    symbols = split.where("what = 'symbol'").select("repo", "path", "name", F.lower("name").alias("name_lower"), "kind", F.col("start_line").alias("line"))
    return defs.unionByName(tiles), symbols


class Engine:
    """A corpus: files (repo, path, lang, flags, text), chunks (with body) and symbols; ``stem`` for Porter stems in the index."""

    def __init__(
        self, files: DataFrame, chunks: DataFrame, symbols: DataFrame, stem: bool = True, scorer: ranking.Scorer | None = None, blend: float = C.BLEND
    ):
        self.files, self.chunks, self.symbols, self.stem, self.scorer, self.blend = files, chunks, symbols, stem, scorer, blend
        self.spark, self.postings, self.tokens = files.sparkSession, None, None
        self.grams: trigrams.Grams | None = None
        self.blocks: blocks.Blocks | None = None
        self.names: names.Names | None = None

    def save(self, folder: str) -> None:
        """Stores the tables and the index; files and chunks sorted by place, so that a repo's or a file's rows are read alone."""
        own = self.files.repartitionByRange("repo", "path").sortWithinPartitions("repo", "path")
        own.write.mode("overwrite").parquet(f"{folder}/files")
        blocks.numbered(self.chunks.drop("number")).write.mode("overwrite").parquet(f"{folder}/chunks")
        names.Names.write(self.symbols, f"{folder}/names")
        files, chunks = (self.spark.read.parquet(f"{folder}/{t}") for t in ("files", "chunks"))
        if self.postings is None:
            rows = index.postings_of(chunks, self.stem)
        else:
            rows = self.postings.join(chunks.select(*index.CHUNK, "number"), index.CHUNK).select(*self.postings.columns, "number")
        index.write_postings(rows, chunks.count(), f"{folder}/index", lambda p, total: blocks.write(p, chunks, files, total, f"{folder}/index"))
        trigrams.Grams.write(self.files, f"{folder}/trigrams")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, stem: bool = True, scorer: ranking.Scorer | None = None, blend: float = C.BLEND) -> Engine:
        """An engine over stored tables; searches read postings of their terms, and texts only of files that may match."""
        found = names.Names(spark, f"{folder}/names")
        files, chunks = (spark.read.parquet(f"{folder}/{t}") for t in ("files", "chunks"))
        made = cls(files, chunks.drop("number"), found.symbols, stem, scorer, blend)  # numbers belong to the blocks
        made.names = found
        made.postings, made.tokens, made.statistics = index.read(spark, f"{folder}/index")
        made.grams = trigrams.Grams(spark, f"{folder}/trigrams")
        made.blocks = blocks.Blocks(spark, f"{folder}/index", made.statistics)
        return made

    @classmethod
    def from_files(cls, files: DataFrame, stem: bool = True, scorer: ranking.Scorer | None = None, blend: float = C.BLEND) -> Engine:
        """Indexes described files (see ``sources.corpus.describe``)."""
        own = files.where((F.col("lang") != "") & ~paths.skip_path(F.col("path")))
        return cls(own, *cut(own), stem, scorer, blend)

    @cached_property
    def repos(self) -> list[str]:
        """Names of repositories: as many as the catalog has rows."""
        return [r["repo"] for r in self.files.select("repo").distinct().orderBy("repo").collect()]

    @cached_property
    def statistics(self) -> DataFrame:
        row = index.statistics(self.chunks).first()
        return self.spark.createDataFrame([(row["n_docs"], row["n_tokens"])], "n_docs long, n_tokens long")

    # ---- search ----

    def search(
        self, query: str, mode: str = "auto", repos: list[str] | None = None, langs: list[str] | None = None, path: str | None = None,
        limit: int | None = None, deep: bool = False,
    ) -> Result:
        if mode not in paths.MODES:
            raise CorpusError(USER, f"unknown mode {mode!r}", "use one of: " + ", ".join(paths.MODES))
        for lang in langs or ():
            if lang.lower() not in C.EXTENSIONS:
                raise CorpusError(USER, f"unknown language {lang!r}", "use one of: " + ", ".join(sorted(C.EXTENSIONS)))
        repos = [catalog.resolve(self.repos, r) for r in repos or ()]
        narrow = lambda rows: lookup.filtered(rows, repos, langs, path)
        files = narrow(self.files) if repos or langs or path else None
        if mode != "auto":
            return self._run(mode, query, files, narrow, limit, bool(repos), deep)
        first = paths.mode_of(query)
        result = self._run(first, query, files, narrow, limit, bool(repos), deep)
        other = "exact" if first == "symbol" or (first == "concept" and len(query.split()) <= 4) else None
        if other is None:
            return result
        # at most ``limit`` hits are kept here, so that the search runs once
        rows = result.hits.collect()
        result.hits = self.spark.createDataFrame(rows, result.hits.schema)
        if rows:
            return result
        again = self._run(other, query, files, narrow, limit, bool(repos), deep)
        return Result(f"{first}->{other}", again.hits, f"no {first} results; tried {other}", result.terms)

    def _run(self, mode: str, query: str, files: DataFrame | None, narrow: Callable[[DataFrame], DataFrame], limit: int | None, scoped: bool, deep: bool) -> Result:
        """``files`` are those that ``narrow`` leaves, or None where it leaves all."""
        if mode == "concept":
            return self._concept(query, files, limit or C.CONCEPT_LIMIT, scoped, deep)
        if mode == "symbol":
            return self._symbol(query.strip(), self.files if files is None else files, limit or C.SYMBOL_LIMIT)
        fixed = mode == "exact"
        bare = query.strip()
        pattern = bare[1:-1] if fixed and len(bare) >= 2 and bare[0] == bare[-1] == '"' else query
        pattern = pattern if fixed else lookup.check_regex(pattern)
        files = self.files if files is None else files
        found = lookup.grep(narrow(self.grams.files_for(pattern, fixed)) if self.grams else files, pattern, fixed)
        groups = lookup.group_by_chunk(found, self.chunks).join(files.select("repo", "path", "flags"), ["repo", "path"])
        hits = lookup.top_groups(lookup.grep_score(groups, pattern, fixed), limit or C.GREP_LIMIT)
        return Result(mode, hits.select(*HIT, "match_lines"))

    def _concept(self, query: str, files: DataFrame | None, limit: int, scoped: bool, deep: bool) -> Result:
        terms, named = text.query_terms(query), []
        if not scoped:
            named = [r for r in self.repos if r.lower() in terms]
            terms = [t for t in terms if t not in {r.lower() for r in named}] or terms
        if not terms:
            raise CorpusError(USER, f"query {query!r} has no searchable terms", "add specific words, e.g. identifiers or domain terms")
        single = self._tokens(terms)
        if self.blocks is not None and files is None and all(len(p) == 1 for p in single):
            listed = self.blocks.described(self.blocks.best([p[0] for p in single]))
        else:  # phrases and filters need all postings of their words
            scores = self._scores(terms)
            scores = scores if files is None else scores.join(files.select("repo", "path"), ["repo", "path"], "left_semi")
            listed = self._described(ranking.shortlist(scores))
        mentioned = F.col("repo").isin(named) if named else None
        hits = ranking.cap_per_file(ranking.concept_score(listed, terms, query, mentioned))
        if self.scorer is None:
            return Result("concept", ranking.top(hits, limit).select(*HIT), "keyword-ranked: no scorer", terms)
        pool = ranking.top(hits, C.JUDGED_DEEP if deep else C.JUDGED)
        pool = pool.join(self.chunks.select("repo", "path", "start_line", F.col("body").alias("text")), ["repo", "path", "start_line"])
        pool = pool.withColumns({"id": F.concat_ws(":", "repo", "path", "start_line"), "header": F.concat_ws(" ", "path", "kind", "symbol"), "query_text": F.lit(query)})
        if mentioned is not None:
            pool = pool.withColumn("mentioned", mentioned)
        pool = self.spark.createDataFrame(pool.collect(), pool.schema)  # some dozens of rows
        try:
            scores = self.scorer(pool).collect()
        except Exception as e:  # whatever goes wrong with a remote judge, the keyword order is still there
            why = (str(e).strip() or type(e).__name__).splitlines()[-1][:200]
            return Result("concept", pool.where(F.col("place") <= limit).select(*HIT), f"keyword-ranked: the scorer failed ({why})", terms)
        judged = self.spark.createDataFrame([(r["query"], r["id"], float(r["p"])) for r in scores], "query int, id string, p double")
        best = ranking.blend(pool.drop("place"), judged, self.blend).where(F.col("place") <= limit)
        cost = sum(r["cost"] for r in scores if "cost" in r)
        return Result("concept", best.drop("score").withColumnRenamed("blended", "score").select(*HIT, "p", "weak"), "", terms, cost)

    def _described(self, listed: DataFrame) -> DataFrame:
        """The shortlist with what is known of its files and chunks, of which only those of its paths are read."""
        rows = listed.collect()  # at most C.SHORTLIST
        small = self.spark.createDataFrame(rows, listed.schema)
        there = F.col("path").isin(sorted({r["path"] for r in rows}))
        meta = self.chunks.where(there).select("repo", "path", "start_line", "end_line", "symbol", "kind")
        files = self.files.where(there).select("repo", "path", "lang", "flags")
        return meta.join(F.broadcast(small), ["repo", "path", "start_line"]).join(files, ["repo", "path"])

    def _tokens(self, terms: list[str]) -> list[list[str]]:
        """The index tokens of each term."""
        one = (lambda w: porter(fold(w))) if self.stem else str.lower
        return [[one(w) for w in regex.findall(text.TOKEN, t)] for t in terms]

    def _scores(self, terms: list[str], tokens: DataFrame | None = None) -> DataFrame:
        """BM25 of one query.  A term of several index tokens is a phrase: its tokens side by side in one column."""
        phrases = self._tokens(terms)
        single = [p[0] for p in phrases if len(p) == 1]
        if tokens is None:
            tokens = self.tokens if self.tokens is not None else index.tokens(self.chunks, self.stem)
        stored = self.postings is not None
        rows = self.postings.where(F.col("term").isin(single)).drop("places") if stored else index.postings(tokens.where(F.col("term").isin(single)))
        asked = [(0, s) for s in single]
        long = {" ".join(p): p for p in phrases if len(p) > 1}
        if stored and long:
            words = self.postings.where(F.col("term").isin(sorted({w for p in long.values() for w in p})))
            found = index.phrase_postings(words, self.spark.createDataFrame(list(long.items()), "phrase string, words array<string>"))
            return ranking.score_postings(
                rows.unionByName(found), self.spark.createDataFrame([*asked, *((0, " ".join(p)) for p in phrases if len(p) > 1)], "query int, term string"),
                self.statistics, one_query=True,
            )
        for p in (p for p in phrases if len(p) > 1):
            run = tokens.where(F.col("term") == p[0]).select(*index.CHUNK, "dl", "col", "pos", F.lit(" ".join(p)).alias("term"))
            for k, word in enumerate(p[1:], 1):
                after = tokens.where(F.col("term") == word).select(*index.CHUNK, "col", (F.col("pos") - k).alias("pos"))
                run = run.join(after, [*index.CHUNK, "col", "pos"], "left_semi")
            rows = rows.unionByName(index.postings(run))
            asked.append((0, " ".join(p)))
        return ranking.score_postings(rows, self.spark.createDataFrame(asked, "query int, term string"), self.statistics, one_query=True)

    def _symbol(self, query: str, files: DataFrame, limit: int) -> Result:
        listed = self.names.find(files, query) if self.names else lookup.find_symbols(self.symbols, files, query)
        ranked = lookup.enclosing_chunk(lookup.rank_symbols(listed, query, limit), self.chunks)
        hits = ranked.select(
            "repo", "path", F.coalesce("start_line", "line").alias("start_line"), F.coalesce("end_line", "line").alias("end_line"),
            F.col("name").alias("symbol"), "kind", "score", "place", "line",
        )
        return Result("symbol", hits)

    # ---- views ----

    def show(self, target: str, context: int = 0) -> DataFrame:
        parsed = self.spark.createDataFrame([(target,)], "t string").select(paths.parse_target(F.col("t")).alias("p")).first()["p"]
        if parsed is None:
            raise CorpusError(USER, f"cannot parse target {target!r}", "format: <repo>:<path>[:<start>[-<end>]]")
        repo = catalog.resolve(self.repos, parsed["repo"])
        files = self.files.where((F.col("repo") == repo) & (F.col("path") == parsed["path"]))
        if files.isEmpty():
            raise CorpusError(NOT_FOUND, f"file {repo}:{parsed['path']} not found", f"look at the tree of {repo}")
        out = views.show(files, self.spark.createDataFrame([(repo, parsed["path"], parsed["start"], parsed["end"])], "repo string, path string, start int, end int"), context)
        if out.isEmpty():
            raise CorpusError(USER, f"line {parsed['start']} is past the end of {repo}:{parsed['path']}", "ask for an earlier line")
        return out

    def tree(self, repo: str, below: str = "", depth: int = 2) -> DataFrame:
        name = catalog.resolve(self.repos, repo)
        out = views.tree(self.files.where(F.col("repo") == name), depth, below)
        if out.isEmpty():
            raise CorpusError(NOT_FOUND, f"no files under {name}:{below}", f"look at the tree of {name}")
        return out.orderBy(F.desc("is_dir"), "path").limit(views.ENTRIES)

    def list(self, repos: DataFrame, categories: list[str] | None = None) -> DataFrame:
        names = paths.parse_categories(categories or [])
        for c in names:
            if views.in_categories(repos, [c]).isEmpty():
                raise CorpusError(NOT_FOUND, f"no repos in category {c!r}", "list the categories")
        own = views.in_categories(repos, names) if names else repos
        return views.repo_list(own, views.repo_stats(self.files, self.chunks), views.top_langs(self.files)).orderBy("name")
