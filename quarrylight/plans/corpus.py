"""A corpus on disk: a catalog, checkouts and the stored index, with the verbs that change them."""

from __future__ import annotations

import datetime
import os
import shutil
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NOT_FOUND, USER, CorpusError
from ..functions import constants as C
from ..functions import paths
from ..operators import index, views
from ..operators.ranking import Scorer
from ..sources import catalog, git
from ..sources import corpus as files_of
from ..streaming.segments import Segments
from .engine import Engine, cut


#: Repositories that are cloned or fetched at a time.
AT_ONCE = 4


class Corpus:
    """``root`` holds ``repos.json`` and a folder per repository, on the machine that runs git.

    The index has a segment for each change (``streaming.segments``), so a change writes what it changes.  It stands in
    ``index``, by default ``.index`` below the root; on a cluster that has to be a folder that all executors share.
    """

    def __init__(self, spark: SparkSession, root: str, scorer: Scorer | None = None, blend: float = C.BLEND, index: str | None = None):
        self.spark, self.root, self.scorer, self.blend = spark, os.path.abspath(root), scorer, blend
        os.makedirs(self.root, exist_ok=True)
        self.catalog = os.path.join(self.root, "repos.json")
        if index is None and not spark.sparkContext.master.startswith("local"):
            raise CorpusError(USER, "the index needs a folder that all executors share", "name one: Corpus(..., index=...)")
        self.segments = Segments(spark, index or "file://" + os.path.join(self.root, ".index"), cut)

    def repos(self) -> DataFrame:
        return catalog.read(self.spark, self.catalog)

    def names(self) -> list[str]:
        return sorted(r["name"] for r in self.repos().select("name").collect())

    def folder(self, name: str) -> str:
        return os.path.join(self.root, name)

    def engine(self) -> Engine:
        if not self.segments.numbers():
            self.reindex()
        return self.segments.engine(scorer=self.scorer, blend=self.blend)

    # ---- changes ----

    def add(self, source: str, name: str = "", categories: list[str] | None = None) -> dict:
        """Clones and indexes a repository; one with the same URL is left as it is."""
        out = self.add_all([source], name, categories)[0]
        if "error" in out:
            raise out["error"]
        return out

    def add_all(self, sources: list[str], name: str = "", categories: list[str] | None = None) -> list[dict]:
        """Several at once: source, name and status of each, and ``error`` of those that failed.  What is new is indexed in one step."""
        if name and len(sources) > 1:
            raise CorpusError(USER, "a name is for one source", "add the others without it")
        labels = sorted(set(paths.parse_categories(categories or [])))
        out, wanted, taken = [], [], {r["name"] for r in self.repos().select("name").collect()}
        known = {r["u"]: r["name"] for r in self.repos().select("name", paths.normal_url(F.col("url")).alias("u")).collect()}
        asked = self.spark.createDataFrame(list(enumerate(sources)), "i int, s string").withColumn("p", paths.parse_source(F.col("s")))
        for r in asked.withColumn("u", paths.normal_url(F.col("p.url"))).orderBy("i").collect():
            own: dict = {"source": r["s"]}
            out.append(own)
            p = r["p"]
            if p is None:
                own |= {"status": "failed", "error": CorpusError(USER, f"cannot parse source {r['s']!r}", "use owner/repo, a URL, or owner/repo@tag")}
            elif r["u"] in known:
                own |= {"name": known[r["u"]], "status": "exists"}
            else:
                own["name"] = name or (p["name"] if p["name"] not in taken else f"{p['owner']}-{p['name']}")
                if own["name"] in taken:
                    own |= {"status": "failed", "error": CorpusError(USER, f"name {own['name']!r} is taken", "give another name")}
                    continue
                taken.add(own["name"])
                known[r["u"]] = own["name"]
                wanted.append((own, p))

        def fetch(job: tuple) -> tuple | None:
            own, p = job
            try:
                tracked, pinned = git.clone(p["url"], self.folder(own["name"]), p["ref"])
                now = datetime.datetime.now(datetime.UTC).replace(microsecond=0, tzinfo=None)
                own["status"] = "added"
                return own["name"], p["url"], tracked, pinned, git.head(self.folder(own["name"])), labels, now, now
            except CorpusError as e:
                own |= {"status": "failed", "error": e}
                return None

        with ThreadPoolExecutor(AT_ONCE) as pool:
            rows = [r for r in pool.map(fetch, wanted) if r]
        if rows:
            self._write(catalog.put(self.repos(), self.spark.createDataFrame(rows, catalog.SCHEMA)))
            self.reindex([r[0] for r in rows])
        return out

    def update(self, names: list[str] | None = None) -> list[dict]:
        """Fetches repositories that aren't pinned; missing checkouts are cloned again.  Only changed files are indexed anew."""
        wanted = [catalog.resolve(self.names(), n) for n in names] if names else self.names()

        def fetch(r) -> dict:
            there = os.path.isdir(os.path.join(self.folder(r["name"]), ".git"))
            try:
                if not there:
                    git.clone(r["url"], self.folder(r["name"]), r["ref"])
                elif not r["pinned"]:
                    git.update(self.folder(r["name"]), r["ref"])
                sha = git.head(self.folder(r["name"]))
                status = "recloned" if not there else "pinned" if r["pinned"] else "updated" if sha != r["sha"] else "current"
                return {"name": r["name"], "status": status, "sha": sha}
            except CorpusError as e:
                return {"name": r["name"], "status": f"error: {e.message}"}

        with ThreadPoolExecutor(AT_ONCE) as pool:
            out = list(pool.map(fetch, self.repos().where(F.col("name").isin(wanted)).collect()))
        changed = [(x["name"], x["sha"]) for x in out if x["status"] in ("recloned", "updated")]
        if changed:
            new = F.create_map(*[F.lit(x) for pair in changed for x in pair])
            now = F.date_trunc("second", F.current_timestamp())
            own = self.repos().withColumn("updated_at", F.when(new[F.col("name")].isNotNull(), now).otherwise(F.col("updated_at")))
            self._write(own.withColumn("sha", F.coalesce(new[F.col("name")], "sha")))
            self.reindex([n for n, _ in changed])
        return [{"name": x["name"], "status": x["status"]} for x in out]

    def remove(self, names: list[str]) -> None:
        """Exact names only."""
        if unknown := set(names) - set(self.names()):
            raise CorpusError(NOT_FOUND, f"repo {sorted(unknown)[0]!r} not found", "give the exact name")
        self._write(self.repos().where(~F.col("name").isin(names)))
        for n in names:
            shutil.rmtree(self.folder(n), ignore_errors=True)
        self.reindex(names)

    def tag(self, name: str, categories: list[str], remove: bool = False) -> None:
        name = catalog.resolve(self.names(), name)
        self._write(catalog.tag(self.repos(), name, paths.parse_categories(categories), remove))

    def _write(self, repos: DataFrame) -> None:
        catalog.write(repos, self.catalog)

    # ---- the index ----

    def _listing(self, names: list[str]) -> DataFrame:
        """repo, path, blob of the checkouts' files that are indexed."""
        out = self.spark.createDataFrame([], "repo string, path string, blob string")
        for n in names:
            out = out.unionByName(git.listing(self.spark, self.folder(n), n))
        return out.where((paths.language(F.col("path")) != "") & ~paths.skip_path(F.col("path")))

    def _texts(self, names: list[str], listing: DataFrame) -> DataFrame:
        """The same and the text."""
        out = self.spark.createDataFrame([], "repo string, path string, blob string, text string")
        for n in names:
            text = files_of.tracked_files(self.spark, self.folder(n), n).drop("blob")
            out = out.unionByName(listing.where(F.col("repo") == n).join(text, ["repo", "path"]))
        return out

    def reindex(self, names: list[str] | None = None) -> None:
        """Brings the index up to date for some repositories, or builds it anew.

        Blobs of the checkouts are compared with those of the index: files that are gone or changed lose their
        rows, and only files that were added or changed are read, cut and tokenised.
        """
        tracked = [n for n in self.names() if os.path.isdir(self.folder(n))]
        there = tracked if names is None else [n for n in tracked if n in names]
        live = self.segments.heads().where("blob is not null")
        live = live if names is None else live.where(F.col("repo").isin(names))
        listing = self._listing(there).persist()
        changes = index.difference(live, listing).where("status <> 'unchanged'").persist()
        if not changes.isEmpty():
            number = self.segments.next_number()
            texts = files_of.describe(self._texts(there, listing.join(changes.where("status <> 'removed'"), ["repo", "path"], "left_semi")))
            gone = changes.where("status = 'removed'").select("repo", "path")
            batch = texts.unionByName(gone, allowMissingColumns=True).withColumn("version", F.lit(number))
            self.segments.apply(batch, number)
            self.segments.merge()
        changes.unpersist(), listing.unpersist()

    # ---- state ----

    def status(self) -> DataFrame:
        rows = []
        for n in os.listdir(self.root):
            if os.path.isdir(self.folder(n)) and not n.startswith("."):
                is_git = os.path.isdir(os.path.join(self.folder(n), ".git"))
                if is_git or n not in self.names():
                    rows.append((n, git.head(self.folder(n)) if is_git else None))
        engine = self.engine()
        return views.status_issues(self.repos(), views.repo_stats(engine.files, engine.chunks), self.spark.createDataFrame(rows, "name string, sha string"))
