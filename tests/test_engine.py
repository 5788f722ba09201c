import sqlite3

import pytest
from pyspark.sql import functions as F

from quarrylight.errors import CorpusError
from quarrylight.functions import constants as C
from quarrylight.functions import paths, text
from quarrylight.operators import index, lookup, ranking
from quarrylight.plans.engine import Engine
from quarrylight.sources import catalog, corpus, evalset

FILES = [
    ("netlib", "client.go", "package n\n\n// Retry sends again after a pause.\nfunc (c *Client) RetryRequest(max int) error {\n\tfor i := 0; i < max; i++ {\n\t\tsleep(i)\n\t}\n\treturn nil\n}\n"),
    ("netlib", "client_test.go", "package n\n\nfunc TestRetry(t *T) {\n\tretry_request(3)\n\tretry_request(4)\n\tcheck(t)\n}\n"),
    ("netlib", "docs/guide.md", "# Retrying\nHow requests are retried after a pause.\nmax_retries sets the bound.\n"),
    ("netlib", "vendor/x/pause.go", "package x\n\nfunc Pause() {\n\tretry()\n\tretry()\n}\n"),
    ("weblib", "app.py", "def handle(msg):\n    parse_message(msg)\n    return msg\n\n\nclass Router:\n    def add(self, path):\n        self.paths.append(path)\n        return path\n"),
    ("weblib", "naïve.js", "function naïveCafé(x) {\n  return x\n}\nexports.pause = function pause() {\n  return 1\n}\n"),
    ("weblib", "node_modules/z/z.js", "function hidden() {\n  return 1\n}\n"),
    ("weblib", "big.json", "{" + "x" * 3000 + "}"),
]


@pytest.fixture(scope="module")
def engine(spark):
    own = corpus.describe(spark.createDataFrame([(r, p, "b" + p, t) for r, p, t in FILES], "repo string, path string, blob string, text string"))
    made = Engine.from_files(own)
    made.chunks, made.symbols, made.files = made.chunks.persist(), made.symbols.persist(), made.files.persist()
    return made


def test_what_is_indexed(engine):
    paths_ = {r["path"] for r in engine.files.collect()}
    assert "node_modules/z/z.js" not in paths_
    assert {r["path"] for r in engine.chunks.collect()} == paths_ - {"big.json"}


def test_scores_equal_the_full_text_index(engine):
    """BM25 over Porter stems, weighted columns and phrases: as SQLite's FTS5 has it."""
    rows = engine.chunks.orderBy("repo", "path", "start_line").collect()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(symbol, path, body, tokenize='porter unicode61')")
    for i, r in enumerate(rows):
        db.execute("insert into t(rowid, symbol, path, body) values (?, ?, ?, ?)", (i, *(" ".join(text.expand_text(r[c])) for c in ("symbol", "path", "body"))))
    tokens = index.tokens(engine.chunks, stem=True).persist()
    for terms in (["retries"], ["retry", "retries"], ["pause", "max_retries"], ["message", "msg", "naive"], ["retries_max", "self"], ["absent"]):
        want = {i: -s for i, s in db.execute("select rowid, bm25(t, 4.0, 2.0, 1.0) from t where t match ?", (text.match_expression(terms),))}
        got = {(r["repo"], r["path"], r["start_line"]): r["bm25"] for r in engine._scores(terms, tokens).collect()}
        assert got.keys() == {(rows[i]["repo"], rows[i]["path"], rows[i]["start_line"]) for i in want}, terms
        for i, s in want.items():
            assert got[rows[i]["repo"], rows[i]["path"], rows[i]["start_line"]] == pytest.approx(s, rel=1e-9, abs=1e-12)


def test_concept(engine):
    hits = engine.search("how are requests retried").hits.orderBy("place").collect()
    assert (hits[0]["path"], hits[0]["symbol"]) in {("client.go", "RetryRequest"), ("docs/guide.md", "Retrying")}
    only = engine.search("pause in weblib").hits.orderBy("place").collect()
    assert only[0]["repo"] == "weblib"
    with pytest.raises(CorpusError):
        engine.search("is it the", mode="concept")


def test_concept_with_scorer(engine):
    judged = Engine(engine.files, engine.chunks, engine.symbols, scorer=ranking.overlap_scorer).search("requests retried after a pause", mode="concept")
    rows = judged.hits.orderBy("place").collect()
    assert rows and rows[0]["p"] >= 0.5 and not rows[0]["weak"]


def test_symbol_exact_regex_auto(engine):
    assert [(r["symbol"], r["start_line"]) for r in engine.search("Pause").hits.orderBy("place").collect()][:2] == [("pause", 4), ("Pause", 3)]
    best = engine.search("Router").hits.first()
    assert (best["path"], best["symbol"], best["start_line"], best["end_line"]) == ("app.py", "Router", 6, 9)
    exact = engine.search('"retry_request"').hits.orderBy("place").collect()
    assert [(r["path"], list(r["match_lines"])) for r in exact] == [("client_test.go", [4, 5])]
    assert engine.search(r"max_\w+").mode == "regex" and engine.search(r"max_\w+").hits.count() == 1
    auto = engine.search("sleep")
    assert auto.mode == "symbol->exact" and auto.hits.first()["path"] == "client.go"
    with pytest.raises(CorpusError):
        engine.search("(", mode="regex")
    with pytest.raises(CorpusError):
        engine.search("x", langs=["cobol"])
    assert engine.search("pause", mode="exact", repos=["net"], path="vendor").hits.count() == 1


def test_views(engine, spark):
    shown = engine.show("weblib:app.py:6-7").first()
    assert shown["content"] == "6| class Router:\n7|     def add(self, path):\n" and shown["next"] == "weblib:app.py:8-9"
    for bad in ("weblib:none.py", "nothing", "weblib:app.py:99"):
        with pytest.raises(CorpusError):
            engine.show(bad)
    tree = [(r["path"], r["files"], r["tag"]) for r in engine.tree("netlib").collect()]
    assert tree[:2] == [("docs/", 1, "doc"), ("vendor/", 1, "vendor")] and ("client.go", 0, "") in tree
    repos = spark.createDataFrame([("netlib", ["net"]), ("weblib", [])], "name string, categories array<string>").selectExpr(
        "name", "'u' as url", "'main' as ref", "false as pinned", "'abcdef0123' as sha", "categories", "timestamp '2026-01-01' as added_at", "timestamp '2026-01-01' as updated_at"
    )
    listed = engine.list(repos, ["net"]).collect()
    assert [(r["name"], r["files"], r["langs"]) for r in listed] == [("netlib", 4, ["go"])]
    with pytest.raises(CorpusError):
        engine.list(repos, ["unknown"])


@pytest.mark.parametrize(
    ("path", "flags"),
    [
        ("a/b_test.go", C.TEST), ("vendor/x.go", C.VENDOR), ("x.pb.go", C.GENERATED), ("README.md", C.DOC), ("src/main.rs", 0), ("tests/fixtures/a.json", C.TEST),
        ("LatestTest.java", C.TEST), ("latest.java", 0),
    ],
)
def test_path_flags(spark, path, flags):
    assert spark.range(1).select(paths.path_flags(F.lit(path)).alias("f")).first()["f"] == flags


def test_sources_and_targets(spark):
    own = lambda s: spark.range(1).select(paths.parse_source(F.lit(s)).alias("p")).first()["p"]
    assert tuple(own("Owner/Repo@v1")) == ("https://github.com/Owner/Repo", "owner", "repo", "v1")
    assert tuple(own("https://github.com/a/b/tree/main/x")) == ("https://github.com/a/b", "a", "b", "main/x")
    assert tuple(own("git@github.com:a/b.git")) == ("git@github.com:a/b", "a", "b", "")
    assert own("not a source") is None
    target = lambda t: tuple(spark.range(1).select(paths.parse_target(F.lit(t)).alias("p")).first()["p"])
    assert target("r:a/b.go:10-20") == ("r", "a/b.go", 10, 20) and target("references/r/a.py:3") == ("r", "a.py", 3, 3)


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "repos.json")
    assert catalog.read(spark, path).count() == 0
    repos = catalog.document_repos(spark, "/root/testdata/sf0.001")
    catalog.write(repos, path)
    assert catalog.read(spark, path).orderBy("name").collect() == repos.select(*catalog.read(spark, path).columns).orderBy("name").collect()
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(CorpusError):
        catalog.read(spark, str(tmp_path / "broken.json"))
    assert catalog.resolve(["netlib", "weblib"], "NETLIB") == "netlib" and catalog.resolve(["netlib", "weblib"], "web") == "weblib"
    for bad in ("lib", "zzz"):
        with pytest.raises(CorpusError):
            catalog.resolve(["netlib", "weblib"], bad)
    with pytest.raises(CorpusError):
        paths.parse_categories(["No Good!"])
    assert paths.parse_categories(["Web, api", ""]) == ["web", "api"]


def test_eval_lines(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text('// note\n{"q": "a", "expect": ["r:p:3"]}\n\n{"q": "b", "repo": "r", "expect": []}\n')
    assert [r["q"] for r in evalset.read(spark, str(tmp_path / "cases.jsonl")).collect()] == ["a", "b"]
    (tmp_path / "bad.jsonl").write_text('{"q": "a"}\n{broken\n')
    with pytest.raises(CorpusError, match="line 2"):
        evalset.read(spark, str(tmp_path / "bad.jsonl"))


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1, "r", "x.go", 1, 9), (1, 2, "r", "a/p.go", 5, 9), (2, 1, "r", "d/q.go", 1, 4)], "query int, place int, repo string, path string, start_line int, end_line int")
    want = spark.createDataFrame([(1, "r:p.go:7"), (2, "r:d/"), (3, "r:none")], "query int, place string")
    row = ranking.metrics(want, hits, want).first()
    assert (row["cases"], row["hit1"], row["hit5"]) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3)) and row["mrr"] == pytest.approx(0.5)


def test_stored_engine_answers_alike(spark, tmp_path, engine):
    engine.save(str(tmp_path / "corpus"))
    stored = Engine.open(spark, str(tmp_path / "corpus"))
    for q in ("how are requests retried", "max_retries", "pause in weblib", "Router", '"retry_request"'):
        columns = ["repo", "path", "start_line", "end_line", "symbol", "place"]
        assert stored.search(q).hits.select(columns).orderBy("place").collect() == engine.search(q).hits.select(columns).orderBy("place").collect()
    total = stored.postings.agg(F.sum("n")).first()[0]
    assert total == stored.statistics.first()["n_tokens"] and stored.statistics.first()["n_docs"] == engine.chunks.count()


def test_patterns_are_checked_by_the_engine_that_matches(spark):
    assert lookup.check_regex(r"\p{L}+(?<n>x)") == r"\p{L}+(?<n>x)"
    for bad in ("(?P<n>x)", "(", "[z-a]", "a{2,1}"):
        with pytest.raises(CorpusError):
            lookup.check_regex(bad)


def test_an_automatic_search_runs_once(engine, monkeypatch):
    """What is looked at to choose the mode is what the caller gets."""
    found = engine.search("Router")
    monkeypatch.setattr(engine, "files", None)
    assert found.hits.first()["path"] == "app.py"


def test_phrases_from_stored_places(spark, tmp_path, engine):
    """Places that are intersected give what tokens side by side give; a word may come twice in a phrase."""
    engine.save(str(tmp_path / "corpus"))
    stored = Engine.open(spark, str(tmp_path / "corpus"))
    for terms in (["max_retries"], ["retry_request", "pause"], ["retry_retry", "self_paths_append"], ["retries_max", "absent_words"], ["add_self_path"]):
        got, want = (sorted(map(tuple, e._scores(terms).collect())) for e in (stored, engine))
        assert [r[:-1] for r in got] == [r[:-1] for r in want], terms
        assert [r[-1] for r in got] == pytest.approx([r[-1] for r in want])
