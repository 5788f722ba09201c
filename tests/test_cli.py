import io
import json
import subprocess

import pytest

from quarrylight import cli
from quarrylight.errors import CorpusError
from quarrylight.operators import chunker
from quarrylight.operators.judge import Judge
from quarrylight.plans import present
from quarrylight.plans.corpus import Corpus
from quarrylight.plans.engine import Engine
from quarrylight.sources import corpus, git

pytestmark = pytest.mark.skipif(not git.available(), reason="git is not installed")


@pytest.fixture(scope="module")
def origin(tmp_path_factory):
    folder = tmp_path_factory.mktemp("origin") / "Sample"
    folder.mkdir()
    (folder / "a.py").write_text("def retry_request(n):\n    pause(n)\n    return n\n")
    (folder / "docs").mkdir()
    (folder / "docs/guide.md").write_text("# Retrying\nRequests are retried after a pause.\n")
    run = lambda *x: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *x], cwd=folder, check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("add", "."), run("commit", "-q", "-m", "one")
    return folder, run


def out(capsys):
    return json.loads(capsys.readouterr().out)


def test_commands(spark, origin, tmp_path, capsys, monkeypatch):
    folder, commit = origin
    root = str(tmp_path / "refs")
    clone = git.clone
    monkeypatch.setattr(git, "clone", lambda url, to, ref="": clone(f"file://{folder}", to, ref))
    do = lambda *a: cli.main(["--root", root, *a], spark)
    assert do("add", "me/Sample", "--categories", "net") == 0 and out(capsys)["name"] == "sample"
    assert do("add", "https://github.com/me/Sample.git") == 0 and out(capsys)["status"] == "exists"
    assert do("search", "retry_request") == 0
    hit = out(capsys)["hits"][0]
    assert (hit["path"], hit["symbol"], hit["excerpt"].splitlines()[0]) == ("a.py", "retry_request", ">1| def retry_request(n):")
    assert do("find", "how", "are", "requests", "retried", "--local-rerank") == 0 and out(capsys)["mode"] == "concept"
    assert do("search", '"pause"', "--text") == 0
    assert capsys.readouterr().out.splitlines()[:4] == [
        '# 2 results for ""pause"" | exact | 1 repo', "[1] sample:a.py:1-3  func retry_request", " 1| def retry_request(n):", ">2|     pause(n)",
    ]
    assert do("cat", "sample:docs/guide.md") == 0 and out(capsys)[0]["total"] == 2
    assert do("tree", "sample") == 0 and {r["path"] for r in out(capsys)} == {"docs/", "a.py", "docs/guide.md"}
    assert do("tag", "sample", "web") == 0 and do("ls", "--category", "web") == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])[0]["categories"] == ["net", "web"]
    assert do("status") == 0 and out(capsys) == []
    (folder / "b.go").write_text("package b\n\nfunc Added() int {\n\treturn 1\n}\n")
    commit("add", "."), commit("commit", "-q", "-m", "two")
    monkeypatch.setattr(git, "update", lambda to, ref: subprocess.run(["git", "pull", "-q"], cwd=to, check=True))
    assert do("update") == 0 and out(capsys) == [{"name": "sample", "status": "updated"}]
    assert do("def", "Added") == 0 and out(capsys)["hits"][0]["path"] == "b.go"
    assert do("show", "sample:none") == 3 and do("search", "(", "--mode", "regex") == 2
    assert do("rm", "sample") == 0 and do("search", "x", "--repos", "sample") == 3


def test_tools(spark, tmp_path):
    asks = [
        {"id": 1, "method": "initialize"}, {"id": 2, "method": "ping"}, {"id": 3, "method": "tools/list"}, {"id": 4, "method": "none"},
        {"method": "notifications/initialized"}, {"id": 5, "method": "tools/call", "params": {"name": "categories"}},
        {"id": 6, "method": "tools/call", "params": {"name": "other"}}, {"id": 7, "method": "tools/call", "params": {"name": "remove", "arguments": {"repos": "x"}}},
    ]
    sink = io.StringIO()
    cli.serve(Corpus(spark, str(tmp_path)), io.StringIO("\n".join(map(json.dumps, asks)) + "\n{\n"), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, 7, None]
    assert len(got[2]["result"]["tools"]) == 9 and got[3]["error"]["code"] == -32601 and got[4]["result"]["content"][0]["text"] == "[]"
    assert got[5]["error"]["code"] == -32602 and got[6]["result"]["isError"] and got[7]["error"]["code"] == -32700


def test_judge(spark):
    def post(url, body, headers, timeout):
        asked = json.loads(body)
        return json.dumps({"scores": {i["id"]: len(asked["items"]) / 100 for i in asked["items"]}}).encode()

    hits = spark.createDataFrame([(1, "q", str(i), "h", "t") for i in range(40)], "query int, query_text string, id string, header string, text string")
    got = sorted(r["p"] for r in Judge("http://example.com", post=post)(hits).collect())
    assert got == [0.1] * 10 + [0.3] * 30


def test_a_judge_costs_and_a_broken_one_leaves_the_keyword_order(spark, tmp_path):
    own = corpus.describe(spark.createDataFrame([("r", f"f{i}.py", "b", f"def retry_{i}(n):\n    retry(n)\n    return n\n") for i in range(40)], "repo string, path string, blob string, text string"))
    plain = Engine.from_files(own).search("retry loop", "concept")
    asked = []

    def post(url, body, headers, timeout):
        items = json.loads(body)["items"]
        asked.append(len(items))
        return json.dumps({"scores": {x["id"]: 0.9 for x in items}, "usage": {"cost": 0.25}}).encode()

    judged = Engine.from_files(own, scorer=Judge("u", post=post), blend=0.0).search("retry loop", "concept", deep=True)
    assert judged.cost == pytest.approx(0.5) and {r["p"] for r in judged.hits.collect()} == {0.9}
    assert {r["score"] for r in judged.hits.collect()} == {0.9}
    assert "# judged for $0.500000" in present.as_text(present.present(Engine.from_files(own), "retry loop", judged))
    by_tokens = Judge("u", post=lambda *_: b'{"scores": {"a": 1}, "usage": {"total_tokens": 2000000}}').ask("q", [])
    assert by_tokens == ({"a": 1.0}, pytest.approx(0.084))

    def broken(*_):
        raise TimeoutError("no answer")

    fallen = Engine.from_files(own, scorer=Judge("u", post=broken)).search("retry loop", "concept")
    assert "no answer" in fallen.note and fallen.cost == 0
    columns = ["repo", "path", "start_line", "place"]
    assert fallen.hits.select(columns).orderBy("place").collect() == plain.hits.select(columns).orderBy("place").collect()


def tables(engine):
    files, chunks, symbols = (sorted(map(str, getattr(engine, t).collect())) for t in ("files", "chunks", "symbols"))
    places = sorted(str(r) for r in engine.postings.select("term", "repo", "path", "start_line", "tf", "n", "dl", "places").collect())
    return files, chunks, symbols, places, engine.statistics.collect()


def test_updates_index_what_changed(spark, tmp_path, monkeypatch):
    """After each change the index equals one that is built anew, and only changed files were cut."""
    run = lambda folder, *x: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *x], cwd=folder, check=True, capture_output=True)
    origins = {}
    for name in ("one", "two", "three"):
        origins[name] = tmp_path / "from" / name
        origins[name].mkdir(parents=True)
        for i in range(4):
            (origins[name] / f"f{i}.py").write_text(f"def {name}_{i}(n):\n    use(n)\n    return {i}\n")
        run(origins[name], "init", "-q", "-b", "main"), run(origins[name], "add", "."), run(origins[name], "commit", "-q", "-m", "one")
    clone = git.clone
    monkeypatch.setattr(git, "clone", lambda url, to, ref="": clone(f"file://{origins.get(url.rsplit('/', 1)[1], 'none')}", to, ref))
    monkeypatch.setattr(git, "update", lambda to, ref: subprocess.run(["git", "pull", "-q"], cwd=to, check=True))
    split, cut = chunker.split_files, []

    def counted(files):
        cut.append(sorted(r["path"] for r in files.select("path").collect()))
        return split(files)

    monkeypatch.setattr(chunker, "split_files", counted)
    own = Corpus(spark, str(tmp_path / "refs"))
    added = own.add_all(["me/one", "me/two", "not a source", "me/none", "https://github.com/me/one.git"])
    assert [x["status"] for x in added] == ["added", "added", "failed", "failed", "exists"]
    assert added[3]["error"].code == 2 and not (tmp_path / "refs/none").exists() and own.names() == ["one", "two"]

    def anew():
        other = Engine.from_files(own.engine().files.drop("lang", "size", "flags").transform(corpus.describe))
        other.save(str(tmp_path / "anew"))
        return Engine.open(spark, str(tmp_path / "anew"))

    assert tables(own.engine()) == tables(anew()) and cut[0] == sorted([f"f{i}.py" for i in range(4)] * 2)
    cut.clear()
    own.add("me/three")
    assert cut == [[f"f{i}.py" for i in range(4)]]
    cut.clear()
    (origins["two"] / "f1.py").write_text("def other(n):\n    use(n, 2)\n    return n\n")
    (origins["two"] / "f2.py").unlink()
    (origins["two"] / "new.py").write_text("def new(n):\n    use(n)\n    return n\n")
    run(origins["two"], "add", "-A"), run(origins["two"], "commit", "-q", "-m", "two")
    assert {x["name"]: x["status"] for x in own.update()} == {"one": "current", "two": "updated", "three": "current"}
    assert cut == [["f1.py", "new.py"]]
    state = own.engine()
    assert {r["path"] for r in state.files.where("repo = 'two'").collect()} == {"f0.py", "f1.py", "f3.py", "new.py"}
    assert state.search("other", "symbol").hits.count() == 1 and state.search("two_1", "symbol").hits.count() == 0
    assert tables(state) == tables(anew())
    cut.clear()
    own.remove(["one"])
    assert cut in ([], [[]]) and tables(own.engine()) == tables(anew())
    assert {r["repo"] for r in own.engine().postings.select("repo").distinct().collect()} == {"two", "three"}


def test_evaluation_and_guide(spark, origin, tmp_path, capsys, monkeypatch):
    folder, _ = origin
    clone = git.clone
    monkeypatch.setattr(git, "clone", lambda url, to, ref="": clone(f"file://{folder}", to, ref))
    root = str(tmp_path / "refs")
    do = lambda *a: cli.main(["--root", root, *a], spark)
    assert do("add", "me/Sample", "not a source") == 4
    assert [x["status"] for x in out(capsys)] == ["added", "failed"]
    assert do("add", "not a source") == 2 and capsys.readouterr().err
    (tmp_path / "cases.jsonl").write_text('{"q": "retry_request", "expect": ["sample:a.py:1"]}\n{"q": "nowhere to be found here", "repo": "sample", "mode": "exact", "expect": ["sample:x"]}\n')
    assert do("eval", str(tmp_path / "cases.jsonl"), "--local-rerank") == 0
    got = out(capsys)
    assert [(r["config"], r["cases"], r["hit1"], r["mrr"]) for r in got] == [("keyword", 2, 0.5, 0.5), ("reranked", 2, 0.5, 0.5)]
    assert all(r["avg_ms"] > 0 and r["cost"] == 0 for r in got)
    assert do("guide") == 0 and "concept" in capsys.readouterr().out


def test_a_pinned_commit_can_be_fetched_again(origin, tmp_path):
    folder, _ = origin
    sha = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()
    assert git.clone(f"file://{folder}", str(tmp_path / "pinned"), sha) == (sha, True)
    git.update(str(tmp_path / "pinned"), sha)
    assert git.head(str(tmp_path / "pinned")) == sha
    with pytest.raises(CorpusError):
        git.clone(f"file://{folder}", str(tmp_path / "bad"), "0" * 40)
    assert not (tmp_path / "bad").exists()
