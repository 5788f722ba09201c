"""``python -m quarrylight.cli COMMAND ...``: the verbs on the command line, and as tools over JSON lines."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .errors import GENERAL, OK, PARTIAL, CorpusError
from .functions import constants as C
from .functions import paths
from .operators import views
from .operators.judge import Judge
from .operators.ranking import overlap_scorer
from .plans import evaluate, present
from .plans.corpus import Corpus
from .sources import evalset

SYNONYMS = {"s": "search", "find": "search", "grep": "search", "rm": "remove", "ls": "list", "pull": "update", "sync": "update", "cat": "show", "read": "show"}
TOOLS = {
    "search": ("query", "mode", "repos", "langs", "path", "categories", "limit", "budget", "deep"),
    "show": ("target", "context"),
    "tree": ("repo", "path", "depth"),
    "list": ("categories",),
    "categories": (),
    "add": ("source", "sources", "name", "categories"),
    "update": ("repos",),
    "remove": ("repos",),
    "status": (),
}


def rows(df: DataFrame) -> list[dict]:
    """A view's rows; views are limited to what a screen holds."""
    return [json.loads(r) for r in df.toJSON().collect()]


def listed(value: Any) -> list[str]:
    """A list, or a comma-separated string as one."""
    return [x for x in (value.split(",") if isinstance(value, str) else value or []) if x]


def rolled_up(items: list[dict]) -> list[dict] | dict:
    """What became of each item; the first error is raised if nothing else came of any."""
    errors = [x["error"] for x in items if "error" in x]
    if errors and len(errors) == len(items):
        raise errors[0]
    out = [x | ({"error": x["error"].message, "hint": x["error"].hint} if "error" in x else {}) for x in items]
    return out if len(out) > 1 else out[0]


def run(corpus: Corpus, command: str, a: dict) -> Any:
    number = lambda k, default=None: int(a[k]) if a.get(k) not in (None, "") else default
    match command:
        case "search" | "def":
            engine = corpus.engine()
            chosen = listed(a.get("repos")) + [r["name"] for r in rows(views.in_categories(corpus.repos(), listed(a.get("categories"))))]
            mode = "symbol" if command == "def" else a.get("mode") or "auto"
            found = engine.search(a["query"], mode, chosen or None, listed(a.get("langs")), a.get("path"), number("limit"), bool(a.get("deep")))
            shown = present.present(engine, a["query"], found, number("budget", C.BUDGET))
            return present.as_text(shown) if a.get("text") else dataclasses.asdict(shown)
        case "show":
            return rows(corpus.engine().show(a["target"], number("context", 0)))
        case "tree":
            return rows(corpus.engine().tree(a["repo"], a.get("path") or "", number("depth", 2)))
        case "list":
            return rows(corpus.engine().list(corpus.repos(), listed(a.get("categories"))))
        case "categories":
            return rows(views.category_counts(corpus.repos()))
        case "status":
            return rows(corpus.status())
        case "add":
            out = corpus.add_all(listed(a.get("sources") or a["source"]), a.get("name") or "", listed(a.get("categories")))
            return rolled_up(out)
        case "eval":
            scorers = {"keyword": None} | ({"reranked": corpus.scorer} if corpus.scorer else {})
            return rows(evaluate.evaluate(corpus.engine(), evalset.read(corpus.spark, a["cases"]), scorers))
        case "guide":
            return evaluate.GUIDE
        case "update":
            return corpus.update(listed(a.get("repos")) or None)
        case "remove":
            return corpus.remove(listed(a.get("repos")))
        case "reindex":
            return corpus.reindex()
        case "tag" | "untag":
            return corpus.tag(a["repo"], listed(a.get("categories")), command == "untag")
    raise CorpusError(GENERAL, f"unknown command {command!r}", "see --help")


def serve(corpus: Corpus, source: TextIO, sink: TextIO) -> None:
    """JSON-RPC 2.0, a message a line: initialize, ping, tools/list, tools/call.  Errors of tools are results."""
    for line in source:
        if not line.strip():
            continue
        answer: dict[str, Any] = {"jsonrpc": "2.0", "id": None}
        try:
            ask = json.loads(line)
        except ValueError:
            answer["error"] = {"code": -32700, "message": "parse error"}
        else:
            if "id" not in ask:
                continue
            answer["id"] = ask["id"]
            params = ask.get("params") or {}
            match ask.get("method"):
                case "initialize":
                    info = {"name": "quarrylight", "version": __version__}
                    answer["result"] = {"protocolVersion": params.get("protocolVersion", ""), "capabilities": {"tools": {}}, "serverInfo": info}
                case "ping":
                    answer["result"] = {}
                case "tools/list":
                    schema = lambda names: {"type": "object", "properties": {n: {} for n in names}}
                    answer["result"] = {"tools": [{"name": n, "inputSchema": schema(names)} for n, names in TOOLS.items()]}
                case "tools/call" if params.get("name") in TOOLS:
                    try:
                        text, failed = json.dumps(run(corpus, params["name"], params.get("arguments") or {})), False
                    except CorpusError as e:
                        text, failed = f"{e.message}\n{e.hint}", True
                    except (KeyError, ValueError) as e:
                        text, failed = f"argument {e} is missing or wrong", True
                    answer["result"] = {"content": [{"type": "text", "text": text}], "isError": failed}
                case "tools/call":
                    answer["error"] = {"code": -32602, "message": "unknown tool"}
                case _:
                    answer["error"] = {"code": -32601, "message": "unknown method"}
        print(json.dumps(answer), file=sink, flush=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrylight", description="Search collections of source code and text.")
    p.add_argument("--root", default="references", help="folder of the catalog, checkouts and index")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, many: str = "") -> argparse.ArgumentParser:
        c = sub.add_parser(name, aliases=[k for k, v in SYNONYMS.items() if v == name])
        for x in positional:
            c.add_argument(x)
        if many:
            c.add_argument(many, nargs="*")
        return c

    for name in ("search", "def"):
        c = command(name, many="query")
        c.add_argument("--mode", choices=paths.MODES)
        for option in ("--repos", "--langs", "--path", "--categories", "--limit", "--budget"):
            c.add_argument(option)
        c.add_argument("--text", action="store_true", help="for reading, not as JSON")
        c.add_argument("--deep", action="store_true")
        c.add_argument("--local-rerank", action="store_true", help="rerank by the share of the query's terms")
    command("show", "target").add_argument("--context", default=0)
    c = command("tree", "repo")
    c.add_argument("path", nargs="?", default="")
    c.add_argument("--depth", default=2)
    command("list").add_argument("--categories", "--category")
    c = command("add", many="sources")
    c.add_argument("--name")
    c.add_argument("--categories", "--category")
    for name in ("update", "remove"):
        command(name, many="repos")
    for name in ("tag", "untag"):
        command(name, "repo", many="categories")
    c = command("eval", "cases")
    c.add_argument("--local-rerank", action="store_true", help="also with hits reranked by the share of the query's terms")
    for name in ("categories", "status", "reindex", "serve", "guide"):
        command(name)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = vars(parser().parse_args(argv))
    name = SYNONYMS.get(a["command"], a["command"])
    spark = spark or SparkSession.builder.appName("quarrylight").getOrCreate()
    try:
        blend = float(os.environ.get("JUDGE_BLEND") or C.BLEND)
        corpus = Corpus(spark, a["root"], overlap_scorer if a.get("local_rerank") else Judge.from_environment(), blend)
        if name == "serve":
            serve(corpus, sys.stdin, sys.stdout)
            return OK
        if isinstance(a.get("query"), list):
            a["query"] = " ".join(a["query"])
        out = run(corpus, name, a)
        print(out if isinstance(out, str) else json.dumps(out))
        items = out if isinstance(out, list) else [out]
        failed = name in ("add", "update") and any(x["status"].startswith(("error", "failed")) for x in items)
        return PARTIAL if failed or (name == "status" and out) else OK
    except CorpusError as e:
        print(f"{e.message}\n{e.hint}", file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
