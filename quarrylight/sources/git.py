"""Checkouts of repositories: a connector on the driver, for ``tracked_files`` to read."""

from __future__ import annotations

import os
import re
import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession

from ..errors import GENERAL, USER, CorpusError

# What git says in its messages, and what helps.
HINTS = {
    "could not resolve host": "check the network",
    "repository not found": "check the URL and whether the repository is private",
    "authentication failed": "set up credentials for this host",
    "permission denied": "check the SSH key",
    "remote branch": "check the ref",
    "couldn't find remote ref": "check the ref",
}


#: Seconds that a git command may take.
LONGEST = 600


def available() -> bool:
    return shutil.which("git") is not None


def _git(*args: str, cwd: str | None = None) -> str:
    if not available():
        raise CorpusError(GENERAL, "git is not installed", "install git")
    try:
        run = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"}, timeout=LONGEST)
    except subprocess.TimeoutExpired as e:
        raise CorpusError(GENERAL, f"git {args[0]} took more than {LONGEST} s", "check the network or try again") from e
    if run.returncode:
        low = run.stderr.lower()
        fatal = [x for x in run.stderr.splitlines() if x.startswith("fatal")] or run.stderr.splitlines()[:1] or ["git failed"]
        raise CorpusError(USER, fatal[-1], next((h for k, h in HINTS.items() if k in low), ""))
    return run.stdout


def clone(url: str, folder: str, ref: str = "") -> tuple[str, bool]:
    """A shallow checkout; returns what it tracks and whether that is pinned (a commit or a tag).  What fails leaves no new folder behind."""
    there = os.path.exists(folder)
    try:
        if re.fullmatch("[0-9a-f]{40}", ref):
            os.makedirs(folder)
            _git("init", "-q", cwd=folder)
            _git("remote", "add", "origin", url, cwd=folder)
            update(folder, ref)
            return ref, True
        _git("clone", "-q", "--depth", "1", "--single-branch", "--no-tags", *(["--branch", ref] if ref else []), url, folder)
        branch = _git("rev-parse", "--abbrev-ref", "HEAD", cwd=folder).strip()
        return (ref, True) if branch == "HEAD" else (branch, False)
    except CorpusError:
        if not there:
            shutil.rmtree(folder, ignore_errors=True)
        raise


def update(folder: str, ref: str) -> None:
    _git("fetch", "-q", "--depth", "1", "origin", ref, cwd=folder)
    _git("reset", "-q", "--hard", "FETCH_HEAD", cwd=folder)


def head(folder: str) -> str:
    return _git("rev-parse", "HEAD", cwd=folder).strip()


def listing(spark: SparkSession, folder: str, repo: str) -> DataFrame:
    """repo, path, blob of tracked files; submodules are none."""
    records = [r.split("\t", 1) for r in _git("ls-files", "-s", "-z", cwd=folder).split("\0") if r]
    rows = [(repo, path, meta.split()[1]) for meta, path in records if not meta.startswith("160000")]
    return spark.createDataFrame(rows, "repo string, path string, blob string")
