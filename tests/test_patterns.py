"""Many patterns in one scan find what each finds alone."""

import pytest

from quarrylight.operators import lookup, patterns
from quarrylight.sources import corpus

TEXTS = [
    "one Two\nthree two\r\nfour\n", "ÀB été\nİx two two\n", "", None, "no line end two", "two\n" * 60, "a\nb\n\n\ntwo three\n", "Two three\n  four five  \n", "日本語 two\n語\n",
]
ASKED = ["two", "Two", "three", "two three", "e", "été", "İx", "four five ", "\n", "b\n", "語", "absent", "two", ""]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("r", f"f{i}", t) for i, t in enumerate(TEXTS)], "repo string, path string, text string").repartition(3)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 5])
def test_grep_many_equals_grep(spark, files, slice_bytes):
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query long, pattern string")
    for per_file, most in ((50, 5000), (3, 7), (50, None)):
        got = sorted(map(tuple, patterns.grep_many(files, asked, per_file, most, slice_bytes).collect()))
        want = [(i, *r) for i, p in enumerate(ASKED) if p for r in lookup.grep(files, p, True, per_file, most).collect()]
        assert got == sorted(want)


def test_texts_that_hold_a_pattern(spark, files):
    asked = spark.createDataFrame([(str(i), p) for i, p in enumerate(ASKED)], "query string, pattern string")
    for most in (1 << 20, 5):
        got = sorted(map(tuple, patterns.holding(files, asked, most).collect()))
        assert got == sorted((str(i), "r", f"f{k}") for i, p in enumerate(ASKED) if p for k, t in enumerate(TEXTS) if p in (t or ""))
    none = spark.createDataFrame([], "query long, pattern string")
    assert patterns.holding(files, none).count() == patterns.grep_many(files, none).count() == 0


def test_groups_of_many_equal_groups_of_one(spark, files):
    chunks = corpus.window_chunks(files, 2)
    asked = spark.createDataFrame([(1, "two"), (2, "e")], "query long, pattern string")
    got = sorted(map(tuple, patterns.groups_of_many(patterns.grep_many(files, asked), chunks).select("query", "repo", "path", "start_line", "end_line", "n").collect()))
    want = [(i, *r) for i, p in ((1, "two"), (2, "e")) for r in lookup.group_by_chunk(lookup.grep(files, p), chunks).select("repo", "path", "start_line", "end_line", "n").collect()]
    assert got == sorted(want)


def test_matches_are_cut_down_in_parts_first(spark):
    """No task reads all matches of a frequent pattern, and the first in order of place stay."""
    files = spark.createDataFrame([(f"r{i % 3}", f"p{i:02}", "one of many\nmany\n") for i in range(60)], "repo string, path string, text string")
    asked = spark.createDataFrame([(1, "many"), (2, "one")], "query long, pattern string")
    own = patterns.grep_many(files, asked, most=7)
    plan = own._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(query#" in plan and "xxhash64(repo#" in plan
    all_of = sorted((q, f"r{i % 3}", f"p{i:02}", n) for i in range(60) for q, n in ((1, 1), (1, 2), (2, 1)))
    want = [x for q in (1, 2) for x in [y for y in all_of if y[0] == q][:7]]
    assert sorted((r["query"], r["repo"], r["path"], r["line"]) for r in own.collect()) == want
