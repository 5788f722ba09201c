"""Symbols by a table of suffixes: the same list as comparing every symbol."""

from quarrylight.operators import lookup, names

LONG = "configuration_of_the_retrying_client_for_requests"
ROWS = [
    ("Retry", 1), ("retry", 2), ("RetryRequest", 3), ("max_retries", 4), ("Client.Retry", 5), ("client::retry", 6), ("x", 7), ("", 8), (None, 9), ("naïveCafé", 10),
    ("İstanbul", 11), (LONG, 12), (LONG + "_2", 13), ("a" * 3000 + "Retry", 14), ("re%try_", 15), ("Retry", 1),
]


def test_same_list_as_comparing_all(spark, tmp_path):
    symbols = spark.createDataFrame([("r", f"f{line % 3}", n, "func", line) for n, line in ROWS], "repo string, path string, name string, kind string, line long")
    files = spark.createDataFrame([("r", f"f{i}", "go", i % 2) for i in range(3)], "repo string, path string, lang string, flags int")
    own = names.Names.write(symbols, str(tmp_path))
    rows = lambda df: sorted((r["list_place"], r["name"], r["path"], r["line"], r["match"]) for r in df.collect())
    for q in ("Retry", "retr", "Client.Retry", "a::b.retry", "caf", "i̇s", LONG[:40].upper(), LONG[3:], "aaaretry", "%t", "_", "", "x.", "none such"):
        want = rows(lookup.find_symbols(symbols, files, q))
        assert rows(own.find(files, q)) == want, q
    assert "StringStartsWith(suffix,retry)" in own.holding("retry")._jdf.queryExecution().toString()
    assert "In(name_lower, [" in own.symbols_for("caf")._jdf.queryExecution().toString() or "EqualTo(name_lower," in own.symbols_for("caf")._jdf.queryExecution().toString()
    assert own.suffixes.selectExpr("max(length(suffix))").first()[0] == names.REACH


def test_no_symbols(spark, tmp_path):
    own = names.Names.write(spark.createDataFrame([], "repo string, path string, name string, kind string, line long"), str(tmp_path))
    files = spark.createDataFrame([], "repo string, path string, lang string, flags int")
    assert own.find(files, "x").count() == 0
