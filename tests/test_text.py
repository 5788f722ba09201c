import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.functions import paths, porter, text


@pytest.mark.parametrize(
    ("token", "want"),
    [
        ("parseHTTPConfig", ["parse", "http", "config"]), ("max_retries", ["max", "retries"]), ("$scope", ["scope"]), ("utf8Decode", ["utf8", "decode"]),
        ("ABC", ["abc"]), ("__", []),
    ],
)
def test_parts(spark, token, want):
    assert text.split_parts(token) == want
    assert spark.range(1).select(text.parts(F.lit(token)).alias("p")).first()["p"] == want


def test_expand_keeps_the_identifier_before_its_parts(spark):
    source = "retry(max_retries, parseConfig) x1"
    want = ["retry", "max_retries", "max", "retries", "parseconfig", "parse", "config", "x1"]
    assert text.expand_text(source) == want
    row = spark.range(1).select(text.expand(F.lit(source)).alias("e"), text.index_tokens(F.lit("max_retries")).alias("t")).first()
    assert row["e"] == want and row["t"] == ["max", "retries", "max", "retries"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abAB1_$ é.Ñ", max_size=12), min_size=1, max_size=20))
def test_columns_equal_strings(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    own = rows.select("t", text.expand(F.col("t")).alias("e"), text.stem_light(F.col("t")).alias("s")).collect()
    assert all(r["e"] == text.expand_text(r["t"]) and r["s"] == text.light_stem(r["t"]) for r in own)


@pytest.mark.parametrize(("word", "want"), [("receiving", "receiv"), ("stopped", "stop"), ("boxes", "box"), ("is", "is"), ("bed", "bed"), ("logs", "log")])
def test_light_stem(word, want):
    assert text.light_stem(word) == want


def test_query_terms():
    assert {"message", "msg", "receive", "recv"} <= set(text.query_terms("how does it receive a message"))
    assert {"backoff", "retry"} <= set(text.query_terms("retry when backed off"))
    assert "login" in text.query_terms("log in") and "the" not in text.query_terms("the end")
    assert text.query_terms("is it the") == []
    assert text.query_terms("maxRetries")[:3] == ["maxretries", "max", "retries"]
    assert text.match_expression(['a"b', "c"]) == '"ab" OR "c"'


@pytest.mark.parametrize(
    ("query", "mode"),
    [
        ("parseConfig", "symbol"), ("a.b::c", "symbol"), ("x->y", "symbol"), ('"exact words"', "exact"), ("foo.*bar", "regex"), ("how does it work", "concept"),
        ("func (", "concept"), ("a-b", "concept"), ("", "concept"),
    ],
)
def test_modes(query, mode):
    assert paths.mode_of(query) == mode


@pytest.mark.parametrize(("glob", "want"), [("docs", "*docs*"), ("a\\b", "*a/b*"), ("src/**/x*.go", "src/*/x*.go"), ("***", "*")])
def test_glob_pattern(glob, want):
    assert paths.glob_pattern(glob) == want


def test_globs_match_as_in_sqlite():
    import re

    db = sqlite3.connect(":memory:")
    names = ["a/b.go", "a/[x].go", "ab", "b-c", "A/B.GO", "x.y", "-", "a\nb"]
    for glob in ["*.go", "a/?.go", "[a-b]*", "[^a]*", "*[x]*", "a/[", "x.y", "*-*", "[]x]*"]:
        for n in names:
            want = bool(db.execute("select ? glob ?", (n, glob)).fetchone()[0])
            if glob not in ("a/[", "[]x]*"):
                assert bool(re.match(paths.glob_regex(glob), n)) == want, (glob, n)


def test_porter_equals_the_full_text_index():
    words = (
        "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing"
        " filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization"
        " predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti"
        " electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent"
        " adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll delay nothing internal retries"
        " generalizations oscillators be at by yes says boy apologies flying dying skies controlling queueing ion onion tion sion vision abolition"
        " naïve café señor größe mañana élan axb yy ay eau rhythm syzygy"
    ).split()
    syllables = ["at", "tion", "es", "ing", "er", "bl", "eed", "y", "s", "ous", "i", "al", "ness", "q", "ll", "iv", "e"]
    words += [a + b + c for a in syllables for b in syllables for c in syllables]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.executemany("insert into t(rowid, x) values (?, ?)", enumerate(words))
    db.execute("create virtual table v using fts5vocab(t, instance)")
    want = dict(db.execute("select doc, term from v"))
    wrong = [(w, want[i], porter.porter(porter.fold(w))) for i, w in enumerate(words) if want.get(i) != porter.porter(porter.fold(w))]
    assert not wrong, wrong[:20]
