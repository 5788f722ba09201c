"""Searches by the trigram index find what a search of all files finds, and read only files that may match."""

import re

import pytest

import pyarrow as pa
from quarrylight.operators import lookup, trigrams
from quarrylight.operators.trigrams import Grams, needed_grams, required_texts

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
TEXTS = [f"{a} {b}\n{b}({a})\n" for a in WORDS for b in WORDS] + [
    None, "", "ab", "x\nyz\n", "Straße ΟΔΟΣ İstanbul\nend\r\nALPHA\r\n", "日本語のテキスト\n", "a.b*c [d] {e}\n", "y" * 3000 + "needle", "z" * (1 << 20) + "needle",
]
FIXED = ["alpha beta", "ALPHA", "Alpha", "needle", "a.b*c", "日本語", "straße", "οδοσ", "ΟΔΟΣ", "İstanbul", "ab", "absent text", "yz\n", "d\r", "beta(zeta)", "end"]
PATTERNS = [
    "alpha be.a", "(alpha|beta) gamma", "alpha$|^needle", "iota?\\(", "kap+a [a-z]+", "theta\\([a-z]{4}\\)", "x*", "al(ph|xx)a zeta", "[a-c]eta\\(iota", "^ab$", "(?i)ALPHA beta",
    "a\\.b\\*c", "\\bzeta\\b", "delta{1,2} eta", "del{0}ta", "Straße|needle", "\\Qa.b\\E", "[]x] \\{e", "alpha |beta ", "z{3}needle", "end|", "eta (?=iota)",
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r" if i % 3 else "s", f"f{i}", t, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "repo string, path string, text string, extra int").repartition(4).persist()


@pytest.fixture(scope="module")
def grams(files, tmp_path_factory):
    return Grams.write(files, str(tmp_path_factory.mktemp("grams")), parts=16)


def test_fixed_texts(files, grams):
    for p in FIXED:
        want = sorted(map(tuple, lookup.grep(files, p).collect()))
        assert sorted(map(tuple, grams.grep(p).collect())) == want, p


def test_patterns(files, grams):
    for p in PATTERNS:
        try:
            want = sorted(map(tuple, lookup.grep(files, lookup.check_regex(p), False).collect()))
        except Exception:  # noqa: BLE001, S112
            continue  # no pattern for the engine
        assert sorted(map(tuple, grams.grep(p, False).collect())) == want, p


def test_what_a_pattern_needs():
    assert required_texts("token = .[0-9a-f]{8}") == [["token = ", "", "", ""]]
    assert required_texts("rights? reserved|KEY") == [["right", " reserved"], ["KEY"]]
    assert required_texts("a(b|c)+def\\.x*") == [["a", "", "def.", ""]]
    assert required_texts("a\\d") == required_texts("(?i)x") == required_texts("a{2") == [[]]
    assert needed_grams("ab") == set() and len(needed_grams("abcd")) == 2


def test_only_parts_with_candidates_are_read(spark, files, grams):
    rows = grams.files_for("beta(zeta)")
    assert rows.count() == 1
    assert grams.candidates("beta(zeta)").select("part").distinct().count() == 1 and len(grams.files.inputFiles()) > 8
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ (=|IN) ", plan)  # so the other parts are not even opened
    assert re.search(r"PushedFilters: \[In\(gram|PushedFilters: \[[^\]]*gram", plan)
    assert grams.candidates("x*", False) is None and grams.candidates("absent text").count() == 0
    assert grams.files_for("ab").count() == len(TEXTS)


def test_workers_hand_on_slices_of_a_batch():
    """What a worker holds doesn't follow the number of texts of a batch."""
    texts = [f"text number {i} of some" for i in range(50)]
    b = pa.RecordBatch.from_pydict({"repo": ["r"] * 50, "path": [f"p{i}" for i in range(50)], "part": pa.array([1] * 50, pa.int32()), "low": texts})
    out = list(trigrams.gram_batches(iter([b]), 100))
    assert len(out) > 5 and max(x.num_rows for x in out) < 130
    rows = [(r["path"], r["gram"]) for x in out for r in x.to_pylist()]
    assert rows == [(f"p{i}", g) for i, x in enumerate(texts) for g in trigrams.grams_of(x)]
