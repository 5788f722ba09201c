"""Searches of blocks: the same shortlists as scoring everything, with fewer blocks read."""

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import blocks, index, ranking
from quarrylight.plans import queries as plans
from quarrylight.plans.engine import Engine
from quarrylight.sources.corpus import line_symbols

SF = "/root/testdata/sf0.001"


def store(chunks, files, folder, width):
    spark = chunks.sparkSession
    blocks.numbered(chunks).write.parquet(f"{folder}/chunks")
    stored = spark.read.parquet(f"{folder}/chunks")
    index.write_postings(index.postings_of(stored), stored.count(), folder, lambda p, total: blocks.write(p, stored, files, total, folder, width))
    rows, _, total = index.read(spark, folder)
    return blocks.Blocks(spark, folder, total), rows, total


def exhaustive(spark, rows, total, terms, k):
    asked = spark.createDataFrame([(0, t) for t in terms], "query int, term string")
    best = ranking.shortlist(ranking.bm25(rows, asked, total), k)
    return [(r["repo"], r["path"], r["start_line"], round(r["bm25"], 8)) for r in best.orderBy("rank").collect()]


def place_of(found, listed):
    at = {r["number"]: (r["repo"], r["path"], r["start_line"]) for r in found.places.collect()}
    return [(*at[n], round(s, 8)) for n, s in listed]


def test_shortlists_equal_exhaustive_ones(spark, tmp_path):
    found, rows, total = store(plans.chunks_of(spark, SF, body=True), plans.files_of(spark, SF), str(tmp_path), 4)
    often = [r["term"] for r in rows.groupBy("term").count().orderBy(F.desc("count"), "term").limit(40).collect()]
    rare = [r["term"] for r in rows.groupBy("term").count().where("count = 2").orderBy("term").limit(3).collect()]
    for terms in (often[:3], [rare[1], rare[1], often[30], "absent"]):
        want = exhaustive(spark, rows, total, terms, 1000)
        for k, first, listed in ((10, 1, 1000), (3, 2, 5), (1000, 2, 3)):
            assert place_of(found, found.best(terms, k, first, listed)) == want[:k], (terms, k, first, listed)
    assert found.best(["absent"]) == []


def test_blocks_below_the_threshold_are_skipped(spark, tmp_path):
    """A few chunks that are full of a word stand among many that have it once."""
    words = [("r", f"f{i:05d}", "alpha " * 30 if i % 500 == 7 else "alpha " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(4000)]
    rows = spark.createDataFrame(words, "repo string, path string, body string")
    chunks = rows.selectExpr("repo", "path", "1L as start_line", "1L as end_line", "'' as symbol", "'block' as kind", "body")
    files = rows.selectExpr("repo", "path", "'text' as lang", "0 as flags")
    found, postings, total = store(chunks, files, str(tmp_path), 16)
    got = place_of(found, found.best(["alpha"], 8, 8))
    assert got == exhaustive(spark, postings, total, ["alpha"], 8) and len(got) == 8
    there, scored = found.looked_at
    assert there == 250 and scored == 8
    # ties: all chunks but eight are alike, so the first of them by place fill up the list
    got = place_of(found, found.best(["alpha"], 20, 8))
    assert got == exhaustive(spark, postings, total, ["alpha"], 20)
    read = found.blocks.where("term = 'alpha'").where(blocks.within("block", [3, 5]))
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,alpha), In(block, [3,5])]" in read._jdf.queryExecution().toString()


@pytest.mark.parametrize("stem", [False, True])
def test_the_engine_finds_the_same(spark, tmp_path, stem):
    files = plans.files_of(spark, SF)
    Engine(files, plans.chunks_of(spark, SF, body=True), line_symbols(files), stem).save(str(tmp_path / "a"))
    own = Engine.open(spark, str(tmp_path / "a"), stem)
    own.save(str(tmp_path / "b"))  # stored postings have no numbers of chunks
    again, plain = Engine.open(spark, str(tmp_path / "b"), stem), Engine.open(spark, str(tmp_path / "a"), stem)
    plain.blocks = None
    plain_rows = lambda e, q: [tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in e.search(q, "concept").hits.orderBy("place").collect()]
    for row in plans.asked(spark, SF).orderBy("query").limit(2).collect():
        want = plain_rows(plain, row["q"])
        assert want and plain_rows(own, row["q"]) == want and plain_rows(again, row["q"]) == want
    assert plain_rows(own, "zzzz yyyy") == []
