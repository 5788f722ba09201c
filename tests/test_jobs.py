"""The jobs: two runs over growing input (on copies), the command line, and the same result when run again."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import evaluate_search, refresh_index
from quarrylight.operators import index
from quarrylight.sources import corpus

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def postings(docs):
    files = corpus.as_files(docs)
    return sorted(map(str, index.postings_of(corpus.window_chunks(files, 8, True), False).collect()))


def test_refresh_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level("INFO")
    folder, out, at = str(tmp_path / "documents"), str(tmp_path / "index"), str(tmp_path / "checkpoint")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    run = lambda: refresh_index.run(spark, folder, out, at, stem=False)
    docs.where("doc_id < 150").coalesce(1).write.parquet(folder)
    own = run()
    assert sorted(map(str, own.live("postings").collect())) == postings(docs.where("doc_id < 150"))
    before = {f: os.path.getmtime(f) for d, _, fs in os.walk(out) for f in (os.path.join(d, x) for x in fs)}
    run()  # nothing new
    assert {f: os.path.getmtime(f) for f in before} == before
    assert "read 0 new rows" in caplog.text
    # new documents, a changed one and a removed one
    changed = docs.where("doc_id = 3").withColumn("text", F.lit("Quite another text\nof two lines\n"))
    removed = docs.where("doc_id = 4").withColumn("text", F.lit(None).cast("string"))
    docs.where("doc_id >= 150").unionByName(changed).unionByName(removed).coalesce(1).write.mode("append").parquet(folder)
    caplog.clear()
    own = run()
    assert "read 52 new rows in 1 batches" in caplog.text
    now = docs.where("doc_id not in (3, 4)").unionByName(changed)
    assert sorted(map(str, own.live("postings").collect())) == postings(now)
    assert sorted(map(str, run().live("postings").collect())) == postings(now)


def test_a_refresh_that_was_cut_off_is_done_again(spark, tmp_path, monkeypatch):
    folder, out, at = str(tmp_path / "documents"), str(tmp_path / "index"), str(tmp_path / "checkpoint")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").where("doc_id < 40")
    docs.coalesce(1).write.parquet(folder)
    write = refresh_index.Segments._write

    def broken(self, name, rows, segment):
        if name == "files":
            raise RuntimeError("lost")
        write(self, name, rows, segment)

    monkeypatch.setattr(refresh_index.Segments, "_write", broken)
    with pytest.raises(Exception, match="lost"):
        refresh_index.run(spark, folder, out, at, stem=False)
    monkeypatch.setattr(refresh_index.Segments, "_write", write)
    assert sorted(map(str, refresh_index.run(spark, folder, out, at, stem=False).live("postings").collect())) == postings(docs)


def test_evaluation_replaces_its_own_configurations(spark, tmp_path):
    docs, items, out = f"{SF}/documents.parquet", f"{SF}/benchmark.parquet", str(tmp_path / "out")
    some = [{"name": "a", "mode": "concept", "lines_per_chunk": 8}, {"name": "b", "mode": "exact", "lines_per_chunk": 8}]
    first = sorted(map(str, evaluate_search.run(spark, docs, items, out, some).collect()))
    answers = lambda: sorted(map(str, spark.read.parquet(f"{out}/answers").collect()))
    before = answers()
    assert sorted(map(str, evaluate_search.run(spark, docs, items, out, some[:1]).collect())) == first  # b stays
    assert answers() == before
    stemmed = evaluate_search.run(spark, docs, items, out, [{"name": "c", "mode": "concept", "lines_per_chunk": 8, "stem": True, "limit": 3}])
    assert {r["configuration"] for r in stemmed.collect()} == {"a", "b", "c"}
    places = spark.read.parquet(f"{out}/answers").where("configuration = 'c'").agg(F.max("place")).first()[0]
    assert places == 3
    right = spark.read.parquet(f"{out}/answers").where("right").select("query").distinct().count()
    assert right and all(0 < r["mrr"] <= 1 for r in stemmed.collect() if r["configuration"] != "b")
    with pytest.raises(ValueError, match="none of"):
        evaluate_search.run(spark, docs, items, out, [{"name": "x", "mode": "other"}])


def test_evaluation_sees_new_documents(spark, tmp_path):
    """A right answer that comes with new documents is found by the next run."""
    docs, out = str(tmp_path / "documents"), str(tmp_path / "out")
    spark.createDataFrame([(1, "plain words here\nand there\n", "en", "s"), (2, "other words\nand lines\n", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(docs)
    spark.createDataFrame([(7, "rare question of a user")], "item_id long, text string").write.parquet(str(tmp_path / "items"))
    some = [{"name": "a", "mode": "concept", "lines_per_chunk": 8}]
    assert evaluate_search.run(spark, docs, str(tmp_path / "items"), out, some).first()["cases"] == 0
    spark.createDataFrame([(3, "rare question of a user\nwith an answer\n", "en", "s")], "doc_id long, text string, lang string, source string").write.mode("append").parquet(docs)
    row = evaluate_search.run(spark, docs, str(tmp_path / "items"), out, some).first()
    assert (row["cases"], row["hit1"], row["mrr"]) == (1, 1.0, 1.0)


@pytest.mark.parametrize(("job", "config"), [("refresh_index", {"stem": False}), ("evaluate_search", {"configurations": [{"name": "a", "mode": "exact", "lines_per_chunk": 8}]})])
def test_command_line(tmp_path, job, config):
    config |= {"documents": "/nowhere", "output": str(tmp_path / "out")} | ({"checkpoint": str(tmp_path / "cp")} if job == "refresh_index" else {"benchmark": f"{SF}/benchmark.parquet"})
    (tmp_path / "config.json").write_text(json.dumps(config, indent=1))
    shutil.copytree(f"{SF}", tmp_path / "data", ignore=lambda d, names: [n for n in names if n != "documents.parquet"])
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_CONF_DIR": str(tmp_path), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    run = [sys.executable, str(ROOT / "jobs" / f"{job}.py"), str(tmp_path / "config.json"), "--documents", str(tmp_path / "data")]
    out = subprocess.run(run, capture_output=True, text=True, env=env, cwd=tmp_path, timeout=300, check=False)
    assert out.returncode == 0, out.stderr[-3000:]
    assert job in out.stderr and (tmp_path / "out").exists()
    assert subprocess.run([*run[:2], "--help"], capture_output=True, env=env, timeout=60, check=False).returncode == 0
