"""An index in segments equals one that is built anew, after every kind of change and after a crash at every step."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import index
from quarrylight.plans.engine import Engine
from quarrylight.sources import corpus
from quarrylight.streaming import segments
from quarrylight.streaming.segments import Segments, refresh

FILE = "repo string, path string, blob string, text string, lang string, size int, flags int, version bigint"
NAMES = ("chunks", "symbols", "postings", "files")


def cut(files):
    return corpus.window_chunks(files, 8, True), corpus.line_symbols(files)


def frame(spark, rows, version=0):
    """Rows (path, text) or (path, text, version) of one repository."""
    full = [("r", p, None if t is None else f"blob of {t}", t, "text", len(t or ""), 0, *(v or (version,))) for p, t, *v in rows]
    return spark.createDataFrame(full, FILE)


def same(segments, texts):
    """Whether the live tables are those of an index over the texts (path -> text)."""
    spark = segments.spark
    files = frame(spark, list(texts.items())).drop("version")
    chunks, symbols = cut(files)
    for name, want in (("files", files), ("chunks", chunks), ("symbols", symbols), ("postings", index.postings_of(chunks, False))):
        got = segments.live(name)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    assert segments.statistics().first() == index.statistics(chunks).first()


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if "_staged" not in d and f.endswith(".parquet"))


def text(i, n=3):
    return "".join(f"Word{i} of line {k}\nand more {i * k}\n" for k in range(n))


def test_changes_follow_each_other(spark, tmp_path):
    own = Segments(spark, str(tmp_path), cut, stem=False)
    now = {f"f{i}": text(i) for i in range(30)}
    assert own.apply(frame(spark, list(now.items()), 1), 0) == {"added": 30, "changed": 0, "removed": 0}
    same(own, now)
    first = size(tmp_path)
    change = [("f3", text(99)), ("f4", None), ("new", text(50)), ("f5", text(5)), ("none", None)]
    assert own.apply(frame(spark, change, 2), 1) == {"added": 1, "changed": 1, "removed": 1}
    now |= {"f3": text(99), "new": text(50)}
    del now["f4"]
    same(own, now)
    assert size(tmp_path) - first < first  # what is written follows the change; small files have much overhead
    assert own.apply(frame(spark, change, 2), 1) == {"added": 1, "changed": 1, "removed": 1}  # the same batch again
    same(own, now)
    assert own.apply(frame(spark, change, 2), 2) == {"added": 0, "changed": 0, "removed": 0}  # the same rows as a new batch
    assert own.numbers() == [0, 2]
    assert own.apply(frame(spark, [("f4", text(4))], 3), 3)["added"] == 1  # a removed file comes back
    same(own, now | {"f4": text(4)})


def test_written_bytes_follow_the_change(spark, tmp_path):
    own = Segments(spark, str(tmp_path), cut, stem=False)
    own.apply(frame(spark, [(f"f{i}", text(i, 400)) for i in range(60)], 1), 0)
    before = size(tmp_path)
    own.apply(frame(spark, [("f7", text(77, 400))], 2), 1)
    assert size(tmp_path) - before < before / 10


def test_a_late_older_version_is_skipped(spark, tmp_path):
    own = Segments(spark, str(tmp_path), cut, stem=False)
    rows = [("a", text(1), 5), ("a", text(2), 7), ("a", text(3), 6), ("b", text(4), 5), ("b", None, 9)]
    assert own.apply(frame(spark, rows).repartition(3), 0) == {"added": 1, "changed": 0, "removed": 0}
    same(own, {"a": text(2)})
    assert own.apply(frame(spark, [("a", text(8), 6), ("c", text(9), 1)]), 1) == {"added": 1, "changed": 0, "removed": 0}
    same(own, {"a": text(2), "c": text(9)})


def test_a_crash_before_each_table(spark, tmp_path, monkeypatch):
    own = Segments(spark, str(tmp_path), cut, stem=False)
    old = {f"f{i}": text(i) for i in range(5)}
    own.apply(frame(spark, list(old.items()), 1), 0)
    write, crash_at = Segments._write, []

    def broken(self, name, rows, segment):
        if name in crash_at:
            raise RuntimeError("lost")
        write(self, name, rows, segment)

    change = frame(spark, [("f1", text(11)), ("f2", None), ("g", text(6))], 2)
    monkeypatch.setattr(Segments, "_write", broken)
    for name in NAMES:
        crash_at[:] = [name]
        with pytest.raises(RuntimeError):
            own.apply(change, 1)
        assert {r["path"] for r in own.live("postings").select("path").distinct().collect()} == set(old)  # what is there of the batch isn't live
    crash_at.clear()
    own.apply(change, 1)
    new = {k: v for k, v in old.items() if k != "f2"} | {"f1": text(11), "g": text(6)}
    same(own, new)
    monkeypatch.setattr(Segments, "to_merge", lambda self: self.numbers())
    crash_at[:] = ["files"]
    with pytest.raises(RuntimeError):
        own.merge()
    assert {r["path"] for r in own.live("postings").select("path").distinct().collect()} == set(new)
    crash_at.clear()
    own.merge()
    same(own, new)
    assert len(own.numbers()) == 1


def test_merged_segments(spark, tmp_path, monkeypatch):
    own = Segments(spark, str(tmp_path), cut, stem=False)
    now = {}
    for n in range(4):
        change = [(f"f{n}-{k}", text(n + k)) for k in range(3)] + ([(f"f{n - 1}-0", None), (f"f{n - 1}-1", text(70 + n))] if n else [])
        own.apply(frame(spark, change, n), n)
        now |= dict(change)
        own.merge()
    assert len(own.numbers()) <= 2
    now = {p: t for p, t in now.items() if t is not None}
    same(own, now)
    drop = Segments._drop
    monkeypatch.setattr(Segments, "_drop", lambda self, numbers: None)  # a crash before the old segments go
    own.apply(frame(spark, [("x", text(3))], 9), 9)
    monkeypatch.setattr(Segments, "to_merge", lambda self: self.numbers())
    own.merge()
    monkeypatch.setattr(Segments, "_drop", drop)
    own.merge()
    same(own, now | {"x": text(3)})
    assert len(own.numbers()) == 1


def test_a_stream_can_be_searched(spark, tmp_path):
    """A folder that a stream keeps up to date answers as an engine over the same files does."""
    incoming, folder = str(tmp_path / "in"), str(tmp_path / "index")
    files = corpus.document_files(spark, "/root/testdata/sf0.001").withColumn("version", F.lit(1).cast("bigint"))
    own = Segments(spark, folder, cut, stem=False)

    def run():
        refresh(spark.readStream.schema(files.schema).parquet(incoming), own, str(tmp_path / "checkpoint")).awaitTermination()

    files.where("repo <> 'src3'").coalesce(1).write.parquet(incoming)
    run()
    changed = files.where("repo = 'src5'").withColumns({"text": F.lit("The rights reserved\nhere and there\n"), "blob": F.lit("x"), "version": F.lit(2).cast("bigint")})
    removed = files.where("repo = 'src7'").withColumns({"text": F.lit(None).cast("string"), "version": F.lit(2).cast("bigint")})
    files.where("repo = 'src3'").unionByName(changed).unionByName(removed).coalesce(1).write.mode("append").parquet(incoming)
    run()
    run()
    now = files.where("repo not in ('src5', 'src7')").unionByName(changed).drop("version")
    anew, stored = Engine(now, *cut(now), stem=False), own.engine()
    columns = ["repo", "path", "start_line", "end_line", "place"]
    for q in ("rights reserved here", '"rights reserved"', "rights? reserved"):
        got, want = (sorted(map(str, e.search(q).hits.select(columns).collect())) for e in (stored, anew))
        assert got == want and got
    assert stored.list(spark.createDataFrame([], "name string, url string, ref string, pinned boolean, sha string, categories array<string>, added_at timestamp, updated_at timestamp")).count() == 0


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_live_rows_need_no_join_of_all_files(spark, tmp_path, monkeypatch):
    """One segment is read as it is; of several only what a later one holds as well is taken out, with places that are null."""
    own = Segments(spark, str(tmp_path), cut, stem=False)

    def check(texts):
        chunks, symbols = cut(frame(spark, list(texts.items())))
        for name, want in (("chunks", chunks), ("symbols", symbols), ("postings", index.postings_of(chunks, False))):
            assert sorted(map(str, own.live(name).collect())) == sorted(map(str, want.collect())), name
        assert {r["path"]: r["text"] for r in own.live("files").collect()} == texts and own.live("files").count() == len(texts)

    own.apply(frame(spark, [*((f"f{i}", text(i)) for i in range(6)), (None, text(7))], 1), 0)
    assert all("Join" not in plan(own.live(name)) for name in NAMES)
    now = {f"f{i}": text(i) for i in range(6)} | {None: text(7)}
    check(now)
    own.apply(frame(spark, [("f1", text(11)), ("f2", None), (None, text(8))], 2), 1)
    now |= {"f1": text(11), None: text(8)}
    del now["f2"]
    assert {(r["path"], r["segment"]) for r in own.superseded().collect()} == {("f1", 0), ("f2", 0), (None, 0)}
    check(now)
    monkeypatch.setattr("quarrylight.streaming.segments.broadcast_if_small", lambda df: df.hint("merge"))  # as if they were many
    check(now)
    monkeypatch.setattr(Segments, "to_merge", lambda self: self.numbers())
    own.merge()
    check(now)


def test_texts_and_postings_are_dealt_out_once(spark, tmp_path, monkeypatch):
    """Neither chunks nor postings are stored before they are written."""
    own, staged, stage = Segments(spark, str(tmp_path), cut, stem=False), [], Segments._staged
    monkeypatch.setattr(Segments, "_staged", lambda self, name, rows: staged.append(name) or stage(self, name, rows))
    now = {f"f{i}": text(i) for i in range(9)}
    own.apply(frame(spark, list(now.items()), 1), 0)
    assert "postings" not in staged and "chunks" not in staged
    same(own, now)


def test_ranges_of_postings(spark, tmp_path, monkeypatch):
    """Postings in ranges are all postings; ranges follow each other, each is sorted, and a frequent term is in several."""
    monkeypatch.setattr(index, "SAMPLED", 400)
    monkeypatch.setattr(index, "RANGE", 300)
    texts = {f"f{i}": "".join(f"Common word{i} x{i * k % 97}\ncommon again\n" for k in range(16)) for i in range(150)}
    corpus.window_chunks(frame(spark, list(texts.items())), 8, True).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    own = index.ranged_postings(chunks, chunks.count())
    want = index.postings_of(chunks)
    assert own.columns == want.columns and sorted(map(str, own.collect())) == sorted(map(str, want.collect()))
    parts = {}
    for r in own.select(F.spark_partition_id().alias("part"), "term", "repo", "path").collect():
        parts.setdefault(r["part"], []).append((r["term"], r["repo"], r["path"]))
    rows = [parts[k] for k in sorted(parts)]
    assert len(rows) > 5 and all(r == sorted(r) for r in rows)
    assert all(a[-1][0] <= b[0][0] for a, b in zip(rows, rows[1:]))
    assert sum(any(x[0] == "common" for x in r) for r in rows) > 1 and max(map(len, rows)) < len(own.collect()) / 3


def shuffle_files(spark):
    """Names of the shuffle files on disk; a local session has one block manager."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_disk_beside_the_tables_is_bounded(spark, tmp_path, monkeypatch):
    """Shuffle files go with each round, not when garbage is collected; staged rows go with the batch or the merge."""
    own = Segments(spark, str(tmp_path), cut, stem=False)
    key, before, most, put = segments.CLEANUP, shuffle_files(spark), [], Segments._put
    set_before = spark.conf.get(key, None)

    def watched(self, name, rows, segment, mode):
        put(self, name, rows, segment, mode)
        for _ in range(50):  # files are removed in the background
            if not shuffle_files(spark) - before:
                break
            time.sleep(0.1)
        most.append(len(shuffle_files(spark) - before))

    monkeypatch.setattr(Segments, "_put", watched)
    monkeypatch.setattr(Segments, "to_merge", lambda self: self.numbers())
    texts = {f"f{i}": text(i, 20) for i in range(40)}
    for n in range(2):
        own.apply(frame(spark, [(p, t) for i, (p, t) in enumerate(texts.items()) if i % 2 == n], n), n)
        assert not os.path.exists(tmp_path / "_staged")
    own.merge()
    assert not os.path.exists(tmp_path / "_staged")
    assert len(most) == 12 and most == [0] * 12
    assert spark.conf.get(key, None) == set_before
    same(own, texts)


def test_postings_and_merges_in_rounds(spark, tmp_path, monkeypatch):
    """Rounds hold all rows once, places that are null too; a round that was cut off leaves nothing behind."""
    monkeypatch.setattr(segments, "ROUND", 200)
    monkeypatch.setattr(segments, "MERGED", 500)
    monkeypatch.setattr(Segments, "_ranged", lambda self, name, rows: rows.repartitionByRange(4, *segments.SORTED_BY[name]).sortWithinPartitions(*segments.SORTED_BY[name]))
    chunks_in_files = lambda files: (corpus.window_chunks(files, 8, True).repartition(4, "path"), corpus.line_symbols(files))
    own, puts, put = Segments(spark, str(tmp_path), chunks_in_files, stem=False), [], Segments._put
    lost = []

    def watched(self, name, rows, segment, mode):
        puts.append((name, mode))
        if lost and puts.count(lost[0]) == 2:
            raise RuntimeError("lost")
        put(self, name, rows, segment, mode)

    monkeypatch.setattr(Segments, "_put", watched)
    texts = {f"f{i:02}": text(i, 20) for i in range(40)} | {None: text(50, 20)}
    first, second = ([(p, t) for i, (p, t) in enumerate(texts.items()) if i % 2 == n] for n in range(2))
    lost[:] = [("postings", "append")]
    with pytest.raises(RuntimeError):
        own.apply(frame(spark, first, 1), 0)
    lost.clear()
    own.apply(frame(spark, first, 1), 0)
    own.apply(frame(spark, [*second, ("f00", text(70, 20)), ("f02", None)], 2), 1)
    now = texts | {"f00": text(70, 20)}
    del now["f02"]

    def check():
        chunks, symbols = cut(frame(spark, list(now.items())))
        for name, want in (("chunks", chunks), ("symbols", symbols), ("postings", index.postings_of(chunks, False))):
            assert sorted(map(str, own.live(name).collect())) == sorted(map(str, want.collect())), name
        assert {r["path"]: r["text"] for r in own.live("files").collect()} == now and own.live("files").count() == len(now)

    assert puts.count(("postings", "append")) > 4
    check()
    puts.clear()
    monkeypatch.setattr(Segments, "to_merge", lambda self: self.numbers())
    lost[:] = [("chunks", "append")]
    with pytest.raises(RuntimeError):
        own.merge()
    check()
    lost.clear()
    puts.clear()
    own.merge()
    assert all(puts.count((name, "overwrite")) == 1 and puts.count((name, "append")) > 0 for name in NAMES)
    assert len(own.numbers()) == 1
    check()
    files = own.spark.read.parquet(f"{own.folder}/postings").groupBy(F.input_file_name()).agg(F.min("term").alias("a"), F.max("term").alias("b"))
    ranges = sorted((r["a"], r["b"]) for r in files.collect())
    assert len(ranges) > 4 and all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:]))  # merged postings stand in one order


def test_texts_are_neither_grouped_nor_joined(spark, tmp_path):
    """The rows of a batch that count are found where they are dealt out: one exchange of texts, after a first batch as well."""
    own = Segments(spark, str(tmp_path), cut, stem=False)
    own.apply(frame(spark, [(f"f{i}", text(i)) for i in range(6)], 1), 0)
    batch = frame(spark, [("f1", text(11), 3), ("f1", text(12), 2), ("f2", None, 2), ("f3", text(3), 2), ("f4", text(9), 0), ("g", text(1), None), ("h", None, 2)])
    found = own._changes(batch.repartition(3), 2)
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange rangepartitioning") == 1 and "max_by" not in executed
    assert executed.index("Window") < executed.index("Exchange rangepartitioning") < executed.index("Join")  # what is known is joined below, without texts
    assert {(r["path"], r["status"], r["text"]) for r in found.collect()} == {("f1", "changed", text(11)), ("f2", "removed", None), ("g", "added", text(1))}
