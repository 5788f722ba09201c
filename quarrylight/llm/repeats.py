"""Substring dedup: removes word windows that also start earlier, over prefix-partitioned suffix trees.

A suffix is a window of ``window`` words with what follows; two windows are equal when they stand below
the same node of the suffix tree at depth ``window``.

1. Documents with the same words are one; all but the first are removed whole (if long enough).
2. Each window has an anchor: of its runs of ``prefix`` words the one with the smallest name.  Equal
   windows have equal anchors at the same offset.  One in seven runs is an anchor, and only windows
   with an anchor that occurs twice can be repeated: the others are not looked at again.
3. Consecutive windows with one anchor are a stretch.  Of stretches with the same words only the first
   goes on; all windows of the others are repeated.  That is summed up before the shuffle, so a passage
   that a third of all documents share, or one document a million times, costs a row for each task.
4. Different stretches are split by prefix, the ``prefix`` words of their anchor.  Each group that fits
   in memory (at most ``group`` stretches) becomes a suffix tree: stretches are sorted by their words
   from the anchor on, and each run of neighbours with d words or more in common is an internal node of
   depth d.  Windows whose anchor stands at offset o are equal when they stand below one node of depth
   ``window`` - o and are led by the same o words; all but the first of them are repeated.
5. Groups above ``group`` are split by longer prefixes, those of their windows themselves.  The stretches
   of such a group differ in what leads to their common words, so the prefix has to be the whole window;
   a group is then one node, and its first place is summed up before the shuffle.
6. The repeated windows, overlaid, are the maximal repeats that go.

Trees compare words.  Equal stretches, and windows of groups above ``group``, are known by names of
128 bits (``wordhash``).

Defined results
---------------
* Words are runs of bytes other than blank and the control characters from tab to carriage return,
  unchanged.  A null text has none.  Kept words are joined by one blank.
* Earlier is: smaller id, or same id and earlier start.  A null id is smaller than any other.
* Repeated rows (same id and words) get the same result.  Rows of one id with different words are
  judged by that order too, each with its own windows.
* Ids are whole numbers of any width; others raise an error.  Only the two named columns are read; an
  empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .scratch import Scratch, shuffle_width

WINDOW, PREFIX, GROUP = 20, 8, 4096
#: Stretches whose trees are built at once, all groups together; the groups that stand in them are whole.
FOREST = 16_384
#: Ids are broadcast up to so many (some 16 MB); beyond it Spark sorts and merges.
BROADCAST_IDS = 250_000
_LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Stands for a null id in the order of documents.
_NULL_ID = -(1 << 63)


def anchors(w: wordhash.Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each window, that of its anchor, and a lane of the name of the run from each word on."""
    starts = w.begins(window)
    at, h = w.runs(prefix)
    g = np.full(len(w.starts) + window, _LARGEST)
    g[at] = h
    least = g[starts] if len(starts) else np.zeros(0, np.uint64)
    place = starts.copy()
    for o in range(1, window - prefix + 1):
        x = g[starts + o]
        less = x < least
        least = np.where(less, x, least)
        place = np.where(less, starts + o, place)
    return starts, place, g


def stretches(w: wordhash.Words, window: int, prefix: int) -> dict[str, np.ndarray]:
    """Runs of windows of one row with one anchor: their row, first word, number of windows, words up to the anchor, and the anchor's name."""
    starts, place, g = anchors(w, window, prefix)
    row = np.searchsorted(w.word_at, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    wins = np.diff(np.append(first, len(starts)))
    return {"row": row[first], "at": starts[first], "wins": wins, "lead": place[first] - starts[first], "h": g[place[first]]}


def repeated_windows(
    h: np.ndarray, ids: np.ndarray, start: np.ndarray, lead: np.ndarray, wins: np.ndarray, words: pa.ListArray, window: int, prefix: int
) -> np.ndarray:
    """For whole groups of stretches: at [row, o], whether the window with its anchor at offset o starts earlier in another row."""
    n, reach = len(h), window - prefix
    code = words.values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    begin = words.offsets.to_numpy()
    from_anchor = lead[:, None] + np.arange(window)
    right = np.where(from_anchor < np.diff(begin)[:, None], code[np.minimum(begin[:-1, None] + from_anchor, len(code) - 1)], 0)
    to_anchor = lead[:, None] - 1 - np.arange(reach)
    left = np.where(to_anchor >= 0, code[np.maximum(begin[:-1, None] + to_anchor, 0)], 0)
    # The tree: neighbours in the order of their words, and how many words from the anchor on they share.
    order = np.lexsort((*right.T[::-1], h))
    share = np.logical_and.accumulate(right[order][1:] == right[order][:-1], axis=1).sum(1)
    share[h[order][1:] != h[order][:-1]] = -1
    place = np.unique(ids, return_inverse=True)[1] << 32
    led = np.zeros(n, np.int64)  # equal for rows that are led by the same o words
    again = np.zeros((n, reach + 1), bool)
    for o in range(reach + 1):
        if o:
            led = np.unique(led * (code.max() + 1) + left[:, o - 1], return_inverse=True)[1]
        node = np.empty(n, np.int64)
        node[order] = np.concatenate([[0], np.cumsum(share < window - o)])
        own = np.flatnonzero((lead >= o) & (lead - o < wins))
        key, at = node[own] * n + led[own], place[own] + start[own] + lead[own] - o
        by = np.lexsort((at, key))
        head = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]) if len(by) else [])
        first = np.repeat(at[by][head], np.diff(np.append(head, len(by))))
        again[own[by[at[by] != first]], o] = True
    return again


def joined(data: np.ndarray, words: tuple[np.ndarray, np.ndarray]) -> bytes:
    starts, ends = words
    raw = data.tobytes()
    return b" ".join([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())])


def _hashes_of_all(w: wordhash.Words) -> list[str]:
    """SHA-256 of each row's words joined by one blank."""
    sep = wordhash.SEPARATES[w.data]
    keep = np.ones(len(w.data), bool)
    keep[1:] = ~(sep[1:] & sep[:-1])
    edge = np.zeros(len(w.data) + 1, bool)
    edge[w.text_at] = True
    keep[edge[:-1] & sep] = False  # a separator at the start of a row
    flat = np.where(sep, np.uint8(32), w.data)[keep].tobytes()
    at = np.concatenate([[0], np.cumsum(keep)])[w.text_at].tolist()
    return [hashlib.sha256(flat[a:b].rstrip(b" ") if flat[b - 1 : b] == b" " else flat[a:b]).hexdigest() for a, b in zip(at, at[1:])]


def _names(w: wordhash.Words) -> tuple[pa.Array, pa.Array]:
    """Both lanes of the name of each row's words."""
    return pa.array(w.whole().view(np.int64)), pa.array(w.whole(1).view(np.int64))


def _split(column: pa.Array) -> pa.ListArray:
    """The words of each text, as bytes."""
    data, size, count = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for w in wordhash.words(column):
        data.append(w.data[~wordhash.SEPARATES[w.data]])
        size.append(w.ends - w.starts)
        count.append(w.counts)
    at = np.cumsum(np.concatenate(size))
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.concatenate(data))])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(count)).astype(np.int32)), words)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    if not isinstance(kind := docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"ids are {kind.simpleString()}, not whole numbers")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_NULL_ID))
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(ident.alias("id"), F.xxhash64(text).alias("x"), text.alias("text"))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    prefix: int = PREFIX,
    group: int = GROUP,
    with_text: bool = True,
) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, and if asked for kept_text and spans.

    ``spans`` are the maximal repeats that go, as numbers of their first and last words from 0; text
    and spans are null where nothing is removed.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = _texts(docs, id_col, text_col)
    by_id = _Texts(texts, scratch)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wordhash.sparing(batches):
            for w in wordhash.words(b.column("text")):
                _, place, g = anchors(w, window, prefix)
                place = np.unique(place)
                at = np.searchsorted(place, w.word_at)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").slice(w.first_row, w.rows), b.column("x").slice(w.first_row, w.rows),
                        pa.array(w.counts.astype(np.int64)),
                        *_names(w),
                        pa.array(_hashes_of_all(w), pa.string()),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(g[place].view(np.int64))),
                    ],
                    ["id", "x", "n", "f", "g", "sha", "prefixes"],
                )

    meta = scratch.keep("meta", texts.mapInArrow(scan, "id bigint, x bigint, n bigint, f bigint, g bigint, sha string, prefixes array<bigint>"))
    first = meta.where(f"n >= {window}").groupBy("f", "g", "n").agg(F.min(F.struct("id", "x", "prefixes")).alias("v"))
    first = scratch.keep("first", first.select("f", "g", "n", "v.*"))
    heads = first.select("id", "x", F.explode("prefixes").alias("h"))
    twice = scratch.keep("twice", heads.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
    # prefixes of a document that occur twice: at most as many as it has words
    found = heads.join(twice.hint("merge"), "h").groupBy("id", "x").agg(F.collect_set("h").alias("found"))
    found = scratch.keep("found", found)
    scratch.drop("twice")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wordhash.sparing(batches):
            for w in wordhash.words(b.column("text")):
                s = stretches(w, window, prefix)
                wanted = b.column("found").slice(w.first_row, w.rows).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                some = np.flatnonzero(np.isin(s["h"], wanted))
                row, at, wins = (s[k][some] for k in ("row", "at", "wins"))
                begins = w.begins(window)
                one, last = np.searchsorted(begins, at), np.searchsorted(begins, at + wins - 1)
                names = []
                for lane in (0, 1):  # the first and the last window hold all words of a stretch
                    node = w.runs(window, lane)[1]
                    names.append(wordhash.mix(wordhash.mix(node[one] + wins.astype(np.uint64)) + node[last]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s["h"][some].view(np.int64)), pa.array(names[0]), pa.array(names[1]),
                        *(b.column(c).take(pa.array(w.first_row + row)) for c in ("id", "x")), pa.array(w.whole().view(np.int64)[row]),
                        pa.array((at - w.word_at[row]).astype(np.int32)), pa.array(s["lead"][some].astype(np.int32)), pa.array(wins.astype(np.int32)),
                    ],
                    ["h", "d1", "d2", "id", "x", "f", "start", "lead", "wins"],
                )

    # rows of one id with different words each bring the stretches they have
    some = by_id.joined(found)
    places = "h bigint, d1 bigint, d2 bigint, id bigint, x bigint, f bigint, start int, lead int, wins int"
    places = scratch.keep("places", some.mapInArrow(cut, places))
    scratch.drop("found")
    classes = places.groupBy("h", "d1", "d2").agg(F.min(F.struct("id", "start", "x", "f", "lead", "wins")).alias("v"))
    classes = scratch.keep("classes", classes.select("h", "d1", "d2", "v.*"))
    one = classes.select("d1", "d2", F.struct("id", "start").alias("first"), F.col("x").alias("first_x"))
    late = places.join(one.hint("merge"), ["d1", "d2"]).where("struct(id, start) <> first")
    late = late.select("id", "x", "f", F.expr("sequence(start, start + wins - 1)").alias("starts"))

    shared = classes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h", (F.col("c") > group).alias("large"))
    shared = scratch.keep("shared", shared)
    asked = classes.join(shared.hint("merge"), "h").groupBy("id", "x").agg(F.collect_list(F.struct("f", "start", "lead", "wins", "h", "large")).alias("asked"))
    asked = scratch.keep("asked", asked)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of small groups with their words, and the names of the windows of large ones."""
        for b in wordhash.sparing(batches):
            lists = b.column("asked")
            for w in wordhash.words(b.column("text")):
                own = lists.slice(w.first_row, w.rows)
                rows = np.repeat(np.arange(w.rows), own.value_lengths().to_numpy(zero_copy_only=False))
                flat = own.flatten()
                f, start, lead, wins, h, large = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
                here = f == w.whole().view(np.int64)[rows]
                at = w.word_at[rows] + start
                small, big = np.flatnonzero(here & ~large), np.flatnonzero(here & large)
                of = lambda row: [b.column(c).take(pa.array(w.first_row + row)) for c in ("id", "x")]  # noqa: E731, B023
                lo, hi = w.starts[at[small]], w.ends[at[small] + window + wins[small] - 2]
                raw = w.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[small]), *of(rows[small]), pa.array(f[small]),
                        *(pa.array(x[small]) for x in (start, lead, wins)),
                        pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())], pa.binary()), pa.nulls(len(small), pa.int64()), pa.nulls(len(small), pa.int64()),
                    ],
                    ["h", "id", "x", "f", "start", "lead", "wins", "words", "w1", "w2"],
                )
                if len(big):
                    each = np.repeat(big, wins[big])
                    k = np.arange(len(each)) - np.repeat(np.cumsum(wins[big]) - wins[big], wins[big])
                    window_at = np.searchsorted(w.begins(window), at[each] + k)
                    none = pa.nulls(len(each), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h[each]), *of(rows[each]), pa.array(f[each]), pa.array((start[each] + k).astype(np.int32)), none, none,
                            pa.nulls(len(each), pa.binary()), *(pa.array(w.runs(window, lane)[1][window_at].view(np.int64)) for lane in (0, 1)),
                        ],
                        ["h", "id", "x", "f", "start", "lead", "wins", "words", "w1", "w2"],
                    )

    some = by_id.joined(asked)
    cuts = some.mapInArrow(suffixes, "h bigint, id bigint, x bigint, f bigint, start int, lead int, wins int, words binary, w1 bigint, w2 bigint")
    cuts = scratch.keep("suffixes", cuts)
    scratch.drop("asked")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group; groups are whole in what is worked on at once."""
        held: list[pa.RecordBatch] = []

        def trees(t: pa.Table) -> pa.RecordBatch:
            h, ids, x, f, start, lead, wins = (t.column(c).to_numpy() for c in ("h", "id", "x", "f", "start", "lead", "wins"))
            again = repeated_windows(h, ids, start.astype(np.int64), lead.astype(np.int64), wins, _split(t.column("words").combine_chunks()), window, prefix)
            row, o = np.nonzero(again[:, ::-1])  # in order of start
            starts = start[row] + lead[row] - (again.shape[1] - 1 - o)
            count = np.bincount(row, minlength=len(h))
            rows = np.flatnonzero(count)
            at = np.concatenate([[0], np.cumsum(count[rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(starts.astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(x[rows]), pa.array(f[rows]), lists], ["id", "x", "f", "starts"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < FOREST:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if whole:
                yield trees(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield trees(t)

    stretch_rows = cuts.where("words is not null").select("h", "id", "x", "f", "start", "lead", "wins", "words")
    marked = stretch_rows.repartition("h").sortWithinPartitions("h").mapInArrow(forest, "id bigint, x bigint, f bigint, starts array<int>")
    wide = cuts.where("words is null").select("w1", "w2", "id", "x", "f", "start")
    firsts = wide.groupBy("w1", "w2").agg(F.min(F.struct("id", "start")).alias("first"))
    firsts = scratch.keep("firsts", firsts)  # so that both sides of the join are exchanges, which Spark splits where they are skewed
    wide = wide.join(firsts.hint("merge"), ["w1", "w2"]).where("struct(id, start) <> first").select("id", "x", "f", F.array("start").alias("starts"))
    repeated = late.unionByName(marked).unionByName(wide)
    # rows that repeat id and text bring equal lists, which meet within a task first
    collected = F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts")
    repeated = scratch.keep("repeated", repeated.groupBy("id", "x", "f").agg(collected))
    several = meta.groupBy("id").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a <> b").select("id")
    several = scratch.keep("several", several)
    if not several.isEmpty():
        # stretches of other texts of an id that start where the first ones do are as early as these: their windows fare alike
        alike = places.join(several.hint("merge"), "id", "left_semi").join(one.hint("merge"), ["d1", "d2"])
        alike = alike.where("struct(id, start) = first and x <> first_x").select("id", "x", "f", "start", "wins", "first_x")
        alike = alike.join(repeated.select("id", F.col("x").alias("first_x"), "starts").hint("merge"), ["id", "first_x"])
        alike = alike.select("id", "x", "f", F.expr("filter(starts, s -> s between start and start + wins - 1)").alias("starts"))
        repeated = scratch.keep("repeated-alike", repeated.unionByName(alike).groupBy("id", "x", "f").agg(collected))
    scratch.drop("places", "classes", "shared", "suffixes", "firsts")

    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wordhash.sparing(batches):
            for w in wordhash.words(b.column("text")):
                f, g = _names(w)
                here = np.flatnonzero(b.column("f").slice(w.first_row, w.rows).to_numpy() == f.to_numpy())
                own = pa.array(here)
                gone, sha, kept, spans = [], [], [], []
                for r in here.tolist():
                    words = slice(w.word_at[r], w.word_at[r + 1])
                    n = words.stop - words.start
                    starts = np.asarray(b.column("starts")[w.first_row + r].values)
                    edge = np.zeros(n + window + 1, np.int32)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    stay = np.cumsum(edge)[:n] == 0
                    at = w.text_at[r]
                    text = joined(w.data[at : w.text_at[r + 1]], (w.starts[words][stay] - at, w.ends[words][stay] - at))
                    gone.append(int(n - stay.sum()))
                    sha.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode() if with_text else None)
                    turns = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]))) if with_text else stay[:0]
                    spans.append([{"first": int(a), "last": int(z) - 1} for a, z in zip(turns[::2], turns[1::2])] if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").slice(w.first_row, w.rows).take(own), pa.array(w.counts[here].astype(np.int64)), f.take(own), g.take(own),
                        pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(spans, span_type),
                    ],
                    ["id", "n", "f", "g", "gone", "kept_sha", "kept", "spans"],
                )

    # A text whose windows all start earlier elsewhere under the same id and words is covered like its first row.
    part = by_id.joined(repeated)
    covered = "id bigint, n bigint, f bigint, g bigint, gone bigint, kept_sha string, kept string, spans array<struct<first: int, last: int>>"
    part = part.mapInArrow(cover, covered).dropDuplicates(["id", "n", "f", "g"])
    part = scratch.keep("covered", part)
    by_id.drop()
    marks = meta.drop("prefixes", "x").join(first.select("f", "g", "n", F.col("id").alias("first_id")).hint("merge"), ["f", "g", "n"], "left")
    whole = F.expr("first_id is not null and first_id <> id")
    marks = marks.join(part.hint("merge"), ["id", "n", "f", "g"], "left")
    out = marks.select(
        F.when(F.col("id") != _NULL_ID, F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("n").alias("n_words"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(whole, "").otherwise(F.col("kept")).alias("kept_text"),
        F.when(whole, F.expr("array(struct(0 as first, cast(n - 1 as int) as last))")).otherwise(F.col("spans")).alias("spans"),
    )
    return out if with_text else out.drop("kept_text", "spans")


class _Texts:
    """The texts (id, x, text), to be joined with what is known of some of them, several times; x is a hash of the text.

    With the hash in the key, the lists of a row's joins are its own, however many rows have its id, as null ids have.  While those ids are few enough they are sent to all tasks, and no text moves.  Beyond that the texts
    are dealt out by both once, into a table with a bucket for each shuffle partition, and all joins merge with it.
    """

    def __init__(self, texts: DataFrame, scratch: Scratch):
        self.texts, self.scratch, self.table = texts, scratch, None

    def joined(self, of_ids: DataFrame) -> DataFrame:
        """The texts with the rows of their ids and hashes."""
        key = ["id", "x"]
        ids = of_ids.select(*key).distinct()
        if self.table is None and ids.count() <= BROADCAST_IDS:
            return self.texts.join(F.broadcast(ids), key, "left_semi").join(of_ids.hint("merge"), key)
        spark = self.texts.sparkSession
        if self.table is None:
            self.table = "quarrylight_texts_" + self.scratch.path.rpartition("-")[2]
            n = shuffle_width(spark)
            dealt = self.texts.repartition(n, *key).write.format("parquet").bucketBy(n, *key).sortBy(*key)
            dealt.option("path", f"{self.scratch.path}/texts").saveAsTable(self.table)
        return spark.table(self.table).join(of_ids.hint("merge"), key)

    def drop(self) -> None:
        if self.table:
            self.texts.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")
            self.scratch.drop("texts")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP3_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS g
  FROM (SELECT *, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})
),
firsts AS (SELECT g, min((doc_id, i)) AS f FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM windows JOIN firsts USING (g) WHERE (doc_id, i) <> f
),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
