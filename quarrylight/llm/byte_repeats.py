"""Substring dedup of bytes: removes every byte of a string of ``window`` bytes that starts anywhere else, too, by prefix-free parsing.

1. Equal texts are one, with the number of their copies; texts are dealt out by digest once and stay so.
2. Triggers are the places whose next GRAM bytes have a rolling hash divisible by a constant.  A window's
   anchor is, of the ANCHOR bytes at its triggers, the string with the smallest hash: equal windows have
   equal anchors at the same offset.  Consecutive windows with one anchor are a stretch, about one for each
   80 bytes.  Only texts with anchors that occur twice are looked at again, and there only those anchors.
3. All windows of stretches that occur twice are repeated.  Occurrences are summed up before the shuffle,
   so a passage that a third of all texts share costs a row for each task and stretch.
4. Different stretches with one anchor are dealt to one task, which works through whole groups by
   prefix-free parsing (``repeated_windows``): triggers cut them into phrases that overlap by a trigger,
   so that no phrase suffix is the beginning of another.  The suffix array of the dictionary (the different phrases) and
   that of the parse (the phrases' ranks) give the order of all windows: by the rest of their phrase, then by the
   phrases that follow.  Equal windows are neighbours in that order; neighbours are compared byte by byte.
5. Groups of more than ``group`` different stretches, and windows without a trigger, are exchanged as names of single
   windows (128 bits), summed up before the shuffle.
6. Runs of repeated windows of a text are overlaid on its bytes.

Defined results
---------------
* Texts are their UTF-8 bytes; a null text is empty.  Matches don't cross rows.
* Each row is a document: of two rows with equal texts, also of one id, each repeats the other.  A text
  shorter than ``window`` loses nothing.
* ``kept_bytes`` may begin or end within a character.
* Ids may be of any type and null; only id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .scratch import Scratch, shuffle_width

WINDOW, GRAM, ANCHOR, GROUP = 200, 16, 48, 4096
#: One place in so many is a trigger: of anchors, and of the phrases of a group.
ANCHOR_RATE, PHRASE_RATE = 16, 64
#: Bytes of stretches that are parsed at once; the groups that stand in them are whole.
FOREST_BYTES = 1 << 20
_U = np.uint64
_BASE = 0xA24BAED4963EE407 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """The rolling hash of the n bytes from each place on: a polynomial modulo 2**64, as differences of sums."""
    if len(data) < n:
        return np.zeros(0, _U)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, len(data)), out=sums[1:])
    return wordhash.mix((sums[n:] - sums[:-n]) * _powers(_INVERSE, len(data) - n + 1))


def triggers(data: np.ndarray, at: np.ndarray, rate: int, room: int) -> np.ndarray:
    """Places of triggers from which ``room`` bytes lie in one row; rows begin and end at ``at``."""
    place = np.flatnonzero(rolling(data) % _U(rate) == 0)
    return place[place + room <= at[np.searchsorted(at, place, "right").clip(max=len(at) - 1)]]


def stretches(data: np.ndarray, at: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Runs of windows of one row with one anchor: their row, first byte, number of windows, bytes up to the anchor, and its hash."""
    t = triggers(data, at, ANCHOR_RATE, ANCHOR)
    eight = np.ndarray(max(len(data) - 7, 0), "<u8", data.tobytes(), strides=(1,))
    h = np.zeros(len(t), _U)
    for o in range(0, ANCHOR, 8):
        h = wordhash.mix(h * _U(0x9E3779B97F4A7C15) + eight[t + o])
    row = np.searchsorted(at, t, "right") - 1
    reach = window - ANCHOR
    # a trigger is the anchor of the windows that hold it and no trigger with a smaller hash, or with the same hash before it
    first = np.maximum(at[row], t - reach)
    last = np.minimum(t, at[row + 1] - window)
    for step, beats in ((-1, np.less_equal), (1, np.less)):
        open_ = np.arange(len(t))
        d = step
        while len(open_ := open_[(open_ + d >= 0) & (open_ + d < len(t))]):
            other = open_ + d
            near = (np.abs(t[other] - t[open_]) <= reach) & (row[other] == row[open_])
            open_, other = open_[near], other[near]
            less = beats(h[other], h[open_])
            if step < 0:
                first[open_[less]] = np.maximum(first[open_[less]], t[other[less]] + 1)
            else:
                last[open_[less]] = np.minimum(last[open_[less]], t[other[less]] - reach - 1)
            open_ = open_[~less]
            d += step
    some = np.flatnonzero(first <= last)
    return {"row": row[some], "at": first[some], "wins": last[some] - first[some] + 1, "lead": t[some] - first[some], "h": h[some]}


def bare_windows(s: dict[str, np.ndarray], at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the runs of windows that no stretch holds."""
    n = int(at[-1])
    edge = np.zeros(n + 2, np.int32)
    full = np.flatnonzero(np.diff(at) >= window)
    np.add.at(edge, at[full], 1)
    np.add.at(edge, at[full + 1] - window + 1, -1)
    np.add.at(edge, s["at"], -1)
    np.add.at(edge, s["at"] + s["wins"], 1)
    bare = np.concatenate([[0], np.cumsum(edge[:n]) > 0, [0]]).astype(np.int8)
    turns = np.flatnonzero(np.diff(bare))
    return turns[::2], turns[1::2] - turns[::2]


def name(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _ranks(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


def dictionary_order(phrases: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each suffix of each phrase by its first ``depth`` bytes, equal for equal ones, and where each phrase begins."""
    size = np.array([len(p) for p in phrases], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    data = np.concatenate([np.frombuffer(b"".join(phrases), np.uint8), np.zeros(8, np.uint8)]).astype(np.int64)
    n = int(begin[-1])
    rest = np.repeat(begin[1:], size) - np.arange(n)
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = key << 9 | np.where(i < rest, data[i : n + i] + 1, 0)
    rank, h = _ranks(key), 7
    while h < depth and rank.max(initial=0) < n:
        follows = np.zeros(n, np.int64)
        follows[: n - h] = rank[h:] if n > h else 0
        follows[rest <= h] = 0
        rank = _ranks(rank * (n + 1) + follows)
        h *= 2
    return rank, begin


def parse_order(rank: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix of the parses by its phrases, at least as many as hold ``depth`` bytes.

    ``rank`` has the phrases' ranks, ``starts`` the place of each phrase and ``ends`` the index after the last phrase of its parse.
    """
    n, h = len(rank), 1
    at = np.arange(n)
    while (inside := at + h < ends).any() and (starts[(at + h)[inside]] - starts[inside] < depth).any():
        follows = np.zeros(n, np.int64)
        follows[inside] = rank[(at + h)[inside]]
        rank = _ranks(rank * (n + int(rank.max()) + 1) + follows)
        h *= 2
    return rank


def repeated_windows(texts: list[bytes], wins: np.ndarray, window: int) -> np.ndarray:
    """For each window of each text, one text after the other: whether an equal window stands elsewhere among them."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    t = triggers(data, at, PHRASE_RATE, GRAM)
    # the phrases of a text: up to the end of its first trigger, from each trigger to the end of the next, and the rest
    own = np.diff(np.searchsorted(t, at))
    first_phrase = np.concatenate([[0], np.cumsum(own + 1)])
    total = int(first_phrase[-1])
    starts, ends = np.empty(total, np.int64), np.empty(total, np.int64)
    is_first, is_last = np.zeros(total, bool), np.zeros(total, bool)
    is_first[first_phrase[:-1]] = is_last[first_phrase[1:] - 1] = True
    starts[is_first], starts[~is_first] = at[:-1], t
    ends[is_last], ends[~is_last] = at[1:], t + GRAM
    content = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    phrases = sorted(set(content))
    number = {p: i for i, p in enumerate(phrases)}
    phrase = np.fromiter((number[c] for c in content), np.int64, total)
    suffix_rank, begin = dictionary_order(phrases, window)
    parse_rank = parse_order(phrase + 1, starts, np.repeat(first_phrase[1:], own + 1), window)

    row = np.repeat(np.arange(len(texts)), wins)
    p = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(wins) - wins, wins)
    j = np.searchsorted(t, p) + row  # a text has one phrase more than triggers
    follows = np.where(is_last[j], 0, parse_rank[np.minimum(j + 1, total - 1)])
    order = np.argsort(suffix_rank[begin[phrase[j]] + p - starts[j]] * (int(parse_rank.max(initial=0)) + 1) + follows, kind="stable")
    # neighbours: the last eight bytes, then all
    here = p[order]
    eight = np.ndarray(max(len(data) - 7, 0), "<u8", raw, strides=(1,))
    tail = eight[here + window - 8]
    alike = np.flatnonzero(tail[1:] == tail[:-1])
    view = np.lib.stride_tricks.sliding_window_view(data, window)
    same = np.zeros(max(len(here) - 1, 0), bool)
    for lo in range(0, len(alike), 8192):
        x = alike[lo : lo + 8192]
        same[x] = (view[here[x]] == view[here[x + 1]]).all(1)
    again = np.zeros(len(p), bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    return again


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turns = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return turns[::2], turns[1::2] - turns[::2]


def _int32(x) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.int32))


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP, with_bytes: bool = True
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and if asked for kept_bytes and spans.

    ``spans`` are the removed runs as (first byte from 0, number of bytes); bytes and spans are null where nothing is removed.
    """
    if window < ANCHOR:
        raise ValueError(f"a window has {ANCHOR} bytes at least")
    spark = docs.sparkSession
    scratch = Scratch(spark, "bytes")
    digest = F.sha2(_text(text_col), 256)
    named = docs.select(F.col(f"`{id_col}`").alias("id"), digest.alias("sha"), F.octet_length(_text(text_col)).cast("bigint").alias("n"))
    key = F.unhex(F.substring(digest, 1, 32))
    texts = docs.select(key.alias("k"), _text(text_col).alias("text")).where(F.octet_length("text") >= window)
    # copies meet within a task first, so a text that a third of all rows share is sent once by each
    texts = texts.groupBy("k").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    table = "quarrylight_bytes_" + scratch.path.rpartition("-")[2]
    width = shuffle_width(spark)
    dealt = texts.write.format("parquet").bucketBy(width, "k").sortBy("k").option("path", f"{scratch.path}/texts").option("compression", "zstd")
    dealt.saveAsTable(table)
    texts = spark.table(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of each text, and its windows without one."""
        for b in wordhash.sparing(batches):
            raw, at = wordhash.text_bytes(b.column("text"))
            for lo, hi in wordhash.slices(at):
                own, data = at[lo : hi + 1] - at[lo], raw[at[lo] : at[hi]]
                s = stretches(data, own, window)
                held = np.searchsorted(s["row"], np.arange(hi - lo + 1))
                run, many = bare_windows(s, own, window)
                flat, row_of, names, first, number = data.tobytes(), np.searchsorted(own, run, "right") - 1, [], [], []
                count = np.zeros(hi - lo + 1, np.int64)
                for r, x, m in zip(row_of.tolist(), run.tolist(), many.tolist()):
                    for y in range(x, x + m):
                        v = name(flat[y : y + window])
                        if names and names[-1] == v and y > x:
                            number[-1] += 1
                        else:
                            names.append(v), first.append(y - int(own[r])), number.append(1)
                            count[r + 1] += 1
                bare = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(first, pa.int32()), pa.array(number, pa.int32())], ["name", "s", "m"])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("k").slice(lo, hi - lo), b.column("copies").slice(lo, hi - lo),
                        pa.ListArray.from_arrays(_int32(held), pa.array(s["h"].view(np.int64))), pa.ListArray.from_arrays(_int32(np.cumsum(count)), bare),
                    ],
                    ["k", "copies", "anchors", "bare"],
                )

    meta = texts.select("k", "copies", "text").mapInArrow(scan, "k binary, copies bigint, anchors array<bigint>, bare array<struct<name: binary, s: int, m: int>>")
    meta = scratch.keep("meta", meta)
    times = F.least(F.col("copies"), F.lit(2)).alias("times")
    heads = meta.select("k", times, F.explode("anchors").alias("h"))
    twice = scratch.keep("twice", heads.groupBy("h").agg(F.sum("times").alias("c")).where("c > 1").select("h"))
    found = heads.join(twice.hint("merge"), "h").groupBy("k").agg(F.collect_set("h").alias("found"))
    found = scratch.keep("found", found)
    scratch.drop("twice")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches whose anchors are found twice."""
        for b in wordhash.sparing(batches):
            raw, at = wordhash.text_bytes(b.column("text"))
            copies = b.column("copies").to_numpy()
            for lo, hi in wordhash.slices(at):
                own, data = at[lo : hi + 1] - at[lo], raw[at[lo] : at[hi]]
                s = stretches(data, own, window)
                some = np.flatnonzero(np.isin(s["h"], b.column("found").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).view(_U)))
                row, first, wins, flat = s["row"][some], s["at"][some], s["wins"][some], data.tobytes()
                names = [name(flat[x:y]) for x, y in zip(first.tolist(), (first + wins + window - 1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s["h"][some].view(np.int64)), pa.array(names, pa.binary()), b.column("k").take(pa.array(lo + row)),
                        pa.array(np.minimum(copies[lo + row], 2)), _int32(first - own[row]), _int32(wins),
                    ],
                    ["h", "d", "k", "times", "s", "m"],
                )

    places = texts.join(found.hint("merge"), "k").select("k", "copies", "text", "found")
    places = scratch.keep("places", places.mapInArrow(cut, "h bigint, d binary, k binary, times bigint, s int, m int"))
    scratch.drop("found")
    classes = places.groupBy("h", "d").agg(F.sum("times").alias("times"), F.min(F.struct("k", "s", "m")).alias("v"))
    classes = scratch.keep("classes", classes.select("h", "d", "times", "v.*"))
    # texts that have copies go whole, so only where the others repeat is asked for
    lone = places.where("times = 1")
    late = lone.join(classes.where("times > 1").select("h", "d").hint("merge"), ["h", "d"], "left_semi").select("k", "s", "m")

    shared = classes.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("times").alias("least")).where("c > 1 and least = 1")
    shared = scratch.keep("shared", shared.select("h", (F.col("c") > group).alias("large")))
    asked = classes.join(shared.hint("merge"), "h").groupBy("k").agg(F.collect_list(F.struct("h", "times", "s", "m", "large")).alias("asked"))
    asked = scratch.keep("asked", asked)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of groups that fit with their bytes, and the windows of the others by name."""
        for b in wordhash.sparing(batches):
            raw, at = wordhash.text_bytes(b.column("text"))
            for lo, hi in wordhash.slices(at):
                lists = b.column("asked").slice(lo, hi - lo)
                row = lo + np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
                h, times, s, m, large = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                first, flat = at[row] + s - at[lo], raw[at[lo] : at[hi]].tobytes()
                part, names, bits = [], [], []
                for i, (x, n, wide) in enumerate(zip(first.tolist(), m.tolist(), large.tolist())):
                    if wide:
                        part += [(i, o) for o in range(n)]
                        names += [name(flat[y : y + window]) for y in range(x, x + n)]
                        bits += [None] * n
                    else:
                        part.append((i, 0)), names.append(None), bits.append(flat[x : x + n + window - 1])
                    if len(part) >= 20_000 or i == len(m) - 1:
                        i_, o_ = np.array(part, np.int64).T
                        one = large[i_]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(h[i_]), b.column("k").take(pa.array(row[i_])), pa.array(times[i_]), _int32(s[i_] + o_), _int32(np.where(one, 1, m[i_])),
                                pa.array(bits, pa.binary()), pa.array(names, pa.binary()),
                            ],
                            ["h", "k", "times", "s", "m", "bytes", "name"],
                        )
                        part, names, bits = [], [], []

    some = texts.join(asked.hint("merge"), "k").select("k", "text", "asked")
    cuts = scratch.keep("suffixes", some.mapInArrow(suffixes, "h bigint, k binary, times bigint, s int, m int, bytes binary, name binary"))
    scratch.drop("asked")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group; groups are whole in what is parsed at once."""

        def parsed(t: pa.Table) -> pa.RecordBatch:
            wins, begin, times = (t.column(c).to_numpy() for c in ("m", "s", "times"))
            again = repeated_windows(t.column("bytes").to_pylist(), wins, window)
            edge = np.cumsum(wins) - wins
            again[np.repeat(times > 1, wins)] = False  # all windows of those are known to be repeated
            # no run goes on from one stretch to the next
            gap = np.concatenate([[0], np.cumsum(wins + 1)[:-1]]) if len(wins) else edge
            flags = np.zeros(int((wins + 1).sum()), bool)
            flags[np.arange(len(again)) + np.repeat(gap - edge, wins)] = again
            run, many = _runs(flags)
            row = np.searchsorted(gap, run, "right") - 1
            return pa.RecordBatch.from_arrays([t.column("k").combine_chunks().take(pa.array(row)), _int32(begin[row] + run - gap[row]), _int32(many)], ["k", "s", "m"])

        held: list[pa.RecordBatch] = []
        size = 0
        for b in wordhash.sparing(batches):
            for i in range(0, b.num_rows, 1000):
                held.append(part := b.slice(i, 1000))
                size += int(part.column("m").to_numpy().sum()) + window * part.num_rows
                if size < FOREST_BYTES:
                    continue
                t = pa.Table.from_batches(held)
                h = t.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last group may go on
                if whole:
                    yield parsed(t.slice(0, whole))
                    held = t.slice(whole).combine_chunks().to_batches()
                    size = int(sum(x.column("m").to_numpy().sum() + window * x.num_rows for x in held))
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield parsed(t)

    grouped = cuts.where("name is null").select("h", "k", "times", "s", "m", "bytes")
    marked = grouped.repartition("h").sortWithinPartitions("h").mapInArrow(forest, "k binary, s int, m int")
    bare = meta.select("k", times, F.explode("bare").alias("w")).select("k", "times", "w.*")
    windows = cuts.where("name is not null").select("k", "times", "name", "s", "m").unionByName(bare)
    often = windows.groupBy("name").agg(F.sum(F.col("times") * F.col("m")).alias("c")).where("c > 1").select("name")
    often = scratch.keep("often", often)  # so that both sides of the join are exchanges, which Spark splits where they are skewed
    single = windows.where("times = 1").join(often.hint("merge"), "name", "left_semi").select("k", "s", "m")
    repeated = late.unionByName(marked).unionByName(single)
    repeated = scratch.keep("repeated", repeated.groupBy("k").agg(F.collect_list(F.struct("s", "m")).alias("runs")))
    scratch.drop("places", "classes", "shared", "suffixes", "often", "meta")
    span = pa.list_(pa.struct([("first", pa.int32()), ("number", pa.int32())]))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wordhash.sparing(batches):
            raw, at = wordhash.text_bytes(b.column("text"))
            gone, many, shas, kept, spans = [], [], [], [], []
            for r, list_ in enumerate(b.column("runs")):
                data = raw[at[r] : at[r + 1]]
                s, m = (x.to_numpy().astype(np.int64) for x in list_.values.flatten())
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + m + window - 1, -1)
                go = np.cumsum(edge[:-1]) > 0
                rest = data[~go].tobytes()
                first, number = _runs(go)
                gone.append(int(go.sum())), many.append(len(first)), shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_bytes else None)
                spans.append([{"first": int(x), "number": int(y)} for x, y in zip(first, number)] if with_bytes else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary()), pa.array(spans, span)],
                ["k", "gone", "many", "kept_sha", "kept", "spans"],
            )

    part = texts.where("copies = 1").join(repeated.hint("merge"), "k").select("k", "text", "runs")
    verdict = "k binary, gone bigint, many bigint, kept_sha string, kept binary, spans array<struct<first: int, number: int>>"
    part = part.mapInArrow(cover, verdict)
    whole = texts.where("copies > 1").select(
        "k", F.octet_length("text").cast("bigint").alias("gone"), F.lit(1).cast("bigint").alias("many"), F.lit(_EMPTY).alias("kept_sha"), F.unhex(F.lit("")).alias("kept"),
        F.array(F.struct(F.lit(0).alias("first"), F.octet_length("text").alias("number"))).alias("spans"),
    )
    part = scratch.keep("covered", part.unionByName(whole))
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    scratch.drop("texts", "repeated")
    out = named.withColumn("k", F.unhex(F.substring("sha", 1, 32))).join(part.hint("merge"), "k", "left")
    out = out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.coalesce("gone", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("many", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
        F.col("kept").alias("kept_bytes"),
        "spans",
    )
    return out if with_bytes else out.drop("kept_bytes", "spans")


def op12_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_bytes=False)


#: Windows as digits of their bytes, cut from parts of a thousand bytes.
OP12_SQL = f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (
  SELECT r, p, substr(h, p * 2000 + 1, {2000 + 2 * WINDOW}) AS x, len(h) // 2 AS n FROM (SELECT r, h, unnest(range(len(h) // 2000 + 1)) AS p FROM b)
),
windows AS (
  SELECT r, p * 1000 + i AS s, md5(substr(x, 2 * i + 1, {2 * WINDOW})) AS w FROM (SELECT r, p, x, unnest(range(least(1000, n - p * 1000 - {WINDOW - 1}))) AS i FROM parts)
),
again AS (SELECT r, s FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
runs AS (
  SELECT r, min(s) AS lo, max(s) + {WINDOW} AS hi FROM (
    SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM (
      SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + {WINDOW} THEN 0 ELSE 1 END AS new FROM again)
  ) GROUP BY r, g
),
spans AS (SELECT r, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM runs GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(n_spans + 1),
         lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE his[i] END) + 1,
                          2 * ((CASE WHEN i = n_spans THEN len(h) // 2 ELSE los[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE his[i] END)))), '') END)) AS kept_sha256
FROM b LEFT JOIN spans USING (r)
"""
