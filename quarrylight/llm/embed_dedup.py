"""Embedding near-dedup by NN-descent.

1. Equal vectors are one node.  A neighbour graph is seeded from random-hyperplane trees: nodes in
   the same leaf are compared and keep their nearest K.
2. NN-descent: each node's neighbours and those it is a neighbour of are compared with each other
   and lists take what is nearer, until few entries change.  Leaves and neighbourhoods above PIECE
   nodes are compared in pieces of that size.
3. The list of a node that is saturated (half of it or more are links) is enlarged, not step by step,
   which would send each neighbourhood's vectors again for every member, but at once to all saturated
   nodes in reach: these are gathered around pivots, at half the link angle at most, and since angles
   obey the triangle inequality, links between the nodes of two pivots need pivots within their radii
   plus the link angle.  Pivots, far fewer than nodes, are compared with all pivots; their nodes are
   compared in blocks, which count links and join components, and nothing is written out per pair.
   Links to nodes that aren't saturated stand in the lists of those.  Every node of a leaf or
   neighbourhood that was cut into pieces and isn't saturated, however few its links, is compared with
   all nodes.
4. Recall is audited against brute force, as a mean over nodes, so that a large group doesn't speak for
   small ones, and again over those that were not completed; below TARGET more trees are grown and the
   descent goes on.  The audit takes more nodes until MEASURED of them have links, up to MOST_AUDITED.
   Where links are too rare for that, planted pairs speak for them: to some nodes a vector is made at just
   the link angle, and the share of these pairs, the hardest there are, that share a leaf of any tree is the
   recall (the descent only adds to it); trees are grown until it reaches TARGET.  When rounds run out below
   TARGET, all nodes that are not complete yet are compared with all others.  ``report`` says what was measured.

Links are decided in double precision.  Vectors travel as they came (four or eight bytes a component).

Defined results
---------------
* A vector that is null, empty, zero, or holds a null or non-finite component links with nothing, as
  do rows with a null id.  Vectors of different lengths don't link.
* Each input row gives one row.  Of several vectors with one id the one with the smallest bytes counts.
* n_links counts other ids, equal vectors included.  An empty table gives an empty result.
* Ids are whole numbers of any width; others raise an error.  Only the two named columns are read, so
  further columns may have any names.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import components
from .scratch import Scratch

log = logging.getLogger(__name__)

K, TREES, LEAF = 10, 24, 48
#: A list counts as saturated from so many links on, its own and those of others to it.
SATURATED = K // 2
#: Entries that a comparison of a leaf or neighbourhood adds to each list; links are added up to K.
KEEP = 3
#: Nodes of a piece of a leaf or neighbourhood; nodes of a block and of a part of a region; pivots in hand at once.
PIECE, BLOCK, PART, PIVOTS = 1024, 512, 2048, 4096
#: NN-descent ends when less than this share of entries is new, or after so many turns.
SETTLED, TURNS = 0.01, 3
TARGET, ROUNDS = 0.995, 4
#: Rounds of trees where planted pairs decide: enough for 2**22 leaves.
PLANTED_ROUNDS = 8
#: Nodes that are audited at first and at most (and bytes of their vectors, which are broadcast), and how many of them have to have links.
AUDIT, MOST_AUDITED, MOST_BYTES, MEASURED = 2048, 32768, 64 << 20, 50
#: Turns in which pivots are looked for, and new pivots of a component in the first turn; twice as many in each next one, up to eight times.
PIVOT_TURNS, PICKS = 8, 8


def _unit(raw: pa.Array, kind: str) -> np.ndarray:
    """Rows of unit vectors in double precision; all of one length."""
    x = np.frombuffer(b"".join(raw.to_pylist()), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys, across batches; a run is at most a piece."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        rows = list(zip(*(b.column(b.schema.names.index(k)).to_pylist() for k in keys)))
        lo = 0
        for i in range(len(rows) + 1):
            if i == len(rows) or rows[i] != rows[lo]:
                if rows and rows[lo] != last and held:
                    yield last, pa.Table.from_batches(held)
                    held = []
                if rows:
                    last = rows[lo]
                    held.append(b.slice(lo, i - lo))
                lo = i
    if held:
        yield last, pa.Table.from_batches(held)


def _near(pieces: DataFrame, keys: list[str], kind: str, threshold: float) -> DataFrame:
    """u, v, cos: for each row of a piece (id, raw, grouped by keys) its KEEP nearest in the piece, and its links among the K nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, c = [], [], []

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(x) if x else np.zeros(0) for x in (u, v, c)]
            for x in (u, v, c):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2])], ["u", "v", "cos"])

        for n, (_, t) in enumerate(_groups(batches, keys)):
            if t.num_rows < 2:
                continue
            ids = t.column("id").to_numpy()
            x = _unit(t.column("raw").combine_chunks(), kind)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            k = min(K, len(ids) - 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            cos = np.take_along_axis(s, top, 1)
            order = np.argsort(-cos, axis=1)
            top, cos = np.take_along_axis(top, order, 1), np.take_along_axis(cos, order, 1)
            r, j = np.nonzero((np.arange(k) < KEEP)[None] | (cos >= threshold))
            u.append(ids[r])
            v.append(ids[top[r, j]])
            c.append(cos[r, j])
            if n % 2000 == 1999:
                yield out()
        yield out()

    dealt = pieces.select(*keys, "id", "raw").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u bigint, v bigint, cos double")


def _in_pieces(members: DataFrame, keys: list[str], nodes: DataFrame, kind: str, threshold: float, scratch: Scratch, name: str, cuts: list) -> DataFrame:
    """Compares (keys, id) groups, those above PIECE rows in random pieces; ``cuts`` gets a table of the latter's members (id)."""
    sizes = members.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"), F.count(F.lit(1)).alias("n")).where("n > 1")
    cuts.append(scratch.keep(f"{name}-cut", members.join(sizes.where("pieces > 1"), keys, "left_semi").select("id").distinct()))
    cut = members.join(sizes.drop("n"), keys).withColumn("piece", F.expr("cast(pmod(xxhash64(id), pieces) as int)"))
    return _near(cut.join(nodes.select("id", "raw"), "id"), [*keys, "piece"], kind, threshold)


def _best(entries: DataFrame) -> DataFrame:
    """The K nearest of each node."""
    once = entries.where("u <> v").groupBy("u", "v").agg(F.max("cos").alias("cos"))
    nearest = Window.partitionBy("u").orderBy(F.desc("cos"), "v")
    return once.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= K).drop("r")


def _tree_codes(nodes: DataFrame, bits: int, first_tree: int, kind: str) -> DataFrame:
    """tree, dim, code, id: the leaf of each node in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            raw, ids = b.column("raw"), b.column("id").to_numpy(zero_copy_only=False)
            size = np.array([len(r) for r in raw.to_pylist()])
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                x = _unit(raw.take(pa.array(own)), kind)
                p = planes.setdefault(int(s), np.random.default_rng(first_tree).standard_normal((x.shape[1], TREES * bits)))
                sign = (x @ p > 0).reshape(len(own), TREES, bits)
                code = (sign * (1 << np.arange(bits, dtype=np.int64))).sum(2)
                n = len(own) * TREES
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(own))), pa.array(np.full(n, s, np.int32)),
                        pa.array(code.ravel()), pa.array(np.repeat(ids[own], TREES)),
                    ],
                    ["tree", "dim", "code", "id"],
                )

    return nodes.select("id", "raw").mapInArrow(run, "tree int, dim int, code bigint, id bigint")


def _descend(graph: DataFrame, nodes: DataFrame, kind: str, threshold: float, scratch: Scratch, name: str, cuts: list) -> DataFrame:
    total = graph.count()
    for turn in range(TURNS):
        ends = graph.select(F.col("u").alias("c"), F.col("v").alias("id")).unionByName(graph.select(F.col("v").alias("c"), F.col("u").alias("id")))
        ends = ends.unionByName(nodes.select(F.col("id").alias("c"), "id")).distinct()
        dims = nodes.select(F.col("id").alias("nid"), F.length("raw").alias("dim"))
        ends = scratch.keep(f"{name}-ends-{turn}", ends.join(dims, F.col("id") == F.col("nid")).drop("nid"))
        further = _in_pieces(ends, ["c", "dim"], nodes, kind, threshold, scratch, f"{name}-{turn}", cuts)
        better = scratch.keep(f"{name}-{turn}", _best(graph.unionByName(further)))
        scratch.drop(f"{name}-ends-{turn}")
        new = better.join(graph.select("u", "v"), ["u", "v"], "left_anti").count()
        graph = better
        if new <= SETTLED * total:
            break
    return graph


def _pivots(saturated: DataFrame, nodes: DataFrame, angle: float, kind: str, scratch: Scratch, name: str) -> DataFrame:
    """pivot, x, angle: each saturated node with a pivot within ``angle`` of it; after PIVOT_TURNS the others are pivots themselves."""
    left, turn = saturated, 0
    found = nodes.sparkSession.createDataFrame([], "pivot bigint, x bigint, angle double")
    while turn < PIVOT_TURNS and not left.isEmpty():
        size = left.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
        picks = PICKS << min(turn, 3)
        pick = left.join(size, "root").where(F.expr(f"id = least or pmod(xxhash64(id, {turn}), greatest(n div {picks}, 1)) = 0"))
        pick = pick.select("root", F.col("id").alias("pivot")).join(nodes.select(F.col("id").alias("pivot"), F.col("raw").alias("praw")), "pivot")
        both = left.join(pick, "root").join(nodes.select("id", "raw"), "id").where("length(raw) = length(praw)")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                size = np.array([len(r) for r in b.column("raw").to_pylist()])
                out = np.zeros(len(size))
                for s in np.unique(size):
                    own = np.flatnonzero(size == s)
                    take = pa.array(own)
                    dot = (_unit(b.column("raw").take(take), kind) * _unit(b.column("praw").take(take), kind)).sum(1)
                    out[own] = np.arccos(np.clip(dot, -1, 1))
                yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("id"), pa.array(out)], ["pivot", "x", "angle"])

        at = both.select("pivot", "id", "raw", "praw").mapInArrow(near, "pivot bigint, x bigint, angle double").where(F.col("angle") <= angle)
        at = at.groupBy("x").agg(F.min(F.struct("angle", "pivot")).alias("b")).select("b.pivot", "x", "b.angle")
        at = scratch.keep(f"{name}-pivots-{turn}", at)
        found = found.unionByName(at)
        left = scratch.keep(f"{name}-left-{turn}", left.join(at.select(F.col("x").alias("id")), "id", "left_anti"))
        turn += 1
    return found.unionByName(left.select(F.col("id").alias("pivot"), F.col("id").alias("x"), F.lit(0.0).alias("angle")))


def _either(links: DataFrame) -> DataFrame:
    """u, v: links in both directions, once."""
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _complete(graph: DataFrame, nodes: DataFrame, threshold: float, kind: str, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(x, n): the links of each saturated node to other saturated nodes, counted; (x, y): links that join their components."""
    spark = graph.sparkSession
    links = graph.where(F.col("cos") >= threshold)
    full = _either(links).groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SATURATED).select(F.col("u").alias("id"))
    full = scratch.keep(f"{name}-full", full)
    if full.isEmpty():
        return spark.createDataFrame([], "x bigint, n bigint"), spark.createDataFrame([], "x bigint, y bigint")
    roots = components(links.select(F.col("u").alias("x"), F.col("v").alias("y")), scratch, f"{name}-links")
    saturated = full.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))
    reach = math.acos(threshold) + 1e-6
    near = scratch.keep(f"{name}-near", _pivots(scratch.keep(f"{name}-saturated", saturated), nodes, reach / 2, kind, scratch, name))
    radius = near.groupBy("pivot").agg(F.max("angle").alias("radius"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    radius = radius.join(nodes.select(F.col("id").alias("pivot"), "raw"), "pivot")
    radius = scratch.keep(f"{name}-radius", radius)
    pairs: list[DataFrame] = []
    chunk: list = []

    def beside(pivots: list) -> tuple[DataFrame, Broadcast]:
        """pivot, other: for some pivots, a number of bounded size, all pivots whose nodes may be linked to theirs."""
        by_size: dict[int, list] = {}
        for r in pivots:
            by_size.setdefault(len(r["raw"]), []).append(r)
        packed = {
            s: (np.array([r["pivot"] for r in rows]), _unit(pa.array([bytes(r["raw"]) for r in rows]), kind), np.array([r["radius"] + reach for r in rows]))
            for s, rows in by_size.items()
        }
        sent = spark.sparkContext.broadcast(packed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                size = np.array([len(r) for r in b.column("raw").to_pylist()])
                own_radius = b.column("radius").to_numpy()
                for s in np.unique(size):
                    if s not in sent.value:
                        continue
                    own = np.flatnonzero(size == s)
                    ids, x, most = sent.value[s]
                    for lo in range(0, len(own), 1024):
                        some = own[lo : lo + 1024]
                        angle = np.arccos(np.clip(_unit(b.column("raw").take(pa.array(some)), kind) @ x.T, -1, 1))
                        r, c = np.nonzero(angle <= most[None] + own_radius[some][:, None])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[c]), b.column("pivot").take(pa.array(some[r]))], ["pivot", "other"])

        return radius.select("pivot", "radius", "raw").mapInArrow(run, "pivot bigint, other bigint"), sent

    def write() -> None:
        df, sent = beside(chunk)
        pairs.append(scratch.keep(f"{name}-beside-{len(pairs)}", df))
        sent.unpersist()
        chunk.clear()

    for r in radius.select("pivot", "radius", "raw").toLocalIterator():
        chunk.append(r)
        if len(chunk) == PIVOTS:
            write()
    if chunk:
        write()
    paths = [f"{scratch.path}/{name}-beside-{i}" for i in range(len(pairs))]
    adjacent = spark.read.schema("pivot bigint, other bigint").parquet(*paths)
    own = near.select("pivot", F.col("x").alias("id")).join(nodes.select("id", "raw", "mult"), "id")
    own = scratch.keep(f"{name}-own", own)
    region = adjacent.join(own.withColumnRenamed("pivot", "other"), "other").drop("other")

    held = near.groupBy(F.col("pivot").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    parts = adjacent.join(held, "other").groupBy("pivot").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    blocks = scratch.keep(f"{name}-blocks", radius.select("pivot", "blocks").join(parts, "pivot"))
    heads = own.join(blocks, "pivot")
    block, part = F.expr("cast(pmod(xxhash64(id), blocks) as int)"), F.expr("cast(pmod(xxhash64(id, 1), parts) as int)")
    heads = heads.select("*", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), block.alias("b"), F.lit(0).alias("kind"))
    rest = region.join(blocks, "pivot").select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("b"), part.alias("part"), F.lit(1).alias("kind"))
    columns = ["pivot", F.concat_ws(":", "b", "part").alias("blk"), "kind", "id", "raw", "mult"]
    both = heads.select(*columns).unionByName(rest.select(*columns))
    dealt = both.repartition("pivot", "blk").sortWithinPartitions("pivot", "blk", "kind")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """x, y, n: counts have no y, links no n."""
        state: dict = {"key": None}

        def end() -> list[tuple]:
            if state["key"] is None or not len(state["ids"]):
                return []
            ids, label = state["ids"], state["label"]
            return [(int(i), None, int(n)) for i, n in zip(ids, state["n"])] + [(int(i), int(ids[l]), None) for i, l in zip(ids, label) if ids[l] != i]

        def more(t: pa.RecordBatch) -> list[tuple]:
            out = []
            y, mult = t.column("id").to_numpy(), t.column("mult").to_numpy()
            for lo in range(0, len(y), 1024):
                part = slice(lo, lo + 1024)
                hit = state["x"] @ _unit(t.column("raw").slice(lo, 1024), kind).T >= threshold
                hit &= state["ids"][:, None] != y[None, part]
                state["n"] += hit @ mult[part]
                for j in np.flatnonzero(hit.any(0)):
                    own = np.flatnonzero(hit[:, j])
                    label = state["label"]
                    seen = np.unique(label[own])
                    if len(seen) > 1:
                        label[np.isin(label, seen)] = seen[0]
                    out.append((int(y[lo + j]), int(state["ids"][own[0]]), None))
            return out

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            x, y, n = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (x, y, n)], ["x", "y", "n"])

        for b in batches:
            rows = []
            key = list(zip(b.column("pivot").to_pylist(), b.column("blk").to_pylist(), b.column("kind").to_pylist()))
            lo = 0
            for i in range(1, len(key) + 1):
                if i < len(key) and key[i] == key[lo]:
                    continue
                t, (p, blk, which) = b.slice(lo, i - lo), key[lo]
                lo = i
                if state["key"] != (p, blk):
                    rows += end()
                    state = {"key": (p, blk), "ids": np.zeros(0, np.int64), "x": None}
                if which == 0:
                    x = _unit(t.column("raw"), kind)
                    state["x"] = x if state["x"] is None else np.concatenate([state["x"], x])
                    state["ids"] = np.concatenate([state["ids"], t.column("id").to_numpy()])
                    state["label"], state["n"] = np.arange(len(state["ids"])), np.zeros(len(state["ids"]), np.int64)
                elif len(state["ids"]):
                    rows += more(t)
            yield batch(rows)
        yield batch(end())

    both = scratch.keep(f"{name}-counted", dealt.mapInArrow(count, "x bigint, y bigint, n bigint"))
    counts = both.where("n is not null").groupBy("x").agg(F.sum("n").alias("n"))
    return counts, both.where("n is null").select("x", "y")


def _sweep(targets: DataFrame, nodes: DataFrame, threshold: float, kind: str, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Compares some nodes (id) with all: (x, n), all links of each, counted, and (x, y), the links."""
    chunk: list = []
    sends: list = []

    def against(rows: list) -> DataFrame:
        """x, y, n for some nodes, a number of bounded size: counts have no y, links no n."""
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r["raw"]), []).append(r)
        packed = {s: (np.array([r["id"] for r in own]), _unit(pa.array([bytes(r["raw"]) for r in own]), kind)) for s, own in by_size.items()}
        sent = nodes.sparkSession.sparkContext.broadcast(packed)
        sends.append(sent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = {s: np.zeros(len(ids), np.int64) for s, (ids, _) in sent.value.items()}

            for b in batches:
                size = np.array([len(r) for r in b.column("raw").to_pylist()])
                for s in np.unique(size):
                    if s not in sent.value:
                        continue
                    own = np.flatnonzero(size == s)
                    ids, x = sent.value[s]
                    for lo in range(0, len(own), 1024):
                        t = b.take(pa.array(own[lo : lo + 1024]))
                        y = t.column("id").to_numpy()
                        hit = x @ _unit(t.column("raw"), kind).T >= threshold
                        hit &= ids[:, None] != y[None]
                        n[s] += hit @ t.column("mult").to_numpy()
                        i, j = np.nonzero(hit)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(y[j]), pa.nulls(len(i), pa.int64())], ["x", "y", "n"])
            for s, (ids, _) in sent.value.items():
                own = np.flatnonzero(n[s])
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.nulls(len(own), pa.int64()), pa.array(n[s][own])], ["x", "y", "n"])

        return nodes.select("id", "raw", "mult").mapInArrow(run, "x bigint, y bigint, n bigint")

    parts: list[DataFrame] = []

    def write() -> None:
        parts.append(scratch.keep(f"{name}-{len(parts)}", against(chunk)))
        sends.pop().unpersist()
        chunk.clear()

    for r in nodes.join(targets.select("id").distinct(), "id", "left_semi").select("id", "raw").toLocalIterator():
        chunk.append(r)
        if len(chunk) == PIVOTS:
            write()
    if chunk:
        write()
    schema = "x bigint, y bigint, n bigint"
    paths = [f"{scratch.path}/{name}-{i}" for i in range(len(parts))]
    both = nodes.sparkSession.read.schema(schema).parquet(*paths) if paths else nodes.sparkSession.createDataFrame([], schema)
    counts = both.where("n is not null").groupBy("x").agg(F.sum("n").alias("n"))
    # nodes without links are complete too
    counts = targets.select("id").distinct().join(counts, F.col("id") == F.col("x"), "left").select(F.col("id").alias("x"), F.coalesce("n", F.lit(0)).alias("n"))
    return scratch.keep(f"{name}-counts", counts), both.where("n is null").select("x", "y")


def _recall(nodes: DataFrame, found: DataFrame, counted: DataFrame, threshold: float, kind: str, report: dict) -> float | None:
    """Share of its links found for a node, against brute force: the mean over audited nodes, or over those of them not counted in full (x), if less.

    None where too few nodes have links to say.  ``report`` gets it and the numbers of nodes that were audited and that have links.
    """
    row = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("raw")).alias("bytes")).first()
    size, total = AUDIT, row["n"]
    most = min(total, max(AUDIT, min(MOST_AUDITED, MOST_BYTES // (2 * row["bytes"]))))
    while True:
        shares = _shares(nodes, found, counted, threshold, kind, size)
        if len(shares) >= MEASURED or size >= most:
            break
        size = min(4 * size, most)
    means = [float(np.mean(x)) for x in ([s for s, _ in shares], [s for s, whole in shares if not whole]) if x]
    known = len(shares) >= MEASURED or size >= total
    recall = min(means, default=1.0) if known else None
    report |= {"recall": recall, "audited": min(size, total), "with_links": len(shares)}
    return recall


def _plants(nodes: DataFrame, threshold: float, kind: str) -> DataFrame:
    """id, raw of AUDIT pairs at most: a node's vector, and one at the link angle from it in any direction, with ids 2 k and 2 k + 1."""
    most = nodes.agg(F.max(F.length("raw"))).first()[0]
    rows = nodes.select("raw").orderBy(F.xxhash64("id", F.lit(131))).limit(max(1, min(AUDIT, MOST_BYTES // (4 * most)))).collect()
    rng = np.random.default_rng(17)
    out = []
    for i, r in enumerate(rows):
        x = _unit(pa.array([bytes(r["raw"])]), kind)[0]
        d = rng.standard_normal(len(x))
        d -= (d @ x) * x
        away = np.linalg.norm(d)
        y = threshold * x + math.sqrt(1 - threshold**2) * d / away if away > 1e-9 else x  # in one dimension there is no other direction
        out += [(2 * i, x.astype(kind).tobytes()), (2 * i + 1, y.astype(kind).tobytes())]
    return nodes.sparkSession.createDataFrame([(i, bytearray(raw)) for i, raw in out], "id long, raw binary")


def _met(plants: DataFrame, bits: int, first_tree: int, kind: str) -> set[int]:
    """The planted pairs that share a leaf of one of a round's trees."""
    codes = _tree_codes(plants, bits, first_tree, kind).withColumn("pair", F.expr("id div 2"))
    both = codes.groupBy("pair", "tree", "dim", "code").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return {r[0] for r in both.select("pair").distinct().collect()}


def _shares(nodes: DataFrame, found: DataFrame, counted: DataFrame, threshold: float, kind: str, size: int) -> list[tuple[float, bool]]:
    """For the audited nodes with links: the share that was found, and whether the node was counted in full."""
    picked = nodes.join(found, F.col("id") == F.col("rep"), "left").join(counted.select("x"), F.col("id") == F.col("x"), "left")
    picked = picked.select("id", "raw", F.coalesce("links", F.lit(0)).alias("links"), F.col("x").isNotNull().alias("whole"))
    rows = picked.orderBy(F.xxhash64("id", F.lit(97))).limit(size).collect()
    packed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for s in {len(r["raw"]) for r in rows}:
        own = [r for r in rows if len(r["raw"]) == s]
        packed[s] = np.array([r["id"] for r in own]), _unit(pa.array([bytes(r["raw"]) for r in own]), kind)
    sent = nodes.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for b in batches:
            size = np.array([len(r) for r in b.column("raw").to_pylist()])
            for s in np.unique(size):
                if s in sent.value:
                    own = np.flatnonzero(size == s)
                    ids, x = sent.value[s]
                    for lo in range(0, len(own), 256):
                        take = pa.array(own[lo : lo + 256])
                        hit = x @ _unit(b.column("raw").take(take), kind).T >= threshold
                        hit &= ids[:, None] != b.column("id").take(take).to_numpy()[None]
                        for i, n in zip(ids.tolist(), (hit @ b.column("mult").take(take).to_numpy()).tolist()):
                            sums[i] = sums.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["id", "n"])

    truth = {r["id"]: r["n"] for r in nodes.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    sent.unpersist()
    return [(min(truth[r["id"]], r["links"]) / truth[r["id"]], r["whole"]) for r in rows if truth.get(r["id"])]


def link_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, report: dict | None = None
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.  ``report`` gets the figures of the last audit and the number of rounds."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    if not isinstance(id_type, T.IntegralType):
        raise TypeError(f"ids are {id_type.simpleString()}, not whole numbers")
    report = {} if report is None else report
    scratch = Scratch(spark, "vectors")
    element = df.schema[vec_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    vec = F.col(f"`{vec_col}`")
    numeric = vec if kind == "<f4" else vec.cast("array<double>")
    sound = vec.isNotNull() & F.forall(numeric, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(numeric, lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.when(F.coalesce(sound, F.lit(False)), numeric).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            at = np.concatenate([[0], np.cumsum(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([flat[a:z].tobytes() for a, z in zip(at, at[1:])], pa.binary())], ["id", "raw"])

    own = rows.where("v is not null and id is not null").mapInArrow(pack, "id bigint, raw binary")
    vectors = scratch.keep("vectors", own.groupBy("id").agg(F.min("raw").alias("raw")))
    nodes = scratch.keep("nodes", vectors.groupBy("raw").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mult")).select("id", "raw", "mult"))
    total = nodes.count()
    bits = max(1, math.ceil(math.log2(max(total, 1) / LEAF))) if total > LEAF else 1
    graph = spark.createDataFrame([], "u bigint, v bigint, cos double")
    result = spark.createDataFrame([], "rep bigint, links bigint")
    edges = swept_links = spark.createDataFrame([], "x bigint, y bigint")
    counts = swept = spark.createDataFrame([], "x bigint, n bigint")
    joins = edges

    def combine(name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """rep, links of each node with links; (x, y), links that join all components; (x), the nodes whose links were all counted."""
        links = graph.where(F.col("cos") >= threshold).select("u", "v").unionByName(swept_links.select(F.col("x").alias("u"), F.col("y").alias("v")))
        edges = scratch.keep(f"{name}-edges", links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(joins))
        inner = counts.join(swept.select("x"), "x", "left_anti")  # counted against other saturated nodes only
        both = _either(links).join(swept.select(F.col("x").alias("u")), "u", "left_anti")
        kinds = counts.select(F.col("x").alias("s"))
        both = both.join(kinds.withColumnRenamed("s", "us"), F.col("u") == F.col("us"), "left").join(kinds.withColumnRenamed("s", "vs"), F.col("v") == F.col("vs"), "left")
        both = both.where("us is null or vs is null")  # links between saturated nodes are counted already
        listed = both.join(nodes.select(F.col("id").alias("v"), "mult"), "v").select(F.col("u").alias("rep"), F.col("mult").alias("links"))
        every = listed.unionByName(inner.select(F.col("x").alias("rep"), F.col("n").alias("links")))
        every = every.groupBy("rep").agg(F.sum("links").alias("links"))
        every = every.unionByName(swept.select(F.col("x").alias("rep"), F.col("n").alias("links")))
        return scratch.keep(f"{name}-result", every), edges, inner.select("x").unionByName(swept.select("x"))

    plants, met, turn, recall = None, set(), 0, 0.0
    while total > 1 and recall < TARGET and turn < (ROUNDS if plants is None else PLANTED_ROUNDS):
        name = f"round-{turn}"
        cuts: list[DataFrame] = []
        codes = scratch.keep(f"{name}-codes", _tree_codes(nodes, bits, 1000 + turn, kind))
        seeds = _in_pieces(codes, ["tree", "dim", "code"], nodes, kind, threshold, scratch, f"{name}-leaves", cuts)
        graph = scratch.keep(f"{name}-seeds", _best(graph.unionByName(seeds)))
        scratch.drop(f"{name}-codes")
        graph = _descend(graph, nodes, kind, threshold, scratch, name, cuts)
        counts, joins = _complete(graph, nodes, threshold, kind, scratch, name)
        done = counts.select(F.col("x").alias("id")).unionByName(swept.select(F.col("x").alias("id")))
        targets = cuts[0]
        for c in cuts[1:]:
            targets = targets.unionByName(c)
        targets = scratch.keep(f"{name}-targets", targets.distinct().join(done, "id", "left_anti"))
        if not targets.isEmpty():
            more, found = _sweep(targets, nodes, threshold, kind, scratch, f"{name}-sweep")
            swept, swept_links = swept.unionByName(more), swept_links.unionByName(found)
        result, edges, counted = combine(name)
        recall = _recall(nodes, result, counted, threshold, kind, report) if plants is None else None
        if recall is None:
            grown = range(turn + 1) if plants is None else [turn]
            plants = _plants(nodes, threshold, kind).persist() if plants is None else plants
            for t in grown:
                met |= _met(plants, bits, 1000 + t, kind)
            recall = len(met) / (plants.count() // 2)
        turn += 1
        report |= {"recall": recall, "planted": plants is not None, "rounds": turn, "swept": False}
        log.info("NN-descent: %s", report)
    if total > 1:
        if plants is not None:
            plants.unpersist()
        if recall < TARGET:
            report["swept"] = True
            done = counts.select(F.col("x").alias("id")).unionByName(swept.select(F.col("x").alias("id")))
            more, found = _sweep(nodes.join(done, "id", "left_anti"), nodes, threshold, kind, scratch, "rest")
            swept, swept_links = swept.unionByName(more), swept_links.unionByName(found)
            result, edges, _ = combine("rest")
    roots = components(edges, scratch, "all")
    of_node = nodes.join(result, F.col("id") == F.col("rep"), "left").join(roots, F.col("id") == F.col("node"), "left")
    of_node = of_node.select(F.col("raw").alias("node_raw"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "id").alias("component"))
    of_node = scratch.keep("of-node", of_node)
    mine = scratch.keep("mine", vectors.join(of_node.hint("merge"), F.col("raw") == F.col("node_raw")).select(F.col("id").alias("vid"), "n_links", "component"))
    out = rows.select("id").join(mine.hint("merge"), F.col("id") == F.col("vid"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").cast(id_type).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.cast(id_type).alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 END
),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT y, c FROM reach JOIN links ON x = vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id) LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) USING (vec_id)
"""
