"""MinHash near-dedup: banded candidates, checked by odd sketches and then on the full sets.

1. Each text becomes its set of word shingles, of which only MinHash samples stay: the first of
   them give band keys, as many as the threshold needs; all of them are folded into an odd sketch,
   a bitmap in which each sample flips one bit.  Equal sets are one node from here on.
2. Nodes with an equal band key are candidates.  In each bucket all are compared to its smallest
   node, which costs one comparison a member, and what is linked becomes components.
3. Buckets that still hold several components are finished: members outside the bucket's largest
   component, in blocks of bounded size, are compared to all members of other components, in parts
   of bounded size.  Blocks and parts of one bucket go to different tasks, and pairs are compared
   where they meet, not written out.
4. A comparison looks at the sketches first: the XOR of two odd sketches counts the samples that
   differ, which estimates high similarities closely.  Pairs whose estimate is six standard
   deviations below the threshold are passed over; all others are decided on the full sets, whose
   shingles are known by names of 128 bits.

A pair with the threshold's similarity shares a band with probability 1 - 1e-5 at least (at 0.85
20 bands of 5 rows, at 0.8 29 of 5), a more similar one with more.

Defined results
---------------
* A-Z count as a-z.  Words are parted by blanks and the control characters from tab to carriage return.
* A text with fewer words than a shingle is one shingle; without words, or null, it has none,
  is linked with nothing and stays.
* Rows with a null id are linked with nothing and stay.  Repeated rows get the same result;
  an id with several texts is judged row by row.
* Only the two named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles, wordhash
from .components import components
from .scratch import Scratch, without

#: Samples of a band at most, and the greatest probability that a pair at the threshold shares no band.
ROWS, MISS = 5, 1e-5
#: Members compared to one node or block at a time, and nodes of a block, on average.
CHUNK, BLOCK = 512, 128
#: Ids of candidates, and pairs without their sets, are broadcast up to so many (some 30 MB); beyond it Spark sorts and merges.
BROADCAST_IDS = 250_000
#: Standard deviations between the threshold and the least estimate that is looked into.
MARGIN = 6.0


def band_shape(percent: int) -> tuple[int, int]:
    """Number of bands and their rows, which are fewer where the samples don't suffice."""
    for rows in range(ROWS, 0, -1):
        agree = (percent / 100) ** rows
        n = 1 if agree >= 1 else math.ceil(math.log(MISS) / math.log1p(-agree))
        if n * rows <= shingles.N_SAMPLES:
            return n, rows
    raise ValueError(f"{shingles.N_SAMPLES} samples don't find pairs with a similarity of {percent} %")


def sketch_limit(percent: int) -> int:
    """The most bits that two odd sketches may differ in."""
    k, n, j = shingles.N_SAMPLES, shingles.SKETCH_BITS, percent / 100
    differ = 2 * k * (1 - j)
    mean = n / 2 * (1 - math.exp(-2 * differ / n))
    by_samples = 2 * math.sqrt(k * j * (1 - j)) * math.exp(-2 * differ / n)
    by_bits = math.sqrt(n / 4 * (1 - math.exp(-4 * differ / n)) - differ * math.exp(-4 * differ / n))
    return math.ceil(mean + MARGIN * math.hypot(by_samples, by_bits))


def signatures(docs: DataFrame, shingle: int, percent: int, with_sets: bool) -> DataFrame:
    """From id, text: id, n (size of the set), f1, f2 (its name), keys (of bands), sketch, and shingles if asked for."""
    n_bands, n_rows = band_shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wordhash.sparing(batches):
            ids = b.column("id")
            for w in wordhash.words(b.column("text"), lower=True):
                h, g, at = shingles.shingle_sets(w, shingle)
                s = shingles.samples(h, at)
                f1, f2 = shingles.fingerprint(h, g, at)
                keys = shingles.bands(s, n_bands, n_rows).view(np.int64).ravel()
                rows = len(at) - 1
                cols = {
                    "id": ids.slice(w.first_row, rows),
                    "n": pa.array(np.diff(at).astype(np.int64)),
                    "f1": pa.array(f1.view(np.int64)),
                    "f2": pa.array(f2.view(np.int64)),
                    "keys": pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n_bands), pa.array(keys)),
                    "sketch": pa.array([x.tobytes() for x in shingles.odd_sketch(s)], pa.binary()),
                }
                if with_sets:
                    cols["shingles"] = pa.array([h[a:z].tobytes() + g[a:z].tobytes() for a, z in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n bigint, f1 bigint, f2 bigint, keys array<bigint>, sketch binary"
    return docs.mapInArrow(run, schema + ", shingles binary" * with_sets)


class _Block:
    """The nodes that members of a group are compared to."""

    def __init__(self) -> None:
        self.ids, self.comps, self.sizes, self.sketches, self.keys, self.sets = [], [], [], [], [], []
        self.root: dict = {}

    def find(self, c):
        while (up := self.root.get(c, c)) != c:
            c = up
        return c

    def add(self, r: dict) -> None:
        self.ids.append(r["id"])
        self.comps.append(r["comp"])
        self.sets.append(_lanes(r["shingles"]))
        self.sizes.append(self.sets[-1].shape[1])
        self.sketches.append(np.frombuffer(r["sketch"], np.uint64))
        self.keys.append(r["keys"])

    def links(self, r: dict, percent: int, limit: int) -> Iterator[tuple]:
        """Links of a member to nodes of the block that aren't in its component yet."""
        if isinstance(self.sizes, list):
            self.sizes, self.sketches, self.keys = np.array(self.sizes), np.array(self.sketches), np.array(self.keys)
        own = _lanes(r["shingles"])
        size = own.shape[1]
        low, high = np.minimum(self.sizes, size), np.maximum(self.sizes, size)
        maybe = np.flatnonzero(100 * low >= percent * high)
        if not len(maybe):
            return
        differ = np.bitwise_count(self.sketches[maybe] ^ np.frombuffer(r["sketch"], np.uint64)).sum(1)
        maybe = maybe[differ <= limit]
        if r["band"] >= 0 and len(maybe):  # only in the first bucket that the two share
            maybe = maybe[(self.keys[maybe] == np.array(r["keys"])).argmax(1) == r["band"]]
        for i in maybe:
            if self.ids[i] == r["id"] or (r["twice"] and r["id"] > self.ids[i]):
                continue
            a, b = self.find(self.comps[i]), self.find(r["comp"])
            if a == b:
                continue
            both = _shared(own, self.sets[i])
            if 100 * both >= percent * (size + self.sizes[i] - both):
                self.root[max(a, b)] = min(a, b)
                yield self.comps[i], r["comp"]


def _lanes(raw: bytes) -> np.ndarray:
    """A set of names of 128 bits: a row for each lane, sorted by the first."""
    return np.frombuffer(raw, np.uint64).reshape(2, -1)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many names two sets share."""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    if not a.shape[1]:
        return 0
    at = np.searchsorted(b[0], a[0])
    at[at == b.shape[1]] = b.shape[1] - 1
    return int((b[:, at] == a).all(0).sum())


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links (x, y), as components, in rows of groups: first a block's nodes (kind 0), then members (kind 1)."""
    limit = sketch_limit(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block = None, _Block()
        for b in batches:
            out = []
            for lo in range(0, b.num_rows, 256):
                for r in b.slice(lo, 256).to_pylist():
                    if (g := (r["grp"], r["blk"])) != group:
                        group, block = g, _Block()
                    if r["kind"] == 0:
                        block.add(r)
                    elif block.ids:
                        out += block.links(r, percent, limit)
            x, y = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, id_type), pa.array(y, id_type)], ["x", "y"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    kind = rows.schema["id"].dataType.simpleString()
    columns = ["grp", "blk", "kind", "id", "comp", "band", "twice", "keys", "sketch", "shingles"]
    dealt = rows.select(*columns).repartition("grp", "blk").sortWithinPartitions("grp", "blk", "kind")
    return dealt.mapInArrow(run, f"x {kind}, y {kind}")


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of a comparison with the sets of their ids; sets, which are wide, don't move while the rows can be sent to them."""
    return sets.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, "id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.  Links need ``percent`` of Jaccard similarity."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sigs = scratch.keep("signatures", signatures(texts, shingle, percent, False))
    same = ["f1", "f2", "n"]
    nodes = sigs.where("n > 0 and id is not null").groupBy(*same).agg(F.min(F.struct("id", "keys")).alias("v"))
    nodes = scratch.keep("nodes", nodes.select(*same, "v.*"))

    in_band = nodes.select("id", F.posexplode("keys").alias("band", "key"))
    shared = in_band.groupBy("band", "key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = scratch.keep("shared", shared)  # so that both sides of the join are exchanges, which Spark splits where they are skewed
    members = scratch.keep("members", in_band.join(shared.drop("c").hint("merge"), ["band", "key"]))
    ids = scratch.keep("ids", members.select("id").distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    wanted = texts.join(ids, "id", "left_semi")
    sets = scratch.keep("sets", signatures(wanted, shingle, percent, True).where("n > 0").select("id", "keys", "sketch", "shingles"))

    # every member against the smallest node of its bucket
    pairs = scratch.keep("pairs", members.where("id <> pivot").select("pivot", "id").distinct())
    chunks = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    first = chunks.select(F.col("pivot").alias("grp"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("blk"), F.lit(0).alias("kind"), F.col("pivot").alias("id"))
    rest = pairs.join(chunks, "pivot").select(F.col("pivot").alias("grp"), F.expr("cast(pmod(hash(id), chunks) as int)").alias("blk"), F.lit(1).alias("kind"), "id")
    stars = first.unionByName(rest).select("*", F.col("id").alias("comp"), F.lit(-1).alias("band"), F.lit(False).alias("twice"))
    stars = _with_sets(scratch.keep("stars", stars), sets)
    roots = components(_compare(stars, percent), scratch, "stars")

    # what that leaves open: buckets with several components
    open_rows = members.where("id <> pivot").select("band", "key", "id")
    open_rows = open_rows.join(roots, F.col("id") == F.col("node"), "left").select("band", "key", "id", F.coalesce("root", "id").alias("comp"))
    open_rows = scratch.keep("open", open_rows)
    per = open_rows.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("band", "key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps"))
    per = per.where("comps > 1").select(
        "band", "key", F.col("top.comp").alias("most"), F.expr(f"cast(ceil((all - top.c) / {BLOCK}) as int)").alias("blocks"),
        F.expr(f"cast(ceil(all / {CHUNK}) as int)").alias("parts"),
    )
    per = scratch.keep("per", per)
    rows = scratch.keep("rows", open_rows.join(per.hint("merge"), ["band", "key"]))
    outside = F.col("comp") != F.col("most")
    grp = F.concat_ws(":", "band", "key", "part").alias("grp")
    each, own = F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.expr("cast(pmod(xxhash64(id), parts) as int)").alias("part")
    heads = rows.where(outside).select("*", each).select(grp, F.expr("cast(pmod(hash(id), blocks) as int)").alias("blk"), F.lit(0).alias("kind"), "id", "comp", "band", F.lit(False).alias("twice"))
    against = rows.select("*", own).select(grp, F.explode(F.expr("sequence(0, blocks - 1)")).alias("blk"), F.lit(1).alias("kind"), "id", "comp", "band", outside.alias("twice"))
    left = _with_sets(scratch.keep("left", heads.unionByName(against)), sets)
    more = components(_compare(left, percent), scratch, "rest")

    root = roots.select(F.col("node"), F.col("root")).join(more.select(F.col("node").alias("n2"), F.col("root").alias("r2")), F.col("root") == F.col("n2"), "left")
    root = root.select("node", F.coalesce("r2", "root").alias("root"))
    alone = more.join(roots.select("node"), "node", "left_anti")  # nodes that only the second step linked
    root = scratch.keep("roots", root.unionByName(alone))
    of_node = nodes.select(*same, "id").join(root, F.col("id") == F.col("node"), "left").select(
        F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("gn"), F.coalesce("root", "id").alias("component")
    )
    of_node = scratch.keep("components", of_node)
    scratch.drop("sets", "shared", "members", "open", "per", "rows", "pairs", "stars", "left")
    linked = sigs.select("id", *same).join(
        of_node.hint("merge"), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("gn")), "left"
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return linked.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, that stay: of each component the one with the smallest id."""
    marks = near_duplicates(docs, id_col, text_col, shingle, percent)
    gone = marks.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max("kept").alias("k")).where("NOT k").select("id")
    return without(docs, id_col, Scratch(docs.sparkSession, "near-kept").keep("gone", gone))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM w
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM sets UNION SELECT y, c FROM reach JOIN edges ON x = doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
