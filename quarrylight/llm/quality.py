"""Quality classifier: a kernel ridge model of document statistics, calibrated by isotonic regression.

1. Each whole text becomes some thirty statistics (shares of character classes, repetition of words
   and lines, word lengths).  They are written once; texts are read once.
2. Random Fourier features cos(Wx + b) of the standardised statistics approximate a Gaussian kernel.
3. The normal equations Z'Z and Z'y are summed in each partition, then by matrix row in a tree of
   two steps, and reach the driver as one fixed-size matrix per fold, whatever the number of rows.
4. The ridge penalty is the one with the least error across folds; the fold models also give each
   training row a score from a model that hasn't seen it, and those scores (as a histogram of
   fixed size) are what the isotonic map is fitted to.

All labelled rows outside the held-out part are used; none are sampled.

Defined results
---------------
* Null texts count as empty; an empty text has all statistics zero and gets a score like any other.
* Labels are joined by id.  Null labels are left out; an id labelled twice counts twice.
* With no label, or labels of one kind only, every score is the mean label, or 0.5 without labels.
* Each input row gives one row; repeated rows and null ids too (a null id is not held out).  Only
  the id and the text are read, so further columns may have any names.  An empty table gives none.
* A score equal to the cut is accepted.  Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .scratch import Scratch, without

N_RFF = 320
FOLDS = 4
PENALTIES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
BINS = 4096
#: Tasks whose sums meet in one task before all lots are added.
LANES = 64
VECTORS = "fold int, row int, lane int, v binary"
CUT = 0.3
#: Width of the Gaussian kernel, as a share of the square root of the number of statistics.
KERNEL_WIDTH = 2.0

#: Classes of bytes.
_CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "loud", "bar", "symbol", "quote", "lead", "rest")
_CLASS = np.full(256, _CLASSES.index("symbol"), np.uint8)
for _name, _bytes in (
    ("lower", b"abcdefghijklmnopqrstuvwxyz"),
    ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("digit", b"0123456789"),
    ("blank", b" \t"),
    ("line", b"\n\x0b\x0c\r"),
    ("stop", b".,;:"),
    ("loud", b"!?"),
    ("bar", b"|"),
    ("quote", b"'\"()-/"),
    ("lead", bytes(range(0xC0, 0x100))),
    ("rest", bytes(range(0x80, 0xC0))),
):
    _CLASS[list(_bytes)] = _CLASSES.index(_name)


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over each row's range."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def _repeats(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: its number of distinct keys and the count of the commonest one."""
    rows = len(at) - 1
    distinct, most = np.zeros(rows), np.zeros(rows)
    if len(keys):
        row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(at))
        # 40 bits of the key suffice for statistics; the row stands above them
        k = np.sort((row << np.uint64(40)) | (keys >> np.uint64(24)))
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(first, len(k)))
        r = (k[first] >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(r, minlength=rows).astype(float)
        np.maximum.at(most, r, size)
    return distinct, most


def statistics(w: wordhash.Words) -> np.ndarray:
    """A row of statistics for each text of the slice."""
    rows, sizes = w.rows, np.diff(w.text_at).astype(float)
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(w.text_at))
    k = len(_CLASSES)
    count = np.bincount(row * k + _CLASS[w.data], minlength=rows * k).reshape(rows, k).astype(float)
    share = count / np.maximum(sizes, 1)[:, None]
    n = w.counts.astype(float)
    per_word = lambda x: x / np.maximum(n, 1)
    length = (w.ends - w.starts).astype(float)
    mean = per_word(_per_row(length, w.word_at))
    spread = np.sqrt(np.maximum(per_word(_per_row(length**2, w.word_at)) - mean**2, 0))
    names = w.names()
    same = np.zeros(len(names))
    if len(same):
        same[1:] = names[1:] == names[:-1]
        inner = w.word_at[:-1]
        same[inner[inner < len(same)]] = 0  # the first word of a text has no word before it
    first, last = _CLASS[w.data[w.starts]], _CLASS[w.data[w.ends - 1]]
    code = {c: i for i, c in enumerate(_CLASSES)}
    distinct, most = _repeats(names, w.word_at)
    pairs_at, pairs = w.runs(2)
    d2, m2 = _repeats(pairs, np.searchsorted(pairs_at, w.word_at))
    lines = count[:, code["line"]] + (sizes > 0)
    loud_words = per_word(_per_row(last == code["loud"], w.word_at))
    odd_words = per_word(_per_row((last == code["symbol"]) | (last == code["bar"]), w.word_at))
    short = per_word(_per_row(length <= 1, w.word_at))
    capital = per_word(_per_row(first == code["upper"], w.word_at))
    stops = per_word(_per_row(last == code["stop"], w.word_at))
    repeated = per_word(_per_row(same, w.word_at))
    return np.column_stack(
        [
            np.log1p(sizes), np.log1p(n), np.log1p(lines), np.log1p(per_word(lines)), mean, spread,
            *np.sqrt(share).T,
            np.sqrt(repeated), per_word(distinct), per_word(d2), np.sqrt(per_word(most)), np.sqrt(per_word(m2)),
            np.log1p(n) - np.log1p(distinct), np.sqrt(loud_words), np.sqrt(odd_words), np.sqrt(short), np.sqrt(capital), np.sqrt(stops),
            np.log1p(n * repeated), np.log1p(n * loud_words), np.log1p(n * odd_words),
        ]
    ) * (sizes > 0)[:, None]


N_STATS = 6 + len(_CLASSES) + 14


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    raw: np.ndarray  # of the isotonic map
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.centre) / self.scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.beta
        # A thousandth of the raw score keeps order within the flat parts of the isotonic map.
        tie = 1 / (1 + np.exp(-np.clip(8 * (raw - 0.5), -50, 50)))
        return np.clip(0.999 * np.interp(raw, self.raw, self.calibrated) + 0.001 * tie, 0, 1)


def fourier(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """Random Fourier features and a constant one."""
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((x.shape[1], N_RFF)) / (KERNEL_WIDTH * np.sqrt(x.shape[1]))
    b = rng.uniform(0, 2 * np.pi, N_RFF)
    return np.column_stack([np.sqrt(2 / N_RFF) * np.cos(np.clip(x, -30, 30) @ w + b), np.ones(len(x))])


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to y by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(y, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    column = b.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and stats, an array of floats, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wordhash.sparing(batches):
            parts = [statistics(w) for w in wordhash.words(b.column("text"))]
            x = np.concatenate(parts) if parts else np.zeros((0, N_STATS))
            flat = pa.array(x.astype(np.float32).ravel())
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATS), flat)
            yield pa.RecordBatch.from_arrays([b.column("id"), stats], ["id", "stats"])

    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, stats array<float>")


def _sum_by_row(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Adds up vectors by (fold, row) as a tree: those of LANES lots of tasks, then the lots."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for fold, row, v in zip(b.column("fold").to_pylist(), b.column("row").to_pylist(), b.column("v").to_pylist()):
                v = np.frombuffer(v)
                sums[fold, row] = sums[fold, row] + v if (fold, row) in sums else v
        yield _vectors(sums)

    lots = parts.repartition("fold", "row", "lane").mapInArrow(add, VECTORS)
    rows = lots.repartition("fold", "row").mapInArrow(add, VECTORS).collect()
    return {(r["fold"], r["row"]): np.frombuffer(r["v"]) for r in rows}


def _vectors(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    """Sums of this task; its lane is its number modulo LANES."""
    lane = TaskContext.get().partitionId() % LANES
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f for f, _ in sums], pa.int32()),
            pa.array([r for _, r in sums], pa.int32()),
            pa.array([lane] * len(sums), pa.int32()),
            pa.array([v.tobytes() for v in sums.values()], pa.binary()),
        ],
        ["fold", "row", "lane", "v"],
    )


def fit(stats: DataFrame, labelled: DataFrame) -> Model:
    """A model from ``labelled`` (stats, label, fold); ``stats`` (all documents) gives centre and scale."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, N_STATS))
        for b in batches:
            x = _matrix(b, "stats")
            total += [np.full(N_STATS, len(x)), x.sum(0), (x * x).sum(0)]
        yield _vectors({(0, i): total[i] for i in range(3)})

    m = _sum_by_row(stats.select("stats").mapInArrow(moments, VECTORS))
    n, s, q = (m.get((0, i), np.zeros(N_STATS)) for i in range(3))
    centre = s / np.maximum(n, 1)
    scale = np.sqrt(np.maximum(q / np.maximum(n, 1) - centre**2, 0)) + 1e-3

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, N_RFF + 2, N_RFF + 2))
        for b in batches:
            z = fourier((_matrix(b, "stats") - centre) / scale)
            z = np.column_stack([z, b.column("label").to_numpy(zero_copy_only=False)])
            fold = b.column("fold").to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                own = z[fold == f]
                sums[f] += own.T @ own
        yield _vectors({(f, r): sums[f, r] for f in range(FOLDS) for r in range(N_RFF + 2) if sums[f].any()})

    rows = _sum_by_row(labelled.select("stats", "label", "fold").mapInArrow(equations, VECTORS))
    gram = np.zeros((FOLDS, N_RFF + 2, N_RFF + 2))
    for (f, r), v in rows.items():
        gram[f, r] = v
    whole = gram.sum(0)
    n_rows, positive = whole[N_RFF, N_RFF], whole[N_RFF, N_RFF + 1]
    flat = np.zeros(N_RFF + 1)
    if n_rows == 0 or positive in (0, n_rows):
        mean = positive / n_rows if n_rows else 0.5
        return Model(centre, scale, flat, np.array([0.0, 1.0]), np.array([mean, mean]))

    def solve(g: np.ndarray, penalty: float) -> np.ndarray:
        ridge = np.eye(N_RFF + 1) * penalty * max(g[N_RFF, N_RFF], 1)
        ridge[-1, -1] = 1e-9  # the constant is hardly penalised
        return np.linalg.solve(g[:-1, :-1] + ridge, g[:-1, -1])

    def error(penalty: float) -> float:
        total = 0.0
        for f in range(FOLDS):
            b = np.append(-solve(whole - gram[f], penalty), 1)
            total += b @ gram[f] @ b
        return total

    best = min(PENALTIES, key=error)
    beta, by_fold = solve(whole, best), np.array([solve(whole - gram[f], best) for f in range(FOLDS)])

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BINS))
        for b in batches:
            z = fourier((_matrix(b, "stats") - centre) / scale)
            raw = (z * by_fold[b.column("fold").to_numpy(zero_copy_only=False)]).sum(1)
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            sums[0] += np.bincount(at, minlength=BINS)
            sums[1] += np.bincount(at, b.column("label").to_numpy(zero_copy_only=False), minlength=BINS)
        yield _vectors({(0, 0): sums[0], (0, 1): sums[1]})

    h = _sum_by_row(labelled.select("stats", "label", "fold").mapInArrow(crossed, VECTORS))
    count, ones = h[0, 0], h[0, 1]
    full = count > 0
    y = isotonic(ones[full] / count[full], count[full])
    raw = (np.flatnonzero(full) + 0.5) / BINS * 2 - 0.5
    return Model(centre, scale, beta, raw, y)


def held_out_part(ident: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(ident.cast("string")), F.lit(5)) == 0, F.lit(False))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = CUT
) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.keep("stats", extract(docs, id_col, text_col))
    ident = F.col("id").cast("string")
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label")).where("label is not null")
    labelled = stats.where(~held_out_part(F.col("id"))).join(known, "id")
    fold = F.pmod(F.crc32(F.concat(F.lit("fold:"), ident)), F.lit(FOLDS)).cast("int")
    model = fit(stats, scratch.keep("labelled", labelled.select("stats", "label", fold.alias("fold"))))
    kind = stats.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_matrix(b, "stats")) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(score)], ["id", "score"])

    scored = stats.mapInArrow(run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        held_out_part(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that the classifier doesn't reject.

    An id stays when any of its rows is accepted, so repeated ids stand or fall together.
    """
    scored = Scratch(docs.sparkSession, "quality-kept").keep("scored", score_quality(docs, labels, id_col, text_col))
    gone = scored.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max("predicted").alias("p")).where("p = 0").select("id")
    return without(docs, id_col, gone)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
