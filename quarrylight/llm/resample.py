"""Importance resampling towards a target distribution, over hashed runs of one to three words.

1. Higher-order functions make one array of buckets for each text, a bucket for each run of one to three
   words.  It is written once, so texts are read and hashed once.
2. The buckets are counted in each task; only the totals, a row for each bucket and task, are shuffled.
3. A bucket's gain is the scaled logarithm of how much likelier it is in the target than in the corpus.
   The gains, as many as there are buckets, are one literal array, and a text's weight is an ``aggregate``
   over ``element_at`` of that array: no row is exploded, joined or shuffled for it.
4. Gumbel noise from a hash of the id is added to the weight; the highest scores are a draw without
   replacement in which the weight is the logarithm of the odds.
5. Ranks: a quantile sketch gives a score below the last one drawn (which a count confirms), rows above
   it are dealt out by ranges of score, and a row's rank is its place in its range after what all
   higher ranges hold.  No task sorts all rows.

Defined results
---------------
* Words are runs of 0-9, a-z and characters beyond ASCII, once A-Z are lower-cased.  A null text has
  none: no features, a weight of 0, and a score like any other.
* Each row is a document, also where it repeats another's id.  Of equal scores the smaller id is drawn
  first; rows that are equal in id, features and score get consecutive ranks, in any order.  A null id is
  smaller than any other, and its noise is that of an empty id.
* Texts with fewer than ``min_words`` words have scores but are never drawn.
* Only the id and the text are read; an empty table gives an empty result, and without target texts all
  target counts are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_width

BUCKETS, MIN_WORDS, SEED = 10_000, 20, 42
#: Out of a hundred documents with enough words, so many are drawn.
PERCENT = 5
#: A quantile is off by one rank in so many rows at most, and rows of so much more than the share are ranked.
ACCURACY, MARGIN = 10_000, 0.001
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_of(text: str) -> str:
    """SQL for the words of a text; words of ASCII letters are lower-cased the fast way."""
    lower = f"if(char_length(x) = octet_length(x), lower(x), translate(x, '{_UPPER}', '{_LOWER}'))"
    return f"transform(array_remove(split(coalesce(cast({text} as string), ''), '{_BETWEEN}'), ''), x -> {lower})"


def buckets_of(text: str, buckets: int = BUCKETS) -> str:
    """SQL for (number of words, the bucket of each run of one to three words) of a text."""
    of = "cast(crc32({}) % " + str(buckets) + " as int)"
    one = f"transform(w, x -> {of.format('x')})"
    two = f"transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> {of.format('''concat(x, ' ', w[i + 1])''')})"
    three = f"transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> {of.format('''concat(x, ' ', w[i + 1], ' ', w[i + 2])''')})"
    # the words are the variable of a function, so that they are made once, whatever the optimiser does with projections
    return f"transform(array({words_of(text)}), w -> named_struct('n_words', size(w), 'buckets', concat({one}, {two}, {three})))[0]"


def counts(hashed: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How often each bucket occurs; at most as many rows as buckets come to the driver."""
    out = [0] * buckets
    for bucket, n in hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():
        out[bucket] = n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln((t + 1)(S + m) / ((s + 1)(T + m)))) of each of m buckets."""
    m, s_all, t_all = len(corpus), sum(corpus), sum(target)
    up, down = float(s_all + m), float(t_all + m)
    return [math.floor(1000 * math.log((float(t + 1) * up) / (float(s + 1) * down))) for s, t in zip(corpus, target)]


def literal_array(values: list[int], kind: str = "bigint") -> Column:
    """One constant array; the optimiser folds it before any task sees it."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def scores(docs: DataFrame, target: DataFrame, scratch: Scratch, id_col: str, text_col: str, target_col: str, buckets: int, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each row."""
    hashed = docs.select(F.col(f"`{id_col}`").alias("id"), F.expr(buckets_of(f"`{text_col}`", buckets)).alias("h"))
    hashed = scratch.keep("hashed", hashed.select("id", "h.*"))
    wanted = target.select(F.expr(buckets_of(f"`{target_col}`", buckets)).alias("h")).select("h.*")
    gain = literal_array(gains(counts(hashed, buckets), counts(wanted, buckets)))
    weight = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda a, b: a + F.element_at(gain, b + 1))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000) * F.log(-F.log((noise.cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = hashed.select("id", "n_words", F.size("buckets").cast("bigint").alias("n_features"), weight.alias("weight"), noise.alias("noise"))
    scored = scratch.keep("scored", scored.withColumn("score", F.col("weight") + F.col("noise")).drop("noise"))
    scratch.drop("hashed")
    return scored


def ranked(scored: DataFrame, drawn: int, eligible: Column, share: float, scratch: Scratch) -> DataFrame:
    """The rows with ``rank`` 1, 2, ... for the ``drawn`` eligible rows of the highest scores, null for others."""
    own = scored.where(eligible)
    low = own.agg(F.percentile_approx("score", max(0.0, 1 - share - MARGIN), ACCURACY)).first()[0]
    enough = low is not None and own.where(F.col("score") >= low).count() >= drawn
    among = eligible & (F.col("score") >= low) if enough else eligible
    columns = scored.columns
    n = shuffle_width(scored.sparkSession)
    order = [F.desc("score"), F.asc_nulls_first("id"), F.asc("weight"), F.asc("n_features"), F.asc("n_words")]
    # equal rows travel as one row and its number
    dealt = scored.where(among).groupBy(*columns).agg(F.count(F.lit(1)).alias("c")).repartitionByRange(n, *order)
    dealt = scratch.keep("dealt", dealt.withColumn("range", F.spark_partition_id()))
    held = dict(dealt.groupBy("range").agg(F.sum("c")).collect())  # one row for each range
    before, so_far = [], 0
    for i in range(max(held, default=0) + 1):
        before.append(so_far)
        so_far += held.get(i, 0)
    upto = F.sum("c").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("after", F.element_at(literal_array(before), F.col("range") + 1) + upto - F.col("c"))
    placed = placed.select(*columns, F.explode(F.expr("sequence(after + 1, after + c)")).alias("rank"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.where(~F.coalesce(among, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.unionByName(others)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (null where it isn't drawn)."""
    scratch = Scratch(docs.sparkSession, "resample")
    scored = scores(docs, target, scratch, id_col, text_col, target_col, buckets, seed)
    eligible = F.col("n_words") >= min_words
    drawn = percent * scored.where(eligible).count() // 100
    return ranked(scored, drawn, eligible, percent / 100, scratch).withColumnRenamed("id", id_col)


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that are drawn, with all their columns; all rows of an id that is drawn."""
    ids = resample(docs, target, id_col, **how).where("rank is not null").select(F.col(f"`{id_col}`").alias("drawn")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"))
    return rows.join(ids, F.col("id").eqNullSafe(F.col("drawn")), "left_semi").select("row.*")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its table, which is made by its rule, over the bytes of each different feature.
OP11_SQL = f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS table_ FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i)
  )
),
texts AS (
  SELECT 'd' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
),
split AS (
  SELECT row_number() OVER () AS r, origin, id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts
),
features AS (
  SELECT r, f, count(*) AS n FROM (
    SELECT r, array_to_string(w[i:i + k], ' ') AS f
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 1)) AS i FROM split, (SELECT unnest([0, 1, 2]) AS k))
  ) GROUP BY r, f
),
bytes AS (
  SELECT f, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM features)
),
hashed AS (
  SELECT f, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c // 256, table_[xor(c % 256, x) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM bytes, crc
),
doc_buckets AS (
  SELECT r, any_value(origin) AS origin, bucket, sum(n)::BIGINT AS n FROM features JOIN hashed USING (f) JOIN split USING (r) GROUP BY r, bucket
),
totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (origin = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (origin = 'b'), 0)::DOUBLE AS t
  FROM doc_buckets GROUP BY bucket
),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM totals) + {BUCKETS}))))::BIGINT AS g
  FROM totals
),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM doc_buckets JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= {MIN_WORDS} AS enough,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (r) WHERE origin = 'd'
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (enough) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed
"""
