"""Chat formatting by quotation linking, with DataFrame functions only.

1. The lines of a message get a quote level, the number of ``>`` before them.  Level 0 is what the
   message itself says; a run of lines of one higher level is a quoted passage.
2. What messages say is indexed by the hash of the normalised whole and of each of its lines, with
   the first turn of the conversation that says it.  Passages and their lines are looked up there:
   both sides are one row per hash at most, so text that is said a thousand times costs no more.
3. Of a message's finds the lowest level counts, then whole passages before lines, the longest,
   and the latest turn: that is the message it replies to.  Replies to replies are followed to
   their first message by pointer jumping, in as many joins as the logarithm of the longest chain.
4. Within a conversation, messages come in the order of their first message and then of their turn:
   each after what it replies to, threads in one piece, conversations without quotes in order of
   turn.  Places are numbered from the sorted ranges of all messages, so a conversation with a third
   of all messages is no task of its own.

Each message is one row; ``chat`` is its text without quotes in the chat format, and the rows of a
conversation in order of ``place`` are the conversation.

Defined results
---------------
* White space around quote marks is no text.  Normalised: runs of blanks, tabs and line ends are one
  blank, trimmed, lower case.  Empty passages and lines are not looked up.
* Only an earlier turn of the same conversation can be quoted.  Null conversations are one conversation.
* Rows with a null turn come first, quote nothing and cannot be quoted.  Rows that share a conversation
  and turn share the message they reply to; repeated rows stay repeated.
* Null texts count as empty.  Roles are trimmed and lower-cased; null or empty ones are ``user``.
* Only the four named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

MARKS = "^[ \\t]*(?:>[ \\t]*)+"
#: Characters of a text that take part in the bounds of ranges.
PREFIX = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def normalised(c: F.Column) -> F.Column:
    return F.lower(F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " ")))


def own_text(text: F.Column) -> F.Column:
    """The lines without quote marks, without empty ones at either end."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(MARKS))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "^[ \\t\\r\\n]+", ""), "[ \\t\\r\\n]+$", "")


def quoted_passages(messages: DataFrame) -> DataFrame:
    """conv, turn, level, passage of each quoted passage."""
    quoting = messages.where(F.col("text").rlike("(?m)" + MARKS) & F.col("turn").isNotNull()).select("conv", "turn", "text").distinct()
    lines = quoting.select("conv", "turn", F.md5("text").alias("m"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("level", F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 0), "[^>]", "")))
    lines = lines.withColumn("body", F.regexp_replace("line", MARKS, ""))
    in_message = Window.partitionBy("conv", "turn", "m").orderBy("at")  # the lines of one message
    lines = lines.withColumn("new", F.coalesce((F.col("level") != F.lag("level").over(in_message)).cast("int"), F.lit(1)))
    lines = lines.withColumn("run", F.sum("new").over(in_message)).where("level > 0")
    runs = lines.groupBy("conv", "turn", "m", "run", "level").agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("b"))
    return runs.select("conv", "turn", "level", F.array_join(F.col("b.body"), "\n").alias("passage"))


def _units(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """The normalised whole and lines of a text: keys, whole, unit."""
    whole = df.select(*keys, F.lit(1).alias("whole"), normalised(F.col(text)).alias("unit"))
    lines = df.where(F.col(text).contains("\n")).select(*keys, F.explode(F.split(text, "\n")).alias("l"))
    lines = lines.select(*keys, F.lit(0).alias("whole"), normalised(F.col("l")).alias("unit"))
    return whole.unionByName(lines).where("unit <> ''")


def reply_links(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, turn, reply_to, root, depth of each place that replies to another."""
    said = _units(messages.where("turn is not null").select("conv", "turn", "own"), "own", "conv", "turn")
    quoted = scratch.keep("quoted", _units(quoted_passages(messages), "passage", "conv", "turn", "level"))
    asked = quoted.select(F.col("conv").alias("c"), F.md5("unit").alias("h")).distinct()
    said = said.select("conv", F.md5("unit").alias("h"), "turn").groupBy("conv", "h").agg(F.min("turn").alias("said_at"))
    said = said.join(asked.withColumnRenamed("h", "h2"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("h2")), "left_semi")
    said = said.select(F.col("conv").alias("c"), F.col("h").alias("h2"), "said_at")
    quoted = quoted.withColumn("h", F.md5("unit"))
    found = quoted.join(said, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("h2"))).where("said_at < turn")
    best = F.min(F.struct("level", -F.col("whole"), -F.length("unit"), (-F.col("said_at")).alias("at")))
    links = found.groupBy("conv", "turn").agg(best.alias("b")).select("conv", "turn", (-F.col("b.at")).alias("reply_to"))
    links = scratch.keep("links-0", links.withColumn("root", F.col("reply_to")).withColumn("depth", F.lit(1)))
    hop = 0
    while True:
        up = links.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        on = F.col("conv").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t"))
        if links.join(up, on, "left_semi").isEmpty():
            return links
        further = links.join(up, on, "left")
        hop += 1
        links = scratch.keep(
            f"links-{hop}",
            further.select("conv", "turn", "reply_to", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth")),
        )


def format_chats(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per message: conversation, turn, role, reply_to, root, depth, place, content, chat."""
    scratch = Scratch(messages.sparkSession, "chat")
    role = F.lower(F.trim(F.col(f"`{role_col}`")))
    rows = messages.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.when(role != "", role).otherwise("user").alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("own", own_text(F.col("text")))
    links = reply_links(rows, scratch).select(F.col("conv").alias("c"), F.col("turn").alias("t"), "reply_to", "root", "depth")
    placed = rows.drop("text").join(links, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left")
    placed = placed.select("conv", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), "own")
    # Sorted ranges, numbered within; a conversation's rows before a range are counted from the ranges.
    # Bounds of ranges are sampled to the driver, so of a text only its beginning decides about the range.
    order = ["conv", "root", "turn", "role"]
    ranged = placed.repartitionByRange(*order, F.substring("own", 1, PREFIX)).sortWithinPartitions(*order, "own")
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id())
    ranged = scratch.keep("ranged", ranged)
    per = ranged.groupBy("conv", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    ranges = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    per = per.withColumn("before", F.coalesce(F.sum("n").over(ranges), F.lit(0)))
    per = per.select(F.col("conv").alias("c"), F.col("part").alias("p"), "first", "before")
    out = ranged.join(per, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return out.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        "role",
        "reply_to",
        "root",
        "depth",
        (F.col("before") + F.col("seq") - F.col("first") + 1).alias("place"),
        F.col("own").alias("content"),
        F.concat(F.lit(OPEN), "role", F.lit("\n"), "own", F.lit(CLOSE + "\n")).alias("chat"),
    )


def op4_chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_NORM = "lower(trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g')))"
_MARK = "^[ \\t]*(?:>[ \\t]*)+"
OP4_SQL = f"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, CASE WHEN trim(role) <> '' THEN lower(trim(role)) ELSE 'user' END AS role, coalesce(text, '') AS text
  FROM conversations
),
l AS (
  SELECT rid, conv_id, turn, pos, line, length(regexp_replace(regexp_extract(line, '{_MARK}', 0), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '{_MARK}', '') AS body
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM m)
),
own AS (
  SELECT rid, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), ''), '^[ \\t\\r\\n]+', ''), '[ \\t\\r\\n]+$', '') AS own
  FROM l GROUP BY rid
),
msg AS (SELECT m.rid, m.conv_id, m.turn, m.role, own.own FROM m JOIN own USING (rid)),
said AS (
  SELECT conv_id, unit, min(turn) AS said_at FROM (
    SELECT conv_id, turn, {_NORM.format("own")} AS unit FROM msg
    UNION ALL SELECT conv_id, turn, {_NORM.format("x")} FROM (SELECT conv_id, turn, unnest(string_split(own, chr(10))) AS x FROM msg)
  ) WHERE unit <> '' AND turn IS NOT NULL GROUP BY conv_id, unit
),
runs AS (
  SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY pos) AS run
  FROM (SELECT *, (level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY pos))::INT AS new FROM l)
),
passages AS (
  SELECT rid, conv_id, turn, level, run, string_agg(body, chr(10) ORDER BY pos) AS passage FROM runs WHERE level > 0 GROUP BY ALL
),
quoted AS (
  SELECT conv_id, turn, level, 1 AS whole, {_NORM.format("passage")} AS unit FROM passages
  UNION ALL SELECT conv_id, turn, level, 0, {_NORM.format("x")} FROM (SELECT *, unnest(string_split(passage, chr(10))) AS x FROM passages)
),
links AS (
  SELECT conv_id, turn, said_at AS reply_to FROM (
    SELECT q.conv_id, q.turn, s.said_at,
           row_number() OVER (PARTITION BY q.conv_id, q.turn ORDER BY level, whole DESC, length(q.unit) DESC, s.said_at DESC) AS r
    FROM quoted q JOIN said s ON s.conv_id IS NOT DISTINCT FROM q.conv_id AND s.unit = q.unit AND s.said_at < q.turn
  ) WHERE r = 1
),
chain AS (
  SELECT conv_id, turn, reply_to, reply_to AS root, 1 AS depth FROM links
  UNION ALL
  SELECT c.conv_id, c.turn, c.reply_to, k.reply_to, c.depth + 1 FROM chain c JOIN links k ON k.conv_id IS NOT DISTINCT FROM c.conv_id AND k.turn = c.root
),
ends AS (SELECT conv_id, turn, any_value(reply_to) AS reply_to, arg_max(root, depth) AS root, max(depth) AS depth FROM chain GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, e.reply_to, coalesce(e.root, m.turn) AS root, coalesce(e.depth, 0)::INT AS depth,
       row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(e.root, m.turn) NULLS FIRST, m.turn NULLS FIRST, m.role, m.own) AS place,
       m.own AS content, '{OPEN}' || m.role || chr(10) || m.own || '{CLOSE}' || chr(10) AS chat
FROM msg m LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM m.conv_id AND e.turn = m.turn
"""
