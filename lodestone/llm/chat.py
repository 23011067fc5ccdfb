"""Chat formatting: logged snapshots that a longer conversation extends collapse, the rest is rendered.

A conversation's turns in order (turn, role, text) give rolling prefix hashes: 128 bits, two running
``bit_xor`` sums of position-salted turn hashes, so a window computes all of them. Conversations whose whole hash is
a proper prefix hash of another are removed by an anti-join; of equal conversations the smallest id stays. What is left is
maximal and is rendered with role marks. All in DataFrame functions.

Scale: windows run over single conversations and spill; prefix hashes are made distinct before they meet the whole hashes, so that a
very common first turn is no hot group.
Nulls: a null role or text counts as a value of its own, rendered empty; a row with a null conversation id belongs to no other and is
a conversation of one turn, so that any number of them is no group; a null turn comes first. Equal rows of a conversation count
once; ties in ``turn`` are ordered by role and text. Empty and very long texts are turns like others. An empty table gives
none. Other columns, of whatever name, are not read.

The template's marks inside a role or a text are escaped (``<|`` becomes ``<`` backslash ``|``), so that no turn can forge another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .state import scratch, written

#: Fixed values of the template.
TURN_START, ROLE_END, TURN_END = "<|start|>", "\n", "<|end|>\n"


def conversation(conv: str, turn: str, role: str, text: str) -> Column:
    """Which conversation a row is of: (its id, and for a null id what the row holds)."""
    own = F.when(F.col(conv).isNull(), F.sha2(F.to_json(F.struct(F.col(turn).alias("a"), F.col(role).alias("b"), F.col(text).alias("c"))), 256))
    return F.struct(F.col(conv).isNull().alias("nameless"), F.col(conv).alias("id"), own.alias("row"))


def turns_with_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, h1, h2, n): every distinct turn with the hash of the prefix that it ends; ``n`` turns in all."""
    hashed = [F.xxhash64(F.lit(k), F.col(role).isNull(), F.col(role), F.col(text).isNull(), F.col(text)) for k in (1, 2)]
    narrow = turns.select(conversation(conv, turn, role, text).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), hashed[0].alias("a"), hashed[1].alias("b"))
    narrow = narrow.dropDuplicates(["conv", "turn", "role", "text"])
    ordered = Window.partitionBy("conv").orderBy("turn", "role", "text")
    placed = narrow.select("conv", "a", "b", F.row_number().over(ordered).alias("place"))
    upto = Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolling = [F.expr("bit_xor(salted_" + c + ")").over(upto).alias(h) for c, h in (("a", "h1"), ("b", "h2"))]
    salted = placed.select("conv", "place", F.xxhash64("a", "place").alias("salted_a"), F.xxhash64("b", "place").alias("salted_b"))
    return salted.select("conv", "place", *rolling, F.max("place").over(Window.partitionBy("conv")).alias("n"))


def maximal(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_same): one row for each maximal conversation; ``n_same`` equal ones had its turns."""
    prefixes = written(turns_with_prefixes(turns, conv, turn, role, text), "turn-prefixes")
    whole = prefixes.where("place = n").groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_same"))
    inner = prefixes.where("place < n").select(F.col("place").alias("n"), "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv", F.col("n").cast("long").alias("n_turns"), "n_same")


def rendered(role: Column, text: Column) -> Column:
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit(TURN_START), plain(role), F.lit(ROLE_END), plain(text), F.lit(TURN_END))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_same, chat) of the maximal conversations; ``chat`` is the rendered conversation."""
    with scratch(turns.sparkSession) as keep:
        kept = keep(maximal(turns, conv, turn, role, text), "maximal")
    rows = turns.select(conversation(conv, turn, role, text).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    mine = rows.join(kept.withColumnRenamed("conv", "kept"), F.to_json("conv") == F.to_json("kept"))
    parts = F.sort_array(F.collect_set(F.struct("turn", "role", "text")))  # one conversation is one output row
    chat = F.array_join(F.transform(parts, lambda p: rendered(p["role"], p["text"])), "")
    return mine.groupBy("conv", "n_turns", "n_same").agg(chat.alias("chat")).select(F.col("conv.id").alias("conv_id"), "n_turns", "n_same", "chat")


def op8(spark, sf_dir: str) -> DataFrame:
    """Registered query: the whole table of conversations, collapsed and rendered."""
    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP8_SQL = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
marked AS (SELECT conv_id, turn, role, text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own,
  '<|start|>' || replace(coalesce(role, ''), '<|', '<\|') || chr(10) || replace(coalesce(text, ''), '<|', '<\|') || '<|end|>' || chr(10) AS part FROM turns),
chats AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(part, '' ORDER BY turn, role, text) AS chat FROM marked GROUP BY conv_id, own),
one AS (SELECT min(conv_id) AS conv_id, n_turns, count(*)::BIGINT AS n_same, chat FROM chats GROUP BY n_turns, chat)
SELECT conv_id, n_turns, n_same, chat FROM one a
WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.n_turns > a.n_turns AND starts_with(b.chat, a.chat))
"""
