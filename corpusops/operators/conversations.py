"""Ordered turns: merging, history, summaries, carried state and expiry. Turns are (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from corpusops.operators.ranking import top_k


def in_order() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")



def merge_adjacent_roles(turns: DataFrame) -> DataFrame:
    """(conv_id, island, role, text): system turns go, runs of one role are joined by a blank line, and a user
    turn "Hello" comes first where the first is not the user's."""
    said = turns.where("role != 'system'").withColumn("_new", F.coalesce((F.col("role") != F.lag("role").over(in_order())).cast("int"), F.lit(0)))
    islands = said.withColumn("island", F.sum("_new").over(in_order()))
    merged = islands.groupBy("conv_id", "island", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    hello = merged.where("island = 0 AND role != 'user'").select("conv_id", F.lit(-1).cast("long").alias("island"), F.lit("user").alias("role"), F.lit("Hello").alias("text"))
    return merged.unionByName(hello)


def recent(turns: DataFrame, n: int) -> DataFrame:
    """The newest n turns of each conversation, with their place from the oldest."""
    newest = turns.withColumn("_back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_back") <= n)
    return newest.withColumn("place", F.row_number().over(in_order())).drop("_back")


def history(turns: DataFrame, n: int = 10, chars: int = 200) -> DataFrame:
    """Adds to each turn the n turns before it, as lines of role and the first characters."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring("text", 1, chars))
    return turns.withColumn("history", F.array_join(F.collect_list(line).over(in_order().rowsBetween(-n, -1)), "\n"))


def summary(turns: DataFrame, chars: int = 100) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.substring(F.max_by("text", "turn"), 1, chars).alias("preview"))


def carry(turns: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds the last value set before each turn; a turn leaves it as it is where value is null, and clears it
    where value is empty."""
    held = F.last(value, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn(name, F.nullif(held, F.lit("")))


def live(rows: DataFrame, key: str, ts: str, now: Column, days: int = 30) -> DataFrame:
    """Rows of the keys whose last write is at most `days` old."""
    last = rows.groupBy(key).agg(F.max(ts).alias("_last")).where(F.col("_last") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return rows.join(last, key, "left_semi")


def titles(turns: DataFrame, chars: int = 50) -> DataFrame:
    """(conv_id, title, updated): the start of the first user turn, or "New Chat", and the last turn."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    out = turns.groupBy("conv_id").agg(first.alias("_first"), F.max("turn").alias("updated"))
    title = F.when(F.col("_first").isNull(), "New Chat").when(F.length("_first") > chars, F.concat(F.substring("_first", 1, chars), F.lit("..."))).otherwise(F.col("_first"))
    return out.select("conv_id", title.alias("title"), "updated")


def without(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """What is left when the deleted keys take their rows with them."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def combine_clarification(turns: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    """Adds combined: after a vague user turn the next user turn is its answer; words of `before` follow the answer,
    those of `after` precede it."""
    users = turns.where("role = 'user'")
    vague = F.lower(F.trim(F.lag("text").over(in_order())))
    return users.withColumn("combined", F.when(vague.isin(before), F.concat_ws(" ", "text", vague)).when(vague.isin(after), F.concat_ws(" ", vague, "text")).otherwise(F.col("text")))


def listing(conversations: DataFrame, messages: DataFrame, owner: Column, most: int) -> DataFrame:
    """(user_id, conv_id, title, updated, place, n_messages): an owner's newest conversations, with the number of their
    messages. conversations: (user_id, conv_id, title, updated); messages: (conv_id, ...)."""
    own = top_k(conversations.where(owner), ["user_id"], [F.desc("updated"), F.asc("conv_id")], most, "place")
    counts = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return own.join(counts, "conv_id", "left").select("user_id", "conv_id", "title", "updated", "place", F.coalesce("n_messages", F.lit(0)).alias("n_messages"))
