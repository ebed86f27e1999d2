"""Conversation history: bounded messages and entities, keyed by conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages and entities kept, and the characters that a context shows of a message.
MESSAGES, ENTITIES, SHOWN = 10, 20, 300


def last_messages(messages: DataFrame, n: int = MESSAGES, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each conversation."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return messages.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def recent_context(messages: DataFrame, n: int = 3, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per conversation, its last n messages as labelled lines, each cut to 300 characters."""
    text = F.when(F.length("text") > SHOWN, F.concat(F.substring("text", 1, SHOWN), F.lit("..."))).otherwise(F.col("text"))
    line = F.concat(F.initcap("role"), F.lit(": "), text)
    held = F.sort_array(F.collect_list(F.struct(order, line.alias("line"))))  # n at most
    return last_messages(messages, n, key, order).groupBy(key).agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("context"))


def add_entities(known: Column, new: Column, most: int = ENTITIES) -> Column:
    """Append entities not yet known, keep the last `most`."""
    every = F.array_distinct(F.concat(known, new))
    return F.slice(every, F.greatest(F.size(every) - most, F.lit(0)) + 1, F.lit(most))


def entities(mentions: DataFrame, key: str, order: str, value: str, most: int = ENTITIES) -> DataFrame:
    """Per key, the last `most` distinct values by first mention, with their place from 1."""
    first = mentions.groupBy(key, value).agg(F.min(order).alias("__first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__first"), F.desc(value)))
    kept = first.withColumn("__r", rank).where(F.col("__r") <= most)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__r")))
    return kept.select(key, value, place.alias("place"))


def clear(messages: DataFrame, keys: DataFrame, key: str = "conv_id") -> DataFrame:
    """Messages without the conversations named."""
    return messages.join(keys.select(key).distinct(), key, "left_anti")
