"""Joins by patterns and by membership, as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _keyed(subscriptions: DataFrame, pattern: str) -> DataFrame:
    """subscriptions with kind, and the topic or prefix that they wait for as __key."""
    star = F.endswith(F.col(pattern), F.lit(".*"))
    return subscriptions.withColumn("__key", F.when(star, F.expr(f"substr(`{pattern}`, 1, length(`{pattern}`) - 2)")).otherwise(F.col(pattern))).withColumn("kind", F.when(star, "wildcard").otherwise("exact"))


def _topic_keys(topics: DataFrame, topic: str) -> DataFrame:
    """topics with the keys under which each is found: itself, exactly, and its prefixes (itself too) by wildcard."""
    parts = F.split(topic, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), ".").alias("__key"), F.lit("wildcard").alias("kind")))
    return topics.select("*", F.inline(F.concat(F.array(F.struct(F.col(topic).alias("__key"), F.lit("exact").alias("kind"))), prefixes)))


def deliveries(messages: DataFrame, subscriptions: DataFrame, topic: str = "topic", pattern: str = "pattern") -> DataFrame:
    """messages joined with the subscriptions they go to, and kind: exact, or wildcard for a pattern `prefix.*` where prefix is the topic or the topic up to one of
    its dots. A message's prefixes are made once for each different topic; both sides meet by equality. A subscription that
    is there twice delivers twice, as does one that has the exact and a wildcard pattern. For their numbers alone delivery_counts doesn't make all these rows."""
    topics = messages.select(topic).where(F.col(topic).isNotNull()).distinct()
    routes = _topic_keys(topics, topic).join(_keyed(subscriptions, pattern), ["__key", "kind"]).drop("__key")
    return messages.join(routes, topic)


def delivery_counts(messages: DataFrame, subscriptions: DataFrame, by: list[str], topic: str = "topic", pattern: str = "pattern") -> DataFrame:
    """(by, n): how many rows deliveries has for each combination of by, columns of subscriptions or kind; those without any are left out.

    Messages are counted by topic and topics by key, and subscriptions by key, so a key's messages and subscriptions meet as one row a combination of by."""
    topics = messages.where(F.col(topic).isNotNull()).groupBy(topic).agg(F.count(F.lit(1)).alias("__n"))
    sent = _topic_keys(topics, topic).groupBy("__key", "kind").agg(F.sum("__n").alias("__n"))
    waiting = _keyed(subscriptions, pattern).groupBy("__key", *dict.fromkeys(["kind", *by])).agg(F.count(F.lit(1)).alias("__m"))
    return waiting.join(sent, ["__key", "kind"]).groupBy(*by).agg(F.sum(F.col("__n") * F.col("__m")).alias("n"))


def best_members(wanted: DataFrame, members: DataFrame, category: str, categories: str, eligible: Column, rating: Column, place: str, most: int = 1000) -> DataFrame:
    """(category, and the columns of members): for each category of wanted the best rated eligible member whose array categories holds it; among equal
    ratings the first by place. Only a category's first `most` members by place are looked at, as a lookup gives no more; null for no such member.

    Arrays are exploded and met by equality. Members of a category are ranked by a window only to cut at most; the best one is
    an aggregate.
    """
    asked = wanted.select(category).where(F.col(category).isNotNull()).distinct()
    each = members.withColumn(category, F.explode(F.array_distinct(categories))).join(asked, category, "left_semi")
    first = each.withColumn("__n", F.row_number().over(W.partitionBy(category).orderBy(place))).where(F.col("__n") <= most)
    rows = first.withColumns({"__ok": eligible, "__rating": rating}).where("__ok")
    best = rows.groupBy(category).agg(F.min_by(F.struct(*members.columns), F.struct((-F.col("__rating")).alias("r"), place)).alias("m"))
    return asked.join(best, category, "left").select(category, *[F.col("m")[c].alias(c) for c in members.columns])
