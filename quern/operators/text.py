"""Tokens, word counts and report statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column | str) -> Column:
    """Pieces between single spaces; empty ones inside count, trailing ones don't; "" is one empty piece, spaces alone none."""
    t = F.col(text) if isinstance(text, str) else text
    cut = F.rtrim(t)
    return F.when((t != "") & (cut == ""), F.array().cast("array<string>")).otherwise(F.split(cut, " ", -1))


def tokenize(df: DataFrame, text: str = "value") -> DataFrame:
    return df.select(F.explode(tokens(text)).alias("word"))


def word_count(df: DataFrame, text: str = "value", empties: bool = True) -> DataFrame:
    """(word, n)."""
    w = tokenize(df, text)
    return (w if empties else w.where(F.col("word") != "")).groupBy("word").agg(F.count("*").alias("n"))


def word_count_without(df: DataFrame, stop: set[str], marks: str, text: str = "value") -> DataFrame:
    """(word, n) of lower-case words between spaces and marks, without stop words and empty pieces."""
    w = df.select(F.explode(F.split(F.translate(text, marks, " " * len(marks)), " ", -1)).alias("w")).select(F.lower(F.trim("w")).alias("word"))
    return w.where((F.col("word") != "") & ~F.col("word").isin(sorted(stop))).groupBy("word").agg(F.count("*").alias("n"))


def report_card(df: DataFrame, key: str, text: str, mention: str) -> DataFrame:
    """For each key: the longest word, how often `mention` occurs in any case, and the average number of words of a text."""
    t = df.select(key, tokens(text).alias("w")).select(
        key,
        F.size("w").alias("words"),
        F.coalesce(F.array_max(F.transform("w", lambda x: F.length(x))), F.lit(0)).alias("longest"),
        F.size(F.filter("w", lambda x: F.lower(x) == mention)).alias("mentions"),
    )
    return t.groupBy(key).agg(F.max("longest").cast("long").alias("longest_word"), F.sum("mentions").cast("long").alias("mentions"), (F.sum("words") / F.count("*")).alias("average_words"))
