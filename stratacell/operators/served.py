"""Queries that a tool serves: a bad request gives a row with an error and a hint, never an exception."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suggestions(word: str, known: list[str], n: int = 3) -> list[str]:
    """Names that hold the word, then close ones."""
    low = word.lower()
    hits = [k for k in known if low in k.lower()]
    return (hits + [k for k in difflib.get_close_matches(word, known, n, 0.6) if k not in hits])[:n]


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of a key with null error, or one row that says there is none. The filter reaches the scan."""
    found = df.filter(F.col(key) == value)
    none = df.sparkSession.range(1).join(found.limit(1).select(F.lit(1).alias("hit")), F.lit(True), "left_anti").select(F.lit(f"no {key} {value}").alias("error"))
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(none, allowMissingColumns=True)


def grouped_rate(df: DataFrame, by: str, allowed: tuple[str, ...], hit) -> DataFrame:
    """A rate by one of the allowed columns; else an error with what is close."""
    if by not in allowed:
        hint = ", ".join(suggestions(by, list(allowed))) or ", ".join(allowed)
        return df.sparkSession.range(1).select(F.lit(f"unknown column {by}").alias("error"), F.lit(hint).alias("hint"))
    return df.groupBy(F.col(by).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("int")), 6).alias("rate"))


def compared(cells: DataFrame, id_: str, key: str, value: str, ids: list, most: int = 6) -> DataFrame:
    """The values of some entities side by side with whether they differ; too many entities give a row that says so."""
    if not 1 < len(ids) <= most:
        return cells.sparkSession.range(1).select(F.lit(f"compare 2 to {most} entities, not {len(ids)}").alias("error"))
    own = cells.filter(F.col(id_).isin(*ids)).groupBy(key).agg(*[F.max(F.when(F.col(id_) == i, F.col(value))).alias(f"v{k}") for k, i in enumerate(ids, 1)], F.countDistinct(F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("_kinds"))
    return own.withColumn("differs", F.col("_kinds") > 1).drop("_kinds")


def suggested(names: DataFrame, id_: str, name: str, word: str, n: int = 3) -> DataFrame:
    """The nearest names: those that hold the word, then by edits. A report of n rows, found by a top-n and not by a sort of all."""
    low = F.lower(F.col(name))
    return names.select(id_, name, (~low.contains(word.lower())).cast("int").alias("kind"), F.levenshtein(low, F.lit(word.lower())).alias("edits")).orderBy("kind", "edits", id_).limit(n)


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """One row a share: linear between neighbours, over the numbers that there are."""
    one = df.agg(F.percentile(value, F.array(*[F.lit(s) for s in shares])).alias("q"), F.count(value).alias("n"))
    pairs = F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("share"), F.col("q").alias("value"))
    return one.select("n", F.explode(pairs).alias("p")).select("p.share", F.round("p.value", 6).alias("value"), "n")
