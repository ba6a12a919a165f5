"""Documents cut down to what bears on a question, and work on batches of them by a callable that is passed in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyword_windows(docs: DataFrame, id_: str, words: tuple[str, ...], reach: int) -> DataFrame:
    """Runs of words within reach of a keyword, overlapping or touching ones merged: id, start, end (positions from 0, end beyond), hits. Only hits become rows, not all words."""
    found = F.split(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), " ")
    hits = F.filter(F.transform(found, lambda w, i: F.when(F.regexp_replace(w, "[^a-z]", "").isin(*words), i)), lambda i: i.isNotNull())
    rows = docs.select(id_, F.size(found).alias("n"), F.explode(hits).alias("at"))
    rows = rows.select(id_, F.greatest(F.col("at") - reach, F.lit(0)).alias("start"), F.least(F.col("at") + reach + 1, F.col("n")).alias("end"))
    order = Window.partitionBy(id_).orderBy("start")
    new = rows.withColumn("_new", F.when(F.col("start") <= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    new = new.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return new.groupBy(id_, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("hits")).drop("_run")


def condensed(text: str | None, signals: tuple[str, ...], budget: int) -> str:
    """The units (paragraphs) that hold most signals, within a budget of words, in the order of the text; units of signs are left out."""
    units = [u for u in re.split(r"\n+", text or "") if sum(c.isalpha() for c in u) * 2 > len(u)]
    ranked = sorted(range(len(units)), key=lambda i: (-sum(len(re.findall(s, units[i], re.I)) for s in signals), i))
    left, keep = budget, []
    for i in ranked:
        n = len(units[i].split())
        if n <= left:
            left -= n
            keep.append(i)
    return "\n".join(units[i] for i in sorted(keep))


def condensed_documents(docs: DataFrame, id_: str, signals: tuple[str, ...], budget: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({id_: p[id_], "condensed": [condensed(t, signals, budget) for t in p["text"]]})

    return docs.select(id_, "text").mapInPandas(run, f"{id_} long, condensed string")


def voted(docs: DataFrame, id_: str, backend: Callable[[list[str]], list[dict]], schema: str) -> DataFrame:
    """Rows that a backend gives for batches of texts, one a text in order; a batch whose answer has another length is marked, not guessed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = backend(p["text"].fillna("").tolist())
            good = len(got) == len(p)
            yield pd.DataFrame([{id_: i, "status": "ok" if good else "order", **(got[k] if good else {})} for k, i in enumerate(p[id_])])

    return docs.select(id_, "text").mapInPandas(run, f"{id_} long, status string, {schema}")
