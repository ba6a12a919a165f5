"""Pieces that several training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one is set only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="stratacell-")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it from there: lineage ends, lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged. lower() is used only where no other character of the text can change under it."""
    return F.when(text.rlike(r"[^\x00-\x7F\p{Ll}\p{Lo}\p{P}\p{Sc}\p{Sm}\p{Nd}]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
