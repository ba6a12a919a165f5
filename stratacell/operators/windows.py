"""Ranks, standard scores, corrections for many tests, islands and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacell.operators.linkage import cut


def average_rank(value: str, *by: str) -> Column:
    """The rank in the group, ties sharing their mean rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def within_key_score(panel: DataFrame, key: str, value: str) -> DataFrame:
    """panel with z: the standard score in its key; in keys of two or three the centred average rank over the spread of 1..n; 0 in constant and single keys."""
    own = Window.partitionBy(key)
    n, sd = F.count(value).over(own), F.stddev_samp(value).over(own)
    ranked = panel.withColumns({"_n": n, "_sd": sd, "_mean": F.avg(value).over(own), "_rank": average_rank(value, key)})
    spread = F.sqrt(F.col("_n") * (F.col("_n") + 1) / 12.0)
    z = F.when((F.col("_n") < 2) | (F.coalesce("_sd", F.lit(0.0)) == 0), 0.0).when(F.col("_n") >= 4, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise((F.col("_rank") - (F.col("_n") + 1) / 2.0) / spread)
    return ranked.withColumn("z", F.round(z, 6)).drop("_n", "_sd", "_mean", "_rank")


def adjusted(tests: DataFrame, p: str, tie: str, *by: str) -> DataFrame:
    """tests with bh_q and holm_p within each family."""
    own = Window.partitionBy(*by)
    order = own.orderBy(p, tie)
    ranked = tests.withColumns({"_m": F.count(p).over(own), "_r": F.row_number().over(order)})
    bh = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(order.rowsBetween(0, Window.unboundedFollowing))
    holm = F.max(F.col(p) * (F.col("_m") - F.col("_r") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumns({"bh_q": F.round(F.least(bh, F.lit(1.0)), 6), "holm_p": F.round(F.least(holm, F.lit(1.0)), 6)}).drop("_m", "_r")


def top_row(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def islands(df: DataFrame, by: list[str], at: str, gap: Column) -> DataFrame:
    """df with island: a new one begins where the step from the row before exceeds gap."""
    order = Window.partitionBy(*by).orderBy(at)
    new = F.when(F.lag(at).over(order).isNull() | (F.col(at) - F.lag(at).over(order) > gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str, tie: str) -> DataFrame:
    """The union of each group's intervals: by, start, end, n. A group is spread over ranges of starts; what reaches into a range from those before it is one row a range and group."""
    ranged = in_ranges(df.select(*by, start, end, tie), [*by, start, end, tie])
    carried = carry(ranged.groupBy("_part", *by).agg(F.max(end).alias("_far")), by, F.max("_far"), "_reach")
    order = Window.partitionBy("_part", *by).orderBy(start, end, tie)
    own = ranged.join(carried, ["_part", *by], "left")
    reach = F.greatest(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    new = own.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    new = new.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = cut(new.groupBy("_part", *by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")))
    before = carry(piece.groupBy("_part", *by).agg(F.max("_island").alias("_n")), by, F.sum("_n"), "_before")
    whole = piece.join(before, ["_part", *by], "left").withColumn("_island", F.col("_island") + F.coalesce("_before", F.lit(0)))
    return whole.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).drop("_island")


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt by ranges, with the range's number; dealt once, as two plans would sample other bounds."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def carry(parts: DataFrame, by: list[str], total: Column, name: str) -> DataFrame:
    """For each range and group, an aggregate over the group's earlier ranges: a row a range and group."""
    return parts.select("_part", *by, total.over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias(name))


def group_rank(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """1..n within each group without one task that holds a group: ranks within ranges, plus the group's rows in the ranges before."""
    ranged = in_ranges(df, [*by, *order])
    before = carry(ranged.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n")), by, F.sum("_n"), "_before")
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)))
    return own.join(before, ["_part", *by]).withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_part", "_own", "_before")


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """1..n over all rows without one task that holds them all: ranks within ranges, plus the rows of the ranges before."""
    ranged = in_ranges(df, order)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def quartile_label(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with bin: lo-hi by the data's own quartiles, the upper edge inside."""
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))).alias("edges"))
    own = df.join(edges, list(by)) if by else df.crossJoin(F.broadcast(edges))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    k = F.size(F.filter(inner, lambda e: e < F.col(value)))
    return own.withColumn("bin", k + 1).withColumns({"lo": F.element_at("edges", F.col("bin")), "hi": F.try_element_at("edges", F.col("bin") + 1)}).drop("edges")


def hash_unit(seed: str, id_: Column) -> Column:
    """A number in [0, 1] from the first 12 hex digits of sha256(seed:id)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), id_.cast("string")), 256), 1, 12), 16, 10).cast("double") / float(16**12 - 1)
