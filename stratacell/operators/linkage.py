"""Record linkage: canonical members, links, components, neighbourhood joins, attribution."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write to the checkpoint folder that the session names, and read from there; a local session without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stratacell-"))
    return df.checkpoint(eager=True)


def star_links(records: DataFrame, id_: str, key: Column) -> DataFrame:
    """One link of each record to the smallest of its key: as many links as records, however large a group is."""
    keyed = records.select(F.col(id_).alias("b"), key.alias("key")).filter("key IS NOT NULL AND key <> ''")
    root = keyed.groupBy("key").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(root.select("key", "a"), "key").filter("a <> b").select("a", "b")


def components(nodes: DataFrame, id_: str, links: DataFrame) -> DataFrame:
    """id, root: the smallest id that is connected. Least labels of neighbours, then the label's own label, until nothing changes."""
    both = cut(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("root")))
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("near"))
        step = cut(labels.join(near, F.col("node") == F.col("x")).select("node", "root", F.least("root", "near").alias("new")))
        jump = step.select(F.col("node").alias("by"), F.col("new").alias("to"))
        after = cut(step.join(jump, F.col("new") == F.col("by"), "left").select("node", "root", F.coalesce("to", "new").alias("new")))
        labels = after.select("node", F.col("new").alias("root"))
        if after.filter("new <> root").isEmpty():
            break
    return nodes.select(F.col(id_)).join(labels, F.col(id_) == F.col("node"), "left").select(id_, F.coalesce("root", id_).alias("root"))


def canonical(records: DataFrame, root: str, order: list[Column], keep: list[str]) -> DataFrame:
    """The first member of each component in the given order."""
    return records.groupBy(root).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("m"), F.count(F.lit(1)).alias("members")).select(root, "members", "m.*")


def sorted_neighbours(records: DataFrame, id_: str, key: str, window: int, block: Column) -> DataFrame:
    """Pairs of records at most window places apart in the order of key within their block. A place is shared by one row, so pairs grow with window times rows; a large block is spread over ranges."""
    from stratacell.operators.windows import group_rank

    ranked = group_rank(records.select(F.col(id_).alias("id"), F.col(key).alias("key"), block.alias("block")), ["block"], ["key", "id"], "rn")
    ahead = ranked.select("block", F.col("id").alias("b"), F.col("key").alias("key_b"), "rn")
    near = ranked.select("block", F.col("id").alias("a"), F.col("key").alias("key_a"), F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + window)).alias("rn"))
    return near.join(ahead, ["block", "rn"]).select("a", "b", "key_a", "key_b")


def cascade(left: DataFrame, matches: list[tuple[str, Column, DataFrame]], keep: str) -> DataFrame:
    """left with match and how: the first basis whose key (column, table of key and match) is found."""
    out = left
    for name, key, side in matches:
        own = side.groupBy("key").agg(F.min("match").alias(f"_{name}")).select(F.col("key").alias(f"_k{name}"), f"_{name}")
        out = out.join(own, key == F.col(f"_k{name}"), "left").drop(f"_k{name}")
    how = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n, _, _ in matches])
    return out.select(keep, F.coalesce(*[F.col(f"_{n}") for n, _, _ in matches]).alias("match"), how.alias("how"))


def contains_tokens(a: Column, b: Column) -> Column:
    """Whether one token sequence is a run within the other."""
    spaced = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    return spaced(a).contains(spaced(b)) | spaced(b).contains(spaced(a))
