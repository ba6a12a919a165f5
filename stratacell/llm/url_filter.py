"""URL filters by a sort-merge range join, in DataFrame functions only.

A rule (verdict, host, path) fits its host and all subdomains if the url's path
starts with the rule's. The canonical key of a rule is its host's labels from
the top-level domain down, a separator, and its path; all keys that start with
it form an interval, and the intervals of a rule set nest. A url has one key for
each suffix of its host, with its path. Rules and distinct url keys are sorted
together by range. In that order a sweep carries the last rule that opened, with
the stack of rules that enclose it; the rules that hold a key are those of the
stack that the key starts with, and the innermost of them wins. A range's first
keys take the last stack of the ranges before it. The longest fitting rule over
all host suffixes gives the verdict.

Defined cases: a null url, or one without ://, has empty host and path and no
rule; a url that no rule fits gets the default verdict; repeated rows repeat;
of two fitting rules with equally long text the one with the longer host wins;
an empty table gives an empty result, and without rules all get the default;
columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacell.llm.common import LOWER, UPPER, cut

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Between host and path in a key; it sorts before every other character.
GAP = "\u0000"


def host_path(pages: DataFrame) -> DataFrame:
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    split = pages.select("page_id", rest.alias("rest"))
    return split.select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def rule_rows(spark: SparkSession, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """One row a rule: its key and the stack of rules around it, outermost first and itself last. The rules are a parameter, so a list on the driver."""
    keyed = sorted({(".".join(reversed(h.split("."))) + GAP + p, h + p, v, len(h)) for v, h, p in rules})
    stack: list[tuple[str, str, str, int]] = []
    rows = []
    for r in keyed:
        while stack and not r[0].startswith(stack[-1][0]):
            stack.pop()
        stack.append(r)
        rows.append(list(stack))
    one = lambda r: F.struct(F.lit(r[0]).alias("key"), F.lit(r[1]).alias("rule"), F.lit(r[2]).alias("verdict"), F.lit(r[3]).alias("host_len"))
    rows = [F.struct(F.lit(s[-1][0]).alias("key"), F.array(*map(one, s)).alias("stack")) for s in rows]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.key", "r.stack")


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages."""
    spark = pages.sparkSession
    urls = host_path(pages)
    if not rules:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    opened = rule_rows(spark, rules)
    known = urls.filter("host != ''").select("host", "path").distinct()
    labels = F.reverse(F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(GAP), F.col("path")))
    keys = known.select(F.explode(suffixes).alias("key"), "host", "path")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = keys.select("key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast(opened.schema["stack"].dataType).alias("stack")).unionByName(
        opened.select("key", F.lit(0).alias("kind"), F.lit("").alias("host"), F.lit("").alias("path"), "stack")
    )
    ranged = cut(both.repartitionByRange(n, "key", "kind", "host").withColumn("part", F.spark_partition_id()))
    # The last stack of each range that opens a rule, and so the one that is carried into the ranges after it: at most a row a range.
    last = ranged.filter("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("last"))
    ends = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part").join(last, "part", "left")
    carried = ends.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind", "host").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    swept = swept.join(F.broadcast(carried), "part", "left").withColumn("active", F.coalesce("active", "carried"))
    held = F.filter("active", lambda r: F.startswith(F.col("key"), r["key"]))
    fits = swept.select("host", "path", F.try_element_at(held, F.lit(-1)).alias("fit")).filter("fit IS NOT NULL")
    rank = F.struct(F.char_length("fit.rule"), F.col("fit.host_len"))
    best = fits.groupBy("host", "path").agg(F.max_by("fit", rank).alias("fit")).select(F.col("host").alias("h"), F.col("path").alias("p"), "fit")
    joined = urls.join(cut(best), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP5_SQL = r"""
WITH s AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM s
), rules(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), k AS (
  SELECT DISTINCT host, path FROM u
), best AS (
  SELECT host, path, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(verdict, length(h || p) * 1000 + length(h)) AS verdict
  FROM k JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path
)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""
