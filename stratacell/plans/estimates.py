"""Queries on estimates: agreement, entropy, pooling, association, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacell.operators import estimates as E
from stratacell.operators import windows as W
from stratacell.plans.registry import query
from stratacell.session import table


def two_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two codings of an order: by its first line's status and by its own."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linestatus", F.col("l_linenumber") * 1e6 + F.col("l_extendedprice")).alias("a"), F.sum("l_quantity").alias("q"))
    return lines.join(table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("b"), "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))


READINGS = """
r AS (
  SELECT a, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS b, q, o_orderpriority
  FROM (SELECT l_orderkey, arg_min(l_linestatus, l_linenumber * 1e6 + l_extendedprice) AS a, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey
)"""


def kappa_sql(weight: str, by: str = "", certain: str = "NULL") -> str:
    p, on, g = (f"{by},", f"USING ({by})", f"GROUP BY {by}") if by else ("", "ON true", "")
    return f"""WITH {READINGS}, c AS (SELECT {p} a, b, sum({weight})::DOUBLE AS n FROM r GROUP BY {p} a, b),
t AS (SELECT {p} sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS agree FROM c {g}),
ra AS (SELECT {p} a AS v, sum(n) AS ra FROM c GROUP BY {p} a), rb AS (SELECT {p} b AS v, sum(n) AS rb FROM c GROUP BY {p} b),
ch AS (SELECT {p} sum(ra * rb) AS chance FROM ra JOIN rb USING ({p} v) {g})
SELECT {p} round(n, 6) AS n, round(agree / n, 6) AS po, round(coalesce(chance, 0) / (n * n), 6) AS pe, round(CASE WHEN coalesce(chance, 0) / (n * n) < 1 THEN (agree / n - coalesce(chance, 0) / (n * n)) / (1 - coalesce(chance, 0) / (n * n)) ELSE {certain} END, 6) AS kappa FROM t LEFT JOIN ch {on}"""


@query(kappa_sql("1"))
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.kappa(two_readings(spark, sf_dir), "a", "b")


@query(kappa_sql("1", "o_orderpriority"))
def kappa_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.kappa(two_readings(spark, sf_dir), "a", "b", by=("o_orderpriority",))


@query(kappa_sql("q", "", "1.0"))
def weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.kappa(two_readings(spark, sf_dir), "a", "b", F.col("q"), certain=1.0)


@query(f"""WITH {READINGS}, t AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS agree FROM r), v AS (SELECT v, count(*) AS m FROM (SELECT a AS v FROM r UNION ALL SELECT b FROM r) GROUP BY v),
s AS (SELECT count(*) AS q, sum(m / (2.0 * n)::DOUBLE * (1 - m / (2.0 * n)::DOUBLE)) AS s, max(n) AS n, max(agree) AS agree FROM v, t)
SELECT n, q, round((agree / n - CASE WHEN q < 2 THEN 0 ELSE s / (q - 1) END) / (1 - CASE WHEN q < 2 THEN 0 ELSE s / (q - 1) END), 6) AS ac1 FROM s""")
def ac1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gwet_ac1(two_readings(spark, sf_dir), "a", "b")


@query(f"""WITH {READINGS} SELECT o_orderpriority, count(*) AS n, round(avg((a <> b)::INT), 6) AS rate, count(*) FILTER (a <> b AND a = 'O') AS flips, round(max(m) / count(*), 6) AS top_share
FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority, a) AS m FROM r) GROUP BY o_orderpriority""")
def disagreement_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = two_readings(spark, sf_dir)
    top = r.groupBy("o_orderpriority", "a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("d"))
    flips = F.sum(F.when(F.col("a") == "O", F.col("d")).otherwise(0))
    return top.groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.round(F.sum("d") / F.sum("n"), 6).alias("rate"), flips.alias("flips"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"))


@query("""WITH c AS (SELECT lang, count(*)::DOUBLE AS n, sum(toxic)::DOUBLE AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low, round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM c""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    low, high = E.wilson(F.col("k").cast("double"), F.col("n"))
    return c.select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL), t AS (SELECT day, sum(n) AS total, sum(n * ln(n)) AS nlogn, count(*) AS k FROM c GROUP BY day)
SELECT day, total::BIGINT AS total, k, round(greatest(ln(total) - nlogn / total, 0), 6) AS entropy, round(greatest(ln(total) - nlogn / total, 0) + (k - 1) / (2 * total), 6) AS entropy_mm FROM t""")
def entropy_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return E.entropy(c, "n", "day")


@query("""WITH m AS (SELECT o_orderpriority, year(o_orderdate) AS y, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY ALL)
SELECT o_orderpriority, arg_min(v, y) AS first, arg_max(v, y) AS last, round(arg_max(v, y) - arg_min(v, y), 6) AS change FROM m GROUP BY o_orderpriority""")
def first_to_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    return E.first_to_last(m, "y", "v", "o_orderpriority")


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An effect and its variance of each supplier and ship mode year."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_discount").alias("y"), (F.var_samp("l_discount") / F.count(F.lit(1))).alias("v"), F.count(F.lit(1)).alias("n"))
    return own.filter("v > 0")


STUDIES = "s AS (SELECT * FROM (SELECT l_returnflag, l_suppkey, avg(l_discount) AS y, var_samp(l_discount) / count(*) AS v, count(*) AS n FROM lineitem GROUP BY ALL) WHERE v > 0)"


def pooled_sql(by: str, where: str = "", extra: str = "") -> str:
    return f"""WITH {STUDIES}, f AS (SELECT {by}, count(*) AS k, sum(1 / v) AS sw, sum(y / v) AS swy, sum(1 / v / v) AS sww, sum(y * y / v) AS swyy FROM s {where} GROUP BY {by}),
g AS (SELECT *, swyy - swy * swy / sw AS q, CASE WHEN k > 1 THEN greatest((swyy - swy * swy / sw - (k - 1)) / (sw - sww / sw), 0) ELSE 0 END AS tau2 FROM f),
h AS (SELECT {by}, sum(1 / (v + tau2)) AS s, sum(y / (v + tau2)) AS sy FROM s JOIN g USING ({by}) {where} GROUP BY {by})
SELECT {by}, k, round(q, 6) AS q, round(tau2, 6) AS tau2, round(CASE WHEN q > 0 THEN greatest((q - (k - 1)) / q, 0) ELSE 0 END, 6) AS i2, round(sy / s, 6) AS mu, round(1 / sqrt(s), 6) AS se {extra} FROM g JOIN h USING ({by})"""


@query(pooled_sql("l_returnflag"))
def random_effects_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pooled(studies(spark, sf_dir), "y", "v", ("l_returnflag",))


@query(f"WITH {STUDIES} SELECT l_returnflag, count(*) AS k, round(regr_slope(y / sqrt(v), 1 / sqrt(v)), 6) AS slope, round(regr_intercept(y / sqrt(v), 1 / sqrt(v)), 6) AS intercept FROM s GROUP BY l_returnflag")
def egger_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.egger(studies(spark, sf_dir), "y", "v", ("l_returnflag",))


@query(f"WITH {STUDIES}, p AS (SELECT unnest([2, 5, 10, 20]) AS least) SELECT l_returnflag, least, count(*) AS k, round(sum(y / v) / sum(1 / v), 6) AS fixed, CASE WHEN count(*) < 5 THEN 'insufficient' ELSE 'pooled' END AS verdict FROM s JOIN p ON n >= least GROUP BY ALL")
def sensitivity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for all parameter values: each study goes to those that admit it."""
    own = studies(spark, sf_dir).withColumn("least", F.explode(F.filter(F.array(*[F.lit(k) for k in (2, 5, 10, 20)]), lambda k: k <= F.col("n"))))
    k = F.count(F.lit(1))
    return own.groupBy("l_returnflag", "least").agg(k.alias("k"), F.round(F.sum(F.col("y") / F.col("v")) / F.sum(1 / F.col("v")), 6).alias("fixed"), F.when(k < 5, "insufficient").otherwise("pooled").alias("verdict"))


@query(f"WITH {STUDIES} SELECT l_returnflag, round(avg(y), 6) AS mean, round(stddev_samp(y) / sqrt(count(*)), 6) AS se, count(*) AS n FROM s GROUP BY l_returnflag")
def equal_weight_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.avg("y"), 6).alias("mean"), F.round(F.stddev_samp("y") / F.sqrt(F.count(F.lit(1))), 6).alias("se"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {STUDIES} SELECT l_suppkey, round(avg(y), 6) AS y, round(avg(v), 8) AS v, array_to_string(list_sort(list(DISTINCT l_returnflag)), ';') AS flags FROM s GROUP BY l_suppkey")
def paper_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study's contrasts as one: their mean effect and mean variance, so that many don't look more precise."""
    return studies(spark, sf_dir).groupBy("l_suppkey").agg(F.round(F.avg("y"), 6).alias("y"), F.round(F.avg("v"), 8).alias("v"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ";").alias("flags"))


def v_sql(weight: str) -> str:
    return f"""WITH c AS (SELECT p_brand AS a, p_type AS b, sum({weight})::DOUBLE AS o, sum({weight} * {weight})::DOUBLE AS ww FROM part GROUP BY ALL), ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), rb AS (SELECT b, sum(o) AS rb FROM c GROUP BY b),
t AS (SELECT sum(o) AS n, sum(ww) AS ww, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM c), s AS (SELECT greatest(sum(o * o / (ra * rb)) - 1, 0) AS phi2 FROM c JOIN ra USING (a) JOIN rb USING (b)), x AS (SELECT n * n / ww AS n, r, k, phi2 FROM t, s)
SELECT round(n, 6) AS n, round(n * phi2, 4) AS chi2, round(sqrt(phi2 / (least(r, k) - 1)), 6) AS v, round(sqrt(greatest(phi2 - (r - 1) * (k - 1) / (n - 1), 0) / least(r - (r - 1) ** 2 / (n - 1) - 1, k - (k - 1) ** 2 / (n - 1) - 1)), 6) AS v_corrected FROM x"""


@query(v_sql("1"))
def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cramers_v(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query(v_sql("p_size"))
def weighted_cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cramers_v(table(spark, sf_dir, "part"), "p_brand", "p_type", weight=F.col("p_size"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells: dimension number, level."""
    p = table(spark, sf_dir, "part")
    each = [F.struct(F.lit(i).alias("d"), c.cast("string").alias("v")) for i, c in enumerate((F.col("p_brand"), F.col("p_type"), F.floor(F.col("p_size") / 10)))]
    return p.select("p_partkey", F.explode(F.array(*each)).alias("c")).select("p_partkey", "c.d", "c.v")


@query("""WITH l AS (SELECT p_partkey, 0 AS d, p_brand AS v FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part UNION ALL SELECT p_partkey, 2, (p_size // 10)::VARCHAR FROM part),
c AS (SELECT x.d AS da, y.d AS db, x.v AS a, y.v AS b, count(*)::DOUBLE AS o FROM l x JOIN l y USING (p_partkey) WHERE x.d < y.d GROUP BY ALL), ra AS (SELECT da, db, a, sum(o) AS ra FROM c GROUP BY ALL), rb AS (SELECT da, db, b, sum(o) AS rb FROM c GROUP BY ALL),
t AS (SELECT da, db, sum(o) AS n, least(count(DISTINCT a), count(DISTINCT b)) AS m FROM c GROUP BY ALL), s AS (SELECT da, db, greatest(sum(o * o / (ra * rb)) - 1, 0) AS phi2 FROM c JOIN ra USING (da, db, a) JOIN rb USING (da, db, b) GROUP BY ALL)
SELECT da, db, round(n, 6) AS n, round(sqrt(phi2 / (m - 1)), 6) AS v FROM t JOIN s USING (da, db)""")
def association_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of dimensions at once; an entity has as many rows as dimensions, so its pairs are few."""
    x = levels(spark, sf_dir)
    y = x.select("p_partkey", F.col("d").alias("db"), F.col("v").alias("b"))
    pairs = x.withColumnsRenamed({"d": "da", "v": "a"}).join(y, "p_partkey").filter("da < db")
    return E.cramers_v(pairs, "a", "b", by=("da", "db")).select("da", "db", "n", "v")


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) AS m, median(o_totalprice) AS med, max(o_totalprice) AS top, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority, round(m, 4) AS mean, round(med, 4) AS median, top, n FROM c""")
def comparable_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.median(x), 4).alias("median"), F.max(x).alias("top"), F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey) SELECT CASE WHEN n >= 5 THEN '5+' WHEN n >= 3 THEN '3-4' ELSE '1-2' END AS size, count(*) AS keys FROM k GROUP BY size""")
def key_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"))
    return k.groupBy(F.when(F.col("n") >= 5, "5+").when(F.col("n") >= 3, "3-4").otherwise("1-2").alias("size")).agg(F.count(F.lit(1)).alias("keys"))


def panel_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.within_key_score(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_orderpriority") < "3").cast("int").alias("x")), "o_custkey", "o_totalprice")


PANEL = """
p AS (SELECT o_orderkey, o_custkey, o_totalprice, (o_orderpriority < '3')::INT AS x, count(*) OVER k AS n, stddev_samp(o_totalprice) OVER k AS sd, avg(o_totalprice) OVER k AS m,
  rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_custkey, o_totalprice) - 1) / 2.0 AS r FROM orders WINDOW k AS (PARTITION BY o_custkey)),
z AS (SELECT o_orderkey, o_custkey, o_totalprice, x, round(CASE WHEN n < 2 OR coalesce(sd, 0) = 0 THEN 0 WHEN n >= 4 THEN (o_totalprice - m) / sd ELSE (r - (n + 1) / 2.0) / sqrt(n * (n + 1) / 12.0) END, 6) AS z FROM p)"""


@query(f"WITH {PANEL} SELECT o_orderkey, o_custkey, o_totalprice, x, z FROM z")
def within_key_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_z(spark, sf_dir)


@query(f"WITH {PANEL} SELECT o_custkey, round(avg(z) FILTER (x = 1) - avg(z) FILTER (x = 0), 10) AS difference FROM z GROUP BY o_custkey HAVING count(*) FILTER (x = 1) > 0 AND count(*) FILTER (x = 0) > 0")
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda k: F.avg(F.when(F.col("x") == k, F.col("z")))
    return panel_z(spark, sf_dir).groupBy("o_custkey").agg(side(1).alias("a"), side(0).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").select("o_custkey", F.round(F.col("a") - F.col("b"), 10).alias("difference"))


@query(f"""WITH {PANEL}, d AS (SELECT o_custkey, z - avg(z) OVER k AS zd, x - avg(x) OVER k AS xd FROM z WINDOW k AS (PARTITION BY o_custkey)), per AS (SELECT o_custkey, sum(zd * xd) AS zx, sum(xd * xd) AS xx FROM d GROUP BY o_custkey),
t AS (SELECT sum(zx) / sum(xx) AS beta, sum(xx) AS sxx, count(*) AS keys FROM per) SELECT max(keys) AS keys, round(max(beta), 6) AS beta, round(sqrt(sum((zx - beta * xx) ** 2)) / max(sxx), 6) AS se FROM per, t""")
def fixed_effect_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fixed_effect(panel_z(spark, sf_dir), "o_custkey", "z", "x")


@query("""SELECT l_orderkey, l_returnflag, arg_min(l_partkey, l_linenumber * 1e6 + l_extendedprice) AS first_part, median(l_extendedprice) AS median, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS n FROM lineitem GROUP BY ALL""")
def arm_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min_by("l_partkey", F.col("l_linenumber") * 1e6 + F.col("l_extendedprice")).alias("first_part"), F.median(x).alias("median"), F.min(x).alias("low"), F.max(x).alias("high"), F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT *, max(l_quantity) FILTER (l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS own FROM lineitem)
SELECT l_orderkey, count(*) AS arms, max(own) AS own_best, 1 + count(*) FILTER (l_quantity > own + 1e-12) AS rank, count(*) FILTER (abs(l_quantity - own) <= 1e-12 AND l_returnflag <> 'R') > 0 AS tied FROM b GROUP BY l_orderkey HAVING max(own) IS NOT NULL""")
def own_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competition rank of a block's best own arm among all its arms."""
    own = F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).over(Window.partitionBy("l_orderkey"))
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", own.alias("own")).filter("own IS NOT NULL")
    tied = F.count_if((F.abs(F.col("l_quantity") - F.col("own")) <= 1e-12) & (F.col("l_returnflag") != "R")) > 0
    return b.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("arms"), F.max("own").alias("own_best"), (1 + F.count_if(F.col("l_quantity") > F.col("own") + 1e-12)).alias("rank"), tied.alias("tied"))


@query("""SELECT l_orderkey, bool_or(abs(l_discount) <= 0.02) AND bool_or(abs(l_discount) >= 0.09) AS mixed, bool_and(l_linestatus = 'F') AS all_closed FROM lineitem GROUP BY l_orderkey""")
def mixed_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.abs(F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.bool_or(d <= 0.02) & F.bool_or(d >= 0.09)).alias("mixed"), F.bool_and(F.col("l_linestatus") == "F").alias("all_closed"))


@query("""WITH c AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey) SELECT l_orderkey, bool_and(parts >= 600) AS all_recurring, bool_or(parts >= 600) AS any_recurring FROM lineitem JOIN c USING (l_suppkey) GROUP BY l_orderkey""")
def recurring_comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    c = lines.groupBy("l_suppkey").agg((F.countDistinct("l_partkey") >= 600).alias("recurring"))
    return lines.join(c, "l_suppkey").groupBy("l_orderkey").agg(F.bool_and("recurring").alias("all_recurring"), F.bool_or("recurring").alias("any_recurring"))


@query("""SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS rate, count(*) < 20 AS suppressed FROM orders GROUP BY ALL""")
def year_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("rate"), (F.count(F.lit(1)) < 20).alias("suppressed"))


@query("""WITH s AS (SELECT 1 AS stage, 'price' AS name, count(*) FILTER (o_totalprice < 1000) AS dropped FROM orders UNION ALL SELECT 2, 'status', count(*) FILTER (o_totalprice >= 1000 AND o_orderstatus = 'P') FROM orders UNION ALL SELECT 3, 'priority', count(*) FILTER (o_totalprice >= 1000 AND o_orderstatus <> 'P' AND o_orderpriority LIKE '5%') FROM orders)
SELECT stage, name, dropped, (SELECT count(*) FROM orders) - sum(dropped) OVER (ORDER BY stage)::BIGINT AS survivors FROM s""")
def guard_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each guard drops, by one pass that gives each row its first failing guard."""
    guards = ((1, "price", F.col("o_totalprice") < 1000), (2, "status", F.col("o_orderstatus") == "P"), (3, "priority", F.col("o_orderpriority").startswith("5")))
    first = F.coalesce(*[F.when(c, k) for k, _, c in guards], F.lit(0))
    counts = table(spark, sf_dir, "orders").select(first.alias("first")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("first") == k).alias(f"d{k}") for k, _, _ in guards])
    gone, rows = F.lit(0).cast("long"), []
    for k, name, _ in guards:
        gone = gone + F.col(f"d{k}")
        rows.append(F.struct(F.lit(k).alias("stage"), F.lit(name).alias("name"), F.col(f"d{k}").alias("dropped"), (F.col("total") - gone).alias("survivors")))
    return counts.select(F.inline(F.array(*rows)))


@query("""SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 10) AS share, round(avg(m), 10) AS mean_of_means FROM (SELECT *, avg(l_discount) OVER (PARTITION BY l_suppkey, l_returnflag) AS m FROM lineitem) GROUP BY l_suppkey""")
def weighted_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_discount") * F.col("l_quantity")).alias("dq"), F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("m"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("l_suppkey").agg(F.round(F.sum("dq") / F.sum("q"), 10).alias("share"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 10).alias("mean_of_means"))


@query("""WITH a AS (SELECT o_custkey, sum(o_totalprice) AS x FROM orders GROUP BY o_custkey), b AS (SELECT c_custkey, c_acctbal * 100 AS y FROM customer) SELECT coalesce(o_custkey, c_custkey) AS key, CASE WHEN x IS NULL THEN 'only_right' WHEN y IS NULL THEN 'only_left' WHEN abs(x - y) > 100000 THEN 'differs' ELSE 'same' END AS verdict FROM a FULL JOIN b ON o_custkey = c_custkey""")
def reproduction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("x"))
    b = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 100).alias("y"))
    j = a.join(b, F.col("o_custkey") == F.col("c_custkey"), "full")
    verdict = F.when(F.col("x").isNull(), "only_right").when(F.col("y").isNull(), "only_left").when(F.abs(F.col("x") - F.col("y")) > 100000, "differs").otherwise("same")
    return j.select(F.coalesce("o_custkey", "c_custkey").alias("key"), verdict.alias("verdict"))
