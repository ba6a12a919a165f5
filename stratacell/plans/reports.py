"""Queries behind reports: allocations, effects, tables of power, served requests, condensed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacell.operators import documents as D
from stratacell.operators import served
from stratacell.operators.windows import global_rank
from stratacell.plans.registry import query
from stratacell.session import table
from stratacell.sources.bibliography import bibliography
from stratacell.sources.documents import lists_to_rows
from stratacell.sources.manual import manuals


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1]) AS e FROM orders) SELECT least(1 + (o_totalprice >= e[2])::INT + (o_totalprice >= e[3])::INT + (o_totalprice >= e[4])::INT, 4) AS bin, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders, q GROUP BY bin""")
def half_open_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_totalprice")
    e = o.agg(F.percentile("o_totalprice", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("e"))
    inner = F.slice("e", 2, 3)
    own = o.crossJoin(F.broadcast(e)).select("o_totalprice", (1 + F.size(F.filter(inner, lambda x: x <= F.col("o_totalprice")))).alias("bin"))
    return own.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("""WITH s AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY c_mktsegment), q AS (SELECT *, 100.0::DOUBLE * size / sum(size) OVER () AS quota FROM s), f AS (SELECT *, floor(quota) AS base, row_number() OVER (ORDER BY quota - floor(quota) DESC, c_mktsegment) AS rn, 100 - sum(floor(quota)) OVER () AS rest FROM q)
SELECT c_mktsegment, size, (base + (rn <= rest)::INT)::BIGINT AS seats FROM f""")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred seats in proportion to strata: as many rows as strata."""
    s = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("size"))
    every = Window.partitionBy(F.lit(0))
    q = s.withColumn("quota", 100.0 * F.col("size") / F.sum("size").over(every))
    f = q.withColumns({"base": F.floor("quota"), "rn": F.row_number().over(every.orderBy(F.desc(F.col("quota") - F.floor("quota")), "c_mktsegment"))}).withColumn("rest", 100 - F.sum("base").over(every))
    return f.select("c_mktsegment", "size", (F.col("base") + (F.col("rn") <= F.col("rest")).cast("int")).cast("long").alias("seats"))


@query("""WITH a AS (SELECT l_suppkey, avg((l_returnflag = 'R')::INT) AS p, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_suppkey), b AS (SELECT l_suppkey, avg((l_returnflag = 'R')::INT) AS q, count(*) AS m FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_suppkey)
SELECT l_suppkey, round(p - q, 6) AS effect, round(p * (1 - p) / n + q * (1 - q) / m, 8) AS variance FROM a JOIN b USING (l_suppkey)""")
def contrast_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two shares and its binomial variance, both arms from one aggregate."""
    arm = lambda s, c: F.avg(F.when(F.col("l_linestatus") == s, (F.col("l_returnflag") == "R").cast("int"))).alias(c)
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(arm("F", "p"), arm("O", "q"), F.count_if(F.col("l_linestatus") == "F").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("m")).filter("n > 0 AND m > 0")
    p, q = F.col("p"), F.col("q")
    return per.select("l_suppkey", F.round(p - q, 6).alias("effect"), F.round(p * (1 - p) / F.col("n") + q * (1 - q) / F.col("m"), 8).alias("variance"))


@query("""WITH g AS (SELECT l_suppkey, avg(l_discount) AS m, var_samp(l_discount) AS v, count(*) AS n FROM lineitem GROUP BY l_suppkey), c AS (SELECT avg(v) AS within, greatest(var_samp(m) - avg(v / n), 0) AS between FROM g), k AS (SELECT unnest([5, 10, 20, 40]) AS seeds)
SELECT seeds, round(within, 8) AS within, round(between, 8) AS between, round(sqrt(between + within / seeds), 8) AS error FROM c, k""")
def variance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance between and within units, and the error that so many seeds leave."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"), F.var_samp("l_discount").alias("v"), F.count(F.lit(1)).alias("n"))
    c = g.agg(F.avg("v").alias("within"), F.greatest(F.var_samp("m") - F.avg(F.col("v") / F.col("n")), F.lit(0.0)).alias("between"))
    k = c.select("within", "between", F.explode(F.array(*[F.lit(x) for x in (5, 10, 20, 40)])).alias("seeds"))
    return k.select("seeds", F.round("within", 8).alias("within"), F.round("between", 8).alias("between"), F.round(F.sqrt(F.col("between") + F.col("within") / F.col("seeds")), 8).alias("error"))


@query("""WITH o AS (SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey, max(o_totalprice) AS total FROM orders GROUP BY o_custkey), r AS (SELECT c_custkey, o_orderkey, total, row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey) AS rn FROM customer JOIN o ON c_custkey = o_custkey)
SELECT c_custkey, o_orderkey, total FROM r WHERE rn = 1""")
def top_one_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each nation: orders are reduced by customer before the join, customers by nation after it."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("o_orderkey"), F.max("o_totalprice").alias("total"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(o, F.col("c_custkey") == F.col("o_custkey"))
    best = c.groupBy("c_nationkey").agg(F.min_by(F.struct("c_custkey", "o_orderkey", "total"), F.struct(-F.col("total"), F.col("c_custkey"))).alias("b"))
    return best.select("b.*")


@query("""SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_code, dense_rank() OVER (ORDER BY p_type) - 1 AS type_code FROM part""")
def dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as numbers of a sorted dictionary: ranks are taken over distinct values only."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    codes = lambda c, n: global_rank(p.select(F.col(c).alias(f"_{c}")).distinct(), [f"_{c}"], n).withColumn(n, (F.col(n) - 1).cast("long"))
    out = p.join(codes("p_brand", "brand_code"), F.col("p_brand") == F.col("_p_brand")).join(codes("p_type", "type_code"), F.col("p_type") == F.col("_p_type"))
    return out.select("p_partkey", "brand_code", "type_code")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS route, o_orderstatus <> 'P' AS ok FROM orders) SELECT o_custkey, arg_min(o_orderkey, route * 10000000 + o_orderkey) FILTER (ok) AS chosen, count(*) FILTER (NOT ok) AS failures FROM r GROUP BY o_custkey""")
def fallback_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first route that works, in a fixed order, with the failures counted."""
    p = F.col("o_orderpriority")
    r = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(p == "1-URGENT", 1).when(p == "2-HIGH", 2).otherwise(3).alias("route"), (F.col("o_orderstatus") != "P").alias("ok"))
    chosen = F.min(F.when(F.col("ok"), F.struct("route", "o_orderkey")))["o_orderkey"]
    return r.groupBy("o_custkey").agg(chosen.alias("chosen"), F.count_if(~F.col("ok")).alias("failures"))


@query("""SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS bundle, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each conversation, whole and in order."""
    part = F.struct("turn", F.concat("role", F.lit(":"), "text").alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(parts, "|").alias("bundle"), F.sum(F.length("text")).alias("chars"))


@query("""WITH w AS (SELECT doc_id, string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ') AS x FROM documents), h AS (SELECT doc_id, len(x) AS n, unnest(x) AS word, unnest(range(0, len(x))) AS p FROM w), r AS (SELECT doc_id, greatest(p - 5, 0) AS s, least(p + 6, n) AS e FROM h WHERE regexp_replace(word, '[^a-z]', '', 'g') IN ('idiot', 'clown', 'scum')),
i AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM i)
SELECT doc_id, min(s) AS start, max(e) AS "end", count(*) AS hits FROM g GROUP BY doc_id, run""")
def keyword_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.keyword_windows(table(spark, sf_dir, "documents"), "doc_id", ("idiot", "clown", "scum"), 5)
    return w.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "hits")


@query()
def condensed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.condensed_documents(table(spark, sf_dir, "documents"), "doc_id", (r"\bthe\b", "[0-9]+"), 200)


def stub_backend(texts: list[str]) -> list[dict]:
    """Stands for a model: a vote from the text alone."""
    return [{"vote": "include" if "the" in t.split() else "exclude"} for t in texts]


@query("""SELECT item_id, 'ok' AS status, CASE WHEN list_contains(regexp_split_to_array(text, '\\s+'), 'the') THEN 'include' ELSE 'exclude' END AS vote FROM benchmark""")
def voted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.voted(table(spark, sf_dir, "benchmark"), "item_id", stub_backend, "vote string")


@query("""SELECT o_orderkey, o_custkey, o_totalprice, NULL::VARCHAR AS error FROM orders WHERE o_orderkey = 7""")
def served_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served.point_lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 7)


@query("""SELECT 'unknown column priority' AS error, 'o_orderpriority' AS hint""")
def served_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served.grouped_rate(table(spark, sf_dir, "orders"), "priority", ("o_orderpriority", "o_orderstatus"), F.col("o_orderstatus") == "F")


@query("""SELECT o_orderpriority AS "group", count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM orders GROUP BY o_orderpriority""")
def served_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served.grouped_rate(table(spark, sf_dir, "orders"), "o_orderpriority", ("o_orderpriority", "o_orderstatus"), F.col("o_orderstatus") == "F")


@query("""SELECT l_shipmode AS key, max(n) FILTER (l_suppkey = 1) AS v1, max(n) FILTER (l_suppkey = 2) AS v2, count(DISTINCT n) > 1 AS differs FROM (SELECT l_suppkey, l_returnflag AS l_shipmode, count(*) AS n FROM lineitem GROUP BY ALL) WHERE l_suppkey IN (1, 2) GROUP BY l_shipmode""")
def served_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named entities side by side; the filter reaches the scan."""
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return served.compared(cells, "l_suppkey", "key", "n", [1, 2])


@query("""SELECT 'compare 2 to 6 entities, not 7' AS error""")
def served_compare_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served.compared(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey", "s_name", "s_acctbal", list(range(7)))


@query("""SELECT p_partkey, p_name, (NOT contains(lower(p_name), 'green ring'))::INT AS kind, levenshtein(lower(p_name), 'green ring')::INT AS edits FROM part ORDER BY kind, edits, p_partkey LIMIT 3""")
def served_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Did you mean: a report of three names."""
    return served.suggested(table(spark, sf_dir, "part"), "p_partkey", "p_name", "green ring")


@query("""SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS share, round(unnest(quantile_cont(s_acctbal, [0, 0.25, 0.5, 0.75, 1])), 6) AS value, count(s_acctbal) AS n FROM supplier""")
def served_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served.quantiles(table(spark, sf_dir, "supplier"), "s_acctbal")


@query("""SELECT p_partkey, 'article' AS kind, 'k' || p_partkey AS key, p_name || ' & {Co}' AS title, '20' || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS year, 'House, Ltd' AS publisher FROM part""")
def bibliography_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name through the format of bibliographies and back: strings, joined parts, escapes, inner braces."""
    n = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('@string{pub = "House"} text @comment{x}\n@Article{k'), n, F.lit(", Title = {"), "p_name", F.lit(" \\& {Co}}, year = 20"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit(', publisher = pub # ", Ltd"\n}'))
    e = bibliography(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")
    return e.select("p_partkey", "kind", "key", F.col("fields")["title"].alias("title"), F.col("fields")["year"].alias("year"), F.col("fields")["publisher"].alias("publisher"))


@query("""SELECT p_partkey, unnest(['definition', 'value', 'value', 'rule']) AS part, unnest(['', 'yes', p_brand, '']) AS name, unnest([p_name || ' goes on', 'it is said', '', 'the first wins']) AS said FROM part""")
def manual_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manual of one dimension for each part, as rows."""
    text = F.concat(F.lit("# Manual\n\n## `dim`\n**Definition:** "), "p_name", F.lit("\ngoes on\n\nValues:\n- `yes`: it is\n  said\n- "), "p_brand", F.lit("\n\nDecision rule:\nthe first wins\n"))
    return manuals(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text").select("p_partkey", "part", "name", "said")


@query("""SELECT p_partkey, unnest(['Tools/Own', 'Tools']) AS section, unnest([p_brand, 'n']) AS name, unnest(['http://a/' || p_partkey, 'http://b']) AS url FROM part""")
def listed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of lists and of rows of tables, with their sections."""
    text = F.concat(F.lit("# Tools\n## Own\n* ["), "p_brand", F.lit("](http://a/"), F.col("p_partkey").cast("string"), F.lit(") good\n[no](http://c)\n# Tools\n| name | x |\n|---|---|\n| [n](http://b) | 1 |\n"))
    return lists_to_rows(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")
