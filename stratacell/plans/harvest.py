"""Queries on what sources give: boards, catalogues, references, repositories, citations, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacell.functions import keys as K
from stratacell.functions import names as N
from stratacell.functions import text as X
from stratacell.plans.keying import pick
from stratacell.plans.registry import query
from stratacell.session import table
from stratacell.sources.catalogue import catalogues

Z = 1.959963984540054


@query("""SELECT o_custkey, 'b' || o_custkey AS board, o_orderkey::VARCHAR AS name, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS score FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 100000""")
def board_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board's JSON (a list of results with names and scores) as entries; an entry without a name is none, one without a score stays."""
    o = table(spark, sf_dir, "orders")
    name = F.when((F.col("o_orderstatus") != "F") | (F.col("o_totalprice") > 100000), F.col("o_orderkey").cast("string"))
    rows = o.groupBy("o_custkey").agg(F.collect_list(F.struct(name.alias("name"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"))).alias("results"))
    pages = rows.select("o_custkey", F.to_json(F.struct(F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("board"), "results")).alias("body"))
    parsed = pages.withColumn("p", F.from_json("body", "board string, results array<struct<name: string, score: double>>"))
    return parsed.select("o_custkey", "p.board", F.explode("p.results").alias("r")).filter("r.name IS NOT NULL").select("o_custkey", "board", "r.name", "r.score")


@query("""SELECT l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN 'Tool A' WHEN 1 THEN 'Tool B' ELSE 'gpt-4o' END AS name, CASE l_partkey % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3.5-sonnet' END AS model, l_extendedprice AS score FROM lineitem WHERE l_quantity >= 5 AND l_partkey % 3 < 2""")
def board_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as result rows: the system's name without the model it ran on, and that model's key. No score, or a bare model, gives no row."""
    label = pick("l_partkey", "Tool A (GPT4o)", "Tool B + Claude 3.5 Sonnet", "gpt-4o")
    name, model = K.without_model(label)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"), K.canonical_model(model).alias("model"), F.when(F.col("l_quantity") >= 5, F.col("l_extendedprice")).alias("score"), K.is_model(label).alias("bare"))
    return rows.filter("score IS NOT NULL AND NOT bare").drop("bare")


@query("""SELECT item_id, unnest([1, 2, 3]) AS number, unnest(['A. Writer', 'B. Other', 'C. Last']) AS author, unnest([2019 + item_id % 5, 2001, NULL])::BIGINT AS year, unnest([NULL, '10.1234/ab' || item_id, NULL]) AS doi FROM benchmark""")
def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered references at the end of each text: number, first author, year, identifier."""
    n = F.col("item_id")
    text = F.concat(F.col("text"), F.lit("\nsee [1]\n\nReferences\n[1] A. Writer. On\nthings, "), (2019 + n % 5).cast("string"), F.lit(".\n[2] B. Other. More. 2001. doi:10.1234/ab"), n.cast("string"), F.lit(".\n[3] C. Last. No date.\n"))
    rest = F.regexp_extract(text, r"(?is)\n(?:references|bibliography)[ \t]*\n(.*)\z", 1)
    each = F.filter(F.split(F.concat(F.lit("\n"), rest), r"\n(?=\[\d+\])"), lambda x: x.rlike(r"^\[\d+\]"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(each).alias("e"))
    year = F.regexp_extract("e", r"\b((?:19|20)\d{2})\b", 1)
    return b.select("item_id", F.regexp_extract("e", r"^\[(\d+)\]", 1).cast("int").alias("number"), F.regexp_extract("e", r"^\[\d+\]\s*([^.]+\.[^.]+)\.", 1).alias("author"), F.when(year != "", year.cast("long")).alias("year"), X.doi(F.col("e")).alias("doi"))


@query("""SELECT o_custkey, repo, score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, repo) AS rn FROM (SELECT o_custkey, 'github.com/o/r' || o_orderkey AS repo, 3 * (o_orderstatus = 'F')::INT + 2 * (o_orderpriority = '1-URGENT')::INT + (o_totalprice > 100000)::INT AS score FROM orders)) WHERE rn = 1 AND score > 0""")
def repository_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the repositories that a text names the best by marks: stated as the paper's own, named in the title, linked often."""
    url = F.concat(F.lit("https://github.com/o/r"), F.col("o_orderkey").cast("string"), F.lit(".git"))
    score = 3 * (F.col("o_orderstatus") == "F").cast("int") + 2 * (F.col("o_orderpriority") == "1-URGENT").cast("int") + (F.col("o_totalprice") > 100000).cast("int")
    o = table(spark, sf_dir, "orders").select("o_custkey", X.repo_key(url).alias("repo"), score.alias("score")).groupBy("o_custkey").agg(F.min(F.struct((-F.col("score")).alias("s"), "repo")).alias("best"))
    return o.select("o_custkey", "best.repo", (-F.col("best.s")).alias("score")).filter("score > 0")


@query("""SELECT p_partkey, unnest([p_brand, 'Second']) AS name, unnest(['http://a/' || p_partkey, 'http://b']) AS url, unnest([p_type, NULL]) AS category FROM part""")
def catalogue_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues that list maps of scalars, one entry an item."""
    text = F.concat(F.lit("# tools\n- name: '"), "p_brand", F.lit("'\n  url: http://a/"), F.col("p_partkey").cast("string"), F.lit("\n  category: "), "p_type", F.lit("  # kind\n\n- name: Second\n  url: \"http://b\"\n  tags:\n    - x\n"))
    c = catalogues(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")
    return c.select("p_partkey", F.col("entry")["name"].alias("name"), F.col("entry")["url"].alias("url"), F.col("entry")["category"].alias("category"))


@query("""SELECT doc_id, '10.5555/x' || doc_id AS doi, '2401.0' || lpad((doc_id % 10000)::VARCHAR, 4, '0') AS preprint, NULL AS none FROM documents""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in prose, without what stands after them; a preprint number needs a month that exists."""
    n = F.col("doc_id")
    t = F.concat(F.lit("see https://doi.org/10.5555/X"), n.cast("string"), F.lit("), and arXiv:2401.0"), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit("v2."))
    return table(spark, sf_dir, "documents").select("doc_id", X.doi(t).alias("doi"), X.preprint_id(t).alias("preprint"), X.preprint_id(F.lit("2413.01234")).alias("none"))


@query("""SELECT l_orderkey AS citing, l_partkey AS cited, count(*) AS n, count(*) OVER (PARTITION BY l_partkey) AS citations FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY l_orderkey, l_partkey""")
def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges once each, without loops, with how many cite the same; counts are aggregated and joined, so that a much cited one is no single task."""
    e = table(spark, sf_dir, "lineitem").filter("l_orderkey <> l_partkey").groupBy(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited")).agg(F.count(F.lit(1)).alias("n"))
    return e.join(e.groupBy(F.col("cited").alias("c")).agg(F.count(F.lit(1)).alias("citations")), F.col("cited") == F.col("c")).drop("c")


@query(f"""WITH g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT o_orderpriority, sum(n) AS total FROM g GROUP BY 1)
SELECT o_orderpriority, o_orderstatus, n, round(n / total, 6) AS rate, round((n / total + {Z * Z} / (2 * total) - {Z} * sqrt(n / total * (1 - n / total) / total + {Z * Z} / (4 * total * total))) / (1 + {Z * Z} / total), 6) AS low, round((n / total + {Z * Z} / (2 * total) + {Z} * sqrt(n / total * (1 - n / total) / total + {Z * Z} / (4 * total * total))) / (1 + {Z * Z} / total), 6) AS high FROM g JOIN t USING (o_orderpriority)""")
def escalation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by group with Wilson's intervals."""
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    total, p, z2 = F.sum("n").over(Window.partitionBy("o_orderpriority")), F.col("n") / F.col("total"), Z * Z
    t = F.col("total")
    half, middle, base = Z * F.sqrt(p * (1 - p) / t + z2 / (4 * t * t)), p + z2 / (2 * t), 1 + z2 / t
    return g.withColumn("total", total).select("o_orderpriority", "o_orderstatus", "n", F.round(p, 6).alias("rate"), F.round((middle - half) / base, 6).alias("low"), F.round((middle + half) / base, 6).alias("high"))


@query("""WITH r AS (SELECT l_suppkey AS s, l_returnflag AS a, l_linestatus AS b, l_tax AS c, l_discount AS d, l_quantity AS e, l_linenumber % 2 AS side, l_extendedprice AS v FROM lineitem), f AS (SELECT s, a, b, c, d, e, side, count(*) AS n, min(v) AS v FROM r GROUP BY ALL), x AS (SELECT * FROM f WHERE side = 1), y AS (SELECT * FROM f WHERE side = 0), k4 AS (SELECT DISTINCT s, a, b, c, d FROM y), k3 AS (SELECT DISTINCT s, a, b, c FROM y)
SELECT x.s, x.a, x.b, x.c, x.d, x.e, round(x.v - y.v, 2) AS delta, CASE WHEN y.v IS NOT NULL AND x.n = 1 AND y.n = 1 THEN 'paired' WHEN y.v IS NOT NULL THEN 'ambiguous' WHEN k4.s IS NOT NULL THEN 'fifth_differs' WHEN k3.s IS NOT NULL THEN 'fourth_differs' ELSE 'none' END AS verdict
FROM x LEFT JOIN y USING (s, a, b, c, d, e) LEFT JOIN k4 ON x.s = k4.s AND x.a = k4.a AND x.b = k4.b AND x.c = k4.c AND x.d = k4.d LEFT JOIN k3 ON x.s = k3.s AND x.a = k3.a AND x.b = k3.b AND x.c = k3.c""")
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms paired on all five keys; without a partner the first key that differs is named."""
    names = {"s": "l_suppkey", "a": "l_returnflag", "b": "l_linestatus", "c": "l_tax", "d": "l_discount", "e": "l_quantity"}
    r = table(spark, sf_dir, "lineitem").select(*[F.col(c).alias(k) for k, c in names.items()], (F.col("l_linenumber") % 2).alias("side"), F.col("l_extendedprice").alias("v"))
    f = r.groupBy(*names, "side").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    x, y = f.filter("side = 1").drop("side"), f.filter("side = 0").select(*names, F.col("n").alias("m"), F.col("v").alias("w"))
    known = lambda *k: y.select(*k).distinct().withColumn(f"known{len(k)}", F.lit(True))
    j = x.join(y, list(names), "left").join(known("s", "a", "b", "c", "d"), ["s", "a", "b", "c", "d"], "left").join(known("s", "a", "b", "c"), ["s", "a", "b", "c"], "left")
    verdict = F.when(F.col("w").isNotNull() & (F.col("n") == 1) & (F.col("m") == 1), "paired").when(F.col("w").isNotNull(), "ambiguous").when(F.col("known5"), "fifth_differs").when(F.col("known4"), "fourth_differs").otherwise("none")
    return j.select(*names, F.round(F.col("v") - F.col("w"), 2).alias("delta"), verdict.alias("verdict"))


@query("""WITH t AS (SELECT c_nationkey, c_custkey, c_acctbal FROM customer), b AS (SELECT c_nationkey, arg_max(c_custkey, c_acctbal) AS best, max(c_acctbal) AS top FROM t GROUP BY 1), s AS (SELECT c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS siblings FROM t JOIN b USING (c_nationkey) WHERE c_custkey <> best GROUP BY 1)
SELECT c_nationkey, best, top, coalesce(siblings, '') AS siblings FROM b LEFT JOIN s USING (c_nationkey) ORDER BY top DESC LIMIT 5""")
def top_with_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-five report with one entity a repository, the others of it attached."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    top = c.groupBy("c_nationkey").agg(F.max_by("c_custkey", "c_acctbal").alias("best"), F.max("c_acctbal").alias("top")).orderBy(F.desc("top")).limit(5)
    others = c.join(F.broadcast(top), "c_nationkey").groupBy("c_nationkey", "best", "top").agg(F.array_sort(F.collect_list(F.when(F.col("c_custkey") != F.col("best"), F.col("c_custkey")))).alias("o"))
    return others.select("c_nationkey", "best", "top", F.array_join(F.col("o").cast("array<string>"), ",").alias("siblings"))


@query("""SELECT doc_id, n AS signals, h AS hedges, n - h > 0 AS counts FROM (SELECT doc_id, len(regexp_extract_all(text, '\\b(the|and)\\b')) AS n, len(regexp_extract_all(text, '\\b(or|of) (the|and)\\b')) AS h FROM documents)""")
def hedged_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a text, less those that a hedge stands before."""
    n, h = F.regexp_count("text", F.lit(r"\b(the|and)\b")), F.regexp_count("text", F.lit(r"\b(or|of) (the|and)\b"))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("signals"), h.cast("long").alias("hedges"), (n - h > 0).alias("counts"))


@query("""SELECT o_custkey, arg_min(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) FILTER (o_orderstatus = 'F') AS first_done, arg_min(o_orderpriority, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) FILTER (o_totalprice > 150000) AS first_large FROM orders GROUP BY o_custkey""")
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group, in the order of its members, the first member that has a value, for each field."""
    order = F.struct("o_orderdate", "o_orderkey")
    first = lambda c, has: F.min(F.when(has, F.struct(order.alias("at"), F.col(c).alias("v"))))["v"]
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(first("o_orderkey", F.col("o_orderstatus") == "F").alias("first_done"), first("o_orderpriority", F.col("o_totalprice") > 150000).alias("first_large"))


@query("""WITH r AS (SELECT l_orderkey, l_returnflag, l_suppkey % 3 AS seed, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_returnflag, count(*) AS seeds, round(avg(v), 6) AS mean, round(max(v) - min(v), 6) AS spread FROM r GROUP BY ALL""")
def seed_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores averaged within each seed, then over seeds."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", (F.col("l_suppkey") % 3).alias("seed")).agg(F.avg("l_quantity").alias("v"))
    return r.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v") - F.min("v"), 6).alias("spread"))


@query("""WITH k AS (SELECT p_partkey, lower(trim(p_brand)) AS name FROM part WHERE p_size <= 10), c AS (SELECT DISTINCT lower(trim(p_brand)) AS name FROM part WHERE p_size > 10) SELECT count(*) AS known, count(c.name) AS found, round(count(c.name) / count(*), 6) AS recall FROM k LEFT JOIN c USING (name)""")
def known_item_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of known items whose normal title the candidates have."""
    p = table(spark, sf_dir, "part").select(F.lower(F.trim("p_brand")).alias("name"), "p_size")
    j = p.filter("p_size <= 10").join(p.filter("p_size > 10").select(F.col("name").alias("c")).distinct(), F.col("name") == F.col("c"), "left")
    return j.agg(F.count(F.lit(1)).alias("known"), F.count("c").alias("found")).select("known", "found", F.round(F.col("found") / F.col("known"), 6).alias("recall"))


@query("""WITH m AS (SELECT o_orderpriority, year(o_orderdate) AS y, round(avg(o_totalprice), 4) AS v, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT o_orderpriority, arg_min(v, y) AS first, arg_max(v, y) AS last, min(n) AS least FROM m GROUP BY o_orderpriority)
SELECT o_orderpriority, CASE WHEN least < 30 THEN 'too_few' WHEN abs(last - first) <= 0.02 * abs(first) THEN 'flat' WHEN last > first THEN 'up' ELSE 'down' END AS verdict FROM e""")
def change_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a measure went up or down from its first year to its last, hardly changed, or rests on too few rows."""
    m = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"), F.count(F.lit(1)).alias("n"))
    e = m.groupBy("o_orderpriority").agg(F.min_by("v", "y").alias("first"), F.max_by("v", "y").alias("last"), F.min("n").alias("least"))
    a, b = F.col("first"), F.col("last")
    return e.select("o_orderpriority", F.when(F.col("least") < 30, "too_few").when(F.abs(b - a) <= 0.02 * F.abs(a), "flat").when(b > a, "up").otherwise("down").alias("verdict"))


@query()
def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring names that are alike to 85 of 100, whose digits agree and whose versions don't contradict."""
    from stratacell.operators.linkage import sorted_neighbours

    names = table(spark, sf_dir, "part").groupBy("p_type", F.concat_ws(" v", "p_name", (F.col("p_size") % 3).cast("string")).alias("name")).agg(F.min("p_partkey").alias("id"))
    pairs = sorted_neighbours(names, "id", "name", 5, F.col("p_type")).withColumn("ratio", N.ratio_udf("key_a", "key_b"))
    digits = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), ",")
    versions = [X.version_split(F.col(c))[1] for c in ("key_a", "key_b")]
    fits = (F.col("ratio") >= 85) & (digits("key_a") == digits("key_b")) & F.coalesce(versions[0] == versions[1], F.lit(True))
    return pairs.withColumn("match", fits).groupBy("match").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max("ratio"), 4).alias("best"))


@query("""WITH r AS (SELECT l_returnflag, l_suppkey, avg(l_discount) AS y FROM lineitem GROUP BY ALL), w AS (SELECT * FROM r UNION ALL SELECT 'all', l_suppkey, avg(l_discount) FROM lineitem GROUP BY l_suppkey) SELECT l_returnflag AS arm, count(*) AS n, round(avg(y), 6) AS mean, round(min(y), 6) AS low, round(max(y), 6) AS high FROM w GROUP BY 1""")
def united_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms of several origins in one table by name, extra columns of one filled with nothing."""
    li = table(spark, sf_dir, "lineitem")
    each = li.groupBy(F.col("l_returnflag").alias("arm"), "l_suppkey").agg(F.avg("l_discount").alias("y"))
    every = li.groupBy("l_suppkey").agg(F.avg("l_discount").alias("y"), F.count(F.lit(1)).alias("rows")).withColumn("arm", F.lit("all"))
    u = each.unionByName(every, allowMissingColumns=True)
    return u.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("mean"), F.round(F.min("y"), 6).alias("low"), F.round(F.max("y"), 6).alias("high"))
