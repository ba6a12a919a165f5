"""Queries on coded, silent and unresolved cells: documents with their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacell.operators import states as S
from stratacell.operators.estimates import weighted_ratio
from stratacell.operators.windows import hash_unit
from stratacell.plans.registry import query
from stratacell.session import table

DIMENSIONS = ("quality", "toxic")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their texts, and labels where there are any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (F.coalesce(F.length("text"), F.lit(0)) == 0).alias("is_empty"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), *DIMENSIONS)
    return docs.join(labels, F.col("doc_id") == F.col("labelled"), "left")


def long_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = entities(spark, sf_dir)
    values: dict[str, Column] = {d: F.col(d) for d in DIMENSIONS}
    long = S.cells(own, "doc_id", values, {d: F.col("labelled").isNull() for d in DIMENSIONS}, F.col("is_empty"))
    return long.select("doc_id", "lang", "source", "n_chars", "dimension", "state", "value")


CELLS = """
e AS (
  SELECT d.doc_id, lang, source, n_chars, coalesce(length(text), 0) = 0 AS is_empty, l.doc_id AS labelled, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), u AS (
  SELECT doc_id, lang, source, n_chars, is_empty, labelled, 'quality' AS dimension, quality AS v FROM e
  UNION ALL SELECT doc_id, lang, source, n_chars, is_empty, labelled, 'toxic', toxic FROM e
), cells AS (
  SELECT doc_id, lang, source, n_chars, dimension,
         CASE WHEN is_empty THEN 'unresolved' WHEN labelled IS NULL THEN 'not_reported' WHEN v IS NULL THEN 'unresolved' ELSE 'coded' END AS state,
         CASE WHEN NOT is_empty AND labelled IS NOT NULL THEN v::VARCHAR END AS value
  FROM u
)"""


@query(f"WITH {CELLS} SELECT dimension, lang, count(*) FILTER (state = 'coded') AS coded, count(*) FILTER (state = 'not_reported') AS not_reported, count(*) FILTER (state = 'unresolved') AS unresolved FROM cells GROUP BY ALL")
def three_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.state_counts(long_cells(spark, sf_dir), "dimension", "lang")


@query(f"WITH {CELLS} SELECT doc_id, max(value) FILTER (dimension = 'quality') AS quality, max(state) FILTER (dimension = 'quality') AS quality_state, max(value) FILTER (dimension = 'toxic') AS toxic, max(state) FILTER (dimension = 'toxic') AS toxic_state FROM cells GROUP BY doc_id")
def wide_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.wide(long_cells(spark, sf_dir), "doc_id", list(DIMENSIONS))


@query(f"""WITH {CELLS} SELECT lang, dimension, grouping(lang)::INT * 2 + grouping(dimension)::INT AS level, count(*) FILTER (state <> 'unresolved') AS base, count(*) FILTER (state = 'not_reported') AS silent,
round(count(*) FILTER (state = 'not_reported') / nullif(count(*) FILTER (state <> 'unresolved'), 0), 6) AS rate FROM cells GROUP BY GROUPING SETS ((lang), (dimension), (lang, dimension), ())""")
def under_reporting_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_cells(spark, sf_dir).createOrReplaceTempView("stratacell_cells")
    return spark.sql(
        """SELECT lang, dimension, cast(grouping(lang) AS int) * 2 + cast(grouping(dimension) AS int) AS level, count_if(state <> 'unresolved') AS base, count_if(state = 'not_reported') AS silent,
        round(try_divide(count_if(state = 'not_reported'), count_if(state <> 'unresolved')), 6) AS rate FROM stratacell_cells GROUP BY GROUPING SETS ((lang), (dimension), (lang, dimension), ())"""
    )


#: A unit's weight from a hash sample: about half of the documents are in it, each with its stratum's size over its sampled size.
def sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = entities(spark, sf_dir).withColumn("drawn", hash_unit("frame", F.col("doc_id")) < 0.5)
    sizes = own.groupBy(F.col("source").alias("stratum")).agg(F.count(F.lit(1)).alias("size"), F.count_if("drawn").alias("nh"))
    units = own.filter("drawn").join(sizes.withColumnRenamed("stratum", "s"), F.col("source").eqNullSafe(F.col("s")))
    return units.withColumn("weight", F.col("size") / F.col("nh")), sizes.select("stratum", "size")


SAMPLED = """
e AS (
  SELECT d.doc_id, lang, source, n_chars, coalesce(length(text), 0) = 0 AS is_empty, l.doc_id AS labelled, quality, toxic,
         ('0x' || substr(sha256('frame:' || d.doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE / 281474976710655.0::DOUBLE < 0.5 AS drawn
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), sizes AS (
  SELECT source AS stratum, count(*)::DOUBLE AS size, count(*) FILTER (drawn) AS nh FROM e GROUP BY source
), s AS (
  SELECT e.*, size / nh AS w, source AS stratum, (labelled IS NULL AND NOT is_empty)::INT::DOUBLE AS y, (NOT is_empty)::INT::DOUBLE AS x
  FROM e JOIN sizes ON e.source = sizes.stratum WHERE drawn
), base AS (SELECT * FROM s WHERE w > 0 AND x > 0)"""


def ratio_sql(by: str) -> str:
    on, part = (f"USING ({by})", f"{by},") if by else ("ON true", "")
    return f"""WITH {SAMPLED}, r AS (
  SELECT {part} sum(w * y) / sum(w * x) AS ratio, count(*) AS n FROM base {"GROUP BY " + by if by else ""}
), h AS (
  SELECT {part.replace(by, "base." + by) if by else ""} stratum, var_samp(y - ratio * x) AS s2, count(*) AS nh, sum(x) AS xh FROM base JOIN r {on} GROUP BY {part.replace(by, "base." + by) if by else ""} stratum
), v AS (
  SELECT {part} sum(greatest(CASE WHEN h.nh > 1 THEN size * size * (1 - h.nh / size) * s2 / h.nh ELSE 0 END, 0)) / (sum(size * xh / h.nh) ** 2) AS variance FROM h JOIN sizes USING (stratum) {"GROUP BY " + by if by else ""}
)
SELECT {part} n, round(ratio, 6) AS ratio, round(sqrt(variance), 6) AS se FROM r JOIN v {on}"""


def _ratio(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    units, sizes = sampled(spark, sf_dir)
    y, x = F.col("labelled").isNull() & ~F.col("is_empty"), ~F.col("is_empty")
    return weighted_ratio(units, y.cast("int"), x.cast("int"), F.col("weight"), F.col("source"), sizes, by)


@query(ratio_sql("lang"))
def under_reporting_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratio(spark, sf_dir, "lang")


@query(ratio_sql(""))
def weighted_ratio_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratio(spark, sf_dir)


@query(f"""WITH {SAMPLED}, h AS (SELECT stratum, avg(y) AS p, count(*) AS nh FROM s GROUP BY stratum)
SELECT round(sum(size * p) / sum(size), 6) AS share, round(sqrt(sum(CASE WHEN h.nh > 1 THEN size * size * (1 - h.nh / size) * p * (1 - p) / (h.nh - 1) ELSE 0 END)) / sum(size), 6) AS se FROM h JOIN sizes USING (stratum)""")
def weighted_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, sizes = sampled(spark, sf_dir)
    y = (F.col("labelled").isNull() & ~F.col("is_empty")).cast("double")
    own = units.groupBy(F.col("source").alias("stratum")).agg(F.avg(y).alias("p"), F.count(F.lit(1)).alias("n")).join(sizes, "stratum")
    size = F.col("size").cast("double")
    term = F.when(F.col("n") > 1, size * size * (1 - F.col("n") / size) * F.col("p") * (1 - F.col("p")) / (F.col("n") - 1)).otherwise(0.0)
    return own.agg(F.round(F.sum(size * F.col("p")) / F.sum(size), 6).alias("share"), F.round(F.sqrt(F.sum(term)) / F.sum(size), 6).alias("se"))


@query(f"WITH {CELLS} SELECT dimension, count(*) AS cells, count(*) FILTER (state = 'not_reported') AS silent, round(count(*) FILTER (state = 'not_reported') / count(*), 6) AS rate FROM cells GROUP BY dimension")
def not_reported_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    silent = F.count_if(F.col("state") == S.SILENT)
    return long_cells(spark, sf_dir).groupBy("dimension").agg(F.count(F.lit(1)).alias("cells"), silent.alias("silent"), F.round(silent / F.count(F.lit(1)), 6).alias("rate"))


@query(f"""WITH {CELLS}, v AS (SELECT unnest(['0', '1', '2']) AS value), k AS (SELECT DISTINCT dimension FROM cells), c AS (SELECT dimension, value, count(*) AS n FROM cells WHERE state = 'coded' GROUP BY ALL), t AS (SELECT dimension, sum(n) AS total FROM c GROUP BY dimension)
SELECT dimension, value, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 6) AS share FROM k CROSS JOIN v LEFT JOIN c USING (dimension, value) JOIN t USING (dimension)""")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares among coded cells, with a row of zero for a declared value that no cell has."""
    coded = long_cells(spark, sf_dir).filter(F.col("state") == S.CODED)
    counts = coded.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("dimension").agg(F.sum("n").alias("total"))
    declared = totals.select("dimension", "total", F.explode(F.array(*[F.lit(v) for v in ("0", "1", "2")])).alias("value"))
    out = declared.join(counts, ["dimension", "value"], "left")
    return out.select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("share"))


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(DISTINCT lang) FROM documents) AS langs, (SELECT count(*) FROM labels) AS labels""")
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))
    return docs.crossJoin(table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("labels")))


@query("""SELECT issue, count(*) AS n FROM (
  SELECT 'duplicate_id' AS issue FROM documents GROUP BY doc_id HAVING count(*) > 1
  UNION ALL SELECT 'unknown_document' FROM labels l ANTI JOIN documents d USING (doc_id)
  UNION ALL SELECT 'unknown_order' FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'no_line' FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey
) GROUP BY issue""")
def integrity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    mark = lambda df, name: df.select(F.lit(name).alias("issue"))
    twice = t("documents").groupBy("doc_id").count().filter("count > 1")
    unknown = t("labels").select("doc_id").join(t("documents").select("doc_id"), "doc_id", "left_anti")
    lines, orders = t("lineitem").select("l_orderkey"), t("orders").select("o_orderkey")
    on = F.col("l_orderkey") == F.col("o_orderkey")
    every = mark(twice, "duplicate_id").union(mark(unknown, "unknown_document")).union(mark(lines.join(orders, on, "left_anti"), "unknown_order")).union(mark(orders.join(lines, on, "left_anti"), "no_line"))
    return every.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS no_key, count(*) FILTER (try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS not_number,
count(*) FILTER (try_cast(event_type AS BIGINT) IS NULL) AS not_castable FROM events""")
def cast_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    bad = lambda c: F.count_if(c.try_cast("long").isNull())
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.count_if(k.isNull()).alias("no_key"), bad(k).alias("not_number"), bad(F.col("event_type")).alias("not_castable"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END], lambda x: x IS NOT NULL), '|') AS flags,
coalesce(CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END) AS reason FROM orders""")
def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (("large", F.col("o_totalprice") > 300000), ("urgent", F.col("o_orderpriority").startswith("1")), ("open", F.col("o_orderstatus") == "O"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(S.flags(*rules), "|").alias("flags"), S.first_reason(*rules).alias("reason"))


@query("""WITH r AS (SELECT p_partkey, CASE WHEN lower(p_brand) = 'brand#1' THEN 0 WHEN starts_with(lower(p_brand), 'brand#1') THEN 1 WHEN contains(lower(p_brand), 'brand#1') THEN 2 WHEN contains(lower(p_type), 'brand#1') THEN 3 END AS rank FROM part)
SELECT p_partkey, rank, count(*) OVER () AS total FROM r WHERE rank IS NOT NULL ORDER BY rank, p_partkey LIMIT 20""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits (a top-k report) with the number of all hits."""
    hits = table(spark, sf_dir, "part").select("p_partkey", S.text_rank("brand#1", F.array("p_brand"), F.col("p_type")).alias("rank")).filter("rank IS NOT NULL")
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy("rank", "p_partkey").limit(20).crossJoin(F.broadcast(total))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1995-03' AND '1996-02' GROUP BY month""")
def date_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf_dir, "orders").select(month.alias("month")).filter(S.date_window(F.col("month"), "1995-03", "1996-02")).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment, count(*) FILTER (c_acctbal >= 5000) AS at_least, count(*) FILTER (c_acctbal < 0) AS below, count(*) FILTER (lower(c_name) LIKE '%00001%') AS named FROM customer GROUP BY c_mktsegment""")
def value_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance, name = F.col("c_acctbal"), F.col("c_name")
    return (
        table(spark, sf_dir, "customer")
        .groupBy("c_mktsegment")
        .agg(F.count_if(S.value_predicate("integer", balance, ">=5000")).alias("at_least"), F.count_if(S.value_predicate("integer", balance, "<0")).alias("below"), F.count_if(S.value_predicate("string", name, "00001")).alias("named"))
    )


@query("""WITH w AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN coalesce(spent, 0) >= 2000000 OR c_mktsegment = 'BUILDING' THEN 'H' WHEN coalesce(n, 0) >= 12 THEN 'P' ELSE 'O' END AS stratum FROM customer LEFT JOIN w ON c_custkey = o_custkey""")
def stratum_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("spent"))
    own = table(spark, sf_dir, "customer").join(w, F.col("c_custkey") == F.col("o_custkey"), "left")
    high = (F.coalesce("spent", F.lit(0.0)) >= 2000000) | (F.col("c_mktsegment") == "BUILDING")
    return own.select("c_custkey", F.when(high, "H").when(F.coalesce("n", F.lit(0)) >= 12, "P").otherwise("O").alias("stratum"))


@query("""WITH a AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS first, bool_or(l_linestatus = 'O') AS second, bool_or(l_quantity > 45) AS third FROM lineitem GROUP BY l_orderkey)
SELECT rule, decision, count(*) AS n FROM (SELECT CASE WHEN first = second THEN 'agree' WHEN third THEN 'third_include' ELSE 'third_exclude' END AS rule, CASE WHEN first = second THEN first ELSE third END AS decision FROM a) GROUP BY ALL""")
def adjudicated_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two votes that agree decide; else a third does."""
    votes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_linestatus") == "O").alias("b"), F.bool_or(F.col("l_quantity") > 45).alias("c"))
    same = F.col("a") == F.col("b")
    out = votes.select(F.when(same, "agree").when(F.col("c"), "third_include").otherwise("third_exclude").alias("rule"), F.when(same, F.col("a")).otherwise(F.col("c")).alias("decision"))
    return out.groupBy("rule", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type AS raw, CASE lower(trim(event_type)) WHEN 'value' THEN 'coded' WHEN 'silent' THEN 'not_reported' END AS state, count(*) AS n FROM events GROUP BY ALL""")
def normalised_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("raw"), S.normal_state(F.col("event_type")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN coalesce(length(text), 0) = 0 THEN 'unresolved' ELSE 'coded' END AS state FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id + 300""")
def four_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.length("text").alias("n"))
    own = table(spark, sf_dir, "labels").join(docs, F.col("d") == F.col("doc_id") + 300, "left")
    value = F.when(F.col("n") > 0, F.lit("x"))
    return own.select("doc_id", S.four_state(F.col("d").isNotNull(), value, F.lit(False), F.lit(False)).alias("state"))


@query("""SELECT doc_id, quality, toxic, CASE WHEN quality = 1 AND toxic = 0 THEN 'include' WHEN toxic = 1 THEN 'exclude' ELSE 'undecided' END AS decision, CASE WHEN doc_id % 10 = 0 THEN 'human' ELSE 'auto' END AS decided_by FROM labels""")
def overridden_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.when((q == 1) & (t == 0), "include").when(t == 1, "exclude").otherwise("undecided").alias("decision"), F.when(F.col("doc_id") % 10 == 0, "human").otherwise("auto").alias("decided_by"))
