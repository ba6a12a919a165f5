"""Queries of the served surface: flags, strata, schema, open cells, sheets, orders and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacell.functions import keys as K
from stratacell.functions import text as X
from stratacell.operators.windows import hash_unit
from stratacell.plans.keying import pick
from stratacell.plans.registry import query
from stratacell.plans.relations import HASH
from stratacell.session import table


@query("""SELECT c_custkey, CASE WHEN coalesce(f.flags, '') <> '' THEN f.flags ELSE c_mktsegment END AS flags FROM customer LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) FILTER (o_orderstatus <> 'O') AS flags FROM orders GROUP BY o_custkey) f ON o_custkey = c_custkey""")
def side_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the flags of a side table where it has some."""
    side = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ";").alias("flags"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return c.join(side, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.nullif("flags", F.lit("")), "c_mktsegment").alias("flags"))


@query("""WITH f AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1)
SELECT r.stratum, CASE WHEN f.n > r.n THEN f.n WHEN r.stratum = 'BUILDING' THEN 1000 ELSE 500 END AS size, CASE WHEN f.n > r.n THEN 'frame' WHEN r.stratum = 'BUILDING' THEN 'metadata' ELSE 'design' END AS origin FROM r LEFT JOIN f USING (stratum)""")
def strata_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratum's size from the first source that can give it: a frame larger than the release, metadata, or the design's constant."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stratum"), (F.col("c_custkey") % 3 == 0).alias("released"))
    both = c.groupBy("stratum").agg(F.count(F.lit(1)).alias("frame"), F.count_if("released").alias("n")).filter("n > 0")
    known = K.looked_up(F.col("stratum"), {"BUILDING": "1000"}).cast("long")
    size = F.when(F.col("frame") > F.col("n"), F.col("frame"))
    return both.select("stratum", F.coalesce(size, known, F.lit(500).cast("long")).alias("size"), F.when(size.isNotNull(), "frame").when(known.isNotNull(), "metadata").otherwise("design").alias("origin"))


@query("""SELECT s_suppkey, round(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE coalesce((SELECT avg(t.s_acctbal) FROM supplier t WHERE t.s_nationkey = s.s_nationkey AND t.s_acctbal > 0), (SELECT avg(t.s_acctbal) FROM supplier t WHERE t.s_acctbal > 0), 1) END, 4) AS weight FROM supplier s""")
def weights_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that are missing or not above 0 take the mean of their stratum's, else that of all, else 1; means are aggregated before they are joined."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("w"))
    own = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("w").alias("mean"))
    every = s.agg(F.avg("w").alias("all"))
    return s.join(own, F.col("s_nationkey") == F.col("k"), "left").crossJoin(F.broadcast(every)).select("s_suppkey", F.round(F.coalesce("w", "mean", "all", F.lit(1.0)), 4).alias("weight"))


#: The dimensions of the schema that queries describe, in order.
DIMENSIONS = (("brand", "identity", "enum"), ("type", "identity", "enum"), ("size", "measure", "int"), ("price", "measure", "float"))


def dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *d) for i, d in enumerate(DIMENSIONS, 1)], "ord int, key string, layer string, kind string")


@query("""WITH d(ord, key, layer, kind) AS (VALUES (1, 'brand', 'identity', 'enum'), (2, 'type', 'identity', 'enum'), (3, 'size', 'measure', 'int'), (4, 'price', 'measure', 'float')),
v AS (SELECT 'brand' AS key, count(DISTINCT p_brand) AS n, min(p_brand) AS least FROM part UNION ALL SELECT 'type', count(DISTINCT p_type), min(p_type) FROM part UNION ALL SELECT 'size', count(DISTINCT p_size), min(p_size)::VARCHAR FROM part UNION ALL SELECT 'price', count(DISTINCT p_retailprice), NULL FROM part)
SELECT ord, key, layer, kind, n, least FROM d JOIN v USING (key) WHERE (SELECT count(*) FROM part) > 0""")
def schema_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions in order with layer, kind, the number of their values and the least one."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", "p_retailprice")
    one = p.agg(*[F.countDistinct(c).alias(k) for c, k in (("p_brand", "brand"), ("p_type", "type"), ("p_size", "size"), ("p_retailprice", "price"))], F.min("p_brand").alias("least_brand"), F.min("p_type").alias("least_type"), F.min("p_size").cast("string").alias("least_size"))
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("n"), (F.col(f"least_{k}") if k != "price" else F.lit(None).cast("string")).alias("least")) for k, _, _ in DIMENSIONS])
    v = one.select(F.explode(parts).alias("v")).select("v.*").filter("n > 0")
    return dimensions(spark).join(v, F.col("key") == F.col("k")).select("ord", "key", "layer", "kind", "n", "least")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN '' WHEN 2 THEN c_mktsegment || '|' || c_nationkey ELSE c_nationkey::VARCHAR END AS value FROM customer""")
def value_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded values as text: lists by bars in their order, truth values in lower case, nothing for none."""
    c = table(spark, sf_dir, "customer")
    nation = F.col("c_nationkey").cast("string")
    listed = F.array_join(F.when(F.col("c_custkey") % 4 == 2, F.array("c_mktsegment", nation)).otherwise(F.array(nation)), "|")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lower((F.col("c_custkey") >= 0).cast("string"))).when(F.col("c_custkey") % 4 == 1, "").otherwise(listed).alias("value"))


@query("""WITH a AS (SELECT o_custkey AS k, o_orderpriority AS d, max(o_orderkey) AS v, bool_or(o_orderstatus = 'F') AS resolved FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_custkey AS k, o_orderpriority AS d, max(o_orderkey) AS v, bool_or(o_orderstatus = 'F') AS resolved FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
SELECT k AS o_custkey, d AS o_orderpriority, CASE WHEN a.k IS NULL OR (NOT a.resolved AND coalesce(b.resolved, false)) THEN b.v ELSE a.v END AS value, NOT (coalesce(a.resolved, false) OR coalesce(b.resolved, false)) AS open FROM a FULL JOIN b USING (k, d)""")
def open_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass replaces only what the first left unresolved; what neither resolved stays open."""
    o = table(spark, sf_dir, "orders").withColumn("pass", F.col("o_orderkey") % 2)
    side = lambda k, c: F.max(F.when(F.col("pass") == k, c))
    done = F.col("o_orderstatus") == "F"
    g = o.groupBy("o_custkey", "o_orderpriority").agg(side(0, F.col("o_orderkey")).alias("a"), side(1, F.col("o_orderkey")).alias("b"), F.coalesce(side(0, done), F.lit(False)).alias("ra"), F.coalesce(side(1, done), F.lit(False)).alias("rb"))
    return g.select("o_custkey", "o_orderpriority", F.when(F.col("a").isNull() | (~F.col("ra") & F.col("rb")), F.col("b")).otherwise(F.col("a")).alias("value"), (~(F.col("ra") | F.col("rb"))).alias("open"))


@query("""SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) THEN 'unknown_id' END, CASE WHEN l_returnflag = 'R' THEN 'bad_state' END, CASE WHEN l_returnflag = 'A' AND l_shipmode <> 'AIR' THEN 'no_evidence' END, CASE WHEN l_quantity > 45 THEN 'bad_minutes' END], lambda x: x IS NOT NULL)) AS issue FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, CASE WHEN l_suppkey % 2 = 0 THEN 'AIR' ELSE 'SHIP' END AS l_shipmode FROM lineitem)""")
def sheet_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All problems of a filled sheet, a row each: ids, states, evidence, minutes."""
    known = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("known"))
    rows = table(spark, sf_dir, "lineitem").join(known, F.col("l_partkey") == F.col("known"), "left")
    found = F.array_compact(F.array(F.when(F.col("known").isNull(), "unknown_id"), F.when(F.col("l_returnflag") == "R", "bad_state"), F.when((F.col("l_returnflag") == "A") & (F.col("l_suppkey") % 2 != 0), "no_evidence"), F.when(F.col("l_quantity") > 45, "bad_minutes")))
    return rows.select("l_orderkey", "l_linenumber", F.explode(found).alias("issue"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' WHEN 2 THEN 'exclude' WHEN 3 THEN 'include' WHEN 4 THEN 'exclude' ELSE 'unknown' END AS decision FROM orders""")
def decision_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", K.decision(pick("o_orderkey", "Included", "Excluded (title)", "not passed: FAIL", " yes ", "no", None, "maybe")).alias("decision"))


@query("""WITH s AS (SELECT p_brand, avg((p_size % 4 = 0)::INT) AS silence FROM part WHERE p_brand <> 'Brand#1' GROUP BY p_brand) SELECT p_partkey, p_brand, round(silence, 6) AS silence, row_number() OVER (PARTITION BY p_type ORDER BY silence DESC NULLS LAST, p_partkey) AS place FROM part LEFT JOIN s USING (p_brand) WHERE p_size % 4 = 0""")
def silence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent cells of each entity, those of the most silent field first; a field without a rate last."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    s = p.filter("p_brand <> 'Brand#1'").groupBy(F.col("p_brand").alias("b")).agg(F.avg((F.col("p_size") % 4 == 0).cast("int")).alias("silence"))
    j = p.filter("p_size % 4 = 0").join(s, F.col("p_brand") == F.col("b"), "left")
    place = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc_nulls_last("silence"), "p_partkey")).cast("long")
    return j.select("p_partkey", "p_brand", F.round("silence", 6).alias("silence"), place.alias("place"))


@query("""SELECT o_orderpriority, n, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 9 END, o_orderpriority) AS place FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def vocabulary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the order of a fixed vocabulary, others after it by name; a row a group."""
    words = ("3-MEDIUM", "1-URGENT", "2-HIGH")
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    at = F.coalesce(K.looked_up(F.col("o_orderpriority"), {w: str(i) for i, w in enumerate(words, 1)}).cast("int"), F.lit(9))
    return g.withColumn("place", F.row_number().over(Window.orderBy(at, "o_orderpriority")).cast("long"))


@query(f"""SELECT item_id, CASE WHEN {HASH.format('pool', 'item_id')} < 0.5 THEN 'main' ELSE 'held' END AS pool, row_number() OVER (PARTITION BY {HASH.format('pool', 'item_id')} < 0.5 ORDER BY {HASH.format('order', 'item_id')}, item_id) AS place FROM benchmark WHERE item_id NOT IN (SELECT turn FROM conversations)""")
def instance_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances in two pools by hash, each in a fixed order, without those that a pilot used."""
    used = table(spark, sf_dir, "conversations").select(F.col("turn").cast("long").alias("used")).distinct()
    b = table(spark, sf_dir, "benchmark").select("item_id").join(used, F.col("item_id") == F.col("used"), "left_anti")
    b = b.select("item_id", F.when(hash_unit("pool", F.col("item_id")) < 0.5, "main").otherwise("held").alias("pool"), hash_unit("order", F.col("item_id")).alias("u"))
    return b.select("item_id", "pool", F.row_number().over(Window.partitionBy("pool").orderBy("u", "item_id")).cast("long").alias("place"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN round(sqrt(s_acctbal), 4) END AS root FROM supplier""")
def rounded_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four digits; what is not a number is nothing."""
    x = F.sqrt("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.when(~F.isnan(x), x), 4).alias("root"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber AS i, l_suppkey % 3 AS code FROM lineitem), g AS (SELECT l_orderkey, code, count(*) AS n, min(i) AS first FROM v GROUP BY ALL), b AS (SELECT l_orderkey, arg_max(code, n * 100 - first + code / 10.0) AS code, max(n * 100 - first) AS score, sum(n) AS total FROM g GROUP BY l_orderkey), l AS (SELECT l_orderkey, arg_max(code, i * 10 + code) AS last FROM v GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN (score + 99) // 100 > 1 THEN 'x = ' || code ELSE 'x = ' || last END AS code, CASE WHEN (score + 99) // 100 > 1 THEN 'majority(' || ((score + 99) // 100) || '/' || total || ')' ELSE 'last' END AS how FROM b JOIN l USING (l_orderkey)""")
def code_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest group of attempts that are the same code (comments and space aside), the earliest of equals; if all differ the last attempt."""
    raw = F.concat(F.lit("\n# attempt "), F.col("l_linenumber").cast("string"), F.lit("\nx = "), (F.col("l_suppkey") % 3).cast("string"), F.lit("  # note\n"))
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"), K.plain_code(raw).alias("code"))
    g = v.groupBy("l_orderkey", "code").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max("i").alias("end"))
    b = g.groupBy("l_orderkey").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "code")).alias("best"), F.max_by("code", F.struct("end", "code")).alias("last"), F.sum("n").alias("total"))
    most = F.col("best.n") > 1
    return b.select("l_orderkey", F.when(most, F.col("best.code")).otherwise(F.col("last")).alias("code"), F.when(most, F.format_string("majority(%d/%d)", "best.n", "total")).otherwise("last").alias("how"))


@query("""SELECT conv_id, 'TITLE: ' || conv_id || chr(10) || 'OPENING: ' || trim(regexp_replace(left(body, 700), '\\s+', ' ', 'g')) || chr(10) || body AS text, length('TITLE: ' || conv_id || chr(10) || 'OPENING: ' || trim(regexp_replace(left(body, 700), '\\s+', ' ', 'g')) || chr(10) || body)::INT AS chars FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)""")
def window_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, opening (700 characters of the body on one line, which is the format) and the whole body, with its length."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(body.alias("body"))
    text = F.concat_ws("\n", F.concat(F.lit("TITLE: "), F.col("conv_id").cast("string")), F.concat(F.lit("OPENING: "), F.trim(F.regexp_replace(F.substring("body", 1, 700), r"\s+", " "))), "body")
    return c.select("conv_id", text.alias("text"), F.length(text).alias("chars"))


@query("""SELECT item_id, '"' || text || '" (line ' || item_id || ')' AS evidence, CASE WHEN item_id % 2 = 0 THEN 'https://example.org/blob/main/a.py#L' || item_id ELSE 'a.py' END AS link FROM benchmark""")
def evidence_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id").cast("string")
    place = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("a.py:"), n)).otherwise("a.py")
    link = F.when(place.rlike(r":\d+$"), F.regexp_replace(place, r"^(.*):(\d+)$", "https://example.org/blob/main/$1#L$2")).otherwise(place)
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit('"'), "text", F.lit('" (line '), n, F.lit(")")).alias("evidence"), link.alias("link"))


@query("""SELECT o_orderkey, 'TY  - JOUR' || chr(10) || 'ID  - ' || o_orderkey || chr(10) || CASE WHEN o_orderstatus <> 'P' THEN 'AU  - ' || c_name || chr(10) ELSE '' END || 'PY  - ' || year(o_orderdate) || chr(10) || 'ER  - ' AS record FROM orders JOIN customer ON o_custkey = c_custkey""")
def reference_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the tagged format of reference managers; a missing author has no line."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    line = lambda tag, c: F.concat(F.lit(f"{tag}  - "), c.cast("string"))
    return o.select("o_orderkey", F.concat_ws("\n", F.lit("TY  - JOUR"), line("ID", F.col("o_orderkey")), line("AU", F.when(F.col("o_orderstatus") != "P", F.col("c_name"))), line("PY", F.year("o_orderdate")), F.lit("ER  - ")).alias("record"))


@query("""SELECT n_name, count(*) AS suppliers, round(avg(s_acctbal), 4) AS mean, max(s_acctbal) FILTER (s_suppkey % 3 = 0) AS stars FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def compact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served rows: a struct of what a client needs; stars only where they are coded."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))
    g = s.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.avg("s_acctbal").alias("m"), F.max(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal"))).alias("x"))
    served = F.struct(F.col("n").alias("suppliers"), F.round("m", 4).alias("mean"), F.col("x").alias("stars"))
    return g.select("n_name", served.alias("row")).select("n_name", "row.*")


@query("""SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+$', ''), '^\\s+', '') = '' AS blank, length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS squashed FROM documents""")
def blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.regexp_replace("text", r"^\s+|\s+$", "") == "").alias("blank"), F.length(X.squash(F.col("text"))).cast("long").alias("squashed"))
