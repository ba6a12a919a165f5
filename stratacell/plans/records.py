"""Queries on records: rule chains, evidence, attribution, panels by parameter, nearest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacell.functions import text as X
from stratacell.operators import estimates as E
from stratacell.operators import linkage as L
from stratacell.operators.windows import group_rank, hash_unit
from stratacell.plans.registry import query
from stratacell.plans.relations import HASH
from stratacell.session import table


@query("""SELECT page_id, (regexp_matches(url, 'example\\.(com|org)') AND regexp_matches(url, '/(en|fr)/')) OR regexp_matches(url, 'spam|pills') AS admitted FROM pages""")
def boolean_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks of terms that must both hit, or a strong term that waives them."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", ((url.rlike(r"example\.(com|org)") & url.rlike("/(en|fr)/")) | url.rlike("spam|pills")).alias("admitted"))


@query("""SELECT doc_id, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN n_chars < 60 THEN 'short' WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) * 10 < length(text) * 5 THEN 'not_ascii' WHEN lang <> 'en' THEN 'language' ELSE 'pass' END AS rule FROM documents""")
def hard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a record fails."""
    text = F.col("text")
    ascii_share = F.length(F.regexp_replace(text, "[^A-Za-z]", "")) * 10 < F.length(text) * 5
    rule = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(F.col("n_chars") < 60, "short").when(ascii_share, "not_ascii").when(F.col("lang") != "en", "language").otherwise("pass")
    return table(spark, sf_dir, "documents").select("doc_id", rule.alias("rule"))


@query("""SELECT rule, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT unnest(string_split(r, '|')) AS rule FROM (SELECT concat_ws('|', CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_quantity < 10 THEN 'few' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS r FROM lineitem) WHERE r <> '') GROUP BY rule""")
def reason_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons of each row, counted; the total comes from the few counts."""
    reasons = F.array_compact(F.array(F.when(F.col("l_discount") > 0.08, "discount"), F.when(F.col("l_quantity") < 10, "few"), F.when(F.col("l_returnflag") == "R", "returned")))
    n = table(spark, sf_dir, "lineitem").select(F.explode(reasons).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("rule", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("""SELECT event_id, CASE WHEN d[1] <> d[2] THEN 'differs' ELSE 'same' END AS verdict, d[1] AS first FROM (SELECT event_id, regexp_extract_all(lpad(value::INT::VARCHAR, 4, '0'), '[0-9]') AS d FROM events)""")
def digits_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.regexp_extract_all(F.lpad(F.bround("value", 0).cast("int").cast("string"), 4, "0"), F.lit("[0-9]"), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", F.when(d[0] != d[1], "differs").otherwise("same").alias("verdict"), d[0].alias("first"))


@query("""SELECT item_id, text AS quote, 'lines ' || item_id || ' (a (b))' AS locator FROM benchmark""")
def evidence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote and the locator after it, in the last parentheses that balance."""
    s = F.concat("text", F.lit(" (lines "), F.col("item_id").cast("string"), F.lit(" (a (b)))"))
    quote, locator = X.evidence_split(s)
    return table(spark, sf_dir, "benchmark").select("item_id", quote.alias("quote"), locator.alias("locator"))


@query("""SELECT doc_id, coalesce(try_cast(regexp_extract(text, '\\b((19|20)[0-9]{2})\\b', 1) AS BIGINT), 1990 + doc_id % 7) AS year, CASE WHEN regexp_matches(text, '\\b(19|20)[0-9]{2}\\b') THEN 'text' ELSE 'id' END AS origin FROM documents""")
def preferred_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract("text", r"\b((19|20)[0-9]{2})\b", 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(found.try_cast("long"), 1990 + F.col("doc_id") % 7).alias("year"), F.when(found != "", "text").otherwise("id").alias("origin"))


@query("""WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey), b AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS w FROM lineitem WHERE l_linenumber > 3 GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN v IS NULL OR w IS NULL THEN 'silent_vs_value' WHEN v = w THEN 'same' WHEN list_has_any(v, w) THEN 'partial' ELSE 'disjoint' END AS kind FROM a FULL JOIN b USING (l_orderkey)""")
def disagreement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two codings of a multi-valued cell differ, from one aggregate over both."""
    side = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_returnflag"))))
    first = F.col("l_linenumber") <= 3
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(side(first).alias("v"), side(~first).alias("w"))
    kind = F.when((F.size("v") == 0) | (F.size("w") == 0), "silent_vs_value").when(F.col("v") == F.col("w"), "same").when(F.arrays_overlap("v", "w"), "partial").otherwise("disjoint")
    return own.select("l_orderkey", kind.alias("kind"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber <= 3 AS first, list(DISTINCT l_returnflag) AS s FROM lineitem GROUP BY ALL), p AS (SELECT a.l_orderkey, a.s AS a, b.s AS b FROM v a JOIN v b ON a.l_orderkey = b.l_orderkey AND a.first AND NOT b.first),
u AS (SELECT x, list_contains(a, x) AS a, list_contains(b, x) AS b FROM p, (SELECT unnest(['A', 'N', 'R']) AS x)), c AS (SELECT x, count(*) AS n, avg((a = b)::INT) AS po, avg(a::INT) AS pa, avg(b::INT) AS pb FROM u GROUP BY x)
SELECT x AS value, n, round((po - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0), 6) AS kappa FROM c""")
def multilabel_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa of each value's presence in two codings."""
    side = lambda c: F.collect_set(F.when(c, F.col("l_returnflag")))
    first = F.col("l_linenumber") <= 3
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(side(first).alias("a"), side(~first).alias("b")).filter("size(a) > 0 AND size(b) > 0")
    each = own.select(F.explode(F.array(*[F.struct(F.lit(x).alias("value"), F.array_contains("a", x).alias("a"), F.array_contains("b", x).alias("b")) for x in "ANR"])).alias("u")).select("u.*")
    return E.kappa(each, "a", "b", by=("value",)).select("value", F.col("n").cast("long").alias("n"), "kappa")


@query("""SELECT e.event_id, arg_max(c.event_id, c.ts) AS nearest FROM events e LEFT JOIN events c ON c.user_id = e.user_id AND c.event_type = 'click' AND c.ts < e.ts AND c.ts >= e.ts - INTERVAL 2 HOUR WHERE e.event_type = 'purchase' GROUP BY e.event_id""")
def nearest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An as-of join within reach by one sort: the last click carried along each user's events, with no pairs made."""
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 1).otherwise(0), "event_id")
    click = F.when(F.col("event_type") == "click", F.struct("event_id", "ts"))
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase"))
    last = e.withColumn("c", F.last(click, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("event_type = 'purchase'")
    near = (F.col("c.ts") < F.col("ts")) & (F.col("c.ts") >= F.col("ts") - F.expr("INTERVAL 2 HOURS"))
    return last.select("event_id", F.when(near, F.col("c.event_id")).alias("nearest"))


@query("""SELECT p_type, CASE WHEN n < 4 THEN '(rare)' ELSE p_name END AS name, sum(n)::BIGINT AS n FROM (SELECT p_type, p_name, count(*) AS n FROM part GROUP BY ALL) GROUP BY ALL""")
def rare_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").groupBy("p_type", "p_name").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("p_type", F.when(F.col("n") < 4, "(rare)").otherwise(F.col("p_name")).alias("name")).agg(F.sum("n").alias("n"))


@query("""WITH a AS (SELECT unnest(['small', 'red', 'blue', 'large']) AS alias, unnest(['size', 'colour', 'colour', 'size']) AS kind) SELECT p_partkey, min(kind) AS kind, count(alias) AS hits FROM part LEFT JOIN a ON contains(' ' || p_name || ' ', ' ' || alias || ' ') GROUP BY p_partkey""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a name looked up in a small alias table by equality, not by containment."""
    aliases = spark.sql("SELECT * FROM VALUES ('small', 'size'), ('red', 'colour'), ('blue', 'colour'), ('large', 'size') AS t(alias, kind)")
    w = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    return w.join(F.broadcast(aliases), F.col("w") == F.col("alias"), "left").groupBy("p_partkey").agg(F.min("kind").alias("kind"), F.count("alias").alias("hits"))


@query("""SELECT p_partkey, contains(' ' || p_name || ' ', ' widget ') OR contains(' widget ', ' ' || p_name || ' ') AS own FROM part""")
def token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", L.contains_tokens(F.col("p_name"), F.lit("widget")).alias("own"))


@query("""SELECT doc_id, w AS mention, count(*) AS n, min(pos) AS first FROM (SELECT doc_id, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\\b(idiot|clown|example|token)\\b') AS x FROM documents)) GROUP BY ALL""")
def mention_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names in one pass over each text."""
    x = F.regexp_extract_all("text", F.lit(r"\b(idiot|clown|example|token)\b"), F.lit(0))
    m = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(x).alias("pos", "mention"))
    return m.groupBy("doc_id", "mention").agg(F.count(F.lit(1)).alias("n"), (F.min("pos") + 1).cast("long").alias("first"))


@query("""SELECT conv_id, turn, instr(text, 'the ') > 0 AS found, CASE WHEN instr(text, 'the ') > 0 THEN substr(text, instr(text, 'the '), 4) = 'the ' ELSE false END AS verified FROM conversations""")
def span_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.instr("text", "the ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (at > 0).alias("found"), F.coalesce((at > 0) & (F.substring("text", at, F.lit(4)) == "the "), F.lit(False)).alias("verified"))


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), v AS (SELECT unnest([5, 10, 15]) AS least) SELECT least, count(*) FILTER (n >= least) AS admitted, count(*) FILTER (n >= least AND o_custkey % 10 = 0) AS reference_kept, count(*) FILTER (n < least AND o_custkey % 10 = 0) AS reference_lost FROM n, v GROUP BY least""")
def frame_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission under several thresholds in one aggregate, turned to rows at the end."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("o_custkey") % 10 == 0
    rows = [F.struct(F.lit(k).alias("least"), F.count_if(F.col("n") >= k).alias("admitted"), F.count_if((F.col("n") >= k) & known).alias("reference_kept"), F.count_if((F.col("n") < k) & known).alias("reference_lost")) for k in (5, 10, 15)]
    return n.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@query("""SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(DISTINCT o_custkey) FROM orders) AS ordering, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 3)) AS keyed, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12)) AS comparable""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested populations from one aggregate by key."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("p"), F.count(F.lit(1)).alias("n"))
    own = per.agg(F.count(F.lit(1)).alias("ordering"), F.count_if(F.col("p") >= 3).alias("keyed"), F.count_if(F.col("n") >= 12).alias("comparable"))
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("customers")).crossJoin(own)


@query("""SELECT p_brand, count(*) AS parts, count(DISTINCT l_orderkey) AS orders, round(count(DISTINCT l_orderkey) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS share FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand""")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    total = lines.agg(F.countDistinct("l_orderkey").alias("total"))
    own = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.countDistinct("l_orderkey").alias("orders"))
    return own.crossJoin(F.broadcast(total)).select("p_brand", "parts", "orders", F.round(F.col("orders") / F.col("total"), 6).alias("share"))


@query("""SELECT event_type AS source, count(*) FILTER (value < 20) AS low, count(*) FILTER (value >= 20) AS high, round(median(value), 6) AS median FROM events GROUP BY event_type""")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count_if(v < 20).alias("low"), F.count_if(v >= 20).alias("high"), F.round(F.median(v), 6).alias("median"))


@query("""SELECT stage, left_side, right_side, left_side = right_side AS holds FROM (SELECT 'documents' AS stage, (SELECT count(*) FROM documents) AS left_side, (SELECT count(*) FROM documents SEMI JOIN labels USING (doc_id)) + (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS right_side)""")
def flow_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    n = docs.join(labels, "doc_id", "left").agg(F.count(F.lit(1)).alias("left_side"), (F.count_if("hit") + F.count_if(F.col("hit").isNull())).alias("right_side"))
    return n.select(F.lit("documents").alias("stage"), "left_side", "right_side", (F.col("left_side") == F.col("right_side")).alias("holds"))


@query(f"SELECT doc_id, toxic = 1 AS included FROM labels WHERE toxic = 1 OR {HASH.format('second', 'doc_id')} < 0.1")
def second_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: all that were included, and a hash sample of the rest."""
    return table(spark, sf_dir, "labels").filter((F.col("toxic") == 1) | (hash_unit("second", F.col("doc_id")) < 0.1)).select("doc_id", (F.col("toxic") == 1).alias("included"))


@query(f"""SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('sheet:' || c_custkey::VARCHAR)) AS draw_order FROM customer""")
def sheet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw order in each stratum by hash; a stratum is spread over ranges."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.sha2(F.concat(F.lit("sheet:"), F.col("c_custkey").cast("string")), 256).alias("h"))
    return group_rank(c, ["c_mktsegment"], ["h"], "draw_order").select("c_custkey", "c_mktsegment", F.col("draw_order").cast("long").alias("draw_order"))


@query("""WITH p AS (SELECT l_suppkey % 5 AS a, l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT x.a AS a, y.a AS b, sum(abs(x.n - y.n)) AS d FROM p x JOIN p y USING (k) WHERE x.a < y.a GROUP BY ALL), s AS (SELECT a, b, d FROM d UNION ALL SELECT b, a, d FROM d)
SELECT a, sum(d) FILTER (b = 0)::BIGINT AS b0, sum(d) FILTER (b = 1)::BIGINT AS b1, sum(d) FILTER (b = 2)::BIGINT AS b2, sum(d) FILTER (b = 3)::BIGINT AS b3, sum(d) FILTER (b = 4)::BIGINT AS b4 FROM s GROUP BY a""")
def symmetric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("a"), F.col("l_returnflag").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    q = p.select(F.col("a").alias("b"), "k", F.col("n").alias("m"))
    d = p.join(q, "k").filter("a <> b").groupBy("a").pivot("b", [0, 1, 2, 3, 4]).agg(F.sum(F.abs(F.col("n") - F.col("m"))))
    return d.select("a", *[F.col(str(k)).alias(f"b{k}") for k in range(5)])


@query("""SELECT l_orderkey, l_suppkey, min(l_extendedprice) AS price FROM lineitem SEMI JOIN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) >= 5) USING (l_orderkey) GROUP BY ALL""")
def keys_with_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with several units, kept by one shuffle on the key."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_extendedprice").alias("price"))
    return per.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))).filter("n >= 5").drop("n")


@query("""WITH b AS (SELECT l_orderkey, arg_min(l_partkey, l_extendedprice * 1000 + l_linenumber) AS part FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, part, p_brand FROM orders LEFT JOIN b ON o_orderkey = l_orderkey LEFT JOIN part ON part = p_partkey""")
def best_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.col("l_extendedprice") * 1000 + F.col("l_linenumber")).alias("part"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(b, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("part") == F.col("p_partkey"), "left").select("o_orderkey", "part", "p_brand")


@query("""SELECT n_name, r_name, count(c_custkey) AS customers, round(coalesce(sum(c_acctbal), 0), 2) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts aggregated by key before they meet their small dimensions."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("b"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "r_name", F.coalesce("n", F.lit(0)).alias("customers"), F.round(F.coalesce("b", F.lit(0.0)), 2).alias("balance"))
