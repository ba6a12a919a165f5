"""Queries on attribution, coded duplicates, audits, screening, adjudication and summary rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacell.functions import keys as K
from stratacell.functions import text as X
from stratacell.operators import resample as R
from stratacell.plans.estimates import STUDIES, studies
from stratacell.plans.keying import pick
from stratacell.plans.registry import query
from stratacell.session import table

Z = 1.959963984540054


@query("""WITH c AS (SELECT l_orderkey AS rec, l_linenumber AS i, l_partkey, l_extendedprice AS a, l_quantity AS b FROM lineitem WHERE l_linenumber % 2 = 1), d AS (SELECT l_orderkey AS rec, l_partkey, l_extendedprice AS a, l_quantity AS b FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT c.rec, c.i, c.l_partkey, min(CASE WHEN c.b = d.b THEN 'a_scores' WHEN c.l_partkey % 10 = d.l_partkey % 10 THEN 'b_key' END) AS rule FROM c LEFT JOIN d ON c.rec = d.rec GROUP BY c.rec, c.i, c.l_partkey, c.a, c.b""")
def coded_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts of one paper that the coded set already has: by the same scores, else by the same key; the first rule that fits. The join is on the paper."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_linenumber").alias("i"), "l_partkey", F.col("l_extendedprice").alias("a"), F.col("l_quantity").alias("b"))
    coded = rows.filter("i % 2 = 0").groupBy(F.col("rec").alias("r")).agg(F.collect_set("b").alias("scores"), F.collect_set(F.col("l_partkey") % 10).alias("keys"))
    j = rows.filter("i % 2 = 1").join(coded, F.col("rec") == F.col("r"), "left")
    rule = F.when(F.array_contains("scores", F.col("b")), "a_scores").when(F.array_contains("keys", F.col("l_partkey") % 10), "b_key")
    return j.select("rec", "i", "l_partkey", rule.alias("rule"))


@query("""WITH m AS (SELECT o_custkey AS rec, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN ids IS NULL THEN 'corpus:' || c_custkey WHEN len(ids) = 1 THEN ids[1]::VARCHAR ELSE coalesce(list_filter(ids, lambda x: x % 10 = c_custkey % 10)[1], ids[1])::VARCHAR END AS system FROM customer LEFT JOIN m ON rec = c_custkey""")
def resolved_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coded system of a record: its only candidate, the one whose name fits, the least, or the record itself."""
    m = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(m, F.col("c_custkey") == F.col("o_custkey"), "left")
    fits = F.try_element_at(F.filter("ids", lambda x: x % 10 == F.col("c_custkey") % 10), F.lit(1))
    return c.select("c_custkey", F.coalesce(F.when(F.size("ids") > 1, fits).cast("string"), F.try_element_at("ids", F.lit(1)).cast("string"), F.concat(F.lit("corpus:"), F.col("c_custkey").cast("string"))).alias("system"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN l_orderkey + (l_linenumber % 2) * 100000000 END AS id FROM lineitem), j AS (SELECT n.*, o_orderkey IS NOT NULL AS found FROM n LEFT JOIN orders ON id = o_orderkey) SELECT CASE WHEN id IS NULL THEN 'no_id' WHEN found THEN 'joined' ELSE 'unmatched' END AS status, count(*) AS n FROM j GROUP BY status""")
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows join their evidence by an id within a note; what has no match is counted, not lost."""
    n = F.col("l_linenumber")
    note = F.when(n % 3 > 0, F.concat(F.lit("own arm; row_id="), (F.col("l_orderkey") + (n % 2) * 100000000).cast("string"), F.lit("; checked"))).otherwise("own arm")
    rows = table(spark, sf_dir, "lineitem").select(F.regexp_extract(note, r"\brow_id=(\d+)", 1).try_cast("long").alias("id"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    status = F.when(F.col("id").isNull(), "no_id").when(F.col("o_orderkey").isNotNull(), "joined").otherwise("unmatched")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).join(o, F.col("id") == F.col("o_orderkey"), "left").groupBy(status.alias("status")).agg(F.sum("rows").alias("n"))


@query("""WITH m AS (SELECT o_custkey AS label, o_orderkey AS id, 100 - o_orderkey % 40 AS score, 0 AS fuzzy FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT o_custkey AS label, o_orderkey AS id, 100 - o_orderkey % 40 AS score, 1 AS fuzzy FROM orders WHERE o_orderkey % 40 < 25), u AS (SELECT label, id, max(score) AS score, min(fuzzy) AS fuzzy FROM (SELECT * FROM m UNION ALL SELECT * FROM f) GROUP BY label, id)
SELECT label, id, fuzzy = 1 AS fuzzy, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY fuzzy, score DESC, id) AS place FROM u) WHERE place <= 5""")
def candidate_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five candidates a label, which is the report's length: mentioned ones before those that are only alike, then by score."""
    o = table(spark, sf_dir, "orders")
    score = (100 - F.col("o_orderkey") % 40).alias("score")
    side = lambda f, k: o.filter(f).select(F.col("o_custkey").alias("label"), F.col("o_orderkey").alias("id"), score, F.lit(k).alias("fuzzy"))
    u = side("o_orderstatus = 'F'", 0).unionByName(side("o_orderkey % 40 < 25", 1)).groupBy("label", "id").agg(F.max("score").alias("score"), F.min("fuzzy").alias("fuzzy"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("fuzzy", F.desc("score"), "id")).cast("long")
    return u.withColumn("place", place).filter("place <= 5").select("label", "id", (F.col("fuzzy") == 1).alias("fuzzy"), "place")


@query("""SELECT min(p_partkey) AS p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title, count(*) AS copies FROM part WHERE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) IN (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) FROM part WHERE p_size > 25) GROUP BY title""")
def wanted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each title that an outside list wants."""
    p = table(spark, sf_dir, "part").select("p_partkey", X.norm_title(F.col("p_name")).alias("title"), "p_size")
    wanted = p.filter("p_size > 25").select(F.col("title").alias("own")).distinct()
    return p.join(wanted, F.col("title") == F.col("own"), "left_semi").groupBy("title").agg(F.min("p_partkey").alias("p_partkey"), F.count(F.lit(1)).alias("copies"))


@query("""WITH s AS (SELECT l_suppkey AS paper, count(*) AS expected FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1), t AS (SELECT l_suppkey AS paper, count(*) - (l_suppkey % 4 = 0)::INT AS seen FROM lineitem GROUP BY l_suppkey) SELECT paper, expected, CASE WHEN expected = seen THEN 'same' ELSE 'moved' END AS state, CASE WHEN expected = seen THEN seen END AS rows FROM s JOIN t USING (paper)""")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of exactly the papers of a snapshot; a paper whose count has moved gives none, and says so."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("paper")).agg(F.count(F.lit(1)).alias("expected"))
    j = n.filter("paper % 2 = 0").withColumn("seen", F.col("expected") - (F.col("paper") % 4 == 0).cast("int"))
    same = F.col("expected") == F.col("seen")
    return j.select("paper", "expected", F.when(same, "same").otherwise("moved").alias("state"), F.when(same, F.col("seen")).alias("rows"))


ARMS = """a AS (SELECT l_orderkey, l_linenumber, l_partkey % 6 AS kind, l_suppkey FROM lineitem), n AS (SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS same, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS least FROM supplier),
r AS (SELECT l_orderkey, l_linenumber, CASE WHEN kind = 0 THEN 'ablation' WHEN kind = 1 THEN 'stop_key' WHEN s_suppkey IS NULL THEN 'unknown' WHEN same > 2 THEN 'ambiguous' ELSE 'name' END AS how, l_suppkey FROM a LEFT JOIN n ON s_suppkey = l_suppkey)"""


def attributed_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", pick("l_partkey", "Tool w/o plan", "baseline", "Tool A", "Tool B", "Tool C", "Tool D").alias("label"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    same = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("same"))
    j = rows.join(s.join(same, F.col("s_nationkey") == F.col("k")).select("s_suppkey", "same"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    how = F.when(K.lacking(F.col("label"), F.lit("")).isNotNull(), "ablation").when(K.fold(F.col("label")).isin("baseline", "human", "random"), "stop_key").when(F.col("s_suppkey").isNull(), "unknown").when(F.col("same") > 2, "ambiguous").otherwise("name")
    return j.select("l_orderkey", "l_linenumber", "l_suppkey", how.alias("how"))


@query(f"WITH {ARMS} SELECT l_orderkey, l_linenumber, how, CASE WHEN how = 'name' THEN l_suppkey END AS system FROM r")
def arm_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arm's system, or why none is named: an ablation, a name that is no system, an unknown or an ambiguous one."""
    return attributed_arms(spark, sf_dir).select("l_orderkey", "l_linenumber", "how", F.when(F.col("how") == "name", F.col("l_suppkey")).alias("system"))


@query(f"WITH {ARMS} SELECT l_suppkey, n, first FROM (SELECT l_suppkey, count(*) AS n, arg_min(how, l_orderkey * 10 + l_linenumber) AS first FROM (SELECT l_suppkey, l_orderkey, l_linenumber, min(how) AS how FROM r WHERE how <> 'name' GROUP BY ALL) GROUP BY l_suppkey) ORDER BY n DESC, l_suppkey LIMIT 10")
def unattributed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-ten report of what is not attributed, with the reason seen first."""
    a = attributed_arms(spark, sf_dir).filter("how <> 'name'").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("how").alias("how"))
    return a.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min_by("how", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first")).orderBy(F.desc("n"), "l_suppkey").limit(10)


@query("""WITH b AS (SELECT l_orderkey, count(*) AS arms, count(*) FILTER (l_partkey % 3 = 0) AS before, count(*) FILTER (l_partkey % 3 = 0 OR l_suppkey % 5 = 0) AS after FROM lineitem GROUP BY l_orderkey), m AS (SELECT unnest([{'metric': 'blocks', 'b': (before > 0)::INT, 'a': (after > 0)::INT}, {'metric': 'ranked', 'b': (before >= 2)::INT, 'a': (after >= 2)::INT}, {'metric': 'arms', 'b': before, 'a': after}], recursive := true) FROM b)
SELECT metric, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after, (sum(a) - sum(b))::BIGINT AS change FROM m GROUP BY metric""")
def what_if_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of blocks with one attribution and with another, from one pass."""
    old, new = F.col("l_partkey") % 3 == 0, (F.col("l_partkey") % 3 == 0) | (F.col("l_suppkey") % 5 == 0)
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(old).alias("o"), F.count_if(new).alias("n"))
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), f(F.col("o")).cast("long").alias("before"), f(F.col("n")).cast("long").alias("after")) for m, f in (("blocks", lambda x: x > 0), ("ranked", lambda x: x >= 2), ("arms", lambda x: x))])
    g = b.select(F.explode(parts).alias("m")).groupBy("m.metric").agg(F.sum("m.before").alias("before"), F.sum("m.after").alias("after"))
    return g.withColumn("change", F.col("after") - F.col("before"))


@query("""WITH a AS (SELECT doc_id, quality, toxic FROM labels), j AS (SELECT lang, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS model, quality AS human FROM documents JOIN a USING (doc_id))
SELECT lang, count(*) FILTER (model = 1 AND human = 1) AS tp, count(*) FILTER (model = 1 AND human = 0) AS fp, count(*) FILTER (model = 0 AND human = 1) AS fn, count(*) FILTER (model = 0 AND human = 0) AS tn, round(count(*) FILTER (model = 1 AND human = 1) / nullif(count(*) FILTER (model = 1), 0), 6) AS precision, round(count(*) FILTER (model = 1 AND human = 1) / nullif(count(*) FILTER (human = 1), 0), 6) AS recall, round(avg((model = human)::INT), 6) AS accuracy FROM j GROUP BY lang""")
def audit_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of model and human by group, with precision, recall and accuracy."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 800).alias("model"))
    j = d.join(table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).alias("human")), "doc_id")
    m, h = F.col("model"), F.col("human")
    g = j.groupBy("lang").agg(F.count_if(m & h).alias("tp"), F.count_if(m & ~h).alias("fp"), F.count_if(~m & h).alias("fn"), F.count_if(~m & ~h).alias("tn"))
    share = lambda a, b: F.round(F.try_divide(F.col("tp"), F.col(a) + F.col(b)), 6)
    return g.select("lang", "tp", "fp", "fn", "tn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"))


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS include, count(*) FILTER (o_orderstatus = 'O') AS exclude, count(*) FILTER (o_orderstatus = 'P') AS unsure, round(count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 2 = 0) / nullif(count(*) FILTER (o_custkey % 2 = 0), 0), 6) AS strict, round(count(*) FILTER (o_orderstatus IN ('F', 'P') AND o_custkey % 2 = 0) / nullif(count(*) FILTER (o_custkey % 2 = 0), 0), 6) AS lenient, round(count(*) * count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 2 = 0) / nullif(count(*) FILTER (o_custkey % 2 = 0), 0), 4) AS projected FROM orders GROUP BY o_orderpriority""")
def screening_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by group, the included share of a checked half by a strict and a lenient rule, and what it projects to."""
    s, checked = F.col("o_orderstatus"), F.col("o_custkey") % 2 == 0
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "F").alias("include"), F.count_if(s == "O").alias("exclude"), F.count_if(s == "P").alias("unsure"), F.count_if(checked).alias("c"), F.count_if(checked & (s == "F")).alias("a"), F.count_if(checked & s.isin("F", "P")).alias("b"))
    strict = F.try_divide(F.col("a"), F.col("c"))
    return g.select("o_orderpriority", "n", "include", "exclude", "unsure", F.round(strict, 6).alias("strict"), F.round(F.try_divide(F.col("b"), F.col("c")), 6).alias("lenient"), F.round(F.try_divide(F.col("n") * F.col("a"), F.col("c")), 4).alias("projected"))


@query(f"""WITH r AS (SELECT o_orderpriority AS reference, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS hits FROM orders GROUP BY 1)
SELECT reference, n, hits, round(hits / n, 6) AS recall, round((hits / n + {Z} * {Z} / (2 * n) - {Z} * sqrt(hits / n * (1 - hits / n) / n + {Z} * {Z} / (4 * n * n))) / (1 + {Z} * {Z} / n), 6) AS low, round((hits / n + {Z} * {Z} / (2 * n) + {Z} * sqrt(hits / n * (1 - hits / n) / n + {Z} * {Z} / (4 * n * n))) / (1 + {Z} * {Z} / n), 6) AS high FROM r""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known items that were found, by reference list, with Wilson's interval."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("reference")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") != "P").alias("hits"))
    n, p, z2 = F.col("n"), F.col("hits") / F.col("n"), Z * Z
    half, base = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)), 1 + z2 / n
    middle = p + z2 / (2 * n)
    return g.select("reference", "n", "hits", F.round(p, 6).alias("recall"), F.round((middle - half) / base, 6).alias("low"), F.round((middle + half) / base, 6).alias("high"))


@query("""WITH g AS (SELECT o_custkey, o_orderpriority, o_orderstatus, o_totalprice, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1)
SELECT o_custkey, count(*) AS entries, max(o_totalprice) AS best, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS boards FROM g GROUP BY o_custkey""")
def board_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each system's board entries: repeats dropped, boards as a sorted set."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority", "o_orderstatus").agg(F.max("o_totalprice").alias("best"))
    return g.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("entries"), F.max("best").alias("best"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("boards"))


@query("""SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types, round(median(p_retailprice), 4) AS median, round(quantile_cont(p_retailprice, 0.25), 4) AS low, round(quantile_cont(p_retailprice, 0.75), 4) AS high, count(*) FILTER (p_size > 25) AS large FROM part GROUP BY p_brand""")
def derived_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, medians and inclusive quartiles that a text quotes."""
    p = "p_retailprice"
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("types"), *[F.round(F.percentile(p, q), 4).alias(a) for q, a in ((0.5, "median"), (0.25, "low"), (0.75, "high"))], F.count_if(F.col("p_size") > 25).alias("large"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS body FROM documents), p AS (SELECT unnest([12, 24, 48]) AS len), c AS (SELECT doc_id, len, contains(body, substr(reverse(body), 1, len)) AS back, length(body) < len AS short FROM d, p)
SELECT len, count(*) FILTER (short) AS gap, count(*) FILTER (NOT short AND back) AS both_ways, count(*) FILTER (NOT short AND NOT back) AS one_way FROM c GROUP BY len""")
def adjudication_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of evidence by whether a probe of a text's squashed letters is found in a body, swept over the probe's length."""
    d = table(spark, sf_dir, "documents").select(X.squash(F.col("text")).alias("body")).withColumn("len", F.explode(F.array(F.lit(12), F.lit(24), F.lit(48))))
    back, small = F.col("body").contains(F.substring(F.reverse("body"), F.lit(1), F.col("len"))), F.length("body") < F.col("len")
    return d.groupBy("len").agg(F.count_if(small).alias("gap"), F.count_if(~small & back).alias("both_ways"), F.count_if(~small & ~back).alias("one_way"))


@query("""WITH d(ord, o_orderpriority) AS (VALUES (1, '1-URGENT'), (2, '3-MEDIUM'), (3, '5-LOW')), r AS (SELECT o_orderpriority, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS agree FROM orders GROUP BY 1) SELECT ord, o_orderpriority, printf('%.2f', round(agree, 2)) AS agreement, n::VARCHAR || ' cells' AS cells FROM d JOIN r USING (o_orderpriority)""")
def reliability_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of the dimensions that are reported, in their order and as they are printed."""
    words = {"1-URGENT": "1", "3-MEDIUM": "2", "5-LOW": "3"}
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("a"))
    j = g.withColumn("ord", K.looked_up(F.col("o_orderpriority"), words).cast("int")).filter("ord IS NOT NULL")
    return j.select("ord", "o_orderpriority", F.format_string("%.2f", F.round("a", 2)).alias("agreement"), F.concat(F.col("n").cast("string"), F.lit(" cells")).alias("cells"))


@query(f"WITH {STUDIES}, w AS (SELECT l_returnflag, count(*) AS k, sum(y / v) / sum(1 / v) AS mu, min(y) AS low, max(y) AS high FROM s GROUP BY l_returnflag) SELECT 'within' AS design, l_returnflag, k, round(mu, 6) AS mu, round(high - low, 6) AS span FROM w UNION ALL SELECT 'across', NULL, sum(k)::BIGINT, round(avg(mu), 6), round(max(mu) - min(mu), 6) FROM w")
def design_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary row of each study design: within each group, and across the groups."""
    w = studies(spark, sf_dir).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("k"), (F.sum(F.col("y") / F.col("v")) / F.sum(1 / F.col("v"))).alias("mu"), F.min("y").alias("low"), F.max("y").alias("high"))
    within = w.select(F.lit("within").alias("design"), "l_returnflag", "k", F.round("mu", 6).alias("mu"), F.round(F.col("high") - F.col("low"), 6).alias("span"))
    across = w.agg(F.sum("k").alias("k"), F.round(F.avg("mu"), 6).alias("mu"), F.round(F.max("mu") - F.min("mu"), 6).alias("span"))
    return within.unionByName(across.select(F.lit("across").alias("design"), F.lit(None).cast("string").alias("l_returnflag"), "k", "mu", "span"))


@query("""SELECT n_regionkey, round(avg(rate), 6) AS silence, count(*) AS dimensions FROM (SELECT s_nationkey, avg((s_acctbal < 0)::INT) AS rate FROM supplier GROUP BY 1) JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey""")
def layer_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer's silence is the mean of its dimensions' rates, each counted once."""
    r = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg((F.col("s_acctbal") < 0).cast("int")).alias("rate"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return r.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.round(F.avg("rate"), 6).alias("silence"), F.count(F.lit(1)).alias("dimensions"))


@query("""WITH c AS (SELECT p_type AS cluster, p_brand AS level, count(*) AS inside FROM part GROUP BY ALL), t AS (SELECT p_type AS cluster, count(*) AS size FROM part GROUP BY 1), l AS (SELECT p_brand AS level, count(*) AS everywhere FROM part GROUP BY 1), n AS (SELECT count(*) AS total FROM part),
m AS (SELECT cluster, level, inside / size AS share, (everywhere - inside) / nullif(total - size, 0) AS outside FROM c JOIN t USING (cluster) JOIN l USING (level), n)
SELECT cluster, level, round(share, 6) AS share, round(outside, 6) AS outside, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(share - coalesce(outside, 0), 9) DESC, level) AS place FROM m) WHERE place <= 3""")
def cluster_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three levels that mark a cluster most: their share in it less that outside. A report of fixed length for each cluster."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("cluster"), F.col("p_brand").alias("level")).agg(F.count(F.lit(1)).alias("inside"))
    size, every, total = p.groupBy("cluster").agg(F.sum("inside").alias("size")), p.groupBy("level").agg(F.sum("inside").alias("everywhere")), p.agg(F.sum("inside").alias("total"))
    j = p.join(size, "cluster").join(every, "level").crossJoin(F.broadcast(total))
    share, outside = F.col("inside") / F.col("size"), F.try_divide(F.col("everywhere") - F.col("inside"), F.col("total") - F.col("size"))
    j = j.select("cluster", "level", share.alias("s"), outside.alias("o"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round(F.col("s") - F.coalesce("o", F.lit(0.0)), 9)), "level")).cast("long")
    return j.withColumn("place", place).filter("place <= 3").select("cluster", "level", F.round("s", 6).alias("share"), F.round("o", 6).alias("outside"), "place")


@query()
def bias_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By group: what trim-and-fill and one null study each take off the pooled effect; the larger share is the discount, and an effect is credible if what is left of it keeps its interval away from 0."""

    def make(p: pd.DataFrame) -> dict:
        p = p.sort_values("l_suppkey")
        y, v = p["y"].to_numpy(), p["v"].to_numpy()
        seen, filled, nulls = R.pooled(y, v), R.trim_and_fill(y, v), R.null_fill(y, v)
        cuts = [(seen.mu - x) / seen.mu for x in (filled["adjusted"], nulls["one_each"]) if x is not None and seen.mu]
        discount = max(cuts) if cuts else None
        left = None if discount is None else seen.mu * (1 - discount)
        half = (seen.high - seen.low) / 2
        verdict = "too_few" if discount is None else "credible" if abs(left) > half and left * seen.mu > 0 else "fragile"
        return {"studies": len(y), "observed": seen.mu, "missing": filled["missing"], "discount": discount, "left": left, "to_halve": nulls["to_halve"], "verdict": verdict}

    rows = studies(spark, sf_dir).select("l_returnflag", "l_suppkey", "y", "v")
    return R.grouped(rows, "l_returnflag", "string", make, "studies int, observed double, missing int, discount double, left double, to_halve int, verdict string")


@query()
def contrast_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By group: a contrast's difference with its interval, the least detectable effect, a permutation test and a verdict."""

    def make(p: pd.DataFrame) -> dict:
        p = p.sort_values("l_suppkey")
        y, exposed = p["y"].to_numpy(), (p["l_suppkey"] % 2 == 0).to_numpy()
        if exposed.all() or not exposed.any():
            return {"difference": None, "low": None, "high": None, "least": None, "p": None, "verdict": "one_sided"}
        test, both = R.permutation_test(y, exposed), R.bootstrap_difference(y, exposed)
        verdict = "differs" if test["p"] < 0.05 and both["low"] * both["high"] > 0 else "no_difference_shown"
        return {"difference": test["difference"], "low": both["low"], "high": both["high"], "least": R.detectable(y), "p": test["p"], "verdict": verdict}

    rows = studies(spark, sf_dir).select("l_returnflag", "l_suppkey", "y")
    return R.grouped(rows, "l_returnflag", "string", make, "difference double, low double, high double, least double, p double, verdict string")
