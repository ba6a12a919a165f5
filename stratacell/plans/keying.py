"""Queries that key result rows: models, benchmarks, metrics, arms and the places of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacell.functions import keys as K
from stratacell.plans.registry import query
from stratacell.session import table


def pick(key: str, *choices: object) -> Column:
    """One of some spellings, by a key's remainder."""
    each = [c if isinstance(c, Column) else F.lit(c) for c in choices]
    return F.element_at(F.array(*each), (F.col(key) % len(each) + 1).cast("int"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-sonnet-4.' || p_size WHEN 2 THEN 'deepseek-v3' WHEN 3 THEN 'claude-3.5-sonnet' WHEN 4 THEN 'llama-3.1-' || p_size || 'b-instruct' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'gpt-4o-mini' END AS model FROM part""")
def canonical_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings with routes, dates, idle words, parted versions; two models in one cell and bare numbers are none."""
    size = F.col("p_size").cast("string")
    names = ("GPT4o (2024-05-13)", F.concat(F.lit("us.anthropic.Claude-Sonnet-4-"), size, F.lit("-20250514")), "openai/deepseek-chat", "Claude 3 5 Sonnet latest", F.concat(F.lit("meta/Llama-3.1-"), size, F.lit("B-Instruct")), "gpt-4o/claude-sonnet-4", F.concat(F.lit("4."), size), "openai/gpt-4o-mini-2024-07-18")
    return table(spark, sf_dir, "part").select("p_partkey", K.canonical_model(pick("p_partkey", *names)).alias("model"))


def benchmark_table(spark: SparkSession) -> DataFrame:
    """One row a spelling: a table of fixed size."""
    return spark.createDataFrame([(k, b, s) for k, (b, s) in K.BENCHMARKS.items()], "folded string, family string, implied string")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'swe-bench' WHEN 1 THEN 'swe-bench' WHEN 2 THEN 'tau-bench' WHEN 3 THEN 'gaia' WHEN 5 THEN 'webarena' END AS family, CASE p_partkey % 6 WHEN 0 THEN 'verified' END AS implied, CASE p_size % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'validation' WHEN 2 THEN 'lite' END AS split, CASE WHEN p_partkey % 6 = 0 AND p_size % 4 IN (1, 2) THEN 'conflict' WHEN p_partkey % 6 = 4 THEN 'unrecognised' WHEN p_size % 4 = 3 AND p_partkey % 6 <> 0 THEN 'missing' ELSE 'fine' END AS verdict FROM part""")
def canonical_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family and split by tables of spellings; a split that says all defers to what a qualified name implies."""
    p = table(spark, sf_dir, "part").select("p_partkey", K.fold(pick("p_partkey", "SWE_Bench verified", "swe-bench", "τ-bench", "GAIA", "own set", "WebArena")).alias("key"), K.fold(pick("p_size", "Test", "val", "Lite", "")).alias("s"))
    j = p.join(F.broadcast(benchmark_table(spark)), F.col("key") == F.col("folded"), "left").withColumn("split", K.looked_up(F.col("s"), K.SPLITS))
    conflict = F.col("implied").isNotNull() & F.col("split").isNotNull() & (F.col("split") != "full") & (F.col("split") != F.col("implied"))
    verdict = F.when(conflict, "conflict").when(F.col("family").isNull(), "unrecognised").when((F.col("s") == "") & F.col("implied").isNull(), "missing").otherwise("fine")
    return j.select("p_partkey", "family", "implied", "split", verdict.alias("verdict"))


#: Why a row can't be compared, in the order in which reasons are told.
REASONS = ("system_missing", "model_unidentifiable", "benchmark_unrecognised", "split_missing", "metric_nonstandard", "score_not_numeric")


@query("""WITH r AS (SELECT o_orderkey, list_filter([CASE WHEN o_custkey % 7 = 0 THEN 'system_missing' END, CASE WHEN o_orderkey % 4 = 3 THEN 'model_unidentifiable' END, CASE WHEN o_orderkey % 3 = 2 THEN 'benchmark_unrecognised' END, CASE WHEN o_custkey % 4 = 3 AND o_orderkey % 3 < 2 THEN 'split_missing' END, CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderkey % 3 < 2 THEN 'metric_nonstandard' END, CASE WHEN o_orderstatus = 'P' THEN 'score_not_numeric' END], lambda x: x IS NOT NULL) AS reasons,
  CASE o_orderkey % 3 WHEN 0 THEN 'gaia' ELSE 'webarena' END || '|' || CASE o_custkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'validation' ELSE 'lite' END || '|' || CASE o_orderkey % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gemini-3-pro' ELSE 'o3-mini' END AS key FROM orders)
SELECT o_orderkey, CASE WHEN len(reasons) = 0 THEN key END AS key, array_to_string(reasons, '; ') AS reasons FROM r""")
def comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons against each row, in their fixed order, and a key of benchmark, split and model where there is none."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        "o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("system"), K.canonical_model(pick("o_orderkey", "gpt4o", "gemini-3.0-pro", "O3 mini", "x and y")).alias("model"), K.fold(pick("o_orderkey", "GAIA", "Web Arena", "own")).alias("b"),
        K.looked_up(K.fold(pick("o_custkey", "test", "val", "lite", "")), K.SPLITS).alias("split"), (F.col("o_orderpriority") == "1-URGENT").alias("standard"), F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("score"),
    )
    j = rows.join(F.broadcast(benchmark_table(spark)), F.col("b") == F.col("folded"), "left")
    known = F.col("family").isNotNull()
    against = (F.col("system").isNull(), F.col("model").isNull(), ~known, known & F.coalesce("split", "implied").isNull(), known & ~F.col("standard"), F.col("score").try_cast("double").isNull())
    found = F.array_compact(F.array(*[F.when(c, r) for r, c in zip(REASONS, against, strict=True)]))
    return j.select("o_orderkey", F.when(F.size(found) == 0, F.concat_ws("|", "family", F.coalesce("split", "implied"), "model")).alias("key"), F.array_join(found, "; ").alias("reasons"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'lower' WHEN 1 THEN 'higher' WHEN 2 THEN 'higher' WHEN 3 THEN 'lower' WHEN 4 THEN 'higher' ELSE 'unknown' END AS first_policy, CASE p_partkey % 6 WHEN 0 THEN 'lower' WHEN 1 THEN 'higher' WHEN 2 THEN 'lower' WHEN 3 THEN 'lower' ELSE 'unknown' END AS second_policy FROM part""")
def metric_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two policies, which differ where a name says both or nothing."""
    m = pick("p_partkey", "Error", "Accuracy", "success at cost", "Wall Time", "elo", "  ")
    return table(spark, sf_dir, "part").select("p_partkey", K.direction(m).alias("first_policy"), K.direction(m, True).alias("second_policy"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'ablation' ELSE CASE p_partkey % 7 WHEN 0 THEN 'without' WHEN 1 THEN 'only' WHEN 2 THEN 'minus' WHEN 3 THEN 'no_part' WHEN 4 THEN 'own' WHEN 5 THEN 'variant' END END AS tag FROM part""")
def lacking_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = pick("p_partkey", "Tool w/o memory", "Planner only", "- memory", "No-planner", "Tool (ours)", "variant of Tool", "Other tool")
    return table(spark, sf_dir, "part").select("p_partkey", K.lacking(label, F.when(F.col("p_size") % 5 == 0, "from the ablation table").otherwise("only three runs")).alias("tag"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 0 END AS x FROM lineitem), b AS (SELECT l_orderkey FROM e GROUP BY l_orderkey HAVING count(DISTINCT x) = 2) SELECT l_orderkey, l_linenumber, x FROM e JOIN b USING (l_orderkey) WHERE x IS NOT NULL""")
def contrast_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows exposed or not, of keys that have both; rows of neither kind drop out."""
    flag = F.col("l_returnflag")
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(flag == "A", 1).when(flag == "N", 0).alias("x")).filter("x IS NOT NULL")
    own = Window.partitionBy("l_orderkey")
    return e.withColumns({"_lo": F.min("x").over(own), "_hi": F.max("x").over(own)}).filter("_lo < _hi").drop("_lo", "_hi")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN NULL WHEN 2 THEN 'without_line' WHEN 3 THEN NULL ELSE 'malformed' END AS fault FROM part""")
def locator_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", K.locator_fault(pick("p_partkey", " ", F.concat(F.lit("src/a/b.py:"), n), "src/a/b.py", F.concat(F.lit("Section "), n, F.lit(", Table 2")), "somewhere")).alias("fault"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'removal' WHEN 1 THEN 'addition' WHEN 2 THEN 'both' WHEN 3 THEN 'addition' END AS signal, CASE p_partkey % 5 WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN p_size % 2 = 1 ELSE false END AS contradicts FROM part""")
def label_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a label's wording says, and whether the row's direction contradicts it."""
    label, turned = pick("p_partkey", "w/o memory", "+ memory", "without plan, with critic", "with flat memory", "memory"), pick("p_size", "added", "removed")
    return table(spark, sf_dir, "part").select("p_partkey", K.signal(label).alias("signal"), K.contradiction(label, F.lit("Full"), turned).alias("contradicts"))


@query("""SELECT o_orderkey, 2 AS strict, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS glued, 4 AS first, true AS near FROM orders""")
def score_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a score in a line: not within other numbers; a decimal right after digits counts only if glued cells are allowed."""
    x = F.format_string("%d.5", F.col("o_custkey"))
    line = F.concat(F.lit("(a) "), x, F.lit(" | "), x, F.lit("; 0."), x, F.lit(" "), x, F.lit("1 "), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("N=20"), x)).otherwise(""))
    strict, glued = K.score_places(x, line), K.score_places(x, line, True)
    near = F.exists(strict, lambda a: F.exists(glued, lambda b: (a != b) & (F.abs(a - b) <= F.length(x) + 3)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(strict).alias("strict"), F.size(glued).alias("glued"), F.element_at(strict, 1).alias("first"), near.alias("near"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Tool' WHEN 1 THEN 'Tool' WHEN 2 THEN 'Tool (beta)' WHEN 3 THEN 'gpt-4o' ELSE 'Tool with memory' END AS name, CASE p_partkey % 5 WHEN 0 THEN 'GPT-4o' WHEN 1 THEN 'Claude 3.5 Sonnet' END AS model, p_partkey % 5 = 3 AS bare FROM part""")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without the model that they end with, and labels that are nothing but a model."""
    label = pick("p_partkey", "Tool (GPT-4o)", "Tool + Claude 3.5 Sonnet", "Tool (beta)", "gpt-4o", "Tool with memory")
    name, model = K.without_model(label)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), model.alias("model"), K.is_model(label).alias("bare"))


#: Guards on extracted contrasts, in the order in which they are tried.
GUARDS = ("no_score", "same_arm", "delta_metric", "not_performance", "model_variant", "label_contradicts", "low_confidence", "not_in_quote")


@query("""SELECT guard, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 7 THEN 'no_score' WHEN l_partkey % 11 = 0 THEN 'same_arm' WHEN l_suppkey % 5 = 0 THEN 'delta_metric' WHEN l_suppkey % 5 = 1 THEN 'not_performance' WHEN l_partkey % 4 = 0 THEN 'model_variant' WHEN l_partkey % 4 > 0 AND l_returnflag = 'A' THEN 'label_contradicts' WHEN l_discount < 0.02 THEN 'low_confidence' WHEN l_orderkey % 3 = 0 THEN 'not_in_quote' ELSE 'kept' END AS guard FROM lineitem) GROUP BY guard""")
def guard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first guard that each extracted contrast fails; where none does, it is kept."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("score"), F.when(F.col("l_partkey") % 11 == 0, "Tool").otherwise(pick("l_partkey", "Tool (o3-mini)", "w/o memory", "- plan", "no critic")).alias("arm"), F.lit("Tool").alias("full"),
        pick("l_suppkey", "Δ Acc", "latency", "Accuracy", "score", "pass@1").alias("metric"), F.when(F.col("l_returnflag") == "A", "added").otherwise("removed").alias("turned"), F.col("l_discount").alias("sure"), (F.col("l_orderkey") % 3 != 0).alias("quoted"),
    )
    fails = (F.col("score").isNull(), F.col("arm") == F.col("full"), F.col("metric").rlike("(?i)^(?:Δ|delta)|gain|improvement"), F.col("metric").rlike(K.LESS) & ~F.col("metric").rlike(K.MORE), K.without_model(F.col("arm"))[1].isNotNull(), K.contradiction(F.col("arm"), F.col("full"), F.col("turned")), F.col("sure") < 0.02, ~F.col("quoted"))
    guard = F.coalesce(*[F.when(c, g) for g, c in zip(GUARDS, fails, strict=True)], F.lit("kept"))
    return rows.select(guard.alias("guard")).groupBy("guard").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'missing_score' WHEN l_quantity < 10 THEN 'bad_score' WHEN l_tax > 0.07 THEN 'bad_date' WHEN l_linenumber = 6 THEN 'missing_locator' ELSE 'ok' END AS reason, CASE WHEN l_quantity >= 10 THEN l_extendedprice END AS score FROM lineitem""")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows as text, with the first reason for which each is refused."""
    from stratacell.functions import text as X

    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(q < 5, "").when(q < 10, "10-20").otherwise(F.format_string("~%.2f%%", F.col("l_extendedprice"))).alias("raw"), F.when(F.col("l_tax") > 0.07, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM")).alias("day"), F.when(F.col("l_linenumber") != 6, "Table 2").alias("place"))
    score = X.clean_number(F.col("raw"))
    reason = F.coalesce(F.when(F.col("raw") == "", "missing_score"), F.when(score.isNull(), "bad_score"), F.when(X.partial_date(F.col("day")).isNull(), "bad_date"), F.when(K.locator_fault(F.col("place")).isNotNull(), "missing_locator"), F.lit("ok"))
    return rows.select("l_orderkey", "l_linenumber", reason.alias("reason"), score.alias("score"))


@query("""SELECT p_partkey, p_partkey % 4 <> 3 AS variant FROM part""")
def model_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms that differ by model or training: by category, by a router of models, by a model in the label that the full arm lacks."""
    arm = pick("p_partkey", "w/o fine-tuning", "no model cascade", "Tool (o3-mini)", "Tool w/o plan (GPT-4o)")
    named = K.without_model(arm)[1]
    other = named.isNotNull() & ~K.fold(F.lit("Tool (gpt-4o)")).contains(K.fold(F.coalesce(named, F.lit("-"))))
    return table(spark, sf_dir, "part").select("p_partkey", (arm.rlike(r"(?i)fine-?tun|pre-?train|\bsft\b|\bdpo\b") | arm.rlike(r"(?i)\b(?:model|llm)s?[- ]?(?:rout|cascad|switch)\w*") | other).alias("variant"))
