"""Operators on small tables whose results are worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacell.functions import names as N
from stratacell.functions import tails
from stratacell.functions import text as T
from stratacell.operators import estimates as E
from stratacell.operators import linkage as L
from stratacell.operators import resample as R
from stratacell.operators import states as S
from stratacell.operators import windows as W


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_states(spark):
    df = spark.createDataFrame([("a", False, False), ("", False, False), (None, True, False), ("b", True, True), (None, None, None)], "v string, s boolean, u boolean")
    got = [r[0] for r in df.select(S.three_state(F.col("v"), F.col("s"), F.col("u"))).collect()]
    assert got == ["coded", "unresolved", "not_reported", "unresolved", "unresolved"]
    assert one(spark, S.three_state(F.lit(""), F.lit(False), F.lit(False), empty_is_unresolved=False)) == "coded"
    assert one(spark, S.four_state(F.lit(False), F.lit("x"), F.lit(False), F.lit(False))) == "missing"
    assert one(spark, S.normal_state(F.lit(" Valued "))) == "coded" and one(spark, S.normal_state(F.lit("?"))) is None


def test_two_stratum_census(spark):
    """A census stratum of four adds no variance; of twenty, eight were drawn."""
    high = [("H", 1.0, y, 1) for y in (1, 1, 0, 0)]
    other = [("O", 2.5, y, 1) for y in (1, 1, 1, 1, 1, 1, 0, 0)]
    units = spark.createDataFrame(high + other, "s string, w double, y int, x int")
    sizes = spark.createDataFrame([("H", 4), ("O", 20)], "stratum string, size int")
    got = E.weighted_ratio(units, F.col("y"), F.col("x"), F.col("w"), F.col("s"), sizes).first()
    ratio = (2 + 2.5 * 6) / 24
    s2 = np.var([1 - ratio] * 6 + [-ratio] * 2, ddof=1)
    assert got["ratio"] == pytest.approx(ratio, abs=1e-6)
    assert got["se"] == pytest.approx(math.sqrt(400 * (1 - 8 / 20) * s2 / 8) / 24, abs=1e-6)


def test_within_key_scores(spark):
    rows = [("four", 10.0), ("four", 20.0), ("four", 30.0), ("four", 40.0), ("tie", 1.0), ("tie", 1.0), ("tie", 3.0), ("two", 5.0), ("two", 9.0), ("same", 2.0), ("same", 2.0), ("one", 7.0)]
    got = {}
    for r in W.within_key_score(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect():
        got.setdefault(r["k"], []).append(r["z"])
    sd = math.sqrt(500 / 3)
    assert sorted(got["four"]) == pytest.approx([-15 / sd, -5 / sd, 5 / sd, 15 / sd], abs=1e-6)
    assert sorted(got["tie"]) == pytest.approx([-0.5, -0.5, 1], abs=1e-6)
    assert sorted(got["two"]) == pytest.approx([-1 / math.sqrt(2), 1 / math.sqrt(2)], abs=1e-6)
    assert got["same"] == [0, 0] and got["one"] == [0]


def test_entropy(spark):
    rows = E.entropy(spark.createDataFrame([("a", 5), ("b", 4), ("b", 4), ("b", 4)], "g string, n int"), "n", "g").collect()
    by = {r["g"]: r for r in rows}
    assert by["a"]["entropy"] == 0
    assert by["b"]["entropy"] == pytest.approx(math.log(3), abs=1e-6) and by["b"]["entropy_mm"] == pytest.approx(math.log(3) + 2 / 24, abs=1e-6)


def test_agreement(spark):
    pairs = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15, "a string, b string")
    got = E.kappa(pairs, "a", "b").first()
    assert got["po"] == pytest.approx(0.7) and got["kappa"] == pytest.approx((0.7 - 0.5) / 0.5)
    same = spark.createDataFrame([("a", "a")] * 3, "a string, b string")
    assert E.kappa(same, "a", "b").first()["kappa"] is None and E.kappa(same, "a", "b", certain=1.0).first()["kappa"] == 1
    pi = (25 / 50 + 30 / 50) / 2
    pe = 2 * pi * (1 - pi)
    assert E.gwet_ac1(pairs, "a", "b").first()["ac1"] == pytest.approx((0.7 - pe) / (1 - pe), abs=1e-6)


def test_association(spark):
    perfect = spark.createDataFrame([("x", "1")] * 5 + [("y", "2")] * 5, "a string, b string")
    free = spark.createDataFrame([(a, b) for a in "xy" for b in "12"] * 5, "a string, b string")
    single = spark.createDataFrame([("x", b) for b in "12"], "a string, b string")
    assert E.cramers_v(perfect, "a", "b").first()["v"] == 1 and E.cramers_v(free, "a", "b").first()["v"] == 0
    assert E.cramers_v(single, "a", "b").first()["v"] is None


def test_pooling(spark):
    y, v = np.array([0.1, 0.4, 0.35]), np.array([0.01, 0.02, 0.04])
    w = 1 / v
    q = (w * y**2).sum() - (w * y).sum() ** 2 / w.sum()
    tau2 = max(0, (q - 2) / (w.sum() - (w**2).sum() / w.sum()))
    ws = 1 / (v + tau2)
    got = E.pooled(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, v, strict=True)], "y double, v double"), "y", "v").first()
    assert got["q"] == pytest.approx(q, abs=1e-6) and got["tau2"] == pytest.approx(tau2, abs=1e-6)
    assert got["mu"] == pytest.approx((ws * y).sum() / ws.sum(), abs=1e-6) and got["se"] == pytest.approx(1 / math.sqrt(ws.sum()), abs=1e-6)


def test_corrections_and_rank(spark):
    ps = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([(i, "f", p) for i, p in enumerate(ps)], "i int, f string, p double")
    got = {r["i"]: r for r in W.adjusted(df, "p", "i", "f").collect()}
    assert [got[i]["bh_q"] for i in range(4)] == pytest.approx([0.04, 4 * 0.04 / 3, 4 * 0.04 / 3, 0.5], abs=1e-6)
    assert [got[i]["holm_p"] for i in range(4)] == pytest.approx([0.04, 0.09, 0.09, 0.5], abs=1e-6)
    ranked = W.global_rank(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), ["v"]).collect()
    assert all(r["rank"] == r["v"] + 1 for r in ranked)


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 3, 0), ("a", 2, 5, 1), ("a", 5, 6, 2), ("a", 8, 9, 3)], "k string, s int, e int, i int")
    got = sorted((r["s"], r["e"], r["n"]) for r in W.merged_intervals(df, ["k"], "s", "e", "i").collect())
    assert got == [(1, 6, 3), (8, 9, 1)]


def test_components_of_chains(spark):
    nodes = spark.range(50).withColumnRenamed("id", "n")
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    got = {r["n"]: r["root"] for r in L.components(nodes, "n", links).collect()}
    assert all(got[i] == (0 if i <= 20 else 21 if i <= 40 else i) for i in range(50))


def test_text(spark):
    assert one(spark, T.norm_title(F.lit("  A Title: of--Things! "))) == "a title of things"
    assert one(spark, T.preprint_id(F.lit("see 2401.12345v2"))) == "2401.12345" and one(spark, T.preprint_id(F.lit("2413.12345"))) is None
    assert one(spark, T.doi(F.lit("doi:10.1000/AbC.1)."))) == "10.1000/abc.1"
    assert one(spark, T.scaled_number(F.lit("1.5k stars"))) == 1500
    assert one(spark, T.clean_number(F.lit("~ $1,234.5%"))) == 1234.5
    assert [one(spark, T.partial_date(F.lit(x))) for x in ("2024/3/5", "Feb 13, 2025", "13 February 2025", "March 2024", "2023")] == ["2024-03-05", "2025-02-13", "2025-02-13", "2024-03", "2023"]
    assert one(spark, T.traced(F.lit(0.5), F.lit("scored 50 of it"))) and not one(spark, T.traced(F.lit(0.5), F.lit("scored 51")))
    head, body = T.header(F.lit("a: 1\nb: 2\n\nbody\n\nmore"))
    assert one(spark, head) == {"a": "1", "b": "2"} and one(spark, body) == "body\n\nmore"
    assert one(spark, T.without_references(F.lit("x" * 50 + "\nReferences\n[1]"))) == "x" * 50
    assert one(spark, T.quoted_in(F.lit("A-b"), F.lit("xx a B yy"))) and not one(spark, T.quoted_in(F.lit("--"), F.lit("a")))
    assert one(spark, S.date_window(F.lit("2024"), "2023-05-01", "2024-02-01")) and not one(spark, S.date_window(F.lit("2024-03"), "2023-05-01", "2024-02-01"))


def test_names():
    assert N.normal_name("The  “Fine”—Agent (v2)") == '"fine"-agent'
    assert N.ratio("rciagent", "acidagent") == pytest.approx(82.35, abs=0.01)
    assert N.ratio("", "") == 100 and N.ratio(None, "a") is None
    assert N.partial_ratio("agent", "my agent two") == 100


def test_tails():
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert tails.t_cdf(0, 5) == 0.5
    assert tails.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and tails.chi2_sf(30, 10) == pytest.approx(0.000857, abs=1e-5)
    assert tails.binomial_two_sided(1, 5) == pytest.approx(0.375)
    assert tails.poisson_binomial_tail([0.5, 0.2], 1) == pytest.approx(0.6)


def test_resampling():
    z = np.array([1.0, 2.0, 3.0, 10.0])
    got = R.permutation_test(z, np.array([False, False, False, True]))
    assert got["exact"] and got["p"] == 0.25
    assert R.spearman(np.array([1, 2, 3]), np.array([2, 4, 9]))["p"] == pytest.approx(2 / 6)
    assert R.greedy_budget(np.array([3.0, 2.0, 1.0]), np.array([5.0, 9.0, 4.0]), 10).tolist() == [True, False, True]
    assert R.batches(np.array([1.0, 1.0, 1.0, 9.0]), 2, 9).tolist() == [0, 0, 1, 2]
    assert R.water_fill(np.array([1.0, 9.0, 9.0]), 11).tolist() == [1, 5, 5]
    d = np.abs(np.subtract.outer([0.0, 1, 10, 11, 12], [0.0, 1, 10, 11, 12]))
    label = R.average_linkage(d, 2)
    assert label.tolist() == [0, 0, 1, 1, 1] and R.silhouette(d, label) > 0.8
    assert np.abs(np.subtract.outer(R.scaled(d, 1)[:, 0], R.scaled(d, 1)[:, 0])) == pytest.approx(d, abs=1e-8)
    assert R.trim_and_fill(np.array([0.1, 0.12, 0.11, 0.5, 0.6]), np.full(5, 0.01))["missing"] >= 1
    assert R.null_fill(np.full(3, 1.0), np.full(3, 0.01))["to_halve"] == 3


def test_global_rank_with_other_columns(spark):
    """Above the number of rows that range bounds are sampled from, with columns that the order doesn't have."""
    from stratacell.operators.windows import global_rank

    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("v"), "id", F.sha2(F.col("id").cast("string"), 256).alias("extra"))
    got = global_rank(df, ["v", "id"]).agg(F.countDistinct("rank"), F.max("rank"), F.min("rank"), F.count_if(F.col("rank") < 1)).first()
    assert tuple(got) == (200_000, 200_000, 1, 0)
    own = global_rank(df, ["v", "id"]).orderBy("v", "id").limit(50).collect()
    assert [r["rank"] for r in own] == list(range(1, 51))


def test_numbers_headers_and_references(spark):
    from stratacell.functions import text as X

    def one(f, *texts):
        return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]

    assert one(X.clean_number, "(n=500) 38%", "10-20", "~ $1,234.5", "0.5 ± 0.1", "approx. 7 points", "fast", None) == [38.0, None, 1234.5, 0.5, 7.0, None, None]
    assert one(X.numbers_in, "1,234 and 38 . 0", "12,34") == [[1234.0, 38.0], [12.0, 34.0]]
    assert one(lambda c: X.version_split(c)[0], "Foo v2 agent", "MetaTool 2", "Agent S2.5", "v2") == ["foo agent", "metatool", "agent s", "v2"]
    assert one(lambda c: X.version_split(c)[1], "Foo v2 agent", "MetaTool 2", "Agent S2.5", "v2") == [2, 2, 2, None]
    assert [r[0] for r in spark.range(0, 20_000, 701).select(X.letters(F.col("id"))).limit(3).collect()] == ["a", "zz", "bay"]
    assert one(lambda c: X.header(c)[1], "a: 1\na: 2\n\nbody", "First words.\n\nMore.") == ["body", "First words.\n\nMore."]
    assert one(lambda c: X.header(c)[0]["a"], "a: 1\na: 2\n\nbody") == ["2"]
    text = "References\n" + "x" * 50 + "\nbody ends.  \nReferences\n[1] y"
    assert one(X.without_references, text, "none", "") == [text[: text.rindex("  \nRef")], "none", ""]
    assert one(X.repo_key, "https://GitHub.com/A/b.git", "github.com/a/b/blob/main/x/README.md", "https://a.com/b/c", None) == ["github.com/a/b", "github.com/a/b/x", None, None]
    assert one(lambda c: X.evidence_split(c)[1], "q (a) (b (c))", "q (a", "(x)") == ["b (c)", None, "x"]


def test_studies_that_are_missing():
    """Hand-made: symmetric effects lack none; a lopsided set gets its mirror images."""
    import numpy as np

    from stratacell.operators import resample as R

    v = np.array([0.0001] * 4 + [0.25] * 5)
    y = np.array([0.10, 0.12, 0.08, 0.11, 0.5, 0.6, 0.7, 0.8, 0.9])
    assert R.trim_and_fill(np.linspace(0.1, 0.9, 9), np.full(9, 0.01))["missing"] == 0
    lop = R.trim_and_fill(y, v)
    assert lop["missing"] > 0 and lop["side"] == "right" and lop["adjusted"] < lop["observed"]
    low = R.trim_and_fill(-y, v)
    assert low["side"] == "left" and low["adjusted"] == pytest.approx(-lop["adjusted"])
    assert R.null_fill(np.array([0.5, 0.5]), v[:2])["to_halve"] == -1
    even = R.null_fill(np.full(4, 0.5), np.full(4, 0.01))
    assert even["one_each"] == pytest.approx(0.25) and even["to_halve"] == 4 and even["to_zero"] > 0
    sizes, blocks = np.array([2, 4]), np.array([3, 2])
    from stratacell.functions.tails import poisson_binomial_tail

    assert R.best_by_chance(sizes, blocks, 2) == pytest.approx(poisson_binomial_tail([0.5] * 3 + [0.25] * 2, 2))
    assert 0.4 < R.best_by_chance(np.array([2]), np.array([200_000]), 100_000) < 0.6


def test_clusters_are_chosen():
    x = np.array([0.0, 0.1, 0.2, 5.0, 5.1, 9.0, 9.2])[:, None]
    gap = lambda v: np.abs(v[:, 0][:, None] - v[:, 0][None, :])
    label, score = R.chosen_clusters(gap(x))
    assert label.tolist() == [0, 0, 0, 1, 1, 2, 2] and score > 0.9
    assert R.average_linkage(gap(x), 2).tolist() == [0, 0, 0, 1, 1, 1, 1]
    assert R.chosen_clusters(np.zeros((2, 2)))[0].tolist() == [0, 0]
    two = np.column_stack([np.repeat([0.0, 9.0], 6)] * 10) + np.random.default_rng(1).normal(0, 0.1, (12, 10))
    euclid = lambda v: np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    assert R.chosen_clusters(euclid(two))[1] > R.null_silhouettes(two, euclid, 5) + 0.1
