"""Weighted estimates with design-based errors, entropy, agreement and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_ratio(units: DataFrame, y: Column, x: Column, weight: Column, stratum: Column, sizes: DataFrame, by: tuple[str, ...] = (), all_strata: bool = False) -> DataFrame:
    """R = sum(w y) / sum(w x) by group, with the stratified variance of its residuals.

    sizes has stratum and size (N_h) and is small. Units with weight or x not
    above 0 are left out. Strata with one unit add no variance. The groups'
    ratios return to the units by one join; both aggregates combine on the map side.
    """
    base = units.select(*by, y.cast("double").alias("y"), x.cast("double").alias("x"), weight.cast("double").alias("w"), stratum.alias("stratum")).filter((F.col("w") > 0) & (F.col("x") > 0))
    ratio = base.groupBy(*by).agg((F.sum(F.col("w") * F.col("y")) / F.sum(F.col("w") * F.col("x"))).alias("ratio"), F.count(F.lit(1)).alias("n"))
    own = base.join(ratio.select(*by, "ratio"), list(by)) if by else base.crossJoin(F.broadcast(ratio.select("ratio")))
    per = own.groupBy(*by, "stratum").agg(F.var_samp(F.col("y") - F.col("ratio") * F.col("x")).alias("s2"), F.count(F.lit(1)).alias("nh"), F.sum("x").alias("xh"))
    per = per.join(sizes.select("stratum", F.col("size").cast("double").alias("size")), "stratum")
    term = F.when(F.col("nh") > 1, F.col("size") * F.col("size") * (1 - F.col("nh") / F.col("size")) * F.col("s2") / F.col("nh")).otherwise(0.0)
    total = F.sum(F.col("size") * F.col("xh") / F.col("nh"))
    variance = per.groupBy(*by).agg((F.sum(F.greatest(term, F.lit(0.0))) / (total * total)).alias("variance"))
    out = ratio.join(variance, list(by)) if by else ratio.crossJoin(variance)
    return out.select(*by, "n", F.round("ratio", 6).alias("ratio"), F.round(F.sqrt("variance"), 6).alias("se"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of a share."""
    n = n.cast("double")
    p = successes / n
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / scale, (mid + half) / scale


def entropy(counts: DataFrame, n: str, *by: str) -> DataFrame:
    """Plug-in entropy in nats, and with Miller and Madow's correction, of counts by group."""
    total = counts.groupBy(*by).agg(F.sum(n).alias("total"), F.sum(F.col(n) * F.log(n)).alias("nlogn"), F.count_if(F.col(n) > 0).alias("k"))
    h = F.greatest(F.log("total") - F.col("nlogn") / F.col("total"), F.lit(0.0))
    return total.select(*by, F.col("total").cast("long").alias("total"), "k", F.round(h, 6).alias("entropy"), F.round(h + (F.col("k") - 1) / (2 * F.col("total")), 6).alias("entropy_mm"))


def confusion(pairs: DataFrame, a: str, b: str, weight: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sum(w).alias("n"))


def kappa(pairs: DataFrame, a: str, b: str, weight: Column | None = None, by: tuple[str, ...] = (), certain: float | None = None) -> DataFrame:
    """Cohen's kappa from the confusion counts; certain is the value where chance agreement is 1 (null, or 1.0 as some studies have it)."""
    c = confusion(pairs, a, b, weight, by)
    total = c.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)).alias("agree"))
    rows = c.groupBy(*by, F.col("a").alias("v")).agg(F.sum("n").alias("ra"))
    cols = c.groupBy(*by, F.col("b").alias("v")).agg(F.sum("n").alias("rb"))
    chance = rows.join(cols, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("ra") * F.col("rb")).alias("chance"))
    both = total.join(chance, list(by), "left") if by else total.crossJoin(chance)
    po, pe = F.col("agree") / F.col("n"), F.coalesce("chance", F.lit(0.0)) / (F.col("n") * F.col("n"))
    k = F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(certain))
    return both.select(*by, F.round("n", 6).alias("n"), F.round(po, 6).alias("po"), F.round(pe, 6).alias("pe"), F.round(k, 6).alias("kappa"))


def gwet_ac1(pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Gwet's AC1: chance from the mean share of each category."""
    own = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    total = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agree"))
    votes = own.select(*by, F.explode(F.array(F.col(a), F.col(b))).alias("v")).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("m"))
    both = votes.join(total, list(by)) if by else votes.crossJoin(F.broadcast(total))
    share = F.col("m") / (2 * F.col("n"))
    q = both.groupBy(*by).agg(F.max("n").alias("n"), F.max("agree").alias("agree"), F.count(F.lit(1)).alias("q"), F.sum(share * (1 - share)).alias("s"))
    pe, po = F.when(F.col("q") < 2, 0.0).otherwise(F.try_divide(F.col("s"), F.col("q") - 1)), F.col("agree") / F.col("n")
    return q.select(*by, "n", F.col("q"), F.round((po - pe) / (1 - pe), 6).alias("ac1"))


def pooled(studies: DataFrame, y: str, v: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Random-effects pooling after DerSimonian and Laird, in closed form: one aggregate, one join, one aggregate."""
    w = 1 / F.col(v)
    first = studies.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * F.col(y)).alias("swy"), F.sum(w * w).alias("sww"), F.sum(w * F.col(y) * F.col(y)).alias("swyy"))
    q = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    c = F.col("sw") - F.col("sww") / F.col("sw")
    first = first.withColumns({"q": q, "tau2": F.when(F.col("k") > 1, F.greatest((q - (F.col("k") - 1)) / c, F.lit(0.0))).otherwise(0.0)})
    own = studies.join(first.select(*by, "tau2"), list(by)) if by else studies.crossJoin(F.broadcast(first.select("tau2")))
    ws = 1 / (F.col(v) + F.col("tau2"))
    second = own.groupBy(*by).agg(F.sum(ws).alias("s"), F.sum(ws * F.col(y)).alias("sy"))
    out = first.join(second, list(by)) if by else first.crossJoin(second)
    i2 = F.when(F.col("q") > 0, F.greatest((F.col("q") - (F.col("k") - 1)) / F.col("q"), F.lit(0.0))).otherwise(0.0)
    r = lambda x, name: F.round(x, 6).alias(name)
    return out.select(*by, "k", r(F.col("q"), "q"), r(F.col("tau2"), "tau2"), r(i2, "i2"), r(F.col("sy") / F.col("s"), "mu"), r(1 / F.sqrt("s"), "se"))


def egger(studies: DataFrame, y: str, v: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Slope and intercept of effect over error against precision."""
    sd = F.sqrt(F.col(v))
    own = studies.select(*by, (F.col(y) / sd).alias("z"), (1 / sd).alias("p"))
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.round(F.regr_slope("z", "p"), 6).alias("slope"), F.round(F.regr_intercept("z", "p"), 6).alias("intercept"))


def cramers_v(pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Cramer's V, plain and with Bergsma's correction, from counts; weights are rescaled to Kish's effective size."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    own = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("a"), F.col(b).alias("b"), w.alias("w"))
    cell = own.groupBy(*by, "a", "b").agg(F.sum("w").alias("o"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    ra, rb = cell.groupBy(*by, "a").agg(F.sum("o").alias("ra")), cell.groupBy(*by, "b").agg(F.sum("o").alias("rb"))
    total = cell.groupBy(*by).agg(F.sum("o").alias("n"), F.sum("ww").alias("ww"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c"))
    on = list(by)
    x = cell.select(*by, "a", "b", "o").join(ra, [*on, "a"]).join(rb, [*on, "b"])
    x = x.join(total.select(*by, "n"), on) if by else x.crossJoin(F.broadcast(total.select("n")))
    # The sum over all cells, empty ones too, of (o - e)^2 / e is n (sum of o^2 / (ra rb) - 1).
    s = x.groupBy(*by).agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("s"))
    out = total.join(s, on) if by else total.crossJoin(s)
    n = F.col("n") * F.col("n") / F.col("ww")
    phi2 = F.greatest(F.col("s") - 1, F.lit(0.0))
    small = F.least("r", "c") - 1
    corrected = F.greatest(phi2 - (F.col("r") - 1) * (F.col("c") - 1) / (n - 1), F.lit(0.0))
    r2, c2 = (F.col(k) - (F.col(k) - 1) * (F.col(k) - 1) / (n - 1) for k in ("r", "c"))
    least = F.least(r2 - 1, c2 - 1)
    return out.select(
        *by, F.round(n, 6).alias("n"), F.round(n * phi2, 4).alias("chi2"), F.round(F.when(small > 0, F.sqrt(phi2 / small)), 6).alias("v"), F.round(F.when((small > 0) & (least > 0), F.sqrt(corrected / least)), 6).alias("v_corrected")
    )


def first_to_last(measures: DataFrame, when: str, value: str, *by: str) -> DataFrame:
    """First and last value of each group and the change."""
    return measures.groupBy(*by).agg(F.min_by(value, when).alias("first"), F.max_by(value, when).alias("last")).withColumn("change", F.round(F.col("last") - F.col("first"), 6))


def fixed_effect(panel: DataFrame, key: str, z: str, x: str) -> DataFrame:
    """Slope of z on x within keys, with the sandwich error clustered by key."""
    own = Window.partitionBy(key)
    d = panel.select(key, (F.col(z) - F.avg(z).over(own)).alias("zd"), (F.col(x) - F.avg(x).over(own)).alias("xd"))
    per = d.groupBy(key).agg(F.sum(F.col("zd") * F.col("xd")).alias("zx"), F.sum(F.col("xd") * F.col("xd")).alias("xx"))
    total = per.agg(F.sum("zx").alias("szx"), F.sum("xx").alias("sxx"), F.count(F.lit(1)).alias("keys")).withColumn("beta", F.col("szx") / F.col("sxx"))
    meat = per.crossJoin(F.broadcast(total)).agg(F.max("beta").alias("beta"), F.max("keys").alias("keys"), F.max("sxx").alias("sxx"), F.sum((F.col("zx") - F.col("beta") * F.col("xx")) * (F.col("zx") - F.col("beta") * F.col("xx"))).alias("meat"))
    return meat.select("keys", F.round("beta", 6).alias("beta"), F.round(F.sqrt("meat") / F.col("sxx"), 6).alias("se"))
