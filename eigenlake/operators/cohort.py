"""Cohort statistics on maps (subject, grp, vid, value) and related tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import counted, midranks, quantiles, running

TINY = 1e-30


def two_groups(maps: DataFrame, a: str, b: str) -> DataFrame:
    """(vid, n_a, mean_a, var_a, n_b, mean_b, var_b): one aggregation serves every two-sample statistic."""
    of = lambda g, f: f(F.when(F.col("grp") == g, F.col("value")))
    return maps.where(F.col("grp").isin(a, b)).groupBy("vid").agg(*(of(g, f).alias(f"{n}_{s}") for s, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))


def ttest(maps: DataFrame, a: str, b: str, pooled: bool = False) -> DataFrame:
    """(vid, t, df, cohens_d, hedges_g) of group a against b; undefined statistics are 0."""
    s = two_groups(maps, a, b)
    na, nb, va, vb = (F.col(c).cast("double") for c in ("n_a", "n_b", "var_a", "var_b"))
    diff, both = F.col("mean_a") - F.col("mean_b"), na + nb - 2
    common = ((na - 1) * va + (nb - 1) * vb) / F.nullif(both, F.lit(0.0))
    se = F.sqrt(common * (1 / na + 1 / nb)) if pooled else F.sqrt(va / na + vb / nb)
    df = both if pooled else F.pow(va / na + vb / nb, F.lit(2.0)) / F.nullif(F.pow(va / na, F.lit(2.0)) / (na - 1) + F.pow(vb / nb, F.lit(2.0)) / (nb - 1), F.lit(0.0))
    d = diff / (F.sqrt(common) + TINY)
    return s.select("vid", F.coalesce(diff / F.nullif(se, F.lit(0.0)), F.lit(0.0)).alias("t"), df.alias("df"), d.alias("cohens_d"), (d * (1 - 3 / (4 * both - 1))).alias("hedges_g"))


def mannwhitney(maps: DataFrame, a: str, b: str) -> DataFrame:
    """(vid, u): the U statistic of group a, ties by midranks, from counts of each value; null without a row of group a."""
    values = counted(maps.where(F.col("grp").isin(a, b)).select("vid", "grp", "value"), "value", ["vid"], n_a=F.count(F.when(F.col("grp") == a, 1)))
    n, total = F.sum("n_a"), F.sum(F.col("n_a") * (F.col("upto") - (F.col("n") - 1) / 2))
    return values.groupBy("vid").agg(F.when(n > 0, total - n * (n + 1) / 2).alias("u"))


def kruskal(rows: DataFrame, group: str, value: str, *by: str) -> DataFrame:
    """(by..., h, groups, n): Kruskal-Wallis H with the correction for ties, over groups of more than one."""
    sizes = rows.groupBy(*by, group).agg(F.count("*").alias("m")).where("m > 1").drop("m")
    ranked = midranks(rows.join(sizes, [*by, group]), value, "r", *by)
    per = ranked.groupBy(*by, group).agg(F.sum("r").alias("r"), F.count("*").alias("m")).groupBy(*by).agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("m").alias("n"), F.count("*").alias("groups"))
    ties = ranked.groupBy(*by, value).agg(F.count("*").cast("double").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    joined = per.join(ties, list(by)) if by else per.crossJoin(F.broadcast(ties))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    return joined.select(*by, h.alias("h"), "groups", "n")


def benjamini_hochberg(p_values: DataFrame, *by: str) -> DataFrame:
    """(id, p, p_fdr, p_bonferroni) within each family ``by``; equal p by id."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    raw = p_values.withColumn("q", F.col("p") * n / F.row_number().over(w.orderBy("p", "id"))).withColumn("n", n)
    down = Window.partitionBy(*by).orderBy(F.desc("p"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.select(*by, "id", "p", F.least(F.min("q").over(down), F.lit(1.0)).alias("p_fdr"), F.least(F.col("p") * F.col("n"), F.lit(1.0)).alias("p_bonferroni"))


def partial_correlation(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., r, partial_r, n): Pearson of x and y, and after both are regressed on z."""
    c = lambda a, b: F.corr(a, b)
    s = rows.groupBy(*by).agg(c("x", "y").alias("xy"), c("x", "z").alias("xz"), c("y", "z").alias("yz"), F.count("*").alias("n"))
    left = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return s.select(*by, F.col("xy").alias("r"), ((F.col("xy") - F.col("xz") * F.col("yz")) / F.nullif(left, F.lit(0.0))).alias("partial_r"), "n")


def spearman(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., rho): correlation of midranks of x and y."""
    ranked = midranks(midranks(rows, "x", "rx", *by), "y", "ry", *by)
    return ranked.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"))


def profile(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, population deviation, extremes, quartiles, skewness, excess kurtosis and 3-sigma outliers."""
    v = F.col(value)
    s = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    parts = quantiles(rows, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, *by)
    s = s.join(parts, list(by), "left") if by else s.crossJoin(F.broadcast(parts))
    z = rows.join(s.select(*by, "mean", "std"), list(by)).withColumn("z", (v - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))
    m = z.groupBy(*by).agg(F.avg(F.col("z") * F.col("z") * F.col("z")).alias("skewness"), (F.avg(F.pow("z", F.lit(4.0))) - 3).alias("kurtosis"), F.count_if(F.abs("z") > 3).alias("outliers"))
    return s.join(m, list(by))


def icc(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(icc_2_1, icc_3_1) of two measurements a row, from sums of squares, kept within -1 and 1."""
    x = pairs.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null")
    s = x.agg(F.count("*").cast("double").alias("n"), F.var_samp((F.col("a") + F.col("b")) / 2).alias("vm"), F.avg(F.pow((F.col("a") - F.col("b")), F.lit(2.0))).alias("d2"), F.avg(F.col("a") - F.col("b")).alias("d"))
    n = F.col("n")
    rows, cols = 2 * F.col("vm"), n * F.col("d") * F.col("d") / 2
    error = (n * F.col("d2") / 2 - cols) / (n - 1)
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    return s.select(clip((rows - error) / (rows + error + 2 * (cols - error) / n)).alias("icc_2_1"), clip((rows - error) / (rows + error)).alias("icc_3_1"))


def delong_ranks(scores: DataFrame, s: str) -> DataFrame:
    """Scores with midranks of s among all rows and among those of the same label; no task sees all scores."""
    v = scores.where(F.col(s).isNotNull()).groupBy(F.col(s).alias("v")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    rank = lambda c: F.col(f"{c}_upto") - (F.col(c) - 1) / 2
    table = running(v, "v", "p", "q").select("v", (rank("p") + rank("q") - 0.5).alias(f"{s}_all"), rank("p").alias("rp"), rank("q").alias("rq"))
    return scores.join(table, F.col(s) == F.col("v"), "left").withColumn(f"{s}_own", F.when(F.col("y") == 1, F.col("rp")).otherwise(F.col("rq"))).drop("v", "rp", "rq")


def delong(scores: DataFrame) -> DataFrame:
    """(auc_a, auc_b, var_a, var_b, cov_ab, z) of two scores s_a and s_b against labels y in 0/1, from placement values; z is 0 for equal AUCs, null where they differ without variance."""
    r = scores
    for s in ("s_a", "s_b"):
        r = delong_ranks(r, s)
    counts = scores.agg(F.count_if(F.col("y") == 1).cast("double").alias("m"), F.count_if(F.col("y") == 0).cast("double").alias("n"))
    r = r.crossJoin(F.broadcast(counts))
    place = lambda s: F.when(F.col("y") == 1, (F.col(f"{s}_all") - F.col(f"{s}_own")) / F.col("n")).otherwise(1 - (F.col(f"{s}_all") - F.col(f"{s}_own")) / F.col("m"))
    r = r.select("y", "m", "n", place("s_a").alias("v_a"), place("s_b").alias("v_b"))
    of = lambda y, c: F.when(F.col("y") == y, F.col(c))
    total = lambda f, *c: f(*(of(1, x) for x in c)) / F.first("m") + f(*(of(0, x) for x in c)) / F.first("n")
    out = r.agg(F.avg(of(1, "v_a")).alias("auc_a"), F.avg(of(1, "v_b")).alias("auc_b"), total(F.var_samp, "v_a").alias("var_a"), total(F.var_samp, "v_b").alias("var_b"), total(F.covar_samp, "v_a", "v_b").alias("cov_ab"))
    spread = F.col("var_a") + F.col("var_b") - 2 * F.col("cov_ab")
    return out.withColumn("z", F.when(F.col("auc_a") == F.col("auc_b"), 0.0).when(spread > TINY, (F.col("auc_a") - F.col("auc_b")) / F.sqrt(spread)))


def combat(rows: DataFrame) -> DataFrame:
    """Site-harmonised values (subject, site, feature, value, harmonised) without covariates.

    The grand mean is the unweighted mean of the site means, the scale the
    pooled residual deviation; site shifts and scales are shrunk across sites
    within a feature by empirical Bayes, in one step.
    """
    site = rows.groupBy("feature", "site").agg(F.avg("value").alias("mu"), F.var_pop("value").alias("vp"), F.count("*").cast("double").alias("n"))
    grand = site.groupBy("feature").agg(F.avg("mu").alias("grand"), (F.sum(F.col("vp") * F.col("n")) / F.sum("n")).alias("pooled"))
    s = site.join(grand, "feature").withColumn("sd", F.sqrt("pooled") + TINY)
    s = s.withColumn("gamma", (F.col("mu") - F.col("grand")) / F.col("sd")).withColumn("delta", F.when(F.col("n") > 1, F.col("vp") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0.0))).otherwise(0.0) / (F.col("sd") * F.col("sd")))
    prior = s.groupBy("feature").agg(F.avg("gamma").alias("g"), F.coalesce(F.var_samp("gamma"), F.lit(0.0)).alias("tau"), F.avg("delta").alias("dm"), F.coalesce(F.var_samp("delta"), F.lit(0.0)).alias("dv"))
    s = s.join(prior, "feature")
    alpha, beta = (2 * F.col("dv") + F.col("dm") * F.col("dm")) / (F.col("dv") + TINY), (F.col("dm") * F.col("dv") + F.pow("dm", F.lit(3.0))) / (F.col("dv") + TINY)
    gamma = (F.col("n") * F.col("tau") * F.col("gamma") + F.col("delta") * F.col("g")) / (F.col("n") * F.col("tau") + F.col("delta") + TINY)
    s = s.withColumn("gamma_star", gamma)
    delta = (beta + F.col("n") * F.col("delta") / 2) / (alpha + F.col("n") / 2 + 1)
    s = s.select("feature", "site", "grand", "sd", "gamma_star", delta.alias("delta_star"))
    z = (F.col("value") - F.col("grand")) / F.col("sd")
    return rows.join(s, ["feature", "site"]).select("subject", "site", "feature", "value", ((z - F.col("gamma_star")) / F.sqrt(F.greatest("delta_star", F.lit(TINY))) * F.col("sd") + F.col("grand")).alias("harmonised"))


def normative(rows: DataFrame, *by: str) -> DataFrame:
    """(id, value, expected, z, extreme) by a line in age for each ``by``; the residual deviation has two degrees fewer; extreme is -1, 0 or 1 beyond two deviations."""
    m = rows.groupBy(*by).agg(F.regr_slope("value", "age").alias("slope"), F.regr_intercept("value", "age").alias("intercept"), F.regr_syy("value", "age").alias("syy"), F.regr_sxy("value", "age").alias("sxy"), F.count("*").alias("n"))
    sigma = F.sqrt(F.greatest((F.col("syy") - F.col("slope") * F.col("sxy")) / F.nullif(F.col("n") - 2, F.lit(0)), F.lit(0.0)))
    joined = rows.join(m, list(by)) if by else rows.crossJoin(F.broadcast(m))
    expected = F.col("intercept") + F.col("slope") * F.col("age")
    z = (F.col("value") - expected) / (sigma + TINY)
    return joined.select(*by, "id", "value", expected.alias("expected"), z.alias("z"), F.when(z > 2, 1).when(z < -2, -1).otherwise(0).alias("extreme"))


def centile_curves(rows: DataFrame, width: float, *by: str) -> DataFrame:
    """(bin, age, n, p5, p25, p50, p75, p95) in age bins of equal width from 0."""
    b = F.floor(F.col("age") / width)
    rows = rows.withColumn("bin", b)
    parts = quantiles(rows, "value", {f"p{q}": q / 100 for q in (5, 25, 50, 75, 95)}, *by, "bin")
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n")).join(parts, [*by, "bin"], "left").withColumn("age", (F.col("bin") + 0.5) * width)


def lateralisation(pairs: DataFrame) -> DataFrame:
    """(feature, li, paired_t): mean of (L-R)/(|L|+|R|), and the paired t of L-R."""
    d = F.col("left") - F.col("right")
    li = d / (F.abs("left") + F.abs("right") + TINY)
    return pairs.groupBy("feature").agg(F.avg(li).alias("li"), F.coalesce(F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count("*")), F.lit(0.0)), F.lit(0.0)).alias("paired_t"))


def stability(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, std, cv) across shapes; population deviation."""
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.stddev_pop(value) / (F.abs(F.avg(value)) + TINY)).alias("cv"))
