"""Tests on grouped scores: Brunner-Munzel, paired t, normality, and corrections of many p-values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semaspan.functions.distributions import normal_quantile, normal_upper, t_quantile, t_two_sided, t_upper
from semaspan.plans.joins import lookup_join
from semaspan.plans.ordered import group_quantiles, ordered, running
from semaspan.session import settle


def _rank_statistics(counts: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Brunner-Munzel sums per group from (groups, value, _x, _y), the rows of each side per value.

    x is the first group (FVC), y the second (LVC). All ranks come from counts per distinct value, so
    tied rows never travel one by one.
    """
    keys = list(groups)
    upto = running(ordered(counts, [*keys, value]), keys, {"_ux": ("sum", "_x"), "_uy": ("sum", "_y")})

    def middle(upto_value: Column, n: Column) -> Column:
        return upto_value - (n - 1) / F.lit(2.0)

    x, y = F.col("_x").cast("double"), F.col("_y").cast("double")
    ranks = upto.select(
        *keys, x.alias("_x"), y.alias("_y"),
        middle(F.col("_ux") + F.col("_uy"), x + y).alias("_pooled"),
        middle(F.col("_ux"), x).alias("_in_x"),
        middle(F.col("_uy"), y).alias("_in_y"),
    )
    # placements: pooled rank less rank inside the own side
    px, py = F.col("_pooled") - F.col("_in_x"), F.col("_pooled") - F.col("_in_y")
    nx, ny = F.sum("_x"), F.sum("_y")
    mean_x = F.try_divide(F.sum(F.col("_x") * F.col("_pooled")), nx)
    mean_y = F.try_divide(F.sum(F.col("_y") * F.col("_pooled")), ny)
    means = ranks.groupBy(*keys).agg(
        nx.alias("_nx"), ny.alias("_ny"), mean_x.alias("_mx"), mean_y.alias("_my")
    )
    centred = lookup_join(ranks, means, keys, salts=8)
    dx = px - F.col("_mx") + (F.col("_nx") + 1) / 2
    dy = py - F.col("_my") + (F.col("_ny") + 1) / 2
    return centred.groupBy(*keys).agg(
        F.max("_nx").alias("nx"), F.max("_ny").alias("ny"), F.max("_mx").alias("mx"), F.max("_my").alias("my"),
        F.try_divide(F.sum(F.col("_x") * dx * dx), F.max("_nx") - 1).alias("sx"),
        F.try_divide(F.sum(F.col("_y") * dy * dy), F.max("_ny") - 1).alias("sy"),
    )


def _brunner_munzel_columns() -> dict[str, Column]:
    nx, ny, sx, sy = (F.col(c) for c in ("nx", "ny", "sx", "sy"))
    pooled = nx * sx + ny * sy
    shift = F.col("my") - F.col("mx")
    spread = F.when(pooled > 0, pooled)  # null when the sides do not overlap at all
    return {
        "statistic": nx * ny * shift / ((nx + ny) * F.sqrt(spread)),
        "df": spread * spread / ((nx * sx) * (nx * sx) / (nx - 1) + (ny * sy) * (ny * sy) / (ny - 1)),
        "relative_effect": shift / (nx + ny) + 0.5,
        "_se": F.sqrt(F.try_divide(sx, nx * ny * ny) + F.try_divide(sy, ny * nx * nx)),
    }


def _side_counts(scores: DataFrame, pair: str, kind: str, score: str) -> DataFrame:
    # adding 0.0 makes a negative zero equal to zero
    values = scores.filter(F.col(score).isNotNull()).select(pair, kind, (F.col(score) + 0.0).alias("_value"))
    return values.groupBy(pair, "_value").agg(
        F.count_if(F.col(kind) == "FVC").alias("_x"), F.count_if(F.col(kind) == "LVC").alias("_y")
    )


def brunner_munzel(scores: DataFrame, pair: str = "pair", kind: str = "kind", score: str = "score",
                   confidence: float = 0.95) -> DataFrame:
    """Asymptotic test per pair, first side FVC, second LVC.

    (pair, statistic, df, p_greater, p_two_sided, relative_effect, ci_lower, ci_upper, fvc_n, lvc_n).
    p_greater asks whether LVC scores tend to be greater. Sides that do not overlap have no variance:
    their statistic and p are null and the relative effect is 0 or 1. So have sides below two rows. Null scores
    take no part.
    """
    sums = _rank_statistics(_side_counts(scores, pair, kind, score), [pair], "_value")
    enough = (F.col("nx") >= 2) & (F.col("ny") >= 2)
    tested = sums.withColumns({n: F.when(enough, c) for n, c in _brunner_munzel_columns().items()})
    t, df = F.col("statistic"), F.col("df")
    reach = t_quantile(0.5 + confidence / 2, df) * F.col("_se")
    valid = t.isNotNull()
    return tested.select(
        pair, "statistic", "df",
        F.when(valid, t_upper(t, df)).alias("p_greater"),
        F.when(valid, t_two_sided(t, df)).alias("p_two_sided"),
        "relative_effect",
        F.when(valid, F.col("relative_effect") - reach).alias("ci_lower"),
        F.when(valid, F.col("relative_effect") + reach).alias("ci_upper"),
        F.col("nx").cast("long").alias("fvc_n"),
        F.col("ny").cast("long").alias("lvc_n"),
    )


def brunner_munzel_permutation(scores: DataFrame, n_perm: int, seed: int = 1, pair: str = "pair", kind: str = "kind",
                               row: str = "row", score: str = "score", confidence: float = 0.95) -> DataFrame:
    """Studentised permutation test per pair (Neubert and Brunner 2007).

    (pair, statistic, p_greater, relative_effect, ci_lower, ci_upper, fvc_n, lvc_n). In permutation k
    the rows of a pair are ordered by md5(seed|k|pair|row) and the first fvc_n become FVC.

    A histogram of the draws finds the cut of each permutation, so no draw is sorted except near the
    cuts, and a row finds its own labels. Labels are counted per distinct value before the shuffle.
    """
    scores = scores.filter(F.col(score).isNotNull())
    values = _dealt_by_draws(scores.select(pair, (F.col(score) + 0.0).alias("_value"), F.col(row).alias("_row")), n_perm)
    sums = _rank_statistics(_side_counts(scores, pair, kind, score), [pair], "_value")
    asked = settle(sums.withColumns(_brunner_munzel_columns()).select(
        pair, F.when((F.col("nx") >= 2) & (F.col("ny") >= 2), F.col("statistic")).alias("_seen"),
        "relative_effect", "_se", F.col("nx").cast("long").alias("nx"), F.col("ny").cast("long").alias("ny"),
    ))
    tested = asked.filter("_seen IS NOT NULL").select(pair, "_seen", "nx", "ny")

    def draw(k: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(seed), k, pair, "_row"))

    size = asked.count() * n_perm  # entries of the per-pair tables below: few are broadcast, many are not
    cuts = _permutation_cuts(values, tested, draw, n_perm, pair, size)
    labelled = lookup_join(values, cuts, pair, max_rows=size, salts=8).select(
        pair, "_value", F.posexplode(F.transform("_cuts", lambda cut, k: draw(k + 1) <= cut)).alias("_perm", "_first")
    )
    first = F.col("_first")
    counts = labelled.groupBy(pair, "_perm", "_value").agg(F.count_if(first).alias("_x"), F.count_if(~first).alias("_y"))
    columns = _brunner_munzel_columns()
    # a draw whose sides do not overlap is as far out as any
    far = F.signum(columns["relative_effect"] - 0.5) * 1e308
    drawn = _rank_statistics(counts, [pair, "_perm"], "_value").select(pair, "_perm", F.coalesce(columns["statistic"], far).alias("_w"))
    draws = settle(lookup_join(drawn, tested.select(pair, "_seen"), pair))
    shares = draws.groupBy(pair).agg(F.avg(F.when(F.col("_w") >= F.col("_seen"), 1.0).otherwise(0.0)).alias("_share"))
    half = (1 - confidence) / 2
    reach = group_quantiles(draws, [pair], "_w", {"_low": half, "_high": 1 - half}).drop("n")
    return asked.join(shares, pair, "left").join(reach, pair, "left").select(
        pair,
        F.col("_seen").alias("statistic"),
        F.col("_share").alias("p_greater"),
        F.when((F.col("nx") >= 2) & (F.col("ny") >= 2), F.col("relative_effect")).alias("relative_effect"),
        (F.col("relative_effect") - F.col("_high") * F.col("_se")).alias("ci_lower"),
        (F.col("relative_effect") - F.col("_low") * F.col("_se")).alias("ci_upper"),
        F.col("nx").alias("fvc_n"),
        F.col("ny").alias("lvc_n"),
    )


DRAWS_A_TASK = 1_000_000  # some seconds of work


def _dealt_by_draws(values: DataFrame, n_perm: int) -> DataFrame:
    """`values` in so many tasks that none makes many draws: a row makes one for each permutation, so small scans are long work."""
    tasks = -(-values.count() * n_perm // DRAWS_A_TASK)
    return values if tasks <= values.rdd.getNumPartitions() else values.repartition(tasks, "_row", "_value")


def _permutation_cuts(values: DataFrame, tested: DataFrame, draw, n_perm: int, pair: str,
                      size: int) -> DataFrame:
    """(pair, _cuts): for each permutation the draw of the last row that becomes FVC.

    Draws are counted by their first two digits, which leaves 256 counts per permutation. Only rows
    of the bucket that holds the cut are ordered. The array has one entry per permutation.
    """
    perms = F.sequence(F.lit(1), F.lit(n_perm))

    def bucket(k: Column) -> Column:
        return F.substring(draw(k), 1, 2)

    kept = lookup_join(values, tested.select(pair), pair, "left_semi", max_rows=size, salts=8)
    counted = (
        kept.select(pair, "_row", F.explode(perms).alias("_perm"))
        .groupBy(pair, "_perm", bucket(F.col("_perm")).alias("_bucket"))
        .agg(F.count("*").alias("_n"))
    )
    upto = F.sum("_n").over(W.partitionBy(pair, "_perm").orderBy("_bucket"))
    edges = (
        lookup_join(counted.withColumn("_upto", upto), tested.select(pair, "nx"), pair)
        .filter((F.col("_upto") >= F.col("nx")) & (F.col("_upto") - F.col("_n") < F.col("nx")))
        .select(pair, F.struct("_perm", "_bucket", (F.col("nx") - F.col("_upto") + F.col("_n")).alias("_need")).alias("_edge"))
        .groupBy(pair)
        .agg(F.array_sort(F.collect_list("_edge")).alias("_edges"))
    )
    near = (
        lookup_join(values, edges, pair, max_rows=size, salts=8)
        .select(pair, "_row", F.explode("_edges").alias("_e"))
        .select(pair, "_row", "_e.*")
        .filter(bucket(F.col("_perm")) == F.col("_bucket"))
        .select(pair, "_perm", "_need", draw(F.col("_perm")).alias("_draw"), F.lit(1).alias("_one"))
    )
    placed = running(ordered(near, [pair, "_perm", "_draw"]), [pair, "_perm"], {"_place": ("sum", "_one")})
    cut = placed.filter("_place = _need").select(pair, F.struct("_perm", "_draw").alias("_c"))
    return cut.groupBy(pair).agg(F.transform(F.array_sort(F.collect_list("_c")), lambda c: c["_draw"]).alias("_cuts"))


def bonferroni(tests: DataFrame, families: Sequence[str] = (), p: str = "p_value") -> DataFrame:
    """Add p_bonferroni = min(1, p * number of tests in the family)."""
    keys = list(families)
    sizes = tests.groupBy(*keys).agg(F.count(p).alias("_tests"))
    joined = lookup_join(tests, sizes, keys, salts=8) if keys else tests.withColumn("_tests", sizes.scalar())
    return joined.select(*tests.columns, F.least(F.lit(1.0), F.col(p) * F.col("_tests")).alias("p_bonferroni"))


def benjamini_hochberg(tests: DataFrame, families: Sequence[str] = (), p: str = "p_value") -> DataFrame:
    """Add p_bh: the cumulative minimum, from the largest p down, of p * tests / rank, at most 1.

    Works on distinct p-values in falling order, where the rank of a value is the number of tests
    that are not greater; tied tests get one value.
    """
    keys = list(families)
    named, wanted = tests, tests.columns
    if not keys:
        keys, named = ["_family"], tests.withColumn("_family", F.lit(0))
    counts = named.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_n"))
    falling = ordered(counts, [*[F.col(k) for k in keys], F.col(p).desc()])
    sizes = falling.groupBy(*keys).agg(F.sum("_n").alias("_tests"))
    seen = lookup_join(running(falling, keys, {"_upto": ("sum", "_n")}), sizes, keys, salts=8)
    rank = F.col("_tests") - F.col("_upto") + F.col("_n")
    raw = seen.withColumn("_raw", F.col(p) * F.col("_tests") / rank)
    lowest = running(raw, keys, {"_low": ("min", "_raw")})
    adjusted = lowest.select(*keys, p, F.least(F.lit(1.0), F.col("_low")).alias("p_bh"))
    # many tests may share a p-value, or have none
    return lookup_join(named, adjusted, [*keys, p], "left", salts=8).select(*wanted, "p_bh")


def paired_t(pairs: DataFrame, groups: Sequence[str] = (), x: str = "lvc", y: str = "fvc", confidence: float = 0.95) -> DataFrame:
    """Paired t-test of x - y: n, mean_difference, t, df, both p-values and the interval of the mean."""
    d = F.col(x) - F.col(y)
    sums = pairs.groupBy(*groups).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_sd")
    )
    error = F.try_divide(F.col("_sd"), F.sqrt("n"))
    tested = sums.withColumns({
        "df": (F.col("n") - 1).cast("double"),
        "_error": error,
        "t": F.when(error > 0, F.col("mean_difference") / error),
    })
    reach = t_quantile(0.5 + confidence / 2, F.col("df")) * F.col("_error")
    t, df = F.col("t"), F.col("df")
    return tested.select(
        *groups, "n", "mean_difference", "t", "df",
        F.when(t.isNotNull(), t_two_sided(t, df)).alias("p_two_sided"),
        F.when(t.isNotNull(), t_upper(t, df)).alias("p_greater"),
        F.when(F.col("n") > 1, F.col("mean_difference") - reach).alias("ci_lower"),
        F.when(F.col("n") > 1, F.col("mean_difference") + reach).alias("ci_upper"),
    )


def paired_cohen_d(pairs: DataFrame, groups: Sequence[str] = (), x: str = "lvc", y: str = "fvc") -> DataFrame:
    """Mean difference over the standard deviation within sides (Borenstein et al. 2009)."""
    d = F.col(x) - F.col(y)
    sums = pairs.groupBy(*groups).agg(
        F.count(d).alias("n"), F.avg(d).alias("_mean"), F.stddev_samp(d).alias("_sd"), F.corr(x, y).alias("_r")
    )
    within = F.try_divide(F.col("_sd"), F.sqrt(2 * (1 - F.col("_r"))))
    return sums.select(*groups, "n", F.try_divide(F.col("_mean"), within).alias("cohen_d"))


# Polynomials in 1/sqrt(n), n and log(n) (Royston 1995, AS R94).
_LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
_SECOND_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_SMALL_MEAN = [0.5440, -0.39978, 0.025054, -6.714e-4]
_SMALL_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
_LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
_LARGE_SD = [-0.4803, -0.082676, 0.0030302]
_SMALL_BOUND = [-2.273, 0.459]
LARGEST_CALIBRATED = 5000  # the approximation of the p-value was fitted to samples up to this size


def _poly(coefficients: list[float], x: Column) -> Column:
    value = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(c)
    return value


def shapiro_wilk(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, n, w, p_value, calibrated): normality of the values of each group, by Royston's approximation.

    W compares the ordered values with weights from normal order scores. W and p are null below three rows
    or without spread; `calibrated` says whether the approximation of p was fitted to samples of that size.
    """
    keys = list(groups)
    wanted = list(groups)
    named = df.filter(F.col(value).isNotNull())
    if not keys:
        keys, named = ["_sample"], named.withColumn("_sample", F.lit(0))
    # equal values are parted by a row number, so that they can lie in several slices
    values = named.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_one"), F.monotonically_increasing_id().alias("_tie"))
    rows = ordered(values, [*keys, "_v", "_tie"])
    placed = running(rows, keys, {"_i": ("sum", "_one")})
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("_mean"))
    scored = lookup_join(placed, sizes, keys, salts=8).withColumn(
        "_m", normal_quantile((F.col("_i") - 0.375) / (F.col("n") + 0.25))
    )
    i, n = F.col("_i"), F.col("n")
    spread = F.col("_v") - F.col("_mean")
    sums = scored.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum(F.col("_m") * F.col("_m")).alias("_mm"),
        F.max(F.when(i == n, F.col("_m"))).alias("_m_last"),
        F.max(F.when(i == n - 1, F.col("_m"))).alias("_m_second"),
        F.sum(spread * spread).alias("_ss"),
        F.sum(F.col("_m") * F.col("_v")).alias("_mv"),
        F.max(F.when(i == n, F.col("_v"))).alias("_v_last"),
        F.max(F.when(i == 1, F.col("_v"))).alias("_v_first"),
        F.max(F.when(i == n - 1, F.col("_v"))).alias("_v_last2"),
        F.max(F.when(i == 2, F.col("_v"))).alias("_v_first2"),
    )
    root = 1 / F.sqrt("n")
    unit = F.sqrt("_mm")
    last = _poly(_LAST_WEIGHT, root) + F.col("_m_last") / unit
    second = _poly(_SECOND_WEIGHT, root) + F.col("_m_second") / unit
    m1, m2 = F.col("_m_last"), F.col("_m_second")
    # the two (n > 5) or one outer weights on each side are set, the rest are scaled to length one
    rest_two = (F.col("_mm") - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * last * last - 2 * second * second)
    rest_one = (F.col("_mm") - 2 * m1 * m1) / (1 - 2 * last * last)
    rest = F.sqrt(F.when(F.col("n") > 5, rest_two).otherwise(rest_one))
    outer1 = F.col("_v_last") - F.col("_v_first")
    outer2 = F.col("_v_last2") - F.col("_v_first2")
    inner_two = (F.col("_mv") - m1 * outer1 - m2 * outer2) / rest
    inner_one = (F.col("_mv") - m1 * outer1) / rest
    weighted = (
        F.when(F.col("n") == 3, F.lit(math.sqrt(0.5)) * outer1)
        .when(F.col("n") > 5, last * outer1 + second * outer2 + inner_two)
        .otherwise(last * outer1 + inner_one)
    )
    enough = (F.col("n") >= 3) & (F.col("_ss") > 0)
    w = F.when(enough, F.least(weighted * weighted / F.col("_ss"), F.lit(1.0)))
    result = sums.withColumn("w", w)
    size, log_n, gap = F.col("n").cast("double"), F.log(F.col("n").cast("double")), F.log(1 - F.col("w"))
    small = (-F.log(_poly(_SMALL_BOUND, size) - gap) - _poly(_SMALL_MEAN, size)) / F.exp(_poly(_SMALL_SD, size))
    large = (gap - _poly(_LARGE_MEAN, log_n)) / F.exp(_poly(_LARGE_SD, log_n))
    z = F.when(F.col("n") <= 11, small).otherwise(large)
    three = 6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75)))
    p = (
        F.when(F.col("n") == 3, F.greatest(three, F.lit(0.0)))
        .otherwise(normal_upper(z))
    )
    calibrated = F.col("n") <= LARGEST_CALIBRATED
    return result.select(*wanted, "n", "w", F.when(F.col("w").isNotNull(), p).alias("p_value"), calibrated.alias("calibrated"))
