"""Cross-sectional operators: each row against the others of its cohort (a day, a month, a group)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .ranks import quantiles, running_before, with_group_rank, with_rank


def average_rank(x: str, cohort: Sequence[str]) -> Column:
    """1-based rank with ties sharing their mean, over rows where x is not null."""
    order = Window.partitionBy(*cohort).orderBy(F.col(x).asc_nulls_last())
    ties = F.count("*").over(Window.partitionBy(*cohort, x))
    return F.when(F.col(x).isNotNull(), F.rank().over(order) + (ties - 1) / 2.0)


def _n(x: str, cohort: Sequence[str]) -> Column:
    return F.count(x).over(Window.partitionBy(*cohort))


def cohort_rank(df: DataFrame, cohort: Sequence[str], x: str, least: int = 2) -> DataFrame:
    """<x>_rank in [0, 1]: (rank - 1) / (n - 1); NULL in cohorts under ``least``."""
    n = _n(x, cohort)
    return df.withColumn(f"{x}_rank", F.when(n >= least, (average_rank(x, cohort) - 1) / (n - 1)))


def percent_rank(df: DataFrame, cohort: Sequence[str], x: str) -> DataFrame:
    """<x>_pct in (0, 1]: rank / n."""
    return df.withColumn(f"{x}_pct", average_rank(x, cohort) / _n(x, cohort))


def zscore(df: DataFrame, cohort: Sequence[str], x: str) -> DataFrame:
    w = Window.partitionBy(*cohort)
    return df.withColumn(f"{x}_z", F.try_divide(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w)))


def winsorize(df: DataFrame, cohort: Sequence[str], x: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """<x>_w: x clipped to the cohort's quantiles (linear between values)."""
    joined = df.join(quantiles(df, cohort, x, {"__lo": lower, "__hi": upper}), list(cohort), "left")
    return joined.withColumn(f"{x}_w", F.when(F.col(x).isNotNull(), F.least(F.greatest(x, "__lo"), "__hi"))).drop("__lo", "__hi")


def deciles(df: DataFrame, cohort: Sequence[str], score: str, result: str, bins: int = 10) -> DataFrame:
    """(cohort, decile, n, mean_result): bins of the 0-based average rank; cohorts under ``bins`` rows give none."""
    both = df.filter(F.col(score).isNotNull() & F.col(result).isNotNull())
    n = _n(score, cohort)
    ranked = both.withColumn("__n", n).withColumn("decile", F.least(F.floor((average_rank(score, cohort) - 1) / n * bins), F.lit(bins - 1)).cast("int"))
    return ranked.filter(F.col("__n") >= bins).groupBy(*cohort, "decile").agg(F.count("*").alias("n"), F.avg(result).alias("mean_result"))


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's correlation where both are known; NULL, and no error, where one does not vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def with_both_ranks(df: DataFrame, cohort: Sequence[str], a: str, b: str) -> DataFrame:
    """df with ``__a`` and ``__b``: the average ranks of a and b in the cohort, by counts of values, so that no task sorts a cohort. Nulls in the cohort's keys are equal."""
    rows = cut(df.select(*cohort, a, b).withColumn("__g", F.struct(*cohort)))
    total = rows.count()
    return with_group_rank(with_group_rank(rows, ["__g"], a, "__a", total), ["__g"], b, "__b", total).drop("__g")


def rank_correlation(df: DataFrame, cohort: Sequence[str], a: str, b: str, least: int = 3) -> DataFrame:
    """(cohort, n, ic): Spearman's correlation; NULL for small or constant cohorts."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = with_both_ranks(both, cohort, a, b)
    moved = (F.min(a) != F.max(a)) & (F.min(b) != F.max(b)) & (F.count("*") >= least)
    return ranked.groupBy(*cohort).agg(F.count("*").alias("n"), F.when(moved, correlation(F.col("__a"), F.col("__b"))).alias("ic"))


def offset_summary(ic: DataFrame, month: str, horizon: int, least_months: int = 24, least_each: int = 6, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics of monthly series in ``horizon`` classes that do not overlap: (keys, classes, months, mean_ic, mean_t, positive_share).

    Classes of few months or without deviation count for neither mean; months and the positive share are
    those of the whole series, where an ic within 1e-12 of zero is not positive. Too short series give no
    row. A series of months is some hundred rows, whatever the panel.
    """
    numbered = ic.filter("ic is not null").withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(month)) - 1)
    per = numbered.groupBy(*keys, F.pmod("__i", F.lit(horizon)).alias("__k")).agg(F.count("*").alias("n"), F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.count_if(F.col("ic") > 1e-12).alias("p"))
    kept = (F.col("n") >= least_each) & (F.col("s") > 0)
    out = per.groupBy(*keys).agg(
        F.count_if(kept).alias("classes"), F.sum("n").alias("months"), F.avg(F.when(kept, F.col("m"))).alias("mean_ic"),
        F.avg(F.when(kept, F.col("m") / (F.col("s") / F.sqrt("n")))).alias("mean_t"), (F.sum("p") / F.sum("n")).alias("positive_share"),
    )
    return out.filter((F.col("months") >= least_months) & (F.col("classes") > 0))


def feature_report(df: DataFrame, features: Sequence[str], month: str, target: str, stratum: str, horizon: int, half_at: str, least_names: int = 8, least_months: int = 24, least_stratum: int = 12, least_average: float = 15) -> DataFrame:
    """A row a feature: its monthly rank correlation with the target over classes of months, its stability and a label.

    (feature, months, mean_ic, mean_t, positive_share, missing_pct, names, first_half, second_half, strata, label).
    DATA_QUALITY_LIMITED: over half is missing, too few months or too few names a month. UNSTABLE: the sign
    differs between halves or strata. PROMISING: |ic| >= 0.03 with |t| >= 2 and at most 30 % missing. Else WEAK.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("__x")) for f in features]))
    long = df.select(F.col(month).alias("__m"), F.col(target).alias("__y"), F.col(stratum).alias("__s"), each.alias("f")).select("__m", "__y", "__s", "f.*")
    ic = rank_correlation(long, ["feature", "__m"], "__x", "__y", least_names).filter("ic is not null")
    first = F.col("__m") < F.lit(half_at).cast(df.schema[month].dataType)
    halves = ic.groupBy("feature").agg(*[F.when(F.count(F.when(c, 1)) >= least_stratum, F.avg(F.when(c, F.col("ic")))).alias(n) for c, n in ((first, "first_half"), (~first, "second_half"))])
    strata = rank_correlation(long.filter(F.col("__s").isNotNull()), ["feature", "__s", "__m"], "__x", "__y", least_names).filter("ic is not null")
    strata = strata.groupBy("feature", "__s").agg(F.count("*").alias("n"), F.avg("ic").alias("ic")).filter(F.col("n") >= least_stratum)
    sign = lambda c: F.when(F.abs(c) >= 1e-12, F.signum(c))
    strata = strata.groupBy("feature").agg(F.count("*").alias("strata"), F.min(sign(F.col("ic"))).alias("__lo"), F.max(sign(F.col("ic"))).alias("__hi"))
    missing = long.groupBy("feature").agg((F.avg(F.col("__x").isNull().cast("double")) * 100).alias("missing_pct"))
    pairs = long.filter(F.col("__x").isNotNull() & F.col("__y").isNotNull()).groupBy("feature", "__m").agg(F.count("*").alias("n")).groupBy("feature").agg(F.avg("n").alias("names"))
    out = missing
    for t in (pairs, offset_summary(ic, "__m", horizon, least_months, keys=["feature"]), halves, strata):
        out = out.join(t, "feature", "left")
    signs = [F.col("__lo"), F.col("__hi"), sign(F.col("first_half")), sign(F.col("second_half"))]
    i, t = F.col("mean_ic"), F.col("mean_t")
    poor = (F.col("missing_pct") > 50) | i.isNull() | (F.coalesce("names", F.lit(0.0)) < least_average)
    agrees = F.coalesce(sign(i) == F.coalesce(*signs), F.lit(True))
    promising = (F.abs(i) >= 0.03) & (F.abs(t) >= 2) & (F.col("missing_pct") <= 30) & agrees
    label = F.when(poor, "DATA_QUALITY_LIMITED").when(F.greatest(*signs) != F.least(*signs), "UNSTABLE").when(F.abs(i) < 0.02, "WEAK").when(promising, "PROMISING").otherwise("WEAK")
    return out.select("feature", "months", "mean_ic", "mean_t", "positive_share", "missing_pct", "names", "first_half", "second_half", F.coalesce("strata", F.lit(0)).cast("long").alias("strata"), label.alias("label"))


def auc(df: DataFrame, groups: Sequence[str], score: str, outcome: str, least: int = 1) -> DataFrame:
    """(groups, n_pos, n_neg, auc): the share of pairs of a hit and a miss that the score puts right, ties by half.

    NULL with fewer than ``least`` rows of a class. Counts by score are added up over ranges of scores.
    """
    both = df.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    counts = both.groupBy(*groups, score).agg(F.count_if(F.col(outcome) == 1).alias("pos"), F.count_if(F.col(outcome) == 0).alias("neg"))
    placed = running_before(counts, groups, score, ["neg"])
    pos, neg = F.sum("pos"), F.sum("neg")
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    value = F.when((pos >= least) & (neg >= least), F.try_divide(won, pos * neg))
    return placed.groupBy(*groups).agg(pos.alias("n_pos"), neg.alias("n_neg"), value.alias("auc"))


def odds_ratio(df: DataFrame, groups: Sequence[str], flag: str, outcome: str, least: int = 50) -> DataFrame:
    """(groups, n, odds_ratio, low, high, rate_flag, rate_no_flag): half a case is added to each cell; 95 % interval of the logarithm.

    All but n are NULL under ``least`` rows and where the flag never varies. Rates are the outcome's, with and without the flag.
    """
    rows = df.filter(F.col(flag).isNotNull() & F.col(outcome).isNotNull())
    f, o = F.col(flag).cast("boolean"), F.col(outcome).cast("boolean")
    cells = rows.groupBy(*groups).agg(*[(F.count_if(c) + 0.5).alias(n) for n, c in (("__a", f & o), ("__b", f & ~o), ("__c", ~f & o), ("__d", ~f & ~o))], F.count("*").alias("n"), F.count_if(f).alias("__f"), F.avg(F.when(f, o.cast("double"))).alias("__rf"), F.avg(F.when(~f, o.cast("double"))).alias("__rn"))
    ratio = F.col("__a") * F.col("__d") / (F.col("__b") * F.col("__c"))
    half = 1.96 * F.sqrt(1 / F.col("__a") + 1 / F.col("__b") + 1 / F.col("__c") + 1 / F.col("__d"))
    out = {"odds_ratio": ratio, "low": F.exp(F.ln(ratio) - half), "high": F.exp(F.ln(ratio) + half), "rate_flag": F.col("__rf"), "rate_no_flag": F.col("__rn")}
    told = (F.col("n") >= least) & F.col("__f").between(1, F.col("n") - 1)
    return cells.select(*groups, "n", *[F.when(told, c).alias(k) for k, c in out.items()])


def redundancy(df: DataFrame, columns: Sequence[str], threshold: float = 0.85, least: int = 200) -> DataFrame:
    """(a, b, n, rho): pairs of columns whose rank correlation reaches the threshold.

    Each column is ranked once, over its own values; a pair is correlated where both are there. The columns are
    put below each other, ranked together, and set side by side again by row: the plan does not grow with them.
    """
    wide = cut(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).withColumn("__row", F.monotonically_increasing_id()))
    long = wide.select("__row", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in columns])).alias("v")).select("__row", "v.*").filter("x is not null")
    ranked = with_group_rank(long, ["c"], "x", "__rank", wide.count())
    back = ranked.groupBy("__row").agg(*[F.max(F.when(F.col("c") == c, F.col("__rank"))).alias(f"__{c}") for c in columns])
    pairs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.col(f"__{a}") + F.col(f"__{b}")).alias("n"), correlation(F.col(f"__{a}"), F.col(f"__{b}")).alias("rho"))
        for a, b in combinations(columns, 2)
    ]
    found = back.agg(*[p.alias(f"p{i}") for i, p in enumerate(pairs)]).select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("p"))
    return found.select("p.*").filter((F.col("n") >= least) & (F.abs("rho") >= threshold))


def top_bottom(df: DataFrame, cohort: Sequence[str], score: str, result: str, tie: str, share: float = 0.2) -> DataFrame:
    """(cohort, n, edge): mean result of the best share of scores less that of the worst; none where all scores tie."""
    w = Window.partitionBy(*cohort)
    rows = df.filter(F.col(score).isNotNull() & F.col(result).isNotNull())
    k = F.greatest(F.floor(F.count("*").over(w) * share), F.lit(1))
    up, down = F.row_number().over(w.orderBy(F.col(score).desc(), tie)), F.row_number().over(w.orderBy(F.col(score), tie))
    marked = rows.withColumns({"__top": up <= k, "__low": down <= k})
    agg = marked.groupBy(*cohort).agg(F.count("*").alias("n"), (F.avg(F.when(F.col("__top"), F.col(result))) - F.avg(F.when(F.col("__low"), F.col(result)))).alias("edge"), F.count_distinct(score).alias("__d"))
    return agg.filter("__d > 1").drop("__d")
