"""Many rule variants over the same decisions: seven dimensions each, a verdict by dimension and one overall.

The decisions are read once and counted once, by horizon, stratum, period and offset, with a sum for each
variant beside the others; five of the seven dimensions are sums over that small table. The two that need
ranks read each different score once, however many variants share it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cross_section import correlation
from .lineage import cut
from .ranks import with_group_rank
from .rulebook import monthly_spread, overall, verdicts

#: By how much a dimension's mean has to differ.
TOLERANCES = {"ic": 0.005, "tb": 0.002, "edge": 0.005, "r": 0.02, "robust": 0.05, "temporal": 0.005, "region": 0.10}
_SUMS = ("n", "pos", "up", "hit", "n1", "pos1", "up1", "hit1", "reward", "rewarded")


def cells(calls: DataFrame, variants: Mapping[str, str], key: str, horizon: str, month: str, ret: str, reward: str, stratum: str, period: str, tie: str) -> DataFrame:
    """(variant, horizon, stratum, period, offset, sums): counts of all rows, and (ending in 1) of each key's first row of a month.

    variants: the call column of each. month is a number; its remainder by the horizon is the offset, in which no two decisions
    overlap. A row without a return counts, and is no hit. Of a key's rows of a month the one with the smallest tie is the first.
    """
    first = F.row_number().over(Window.partitionBy(horizon, key, month).orderBy(tie)) == 1
    rows = calls.withColumns({"__first": first, "__hit": F.coalesce(F.col(ret) > 0, F.lit(False)), "__offset": F.pmod(month, horizon)})
    one, hit = F.col("__first"), F.col("__hit")
    sums = {"n": F.count("*"), "pos": F.count_if(hit), "n1": F.count_if(one), "pos1": F.count_if(one & hit)}
    for i, call in enumerate(variants.values()):
        up = F.coalesce(F.col(call) == "UP", F.lit(False))
        paid = up & F.col(reward).isNotNull()
        sums |= {f"up_{i}": F.count_if(up), f"hit_{i}": F.count_if(up & hit), f"up1_{i}": F.count_if(one & up), f"hit1_{i}": F.count_if(one & up & hit)}
        sums |= {f"reward_{i}": F.coalesce(F.sum(F.when(paid, F.col(reward).cast("double"))), F.lit(0.0)), f"rewarded_{i}": F.count_if(paid)}
    wide = rows.groupBy(F.col(horizon).alias("horizon"), F.col(stratum).alias("stratum"), F.col(period).alias("period"), F.col("__offset").alias("offset")).agg(*[c.alias(f"__{k}") for k, c in sums.items()])
    each = [F.struct(F.lit(v).alias("variant"), *[F.col(f"__{s}" if s in sums else f"__{s}_{i}").alias(s) for s in _SUMS]) for i, v in enumerate(variants)]
    return wide.select("horizon", "stratum", "period", "offset", F.explode(F.array(*each)).alias("v")).select("v.variant", "horizon", "stratum", "period", "offset", *[f"v.{s}" for s in _SUMS])


def _edge(least: int, of: str = "") -> Column:
    """The hit rate of the calls less that of all rows; NULL under ``least`` calls. Over sums of cells."""
    up, hit, n, pos = (F.sum(f"{k}{of}") for k in ("up", "hit", "n", "pos"))
    return F.when(up >= least, hit / up - pos / n)


def _from_cells(found: DataFrame, least: int, least_stratum: int) -> DataFrame:
    by, told = ["variant", "horizon"], ["variant", "horizon", "dimension", "value"]
    positive = F.avg((F.col("e") > 0).cast("double"))
    rewarded = F.sum("rewarded")
    whole = found.groupBy(*by).agg(_edge(least).alias("edge"), F.when(rewarded >= least, F.sum("reward") / rewarded).alias("r"))
    out = whole.unpivot(by, ["edge", "r"], "dimension", "value").select(*told)
    parts = {
        "robust": (found, "offset", _edge(least, "1"), positive),
        "region": (found.filter("stratum is not null"), "stratum", _edge(least_stratum), positive),
        "temporal": (found.filter("period is not null"), "period", _edge(least), F.when(F.count("e") == 2, F.min("e"))),
    }
    for name, (rows, part, edge, whole_of) in parts.items():
        per = rows.groupBy(*by, part).agg(edge.alias("e")).groupBy(*by).agg(whole_of.alias("value"))
        out = out.unionByName(per.withColumn("dimension", F.lit(name)).select(*told))
    return out


def _from_scores(calls: DataFrame, scores: Mapping[str, Sequence[str]], horizon: str, month: str, ret: str, tie: str, least: int) -> DataFrame:
    """ic and tb for each different score, then for each variant that reads it."""
    each = F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("x")) for s in scores])
    long = calls.select(F.col(horizon).alias("horizon"), F.col(month).alias("__month"), F.col(ret).cast("double").alias("y"), F.col(tie).alias("__tie"), F.explode(each).alias("s")).select("horizon", "__month", "y", "__tie", "s.*")
    long = cut(long.filter("x is not null and y is not null"))
    total, by = long.count(), ["score", "horizon"]
    ranked = with_group_rank(with_group_rank(long, by, "x", "__rx", total), by, "y", "__ry", total)
    ic = ranked.groupBy(*by).agg(F.when(F.count("*") >= least, correlation(F.col("__rx"), F.col("__ry"))).alias("value")).withColumn("dimension", F.lit("ic"))
    tb = monthly_spread(long, by, "__month", "x", "y", "__tie").select(*by, F.col("top_bottom").alias("value")).withColumn("dimension", F.lit("tb"))
    readers = F.create_map(*[x for s, vs in scores.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in vs]))])
    return ic.unionByName(tb).select(F.explode(F.element_at(readers, F.col("score"))).alias("variant"), "horizon", "dimension", "value")


def dimensions(
    calls: DataFrame, variants: Mapping[str, tuple[str, str]], key: str, horizon: str, month: str, ret: str, reward: str, stratum: str, period: str, tie: str, least: int = 10, least_stratum: int = 30
) -> DataFrame:
    """(variant, horizon, dimension, value) for variants given by their columns of call and score.

    ic: rank correlation of score and return; tb: monthly best fifth less worst; edge: hit rate of UP calls less the base's;
    r: their mean reward; robust: share of offsets with a positive edge; temporal: the smaller edge of two periods; region: share of
    strata with a positive edge. A dimension without enough rows is NULL or has no row. A stratum or period of NULL counts in none of them.
    """
    found = cut(cells(calls, {v: c for v, (c, _) in variants.items()}, key, horizon, month, ret, reward, stratum, period, tie))
    scores: dict[str, list[str]] = {}
    for v, (_, s) in variants.items():
        scores.setdefault(s, []).append(v)
    return _from_cells(found, least, least_stratum).unionByName(_from_scores(calls, scores, horizon, month, ret, tie, least_stratum))


def compared(values: DataFrame, base: str, variants: Sequence[str], tolerances: Mapping[str, float] = TOLERANCES) -> DataFrame:
    """(variant, dimension, base, value, verdict, improves, degrades, overall) of each of variants against the base.

    values: from :func:`dimensions`. base and value are means over horizons, those that only one of them has included; a dimension
    that either lacks is INCONCLUSIVE, and one that both lack has no row.
    """
    told = F.create_map(*[F.lit(x) for pair in tolerances.items() for x in pair])
    mine = values.filter(F.col("variant") == base).select(F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"), "horizon", "dimension", F.col("value").alias("__b"))
    others = values.filter(F.col("variant").isin(*variants)).select("variant", "horizon", "dimension", F.col("value").alias("__v"))
    both = cut(mine.join(others, ["variant", "horizon", "dimension"], "full").withColumn("__t", F.element_at(told, F.col("dimension"))))
    found = cut(verdicts(both, ["variant", "dimension"], "__b", "__v", "__t"))
    means = both.groupBy("variant", "dimension").agg(F.avg("__b").alias("base"), F.avg("__v").alias("value"))
    return means.join(found, ["variant", "dimension"]).join(overall(found, ["variant"]), "variant")
