"""Support and resistance zones as known at the close of each bar.

A swing point is confirmed by the ``side`` bars after it. So each bar sees the points of its look-back that
are confirmed by then, clustered by its own average true range: a table of zones for every bar, in which
no later bar has a part. Points are found once per bar by windows; a bar gathers those of its look-back,
of which there are at most lookback / (side + 1) of a kind, and folds them in order of price. One shuffle
by key and one order serve it all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Lengths in bars, widths in average true ranges.

    side: bars that confirm a point; lookback: bars that a zone may come from; width: how near a point must be to
    the mean of a cluster; thin: least half width of a zone; least_touches or least_rejection make a zone count;
    half_life: age at which a touch counts half; nearest: zones kept on a side. A broken resistance is one that
    the close clears by ``clear`` and that a close of the last ``fresh`` bars did not; a lone point must be younger
    than ``lone``; of these ``broken`` are kept.
    """

    side: int = 5
    lookback: int = 504
    width: float = 0.75
    thin: float = 0.1
    least_touches: int = 2
    least_rejection: float = 1.0
    half_life: float = 126.0
    nearest: int = 3
    volume_mean: int = 20
    clear: float = 0.25
    fresh: int = 30
    lone: int = 252
    broken: int = 2


def _points(bars: DataFrame, key: str, order: str, r: Rules) -> DataFrame:
    """bars with position, and ``__top`` and ``__bottom``: the point (level, pos, day, move, volumes) that is there, if any.

    move is how far price went away in the bars that confirm it; volumes are those up to the point, itself last.
    """
    w = Window.partitionBy(key).orderBy(order)
    before, after, both = w.rowsBetween(-r.side, -1), w.rowsBetween(1, r.side), w.rowsBetween(-r.side, r.side)
    volumes = F.collect_list(F.coalesce(F.col("volume").cast("double"), F.lit(float("nan")))).over(w.rowsBetween(-r.volume_mean + 1, 0))

    def point(x: str, found: Column, away: Column) -> Column:
        whole = F.count(x).over(both) == 2 * r.side + 1
        return F.when(whole & found, F.struct(F.col(x).cast("double").alias("level"), F.col("position").alias("pos"), F.col(order).alias("day"), F.greatest(away, F.lit(0.0)).cast("double").alias("move"), volumes.alias("volumes")))

    bars = bars.withColumn("position", F.row_number().over(w) - 1)
    top = point("high", (F.col("high") > F.max("high").over(before)) & (F.col("high") >= F.max("high").over(after)), F.col("high") - F.min("low").over(after))
    bottom = point("low", (F.col("low") < F.min("low").over(before)) & (F.col("low") <= F.min("low").over(after)), F.max("high").over(after) - F.col("low"))
    seen = w.rowsBetween(-(r.lookback - 1 - r.side), -r.side)
    bars = bars.withColumns({"__top": top, "__bottom": bottom})
    return bars.withColumns({"__tops": F.collect_list("__top").over(seen), "__bottoms": F.collect_list("__bottom").over(seen)}).drop("__top", "__bottom")


def _clusters(points: str, r: Rules) -> str:
    """Clusters of an array of points in order of level: a point joins the last cluster if it is near its mean, else opens one.

    Volumes count from the first bar of the look-back on, and only where at least five are there.
    """
    from_ = f"greatest(position - {r.lookback - 1}, 0)"
    known = f"filter(slice(x.volumes, greatest(1, size(x.volumes) - (x.pos - {from_})), {r.volume_mean}), v -> not isnan(v))"
    mean = f"transform(array({known}), k -> if(size(k) >= 5, aggregate(k, 0D, (s, v) -> s + v) / size(k), null))[0]"
    ratio = f"transform(array({mean}), m -> if(m > 0 and not isnan(element_at(x.volumes, -1)), element_at(x.volumes, -1) / m, null))[0]"
    fresh = f"pow(0.5D, (position - x.pos) / {r.half_life}D)"
    one = f"transform(array({ratio}), v -> struct(x.level as lower, x.level as upper, x.level as total, 1 as touches, x.pos as lowest, x.pos as first, x.pos as last, x.day as first_day, x.day as last_day, x.move as move, {fresh} as recency, coalesce(v, 0D) as volume, if(v is null, 0, 1) as volumes))[0]"
    last = "element_at(acc, -1)"
    joined = f"""transform(array({one}), o -> transform(array({last}), l -> struct(l.lower as lower, o.upper as upper, l.total + o.total as total, l.touches + 1 as touches, l.lowest as lowest,
        least(l.first, o.first) as first, greatest(l.last, o.last) as last, if(l.first <= o.first, l.first_day, o.first_day) as first_day, if(l.last >= o.last, l.last_day, o.last_day) as last_day,
        l.move + o.move as move, l.recency + o.recency as recency, l.volume + o.volume as volume, l.volumes + o.volumes as volumes))[0])[0]"""
    near = f"size(acc) > 0 and abs(x.level - {last}.total / {last}.touches) <= {r.width}D * atr"
    empty = f"transform(slice({points}, 1, 0), x -> {one})"
    clusters = f"aggregate(array_sort({points}), {empty}, (acc, x) -> if({near}, concat(slice(acc, 1, size(acc) - 1), array({joined})), concat(acc, array({one}))))"
    thin = f"(c.upper - c.lower) < {2 * r.thin}D * atr"
    middle = "(c.upper + c.lower) / 2"
    return f"""transform({clusters}, c -> struct(if({thin}, {middle} - {r.thin}D * atr, c.lower) as lower, if({thin}, {middle} + {r.thin}D * atr, c.upper) as upper, {middle} as midpoint, c.touches as touches,
        c.first_day as first_touch, c.last_day as last_touch, cast(position - c.last as int) as age, cast(position - c.lowest as int) as lowest_age, c.move / c.touches / atr as rejection, c.recency / c.touches as recency, try_divide(c.volume, c.volumes) as volume_confirmation))"""


def _known(r: Rules) -> Column:
    return (F.col("atr") > 0) & (F.col("position") + 1 >= 2 * r.side + 2)


def _sides(bars: DataFrame, key: str, order: str, r: Rules) -> DataFrame:
    """(key, order, position, close, atr, closes, __supports, __resistances): the clusters of each bar, all of them; closes are those of the last bars."""
    w = Window.partitionBy(key).orderBy(order)
    closes = F.collect_list(F.struct(F.col(order).alias("day"), F.col("close").cast("double").alias("close"))).over(w.rowsBetween(-r.fresh + 1, 0))
    df = _points(bars.withColumns({"atr": F.col("atr").cast("double"), "closes": closes}), key, order, r)
    for points, zones in (("__bottoms", "__supports"), ("__tops", "__resistances")):
        df = df.withColumn(zones, F.when(_known(r), F.expr(_clusters(points, r))))
    return df.select(key, order, "position", F.col("close").cast("double").alias("close"), "atr", "closes", "__supports", "__resistances")


def _nearest(zones: str, below: bool, r: Rules) -> str:
    """Of the clusters that count and lie on their side of the close, the nearest, nearest first."""
    side = "z.midpoint < close" if below else "z.midpoint > close"
    counts = f"z.touches >= {r.least_touches} or z.rejection >= {r.least_rejection}D"
    strength = f"round(100 * (4 * least(z.touches, 5) / 10D / 5 + 0.3D * z.recency + 0.3D * least(z.rejection / 3, 1D)) * 10, 0) / 10"  # tenths whole first: 0.4 thrice is not 1.2
    kept = f"""transform(filter({zones}, z -> {side} and ({counts})), z -> struct(abs(z.midpoint - close) / atr as distance_atr, try_divide(z.midpoint, close) - 1 as distance, z.lower as lower, z.upper as upper, z.midpoint as midpoint,
        z.touches as touches, z.first_touch as first_touch, z.last_touch as last_touch, z.age as age, {strength} as strength, z.rejection as rejection, z.recency as recency, z.volume_confirmation as volume_confirmation))"""
    return f"slice(array_sort({kept}), 1, {r.nearest})"


def zones_as_of(bars: DataFrame, key: str, order: str, rules: Rules = Rules()) -> DataFrame:
    """(key, order, kind, place, lower, upper, midpoint, touches, first_touch, last_touch, age, strength, rejection, recency, volume_confirmation, distance, distance_atr) of the zones of every bar.

    bars: key, order, high, low, close, volume and atr, one row per key and order. kind is SUPPORT or
    RESISTANCE, place 1 the nearest to the close. Strength is 40 % touches (up to five), 30 % recency and
    30 % rejection (up to three ranges). Bars without a positive atr, and a key's first ones, have no zones;
    a point needs every high (or low) of the bars around it.
    """
    df = _sides(bars, key, order, rules)
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(_nearest(z, k == "SUPPORT", rules)).alias("zones")) for k, z in (("SUPPORT", "__supports"), ("RESISTANCE", "__resistances"))])
    each = df.select(key, order, F.explode(both).alias("s")).select(key, order, "s.kind", F.posexplode("s.zones").alias("place", "z"))
    names = ("lower", "upper", "midpoint", "touches", "first_touch", "last_touch", "age", "strength", "rejection", "recency", "volume_confirmation", "distance", "distance_atr")
    return each.select(key, order, "kind", (F.col("place") + 1).alias("place"), *[F.col(f"z.{n}").alias(n) for n in names])


def broken_resistances(bars: DataFrame, key: str, order: str, rules: Rules = Rules()) -> DataFrame:
    """(key, order, place, lower, upper, midpoint, touches, trigger, broke_on, distance_atr): resistances of every bar that its close has cleared lately."""
    trigger = f"z.upper + {rules.clear}D * atr"
    was_below = "exists(closes, c -> c.close <= z.upper)"
    lone = f"not (z.touches < 2 and z.lowest_age > {rules.lone})"
    first = f"get(filter(closes, c -> c.close > {trigger}), 0).day"
    kept = f"""transform(filter(__resistances, z -> close > {trigger} and {was_below} and {lone}), z -> struct((close - z.upper) / atr as distance_atr, z.lower as lower, z.upper as upper, z.midpoint as midpoint,
        z.touches as touches, {trigger} as trigger, {first} as broke_on))"""
    df = _sides(bars, key, order, rules).select(key, order, F.posexplode(F.expr(f"slice(array_sort({kept}), 1, {rules.broken})")).alias("place", "z"))
    return df.select(key, order, (F.col("place") + 1).alias("place"), *[F.col(f"z.{n}").alias(n) for n in ("lower", "upper", "midpoint", "touches", "trigger", "broke_on", "distance_atr")])


def frozen_support(bars: DataFrame, key: str, order: str, rules: Rules = Rules()) -> DataFrame:
    """(key, order, support_low, support_high, support_touches, support_age): for each bar the support nearest below the close of the bar before, as known then.

    Of the supports of the bar before, the one with the highest upper edge; NULL where there is none. The bar
    itself has no part in it, so that its close can be compared with a zone that it could not move.
    """
    w = Window.partitionBy(key).orderBy(order)
    best = F.expr(f"aggregate({_nearest('__supports', True, rules)}, cast(null as struct<lower:double,upper:double,touches:int,age:int>), (b, z) -> if(b is null or z.upper > b.upper, struct(z.lower, z.upper, z.touches, z.age), b))")
    df = _sides(bars, key, order, rules).withColumn("__b", best).withColumn("__b", F.lag("__b").over(w))
    return df.select(key, order, F.col("__b.lower").alias("support_low"), F.col("__b.upper").alias("support_high"), F.col("__b.touches").alias("support_touches"), F.col("__b.age").alias("support_age"))
