"""Which stored rows a derived value was made of, and whether those alone make it again.

Every stored row has a name, the hash of what it says. A value over the last rows of a key names them;
rebuilding reads nothing but the named rows, computes the value again by the same rule and compares. A row
that was changed or taken away since has another name, or none: its values are told as not made again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Rule = Callable[[DataFrame, Sequence[str]], DataFrame]


def named(facts: DataFrame, columns: Sequence[str] | None = None, name: str = "source_id") -> DataFrame:
    """facts with the SHA-256 of each row's columns (default: all), by name and in the order of names. Nulls and empty texts differ."""
    parts = [F.concat(F.lit(f"{len(c)}:{c}="), F.coalesce(F.concat(F.lit("'"), F.col(f"`{c}`").cast("string")), F.lit("null"))) for c in sorted(columns or facts.columns)]
    return facts.withColumn(name, F.sha2(F.concat_ws("\x1f", *parts), 256))


def explained(facts: DataFrame, keys: Sequence[str], order: str, rule: Rule, rows_back: Mapping[str, int], name: str = "source_id") -> DataFrame:
    """(keys, order, feature, value, reason, inputs): each value with the names of the rows it was made of, oldest first.

    facts: one row per keys and order, with its name. rule(facts, keys) gives (keys, order, feature, value, reason) by windows
    over a key in order. rows_back: for each feature, how many rows before its own it reads; features not listed give no row.
    """
    deepest = max(rows_back.values())
    w = Window.partitionBy(*keys).orderBy(order)
    seen = facts.select(*keys, order, F.collect_list(name).over(w.rowsBetween(-deepest, 0)).alias("__seen"))
    depth = F.element_at(F.create_map(*[F.lit(x) for pair in rows_back.items() for x in pair]), F.col("feature"))
    wanted = rule(facts, keys).filter(F.col("feature").isin(*rows_back))
    both = wanted.join(seen, [*keys, order])
    inputs = F.slice("__seen", F.greatest(F.size("__seen") - depth, F.lit(1)), depth + 1)
    return both.select(*keys, order, "feature", "value", "reason", inputs.alias("inputs"))


def rebuilt(values: DataFrame, store: DataFrame, keys: Sequence[str], order: str, rule: Rule, rows_back: Mapping[str, int], name: str = "source_id", tolerance: float = 1e-9) -> DataFrame:
    """values (from :func:`explained`) with n_inputs, missing (named rows that the store does not have), rebuilt and status.

    store: the rows as they are stored now, named by what they say now; rows that say the same count once. status: SAME
    (value and reason are made again), INPUT_MISSING, or DIFFERENT. Features that read equally many rows share one rebuilding,
    so that the work is one join of the named rows and one computation for each different depth.
    """
    depth = F.element_at(F.create_map(*[F.lit(x) for pair in rows_back.items() for x in pair]), F.col("feature"))
    asked = values.select(*keys, F.col(order).alias("__at"), depth.alias("__depth"), F.col("inputs").alias("__inputs")).distinct()
    asked = asked.select(*keys, "__at", "__depth", F.explode("__inputs").alias(name), F.size("__inputs").alias("__n"))
    kept = store.dropDuplicates([name])
    rows = asked.join(kept.drop(*keys), name)
    group = [*keys, "__at", "__depth"]
    found = rows.groupBy(*group).agg(F.count("*").alias("__found"))
    again = rule(rows.drop("__n"), group).filter((F.col(order) == F.col("__at")) & (F.col("__depth") == depth))
    again = again.select(*group, "feature", F.col("value").alias("rebuilt"), F.col("reason").alias("__reason"), F.lit(True).alias("__made"))
    out = values.withColumns({"__at": F.col(order), "__depth": depth}).join(found, group, "left").join(again, [*group, "feature"], "left")
    missing = F.size("inputs") - F.coalesce("__found", F.lit(0))
    close = F.col("value").eqNullSafe(F.col("rebuilt")) | F.coalesce(F.abs(F.col("value") - F.col("rebuilt")) <= tolerance * F.greatest(F.abs("value"), F.lit(1.0)), F.lit(False))
    same = F.coalesce("__made", F.lit(False)) & close & F.col("reason").eqNullSafe(F.col("__reason"))
    status = F.when(missing > 0, "INPUT_MISSING").when(same, "SAME").otherwise("DIFFERENT")
    return out.select(*values.columns, F.size("inputs").cast("long").alias("n_inputs"), missing.cast("long").alias("missing"), "rebuilt", status.alias("status"))


def chain(links: DataFrame, values: DataFrame, name: str = "source_id") -> DataFrame:
    """(feature, <columns of values>, source_id, <columns of links>): for each value and input, where the row came from.

    links: one row or more per name, such as the file, the filing and the time it was first seen; named rows without a link are kept.
    """
    return values.select(*[c for c in values.columns if c != "inputs"], F.posexplode("inputs").alias("position", name)).join(links, name, "left")
