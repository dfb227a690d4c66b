"""Ranked search of a catalogue and rule-based decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import business_rule


def ranked_search(catalogue: DataFrame, key: str, name: str, text: str, limit: int) -> DataFrame:
    """(key, name, score, kind): exact, then prefix, then contained, then near by edit distance; the first ``limit``.

    A score per row and an ordered limit; the catalogue is never sorted as a whole.
    """
    low, q = F.lower(name), text.lower()
    near = 1 - F.levenshtein(low, F.lit(q)) / F.greatest(F.length(low), F.lit(max(len(q), 1)))
    kind = F.when(low == q, "EXACT").when(low.startswith(q), "PREFIX").when(low.contains(q), "CONTAINS").when(near >= 0.6, "FUZZY")
    score = F.when(kind == "EXACT", 100.0).when(kind == "PREFIX", 80.0).when(kind == "CONTAINS", 60.0).otherwise(F.round(near * 50, 6))
    return catalogue.select(key, name, score.alias("score"), kind.alias("kind")).filter("kind is not null").orderBy(F.desc("score"), F.col(name), F.col(key)).limit(limit)


def evaluate_rules(df: DataFrame, entry: Sequence[tuple[str, str, float]], leave: Sequence[tuple[str, str, float]], held: str) -> DataFrame:
    """df with decision (ENTER, HOLD, EXIT, NO_ACTION), and passed and failed rule names."""
    test = lambda r: business_rule(F.col(r[0]), r[1], F.lit(r[2]))
    label = lambda r: f"{r[0]}{r[1]}{r[2]:g}"
    enter = [test(r) for r in entry]
    out = [test(r) for r in leave]
    all_in = F.forall(F.array(*enter), lambda x: x)
    any_out = F.exists(F.array(*out), lambda x: x)
    decision = F.when(F.col(held) & any_out, "EXIT").when(F.col(held), "HOLD").when(all_in, "ENTER").otherwise("NO_ACTION")
    names = lambda want: F.array_join(F.array_compact(F.array(*[F.when(t if want else ~t, label(r)) for r, t in zip(entry, enter)])), ",")
    return df.withColumns({"decision": decision, "passed": names(True), "failed": names(False)})


def weighted_review(df: DataFrame, weights: dict[str, float], hard_exit: Column) -> DataFrame:
    """df with score in [-100, 100] over the signals that are known, and call ADD, HOLD or SELL."""
    total = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    points = sum((F.coalesce(F.signum(F.col(c)), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    score = F.try_divide(points * 100, total)
    call = F.when(F.coalesce(hard_exit, F.lit(False)), "SELL").when(score >= 40, "ADD").when(score <= -40, "SELL").when(score.isNotNull(), "HOLD")
    return df.withColumn("score", score).withColumn("call", call)
