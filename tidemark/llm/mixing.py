"""Mixing sources to target weights.

Sizes (words by default) are added up per source. The target of a source is its weight's share of the
whole size, but at most ``ceiling`` times the source's own size; what is cut off there is shared again
by weight among the others until none is above. A document of a source with repetition rate r is
emitted floor(r) times, and once more with the probability of the fraction, by a coin that is a hash
of the seed, the id and the text, so that reruns agree. Rows that share id and text are numbered, and
each but the first puts its number into the hash, so that each tosses a coin of its own; which of them
has which number does not matter, for they are alike.

Defined cases: null texts have size 0; the null source is a source, ordered last; sources without
words have target 0 and rate 0; repeated rows are taken each by its own coin; an empty table gives an
empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import WORD, checkpoint, global_rank, join_counted, written

#: Sources up to this number are joined by broadcast (a name and three numbers each).
BROADCAST_SOURCES = 100_000
WEIGHTS = (1, 2, 3)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), F.col(id_col).cast("string"), F.col(text_col))


def coin() -> Column:
    """In [0, 1), from 53 bits of the row's hash, with its number among equal rows."""
    h = F.when(F.col("__llm_no") == 0, F.col("__llm_h")).otherwise(F.xxhash64("__llm_h", "__llm_no"))
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def numbered(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """rows with __llm_no: 0, or the place from 0 among the rows of one __llm_h, which hashes has of all rows.

    Only rows that a filter of the repeated hashes points at are moved. They are ranked over all their
    hashes by range, so that no task numbers a hash of very many rows alone.
    """
    repeated = written(hashes.groupBy("__llm_h").agg(F.count("*").alias("__llm_c")).filter("__llm_c > 1"), "repeated")
    if repeated.isEmpty():
        return rows.withColumn("__llm_no", F.lit(0).cast("long"))
    words = bloom.words_for(repeated.count())
    flagged = bloom.flag(rows, "__llm_h", bloom.of_keys(repeated, "__llm_h", words), words, "__llm_hit")
    rest = flagged.filter("not __llm_hit").drop("__llm_hit").withColumn("__llm_no", F.lit(0).cast("long"))
    hits = written(flagged.filter("__llm_hit").drop("__llm_hit").withColumn("__llm_row", F.monotonically_increasing_id()), "hits")
    placed = written(global_rank(hits.select("__llm_h", "__llm_row"), [F.col("__llm_h"), F.col("__llm_row")], "__llm_place"), "placed")
    first = placed.groupBy("__llm_h").agg(F.min("__llm_place").alias("__llm_first"), F.count("*").alias("__llm_c"))
    number = join_counted(placed, first, "__llm_h", "__llm_c", placed.count()).select("__llm_row", (F.col("__llm_place") - F.col("__llm_first")).alias("__llm_no"))
    return rest.unionByName(hits.join(number, "__llm_row").drop("__llm_row"))


def source_targets(sized: DataFrame, source: str, size: str, weights: tuple[float, ...] = WEIGHTS, ceiling: float = 3.0) -> DataFrame:
    """(__llm_source, source_size, weight, target, rate) per source of sized. Weights go round by code point order."""
    per = sized.groupBy(F.col(source).alias("__llm_source")).agg(F.sum(size).alias("source_size"))
    ranked = global_rank(per, [F.col("__llm_source").asc_nulls_last()], "__llm_rank")
    choose = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("__llm_rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = checkpoint(ranked.select("__llm_source", "source_size", choose.alias("weight"), (F.col("source_size") * F.lit(float(ceiling))).alias("__llm_cap")))
    level, capped = 0.0, -1
    while True:  # each round caps at least one more source; the level only rises
        above = F.col("weight") * F.lit(level) > F.col("__llm_cap")
        now, rest, weight = ranked.agg(
            F.count(F.when(above, 1)),
            F.coalesce(F.sum("source_size"), F.lit(0)) - F.coalesce(F.sum(F.when(above, F.col("__llm_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if now == capped:
            break
        capped, level = now, max(level, rest / weight) if weight else level
    target = F.least(F.col("weight") * F.lit(level), F.col("__llm_cap"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(ceiling)))).otherwise(0.0)
    return ranked.select("__llm_source", "source_size", "weight", target.alias("target"), rate.alias("__llm_rate"))


def _with_targets(rows: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    return rows.join(targets, F.col(source).eqNullSafe(F.col("__llm_source")), "left")


def _copies() -> Column:
    whole = F.floor("__llm_rate")
    return (whole + (F.col("__llm_coin") < F.col("__llm_rate") - whole).cast("long")).cast("int")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """(id, size, source_size, target, copies, taken) per row of docs. Texts are read once."""
    rows = checkpoint(
        docs.select(F.col(id_col).alias("__llm_id"), F.col(source_col).alias("__llm_from"), word_count(text_col).alias("size"), text_hash(id_col, text_col, seed).alias("__llm_h"))
    )
    targets = source_targets(rows, "__llm_from", "size", **how)
    return _with_targets(numbered(rows, rows.select("__llm_h")).withColumn("__llm_coin", coin()), "__llm_from", targets).select(
        F.col("__llm_id").alias(id_col), "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """The mixed documents: docs' columns, each row as often as it is taken."""
    sized = checkpoint(docs.select(F.col(source_col).alias("__llm_from"), word_count(text_col).alias("__llm_size"), text_hash(id_col, text_col, seed).alias("__llm_h")))
    targets = source_targets(sized, "__llm_from", "__llm_size", **how).select("__llm_source", "__llm_rate")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = numbered(docs.withColumn("__llm_h", text_hash(id_col, text_col, seed)), sized.select("__llm_h")).withColumn("__llm_coin", coin())
    taken = _with_targets(rows, source_col, targets).withColumn("__llm_copies", _copies())
    return taken.filter("__llm_copies > 0").withColumn("__llm_copy", F.explode(F.sequence(F.lit(1), F.col("__llm_copies")))).select(*cols)
