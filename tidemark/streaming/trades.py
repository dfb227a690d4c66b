"""The trade machine as a stream: bars come in batches, and each batch carries every trade's state on.

States are a table with a version for each batch. A batch reads the last version before its own and writes
its own anew, so that a batch that is run again after a failure gives the same version, and a restarted stream
goes on from the last. The log of all bars so far is read from the states alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import machine


def states_before(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """The states of the last version before ``version`` (the last of all, if None), or None."""
    try:
        every = spark.read.parquet(folder)
    except AnalysisException:  # nothing is written yet
        return None
    if version is not None:
        every = every.filter(F.col("version") < version)
    last = every.agg(F.max("version")).first()[0]
    return None if last is None else every.filter(F.col("version") == last).drop("version")


def carry_on(plans: DataFrame, folder: str, trade: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over a stream of bars (trade, session_date, open, high, low, close): folds each batch into the states of folder.

    Bars of a trade come in the order of their days; a day may not be cut across batches for one trade, and a bar on or before the day
    through which its trade is folded fails the batch.
    """

    def batch(bars: DataFrame, number: int) -> None:
        before = states_before(bars.sparkSession, folder, number)
        machine.advance(plans, before, bars, trade).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return batch


def current_log(spark: SparkSession, plans: DataFrame, folder: str, trade: str) -> DataFrame:
    """The log of every trade after the last batch."""
    states = states_before(spark, folder)
    states = machine.advance(plans, None, plans.sparkSession.createDataFrame([], plans.select(trade).schema).selectExpr(trade, "cast(null as date) as session_date", *[f"cast(null as double) as {c}" for c in ("open", "high", "low", "close")]), trade) if states is None else states
    return machine.log_of(states, plans, trade)
