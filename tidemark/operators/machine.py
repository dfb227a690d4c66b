"""The whole state machine of simulated long trades, as one ordered fold of each trade's bars.

States: WAITING_ENTRY, ENTERED, PARTIAL_TP, and the closed TP1, TP2, TP3, STOPPED, INVALIDATED, EXPIRED,
CLOSED_MANUAL, AMBIGUOUS_INTRABAR, CANCELLED. A trade has some hundred bars; its log and state live in
one row, and nothing leaves the JVM.

Rules of a bar, in their order:

* Waiting: an expiration passed ends it; so does a close under the invalidation. MARKET fills at the open,
  STOP_BUY at the open or the level when reached, LIMIT and ENTRY_ZONE at the open if that is no higher
  than the zone's top, else at the top when touched; MARKET_REFERENCE is filled when the trade is made. A fill at or
  under the stop is stopped at once. A fill inside the bar with the stop or a target inside it too has no
  knowable order and is ambiguous; otherwise that bar does not exit.
* Entered: past the expiration the rest is sold at the last close. An open at or under the stop sells there.
  Targets at or under the open are touched at the open. The stop and a target that would sell, both inside
  the bar, are ambiguous. The stop sells the rest; other targets are touched at their price; a close under
  the invalidation sells the rest there.
* A touched target sells its fraction: LEGACY_HALF_AT_TP1 half at the first two (all, if there is one), PARTIAL_FRACTIONS
  those of the plan, TRACK_TARGETS_ONLY nothing.
* A waiting trade is cancelled on its day, an entered one closed by hand at the given price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a plan, beside the trade's bars. Missing ones are NULL.
PLAN = {
    "entry_type": "string", "entry_low": "double", "entry_high": "double", "stop": "double", "target_1": "double", "target_2": "double", "target_3": "double", "invalidation": "double", "expiration": "date",
    "exit_policy": "string", "fraction_1": "double", "fraction_2": "double", "fraction_3": "double", "decided": "date", "cancel_on": "date", "manual_on": "date", "manual_price": "double",
}
OPEN = ("WAITING_ENTRY", "ENTERED", "PARTIAL_TP")
_EPS = "1e-12D"
_LOG = "array<struct<session_date:date,event:string,price:double,fraction:double,state:string>>"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _event(day: str, event: str, price: str, fraction: str, state: str) -> str:
    return f"struct(cast({day} as date) as session_date, {event} as event, cast({price} as double) as price, cast({fraction} as double) as fraction, {state} as state)"


def _state(state: str = "s.state", entry: str = "s.entry", left: str = "s.left", seen: str = "s.seen", last: str = "s.last", log: str = "s.log") -> str:
    return f"struct({state} as state, cast({entry} as double) as entry, cast({left} as double) as left, cast({seen} as int) as seen, cast({last} as double) as last, {log} as log)"


def _end(event: str, price: str, state: str, day: str = "b.d") -> str:
    """The rest is sold, or nothing while waiting, and the trade ends."""
    return _state(f"'{state}'", left="0", log=f"concat(s.log, array({_event(day, f'{event!r}', price, 's.left', f'{state!r}')}))")


def _touch(n: int, reached: str) -> str:
    part = f"least(p.f{n}, s.left)"
    sells = _let("part", part, _let("now", f"if(s.left - part <= {_EPS}, 'TP{n}', 'PARTIAL_TP')", _state("now", left="s.left - part", seen=f"s.seen | {1 << n}", log=f"concat(s.log, array({_event('b.d', f'{f"TARGET_{n}"!r}', f'greatest(b.o, p.t{n})', 'part', 'now')}))")))
    marks = _state(seen=f"s.seen | {1 << n}", log=f"concat(s.log, array({_event('b.d', f'{f"TARGET_{n}"!r}', f'greatest(b.o, p.t{n})', '0', 's.state')}))")
    return f"if(coalesce({reached} >= p.t{n}, false) and (s.seen & {1 << n}) = 0, if({part} > {_EPS}, {sells}, {marks}), s)"


def _touches(reached: str, then: str) -> str:
    out = then
    for n in (3, 2, 1):
        out = _let("s", _touch(n, reached), out)
    return out


def _bar() -> str:
    """What an entered trade's bar does."""
    sells = " or ".join(f"(coalesce(b.h >= p.t{n}, false) and (s.seen & {1 << n}) = 0 and least(p.f{n}, s.left) > {_EPS})" for n in (1, 2, 3))
    ambiguous = _state("'AMBIGUOUS_INTRABAR'", log=f"concat(s.log, array({_event('b.d', repr('AMBIGUOUS_INTRABAR'), 'null', '0', repr('AMBIGUOUS_INTRABAR'))}))")
    stopped = _touches("b.h", _end("STOP", "p.stop", "STOPPED"))
    held = _touches("b.h", f"if(s.left <= {_EPS}, s, if(coalesce(b.c < p.invalidation, false), {_end('INVALIDATED', 'b.c', 'INVALIDATED')}, s))")
    inside = f"if(b.l <= p.stop, if({sells}, {ambiguous}, {stopped}), {held})"
    done = f"if(b.o <= p.stop, {_end('STOP_GAP', 'b.o', 'STOPPED')}, {_touches('b.o', f'if(s.left <= {_EPS}, s, {inside})')})"
    return _let("s", done, _state(last="b.c"))


def _waiting() -> str:
    quiet = lambda name: _state(f"'{name}'", log=f"concat(s.log, array({_event('b.d', repr(name), 'null', '0', repr(name))}))")
    fill = "case when p.entry_type = 'MARKET' then b.o when p.entry_type = 'STOP_BUY' then if(b.h >= p.entry_high, greatest(b.o, p.entry_high), null) when b.l <= p.entry_high then least(b.o, p.entry_high) end"
    entered = _state("'ENTERED'", entry="fill", last="b.c", log=f"concat(s.log, array({_event('b.d', repr('ENTRY'), 'fill', '0', repr('ENTERED'))}))")
    reach = "b.l <= p.stop or " + " or ".join(f"coalesce(b.h >= p.t{n}, false)" for n in (1, 2, 3))
    ambiguous = _state("'AMBIGUOUS_INTRABAR'", log=f"concat(s.log, array({_event('b.d', repr('AMBIGUOUS_INTRABAR'), 'null', '0', repr('AMBIGUOUS_INTRABAR'))}))")
    after = f"if(fill <= p.stop, {_end('STOP', 'fill', 'STOPPED')}, if(fill = b.o, {_bar()}, if({reach}, {ambiguous}, s)))"
    filled = _let("fill", fill, f"if(fill is null, s, {_let('s', entered, after)})")
    return f"if(coalesce(b.d > p.cancel_on, false), s, if(coalesce(b.d > p.expiration, false), {quiet('EXPIRED')}, if(coalesce(b.c < p.invalidation, false), {quiet('INVALIDATED')}, {filled})))"


def _step() -> str:
    late = f"if(coalesce(b.d > p.expiration, false), {_end('EXPIRED', 's.last', 'EXPIRED')}, {_bar()})"
    live = f"if(s.entry is null, {_waiting()}, if(coalesce(b.d > p.manual_on, false), s, {late}))"
    return f"if(s.state in {OPEN}, {live}, s)"


def _start() -> str:
    """The state of a trade p before its first bar."""
    waiting = _state("'WAITING_ENTRY'", "null", "1", "0", "null", f"cast(array() as {_LOG})")
    filled = _state("'ENTERED'", "p.entry_high", "1", "0", "p.entry_high", f"cast(array({_event('p.decided', repr('ENTRY'), 'p.entry_high', '0', repr('ENTERED'))}) as {_LOG})")
    return f"if(p.entry_type = 'MARKET_REFERENCE', {filled}, {waiting})"


def _finish(state: str) -> str:
    """A state after its last bar: a cancelled plan, or one closed by hand, ends."""
    cancelled = _state("'CANCELLED'", log=f"concat(s.log, array({_event('p.cancel_on', repr('CANCELLED'), 'null', '0', repr('CANCELLED'))}))")
    last = f"if(s.state in {OPEN}, if(s.entry is null, if(p.cancel_on is null, s, {cancelled}), if(p.manual_on is null, s, {_end('MANUAL_CLOSE', 'p.manual_price', 'CLOSED_MANUAL', 'p.manual_on')})), s)"
    return _let("s", state, last)


def _fold() -> str:
    return _finish(f"aggregate(bars, {_start()}, (s, b) -> {_step()})")


def validated(plans: DataFrame) -> DataFrame:
    """plans with ``problem``: the first rule of a plan's levels that it breaks, or NULL."""
    rules = [
        ("ENTRY_TYPE", F.col("entry_type").isin("LIMIT", "ENTRY_ZONE", "STOP_BUY", "MARKET", "MARKET_REFERENCE")),
        ("LEVEL_ORDER", (F.col("stop") > 0) & (F.col("stop") < F.col("entry_low")) & (F.col("entry_low") <= F.col("entry_high")) & (F.col("entry_high") < F.col("target_1"))),
        ("ONE_REFERENCE_PRICE", (F.col("entry_type") != "MARKET_REFERENCE") | (F.col("entry_low") == F.col("entry_high"))),
        ("TARGET_2", F.col("target_2").isNull() | (F.col("target_2") > F.col("target_1"))),
        ("TARGET_3", F.col("target_3").isNull() | (F.col("target_2").isNotNull() & (F.col("target_3") > F.col("target_2")))),
        ("INVALIDATION", F.col("invalidation").isNull() | (F.col("invalidation") > 0)),
        ("EXIT_POLICY", F.col("exit_policy").isin("TRACK_TARGETS_ONLY", "PARTIAL_FRACTIONS", "LEGACY_HALF_AT_TP1")),
        ("FRACTIONS", (F.least(*[F.coalesce(f"fraction_{n}", F.lit(0.0)) for n in (1, 2, 3)]) >= 0) & (sum((F.coalesce(f"fraction_{n}", F.lit(0.0)) for n in (1, 2, 3)), F.lit(0.0)) <= 1 + 1e-12)),
        ("FRACTION_WITHOUT_TARGET", ~((F.coalesce("fraction_2", F.lit(0.0)) > 0) & F.col("target_2").isNull() | (F.coalesce("fraction_3", F.lit(0.0)) > 0) & F.col("target_3").isNull())),
        ("FRACTIONS_OF_ANOTHER_POLICY", (F.col("exit_policy") == "PARTIAL_FRACTIONS") | (sum((F.coalesce(f"fraction_{n}", F.lit(0.0)) for n in (1, 2, 3)), F.lit(0.0)) == 0)),
    ]
    problem = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        problem = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(problem)
    return plans.withColumn("problem", problem)


def _bars() -> Column:
    return F.struct(F.col("session_date").cast("date").alias("d"), *[F.col(c).cast("double").alias(c[0]) for c in ("open", "high", "low", "close")])


def _typed(df: DataFrame, trade: str, *more: Column) -> DataFrame:
    """(trade, columns of PLAN, more); missing columns of a plan are NULL."""
    return df.select(trade, *[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in PLAN.items()], *more)


def _levels(per: DataFrame, trade: str, *more: str) -> DataFrame:
    """(trade, more, p) of the plans that break no rule."""
    per = per.withColumns({"entry_type": F.coalesce("entry_type", F.lit("LIMIT")), "exit_policy": F.coalesce("exit_policy", F.lit("LEGACY_HALF_AT_TP1"))})
    half = F.when(F.col("target_2").isNull(), F.lit(1.0)).otherwise(0.5)
    legacy = {1: half, 2: F.when(F.col("target_2").isNotNull(), 0.5).otherwise(0.0), 3: F.lit(0.0)}
    shares = [F.when(F.col("exit_policy") == "LEGACY_HALF_AT_TP1", legacy[n]).when(F.col("exit_policy") == "PARTIAL_FRACTIONS", F.coalesce(f"fraction_{n}", F.lit(0.0))).otherwise(0.0).alias(f"f{n}") for n in (1, 2, 3)]
    levels = F.struct("entry_type", "entry_high", "stop", *[F.col(f"target_{n}").alias(f"t{n}") for n in (1, 2, 3)], *shares, "invalidation", "expiration", "decided", "cancel_on", "manual_on", "manual_price")
    return validated(per).filter("problem is null").select(trade, *more, levels.alias("p"))


def _log(states: DataFrame, trade: str) -> DataFrame:
    return states.select(trade, F.posexplode("s.log").alias("at", "e")).select(trade, (F.col("at") + 1).alias("sequence_number"), "e.*")


def advance(plans: DataFrame, states: DataFrame | None, bars: DataFrame, trade: str) -> DataFrame:
    """(trade, s, through): the states of plans (trade and columns of PLAN, a row each) after more bars, from those of an earlier call.

    Bars go on from where the states left off: one on or before a trade's last day cannot be folded any more and is an error.
    """
    fresh = bars.select(trade, _bars().alias("bar")).groupBy(trade).agg(F.sort_array(F.collect_list("bar")).alias("bars"))
    both = _levels(_typed(plans, trade), trade).join(fresh, trade, "left")
    if states is None:
        both = both.withColumns({"s0": F.expr(_start()), "through": F.lit(None).cast("date")})
    else:
        both = both.join(states.select(trade, F.col("s").alias("s0"), "through"), trade, "left").withColumn("s0", F.coalesce("s0", F.expr(_start())))
    late = F.get("bars", F.lit(0))["d"] <= F.col("through")
    refused = F.raise_error(F.concat(F.lit("a bar came after its trade was folded through "), F.col("through").cast("string")))
    checked = both.withColumn("bars", F.when(F.coalesce(late, F.lit(False)), refused.cast(both.schema["bars"].dataType)).otherwise(F.col("bars")))
    folded = F.when(F.col("bars").isNull(), F.col("s0")).otherwise(F.expr(f"aggregate(bars, s0, (s, b) -> {_step()})"))
    return checked.select(trade, folded.alias("s"), F.coalesce(F.element_at("bars", -1)["d"], F.col("through")).alias("through"))


def log_of(states: DataFrame, plans: DataFrame, trade: str) -> DataFrame:
    """The log of every trade from its state, as ``simulate`` gives it of the bars so far."""
    both = _levels(_typed(plans, trade), trade).join(states, trade)
    return _log(both.select(trade, F.expr(_finish("s")).alias("s")), trade)


def simulate(path: DataFrame, trade: str) -> DataFrame:
    """(trade, sequence_number, session_date, event, price, fraction, state): the log of each trade.

    path: trade, columns of PLAN (the same on all rows of a trade), session_date, open, high, low, close. A trade
    whose plan breaks a rule has no log.
    """
    rows = _typed(path, trade, _bars().alias("bar"))
    per = rows.groupBy(trade).agg(*[F.first(c).alias(c) for c in PLAN], F.sort_array(F.collect_list("bar")).alias("bars"))
    return _log(_levels(per, trade, "bars").select(trade, F.expr(_fold()).alias("s")), trade)

def metrics(log: DataFrame, path: DataFrame, trade: str) -> DataFrame:
    """(trade, state, entry, exit, sold, ret, realised_r, bars_held, mfe, mae) of each entered trade, from its log and the bars that it was held; of an entry at zero, ret, mfe and mae are NULL."""
    sold = F.col("fraction") > 0
    agg = log.groupBy(trade).agg(
        F.max_by("state", "sequence_number").alias("state"), F.max(F.when(F.col("event") == "ENTRY", F.col("price"))).alias("entry"), F.min(F.when(F.col("event") == "ENTRY", F.col("session_date"))).alias("__from"),
        F.max("session_date").alias("__to"), F.sum(F.when(sold, F.col("price") * F.col("fraction"))).alias("__gain"), F.coalesce(F.sum(F.when(sold, F.col("fraction"))), F.lit(0.0)).alias("sold"),
    ).filter("entry is not null")
    closed = ~F.col("state").isin(*OPEN)
    bars = path.select(trade, "session_date", "high", "low", "stop").join(agg.select(trade, "__from", F.when(closed, F.col("__to")).alias("__to")), trade)
    bars = bars.filter((F.col("session_date") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("session_date") <= F.col("__to"))))
    held = bars.groupBy(trade).agg(F.count("*").alias("bars_held"), F.max("high").alias("__h"), F.min("low").alias("__l"), F.first("stop").alias("__s"))
    full = F.abs(F.col("sold") - 1) < 1e-9
    return agg.join(held, trade, "left").select(
        trade, "state", "entry", F.try_divide(F.col("__gain"), F.when(F.col("sold") > 0, F.col("sold"))).alias("exit"), "sold", F.when(full, F.try_divide(F.col("__gain"), F.col("entry")) - 1).alias("ret"),
        F.try_divide(F.coalesce("__gain", F.lit(0.0)) - F.col("sold") * F.col("entry"), F.col("entry") - F.col("__s")).alias("realised_r"), F.coalesce("bars_held", F.lit(0)).alias("bars_held"),
        (F.try_divide(F.col("__h"), F.col("entry")) - 1).alias("mfe"), (F.try_divide(F.col("__l"), F.col("entry")) - 1).alias("mae"),
    )
