"""Changes of an index out of announcement texts: a text becomes its tokens in order, and a fold over them keeps who replaces whom.

Tokens are companies with their symbols, verbs, mentions of an index, dated phrases, summary headers and
words that tell a reason; all other words are passed over. The fold holds the open clause (who, verb, whom)
until an index is named: a clause of the wanted index is kept, those of others are dropped. Clauses without a
date between them share the next dated phrase; where none follows, the last one before them counts, as in "will
make the following changes after the close on". Everything is column functions; a text is one row.

Defined cases: null and empty texts, and texts without a clause, give no row. A company without a symbol is
looked up among the companies named before it, if one symbol only belongs to that name; else the clause has a
problem. A date that its weekday contradicts is no date. Sentences that name no index are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Months as announcements write them, reasons by rank, and timings.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
REASONS = (("BANKRUPTCY", "bankruptcy|chapter 11"), ("SPINOFF", "spinning off|spin-off|spin off|spun off"), ("MERGER_OR_ACQUISITION", "acquir|merg|buyout|take[- ]private"), ("NO_LONGER_REPRESENTATIVE", "no longer (?:representative|eligible)|ranked near"))
TIMINGS = ("AFTER_CLOSE", "BEFORE_OPEN", "EFFECTIVE_ON_DATE", "TBA", "UNKNOWN")

_WORD = r"\b[A-Z0-9][\w&.'’/\-]*+"
NAME = rf"{_WORD}(?:,? (?:{_WORD}|of|and|the|de|plc|&)){{0,9}}+"
_SYMBOL = r"\([A-Za-z][A-Za-z /]{1,18}: ?[A-Z][A-Z0-9.\-]{0,9}\)"
_DAY = rf"(?:(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,? )?(?:{'|'.join(MONTHS)})[a-z]*\.? \d{{1,2}}(?: ?, ?\d{{4}}| \d{{4}}\b)?"
_DATED = {"AFTER_CLOSE": r"after the (?:market )?close of trading(?: on)?", "BEFORE_OPEN": r"(?:prior to|before) the open(?:ing)?(?: of trading)?(?: on)?(?: trading on)?", "EFFECTIVE_ON_DATE": r"effective(?: on)?"}


def _kinds(index: str) -> dict[str, str]:
    """Token patterns, in the order in which they are tried."""
    number = index.rsplit(" ", 1)[-1]
    return {
        "HEADER": rf"{index} INDEX ?[–-] ?(?:{_DAY}|TBA)",
        "COMPANY": rf"{NAME} ?{_SYMBOL}",
        "RENAMED": rf"to be renamed {NAME}",
        "REPLACE": rf"will replace(?: {NAME}(?= in the {index}))?",
        "ADD": r"(?:will be|was) added(?= to)",
        "REMOVE": r"(?:will be|was) removed(?= from)",
        "INDEX": rf"(?:in|to|from) the {index}(?! (?:GICS|Barra|Pure|Growth|Value|and|&|,))(?!\d)",
        "OTHER": rf"(?:in|to|from) the S&P (?:[A-Z]\w* )?(?!{number}\b)\d{{3,4}}",
        "TBA": r"on a date to be announced",
        **{k: f"{v} {_DAY}" for k, v in _DATED.items()},
        **{k: f"(?i:{v})" for k, v in REASONS},
    }


def normal(text: Column) -> Column:
    """One space between words, none inside brackets or the name of the publisher."""
    for old, new in ((r"\s+", " "), (r"S& P", "S&P"), (r"\( ", "("), (r" \)", ")"), (r" :", ":")):
        text = F.regexp_replace(text, old, new)
    return text


def _let(value: Column, then) -> Column:
    """then(value) with the value made once, however often it is read."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def stated_day(phrase: Column, announced: Column) -> Column:
    """The day that a phrase names: without a year the first from three days before the announcement to two hundred after; NULL if its weekday differs."""
    parts = F.regexp_extract_all(phrase, F.lit(rf"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*day|(?:{'|'.join(MONTHS)})(?=[a-z]*\.? \d)|\d+"), F.lit(0))
    months = F.array(*[F.lit(m) for m in MONTHS])

    def day(p: Column) -> Column:
        weekday = F.when(F.get(p, F.lit(0)).endswith("day"), F.substring(F.get(p, F.lit(0)), 1, 3))
        at = F.when(weekday.isNull(), 0).otherwise(1)
        number, of_month, year = F.array_position(months, F.get(p, at)), F.get(p, at + 1).cast("int"), F.get(p, at + 2).cast("int")
        # A day past the end of its month is none.
        made = lambda y: _let(F.date_add(F.to_date(F.format_string("%04d-%02d-01", y, number)), of_month - 1), lambda d: F.when(F.dayofmonth(d) == of_month, d))
        right = lambda d: F.when(weekday.isNull() | (weekday == F.date_format(d, "EEE")), d)
        near = lambda d: F.when(d.between(F.date_sub(announced, 3), F.date_add(announced, 200)), right(d))
        soon = F.coalesce(_let(made(F.year(announced)), near), _let(made(F.year(announced) + 1), near))
        return F.when(number > 0, F.when(year.isNotNull(), _let(made(year), right)).otherwise(soon))

    return _let(parts, day)


def tokens(text: Column, announced: Column, index: str = "S&P 500") -> Column:
    """array<struct<k, symbol, name, day, rank>> of a text, in its order."""
    kinds = _kinds(index)
    every = F.regexp_extract_all(normal(text), F.lit("(" + "|".join(kinds.values()) + ")"), F.lit(1))
    ranks = {r: i for i, (r, _) in enumerate(REASONS)}
    # What tells the tokens apart once they are found, cheaper than their patterns.
    told = {
        "HEADER": lambda t: t.startswith(f"{index} INDEX"), "COMPANY": lambda t: t.endswith(")"), "RENAMED": lambda t: t.startswith("to be renamed "), "REPLACE": lambda t: t.startswith("will replace"),
        "ADD": lambda t: t.endswith(" added"), "REMOVE": lambda t: t.endswith(" removed"), "INDEX": lambda t: t.endswith(f" the {index}"), "OTHER": lambda t: t.contains(" the S&P "), "TBA": lambda t: t == "on a date to be announced",
        **{k: lambda t, v=v: t.rlike(f"^{v} ") for k, v in _DATED.items()}, **{k: lambda t, v=v: t.rlike(f"^(?i:{v})$") for k, v in REASONS},
    }

    def kind(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, is_it in reversed(told.items()):
            out = F.when(is_it(t), k).otherwise(out)
        return F.struct(out.alias("k"), t.alias("t"))

    def token(x: Column) -> Column:
        k, t = x["k"], x["t"]
        company = k == "COMPANY"
        name = F.when(company, F.trim(F.regexp_extract(t, r"^(.*?) ?\([^()]*\)$", 1))).when(k == "RENAMED", F.substr(t, F.lit(15))).when(k == "REPLACE", F.nullif(F.substr(t, F.lit(14)), F.lit("")))
        symbol = F.when(company, F.regexp_extract(t, r": ?([A-Z][A-Z0-9.\-]{0,9})\)$", 1))
        rank = F.element_at(F.create_map(*[F.lit(y) for p in ranks.items() for y in p]), k)
        return F.struct(k.alias("k"), symbol.alias("symbol"), name.alias("name"), F.when(k.isin("HEADER", *_DATED), stated_day(F.regexp_replace(t, rf"^{index} INDEX ?[–-] ?", ""), announced)).alias("day"), rank.alias("rank"))

    found = F.transform(F.transform(every, kind), token)
    return F.filter(found, lambda t: ~t["k"].isin(*_DATED) | t["day"].isNotNull())


_PARTY = "struct<symbol string, name string>"
_STATE = f"""struct<who: {_PARTY}, verb: string, whom: {_PARTY}, seen: array<{_PARTY}>, batch: int, dated: boolean, lead: struct<kind string, day date>,
    clauses: array<struct<added: {_PARTY}, removed: {_PARTY}, renamed: string, batch: int>>, renamed: string, timings: array<struct<batch int, kind string, day date>>, reasons: array<struct<batch int, rank int>>, headers: array<date>>"""


def _state(**new: str) -> str:
    fields = ("who", "verb", "whom", "seen", "batch", "dated", "lead", "clauses", "renamed", "timings", "reasons", "headers")
    return f"cast(struct({', '.join(f'{new.get(f, f's.{f}')} as {f}' for f in fields)}) as {_STATE})"


def _step() -> str:
    party = f"cast(struct(t.symbol as symbol, t.name as name) as {_PARTY})"
    known = "array_distinct(transform(filter(s.seen, c -> startswith(c.name, t.name)), c -> c.symbol))"
    found = f"if(size({known}) = 1, get({known}, 0), null)"
    open_ = {"who": "null", "verb": "null", "whom": "null", "renamed": "null"}
    batch = "if(s.dated, s.batch + 1, s.batch)"
    clause = f"struct(case s.verb when 'REPLACE' then coalesce(s.who, cast(struct(null as symbol, null as name) as {_PARTY})) when 'ADD' then s.who end as added, case s.verb when 'REPLACE' then s.whom when 'REMOVE' then s.who end as removed, s.renamed as renamed, {batch} as batch)"
    waiting = "(size(s.clauses) > 0 and not s.dated)"
    return f"""case
        when t.k = 'COMPANY' and s.verb is null then {_state(who=party, renamed='null', seen=f'concat(s.seen, array({party}))')}
        when t.k = 'COMPANY' then {_state(whom=party, seen=f'concat(s.seen, array({party}))')}
        when t.k = 'RENAMED' then {_state(renamed='t.name')}
        when t.k = 'REPLACE' then {_state(verb="'REPLACE'", whom=f'if(t.name is null, null, cast(struct({found} as symbol, t.name as name) as {_PARTY}))')}
        when t.k in ('ADD', 'REMOVE') then {_state(verb='t.k')}
        when t.k = 'INDEX' and s.verb is not null and (s.who is not null or s.whom is not null) then {_state(**open_, clauses=f'concat(s.clauses, array({clause}))', batch=batch, dated='false')}
        when t.k in ('INDEX', 'OTHER') then {_state(**open_)}
        when t.k = 'HEADER' then {_state(headers='concat(s.headers, array(t.day))')}
        when t.k in ('AFTER_CLOSE', 'BEFORE_OPEN', 'EFFECTIVE_ON_DATE', 'TBA') and {waiting} then {_state(timings='concat(s.timings, array(struct(s.batch as batch, t.k as kind, t.day as day)))', dated='true')}
        when t.k in ('AFTER_CLOSE', 'BEFORE_OPEN', 'EFFECTIVE_ON_DATE', 'TBA') then {_state(lead='if(size(s.clauses) = 0, struct(t.k as kind, t.day as day), s.lead)')}
        when t.rank is not null and size(s.clauses) > 0 then {_state(reasons='concat(s.reasons, array(struct(s.batch as batch, t.rank as rank)))')}
        else s end"""


def changes(releases: DataFrame, keys: list[str], text: str, announced: str, index: str = "S&P 500") -> DataFrame:
    """(keys, place, added, added_name, removed, removed_name, renamed_to, timing, stated_day, header_day, reason, header_differs, problem).

    A row for each clause of the index in a release, place being its place there. header_day is that of the summary, if the release has
    one with a day. reason: the gravest told after the clause and before clauses of another date. problem: ADDED_WITHOUT_SYMBOL or
    REMOVED_WITHOUT_SYMBOL.
    """
    start = f"cast(named_struct('who', null, 'verb', null, 'whom', null, 'seen', array(), 'batch', 0, 'dated', false, 'lead', null, 'clauses', array(), 'renamed', null, 'timings', array(), 'reasons', array(), 'headers', array()) as {_STATE})"
    rows = releases.select(*keys, tokens(F.col(text), F.col(announced), index).alias("__t"))
    folded = rows.select(*keys, F.expr(f"aggregate(__t, {start}, (s, t) -> {_step()})").alias("s"))
    each = folded.select(*keys, "s", F.posexplode("s.clauses").alias("place", "c"))
    mine = F.get(F.expr("filter(s.timings, x -> x.batch = c.batch)"), F.lit(0))
    worst = F.expr("array_min(transform(filter(s.reasons, x -> x.batch = c.batch), x -> x.rank))")
    header = F.when(F.size("s.headers") == 1, F.get("s.headers", F.lit(0)))
    each = each.withColumns({"__when": F.coalesce(mine["kind"], F.col("s.lead.kind"), F.lit("UNKNOWN")), "__day": F.when(mine.isNotNull(), mine["day"]).otherwise(F.col("s.lead.day")), "__header": header})
    a, r = F.col("c.added"), F.col("c.removed")
    return each.select(
        *keys, "place", a["symbol"].alias("added"), a["name"].alias("added_name"), r["symbol"].alias("removed"), r["name"].alias("removed_name"), F.col("c.renamed").alias("renamed_to"),
        F.col("__when").alias("timing"), F.col("__day").alias("stated_day"), F.col("__header").alias("header_day"),
        F.coalesce(F.get(F.array(*[F.lit(x) for x, _ in REASONS]), worst), F.lit("UNSPECIFIED")).alias("reason"),
        F.coalesce(F.col("__header") != F.col("__day"), F.lit(False)).alias("header_differs"),
        F.when(a.isNotNull() & a["symbol"].isNull(), "ADDED_WITHOUT_SYMBOL").when(r.isNotNull() & r["symbol"].isNull(), "REMOVED_WITHOUT_SYMBOL").alias("problem"),
    )
