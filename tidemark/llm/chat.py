"""Chat formatting with Spark expressions only.

A conversation becomes one string. Adjacent turns of one role share a block, ``<s>role\\n`` text
``</s>``; the texts of a block are parted by ``[+]``. Control strings in texts and roles are escaped:
``&`` becomes ``&amp;`` and the first character of a control string becomes ``&lt;`` or ``&lsqb;``, so
that no text can forge a mark and reading back gives the very turns. The loss mask lists the code
point spans of the assistant's texts.

Turns are collected, ordered by turn, role and text, and merged by folding the array. The fold keeps its
pieces in an array that is joined once, and goes by blocks, so that a very long conversation costs in
proportion to its length.

Defined cases: null text and null role count as empty; null turns come first; null conv_id is a
conversation of its own; repeated rows are turns of their own; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Turns that are folded at once.
BLOCK = 512
OPEN, CLOSE, NEXT = "<s>", "</s>", "[+]"
#: The template's own marks and those of common chat templates.
CONTROL = [OPEN, CLOSE, NEXT, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]


def _replace(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _named(mark: str) -> str:
    return {"<": "&lt;", "[": "&lsqb;"}[mark[0]] + mark[1:]


def escape(text: Column) -> Column:
    return _replace(text, [("&", "&amp;")] + [(m, _named(m)) for m in CONTROL])


def unescape(text: Column) -> Column:
    return _replace(text, [("&lt;", "<"), ("&lsqb;", "["), ("&#10;", "\n"), ("&amp;", "&")])


def _merged(turns: Column, trained: str) -> Column:
    """Folds sorted turns, a block at a time: struct<role, pieces, spans, at> each, with spans from the block's begin."""
    start = F.struct(
        F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("pieces"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(0).cast("long").alias("at")
    )

    def add(acc: Column, t: Column) -> Column:
        mark = F.when(acc["role"].isNull(), t["head"]).when(acc["role"] == t["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(CLOSE), t["head"]))
        begin = acc["at"] + F.length(mark)
        end = begin + F.length(t["text"])
        spans = F.when(t["role"] == F.lit(trained), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct(t["role"].alias("role"), F.concat(acc["pieces"], F.array(mark, t["text"])).alias("pieces"), spans.alias("spans"), end.alias("at"))

    def block(i: Column) -> Column:
        return F.aggregate(F.slice(turns, i, F.lit(BLOCK)), start.withField("role", F.get(turns, i - 2)["role"]), add)

    return F.transform(F.sequence(F.lit(1), F.size(turns), F.lit(BLOCK)), block)


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv, formatted string, loss_mask array<struct<start, end>>), one row a conversation."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(conv).alias("__llm_conv")).agg(F.sort_array(F.collect_list(one)).alias("__llm_turns"))
    head = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    escaped = F.transform("__llm_turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("text")))
    merged = grouped.select("__llm_conv", escaped.alias("__llm_turns")).select("__llm_conv", _merged(F.col("__llm_turns"), trained).alias("__llm_blocks"))
    ends = F.aggregate("__llm_blocks", F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
    merged = merged.withColumn("__llm_before", ends)
    moved = lambda b, k: F.transform(b["spans"], lambda s: F.struct((s["start"] + F.get("__llm_before", k)).alias("start"), (s["end"] + F.get("__llm_before", k)).alias("end")))
    return merged.select(
        F.col("__llm_conv").alias(conv),
        F.concat(F.array_join(F.flatten(F.transform("__llm_blocks", lambda b: b["pieces"])), ""), F.lit(CLOSE)).alias("formatted"),
        F.flatten(F.transform("__llm_blocks", moved)).alias("loss_mask"),
    )


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != F.lit(""))

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + F.lit(2))
        role = unescape(F.substr(role, F.lit(len(OPEN) + 1)))
        return F.transform(F.split(body, r"\[\+\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    spans = F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(spans, "")


def chat_digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what reading the formatted conversations back gives."""
    turns, loss = parse_chat(F.col("formatted")), F.col("__llm_loss")
    listed = F.array_join(F.transform("__llm_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.select(conv, "formatted", turns.alias("__llm_turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("__llm_loss"))
    return read.select(
        conv,
        F.size("__llm_turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def marked_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
