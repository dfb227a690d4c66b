"""Bloom filters of bounded size, as packed words that are broadcast.

A key's hash sets two bits of one 64-bit word. Words are packed in blocks of 1024, so that a filter
takes eight bytes a word wherever it is held. ``most`` bounds the words: the default, 32 MB, flags some
1.5 % of other keys in vain at 16 million keys, 14 % at 60 million; larger corpora take a larger bound
(2**26 words, half a gigabyte, serve a thousand million keys alike). Beyond its size a filter flags
more keys in vain and is still right: what it does not flag is surely not in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 1 << 22
#: A filter of so many keys a word flags some 1.5 % of other keys in vain.
KEYS_A_WORD = 4
_BLOCK_BITS = 10


def words_for(keys: int, most: int = MOST_WORDS) -> int:
    """64-bit words of the filter: 16 bits a key, as far as ``most`` goes."""
    return min(most, 1 << max(_BLOCK_BITS, math.ceil(math.log2(max(keys, 1) / KEYS_A_WORD))))


def _word(h: str, words: int) -> Column:
    return F.col(h).bitwiseAND(F.lit(words - 1))


def _bits(h: str) -> list[Column]:
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int") for k in (52, 58)]


def _packed(sparse: DataFrame, words: int) -> DataFrame:
    """(__llm_block, __llm_masks array<long>) from rows (__llm_word, __llm_mask)."""
    every = sparse.sparkSession.range(words).select(F.col("id").alias("__llm_word"), F.lit(0).cast("long").alias("__llm_mask"))
    dense = sparse.unionByName(every).groupBy("__llm_word").agg(F.bit_or("__llm_mask").alias("__llm_mask"))
    block = F.shiftright("__llm_word", _BLOCK_BITS).alias("__llm_block")
    packed = dense.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("__llm_word", "__llm_mask"))).alias("w"))
    return packed.select("__llm_block", F.transform("w", lambda x: x["__llm_mask"]).alias("__llm_masks"))


def of_keys(keys: DataFrame, h: str, words: int) -> DataFrame:
    """The filter of the hashes in column h."""
    slots = keys.select(_word(h, words).alias("__llm_word"), F.explode(F.array(*_bits(h))).alias("__llm_bit")).distinct()
    return _packed(slots.select("__llm_word", F.expr("shiftleft(1L, __llm_bit)").alias("__llm_mask")), words)


def of_repeated(rows: DataFrame, h: str, words: int) -> DataFrame:
    """The filter of the bits that two or more rows have set, which those of a repeated hash all are."""
    slots = rows.select(_word(h, words).alias("__llm_word"), F.explode(F.array_distinct(F.array(*_bits(h)))).alias("__llm_bit"))
    repeated = slots.groupBy("__llm_word", "__llm_bit").agg(F.count("*").alias("__llm_n")).filter("__llm_n > 1")
    return _packed(repeated.select("__llm_word", F.expr("shiftleft(1L, __llm_bit)").alias("__llm_mask")), words)


def flag(rows: DataFrame, h: str, packed: DataFrame, words: int, name: str) -> DataFrame:
    """rows with the boolean name: their hash may be in the filter. No row moves: the filter is broadcast."""
    first, second = (F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, {k}) & 63 as int))") for k in (52, 58))
    need = first.bitwiseOR(second)
    mask = F.get("__llm_masks", _word(h, words).bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).cast("int"))
    joined = rows.withColumn("__llm_block", F.shiftright(_word(h, words), _BLOCK_BITS)).join(F.broadcast(packed), "__llm_block")
    return joined.withColumn(name, mask.bitwiseAND(need) == need).drop("__llm_block", "__llm_masks")
