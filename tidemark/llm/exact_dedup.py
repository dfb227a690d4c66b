"""Exact deduplication: two passes over a Bloom filter, then an exact grouping of the few rows it points at.

The first pass sets two bits of a register-blocked Bloom filter for each text's hash and keeps the
bits that were set at least twice. A row whose bits were all set twice is possibly repeated. In the
second pass only those rows shuffle, to be grouped by their SHA-256; the rest pass straight through.
A filter is bounded (see :mod:`.bloom`) and always broadcast. Where one would be too full, the rows'
hashes are dealt into slices, as many as the rows ask for, and each slice has its own filter in turn, so
that the share of rows flagged in vain is the same at any size.

Defined cases: null texts count as empty; texts are equal when identical after lower-casing A-Z; of
equal texts the row with the largest id stays, null ids being smallest; of rows that also share the
id, exactly one stays. Empty tables give empty results. Other columns are carried by
:func:`drop_duplicates` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import bloom
from .common import ascii_lower, checkpoint, join_counted, new_folder


def _normal(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def _flagged(rows: DataFrame, h: str, n: int, most: int) -> DataFrame:
    """rows with the boolean __llm_possible, from both passes over the hashes in column h."""
    words = bloom.words_for(n, most)
    return bloom.flag(rows, h, bloom.of_repeated(rows.select(h), h, words), words, "__llm_possible")


def _flagged_in_slices(rows: DataFrame, h: str, n: int, most: int) -> DataFrame:
    """rows with the boolean __llm_possible, by one filter for each slice of hashes that fills it; each row is written twice and read three times."""
    slices = -(-n // (most * bloom.KEYS_A_WORD))
    if slices <= 1:
        return _flagged(rows, h, n, most)
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "slices")
    # Bits that neither the word nor the places within it are read from.
    which = F.pmod(F.shiftrightunsigned(h, 30).bitwiseAND(F.lit((1 << 22) - 1)), F.lit(slices)).cast("int")
    rows.withColumn("__llm_slice", which).write.partitionBy("__llm_slice").parquet(f"{folder}/dealt")
    dealt = spark.read.schema(StructType([*rows.schema.fields, StructField("__llm_slice", IntegerType())])).parquet(f"{folder}/dealt")
    for i in range(slices):
        part = _flagged(dealt.filter(F.col("__llm_slice") == i).drop("__llm_slice"), h, most * bloom.KEYS_A_WORD, most)
        part.write.mode("append").parquet(f"{folder}/flagged")
    return spark.read.schema(part.schema).parquet(f"{folder}/flagged")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = bloom.MOST_WORDS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of docs.

    Texts are read once, for their digests; what follows handles some hundred bytes a row.
    """
    normal = _normal(text_col)
    rows = checkpoint(
        docs.select(
            F.col(id_col).alias("__llm_id"),
            F.sha2(normal, 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("__llm_row"),
        ).withColumn("__llm_h", F.xxhash64("text_sha256"))
    )
    n = rows.count()
    flagged = _flagged_in_slices(rows, "__llm_h", n, most_words)
    possible = flagged.filter("__llm_possible")
    groups = possible.groupBy("text_sha256").agg(
        F.max("__llm_id").alias("keep_id"),
        F.coalesce(F.max_by("__llm_row", "__llm_id"), F.max("__llm_row")).alias("__llm_keep_row"),
        F.count("*").alias("group_size"),
    )
    shared = join_counted(possible, groups, "text_sha256", "group_size", n)
    alone = flagged.filter(~F.col("__llm_possible")).select(
        F.col("__llm_id").alias(id_col), F.col("__llm_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return alone.unionByName(
        shared.select(F.col("__llm_id").alias(id_col), "keep_id", "group_size", (F.col("__llm_row") == F.col("__llm_keep_row")).alias("kept"), "text_sha256")
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = bloom.MOST_WORDS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Possibly repeated rows shuffle whole; a group
    shrinks to one row a task before that."""
    cols = docs.columns
    hashed = docs.withColumn("__llm_h", F.xxhash64(_normal(text_col)))
    flagged = _flagged(hashed, "__llm_h", docs.count(), most_words)
    order = F.struct(F.col(id_col).isNotNull(), F.col(id_col))
    kept = (
        flagged.filter("__llm_possible")
        .groupBy(F.sha2(_normal(text_col), 256).alias("__llm_sha"))
        .agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols]), order).alias("__llm_doc"))
        .select(*[F.col("__llm_doc").getField(c).alias(c) for c in cols])
    )
    return flagged.filter(~F.col("__llm_possible")).select(*[F.col(f"`{c}`") for c in cols]).unionByName(kept)
