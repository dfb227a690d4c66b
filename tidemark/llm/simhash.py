"""SimHash near-duplicates.

A document's fingerprint has a bit for each of the 64 bits of its shingles' hashes: 1 if it is set in
over half of them. Documents whose fingerprints differ in at most two bits are linked, and linked
documents form components.

Links are found by pigeonhole blocks: the 64 bits are cut into six blocks, of which two differing
bits can touch two, so that close fingerprints agree in some four of the six. Distinct fingerprints
are dealt by each of the 15 choices of four blocks, and compared where these agree. There only 22
bits are free, which bounds a bucket to 2**22 fingerprints whatever the corpus; buckets of many are
searched by flipping one or two free bits instead of comparing all pairs. Copies share a fingerprint
and never become pairs.

Defined cases: null texts count as empty; documents without words have fingerprint zero, and are
linked like any other; texts of one or two words are one shingle; repeated rows are copies; null ids
have a fingerprint and join components, and are a component's id only if all its ids are null; empty
tables give empty results; very long texts are hashed in blocks of a megabyte.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import checkpoint, join_counted, written
from .components import connected_components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
_BLOCKS = (11, 11, 11, 11, 10, 10)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: From this many fingerprints on, a bucket is searched by flipping bits.
_FLIP_FROM = 96


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of data, in lists of about size bytes."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + size)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(data: bytes) -> int:
    """Of a text in UTF-8."""
    counts, total, held = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in word_blocks(data.lower()):  # bytes.lower and bytes.split know ASCII only
        words = held + words
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(SHINGLE)))], dtype="<u8")
        if len(hashes):
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        held = words[1 - SHINGLE :]
    if not total:
        return digest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["__llm_id", "__llm_fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__llm_id, __llm_fp long) for each row."""
    schema = T.StructType([T.StructField("__llm_id", docs.schema[id_col].dataType), T.StructField("__llm_fp", T.LongType())])
    return docs.select(F.col(id_col).alias("__llm_id"), F.col(text_col).cast("binary").alias("__llm_text")).mapInArrow(_fingerprints, schema)


def _masks() -> list[int]:
    """For each choice of four blocks, the bits that must agree."""
    edges = np.cumsum((0, *_BLOCKS)).tolist()
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, len(block) - MAX_BITS)]


MASKS = _masks()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket(values: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within a bucket of sorted distinct fingerprints, thinned to what keeps it connected."""
    n = len(values)
    if n < _FLIP_FROM:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(values[i] ^ values[j]) <= MAX_BITS
        return values[i[near]], values[j[near]]
    free = [np.uint64(1 << b) for b in range(64) if not mask >> b & 1]
    flips = free + [a | b for a, b in combinations(free, 2)]
    label, changed = np.arange(n), True
    while changed:
        was = label.copy()
        for flip in flips:
            other = values ^ flip
            at = np.minimum(np.searchsorted(values, other), n - 1)
            hit = np.flatnonzero(values[at] == other)
            low = np.minimum(label[hit], label[at[hit]])
            np.minimum.at(label, label[hit], low)
            label[hit] = np.minimum(label[hit], low)
        label = label[label]
        changed = not np.array_equal(was, label)
    moved = np.flatnonzero(label != np.arange(n))
    return values[moved], values[label[moved]]


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the buckets of a sorted partition of (choice, key, fingerprint)."""

    def linked(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        starts = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(fp)])
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS]
        a.append(fp[two]), b.append(fp[two + 1])
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            x, y = _bucket(np.sort(fp[s : s + n]), MASKS[choice[s]])
            a.append(x), b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now[2] = now[2].view(np.uint64)
        held = [np.concatenate(x) for x in zip(held, now)] if held else now
        if not len(held[0]):
            continue
        last = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])).max(initial=-1)) + 1
        if last:
            yield linked(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    if held and len(held[0]):
        yield linked(*held)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) links between distinct fingerprints (column __llm_fp), enough to connect all that are close."""
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("__llm_fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(MASKS)])
    dealt = distinct.select("__llm_fp", F.explode(keys).alias("k")).select("k.choice", "k.key", "__llm_fp")
    dealt = dealt.repartition("choice", "key").sortWithinPartitions("choice", "key")
    return dealt.mapInArrow(_links, "a long, b long")


def _components(rows: DataFrame) -> DataFrame:
    """(__llm_fp, __llm_n, __llm_root, component_id) per distinct fingerprint of rows."""
    per = written(rows.groupBy("__llm_fp").agg(F.min("__llm_id").alias("__llm_first"), F.count("*").alias("__llm_n")), "fingerprints")
    roots = connected_components(links(per.select("__llm_fp"))).select(F.col("a").alias("__llm_fp"), F.col("b").alias("__llm_root"))
    rooted = per.join(roots, "__llm_fp", "left").withColumn("__llm_root", F.coalesce("__llm_root", "__llm_fp"))
    ids = rooted.groupBy("__llm_root").agg(F.min("__llm_first").alias("component_id"), F.count("*").alias("__llm_fps"))
    return written(join_counted(rooted, ids, "__llm_root", "__llm_fps", per.count()).select("__llm_fp", "__llm_n", "__llm_root", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row. Texts are read once."""
    rows = checkpoint(fingerprints(docs, id_col, text_col))
    found = join_counted(rows, _components(rows), "__llm_fp", "__llm_n", rows.count())
    return found.select(F.col("__llm_id").alias(id_col), F.lpad(F.lower(F.hex("__llm_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = bloom.MOST_WORDS) -> DataFrame:
    """One row of each component, that with the smallest id, with all columns of docs.

    Rows that share id and fingerprint count as one; of equal or only null ids, the smallest fingerprint
    stays. Only rows whose id a Bloom filter finds among those that go, or that are repeated, shuffle with
    their columns; the rest pass straight through.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    n = rows.count()
    found = join_counted(rows, _components(rows), "__llm_fp", "__llm_n", n)
    keys = found.groupBy("__llm_id", "__llm_fp").agg(F.first("__llm_root").alias("__llm_root"), F.count("*").alias("__llm_c"))
    best = keys.groupBy("__llm_root").agg(F.min(F.struct(F.col("__llm_id").isNull(), "__llm_id", "__llm_fp")).alias("__llm_best"), F.count("*").alias("__llm_k"))
    keys = join_counted(keys, best, "__llm_root", "__llm_k", n)
    stays = F.col("__llm_id").eqNullSafe(F.col("__llm_best.__llm_id")) & (F.col("__llm_fp") == F.col("__llm_best.__llm_fp"))
    keys = keys.select("__llm_id", "__llm_fp", "__llm_c", stays.alias("__llm_stays"), F.xxhash64("__llm_id").alias("__llm_h"))
    special = written(keys.filter("not __llm_stays or __llm_c > 1"), "special")
    words = bloom.words_for(special.count(), most_words)
    flagged = bloom.flag(docs.withColumn("__llm_h", F.xxhash64(F.col(id_col))), "__llm_h", bloom.of_keys(special, "__llm_h", words), words, "__llm_hit")
    hits, rest = flagged.filter("__llm_hit"), flagged.filter("not __llm_hit").select(*cols)
    if rows.filter("__llm_id is null").isEmpty() and rows.groupBy("__llm_id").count().filter("count > 1").isEmpty():
        return rest.unionByName(hits.join(special.select(F.col("__llm_id").alias(id_col)), id_col, "left_anti").select(*cols))
    numbered = written(hits.select(*cols, F.monotonically_increasing_id().alias("__llm_row")), "hits")
    keyed = numbered.withColumn("__llm_key", F.struct(F.col(id_col).alias("id"), F.col("__llm_row").alias("row")))
    again = fingerprints(keyed, "__llm_key", text_col).select(F.col("__llm_id.id").alias("__llm_i"), F.col("__llm_id.row").alias("__llm_row"), F.col("__llm_fp").alias("__llm_f"))
    matched = written(again.join(special, F.col("__llm_i").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_f") == F.col("__llm_fp"))).select("__llm_i", "__llm_f", "__llm_row", "__llm_stays"), "matched")
    first = matched.filter("__llm_stays").groupBy("__llm_i", "__llm_f").agg(F.min("__llm_row").alias("__llm_row")).select("__llm_row")
    gone = matched.select("__llm_row").join(first, "__llm_row", "left_anti")
    return rest.unionByName(numbered.join(gone, "__llm_row", "left_anti").select(*cols))
