import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    """(start, length, crc) by the library alone."""
    t, at, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_tokens_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = tf.read_tokens(tf.write_tokens(docs, PATH)).collect()
    assert sorted(map(tuple, got)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_hard_texts(spark):
    rng = random.Random(2)
    pieces = ["<|endoftext|>", "x<|startoftext|>y", "it's", "IT'S", "don't.", "a.,b", "É", "Straße", "İstanbul", "ñandú!", "東京タワー", "é", "क़", "12a3", " ", " x", "…", "ﬁ", "ΑΣ", "\x00", "<|", "|>", "'", "''s", "\x1c", "\x85", "🙂👍🏽", "ŒUVRE"]
    rows = [(i, " \n\t".join(rng.choices(pieces, k=30)) + "".join(rng.choices(pieces, k=9))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (-5, "first"), (203, "Long word " * 150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("clash"))
    files = tf.write_tokens(docs, PATH)
    assert sorted(map(tuple, tf.read_tokens(files).collect())) == brute(rows)
    first = files.orderBy("part").first()
    t = Tokenizer.from_file(PATH)
    assert np.concatenate(list(tf.TokenReader(first.file).span(0, 2))).tolist() == [*t.encode("first").ids[:1], 2][:2]
    assert tf.read_tokens(tf.write_tokens(docs.limit(0), PATH)).count() == 0
    twice = [(1, "same"), (1, "same"), (None, "null id")]
    got = tf.read_tokens(tf.write_tokens(spark.createDataFrame(twice, "doc_id long, text string"), PATH)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(twice), key=str)


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "a<|EndOfText|>b <|STARTOFTEXT|>", "J\u030c", "xJ\u030cy T\u0308 H\u0331", "THE The the It'S ÉCLAIR"])
def test_case_is_the_library_s(text):
    """Special tokens are found in the raw text, and NFC comes before Lowercase."""
    of = tf.Encoder(PATH)
    ids = np.frombuffer(b"".join(tf.encode_text(text.encode(), of)), "<u4").tolist()
    assert ids == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tf, "MEMORY_WORDS", 40)
    e = tf.Encoder(PATH)
    t = Tokenizer.from_file(PATH)
    for k in range(20):
        text = " ".join(f"word{k // 2}x{i}." for i in range(5 * (k % 2), 15))
        assert np.frombuffer(b"".join(tf.encode_text(text.encode(), e)), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(e.words) <= 40


@pytest.mark.parametrize("top", [0, 1, 200, 49_407, 2**32 - 1])
def test_blocks(top):
    rng = np.random.default_rng(top % 97)
    for n in (1, 2, 1000, 4096):
        ids = rng.integers(0, top + 1, n, dtype=np.uint64).astype("<u4")
        if n > 10:
            ids[3] = 2**32 - 1
        assert np.array_equal(tf.unpack_block(tf.pack_block(ids)), ids)


def test_latin_words_are_learned_together_without_normalising(spark, monkeypatch):
    """Parts in lower case need no normaliser and pattern, and documents of a group no call each."""
    docs = [(i, f"Plain{chr(97 + i % 26)} WORD{chr(98 + i % 20)}é, don't x{i}!! Straße") for i in range(300)]
    want = [Tokenizer.from_file(PATH).encode(x, add_special_tokens=False).ids for _, x in docs]
    e, calls = tf.Encoder(PATH), []

    class Counted:
        def encode_batch_fast(self, texts, of=e.of_parts, **kw):
            calls.append(len(texts))
            return of.encode_batch_fast(texts, **kw)

    e.of_parts, e._single = Counted(), lambda words: iter(()) if not words else pytest.fail("by the whole tokenizer")
    got = [np.frombuffer(b"".join(p), "<u4").tolist() for _, p in tf.encode_group([(i, x.encode()) for i, x in docs], e)]
    assert got == want and calls == [1]
