import random

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "  ", "a   b  ", "Hello  world\n a <s> </s>", "the then there thermal", "東京タワー、日本", "\x00zero\x00", "é́ ñ ½² 3.14159 0x1F", "🙂👍🏽", "----" * 40, "x" * 200, "\t\ttabs\r\n\r\n", "don't.e,g;h", "ΑΣ ß İ", "_under_score__", "١٢٣", "aaaaaaaaaa", " lead", "trail ", "ab" * 31, "includegraphics springframework MERCHANTABILITY"]


def test_table_and_hard_texts_equal_the_library(spark, sf):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rng = random.Random(8)
    rows = [(10_000 + i, t) for i, t in enumerate(HARD)] + [(20_000 + i, "".join(rng.choices(HARD[1:], k=6))) for i in range(40)]
    rows += [(30_000, None), (30_001, "long text " * 50_000), (30_000, None), (None, "null id")]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("pieces", lattice.F.lit("clash"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    encoded = lattice.encode(docs, PATH, chunk_bytes=100_000, decoded=True)
    assert lattice.decode(encoded.select("doc_id", "pieces"), PATH).exceptAll(encoded).count() == 0 and encoded.columns == ["doc_id", "pieces", "decoded"]
    got = encoded.collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.pieces == model.encode(texts[r.doc_id][0] or ""), texts[r.doc_id][0]
        assert r.decoded == (texts[r.doc_id][0] or "")
    assert lattice.encode(docs.limit(0), PATH).count() == 0


def test_units_and_words():
    assert lattice.words("a  b ") == ["a", " b", ""] and lattice.words("") == [] and lattice.words("x▁ y") == ["x", " y"]
    assert lattice.units("don't12") == ["▁don", "'", "t", "1", "2"] and lattice.units(" b") == ["▁▁b"]
    texts = ["a b", "", " lead", "a  b", "b a", "x▁y"]
    assert lattice._words(texts).to_pylist() == [lattice.words(t) for t in texts]
    vocabulary = ["ab", "ab.,", "a1", "...", "", " b", "don't", "é!!\n", "x.y"]
    numbers, n, unit = lattice._cut(lattice.pa.array(vocabulary))
    assert unit.take(lattice.pa.array(numbers)).to_pylist() == [u for w in vocabulary for u in lattice.units(w)] and n.tolist() == [len(lattice.units(w)) for w in vocabulary]
    some = ["a\0", "b", "\0", "é"]
    assert lattice._unpack_units(lattice._pack_units(some)) == some


def test_models_with_unreached_pieces_are_refused(spark):
    model = lattice.Pieces.__new__(lattice.Pieces)
    model.normal = [("ab", 0, -1.0), ("a", 1, -2.0), ("b", 2, -3.0), ("abcd", 3, -4.0)]
    model.ranks = {p: i for i, (p, _, _) in enumerate(model.normal)}
    with pytest.raises(ValueError, match="abcd"):
        model.known(spark, "bpe")


def merged(word, rank):
    """BPE by its definition: the best-ranked pair, the leftmost of equals, until none is left."""
    parts = list(word)
    while pairs := [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]:
        k = min(pairs)[1]
        parts[k : k + 2] = ["".join(parts[k : k + 2])]
    return parts


@pytest.mark.parametrize("ties", [False, True])
def test_viterbi_path_equals_merges(spark, ties):
    """Random piece tables, whose pieces were made by merging two others, with ranks in another order than they were made."""
    rng = random.Random(6 + ties)
    table = {"a": 0, "b": 0, "c": 0}
    while len(table) < 30:
        table.setdefault("".join(rng.choices(list(table), k=2)), rng.randint(0, 6) if ties else rng.random())
    table = {p: s for p, s in table.items() if len(p) <= 8}
    ranks = {x: i for i, x in enumerate(sorted({s for p, s in table.items() if len(p) > 1}))}
    rank = {p: ranks[s] for p, s in table.items() if len(p) > 1}
    while lost := [p for p in rank if merged(p, rank) != [p]]:
        for p in lost:
            del rank[p]
    model = lattice.Pieces.__new__(lattice.Pieces)
    model.normal = [(p, i, -float(rank.get(p, 99))) for i, p in enumerate([*rank, "a", "b", "c"])]
    model.ranks, model.longest, model.first_byte = rank | {"a": 99, "b": 99, "c": 99}, 8, 1000
    words = {"".join(rng.choices("abcé" if i % 9 == 0 else "abc", k=rng.randint(1, 24))) for i in range(300)} | {"a" * n for n in range(1, 40)}
    rows = spark.createDataFrame([(i, 0, w) for i, w in enumerate(sorted(words))], "id long, bucket int, unit string")
    got = {r.unit: r.ids for r in lattice.encode_units(rows, model).collect()}
    name = {i: p for p, i, _ in model.normal} | {1000 + b: b for b in "é".encode()}
    assert len(got) == len(words)
    for w, ids in got.items():
        want = [x for p in merged(w, rank) for x in (list(p.encode()) if p == "é" else [p])]
        assert [name[i] for i in ids] == want, w


def test_viterbi_takes_the_best_path(spark):
    rng = random.Random(4)
    table = {"".join(rng.choices("abc", k=rng.randint(1, 4))): -rng.random() * 9 for _ in range(25)} | {"a": -5.0, "b": -6.5}
    ids = {p: i for i, p in enumerate(table)}
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 12))) for _ in range(80)]
    model = lattice.Pieces.__new__(lattice.Pieces)
    model.normal, model.longest, model.first_byte = [(p, ids[p], s) for p, s in table.items()], 4, 1000
    model.ranks = {p: 0 for p in table}
    got = {r.unit: r.ids for r in lattice.encode_units(spark.createDataFrame([(i, 0, w) for i, w in enumerate(set(words))], "id long, bucket int, unit string"), model, "unigram").collect()}
    score = {i: table[p] for p, i in ids.items()}

    def best(word):
        at = [0.0]
        for e in range(1, len(word) + 1):
            at.append(max([at[e - 1] - 100] + [at[s] + table[word[s:e]] for s in range(e) if word[s:e] in table]))
        return at[-1]

    names = {i: p for p, i in ids.items()}
    assert got.keys() == set(words)
    for w, found in got.items():
        total = sum(score[i] for i in found if i < 1000)
        lost = len(w) - sum(len(names[i]) for i in found if i < 1000)
        assert total - 100 * lost == pytest.approx(best(w))
