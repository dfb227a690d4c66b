from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid
from tests.llm.test_dedup_mix_chat import brute_dedup, water_fill
from tests.llm.test_simhash_langid_warc import brute_components, brute_fingerprint


def test_pipeline_against_a_plain_version(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = docs.filter("doc_id % 9 = 0").withColumns({"doc_id": F.col("doc_id") + 1000})
    near = docs.filter("doc_id % 11 = 0 and length(text) > 3000").withColumns({"doc_id": F.col("doc_id") + 2000, "text": F.concat("text", F.lit(" tail"))})
    empty = docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 3000, "text": F.lit(None).cast("string")})
    whole = docs.unionByName(copies).unionByName(near).unionByName(empty)
    whole.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    rows = {r.doc_id: r for r in whole.collect()}
    model = langid.fit(whole)
    kept = {i: r for i, r in rows.items() if not model.decode(r.text)[2]}
    assert not any(i >= 3000 for i in kept) and len(kept) > 0.95 * len(docs.collect())
    kept = {max(g): kept[max(g)] for g in brute_dedup([(i, r.text) for i, r in kept.items()]).values()}
    fps = {i: brute_fingerprint(r.text) for i, r in kept.items()}
    root = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    kept = {i: kept[i] for i in set(root.values())}
    sizes = Counter()
    for r in kept.values():
        sizes[r.source] += len(r.text.encode().split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = water_fill(sizes, {s: float(1 + i % 3) for i, s in enumerate(order)})
    times = Counter(r.doc_id for r in got)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(times) <= set(kept)
    for i, r in kept.items():
        rate = target[r.source] / sizes[r.source]
        assert times[i] in (int(rate + 1e-9), int(rate - 1e-9) + 1)
    for r in got:
        assert r.pieces == sp.encode(kept[r.doc_id].text)


def test_null_and_repeated_ids_and_clashing_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit("clash") for c in ("pieces", "__llm", "size", "fingerprint", "lang_pred")})
    odd = docs.filter("doc_id < 40").withColumns({"doc_id": F.when(F.col("doc_id") % 2 == 0, F.lit(7)).cast("long"), "text": F.concat("text", F.lit(" and something else that nobody said before"))})
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "pieces"] and got.filter("doc_id is null").count() > 0 and got.filter("pieces is null").count() == 0


def test_stages_keep_columns_and_bear_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
