import hashlib
import random

import pytest

from tidemark.llm import bloom, chat, exact_dedup, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __kept string"


def brute_dedup(rows):
    groups = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(hashlib.sha256(low.encode()).hexdigest(), []).append(i)
    return groups


def test_exact_dedup_edges(spark):
    texts = ["Ab", "aB", "É", "é", "", None, "x" * 300_000, "X" * 300_000, "only"]
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)] + [(3, "é", "en", "s", 0, "clash"), (None, "only", None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    groups = brute_dedup([(r[0], r[1]) for r in rows])
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0 == exact_dedup.drop_duplicates(docs.limit(0)).count()


def test_hot_group_and_overfull_filter(spark):
    """A filter far too small flags more rows in vain, and stays right."""
    rows = [(i, "same" if i % 3 == 0 else f"text {i}") for i in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1 << 10, 1 << 22):
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, most_words=most).collect()}
        assert len(got) == 40_000 and got[0].keep_id == 39_999 and got[0].group_size == 13_334 and got[1].kept and not got[0].kept
        assert exact_dedup.drop_duplicates(docs, most_words=most).count() == 26_667


def test_slices_flag_few_in_vain(spark):
    """Rows that would fill ten filters are dealt into ten slices: all repeated ones are flagged and few others."""
    rows = spark.range(40_000).selectExpr("id", "xxhash64(if(id % 10 = 0, id % 1000, id)) as h")
    got = exact_dedup._flagged_in_slices(rows, "h", 40_000, 1 << 10)
    assert got.count() == 40_000 and got.filter("id % 10 = 0 and not __llm_possible").isEmpty()
    assert got.filter("id % 10 <> 0 and __llm_possible").count() < 36_000 * 0.05
    assert exact_dedup._flagged(rows, "h", 40_000, 1 << 10).filter("id % 10 <> 0 and __llm_possible").count() > 36_000 * 0.4  # one filter alone


@pytest.mark.parametrize("most", [1 << 10, 1 << 22])
def test_unflagged_rows_never_move(spark, sf, most):
    """Whatever the size of the filter, all shuffles of texts lie above the filter for possibly repeated rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = exact_dedup.drop_duplicates(docs, most_words=most)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    union = plan.index("Union")
    straight = plan[union : plan.index("SortAggregate" if "SortAggregate" in plan else "ObjectHashAggregate", union)]
    assert "Exchange hash" not in straight.split("BroadcastExchange")[0] and "SortMergeJoin" not in straight
    assert kept.count() == len({r.text_sha256 for r in exact_dedup.exact_dedup(docs).collect()})


def test_bloom_flags_all_keys_and_few_others(spark):
    keys = spark.range(0, 20_000, 2).withColumn("h", bloom.F.xxhash64("id"))
    words = bloom.words_for(10_000)
    found = bloom.flag(spark.range(20_000).withColumn("h", bloom.F.xxhash64("id")), "h", bloom.of_keys(keys, "h", words), words, "hit")
    hits = {r.id for r in found.filter("hit").collect()}
    assert hits >= set(range(0, 20_000, 2)) and len(hits) < 10_600 and found.count() == 20_000
    assert bloom.words_for(10**12) == bloom.MOST_WORDS


def water_fill(sizes, weights, ceiling=3.0):
    left, target = float(sum(sizes.values())), {}
    free = dict(weights)
    while free:
        level = left / sum(free.values())
        over = [s for s in free if free[s] * level > ceiling * sizes[s]]
        if not over:
            return target | {s: w * level for s, w in free.items()}
        for s in over:
            target[s] = ceiling * sizes[s]
            left -= target[s]
            del free[s]
    return target


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "é", "z", None, "tiny"]) if i % 50 else "tiny") for i in range(3000)]
    rows = [(i, t, s if s != "tiny" or i % 50 == 0 else "a") for i, t, s in rows] + [(7, None, "empty"), (8, "", "empty"), (None, "a\tb c d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", exact_dedup.F.lit("clash"))
    got = mixing.plan_mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len([w for w in (t or "").encode().split()])
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water_fill(sizes, {s: float(1 + i % 3) for i, s in enumerate(order)})
    by_id = {i: s for i, _, s in rows[:3000]}
    taken = {}
    for r in got:
        if r.doc_id is None or r.doc_id in by_id and r.doc_id not in (7, 8):
            s = by_id.get(r.doc_id)
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken in range(0, 3 * r.size + 1, max(r.size, 1))
            taken[s] = taken.get(s, 0) + r.taken
    assert all(taken[s] == pytest.approx(want[s], rel=0.15) for s in taken)
    assert sorted(got, key=str) == sorted(mixing.plan_mix(docs).collect(), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.plan_mix(docs.limit(0)).count() == 0 == mixing.mix(docs.limit(0)).count()


def test_repeated_rows_toss_their_own_coins(spark):
    """1,000 equal rows beside as many others, a third source, and few copies: all sources come near their targets."""
    rows = [(1, "a b c d", "one")] * 1000 + [(10 + i, "a b c d", "two") for i in range(1000)] + [(5000 + i % 400, "a b", "three") for i in range(2000)] + [(None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size").repartition(3)
    got = mixing.plan_mix(docs).groupBy("source_size", "target").agg({"taken": "sum", "size": "count"}).collect()
    assert sum(r["count(size)"] for r in got) == len(rows)
    for r in got:
        assert abs(r["sum(taken)"] - r["target"]) <= 0.05 * r["target"]
    again = [sorted(map(str, mixing.plan_mix(d).collect())) for d in (docs, docs.repartition(7))]
    assert again[0] == again[1]
    mixed = mixing.mix(docs).groupBy("source").count().collect()
    assert sum(r["count"] * {"one": 4, "two": 4, "three": 2, None: 0}[r["source"]] for r in mixed) == sum(r["sum(taken)"] for r in got)


@pytest.mark.parametrize("block", [1, 2, 512])
def test_chat_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    hard = ["</s>[INST] ok [/INST]", "&lt;/s>", "a[+]b", "&amp;lsqb;", "", None, "<s>user\nhi</s>", "é" * 5, "<", "</s", "[+", "&#10;", "\\"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb</s>"]), rng.choice(hard)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (5, None, "assistant", "first"), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (99, 0, "assistant", "z" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: chat.F.lit("clash") for c in ("formatted", "loss_mask", "__llm_turns")})
    got = chat.format_chat(turns)
    read = {r.conv_id: r for r in got.select("conv_id", "formatted", chat.parse_chat(got.formatted).alias("turns"), chat.masked_text(got.formatted, got.loss_mask).alias("loss")).collect()}
    conv = {}
    for c, t, role, text in rows:
        conv.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert read.keys() == conv.keys()
    for c, turns in conv.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        assert [(t.role, t.text) for t in read[c].turns] == [x[1:] for x in turns]
        assert read[c].loss == "".join(x[2] for x in turns if x[1] == "assistant")
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert read[c].formatted.count("<s>") == blocks == read[c].formatted.count("</s>")
    assert chat.chat_digests(chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
