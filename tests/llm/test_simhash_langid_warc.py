import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, langid, simhash, warc


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    want = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {i: r.component_id for i, r in got.items()} == want


def test_simhash_edges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "word_blocks", lambda d, size=7, f=simhash.word_blocks: f(d, size))
    texts = ["", None, " \t", "one", "One", "one two", "a b c d e", "A  b\nc d e", "w " * 5000, "  x"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(9, "  x", "clash"), (None, "one", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __llm_fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all(int(r.fingerprint, 16) == brute_fingerprint(texts[r.doc_id]) for r in got if r.doc_id is not None)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[2] == 0 and comp[4] == comp[None] == 3 and comp[7] == 6
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values()))
    for most in (1 << 10, 1 << 22):
        apart = docs.unionByName(spark.createDataFrame([(None, "quite another text than these", "c"), (2, "two rows of one id", "c"), (2, "two rows of one id", "c")], docs.schema))
        assert sorted(str(r.doc_id) for r in simhash.keep_one(apart, most_words=most).collect()) == sorted([*map(str, set(comp.values())), "None", "2"])
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    assert sorted(r.doc_id for r in simhash.keep_one(unique).collect()) == sorted(set(comp.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.keep_one(docs.limit(0)).count()


@pytest.mark.parametrize("flip_from", [2, 10_000])
def test_links_connect_all_close_pairs(spark, monkeypatch, flip_from):
    monkeypatch.setattr(simhash, "_FLIP_FROM", flip_from)
    rng = random.Random(3)
    values = {0, (1 << 64) - 1, (1 << 64) - 2}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(20):
            values.add(x)
            for _ in range(rng.choice((1, 2, 2, 3))):
                x ^= 1 << rng.randrange(64)
    held = np.sort(np.array(sorted(values), np.uint64))
    edges = set()
    for i, m in enumerate(simhash.MASKS):
        keys = held & np.uint64(m)
        for k in np.unique(keys):
            a, b = simhash._bucket(held[keys == k], m)
            edges |= set(zip(a.tolist(), b.tolist()))
    nodes = sorted(values)
    want = brute_components(nodes, lambda a, b: (a ^ b).bit_count() <= 2)
    assert brute_components(nodes, lambda a, b: (a, b) in edges or (b, a) in edges) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 4000)] + [(5000, 5000), (7, 7)]
    got = {r.a: r.b for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 4000)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out and lang is not null")
    assert held.count() > 100
    assert held.filter("lang_pred = lang").count() / held.count() > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0
    assert langid.keep_identified(docs).count() >= 0.97 * docs.count()


def test_language_id_edges(spark):
    rows = [(i, "the cat sat on the mat " * 3, "en") for i in range(40)] + [(i, "der hund liegt auf dem boden " * 3, "de") for i in range(40, 80)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 ...", "de"), (104, "½ ² ① Ⅷ _", "en"), (103, "the cat " * 200_000, None), (None, "der hund", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    assert len(got) == len(rows) and got[103].lang_pred == "en" and got[None].lang_pred == "de" and not got[None].held_out
    assert [got[i].lang_pred for i in (100, 101, 102, 104)] == ["und"] * 4
    assert all(got[i].lang_pred == ("en" if i < 40 else "de") for i in range(80))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    only = langid.language_id(docs.filter("lang = 'en' or lang is null"))
    assert {r.lang_pred for r in only.collect()} == {"en", "und"}
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_id(docs.limit(0)).count() == 0


def plain_language_id(rows, bins=langid.BINS):
    """(language, score) of each text by plain loops over its n-grams, learned from rows (id, text, language)."""

    def grams(text):
        data = b" " + b" ".join(re.sub(rb"[^A-Za-z\x80-\xff]", b" ", text.lower().encode()).split()) + b" "
        for n in (2, 3, 4):
            for at in range(len(data) - n + 1):
                h = n
                for byte in data[at : at + n]:
                    h = (h ^ byte) * 0x01000193 % 2**32
                yield (h * 0x9E3779B1 % 2**32) >> 17

    learned = [(t, x) for i, t, x in rows if i is not None and x is not None and zlib.crc32(str(i).encode()) % 5]
    counts = {x: Counter() for _, x in learned}
    for t, x in learned:
        counts[x].update(grams(t or ""))
    langs = sorted(x for x in counts if counts[x])
    code = langid.codewords(len(langs))
    rate = [[(counts[x][g] + 0.5) / (counts[x].total() + 0.5 * bins) for g in range(bins)] for x in langs]

    def margins(text):
        seen = Counter(grams(text))
        out = []
        for b in range(code.shape[1]):
            yes, no = ([r for r, c in zip(rate, code[:, b]) if (c > 0) == side] for side in (True, False))
            weight = {g: math.log(sum(r[g] for r in yes) / len(yes)) - math.log(sum(r[g] for r in no) / len(no)) for g in seen}
            out.append(sum(n * weight[g] for g, n in seen.items()) / max(seen.total(), 1) * 8.0)
        return out

    good, n = [[0] * code.shape[1] for _ in langs], [0] * len(langs)
    for t, x in learned:
        if t:
            k = langs.index(x)
            n[k] += 1
            for b, m in enumerate(margins(t)):
                good[k][b] += m * code[k][b] > 0
    trust = [[(g + 1) / (n[k] + 2) for g in good[k]] for k in range(len(langs))]
    trust = [[x / sum(row) for x in row] for row in trust]
    out = []
    for _, text, _ in rows:
        if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
            out.append(("und", 0.0))
            continue
        m = margins(text)
        loss = [sum(trust[k][b] * math.log1p(math.exp(-code[k][b] * m[b])) for b in range(code.shape[1])) for k in range(len(langs))]
        p = [math.exp(-(x - min(loss)) * code.shape[1]) for x in loss]
        out.append((langs[p.index(max(p))], max(p) / sum(p)))
    return out


def test_language_id_against_a_plain_version(spark):
    rng = random.Random(3)
    said = {"en": "the cat sat on the mat and it was good", "de": "der hund liegt auf dem boden und schläft", "fr": "le chat est sur la table où il dort", "es": "el niño está en la casa del árbol"}
    rows = [(i, " ".join(rng.choices(said[x].split(), k=rng.randint(1, 12))), x if rng.random() < 0.8 else None) for i in range(60) for x in [rng.choice(list(said))]]
    rows += [(100, None, "en"), (101, "½ ² ① Ⅷ _", None), (102, "", "fr"), (None, "le chat", "fr"), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(((str(r.doc_id), r.lang_pred, r.score) for r in langid.language_id(docs).collect()), key=lambda x: x[:2])
    want = sorted(((str(i), *w) for (i, _, _), w in zip(rows, plain_language_id(rows))), key=lambda x: x[:2])
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_codewords_keep_apart():
    for k in (2, 3, 6, 7, 20):
        code = langid.codewords(k)
        assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= (1 if k < 4 else 2)


def test_warc_round_trip(spark):
    big, other = "<p>é</p>" * 300, "<b>x</b>" * 200_000
    rows = [(1, "http://a/é\r\nX: y", big), (2, None, big), (3, "http://c", other), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "")]
    rows += [(2, None, big), (None, "n", "<i>alone</i>" * 99), (None, "n", "<i>alone</i>" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    index = warc.write_bundles(pages)
    assert index.count() == len(rows)
    got = warc.read_bundles(index).collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    size = len(big.encode())
    assert kinds == Counter(
        [(1, "revisit", 2, size), (2, "revisit", 2, size), (2, "response", None, size), (3, "response", None, len(other)), (4, "response", None, 5), (5, "response", None, 5)]
        + [(6, "response", None, 0), (7, "response", None, 0), (None, "response", None, 99 * 12), (None, "revisit", None, 99 * 12)]
    )
    for r in index.collect():
        headers, _ = warc.read_record(r.bundle, r.frame_at, r.frame_bytes, r.offset)
        assert headers["WARC-Record-ID"] == f"<urn:uuid:{r.record_id}>"
    assert warc.read_bundles(warc.write_bundles(pages.limit(0))).count() == 0


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_warc_one_response_a_payload(spark, monkeypatch, broadcast):
    """Rows that share id and payload, or the whole row, give one response, by broadcast and beyond it; extra columns are left alone."""
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", broadcast)
    long = ["x" * 1000, "y" * 1500, "z" * 2000]
    rows = [(5, f"u{i % 3}", long[0], 1) for i in range(9)] + [(i, "v", long[1], 2) for i in range(2500)] + [(None, None, long[2], 3)] * 4 + [(7, "w", None, 4), (7, "w", "", 5), (8, "w", "k" * 999, 6), (9, "w", "k" * 999, 7), (3, "o", "q" * 1200, 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes long").repartition(7)
    got = warc.read_bundles(warc.write_bundles(pages)).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        per.setdefault(r.payload_digest, []).append(r)
    for text, first in zip(long, (5, 2499, None)):
        mine = per[hashlib.sha1(text.encode()).hexdigest()]
        kept = [r for r in mine if r.record_type == "response"]
        assert len(kept) == 1 and kept[0].page_id == first
        assert all(r.refers_to == first and r.payload_bytes == len(text) for r in mine if r.record_type == "revisit")
    assert sum(r.record_type == "response" for r in got) == 3 + 5
