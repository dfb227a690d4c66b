"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit of the code, a binary classifier over hashed n-grams of
the UTF-8 bytes says whether the text's language has that bit: its weight for an n-gram is the log
ratio of the n-gram's rates in the languages with and without the bit, its margin their mean over the
text. Decoding sums the logistic loss of the margins against each codeword, weighted by how often the
bit was right for that language on the training rows, and takes the codeword of least loss. Texts
whose two best codewords are about as near are flagged as ambiguous.

The classifier is fitted on at most about ``max_rows`` labelled rows, chosen by a hash of id and text
(copies of a row are chosen together); the default bounds what is counted to some 100 MB of usual texts and the model to a few MB for dozens of
languages. Every row is predicted, over its whole text.

Defined cases: null texts and texts without letters (number signs are none) are ``und`` with score 0; null languages are not
learned; rows with a null id are not learned and not held out; without any labelled row all is
``und``; with a single language all texts with letters are that language; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

BINS = 1 << 15
GRAMS = (2, 3, 4)
MAX_ROWS = 20_000
#: Below this share of the decoding's probability, the nearest codeword is ambiguous.
AMBIGUOUS = 0.5
_SHARPNESS = 8.0
_BLOCK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in range(256))


def held_out(id_col: str) -> Column:
    """True for the fifth of the ids that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams over the whole text, in blocks."""
    counts = np.zeros(BINS, np.int64)
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split()) + b" "
    for at in range(0, len(data), _BLOCK):
        a = np.frombuffer(data, np.uint8, min(_BLOCK + max(GRAMS) - 1, len(data) - at), at).astype(np.uint32)
        for n in GRAMS:
            stop = min(_BLOCK, len(a) - n + 1)
            if stop > 0:
                h = np.full(stop, n, np.uint32)
                for k in range(n):
                    h = (h ^ a[k : k + stop]) * np.uint32(0x01000193)
                counts += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(17), minlength=BINS)
    return counts


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                sums[lang] = sums.get(lang, 0) + gram_counts(text)
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bin", "n"])


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1: all ways to part up to 6 languages; for more, random ones that keep apart."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 6:
        return np.array([[1 if j == 0 or (b >> (j - 1)) & 1 else -1 for b in range((1 << (k - 1)) - 1)] for j in range(k)], float)
    draws, best = np.random.default_rng(9), (-1, None)
    for _ in range(200):
        code = draws.choice([-1.0, 1.0], size=(k, int(10 * np.ceil(np.log2(k)))))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        apart = min((code[i] != code[j]).sum() for i, j in combinations(range(k), 2)) if k <= 64 else (code @ code.T - 1e9 * np.eye(k)).max() * -1
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


class Model:
    """Languages, their codewords, the n-gram weights of each bit and the trust in each language's bits."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        rates = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BINS)
        bits = self.code.shape[1]
        self.weights = np.zeros((BINS, bits))
        for b in range(bits):
            yes = self.code[:, b] > 0
            self.weights[:, b] = np.log(rates[yes].mean(axis=0)) - np.log(rates[~yes].mean(axis=0))
        self.trust = np.full(self.code.shape, 1 / max(bits, 1))

    def margins(self, text: str) -> np.ndarray:
        counts = gram_counts(text)
        at = np.flatnonzero(counts)
        return counts[at] @ self.weights[at] / max(counts.sum(), 1) * _SHARPNESS

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = (self.trust * np.logaddexp(0, -self.code * self.margins(text))).sum(axis=1)
        p = np.exp(-(loss - loss.min()) * self.code.shape[1])
        best = int(p.argmax())
        score = float(p[best] / p.sum())
        return self.langs[best], score, score < AMBIGUOUS


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Learns from labelled rows that are not held out."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    n = labelled.count()
    share = min(1.0, max_rows / max(n, 1))
    hashed = F.xxhash64(F.lit(23).cast("long"), F.col(id_col).cast("string"), F.col(text_col))
    picked = F.shiftrightunsigned(hashed, 11) < math.ceil(share * (1 << 53))
    rows = labelled.filter(picked).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BINS))
    counts[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), found["bin"].to_numpy(int)] = found["n"].to_numpy(float)
    model = Model(langs, counts)
    if len(langs) > 1:
        model.trust = _trust(rows, model)
    return model


def _trust(rows: DataFrame, model: Model) -> np.ndarray:
    """How often each bit is right for each language, so that a language's bits add up to 1."""

    def right(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {x: i for i, x in enumerate(model.langs)}
        good, seen = np.zeros(model.code.shape), np.zeros(len(at))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    good[at[lang]] += model.margins(text) * model.code[at[lang]] > 0
                    seen[at[lang]] += 1
        i, b = np.indices(good.shape)
        columns = [i.ravel(), b.ravel(), good.ravel(), np.repeat(seen, good.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["i", "b", "good", "seen"])

    found = rows.mapInArrow(right, "i long, b long, good long, seen long").groupBy("i", "b").agg(F.sum("good").alias("good"), F.sum("seen").alias("seen")).toPandas()
    trust = np.zeros(model.code.shape)
    trust[found["i"], found["b"]] = (found["good"] + 1) / (found["seen"] + 2)
    return trust / trust.sum(axis=1, keepdims=True)


def _predictor(model: Model, carry: int) -> Callable:
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.decode(x.as_py()) for x in batch.column(carry)]
            lang, score, doubt = zip(*found) if found else ((), (), ())
            kept = [batch.column(i) for i in range(carry)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())],
                names=[*batch.schema.names[:carry], "lang_pred", "score", "ambiguous"],
            )

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) for each row; only the text is looked at."""
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__llm_text"))
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return rows.mapInArrow(_predictor(model, 2), T.StructType([*rows.schema.fields[:2], *new]))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> DataFrame:
    return identify(docs, fit(docs, id_col, text_col, lang_col, max_rows), id_col, text_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> DataFrame:
    """docs without the rows whose language is undetermined or ambiguous."""
    model = fit(docs, id_col, text_col, lang_col, max_rows)
    verdict = F.pandas_udf(lambda texts: texts.map(lambda x: not model.decode(x)[2]).astype(bool), "boolean")
    return docs.filter(verdict(F.col(text_col)))
