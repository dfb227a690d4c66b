"""Token ids of documents in binary files of patched frame-of-reference blocks.

Documents are put in ascending order of their id by range, and each task writes one file. A file is

* the magic number,
* blocks of 4096 ids: minimum, width, counts, the differences from the minimum packed at the width
  that holds a given percentile of them, and the others as a list of positions and values,
* the index of block starts, the ids and lengths of its documents, and a footer with their places.

Any span of ids is read by unpacking only the blocks it touches. Files are written under names of
their own through the file system of the folder's address; only those reported by successful tasks
count.

A document's words are looked up in a bounded memory of words already encoded; unknown words are
lower-cased, cut where the tokenizer's own pattern cuts them and encoded by the library in long
batches, without normalising and cutting again; ids that end a word say where each part ends. Words with other than Latin letters, or with what may be a special token, go to the library
as they are, case included: it finds special tokens before it normalises, and composes before it
lower-cases.

Defined cases: null and empty texts have the end id only; null ids come first; rows that share an id
follow each other; very long texts are encoded in blocks of a megabyte; an empty table writes nothing.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, new_folder
from .simhash import word_blocks

MAGIC = b"TOKPFOR1"
BLOCK = 4096
PERCENTILE = 98
END_ID = 2
#: Words kept in memory by a worker, some 200 bytes each.
MEMORY_WORDS = 600_000
#: Documents up to so many bytes together learn their words at once; fewer words than MEMORY_WORDS fit in.
GROUP_BYTES = 1 << 20
_FOOT = struct.Struct("<QQQQQ8s")
_HEAD = struct.Struct("<IBHH")
_LATIN = re.compile(r"[\x21-\x7Eß-öø-ÿ]+")
#: Fixed value: where the tokenizer's pattern cuts a lower-case Latin word.
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Encoder:
    """Encodes words of a text to little-endian 32-bit ids, with a memory of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.of_parts = Tokenizer.from_file(path)  # for parts in lower case, cut and parted by blanks
        self.of_parts.normalizer = None
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a part, and stand nowhere else
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _single(self, words: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _learn_parts(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            ids = np.array(self.of_parts.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                cuts, data = [0, *(4 * stops).tolist()], ids.tobytes()
                self.parts.update((p, data[a:b]) for p, a, b in zip(some, cuts, cuts[1:]))
            else:
                self.parts.update(zip(some, self._single(some)))

    def _learn(self, words: set[bytes]) -> None:
        if len(self.parts) > MEMORY_WORDS:
            self.parts.clear()
        whole, pieces, other = {}, {}, {}  # words that are one part, those that are cut, those for the library
        listed = list(words)
        for w, s in zip(listed, b" ".join(listed).decode("utf-8", "replace").split(" ")):
            if s.isalpha() and (s.isascii() or _LATIN.fullmatch(s)):
                whole[w] = s.lower()
            elif "<|" not in s and _LATIN.fullmatch(s):
                pieces[w] = _CUT.findall(s.lower())
            else:
                other[w] = s
        self._learn_parts(list(set(whole.values()).union(*pieces.values()).difference(self.parts)))
        part = self.parts.__getitem__
        self.words.update(zip(whole, map(part, whole.values())))
        self.words.update((w, b"".join(map(part, p))) for w, p in pieces.items())
        self.words.update(zip(other, self._single(list(other.values()))))

    def encode(self, words: list[bytes]) -> bytes:
        """Ids of words that have been learned."""
        return b"".join(map(self.words.__getitem__, words))

    def learn(self, words: Iterable[bytes]) -> None:
        """Makes sure that all the words can be encoded; a block of a megabyte has fewer than the memory holds."""
        new = set(words).difference(self.words)
        if len(self.words) + len(new) > MEMORY_WORDS:
            self.words.clear()
            new = set(words)
        self._learn(new)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_text(data: bytes, of: Encoder) -> Iterator[bytes]:
    """Ids of a text in UTF-8, in pieces. Separators never join words in this kind of tokenizer."""
    for words in word_blocks(data):
        try:
            yield of.encode(words)
        except KeyError:
            of.learn(words)
            yield of.encode(words)


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bytes]]]:
    """Documents in lists of a megabyte of text at most; a longer one stands alone."""
    some, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            if some and size + len(data) > GROUP_BYTES:
                yield some
                some, size = [], 0
            some.append((doc_id, data))
            size += len(data)
    if some:
        yield some


def encode_group(some: list[tuple[int | None, bytes]], of: Encoder) -> Iterator[tuple[int | None, Iterable[bytes]]]:
    """(id, ids of its text in pieces) of documents whose new words are learned together."""
    if sum(len(data) for _, data in some) > GROUP_BYTES:
        yield from ((doc_id, encode_text(data, of)) for doc_id, data in some)
        return
    texts = [data.split() for _, data in some]
    of.learn(set().union(*texts))
    yield from ((doc_id, (of.encode(words),)) for (doc_id, _), words in zip(some, texts))


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = ids.astype("<u4") - np.uint32(low)
    bits = np.searchsorted(1 << np.arange(32, dtype=np.uint64), rest, side="right")
    width = int(np.searchsorted(np.cumsum(np.bincount(bits, minlength=33)), len(ids) * PERCENTILE / 100))
    out = np.flatnonzero(bits > width)
    patch = out.astype("<u2").tobytes() + rest[out].tobytes()
    rest[out] = 0
    packed = np.packbits(np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width], bitorder="little")
    return _HEAD.pack(low, width, len(ids), len(out)) + packed.tobytes() + patch


def unpack_block(data: memoryview | bytes) -> np.ndarray:
    low, width, n, n_out = _HEAD.unpack_from(data)
    size = (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, _HEAD.size), bitorder="little", count=n * width).reshape(n, width)
    ids = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    at = _HEAD.size + size
    ids[np.frombuffer(data, "<u2", n_out, at)] = np.frombuffer(data, np.uint8, 4 * n_out, at + 2 * n_out).copy().view("<u4")
    return ids + np.uint32(low)


def _store(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


class TokenFile:
    """Writes documents' ids one after the other."""

    def __init__(self, address: str):
        store, path = _store(address)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)
        self.out.write(MAGIC)
        self.at, self.starts, self.ids, self.lengths = len(MAGIC), [], [], []
        self.held, self.n_held = [], 0

    def _block(self, ids: np.ndarray) -> None:
        data = pack_block(ids)
        self.starts.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, pieces: Iterable[bytes]) -> None:
        n = 0
        for piece in pieces:
            n += len(piece) // 4
            self.held.append(piece)
            self.n_held += len(piece) // 4
            if self.n_held >= 64 * BLOCK:
                self._flush()
        self.ids.append(doc_id)
        self.lengths.append(n)

    def _flush(self, all_of_it: bool = False) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        stop = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for at in range(0, stop, BLOCK):
            self._block(ids[at : min(at + BLOCK, stop)])
        self.held, self.n_held = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> None:
        self._flush(all_of_it=True)
        null = np.packbits(np.array([i is None for i in self.ids], bool)).tobytes()
        tail = np.array(self.starts, "<u8").tobytes() + null + np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes()
        self.out.write(tail + _FOOT.pack(self.at, len(self.starts), len(self.ids), sum(self.lengths), BLOCK, MAGIC))
        self.out.close()


class TokenReader:
    """Reads a file's index, then any span of its ids."""

    def __init__(self, address: str):
        store, path = _store(address)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - _FOOT.size)
        self.end, n_blocks, n_docs, self.n_ids, self.block, magic = _FOOT.unpack(self.file.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{address} is no token file")
        self.file.seek(self.end)
        tail = self.file.read(size - _FOOT.size - self.end)
        n_null = (n_docs + 7) // 8
        self.starts = np.frombuffer(tail, "<u8", n_blocks)
        null = np.unpackbits(np.frombuffer(tail, np.uint8, n_null, 8 * n_blocks), count=n_docs).astype(bool)
        ids = np.frombuffer(tail[8 * n_blocks + n_null :], "<i8", n_docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist())]
        self.lengths = np.frombuffer(tail[8 * n_blocks + n_null + 8 * n_docs :], "<u8", n_docs).astype(np.int64)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from start on, block by block."""
        for b in range(start // self.block, -(-(start + n) // self.block)):
            stop = int(self.starts[b + 1]) if b + 1 < len(self.starts) else self.end
            self.file.seek(int(self.starts[b]))
            first = b * self.block
            yield unpack_block(self.file.read(stop - int(self.starts[b])))[max(start - first, 0) : start + n - first]

    def documents(self, blocks_at_once: int = 64) -> Iterator[tuple[int | None, int, int, int]]:
        """(id, start in the file, length, CRC-32 of the ids) of each document; each block is unpacked once or twice."""
        at = held_from = 0
        held = np.empty(0, "<u4")
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            crc, left, pos = 0, n, at
            while left:
                if pos >= held_from + len(held):
                    held_from = pos // self.block * self.block
                    size = min(blocks_at_once * self.block, self.n_ids - held_from)
                    held = np.concatenate(list(self.span(held_from, size)))
                some = held[pos - held_from : pos - held_from + left]
                crc = zlib.crc32(some.astype("<u4").tobytes(), crc)
                pos, left = pos + len(some), left - len(some)
            yield doc_id, at, n, crc
            at += n


def _writer(folder: str, tokenizer: str, end_id: int) -> Callable:
    end = struct.pack("<I", end_id)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, address, of = None, f"{folder}/{uuid.uuid4().hex}.tok", encoder(tokenizer)
        for some in _grouped(batches):
            made = made or TokenFile(address)
            for doc_id, pieces in encode_group(some, of):
                made.add(doc_id, (p for ps in (pieces, (end,)) for p in ps))
        if made:
            made.close()
            row = [[TaskContext.get().partitionId()], [address], [len(made.ids)], [sum(made.lengths)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "file", "docs", "ids"])

    return write


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the files; a row for each of them: (part, file, docs, ids, base), base counting the ids of all files before."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("__llm_id"), F.col(text_col).cast("binary").alias("__llm_text"))
    dealt = rows.repartitionByRange("__llm_id").sortWithinPartitions("__llm_id")
    files = checkpoint(dealt.mapInArrow(_writer(folder, tokenizer, end_id), "part int, file string, docs long, ids long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


def _reader(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(*(c.to_pylist() for c in batch.columns)):
            rows = [(i, base + at, n, crc) for i, at, n, crc in TokenReader(file).documents()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files by a task each."""
    return files.select("file", "base").repartition(max(1, files.count())).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
