"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units that no piece crosses (a run of spaces with the letters, digit or signs that
follow). Each task numbers the different units of a chunk of documents, and writes the documents as
numbers and the units packed by hash bucket, so that texts are read and cut once. The different units
of a bucket are then encoded once:

* the lattice: every unit is exploded into its substrings of bounded length, these are equi-joined
  with the piece table, and the edges are grouped by unit;
* the fold: Viterbi, by Spark's higher-order ``aggregate`` over the places of a unit. For unigram
  models a path's score is the sum of its pieces' scores. For BPE models it is the number of
  neighbours on the path that BPE would have merged otherwise, which only the BPE segmentation keeps
  at zero, for every prefix of the unit: so the best edge into a place is the one that agrees with the
  best path into its start.

Whether two neighbours agree is read from the ranks. A piece's own merges give its halves next to the
boundary, each with the rank at which it is made and at which it is merged away; the neighbours
disagree if some piece across the boundary joins two such halves while both are there.

The ids go back to the chunks by bucket, and each chunk is put together from its own units only. So
what moves are the different units of each chunk, the numbered texts are written and read once, and no
task holds more than a chunk of documents or the units of a bucket.

Characters without a piece become byte pieces. Units of over ``LONGEST`` characters, for which the
fold's cost grows with the square, are encoded by the sentencepiece library in the task.

Defined cases: null and empty texts have no pieces; null ids and repeated rows keep a row each; other
columns are ignored; an empty table gives an empty result; a model without byte pieces in a row, with
pieces that cross units, or with a piece that its own merges do not reach raises ValueError. Decoding
gives the text back, but for the sign U+2581, which reads as a space.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import new_folder

SPACE = "▁"
UNIT = regex.compile(rf"{SPACE}*(?:[\p{{L}}\p{{M}}]+|\p{{Nd}}|[^\p{{L}}\p{{M}}\p{{Nd}}{SPACE}]+)|{SPACE}+")
_SPACED = re.compile(" *[^ ]+| +$").findall
#: A unit's places are held in ten bits.
LONGEST = 1000
CHUNK_BYTES = 12 << 20
_CLASS = regex.compile(r"([\p{L}\p{M}])|(\p{Nd})")
#: Later than any merge.
_NEVER = 1 << 30


def _class(c: str) -> str:
    m = _CLASS.match(c)
    return "space" if c == SPACE else "sign" if not m else "letter" if m[1] else "digit"


def _merged(piece: str, ranks: dict[str, int]) -> tuple | None:
    """The tree of a piece's own merges, as (start, end, rank, left, right), or None where they do not end in it."""
    parts: list[tuple] = [(i, i + 1, 0, None, None) for i in range(len(piece))]
    while len(parts) > 1:
        pairs = [(ranks[w], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (w := piece[a[0] : b[1]]) in ranks]
        if not pairs:
            return None
        rank, k = min(pairs)
        a, b = parts[k : k + 2]
        parts[k : k + 2] = [(a[0], b[1], max(rank, a[2], b[2]), a, b)]
    return parts[0]


def _halves(tree: tuple, side: int) -> list[int | None]:
    """By length less one: the ranks at which a prefix (side 3) or suffix (side 4) of a piece is made and merged away, in 32 bits each."""
    out: list[int | None] = [None] * (tree[1] - tree[0])
    gone = _NEVER
    while tree:
        out[tree[1] - tree[0] - 1] = tree[2] << 32 | gone
        gone, tree = tree[2], tree[side]
    return out


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        m = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        found = [(m.id_to_piece(i), i, float(m.get_score(i))) for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        #: Best first; a piece's rank is the place of its score among the different ones.
        self.normal = sorted(found, key=lambda x: (-x[2], x[1]))
        place = {x: i for i, x in enumerate(sorted({x for _, _, x in found}, reverse=True))}
        self.ranks = {p: place[x] for p, _, x in self.normal}
        self.longest = max(len(p) for p, _, _ in self.normal)
        self.first_byte = m.piece_to_id("<0x00>")
        self.kept = "<u2" if n <= 1 << 16 else "<u4"
        if [m.id_to_piece(self.first_byte + b) for b in range(256)] != [f"<0x{b:02X}>" for b in range(256)]:
            raise ValueError("the model has no byte pieces in a row")
        for p, _, _ in self.normal:
            for a, b in zip(p, p[1:]):
                if (_class(a) != _class(b) or _class(b) == "digit") and a != SPACE:
                    raise ValueError(f"the piece {p!r} crosses units")
        table = [bytes([i - self.first_byte]) if m.is_byte(i) else b"" if m.is_control(i) else m.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.joined = pa.array(table, pa.large_binary())

    def long_unit(self, unit: str) -> list[int]:
        """By the library. A line feed ends the prefix that the library adds, and is cut off with it."""
        return self.model.encode("\n" + unit.replace(SPACE, " "))[2:]

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, no, rank) of the pieces of two and more characters, and the empty one as -1."""
        return spark.createDataFrame([("", -1, 0), *((p, i, self.ranks[p]) for i, (p, _, _) in enumerate(self.normal) if len(p) > 1)], "piece string, no int, rank int")

    def known(self, spark: SparkSession, kind: str) -> Column:
        """A struct of what the fold looks up, by a piece's number or a character's code point; read from one row, which plans do not print."""
        chars = {ord(p): (i, x) for p, i, x in self.normal if len(p) == 1}
        points = range(max(chars, default=0) + 1)
        told = {"piece_ids": [i for _, i, _ in self.normal], "char_ids": [chars[c][0] if c in chars else None for c in points]}
        kinds = {"piece_ids": pa.int32(), "char_ids": pa.int32()}
        if kind == "bpe":
            trees = [_merged(p, self.ranks) for p, _, _ in self.normal]
            if None in trees:
                raise ValueError(f"its own merges do not reach the piece {self.normal[trees.index(None)][0]!r}")
            told |= {name: [[_NEVER], *(_halves(t, side) for t in trees)] for name, side in (("lefts", 3), ("rights", 4))}
            kinds |= dict.fromkeys(("lefts", "rights"), pa.list_(pa.int64()))
        else:
            told |= {"scores": [x for _, _, x in self.normal], "char_scores": [chars[c][1] if c in chars else None for c in points]}
            kinds |= dict.fromkeys(("scores", "char_scores"), pa.float64())
        row = spark.createDataFrame(pa.table({k: pa.array([v], pa.list_(kinds[k])) for k, v in told.items()}))
        return row.select(F.struct(*told)).scalar()


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def words(text: str) -> list[str]:
    """text cut at spaces, each word without the first of the spaces before it."""
    if not text:
        return []
    found = (text.replace(SPACE, " ") if SPACE in text else text).split(" ")
    return [w[1:] for w in _SPACED(" " + " ".join(found))] if "" in found else found


def units(word: str) -> list[str]:
    """The units of a word. One of letters only is one."""
    return UNIT.findall(SPACE + word.replace(" ", SPACE))


def _words(texts: list[str]) -> pa.ListArray:
    """The words of each text. Those without runs of spaces are cut by Arrow."""
    plain = [t != "" and " " not in (t[0], t[-1]) and "  " not in t and SPACE not in t for t in texts]
    cut = pc.split_pattern(pa.array([t for t, x in zip(texts, plain) if x], pa.string()), " ")
    other = pa.array([words(t) for t, x in zip(texts, plain) if not x], pa.list_(pa.string()))
    at, place = [0, len(cut)], []
    for x in plain:
        place.append(at[not x])
        at[not x] += 1
    return pa.concat_arrays([cut, other]).take(pa.array(place, pa.int64()))


_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "\n\r\t"


def _cut(vocabulary: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(numbers of the units of each word, one word after the other; how many each has; the different units).

    Words of letters, also with ASCII signs after them, are cut by Arrow.
    """
    core = pc.ascii_rtrim(vocabulary, characters=_SIGNS)
    simple = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False)
    size = pc.binary_length(core).to_numpy()
    signed = simple & (size < pc.binary_length(vocabulary).to_numpy())
    lists = [units(w) for w in vocabulary.filter(pa.array(~simple)).to_pylist()]
    n = 1 + signed.astype(np.int32)
    n[~simple] = [len(x) for x in lists]
    heads = pc.binary_join_element_wise(pa.scalar(SPACE), core.filter(pa.array(simple)), "")
    tails = pa.array([w[k:] for w, k in zip(vocabulary.filter(pa.array(signed)).cast(pa.binary()).to_pylist(), size[signed].tolist())], pa.binary()).cast(pa.string())
    whole = pa.concat_arrays([heads, tails, pa.array([u for x in lists for u in x], pa.string())]).dictionary_encode()
    codes, numbers, first = whole.indices.to_numpy(), np.empty(n.sum(), np.int32), np.cumsum(n) - n
    numbers[first[simple]] = codes[: len(heads)]
    numbers[first[signed] + 1] = codes[len(heads) : len(heads) + len(tails)]
    numbers[np.repeat(~simple, n)] = codes[len(heads) + len(tails) :]
    return numbers, n, whole.dictionary


def lattice(units_: DataFrame, table: DataFrame, longest: int, partitions: int = 8) -> DataFrame:
    """(id, bucket, unit, edges): for each row of (id, bucket, unit), the pieces of two and more characters within it.

    An edge is one long: ten bits each of end and start, twenty each of the piece's rank and number; so
    that edges are grouped as numbers, and sorted as such are in order of their ends. ``table`` has piece, no and rank, and the
    empty piece, which keeps units that have no other. Ids are unique.
    """
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("unit") - 2, F.lit(0))))
    first = F.when(F.col("start") == 0, 0).otherwise(F.col("start") + 2)
    ends = F.explode(F.sequence(first, F.least(F.col("start") + longest, F.length("unit"))))
    parts = units_.repartition(partitions, "id").withColumn("start", starts).withColumn("end", ends)
    parts = parts.withColumn("piece", F.substr("unit", F.col("start") + 1, F.col("end") - F.col("start")))
    edge = F.expr("shiftleft(cast(end as bigint), 50) | shiftleft(cast(start as bigint), 40) | shiftleft(cast(rank as bigint), 20) | no")
    # The equi-join is on a hash, as one number; the pieces themselves are compared where it meets.
    hashed = table.select(F.xxhash64("piece").alias("key"), F.col("piece").alias("own"), "no", "rank")
    met = parts.withColumn("key", F.xxhash64("piece")).join(F.broadcast(hashed), "key").filter(F.contains("own", F.col("piece")) & (F.length("own") == F.length("piece")))
    found = met.groupBy("id").agg(F.first("bucket").alias("bucket"), F.first("unit").alias("unit"), F.collect_list(F.when(F.col("no") >= 0, edge)).alias("edges"))
    return found


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _char_ids(first_byte: int) -> str:
    """SQL of the ids of the character that ends at ``at``: its piece, or its bytes."""
    char = "substring(unit, at, 1)"
    raw = f"transform(sequence(1, octet_length({char})), k -> {first_byte} + cast(conv(substring(hex(encode({char}, 'UTF-8')), 2 * k - 1, 2), 16, 10) as int))"
    return _let("i", f"get(known.char_ids, ascii({char}))", f"if(i is null, {raw}, array(i))")


#: Where an edge has its start.
_STARTS = 1023 << 40


def _start(edge: str) -> str:
    return f"cast(shiftright({edge}, 40) & 1023 as int)"


def _disagree() -> str:
    """SQL: whether the piece of an edge c across the start of e joins the halves a and b of the neighbours there while both are there.

    Of equal ranks the left one is merged first.
    """
    a = f"get(get(rights, shiftright(t.before, 10)), t.s - {_start('c')} - 1)"
    b = "get(get(lefts, cast(e & 1048575 as int) + 1), cast(shiftright(c, 50) as int) - t.s - 1)"
    return _let("b", b, f"b is not null and {_let('a', a, _joined('a', 'b'))}")


def _joined(a: str, b: str) -> str:
    made = f"greatest(shiftright(c, 20) & 1048575, shiftright({a}, 32), shiftright({b}, 32))"
    return f"coalesce({made} < ({a} & 4294967295) and {made} <= ({b} & 4294967295), false)"


#: The last piece of the best path into a place: its number plus one and its start, or zero for the character before.
_STEP = f"cast(shiftleft((e & 1048575) + 1, 10) as int) | {_start('e')}"


def _bpe_steps() -> str:
    """SQL of the last pieces by place. Of the edges into a place one, or the character, agrees with the path into its start."""
    s = _start("e")
    seen = f"struct({s} as s, coalesce(get(best, {s}), 0) as before, e & {_STARTS} as at, shiftleft((shiftright(e, 40) & 1023) + 1, 50) as low, shiftleft(shiftright(e, 50) + 1, 50) as high)"
    begin = "shiftleft(cast(if(t.before = 0, t.s - 1, t.before & 1023) as bigint), 40)"
    across = f"c >= t.low and c < t.high and (c & {_STARTS}) < t.at and (c & {_STARTS}) >= begin"
    clash = _let("t", seen, f"t.s > 0 and {_let('begin', begin, f'exists(edges, c -> {across} and {_disagree()})')}")
    return f"""aggregate(edges, array(0), (best, e) -> if(shiftright(e, 50) < size(best) or {clash}, best,
        concat(best, array_repeat(0, cast(shiftright(e, 50) as int) - size(best)), array({_STEP}))))"""


def _unigram_steps(unknown: float) -> str:
    """SQL of the last pieces by place: those of the greatest sum of scores."""
    char = f"coalesce(get(known.char_scores, ascii(substring(unit, at, 1))), {unknown}D)"
    step = f"""array_max(concat(array(struct(best[at - 1].score + {char} as score, 0 as step)),
        transform(filter(edges, e -> shiftright(e, 50) = at), e -> struct(best[{_start('e')}].score + get(known.scores, cast(e & 1048575 as int)) as score, {_STEP} as step))))"""
    return f"transform(aggregate(sequence(1, length(unit)), array(struct(0D as score, 0 as step)), (best, at) -> concat(best, array({step}))), b -> b.step)"


def viterbi_fold(first_byte: int, kind: str = "bpe", unknown: float = -100.0) -> Column:
    """The ids of a unit's best path: its last pieces by place, folded over the edges or places, and read back from the end.

    In unigram models characters without a piece cost ``unknown``.
    """
    ids = f"""aggregate(sequence(length(unit), 1, -1), struct(length(unit) as left, cast(array() as array<int>) as ids), (path, at) -> if(at > path.left, path,
        if(coalesce(get(steps, at), 0) = 0, struct(at - 1 as left, concat({_char_ids(first_byte)}, path.ids) as ids),
            struct(get(steps, at) & 1023 as left, concat(array(get(known.piece_ids, shiftright(get(steps, at), 10) - 1)), path.ids) as ids)))).ids"""
    path = _let("edges", "sort_array(edges)", _let("steps", _bpe_steps() if kind == "bpe" else _unigram_steps(unknown), ids))
    if kind == "bpe":
        path = _let("rights", "known.rights", _let("lefts", "known.lefts", path))
    return F.expr(_let("known", "known", path))  # named once, so that its large arrays are not copied into each row


def encode_units(units_: DataFrame, model: Pieces, kind: str = "bpe", partitions: int = 8) -> DataFrame:
    """(bucket, unit, ids) for a table (id, bucket, unit) of different units that are not empty."""
    spark = units_.sparkSession
    edges = lattice(units_, model.table(spark), model.longest, partitions)
    # The filter, which all rows pass, parts the grouping from the projection that reads the constants: merged with the grouping, it would copy them into each row.
    edges = edges.filter(F.col("unit").isNotNull()).withColumn("known", model.known(spark, kind))
    return edges.select("bucket", "unit", viterbi_fold(model.first_byte, kind).alias("ids"))


def _open(address: str, write: bool = False) -> pa.NativeFile:
    """A file of the shared folder."""
    store, path = fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)
    if not write:
        return store.open_input_file(path)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def _pack(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_units(some: list[str]) -> bytes:
    """Units, after a list of the places of those with a zero character, as which the others are parted."""
    odd = [i for i, u in enumerate(some) if "\0" in u]
    return _pack("\0".join([*(u.encode().hex() if "\0" in u else u for u in some), ",".join(map(str, odd))]).encode())


def _unpack_units(data: bytes) -> list[str]:
    *some, odd = _unpack(data).decode().split("\0")
    for i in odd.split(",") if odd else ():
        some[int(i)] = bytes.fromhex(some[int(i)]).decode()
    return some


def _chunks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a task's documents, in chunks of about size bytes."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            ids.append(i)
            texts.append(data.decode("utf-8", "replace"))
            held += len(data)
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _ints(values: Iterable[int]) -> pa.Array:
    """Numbers as their first bytes, then their second ones and so on, which packs better."""
    return pa.array([np.asarray(values, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary())


def _ints_of(data: pa.Buffer) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


DEALT = "chunk string, bucket int, units binary"


def _deal(id_type: pa.DataType, buckets: int, size: int, folder: str) -> Callable:
    """For each chunk its different units by bucket, after a row of bucket -1.

    Its documents, as numbers, go to a file of the task, under a name of its own; a chunk's name is its
    place there, so that only files of successful tasks are ever read. Units are numbered by bucket and, within it, in order, those for the library last; words list the
    numbers of their units, documents those of their words.
    """

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, file, at = None, uuid.uuid4().hex, 0
        for ids, texts in _chunks(batches, size):
            lists = _words(texts)
            coded = lists.flatten().dictionary_encode()
            cut, n_units, unit = _cut(coded.dictionary)
            bucket = np.fromiter(map(zlib.crc32, unit.cast(pa.binary()).to_pylist()), np.uint32, len(unit)) % np.uint32(buckets)
            bucket[pc.utf8_length(unit).to_numpy() > LONGEST] = buckets
            order = pc.sort_indices(unit).to_numpy().astype(np.int64)
            order = order[np.argsort(bucket[order], kind="stable")]
            place = np.empty(len(unit), np.int32)
            place[order] = np.arange(len(unit), dtype=np.int32)
            some, sizes = unit.take(pa.array(order)).to_pylist(), np.bincount(bucket, minlength=buckets + 1).tolist()
            ends = np.cumsum(sizes).tolist()
            by = {b: some[e - n : e] for b, (e, n) in enumerate(zip(ends, sizes)) if n}
            long = by.pop(buckets, [])
            docs = {
                "ids": pa.array([[i.as_py() for i in ids]], pa.list_(id_type)), "ends": _ints(lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()), "words": _ints(coded.indices.to_numpy()), "cut": _ints(place[cut]),
                "n_units": _ints(n_units), "buckets": _ints(list(by)), "sizes": _ints(list(map(len, by.values()))), "long": pa.array([long], pa.list_(pa.string())),
            }
            table = pa.table(docs)
            with (sink := pa.BufferOutputStream()), pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            packed = _pack(sink.getvalue().to_pybytes())
            out = out or _open(f"{folder}/{file}", True)
            out.write(packed)
            k = len(by)
            columns = [[f"{file}:{at}:{len(packed)}"] * (k + 1), [-1, *by], [None, *map(_pack_units, by.values())]]
            kinds, at = (pa.string(), pa.int32(), pa.binary()), at + len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in DEALT.split(", ")])
            del lists, coded, unit, some, by, docs, table, columns
            pa.default_memory_pool().release_unused()
        if out:
            out.close()

    return deal


def _different(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bucket, unit): the different units of each bucket, from rows sorted by bucket."""
    now, seen = None, set()

    def out() -> pa.RecordBatch:
        some = sorted(seen)
        at = np.arange(len(some), dtype=np.int64) + (now << 32)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array([now] * len(some), pa.int32()), pa.array(some, pa.string())], names=["id", "bucket", "unit"])

    for batch in batches:
        for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if bucket != now and seen:
                yield out()
                seen = set()
            now = bucket
            seen.update(_unpack_units(packed))
    if seen:
        yield out()


def _answer(kept: str) -> Callable:
    """Rows sorted by bucket, first its (unit, ids), then the chunks' packed units: for each of these the number of ids of every unit, and all ids."""

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        width = np.dtype(kept).itemsize
        for batch in batches:
            rows = []
            lists = batch.column(4)
            data, ends = lists.values.to_numpy(zero_copy_only=False).astype(kept).tobytes(), lists.offsets.to_pylist()
            for k, (bucket, chunk, packed, unit) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                if bucket != now:
                    now, known = bucket, {}
                if chunk is None:
                    known[unit] = data[width * ends[k] : width * ends[k + 1]]
                else:
                    found = [known[u] for u in _unpack_units(packed)]
                    sizes = np.fromiter(map(len, found), "<u2", len(found)) // np.uint16(width)
                    rows.append((chunk, bucket, _pack(sizes.tobytes() + b"".join(found))))
            if rows:
                kinds = (pa.string(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["chunk", "bucket", "packed"])

    return answer


def _spread(first: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the items of the lists ``which`` stand, one list after the other, and where each list ends among them."""
    n = size[which]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[which] - (ends - n), n), ends


class _Chunk:
    """The documents of a chunk as numbers, and the ids of its units as these come in by bucket."""

    def __init__(self, packed: bytes, model: Pieces):
        table = pa.ipc.open_stream(_unpack(packed)).read_all().combine_chunks()
        self.model, self.ids = model, table.column("ids").combine_chunks().flatten()
        self.ends, self.words, self.cut, self.n_units, buckets, sizes = (_ints_of(table.column(c)[0].as_buffer()) for c in ("ends", "words", "cut", "n_units", "buckets", "sizes"))
        self.left = list(zip(buckets.tolist(), sizes.tolist()))[::-1]
        self.long = table.column("long")[0].as_py()
        self.sizes: list[np.ndarray] = []
        self.flat: list[np.ndarray] = []

    def learn(self, bucket: int, answer: bytes) -> None:
        due, n = self.left.pop()
        if due != bucket:
            raise ValueError(f"an answer is missing: bucket {due} of a chunk")
        self.sizes.append(np.frombuffer(answer, "<u2", n).astype(np.int64))
        self.flat.append(np.frombuffer(answer[2 * n :], self.model.kept))

    def finish(self, decoded: bool) -> Iterator[pa.RecordBatch]:
        if self.left:
            raise ValueError(f"an answer is missing: bucket {self.left[-1][0]} of a chunk")
        for ids in map(self.model.long_unit, self.long):
            self.sizes.append(np.array([len(ids)]))
            self.flat.append(np.array(ids, self.model.kept))
        size, flat = (np.concatenate([np.empty(0, k), *x]).astype(k) for x, k in ((self.sizes, np.int64), (self.flat, np.int32)))
        take, _ = _spread(np.cumsum(size) - size, size, self.cut)  # from ids by unit to ids by word
        by_word = np.add.reduceat(np.r_[size[self.cut], 0], np.cumsum(self.n_units) - self.n_units) if len(self.n_units) else np.empty(0, np.int64)
        flat = flat[take]
        first, starts = np.cumsum(by_word) - by_word, np.r_[0, self.ends]
        for at in range(0, len(self.ids), 64):
            some = starts[at : at + 65]
            take, ends = _spread(first, by_word, self.words[some[0] : some[-1]])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends][some - some[0]], pa.int32()), pa.array(flat[take]))
            columns = [self.ids.slice(at, len(some) - 1), lists, *([pa.array(_texts(lists, self.model), pa.string())] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["__llm_id", "pieces", "decoded"][: len(columns)])


def _texts(lists: pa.Array, model: Pieces) -> list[str | None]:
    """The texts that lists of ids decode to."""
    table, texts = model.joined, []
    for at in range(0, len(lists), 256):
        some = lists.slice(at, 256)
        found = table.take(some.flatten())
        data, ends = found.buffers()[2], np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)
        bounds = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(some), 0).to_numpy())]
        for a, b, valid in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist(), some.is_valid().to_pylist()):
            raw = data[a:b].to_pybytes() if b > a else b""
            texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace") if valid else None)
    return texts


def _assemble(path: str, folder: str, decoded: bool) -> Callable:
    """Rows sorted by chunk, first that of bucket -1, then the ids of its units by bucket: the ids of its texts."""

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for chunk, bucket, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now:
                    if held:
                        yield from held.finish(decoded)
                    now, held = chunk, None
                    pa.default_memory_pool().release_unused()
                if bucket < 0:
                    file, at, size = chunk.split(":")
                    with _open(f"{folder}/{file}") as docs:
                        docs.seek(int(at))
                        held = _Chunk(docs.read(int(size)), pieces(path))
                else:
                    held.learn(bucket, _unpack(packed))
        if held:
            yield from held.finish(decoded)

    return put


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe", buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES, decoded: bool = False) -> DataFrame:
    """(id, pieces array<int>) for each row of docs; with decoded also what the ids decode to, by the task that put them together."""
    spark, model = docs.sparkSession, pieces(path)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("__llm_id"), F.col(text_col).cast("binary").alias("__llm_text"))
    folder = new_folder(spark, "lattice")
    rows.mapInArrow(_deal(to_arrow_type(spark_type), buckets, chunk_bytes, f"{folder}/docs"), DEALT).write.option("compression", "uncompressed").parquet(f"{folder}/dealt")  # packed already
    # A session of its own: its shuffles go once what they serve is written.
    own = spark.newSession()
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    own.conf.set("spark.sql.shuffle.partitions", str(buckets))
    asked = own.read.schema(DEALT).parquet(f"{folder}/dealt").filter("bucket >= 0").select("chunk", "bucket", "units")
    different = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_different, "id long, bucket int, unit string")
    encode_units(different, model, kind, buckets).write.option("compression", "zstd").parquet(f"{folder}/told")
    told = own.read.schema("bucket int, unit string, ids array<int>").parquet(f"{folder}/told").select("bucket", F.lit(None).cast("string").alias("chunk"), F.lit(None).cast("binary").alias("units"), "unit", "ids")
    both = told.unionByName(asked, allowMissingColumns=True).repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
    both.mapInArrow(_answer(model.kept), "chunk string, bucket int, packed binary").write.option("compression", "uncompressed").parquet(f"{folder}/answers")
    texts = spark.read.schema(DEALT).parquet(f"{folder}/dealt").filter("bucket < 0").select("chunk", "bucket", F.col("units").alias("packed"))
    known = spark.read.schema("chunk string, bucket int, packed binary").parquet(f"{folder}/answers")
    by_chunk = texts.unionByName(known).repartition("chunk").sortWithinPartitions("chunk", "bucket")
    schema = T.StructType([T.StructField("__llm_id", spark_type), T.StructField("pieces", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decoded else [])])
    return by_chunk.mapInArrow(_assemble(path, f"{folder}/docs", decoded), schema).withColumnRenamed("__llm_id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "pieces", name: str = "decoded") -> DataFrame:
    """(id, pieces, text of the pieces)."""

    def texts(lists: pa.Array) -> pa.Array:
        return pa.array(_texts(lists, pieces(path)), pa.string())

    return encoded.select(id_col, ids_col, F.arrow_udf(texts, T.StringType())(F.col(ids_col)).alias(name))
