"""WARC records in seekable Zstandard bundles.

Each task writes its records into one bundle: independent Zstandard frames of about a megabyte of
records, and after them, in a skippable frame, the seek table with the size of each frame. The index
maps every record to its bundle, frame and offset within the frame, so that one record is read by
decompressing one frame. Records whose payload repeats an earlier decided one are ``revisit`` records
without payload; their digest and length are kept.

Bundles are written through the file system of their address, under a name of their own that only
successful tasks report, so that repeated and lost tasks leave nothing that is read.

Defined cases: ids are integers (others must be numbered first); null payloads are empty; payloads under ``least`` bytes are all responses; of equal
longer payloads the row with the largest id is the response (null ids are smallest; of equal ids, one)
and the others revisit it; null URLs have no target header; empty tables write nothing.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import HOT_SHARE, checkpoint, join_counted, new_folder, written

LEAST = 1000
FRAME_BYTES = 1 << 20
#: Up to as many repeated payloads, some 20 MB of digests, rows meet them by broadcast in one reading; the result is the same.
BROADCAST_PAYLOADS = 100_000
#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, record_id string, bundle string, frame int, frame_at long, frame_bytes int, offset int, length int"
READ = "record_id string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long"


def _store(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def record(page_id: int | None, record_id: str, url: str | None, html: bytes, digest: str, revisit: bool, first: int | None) -> bytes:
    """One WARC record: the HTTP response, or of a revisit its headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if revisit else http + html
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if first is not None:
            lines.append(f"Refers-To-Page-ID: {first}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and where the next begins."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = dict(x.split(": ", 1) for x in lines)
    begin = stop + 4
    end = begin + int(headers["Content-Length"])
    return headers, data[begin:end], end + 4


class Bundle:
    """Writes frames one after the other, and the seek table at the end."""

    def __init__(self, address: str):
        store, path = _store(address)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.address, self.at, self.sizes = store.open_output_stream(path, compression=None), address, 0, []
        self.pack = zstandard.ZstdCompressor(level=3)

    def frame(self, data: bytes) -> tuple[int, int, int]:
        """Number, place and size of the frame that holds data."""
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.sizes.append((len(packed), len(data)))
        self.at += len(packed)
        return len(self.sizes) - 1, self.at - len(packed), len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def frames(address: str) -> Iterator[bytes]:
    """The content of each frame, found by the seek table."""
    store, path = _store(address)
    with store.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{address} has no seek table")
        f.seek(size - 9 - 8 * count)
        sizes = list(struct.iter_unpack("<II", f.read(8 * count)))
        f.seek(0)
        for packed, plain in sizes:
            yield zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)


def read_record(bundle: str, frame_at: int, frame_bytes: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry; only its frame is read."""
    store, path = _store(bundle)
    with store.open_input_file(path) as f:
        f.seek(frame_at)
        data = zstandard.ZstdDecompressor().decompress(f.read(frame_bytes))
    return parse(data, offset)[:2]


def _writer(folder: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, held, rows, size = None, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, rows, size
            where = bundle.frame(b"".join(held))
            out = [(*r[:2], bundle.address, *where, *r[2:]) for r in rows]
            held, rows, size = [], [], 0
            names = [x.split()[0] for x in INDEX.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for page_id, url, html, digest, again, first in zip(*(c.to_pylist() for c in batch.columns)):
                bundle = bundle or Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                name = str(uuid.UUID(bytes=hashlib.blake2b(f"{page_id}\n{url}\n{digest}".encode(), digest_size=16).digest()))
                data = record(page_id, name, url, html, digest, again, first)
                rows.append((page_id, name, size, len(data)))
                held.append(data)
                size += len(data)
                if size >= FRAME_BYTES:
                    yield flush()
        if rows:
            yield flush()
        if bundle:
            bundle.close()

    return write


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """(id, url, payload, digest, revisits): what each row's record holds; revisits is null for responses.

    Pages are read twice: for their digests, from which alone all is decided, and to be written. Where more
    than BROADCAST_PAYLOADS payloads are repeated, the second reading is one for each way that rows are matched.
    """
    data = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    keys = written(pages.select(F.col(id_col).alias("__llm_id"), F.sha1(data).alias("__llm_digest"), (F.length(data) >= least).alias("__llm_long")), "digests")
    per_id = keys.filter("__llm_long").groupBy("__llm_digest", "__llm_id").agg(F.count("*").alias("__llm_c"))
    per = per_id.groupBy("__llm_digest").agg(
        F.max("__llm_id").alias("__llm_first"),
        F.coalesce(F.max_by("__llm_c", "__llm_id"), F.sum("__llm_c")).alias("__llm_firsts"),
        F.sum("__llm_c").alias("__llm_n"),
    )
    per = written(per.filter("__llm_n > 1"), "payloads")
    payloads, total = per.count(), keys.count()
    rows = pages.select(F.col(id_col).alias("__llm_id"), F.col(url_col).alias("__llm_url"), data.alias("__llm_html"), F.sha1(data).alias("__llm_digest"))
    found = _matched(rows, per, payloads, total)
    is_first = F.col("__llm_id").eqNullSafe(F.col("__llm_first"))
    again = F.col("__llm_n").isNotNull() & is_first & (F.col("__llm_firsts") > 1)
    out = ["__llm_id", "__llm_url", "__llm_html", "__llm_digest"]
    revisit = F.col("__llm_n").isNotNull() & ~is_first
    made = found.filter(~again).select(*out, revisit.alias("__llm_revisit"), F.when(revisit, F.col("__llm_first")).alias("__llm_revisits"))
    if not per.filter("__llm_firsts > 1").isEmpty():  # rows that share id and payload: one of them, of a table written once, is the response
        rest = written(found.filter(again), "again").withColumn("__llm_row", F.monotonically_increasing_id())
        least_row = rest.groupBy("__llm_digest").agg(F.min("__llm_row").alias("__llm_least"), F.count("*").alias("__llm_c"))
        rest = join_counted(rest, least_row, "__llm_digest", "__llm_c", total).withColumn("__llm_revisit", F.col("__llm_row") != F.col("__llm_least"))
        made = made.unionByName(rest.select(*out, "__llm_revisit", F.when(F.col("__llm_revisit"), F.col("__llm_first")).alias("__llm_revisits")))
    return made


def _matched(rows: DataFrame, per: DataFrame, payloads: int, total: int) -> DataFrame:
    """rows with the columns of per, one row a repeated digest; NULL for others."""
    if payloads <= BROADCAST_PAYLOADS:
        return rows.join(F.broadcast(per), "__llm_digest", "left")
    # Only rows that a filter of the repeated digests points at are matched, those with very many copies by broadcast.
    words = bloom.words_for(payloads)
    hashed = per.withColumn("__llm_h", F.xxhash64("__llm_digest"))
    flagged = bloom.flag(rows.withColumn("__llm_h", F.xxhash64("__llm_digest")), "__llm_h", bloom.of_keys(hashed, "__llm_h", words), words, "__llm_hit").drop("__llm_h")
    hot = F.col("__llm_n") > F.lit(max(1000, int(total * HOT_SHARE)))
    added = [c for c in per.columns if c != "__llm_digest"]
    near = flagged.filter("__llm_hit").join(F.broadcast(per.filter(hot)), "__llm_digest", "left")
    far = near.filter("__llm_n is null").drop(*added).join(per.filter(~hot), "__llm_digest", "left")
    none = flagged.filter("not __llm_hit").withColumns({c: F.lit(None).cast(per.schema[c].dataType) for c in added})
    return near.filter("__llm_n is not null").unionByName(far).unionByName(none).drop("__llm_hit")


def write_bundles(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes a record for each row into folder (default: a new one in the shared folder).

    Returns the index, computed once: a row a record, with the columns of INDEX.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    return checkpoint(decide(pages, id_col, url_col, html_col, least).mapInArrow(_writer(folder), INDEX))


def _reader(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for bundle in batch.column(0).to_pylist():
            for data in frames(bundle):
                at, out = 0, []
                while at < len(data):
                    h, block, at = parse(data, at)
                    http, _, body = block.partition(b"\r\n\r\n")
                    kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{bundle}: a payload does not match its digest")
                    told = int(http.rpartition(b"Content-Length: ")[2])
                    page, first = h.get("Page-ID"), h.get("Refers-To-Page-ID")
                    ids = (page and int(page), first and int(first))
                    out.append((h["WARC-Record-ID"][10:-1], ids[0], kind, ids[1], digest, len(body) if kind == "response" else told))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of the bundles that the index names, read back from their frames by a task each (columns of READ)."""
    bundles = checkpoint(index.select("bundle").distinct())
    return bundles.repartition(max(1, bundles.count())).mapInArrow(_reader, READ)
