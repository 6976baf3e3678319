"""Media columns: documents as images in archives, read by a Spark data source.

A payload is stored as the 8-bit grey samples of a PNG of 192 columns. Archives
hold members one after another, then a directory (doc_id, offset, lengths and
CRC-32 of each member) in pages, a fence for each page (its first offset and
CRC-32) and a footer, so a range of bytes is read by itself, with the fences and
the pages that its members stand in. The data source ``leafplan_archive`` plans ranges of bytes over the
archives, reads the members that begin in a range, streams them in bounded
Arrow batches, and reads a member again from its offset if it fails.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import append_columns, filesystem, freeing, new_folder, quoted

WIDTH = 192
MAGIC = b"LPARCH02"
#: A task begins a new archive beyond so many bytes, a read batch ends beyond so many.
ARCHIVE_BYTES, BATCH_BYTES = 256 << 20, 8 << 20
#: Bytes of an archive that one read partition covers.
RANGE_BYTES = 8 << 20
TRIES = 4
#: Entries of a directory page.
PAGE = 1024
_ENTRY = np.dtype([("id", "<i8"), ("valid", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("n_bytes", "<u8"), ("crc", "<u8")])
_FENCE = np.dtype([("offset", "<u8"), ("crc", "<u8")])
_FOOTER = struct.Struct("<QQQQ8s")
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# -- the format --------------------------------------------------------------


def pad(raw: bytes) -> bytes:
    """``raw`` with spaces up to a positive multiple of the width."""
    return raw + b" " * (WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG whose samples are ``payload``, row by row, without filters."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG made by :func:`to_png`, with all its checksums tried."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, data, shape = 8, [], (0, 0)
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a damaged PNG chunk")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
            shape = (height, width)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def image_feature(payload: bytes) -> str:
    """A 64-bit mean hash of the image in 8 x 8 cells and its mean sample in thousandths.

    Rows are cut into 8 bands as even as can be (a band without a row takes the
    next one), columns into 8 of 24. A cell's bit says whether its mean is over
    the mean of all cells, compared as exact fractions of whole sums.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    h = len(rows)
    columns = rows.reshape(h, 8, WIDTH // 8).sum(axis=2, dtype=np.int64)
    totals = np.concatenate([np.zeros((1, 8), np.int64), columns.cumsum(axis=0)])
    low = np.minimum(np.arange(8) * h // 8, h - 1)
    high = np.maximum(low + 1, (np.arange(8) + 1) * h // 8)
    means = (totals[high] - totals[low]) / ((high - low)[:, None] * (WIDTH // 8))
    bits = (means > means.mean()).ravel()
    mean = int(totals[-1].sum()) * 1000 // (h * WIDTH)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}:{mean}"


# -- archives ----------------------------------------------------------------


def directory_bytes(entries: list[tuple], at: int) -> bytes:
    """The pages of a directory that begins at ``at``, their fences and the footer."""
    table = np.array(entries, _ENTRY)
    pages = [table[k : k + PAGE] for k in range(0, len(table), PAGE)]
    fences = np.array([(int(p["offset"][0]), zlib.crc32(p.tobytes())) for p in pages], _FENCE).tobytes()
    return table.tobytes() + fences + _FOOTER.pack(at, len(table), len(pages), zlib.crc32(fences), MAGIC)


def write_archives(docs: DataFrame, folder: str | None = None, *, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Stores each row's text as a media member; the folder with the archives.

    Members are (doc_id, PNG of the padded UTF-8 text; null: of no bytes). A
    task names its archives anew each time it runs; ``_members`` in the folder
    lists those of tasks that succeeded, and only they are read. A row for each
    archive comes to the driver.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "media")

    def run(batches):
        import pyarrow as pa

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, entries = None, "", 0, []

        def close():
            nonlocal out, entries, at
            tail = directory_bytes(entries, at)
            out.write(tail)
            out.close()
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [at + len(tail)], "members": [len(entries)]})
            out, entries, at = None, [], 0
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.arch"
                    out = fs.open_output_stream(f"{root}/{name}")
                raw = (text.as_py() or "").encode()
                media = to_png(pad(raw))
                out.write(media)
                entries.append((doc.as_py() or 0, doc.is_valid, at, len(media), len(raw), zlib.crc32(media)))
                at += len(media)
                if at >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    rows = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text")).mapInArrow(freeing(run), "path string, bytes long, members long").collect()
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/_members") as out:
        out.write("".join(f"{r['bytes']} {r['path']}\n" for r in sorted(rows)).encode())
    return folder


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, size: int):
        self.path, self.start, self.stop, self.size = path, start, stop, size


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self):
        """Ranges of bytes over the listed archives; no archive is opened here."""
        fs, root = filesystem(self.folder)
        with fs.open_input_stream(f"{root}/_members") as f:
            listed = [line.split(" ", 1) for line in f.read().decode().splitlines()]
        found = [_Range(path, a, min(a + self.range_bytes, int(size)), int(size)) for size, path in listed for a in range(0, int(size), self.range_bytes)]
        return found or [_Range("", 0, 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        if not partition.path:
            return
        fs, path = filesystem(partition.path)
        members: list[tuple] = []
        held = 0
        for entry, media in read_members(fs, path, partition.size, partition.start, partition.stop):
            members.append((int(entry["id"]) if entry["valid"] else None, int(entry["n_bytes"]), media))
            held += len(media)
            if held >= BATCH_BYTES:
                yield self._batch(pa, members)
                members, held = [], 0
        if members:
            yield self._batch(pa, members)

    @staticmethod
    def _batch(pa, members):
        ids, sizes, media = zip(*members)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _again(action):
    """What ``action`` gives, tried several times; its last error if all fail."""
    for k in range(TRIES):
        try:
            return action()
        except (OSError, ValueError):
            if k == TRIES - 1:
                raise
            time.sleep(0.1 * 2**k)


def read_members(fs, path: str, size: int, start: int, stop: int) -> Iterator[tuple]:
    """Entry and bytes of each member that begins in [start, stop)."""

    def directory():
        with fs.open_input_file(path) as f:
            at, n, pages, crc, magic = _FOOTER.unpack(f.read_at(_FOOTER.size, size - _FOOTER.size))
            raw = f.read_at(pages * _FENCE.itemsize, at + n * _ENTRY.itemsize) if magic == MAGIC else b""
            if magic != MAGIC or zlib.crc32(raw) != crc:
                raise ValueError(f"{path}: damaged directory")
            fences = np.frombuffer(raw, _FENCE)
            first = max(0, int(np.searchsorted(fences["offset"], start, "right")) - 1)
            last = int(np.searchsorted(fences["offset"], stop, "left"))
            raw = f.read_at(min(n - first * PAGE, max(0, last - first) * PAGE) * _ENTRY.itemsize, at + first * PAGE * _ENTRY.itemsize)
            entries = np.frombuffer(raw, _ENTRY)
            if any(zlib.crc32(entries[(k - first) * PAGE : (k - first + 1) * PAGE].tobytes()) != fences["crc"][k] for k in range(first, last)):
                raise ValueError(f"{path}: damaged directory")
            return entries

    entries = _again(directory)
    mine = entries[(entries["offset"] >= start) & (entries["offset"] < stop)]
    file = None
    for entry in mine:

        def member(entry=entry):
            nonlocal file
            try:
                file = file or fs.open_input_file(path)
                media = file.read_at(int(entry["length"]), int(entry["offset"]))
                if zlib.crc32(media) != int(entry["crc"]):
                    raise ValueError(f"{path}: damaged member at {int(entry['offset'])}")
                return media
            except (OSError, ValueError):
                # The next try opens the archive anew and reads this member alone.
                file = None
                raise

        yield entry, _again(member)


class ArchiveSource(DataSource):
    """``spark.read.format("leafplan_archive").load(folder)``: doc_id, n_bytes, media."""

    @classmethod
    def name(cls):
        return "leafplan_archive"

    def schema(self):
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema):
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The members in ``folder`` as rows ``doc_id, n_bytes, media``."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("leafplan_archive").options(**options).load(folder)


def media_features(members: DataFrame, *, carry: list[str] | None = None) -> DataFrame:
    """Decodes ``media`` and adds sizes, checksums and the image feature.

    ``payload_bytes, payload_sha256, tail_crc32`` are of the decoded samples,
    ``media_bytes, media_sha256`` of the stored form. All depend on the media
    alone, so equal texts have equal values.
    """

    def make():
        def features(media):
            out = []
            for m in media:
                raw = m.as_py()
                payload = from_png(raw)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), image_feature(payload)))
            return [list(c) for c in zip(*out)]

        return features

    return append_columns(members, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make, uses=("media",), carry=carry)


def media_table(docs: DataFrame, folder: str | None = None, *, with_media: bool = True) -> DataFrame:
    """Stores ``docs`` as media, reads them back and computes their features.

    One row for each row of ``docs``: ``doc_id, n_bytes`` (of the text as
    UTF-8), the columns of :func:`media_features`, and ``media`` if asked for.
    A null text is stored like an empty one, a null doc_id comes back as null,
    equal rows are members of their own with equal values, a text of any length
    is one member (held whole by one task), and an empty table gives an empty
    one. No column but doc_id and text is read.
    """
    members = read_archives(docs.sparkSession, write_archives(docs, folder))
    return media_features(members, carry=["doc_id", "n_bytes", *["media"] * with_media])
