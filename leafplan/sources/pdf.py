"""PDF export: grey or colour pages on fixed paper, one file for a group."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafplan.operators.kernels import to_array

#: A4 in points, portrait.
A4 = (595.276, 841.89)


def place(width: int, height: int, paper: tuple[float, float]) -> tuple[float, float, float, float]:
    """Left, bottom, width and height of an image that fits the paper, centred."""
    scale = min(paper[0] / width, paper[1] / height)
    w, h = width * scale, height * scale
    return (paper[0] - w) / 2, (paper[1] - h) / 2, w, h


def pdf_bytes(pages: list[np.ndarray], *, landscape: bool = False) -> bytes:
    """A PDF with one image a page, losslessly compressed."""
    if not pages:
        raise ValueError("a PDF needs a page")
    paper = A4[::-1] if landscape else A4
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for a in pages:
        a = a if a.ndim == 3 else a[..., None]
        color = b"/DeviceGray" if a.shape[2] == 1 else b"/DeviceRGB"
        raw = zlib.compress(np.ascontiguousarray(a if a.shape[2] == 1 else a[..., 2::-1]).tobytes(), 6)
        x, y, w, h = place(a.shape[1], a.shape[0], paper)
        drawing = b"q %.3f 0 0 %.3f %.3f %.3f cm /I Do Q" % (w, h, x, y)
        n = len(objects) + 1
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (a.shape[1], a.shape[0], color, len(raw), raw))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(drawing), drawing))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.3f %.3f] /Resources << /XObject << /I %d 0 R >> >> /Contents %d 0 R >>" % (*paper, n, n + 1))
        kids.append(b"%d 0 R" % (n + 2))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    out, offsets = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def grouped_pdfs(pages: DataFrame, *, group: str = "group_key", order: str = "position", landscape: bool = False) -> DataFrame:
    """``group, pdf, n_pages``: the pages of a group in their order, one document.

    Columns: group, order, image. A document is as large as its pages together;
    they go through one task in turn. Groups of one task follow one another.
    """
    given = pages.select(F.col(group).cast("string").alias("g"), F.col(order).alias("o"), "image")

    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([pdf_bytes(held, landscape=landscape)], pa.binary()), pa.array([len(held)], pa.int32())], names=[group, "pdf", "n_pages"])

        for batch in batches:
            for k in range(batch.num_rows):
                g = batch.column(0)[k].as_py()
                if held and g != key:
                    yield done()
                    held = []
                key = g
                held.append(to_array(batch.column(2)[k].as_py()))
        if held:
            yield done()

    return given.repartition("g").sortWithinPartitions("g", "o").mapInArrow(run, f"{group} string, pdf binary, n_pages int")
