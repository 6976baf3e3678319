"""Pixel kernels in NumPy, and the columns that carry images through Spark.

An image is a struct (height, width, channels, data) with 8-bit samples row by
row, channels in the order blue, green, red as Spark's ``image`` source has
them. A kernel is a function of arrays; ``map_images`` applies it one image at a
time, in small Arrow batches, and turns an exception into an error column, so
one bad image doesn't end a job.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

IMAGE = "struct<height:int,width:int,channels:int,data:binary>"


def to_array(image) -> np.ndarray:
    """The samples of an image struct as height x width x channels."""
    if image is None or image["height"] <= 0 or not image["data"]:
        raise ValueError("DECODE_FAILED")
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["channels"])


def to_struct(a: np.ndarray) -> dict:
    a = np.ascontiguousarray(a if a.ndim == 3 else a[..., None], np.uint8)
    return {"height": a.shape[0], "width": a.shape[1], "channels": a.shape[2], "data": a.tobytes()}


def map_images(rows: DataFrame, kernel: Callable[..., dict], schema: str, *, image: str = "image", uses: tuple[str, ...] = (), keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """``keep``, what ``kernel(array, *uses)`` gives, and ``error`` (null, or what went wrong)."""
    fields = T.StructType.fromDDL(schema)
    given = rows.select(*keep, image, *uses)
    out = T.StructType([given.schema[k] for k in keep] + list(fields) + [T.StructField("error", T.StringType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                try:
                    made, error = kernel(to_array(row[len(keep)]), *row[len(keep) + 1 :]), None
                except Exception as e:  # one image's failure is a row, not the end
                    made, error = {}, str(e) or type(e).__name__
                values = [*row[: len(keep)], *[made.get(f.name) for f in fields], error]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kinds)], schema=kinds)

    return given.mapInArrow(run, out)


# -- colour and size -----------------------------------------------------------


def gray(a: np.ndarray) -> np.ndarray:
    """Luminance of a blue, green, red image; alpha lies over white."""
    if a.ndim == 2 or a.shape[2] == 1:
        return a.reshape(a.shape[:2])
    f = a[..., :3].astype(float)
    if a.shape[2] == 4:
        alpha = a[..., 3:] / 255.0
        f = f * alpha + 255.0 * (1 - alpha)
    return np.clip(np.rint(f @ (0.114, 0.587, 0.299)), 0, 255).astype(np.uint8)


def sample(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples at points; outside, the nearest edge counts."""
    h, w = a.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if a.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    f = a.astype(float)
    return (f[y0, x0] * (1 - fx) + f[y0, x1] * fx) * (1 - fy) + (f[y1, x0] * (1 - fx) + f[y1, x1] * fx) * fy


def resize(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with centres of pixels matched."""
    h, w = a.shape[:2]
    x = (np.arange(width) + 0.5) * w / width - 0.5
    y = (np.arange(height) + 0.5) * h / height - 0.5
    return np.clip(np.rint(sample(a, *np.meshgrid(x, y))), 0, 255).astype(np.uint8)


def blur(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a square window, by running sums; the border repeats."""
    p = np.pad(a.astype(float), radius, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * radius + 1
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def turn(a: np.ndarray, orientation: int) -> np.ndarray:
    """An image turned upright by its EXIF orientation."""
    steps = {2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.swapaxes(0, 1), 6: lambda x: x[::-1].swapaxes(0, 1), 7: lambda x: x[::-1, ::-1].swapaxes(0, 1), 8: lambda x: x[:, ::-1].swapaxes(0, 1)}
    return steps.get(orientation, lambda x: x)(a)


# -- perspective ---------------------------------------------------------------


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The projective map that takes four points to four others."""
    rows = []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.append(np.linalg.solve(np.array(rows, float), np.asarray(dst, float).ravel()), 1).reshape(3, 3)


def project(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.c_[points, np.ones(len(points))] @ m.T
    return p[:, :2] / p[:, 2:]


def warp(a: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quadrilateral straightened to a rectangle, by inverse bilinear sampling."""
    target = np.array([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], float)
    m = homography(target, np.asarray(corners, float))
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    p = project(m, np.c_[x.ravel(), y.ravel()])
    out = sample(a, p[:, 0].reshape(height, width), p[:, 1].reshape(height, width))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def page_size(corners: np.ndarray, *, aspect: float | None = None) -> tuple[int, int]:
    """Sides after straightening; with ``aspect`` (long over short) the shorter is widened to it."""
    c = np.asarray(corners, float)
    side = lambda i, j: np.hypot(*(c[i] - c[j]))
    w, h = max(side(0, 1), side(3, 2)), max(side(1, 2), side(0, 3))
    if aspect:
        if w >= h:
            w, h = max(w, h * aspect), max(h, w / aspect)
        else:
            w, h = max(w, h / aspect), max(h, w * aspect)
    return max(1, round(w)), max(1, round(h))


# -- masks ---------------------------------------------------------------------


def fill_polygon(corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels whose centres lie in a convex polygon."""
    c = np.asarray(corners, float)
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    sides = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(c, np.roll(c, -1, axis=0))]
    return np.all([s >= -1e-9 for s in sides], axis=0) | np.all([s <= 1e-9 for s in sides], axis=0)


def mask_iou(a: np.ndarray, b: np.ndarray) -> float | None:
    """Null for different shapes; two empty masks are equal."""
    if a.shape != b.shape:
        return None
    union = np.count_nonzero(a | b)
    return np.count_nonzero(a & b) / union if union else 1.0


def quad_in_mask(corners: np.ndarray, mask: np.ndarray) -> tuple[float, float]:
    """Overlap of a quadrilateral with a mask, and the part of the mask within it."""
    inside = fill_polygon(corners, mask.shape[1], mask.shape[0])
    both, area = np.count_nonzero(inside & mask), np.count_nonzero(mask)
    union = np.count_nonzero(inside | mask)
    return (both / union if union else 0.0), (both / area if area else 0.0)


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels from 1 of the 8-connected parts of a mask, in order of their first pixel."""
    labels, n = np.zeros(mask.shape, np.int32), 0
    h, w = mask.shape
    for y, x in zip(*np.nonzero(mask)):
        if labels[y, x]:
            continue
        n += 1
        labels[y, x] = n
        queue = deque([(y, x)])
        while queue:
            cy, cx = queue.popleft()
            for ny in range(max(cy - 1, 0), min(cy + 2, h)):
                for nx in range(max(cx - 1, 0), min(cx + 2, w)):
                    if mask[ny, nx] and not labels[ny, nx]:
                        labels[ny, nx] = n
                        queue.append((ny, nx))
    return labels, n


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    return blur(mask, radius) > 1 - 1e-9


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    return blur(mask, radius) > 1e-9


def clean_mask(probability: np.ndarray, threshold: float = 0.5, radius: int = 1) -> np.ndarray:
    """Thresholded, then opened and closed."""
    mask = probability >= threshold
    mask = dilate(erode(mask, radius), radius)
    return erode(dilate(mask, radius), radius)


def component_table(mask: np.ndarray, probability: np.ndarray | None = None) -> list[dict]:
    """Label, area, box, centrality, confidence, border contact and score of each part.

    The score weighs area 0.45, centrality 0.20, confidence 0.25 and distance
    from the border 0.10.
    """
    labels, n = components(mask)
    h, w = mask.shape
    out = []
    for label in range(1, n + 1):
        ys, xs = np.nonzero(labels == label)
        far = np.hypot(xs.mean() - (w - 1) / 2, ys.mean() - (h - 1) / 2) / max(1e-9, np.hypot(w, h) / 2)
        confidence = float(probability[ys, xs].mean()) if probability is not None else 1.0
        touches = bool(xs.min() == 0 or ys.min() == 0 or xs.max() == w - 1 or ys.max() == h - 1)
        ratio = len(xs) / (h * w)
        score = 0.45 * min(1.0, ratio / 0.5) + 0.20 * max(0.0, 1 - far) + 0.25 * confidence + 0.10 * (not touches)
        out.append({"label": label, "area": len(xs), "x0": int(xs.min()), "y0": int(ys.min()), "x1": int(xs.max()), "y1": int(ys.max()), "confidence": confidence, "touches_border": touches, "score": float(score)})
    return out


# -- segmentation tensors --------------------------------------------------------


def letterbox(a: np.ndarray, size: int, *, stretch: bool = False, fill: int = 114) -> tuple[np.ndarray, float, float, int, int]:
    """A square input: the resized image, its scales and offsets."""
    h, w = a.shape[:2]
    if stretch:
        return resize(a, size, size), size / w, size / h, 0, 0
    scale = min(size / w, size / h)
    nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
    left, top = (size - nw) // 2, (size - nh) // 2
    out = np.full((size, size, *a.shape[2:]), fill, np.uint8)
    out[top : top + nh, left : left + nw] = resize(a, nw, nh)
    return out, nw / w, nh / h, left, top


def to_tensor(a: np.ndarray, mean: tuple = (0.0, 0.0, 0.0), std: tuple = (1.0, 1.0, 1.0)) -> np.ndarray:
    """1 x 3 x height x width, red first, in [0, 1] and then normalised."""
    f = a[..., 2::-1].astype(np.float32) / 255.0
    return ((f - np.float32(mean)) / np.float32(std)).transpose(2, 0, 1)[None]


def decode_logits(output: np.ndarray, activation: str = "auto") -> np.ndarray:
    """Document probability (height x width) of a model's output.

    One channel goes through a sigmoid, two through a softmax whose second is
    the document; ``auto`` leaves values alone that are probabilities already.
    """
    a = np.squeeze(np.asarray(output, np.float32))
    if a.ndim == 2:
        a = a[None]
    elif a.ndim == 3 and a.shape[-1] <= 4 < a.shape[0]:
        a = a.transpose(2, 0, 1)
    if a.ndim != 3:
        raise ValueError("output isn't an image")
    if activation == "auto" and a.min() >= 0 and a.max() <= 1:
        return a[-1]
    if len(a) == 1:
        return 1 / (1 + np.exp(-a[0]))
    e = np.exp(a - a.max(axis=0))
    return (e / e.sum(axis=0))[1]


# -- edges -----------------------------------------------------------------------


def edge_map(a: np.ndarray) -> np.ndarray:
    """Gradient magnitude of the smoothed luminance (Sobel), scaled to [0, 1]."""
    g = blur(gray(a), 1)
    p = np.pad(g, 1, mode="edge")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    m = np.hypot(dx, dy)
    return m / max(1e-9, m.max())


def edge_support(edges: np.ndarray, corners: np.ndarray, *, band: int = 3, samples: int = 64, strong: float = 0.2) -> list[float]:
    """For each side, the part of its sample points with a strong edge within the band across it."""
    c, out = np.asarray(corners, float), []
    for a, b in zip(c, np.roll(c, -1, axis=0)):
        t = np.linspace(0.05, 0.95, samples)[:, None]
        along = a + t * (b - a)
        d = (b - a) / max(1e-9, np.hypot(*(b - a)))
        across = along[:, None, :] + np.arange(-band, band + 1)[None, :, None] * np.array([-d[1], d[0]])
        values = sample(edges, across[..., 0], across[..., 1])
        out.append(float((values.max(axis=1) >= strong).mean()))
    return out


def corner_search(edges: np.ndarray, corner: tuple[float, float], radius: int = 12) -> tuple[float, float, float]:
    """The strongest edge point near a corner: x, y and strength; of equals the nearest."""
    h, w = edges.shape
    x0, y0 = max(0, int(corner[0]) - radius), max(0, int(corner[1]) - radius)
    roi = edges[y0 : min(h, int(corner[1]) + radius + 1), x0 : min(w, int(corner[0]) + radius + 1)]
    if not roi.size:
        return corner[0], corner[1], 0.0
    ys, xs = np.mgrid[: roi.shape[0], : roi.shape[1]]
    far = np.hypot(xs + x0 - corner[0], ys + y0 - corner[1])
    k = np.lexsort((far.ravel(), -roi.ravel()))[0]
    return float(xs.ravel()[k] + x0), float(ys.ravel()[k] + y0), float(roi.ravel()[k])


def fit_line(points: np.ndarray, tolerance: float = 2.0) -> dict:
    """Total least squares line, fitted again to its inliers: normal, offset, confidence, status."""
    p = np.asarray(points, float)
    if len(p) < 2:
        return {"status": "too_few_points", "confidence": 0.0}

    def fit(q):
        m = q.mean(axis=0)
        _, _, v = np.linalg.svd(q - m, full_matrices=False)
        normal = np.array([-v[0][1], v[0][0]])
        return normal, float(normal @ m), v[0]

    normal, offset, way = fit(p)
    near = np.abs(p @ normal - offset) <= tolerance
    if near.sum() >= 2:
        normal, offset, way = fit(p[near])
    rest = np.abs(p @ normal - offset)
    near = rest <= tolerance
    extent = float(np.ptp(p[near] @ way)) if near.any() else 0.0
    confidence = 0.45 * near.mean() + 0.30 * min(1.0, near.sum() / 12) + 0.20 * max(0.0, 1 - (float(np.sqrt((rest[near] ** 2).mean())) if near.any() else tolerance) / tolerance) + 0.05 * min(1.0, extent / 100)
    return {"status": "fitted", "nx": float(normal[0]), "ny": float(normal[1]), "offset": offset, "inliers": int(near.sum()), "confidence": float(confidence)}


# -- enhancement -----------------------------------------------------------------


def enhance_gray(a: np.ndarray, strength: float = 0.6) -> np.ndarray:
    """Local contrast evened out, then sharpened."""
    g = gray(a).astype(float)
    r = max(2, min(g.shape) // 16)
    mean = blur(g, r)
    spread = np.sqrt(np.maximum(blur(g * g, r) - mean * mean, 0)) + 8
    even = 128 + (g - mean) * np.minimum(2.0, 48 / spread)
    mixed = (1 - strength) * g + strength * even
    return np.clip(np.rint(mixed + 0.5 * (mixed - blur(mixed, 1))), 0, 255).astype(np.uint8)


def enhance_bw(a: np.ndarray, radius: int | None = None) -> np.ndarray:
    """Paper to white: luminance over its background, then a tone curve."""
    g = gray(a).astype(float)
    background = np.maximum(blur(g, radius or max(2, min(g.shape) // 12)), 1)
    flat = np.clip(g / background, 0, 1)
    return np.clip(np.rint(255 * np.clip((flat - 0.55) / 0.40, 0, 1)), 0, 255).astype(np.uint8)


def enhance_color(a: np.ndarray, strength: float = 0.5) -> np.ndarray:
    """Luminance evened out, colours kept in proportion."""
    g = gray(a).astype(float)
    gain = ((1 - strength) * g + strength * enhance_gray(a)) / np.maximum(g, 1)
    return np.clip(np.rint(a[..., :3] * gain[..., None]), 0, 255).astype(np.uint8)


def enhance(a: np.ndarray, mode: str) -> np.ndarray:
    modes = {"gray": enhance_gray, "bw": enhance_bw, "color": enhance_color, "smart_document": lambda x: enhance_color(x, 0.8)}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode}")
    return modes[mode](a)


def readability_inputs(before: np.ndarray, after: np.ndarray) -> dict:
    """What the readability score of an enhancement is made of."""
    e0, e1 = edge_map(before) > 0.2, edge_map(after) > 0.2
    g = gray(after).astype(float)
    return {"edge_recall": float((e0 & e1).sum() / max(1, e0.sum())), "contrast": float(min(1.0, g.std() / 64)), "density": float(min(1.0, (g < 128).mean() * 5))}
