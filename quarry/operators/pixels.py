"""Pixel operators over tables of images, in Arrow batches: connected components, the band of text, search over scales.

An image is a row: id, height, width, pixels (bytes row by row; one per pixel for grey ones). Images of a batch are worked on
together; an image is never split, and rows are independent, so tasks need no shuffle. A null image, or one whose bytes do not
fit its size, has no components and no match.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Brightness of ink, least height and greatest width by height of a letter, rows around a band of text.
INK = 0.45
LEAST_HEIGHT = 4
WIDEST = 1.3
PAD = 3
# Fixed values of a badge: its corner of an image, the least height of a bar by that of the corner, the rows trimmed from
# each end of a bar, the greatest spread of what is left, summed over colours, and the tier that so many bars say.
BADGE_ROWS = (0.55, 1.0)
BADGE_COLUMNS = (0.35, 1.0)
BAR_HEIGHT = 0.35
TRIM = 2
SPREAD = 20.0
TIERS = {1: "i", 2: "ii", 3: "iii"}
# The side of a model's input, and mean and deviation of its colours.
SIDE = 224
MEAN = np.array([0.485, 0.456, 0.406], np.float32)
DEVIATION = np.array([0.229, 0.224, 0.225], np.float32)


def row_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of each horizontal run of a mask, in reading order."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def touching(row: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in neighbouring rows that touch, corners included."""
    span = width + 4
    begin, end = row * span + first, row * span + last  # both ascend
    lo = np.searchsorted(end, begin - span - 1)
    hi = np.searchsorted(begin, end - span + 1, side="right")
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    return np.repeat(np.arange(len(row)), n), np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least run of each run's component: least neighbours and jumps until nothing changes."""
    up = np.arange(n)
    while True:
        least = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], least)
        np.minimum.at(new, up[b], least)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == up).all():
            return up
        up = new


def boxes(mask: np.ndarray) -> np.ndarray:
    """(top, bottom, left, right, pixels) of each component of a mask, ends exclusive, by the first pixel in reading order."""
    row, first, last = row_runs(mask)
    if not len(row):
        return np.zeros((0, 5), np.int64)
    root, which = np.unique(settle(len(row), *touching(row, first, last, mask.shape[1])), return_inverse=True)
    out = np.empty((len(root), 5), np.int64)
    for i, (values, least) in enumerate(((row, True), (row + 1, False), (first, True), (last + 1, False))):
        held = np.full(len(root), np.iinfo(np.int64).max if least else -1)
        (np.minimum if least else np.maximum).at(held, which, values)
        out[:, i] = held
    out[:, 4] = np.bincount(which, weights=last - first + 1)
    return out


def image(data: bytes | None, height: int | None, width: int | None, depth: int = 1) -> np.ndarray | None:
    if data is None or not height or not width or len(data) != height * width * depth:
        return None
    return np.frombuffer(data, np.uint8).reshape(height, width, depth) if depth > 1 else np.frombuffer(data, np.uint8).reshape(height, width)


def components(images: DataFrame, ink: float = INK) -> DataFrame:
    """(id, no, top, bottom, left, right, pixels, letter): the parts of ink of each grey image, and whether one has a letter's shape."""
    schema = pa.schema([("id", pa.int64()), *((c, pa.int32()) for c in ("no", "top", "bottom", "left", "right")), ("pixels", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            kept, found = [], []
            for i, data, h, w in zip(*(b.column(c).to_pylist() for c in ("id", "pixels", "height", "width")), strict=True):
                if (x := image(data, h, w)) is not None:
                    got = boxes(x / 255.0 > ink)
                    found.append(np.column_stack([np.arange(len(got)), got]))
                    kept += [i] * len(got)
            flat = np.concatenate([np.zeros((0, 6), np.int64), *found])
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), *(pa.array(flat[:, k], f.type) for k, f in enumerate(list(schema)[1:]))], schema=schema)

    cols = ["id", "height", "width", "pixels"]
    found = images.select(*cols).mapInArrow(run, "id long, no int, top int, bottom int, left int, right int, pixels long")
    tall, wide = F.col("bottom") - F.col("top"), F.col("right") - F.col("left")
    return found.withColumn("letter", (tall >= LEAST_HEIGHT) & (wide <= tall * WIDEST))


def text_bands(images: DataFrame, ink: float = INK) -> DataFrame:
    """(id, parts, letters, top, bottom): the rows from the highest to the lowest letter and PAD around them, within the image; null
    where no part is a letter."""
    per = components(images, ink).groupBy("id").agg(F.count("*").alias("parts"), F.count_if("letter").alias("letters"), F.min(F.when(F.col("letter"), F.col("top"))).alias("t"), F.max(F.when(F.col("letter"), F.col("bottom"))).alias("b"))
    out = images.select("id", "height").join(per, "id", "left")
    zero = F.lit(0).cast("long")
    return out.select("id", F.coalesce("parts", zero).alias("parts"), F.coalesce("letters", zero).alias("letters"), F.greatest(F.col("t") - PAD, F.when(F.col("t").isNotNull(), 0)).alias("top"), F.when(F.col("b").isNotNull(), F.least(F.col("b") + PAD, F.col("height"))).alias("bottom"))


def bars(x: np.ndarray) -> int:
    """Bars of a badge in the corner of a colour image (height, width, 3): groups of adjacent columns whose longest run of gold
    (the earliest of equals) is high enough and, but for its trimmed ends, of about one colour."""
    (top, bottom), (left, right) = ([int(n * f) for f in part] for n, part in zip(x.shape, (BADGE_ROWS, BADGE_COLUMNS), strict=False))
    part = x[top:bottom, left:right].astype(np.int64)
    if not part.size:
        return 0
    r, g, b = np.moveaxis(part, 2, 0)
    gold = (r > 170) & (r > b + 40) & (g > b + 15)
    run = np.cumsum(gold, 0)
    run = run - np.maximum.accumulate(np.where(gold, 0, run), 0)  # gold pixels up to here without a gap
    n, end = run.max(0), run.argmax(0) + 1
    # sums of what lies between the trimmed ends, from sums of all rows above
    above = lambda v: np.concatenate([np.zeros((1, *v.shape[1:]), np.int64), np.cumsum(v, 0)])
    column, core = np.arange(len(n)), np.maximum(n - 2 * TRIM, 0)
    low, high = end - n + TRIM, end - TRIM
    low, high = np.where(core > 0, low, 0), np.where(core > 0, high, 0)
    total, square = (t[high, column] - t[low, column] for t in (above(part), above(part * part)))
    spread = (np.sqrt(core[:, None] * square - total * total) / np.maximum(core, 1)[:, None]).sum(1)
    good = (n >= (bottom - top) * BAR_HEIGHT) & (n > 0) & ((core == 0) | (spread <= SPREAD))
    return int((good & ~np.concatenate([[False], good[:-1]])).sum())


def badge_tiers(images: DataFrame) -> DataFrame:
    """(id, bars, tier) of colour images (three bytes a pixel); no tier unless there are one, two or three bars, nulls for a row
    that is no image."""
    schema = pa.schema([("id", pa.int64()), ("bars", pa.int64()), ("tier", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            read = (image(d, h, w, 3) for d, h, w in zip(*(b.column(c).to_pylist() for c in ("pixels", "height", "width")), strict=True))
            n = [None if x is None else bars(x) for x in read]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array([TIERS.get(k) for k in n], pa.string())], schema=schema)

    return images.select("id", "height", "width", "pixels").mapInArrow(run, "id long, bars long, tier string")


def weights(n: int, size: int) -> np.ndarray:
    """(size, n): how much of each of n pixels goes into each of `size`; a triangle as wide as a pixel of the coarser grid."""
    scale = n / size
    at = (np.arange(size)[:, None] + 0.5) * scale - (np.arange(n)[None, :] + 0.5)
    w = np.maximum(0.0, 1.0 - np.abs(at) / max(scale, 1.0))
    return w / w.sum(1, keepdims=True)


def prepared(x: np.ndarray) -> np.ndarray:
    """A colour image as a model takes it: (3, SIDE, SIDE), whole levels after each pass of the resize, then by mean and deviation."""
    level = lambda v: np.clip(np.floor(v + 0.5 + 1e-9), 0, 255)  # noqa: E731; halves go up, whatever the order of the sum
    wide = level(weights(x.shape[1], SIDE) @ x.astype(np.float64))
    full = level(np.tensordot(weights(x.shape[0], SIDE), wide, 1)).astype(np.float32)
    return np.ascontiguousarray(((full / np.float32(255)) - MEAN).transpose(2, 0, 1) / DEVIATION[:, None, None], np.float32)


def prepared_means(images: DataFrame) -> DataFrame:
    """(id, means): each colour's mean over an image as a model takes it; null for a row that is no image."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            read = (image(d, h, w, 3) for d, h, w in zip(*(b.column(c).to_pylist() for c in ("pixels", "height", "width")), strict=True))
            means = [None if x is None else prepared(x).mean((1, 2), dtype=np.float64).tolist() for x in read]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array(means, pa.list_(pa.float64()))], names=["id", "means"])

    return images.select("id", "height", "width", "pixels").mapInArrow(run, "id long, means array<double>")


def resampled(x: np.ndarray, size: int) -> np.ndarray:
    """A square of this side, bilinear between pixel centres; (height, width, depth) in, floats out."""
    out = x.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high, part = np.minimum(low + 1, n - 1), at - low
        part = part.reshape([-1 if k == axis else 1 for k in range(3)])
        out = np.take(out, low, axis) * (1 - part) + np.take(out, high, axis) * part
    return out


def correlation(region: np.ndarray, part: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked normalised cross-correlation of a part at every place of a region, -1 where it is not defined. Both are (height,
    width, depth); sums over all places at once come by the Fourier transform of the padded region."""
    h, w = region.shape[:2]
    k = part.shape[0]
    shape = (h, w)

    def slide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        full = np.fft.irfft2(np.fft.rfft2(a, shape, (0, 1)) * np.conj(np.fft.rfft2(b, shape, (0, 1))), shape, (0, 1))
        return full[: h - k + 1, : w - k + 1].sum(2)

    kept = part * mask
    top = slide(region, kept)
    power = slide(region * region, np.broadcast_to(mask, part.shape).astype(np.float64))
    low = np.sqrt(np.maximum(power, 0) * (kept * kept).sum())
    return np.where(low > 1e-9, top / np.where(low > 1e-9, low, 1), -1.0)


def best_match(region: np.ndarray, reference: np.ndarray, scales: Sequence[float], base: int, least: int) -> tuple[float, float | None, int | None, int | None]:
    """(score, scale, x, y) of a reference with alpha (height, width, 4) in a region (height, width, 3): the first best over scales,
    then rows, then columns, scores to nine digits. Scales at which the reference is not smaller than the region are left out."""
    found: tuple[float, float | None, int | None, int | None] = (-1.0, None, None, None)
    for scale in scales:
        size = max(least, round(base * scale))
        if size >= min(region.shape[:2]):
            continue
        part = resampled(reference, size)
        got = np.round(correlation(region.astype(np.float64), part[:, :, :3], part[:, :, 3:] > 127), 9)
        y, x = np.unravel_index(got.argmax(), got.shape)
        if got[y, x] > found[0]:
            found = (float(got[y, x]), scale, int(x), int(y))
    return found


def search(images: DataFrame, references: dict[str, np.ndarray], scales: Sequence[float] = (0.85, 0.9, 0.95, 1.0, 1.05, 1.1, 1.15), base: int = 48, least: int = 8) -> DataFrame:
    """(id, reference, score, scale, x, y) of every reference in every colour image (three bytes a pixel). The references are a
    closed set that a person keeps, and go to the tasks as they are."""
    names = sorted(references)
    schema = pa.schema([("id", pa.int64()), ("reference", pa.string()), ("score", pa.float64()), ("scale", pa.float64()), ("x", pa.int32()), ("y", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for i, data, h, w in zip(*(b.column(c).to_pylist() for c in ("id", "pixels", "height", "width")), strict=True):
                region = image(data, h, w, 3)
                for name in names if region is not None else ():
                    rows.append((i, name, *best_match(region, references[name], scales, base, least)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return images.select("id", "height", "width", "pixels").mapInArrow(run, "id long, reference string, score double, scale double, x int, y int")
