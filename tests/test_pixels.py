"""Components against flood fill and the search against nested loops, on made-up images and on all rows of a table."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import pixels

DATA = "/root/testdata/sf0.01"
HAVE = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def fill(mask):
    """(top, bottom, left, right, pixels) by filling from each pixel in reading order."""
    seen, out = set(), []
    for y, x in np.argwhere(mask).tolist():
        if (y, x) in seen:
            continue
        todo, part = [(y, x)], []
        seen.add((y, x))
        while todo:
            a, b = todo.pop()
            part.append((a, b))
            for c in range(a - 1, a + 2):
                for d in range(b - 1, b + 2):
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and (c, d) not in seen:
                        seen.add((c, d))
                        todo.append((c, d))
        ys, xs = zip(*part, strict=True)
        out.append([min(ys), max(ys) + 1, min(xs), max(xs) + 1, len(part)])
    return out


@pytest.mark.parametrize("share", [0.0, 0.1, 0.3, 0.45, 0.6, 1.0])
def test_boxes_equal_flood_fill(share):
    rng = np.random.default_rng(int(share * 100))
    for h, w in ((1, 1), (1, 40), (40, 1), (13, 17), (60, 90)):
        mask = rng.random((h, w)) < share
        assert pixels.boxes(mask).tolist() == fill(mask)
    spiral = np.zeros((21, 21), bool)
    for k in range(0, 10, 2):
        spiral[k, k : 21 - k] = spiral[k : 21 - k, 20 - k] = spiral[20 - k, k : 21 - k] = True
        spiral[k + 2 : 21 - k, k] = True
        spiral[k + 2, k : k + 2] = True
    assert pixels.boxes(spiral).tolist() == fill(spiral)


def loops(region, ref, scales, base, least):
    best = (-1.0, None, None, None)
    for s in scales:
        n = max(least, round(base * s))
        if n >= min(region.shape[:2]):
            continue
        part = pixels.resampled(ref, n)
        on = part[:, :, 3] > 127
        for y in range(region.shape[0] - n + 1):
            for x in range(region.shape[1] - n + 1):
                a, b = part[:, :, :3][on], region[y : y + n, x : x + n][on].astype(float)
                low = np.sqrt((a * a).sum() * (b * b).sum())
                score = round(float((a * b).sum() / low), 9) if low > 1e-9 else -1.0
                if score > best[0]:
                    best = (score, s, x, y)
    return best


def test_search_equals_loops():
    rng = np.random.default_rng(3)
    region = rng.integers(0, 256, (30, 41, 3)).astype(np.uint8)
    ref = np.concatenate([region[7:19, 20:32], rng.integers(0, 256, (12, 12, 1))], 2).astype(np.uint8)
    got = pixels.best_match(region, ref, (0.8, 1.0, 1.3, 9.0), 12, 8)
    want = loops(region, ref, (0.8, 1.0, 1.3, 9.0), 12, 8)
    assert got[1:] == want[1:] == (1.0, 20, 7) and abs(got[0] - 1) < 1e-8
    assert pixels.best_match(np.zeros((20, 20, 3), np.uint8), ref, (1.0,), 12, 8) == (-1.0, None, None, None)
    flat = np.full((12, 12, 4), 200, np.uint8)
    assert (pixels.resampled(flat, 7) == 200).all() and pixels.resampled(ref, 12).tolist() == ref.tolist()


def test_images_that_are_none(spark):
    rows = [(1, 2, 2, bytes([255, 0, 0, 255])), (2, 2, 2, b"xx"), (3, None, 2, None), (4, 2, 2, bytes(4))]
    df = spark.createDataFrame(rows, "id long, height int, width int, pixels binary")
    assert [tuple(r) for r in pixels.components(df).collect()] == [(1, 0, 0, 2, 0, 2, 2, False)]
    assert {r.id: (r.parts, r.top) for r in pixels.text_bands(df).collect()} == {1: (1, None), 2: (0, None), 3: (0, None), 4: (0, None)}
    assert pixels.components(df.limit(0)).count() == 0


@HAVE
def test_all_images(spark):
    from quarry.plans import QUERIES
    from quarry.plans import pixels as plan

    got = {r.vec_id: tuple(r)[1:] for r in QUERIES["pixel_components"](spark, DATA).collect()}
    rows = plan.grey(spark, DATA).collect()
    assert len(got) == len(rows) > 0
    for r in rows:
        parts = fill(np.frombuffer(r.pixels, np.uint8).reshape(8, 8) / 255 > 0.5)
        letters = [p for p in parts if p[1] - p[0] >= 4 and p[3] - p[2] <= 1.3 * (p[1] - p[0])]
        band = (max(min(p[0] for p in letters) - 3, 0), min(max(p[1] for p in letters) + 3, 8)) if letters else (None, None)
        assert got[r.id] == (len(parts), len(letters), *band)
    assert any(v[1] for v in got.values()) and any(not v[1] for v in got.values())
    ref = plan.reference(spark, DATA)
    found = {r.vec_id: tuple(r)[1:] for r in QUERIES["multiscale_search"](spark, DATA).collect()}
    for r in plan.grey(spark, DATA, 3).collect():
        want = loops(np.frombuffer(r.pixels, np.uint8).reshape(8, 8, 3), ref, (0.75, 1.0, 1.25), 4, 3)
        assert abs(found[r.id][0] - want[0]) < 2e-6 and found[r.id][1:] == want[1:]


def bars_by_loops(x):
    h, w = x.shape[:2]
    part = x[int(h * 0.55) : h, int(w * 0.35) : w].astype(int)
    good = []
    for column in part.transpose(1, 0, 2):
        best, at, run = 0, 0, 0
        for i, (r, g, b) in enumerate(column.tolist()):
            run = run + 1 if r > 170 and r > b + 40 and g > b + 15 else 0
            if run > best:
                best, at = run, i + 1 - run
        core = column[at + 2 : at + best - 2]
        good.append(best > 0 and best >= len(column) * 0.35 and (best <= 4 or core.std(0).sum() <= 20 + 1e-9))
    return sum(a and not b for a, b in zip(good, [False] + good, strict=False))


def test_bars_equal_loops():
    rng = np.random.default_rng(5)
    seen = set()
    for h, w in ((48, 48), (10, 7), (1, 1), (30, 4)):
        for _ in range(60):
            x = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
            for _ in range(rng.integers(0, 5)):
                left, top = rng.integers(0, w), rng.integers(0, h)
                shade = rng.integers(0, 25, (h - top, 1, 3)) if rng.random() < 0.5 else 0
                x[top:, left : left + rng.integers(1, 4)] = np.array([200, 160, 60]) + shade
            assert pixels.bars(x) == bars_by_loops(x)
            seen.add(pixels.bars(x))
    assert {0, 1, 2, 3} <= seen
    assert pixels.bars(np.zeros((0, 0, 3), np.uint8)) == 0


def resized(line, size):
    """One row or column of levels by a triangle as wide as the coarser grid's pixel."""
    n, out = len(line), []
    wide = max(n / size, 1.0)
    for i in range(size):
        w = [max(0.0, 1 - abs((j + 0.5) - (i + 0.5) * n / size) / wide) for j in range(n)]
        out.append(min(255, max(0, int(np.floor(sum(a * float(b) for a, b in zip(w, line, strict=True)) / sum(w) + 0.5 + 1e-9)))))
    return out


@pytest.mark.parametrize("shape", [(6, 9), (300, 5), (224, 224)])
def test_prepared_equals_plain_resize(shape):
    x = np.random.default_rng(7).integers(0, 256, (*shape, 3)).astype(np.uint8)
    got = pixels.prepared(x)
    assert got.shape == (3, 224, 224) and got.dtype == np.float32
    mean, deviation = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
    columns = (0, 1, 100, 223)
    for c in range(3):
        lines = [resized(row, 224) for row in x[:, :, c].tolist()] if x.shape[1] != 224 else x[:, :, c].tolist()
        for at in columns:
            want = (np.array(resized([row[at] for row in lines], 224)) / 255 - mean[c]) / deviation[c]
            assert np.abs(got[c, :, at] - want).max() < 1e-5


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def part(no, value):
    """A field of a protocol buffer: a number, or bytes with their length."""
    return varint(no << 3) + varint(value) if isinstance(value, int) else varint(no << 3 | 2) + varint(len(value)) + value


def pooling_model():
    """A model file: means over quarters of the image, 12 numbers."""
    ints = lambda name: part(5, part(1, name) + part(8, 112) + part(8, 112) + part(20, 7))
    pool = part(1, b"input") + part(2, b"p") + part(4, b"AveragePool") + ints(b"kernel_shape") + ints(b"strides")
    flat = part(1, b"p") + part(2, b"embedding") + part(4, b"Flatten")
    shape = lambda *dims: part(2, b"".join(part(1, part(2, d) if isinstance(d, bytes) else part(1, d)) for d in dims))
    value = lambda name, *dims: part(1, name) + part(2, part(1, part(1, 1) + shape(*dims)))
    graph = part(1, pool) + part(1, flat) + part(2, b"g") + part(11, value(b"input", b"n", 3, 224, 224)) + part(12, value(b"embedding", b"n", 12))
    return part(1, 7) + part(7, graph) + part(8, part(2, 13))


def test_vectors_by_a_model(spark, tmp_path):
    from quarry.operators.image_vectors import embed

    path = tmp_path / "model.onnx"
    path.write_bytes(pooling_model())
    rng = np.random.default_rng(9)
    made = {i: rng.integers(0, 256, (8 + i, 11, 3)).astype(np.uint8) for i in range(40)}
    rows = [(i, *x.shape[:2], x.tobytes()) for i, x in made.items()] + [(90, 2, 2, None), (91, 3, 3, b"x")]
    df = spark.createDataFrame(rows, "id long, height int, width int, pixels binary").withColumn("extra", F.lit(1))
    got = {r.id: r.vector for r in embed(df, str(path)).collect()}
    assert got.pop(90) is None and got.pop(91) is None and got.keys() == made.keys()
    for i, x in made.items():
        quarters = pixels.prepared(x).reshape(3, 2, 112, 2, 112).mean((2, 4)).ravel()
        assert np.allclose(got[i], quarters / np.linalg.norm(quarters), atol=1e-4)
    assert embed(df.limit(0), str(path)).count() == 0
    none = embed(df, str(tmp_path / "absent.onnx")).collect()
    assert len(none) == 42 and all(r.vector is None for r in none)


def test_badges_that_are_none(spark):
    rows = [(1, 2, 2, None), (2, 2, 2, bytes(11)), (3, 2, 2, bytes(12)), (4, 20, 1, bytes([200, 160, 60] * 20))]
    df = spark.createDataFrame(rows, "id long, height int, width int, pixels binary")
    assert {r.id: (r.bars, r.tier) for r in pixels.badge_tiers(df).collect()} == {1: (None, None), 2: (None, None), 3: (0, None), 4: (1, "i")}
    assert {r.id for r in pixels.prepared_means(df).where("means is null").collect()} == {1, 2}


@HAVE
def test_all_prepared(spark):
    from quarry.plans import QUERIES
    from quarry.plans import pixels as plan

    got = {r.vec_id: (r.red, r.green, r.blue) for r in QUERIES["prepared_images"](spark, DATA).collect()}
    rows = plan.gold(spark, DATA).collect()
    assert len(got) == len(rows) > 0
    mean, deviation = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
    for r in rows[::200]:
        x = np.frombuffer(r.pixels, np.uint8).reshape(32, 8, 3)
        for c in range(3):
            wide = [resized(row, 224) for row in x[:, :, c].tolist()]
            full = np.array([resized(list(column), 224) for column in zip(*wide, strict=True)])
            assert abs(got[r.id][c] - (full.mean() / 255 - mean[c]) / deviation[c]) < 2e-4
