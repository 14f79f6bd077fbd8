"""Small images made of the embeddings: parts of ink, and a reference searched over scales."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import pixels
from quarry.plans.catalog import query
from quarry.sources.tables import read

SIDE = 8


def grey(spark, sf_dir: str, depth: int = 1) -> DataFrame:
    """(id, height, width, pixels): the first 64 components as a square, each on a scale of 0 to 255, `depth` bytes a pixel."""
    e = read(spark, sf_dir, "embeddings").where(F.size("embedding") >= SIDE * SIDE)
    level = lambda v: F.least(F.greatest(F.round(v * 400 + 128), F.lit(0.0)), F.lit(255.0)).cast("int")
    byte = lambda v: F.lpad(F.hex(level(v)), 2, "0")
    body = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, SIDE * SIDE), lambda v: F.repeat(byte(v.cast("double")), depth)), ""))
    return e.select(F.col("vec_id").alias("id"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), body.alias("pixels"))


def gold(spark, sf_dir: str) -> DataFrame:
    """(id, height, width, pixels): the same components as a colour image, four rows each, so that bars of one level and of
    several occur. Red is the level and 80, green the level, blue 50."""
    e = read(spark, sf_dir, "embeddings").where(F.size("embedding") >= SIDE * SIDE)
    level = lambda v: F.least(F.greatest(F.round(v * 400 + 128), F.lit(0.0)), F.lit(255.0)).cast("int")
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    pixel = lambda v: F.concat(two(F.least(level(v) + 80, F.lit(255))), two(level(v)), F.lit("32"))
    row = lambda i: F.repeat(F.array_join(F.transform(F.slice("embedding", i * SIDE + 1, SIDE), lambda v: pixel(v.cast("double"))), ""), 4)
    body = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), row), ""))
    return e.select(F.col("vec_id").alias("id"), F.lit(4 * SIDE).alias("height"), F.lit(SIDE).alias("width"), body.alias("pixels"))


def reference(spark, sf_dir: str) -> np.ndarray:
    """A corner of the first image, without its own corner (alpha)."""
    first = grey(spark, sf_dir, 3).orderBy("id").select("pixels").first()
    if first is None:
        return np.zeros((4, 4, 4), np.uint8)
    part = np.frombuffer(first[0], np.uint8).reshape(SIDE, SIDE, 3)[2:6, 3:7]
    alpha = np.full((4, 4, 1), 255, np.uint8)
    alpha[0, 0] = 0
    return np.concatenate([part, alpha], 2)


@query()
def pixel_components(spark, sf_dir):
    """Parts of ink of every image and the band of its letters; held against flood fill, since SQL has no fill."""
    return pixels.text_bands(grey(spark, sf_dir), ink=0.5).select(F.col("id").alias("vec_id"), "parts", "letters", "top", "bottom")


@query()
def multiscale_search(spark, sf_dir):
    """Score, scale and place of a reference in every image; held against nested loops."""
    found = pixels.search(grey(spark, sf_dir, 3), {"corner": reference(spark, sf_dir)}, (0.75, 1.0, 1.25), base=4, least=3)
    return found.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "scale", "x", "y")


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) >= 64),
px AS (SELECT vec_id, x, y, least(255, greatest(0, CAST(round(e[(y // 4) * 8 + x + 1] * 400 + 128) AS BIGINT))) AS g FROM v, range(2, 8) c(x), range(17, 32) r(y)),
rgb AS (SELECT *, least(255, g + 80) AS r FROM px),
run AS (SELECT *, y - row_number() OVER (PARTITION BY vec_id, x ORDER BY y) AS k FROM rgb WHERE r > 170 AND r > 90 AND g > 65),
span AS (SELECT vec_id, x, k, min(y) AS s, count(*) AS n FROM run GROUP BY vec_id, x, k QUALIFY row_number() OVER (PARTITION BY vec_id, x ORDER BY count(*) DESC, min(y)) = 1),
core AS (SELECT vec_id, x, any_value(span.n) AS n, count(r) AS c, sum(r) AS r1, sum(r * r) AS r2, sum(g) AS g1, sum(g * g) AS g2 FROM span LEFT JOIN rgb USING (vec_id, x) WHERE rgb.y >= s + 2 AND rgb.y < s + n - 2 OR (n <= 4 AND rgb.y = s) GROUP BY vec_id, x),
good AS (SELECT vec_id, x FROM core WHERE n >= 15 * 0.35 AND (n <= 4 OR sqrt(CAST(c * r2 - r1 * r1 AS DOUBLE)) / c + sqrt(CAST(c * g2 - g1 * g1 AS DOUBLE)) / c <= 20)),
bars AS (SELECT vec_id, count(*) AS bars FROM good a WHERE NOT EXISTS (SELECT 1 FROM good b WHERE b.vec_id = a.vec_id AND b.x = a.x - 1) GROUP BY 1)
SELECT vec_id, coalesce(bars, 0) AS bars, CASE bars WHEN 1 THEN 'i' WHEN 2 THEN 'ii' WHEN 3 THEN 'iii' END AS tier FROM v LEFT JOIN bars USING (vec_id)""")
def badge_tier(spark, sf_dir):
    """Tiers by the bars of a badge, in the corner of every image."""
    return pixels.badge_tiers(gold(spark, sf_dir)).select(F.col("id").alias("vec_id"), "bars", "tier")


@query()
def prepared_images(spark, sf_dir):
    """Mean of each colour of every image as a model takes it; held against a plain resize."""
    means = pixels.prepared_means(gold(spark, sf_dir))
    return means.select(F.col("id").alias("vec_id"), *[F.round(F.col("means")[i], 4).alias(c) for i, c in enumerate(("red", "green", "blue"))])
