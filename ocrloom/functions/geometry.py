"""Input plans and polygons as column expressions. A polygon is an array of four [x, y] arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sizes and limits of detector and recognizer inputs.
RECOGNIZER_INPUT_HEIGHT, RECOGNIZER_INPUT_WIDTH = 48, 320
DETECTOR_LIMIT_SIDE, DETECTOR_MAX_SIDE = 736.0, 4000.0
MAX_CROP_SIDE, MAX_CROP_PIXELS = 4096, 8_000_000
RECOGNITION_BATCH = 6
FLOAT_EPSILON = 1.1920928955078125e-07


def _checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def detector_ratio(width: Column, height: Column, max_side: int | None) -> Column:
    """Scale down to max_side; without it, up to the least side and down again to the largest."""
    w, h = width.cast("double"), height.cast("double")
    if max_side is not None:
        if max_side <= 0:
            raise ValueError("detector maximum side must be positive")
        return F.least(F.lit(float(max_side)) / F.greatest(w, h), F.lit(1.0))
    up = F.when(F.least(w, h) < DETECTOR_LIMIT_SIDE, F.lit(DETECTOR_LIMIT_SIDE) / F.least(w, h)).otherwise(F.lit(1.0))
    return F.when(F.greatest(w, h) * up > DETECTOR_MAX_SIDE, F.lit(DETECTOR_MAX_SIDE) / F.greatest(w, h)).otherwise(up)


def aligned_dimension(value: Column) -> Column:
    """The nearest multiple of 32, at least 32; halves go up."""
    ok = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value / 32 <= 134217727)
    return _checked(ok, (F.greatest(F.round(value / 32), F.lit(1.0)) * 32).cast("long"), "invalid resized image dimension")


def detector_input(width: Column, height: Column, max_side: int | None) -> tuple[Column, Column]:
    ratio = detector_ratio(width, height, max_side)
    return aligned_dimension(width * ratio), aligned_dimension(height * ratio)


def to_source(value: Column, source: Column, content: Column) -> Column:
    """A detector coordinate in the source image, kept within it."""
    return F.least(F.greatest(value * source / content, F.lit(0.0)), source.cast("double"))


def corners(width: Column, height: Column) -> Column:
    w, h, zero = width.cast("double"), height.cast("double"), F.lit(0.0)
    return F.array(F.array(zero, zero), F.array(w, zero), F.array(w, h), F.array(zero, h))


def point(polygon: Column, k: int) -> Column:
    return F.get(polygon, k)


def distance(a: Column, b: Column) -> Column:
    dx, dy = F.get(a, 0) - F.get(b, 0), F.get(a, 1) - F.get(b, 1)
    return F.sqrt(dx * dx + dy * dy)


def polygon_width(polygon: Column) -> Column:
    return F.greatest(distance(point(polygon, 0), point(polygon, 1)), distance(point(polygon, 3), point(polygon, 2)))


def polygon_height(polygon: Column) -> Column:
    return F.greatest(distance(point(polygon, 0), point(polygon, 3)), distance(point(polygon, 1), point(polygon, 2)))


def aspect_ratio(polygon: Column) -> Column:
    return polygon_width(polygon) / F.greatest(polygon_height(polygon), F.lit(FLOAT_EPSILON))


def polygon_center(polygon: Column) -> tuple[Column, Column]:
    x, y = (sum((F.get(point(polygon, k), c) for k in range(1, 4)), F.get(point(polygon, 0), c)) / 4 for c in (0, 1))
    return x, y


def bounded_crop(width: Column, height: Column) -> tuple[Column, Column]:
    """Size of a crop in whole pixels, scaled down within side and area limits."""
    ok = ~F.isnan(width) & ~F.isnan(height) & (width > 0) & (height > 0)
    scale = F.least(F.lit(float(MAX_CROP_SIDE)) / F.greatest(width, height), F.sqrt(F.lit(float(MAX_CROP_PIXELS)) / (width * height)), F.lit(1.0))
    return tuple(_checked(ok, F.least(F.greatest(F.round(x * scale), F.lit(1.0)), F.lit(float(MAX_CROP_SIDE))).cast("long"), "invalid crop size") for x in (width, height))  # type: ignore[return-value]


def scaled_recognizer_width(width: Column, height: Column) -> Column:
    """Width at the recognizer's height, rounded up; width and height in whole pixels."""
    return F.greatest(F.floor((RECOGNIZER_INPUT_HEIGHT * width + height - 1) / height), F.lit(1)).cast("long")


def content_width(polygon: Column) -> Column:
    return scaled_recognizer_width(*bounded_crop(polygon_width(polygon), polygon_height(polygon)))


def batch_width(widest: Column) -> Column:
    """Canvas of a batch: its widest content, at least the standard width, as a multiple of four."""
    return (F.floor((F.greatest(widest, F.lit(RECOGNIZER_INPUT_WIDTH)) + 3) / 4) * 4).cast("long")
